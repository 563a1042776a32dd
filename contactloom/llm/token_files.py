"""Token ids in files of Simple-8b words.

A word of 64 bits has a selector in its top four bits and packs as many ids as fit the
other 60: 60 of one bit, 30 of two, down to one of 60. Selector 1 is a run of up to 120
zeros. An id over 60 bits is an escape: a word of selector 0 stands before the raw word,
and the block lists where. Ids are coded in groups of ``GROUP``; the block holds the word
offset of each group, so a reader can start anywhere and decodes a whole block with a few
array operations. A block holds whole documents: their ids and lengths stand before the
words. Blocks are rows of a Parquet table in the shared folder, in ascending doc_id order
within and across shards; Spark's commit protocol makes a lost task harmless.

Defined results: a document lies in one block, so that one of any length is one block (of at most 2 GB, the bound of a value in
Spark, as of its text); a null text has the end id alone; null doc_ids come first and are kept;
rows with the same doc_id are each kept, ordered by a hash of their text; an empty table
gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import NO_ID, batches, python_ready, restored_id, stored
from contactloom.llm.tokens import encoder

GROUP = 8192
#: Ids after which a block ends with the document.
BLOCK = 1 << 18
#: (ids, bits) of each selector from 1. Fixed values of the format.
PACKS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
OF_COUNT = {count: s for s, (count, _) in enumerate(PACKS, 1)}
HEAD = struct.Struct("<4sIQQQQ")


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, the word offset of each group, and the word positions of escapes."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    slim = ids.astype(np.uint32) if int(ids.max()) < 1 << 32 else ids
    # one row for each group, with room behind it where nothing fits: no word reaches over the end of a group
    n_groups, room = -(-n // GROUP), PACKS[0][0]
    holds = np.zeros((n_groups, GROUP), dtype=np.uint8)
    for count, bits in reversed(PACKS):
        fits = np.zeros((n_groups, GROUP + room), dtype=bool)
        narrow = slim < (1 << bits) if bits < 60 or slim is ids else np.ones(n, dtype=bool)
        whole = n // GROUP
        fits[:whole, :GROUP] = narrow[: whole * GROUP].reshape(whole, GROUP)
        if whole < n_groups:
            fits[whole, : n - whole * GROUP] = narrow[whole * GROUP :]
        width = 1
        while width < count and fits.any():
            more = min(width, count - width)
            fits[:, : GROUP + room - more] &= fits[:, more:].copy()
            width += more
        if fits.any():
            np.maximum(holds, fits[:, :GROUP] * np.uint8(count), out=holds)
    holds = holds.reshape(-1)[:n]
    step = np.maximum(holds, 1)
    # where the next word begins, and the one eight words on: the loop then takes eight at once
    after = np.append(np.arange(n, dtype=np.int32) + step, np.int32(n))
    leap = after
    for _ in range(3):
        leap = leap[leap]
    leaps, heads, i = memoryview(leap), [], 0
    take = heads.append
    while i < n:
        take(i)
        i = leaps[i]
    chosen = [np.array(heads, dtype=np.int32)]
    for _ in range(7):
        chosen.append(after[chosen[-1]])
    first = np.stack(chosen, axis=1).ravel().astype(np.int64)
    first = first[first < n]
    picked = np.array([OF_COUNT.get(c, 0) for c in range(room + 1)])[holds[first]]
    place = np.arange(len(first))
    if not picked.all():
        place += np.concatenate([[0], np.cumsum(picked == 0)[:-1]])
    words = np.zeros(len(first) + int((picked == 0).sum()), dtype=np.uint64)
    padded = np.concatenate([ids, np.zeros(room, np.uint64)])
    for s in np.unique(picked).tolist():
        own = picked == s
        p, w = first[own], place[own]
        if s == 0:
            words[w + 1] = ids[p]
            continue
        count, bits = PACKS[s - 1]
        packed = np.full(len(p), s << 60, dtype=np.uint64)
        for j in range(count if bits else 0):
            packed |= padded[p + j] << np.uint64(j * bits)
        words[w] = packed
    starts = np.searchsorted(first, np.arange(0, n, GROUP))
    return words, place[starts].astype(np.uint32), place[picked == 0].astype(np.uint64)


def decode_words(words: np.ndarray, groups: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of :func:`encode_words`, all groups at once."""
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), dtype=bool)
    raw[(escapes + np.uint64(1)).astype(np.int64)] = True
    selector = (words >> np.uint64(60)).astype(np.int64)
    selector[escapes.astype(np.int64)] = -1
    counts = np.array([0] + [c for c, _ in PACKS] + [0], dtype=np.int64)[selector]
    counts[raw], selector[raw] = 1, 0
    last = np.append(groups[1:].astype(np.int64), len(words)) - 1
    sizes = np.full(len(groups), GROUP, dtype=np.int64)
    sizes[-1] = n - GROUP * (len(groups) - 1)
    counts[last] += sizes - np.add.reduceat(counts, groups.astype(np.int64))
    start = np.cumsum(counts) - counts
    out = np.zeros(n, dtype=np.uint64)
    out[start[raw]] = words[raw]
    for s in np.unique(selector[selector > 0]).tolist():
        count, bits = PACKS[s - 1]
        own = np.flatnonzero(selector == s)
        for j in range(count if bits else 0):
            held = own[counts[own] > j]
            out[start[held] + j] = (words[held] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out


def write_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, groups, escapes = encode_words(ids)
    head = HEAD.pack(b"S8B1", len(groups), len(doc_ids), len(ids), len(words), len(escapes))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes(), groups.astype("<u4").tobytes()])


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block."""
    magic, n_groups, n_docs, n_ids, n_words, n_escapes = HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a block of token ids")
    at, parts = HEAD.size, []
    for kind, n in (("<i8", n_docs), ("<i8", n_docs), ("<u8", n_escapes), ("<u8", n_words), ("<u4", n_groups)):
        parts.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += np.dtype(kind).itemsize * n
    doc_ids, lengths, escapes, words, groups = parts
    return doc_ids, lengths, decode_words(words, groups, escapes, n_ids)


def write_token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Encode every text and write the blocks; returns the written table: shard, block, ids_before
    (ids of the shard before the block), n_docs, n_ids, payload."""
    docs = python_ready(docs)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        keys, parts, lengths = [], [], []

        def written() -> pd.DataFrame:
            nonlocal block, before
            ids = np.concatenate(parts)
            payload = write_block(np.array(keys, dtype=np.int64), np.array(lengths, dtype=np.int64), ids)
            row = pd.DataFrame({"shard": [shard], "block": [block], "ids_before": [before], "n_docs": [len(keys)], "n_ids": [len(ids)], "payload": [payload]})
            block, before = block + 1, before + len(ids)
            keys.clear(), parts.clear(), lengths.clear()
            return row

        for frame in frames:
            texts, names = frame["text"].tolist(), frame["doc_id"].tolist()
            for a, b in batches(texts):
                ids, sizes = encoder(path).encode(texts[a:b])
                ends = np.cumsum(sizes)
                keys += names[a:b]
                lengths += (sizes + 1).tolist()
                parts.append(np.insert(ids, ends, np.uint32(end_id)))
                if sum(map(len, parts)) >= BLOCK:
                    yield written()
        if keys:
            yield written()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    return stored(rows.mapInPandas(encode, "shard int, block int, ids_before long, n_docs long, n_ids long, payload binary"), "token-files")


def read_token_files(files: DataFrame, digest: bool = True) -> DataFrame:
    """One row for each document, read back from the blocks: doc_id, start, n_tokens, and ids_crc32 or
    (without ``digest``) the ids. The driver holds one number for each shard."""
    spark = files.sparkSession
    totals = sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    shards = [s for s, _ in totals]
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(np.int64).tolist()
    base = spark.sparkContext.broadcast(dict(zip(shards, starts, strict=False)))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, before, payload in zip(frame["shard"], frame["ids_before"], frame["payload"], strict=True):
                doc_ids, lengths, ids = read_block(payload)
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                first = ends - lengths
                out = pd.DataFrame({"doc_id": doc_ids, "start": base.value[shard] + before + first, "n_tokens": lengths})
                own = [ids[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                out["ids_crc32" if digest else "ids"] = [zlib.crc32(x.tobytes()) for x in own] if digest else [x.astype(np.int64) for x in own]
                yield out

    last = "ids_crc32 long" if digest else "ids array<long>"
    return restored_id(files.select("shard", "ids_before", "payload").mapInPandas(decode, f"doc_id long, start long, n_tokens long, {last}"), "doc_id")
