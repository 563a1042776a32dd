"""BAM files as a Spark data source, decoded with numpy.

A block-compressed file is cut into splits of equal size, a task for each. Where a split's first record begins isn't
written anywhere, so a first pass guesses it from what records look like and walks from there over all records of the
split, to the place where the first record of a later split begins. The guess is right exactly if the walk of the splits
before ends there; the driver compares the two, from the header on, and has a split walked anew where they differ. So no
guess enters the result, and as the walks count the records, these are numbered in the file's order. Small files and
those without block sizes are read by one task.

Files of any scheme that Arrow's file systems know (``s3://``, ``gs://``, ``hdfs://``) are read
through them, others have to be readable where executors run.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from contactloom.functions.cigar import OPERATIONS, place

SCHEMA = (
    "rg string, name string, mate int, flag int, read_length bigint, read_start bigint, read_end bigint, strand string, chrom_id int, "
    "start_pos bigint, end_pos bigint, mapping_quality smallint, identity float, filter_reason string, ordinal bigint"
)
ARROW = pa.schema(
    [("rg", pa.string()), ("name", pa.string()), ("mate", pa.int32()), ("flag", pa.int32()), ("read_length", pa.int64()), ("read_start", pa.int64()), ("read_end", pa.int64()), ("strand", pa.string()), ("chrom_id", pa.int32()),
     ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("mapping_quality", pa.int16()), ("identity", pa.float32()), ("filter_reason", pa.string()), ("ordinal", pa.int64())]
)
#: The fixed part of a record, with its size before it.
FIXED = np.dtype(
    [("size", "<i4"), ("contig", "<i4"), ("pos", "<i4"), ("name_size", "u1"), ("quality", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_bases", "<i4"), ("next_contig", "<i4"), ("next_pos", "<i4"), ("span", "<i4")]
)
#: Compressed bytes of a split, and inflated bytes that are decoded at once.
SPLIT, PIECE = 4 << 20, 4 << 20
#: Bytes of a value of each tag type. Fixed values of the format.
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_CODE = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}


def opened(path: str):
    scheme = path.partition("://")[0] if "://" in path else "file"
    if scheme == "file":
        return open(path.removeprefix("file://"), "rb")
    own, place = fs.FileSystem.from_uri(path)
    return own.open_input_file(place)


def created(path: str):
    """A new file, written by an executor."""
    scheme = path.partition("://")[0] if "://" in path else "file"
    if scheme == "file":
        return open(path.removeprefix("file://"), "wb")
    own, place = fs.FileSystem.from_uri(path)
    return own.open_output_stream(place)


def block_size(head: bytes) -> int | None:
    """The compressed size of a block, from its first bytes; None for a gzip member that doesn't say."""
    if head[:4] != b"\x1f\x8b\x08\x04" or len(head) < 12:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def blocks(path: str, start: int, search: bool = False, sums: bool = True) -> Iterator[tuple[int, bytes]]:
    """Places and inflated bytes of the blocks from ``start`` on, which is a block's or, to ``search``, any place.
    Who reads them a second time may leave out their checksums with ``sums``."""
    with opened(path) as f:
        f.seek(start)
        held, at = f.read(1 << 20), 0
        while at < len(held):
            if len(held) - at < 1 << 17:
                start, held, at = start + at, held[at:] + f.read(1 << 20), 0
            size = block_size(held[at : at + 300])
            if search:
                # a block has another, or the file's end, behind it
                if size is None or size > 1 << 16 or (at + size < len(held) and block_size(held[at + size : at + size + 300]) is None):
                    further = held.find(b"\x1f\x8b\x08\x04", at + 1)
                    at = further if further > 0 else max(at + 1, len(held) - 3)
                    continue
                search = False
            if size is None:
                raise ValueError("the file is cut off" if len(held) - at < 18 else "a block doesn't say its size")
            if at + size > len(held):
                raise ValueError("the file is cut off")
            extra = int.from_bytes(held[at + 10 : at + 12], "little")
            crc, plain = struct.unpack_from("<II", held, at + size - 8)
            data = zlib.decompress(held[at + 12 + extra : at + size - 8], -15, max(plain, 1))
            if len(data) != plain or (sums and zlib.crc32(data) != crc):
                raise ValueError(f"the block at {start + at} is damaged")
            if data:
                yield start + at, data
            at += size


def inflated(path: str) -> Iterator[bytes]:
    """The uncompressed blocks of a file of gzip members. A member without its end is an error."""
    with opened(path) as f:
        rest = f.read(1 << 16)
        if rest[:4] == b"CRAM":
            raise ValueError("CRAM isn't supported")
        while rest:
            state = zlib.decompressobj(31)
            while not state.eof:
                if not rest:
                    raise ValueError("the file is cut off")
                if out := state.decompress(rest):
                    yield out
                rest = state.unused_data if state.eof else f.read(1 << 16)
            rest = rest or f.read(1 << 16)


class Stream:
    def __init__(self, path: str):
        self.blocks, self.data = inflated(path), b""

    def more(self) -> bool:
        """Whether a byte follows."""
        while not self.data and (block := next(self.blocks, None)) is not None:
            self.data = block
        return bool(self.data)

    def take(self, n: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < n:
            block = next(self.blocks, None)
            if block is None:
                raise ValueError("the file is cut off")
            parts.append(block)
            have += len(block)
        joined = b"".join(parts)
        self.data = joined[n:]
        return joined[:n]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header(stream: Stream) -> list[tuple[str, int]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(stream.number())
    out = []
    for _ in range(stream.number()):
        name = stream.take(stream.number())[:-1].decode()
        out.append((name, stream.number()))
    return out


def tags(data: bytes) -> dict[str, object]:
    """RG and NM of a record's tags; the others are stepped over."""
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value: object = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", data, at + 1)[0]
            value, at = None, at + 5 + n * TAG_BYTES[chr(data[at])]
        else:
            size = TAG_BYTES[kind]
            value = struct.unpack_from("<" + TAG_CODE[kind], data, at)[0] if kind in TAG_CODE else None
            at += size
        if name in ("RG", "NM"):
            out[name] = value
    return out


def record(data: bytes, ordinal: int, with_identity: bool) -> tuple:
    contig, pos, name_size, quality, _, n_ops, flag, n_bases = struct.unpack_from("<iiBBHHHi", data)
    at = 32
    name = data[at : at + name_size - 1].decode()
    at += name_size
    raw = struct.unpack_from(f"<{n_ops}I", data, at)
    ops = [(v >> 4, OPERATIONS[v & 15]) for v in raw]
    at += 4 * n_ops + (n_bases + 1) // 2 + n_bases
    found = tags(data[at:])
    mate = 0
    if flag & 1:
        if bool(flag & 64) == bool(flag & 128):
            raise ValueError(f"paired read {name} is neither first nor second")
        mate = 1 if flag & 64 else 2
    rg, strand = found.get("RG", ""), "-" if flag & 16 else "+"
    if flag & 4 or contig < 0:
        return (rg, name, mate, flag | 4, None, None, None, strand, None, None, None, quality, None, "", ordinal)
    # records that every import leaves out need no coordinates
    p = place(ops, bool(flag & 16), n_bases, found.get("NM"), with_identity and not flag & 1536)
    return (rg, name, mate, flag, p.read_length, p.read_start, p.read_end, strand, contig, pos, pos + p.reference_span, quality, p.identity, "", ordinal)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of the data behind one another, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def _texts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    own, bounds = _gathered(data, starts, sizes)
    out = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(own.tobytes()))
    out.validate(full=True)
    return out


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data[at[:, None] + np.arange(size)]).view(kind)[:, 0]


def _tag_values(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each record whether it has an NM number and which, the place and size of its RG in the returned bytes, and
    whether its tags are of a form that this doesn't know."""
    n = len(starts)
    own, bounds = _gathered(data, starts, sizes)
    own, at, ends = np.concatenate([own, np.zeros(16, np.uint8)]), bounds[:-1].copy(), bounds[1:]
    zeros = np.append(np.flatnonzero(own[: bounds[-1]] == 0), bounds[-1])
    has, nm, rg_at, rg_size, odd = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    left = np.flatnonzero(at < ends)
    while len(left):
        here, end = at[left], ends[left]
        name, kind, value = _numbers(own, here, "<u2"), own[here + 2], here + 3
        bad, step = value > end, np.full(len(left), -1, np.int64)
        for letter, size in TAG_BYTES.items():
            step[kind == ord(letter)] = size
        long = (kind == ord("Z")) | (kind == ord("H"))
        step[long] = zeros[np.minimum(np.searchsorted(zeros, value[long]), len(zeros) - 1)] - value[long] + 1
        several = np.flatnonzero((kind == ord("B")) & (value + 5 <= end))
        if len(several):
            each = np.array([TAG_BYTES.get(chr(c), -1) for c in own[value[several]]])
            step[several] = np.where(each > 0, 5 + _numbers(own, value[several] + 1, "<i4").astype(np.int64) * each, -1)
        bad |= (step < 0) | (value + step > end)
        is_nm, is_rg = ~bad & (name == int.from_bytes(b"NM", "little")), ~bad & (name == int.from_bytes(b"RG", "little"))
        whole = np.zeros(len(left), bool)
        for letter, code in TAG_CODE.items():
            mine = np.flatnonzero(is_nm & (kind == ord(letter)))
            if len(mine):
                nm[left[mine]], has[left[mine]], whole[mine] = _numbers(own, value[mine], "<" + np.dtype(code).str[1:]), True, True
        bad |= (is_nm & ~whole) | (is_rg & ~long)
        rg_at[left[is_rg]], rg_size[left[is_rg]] = value[is_rg], step[is_rg] - 1
        odd[left[bad]] = True
        at[left] = value + np.maximum(step, 0)
        left = left[~bad & (at[left] < end)]
    return has, nm, rg_at, rg_size, odd, own


def decoded(buffer: bytes, starts: np.ndarray, ordinal: int, with_identity: bool) -> pa.RecordBatch:
    """What :func:`record` gives for the records at ``starts``. Those that break a rule, or are of a form that isn't
    provided for here, are given to it, so it says what is wrong."""
    n, data = len(starts), np.frombuffer(buffer, np.uint8)
    r = np.ascontiguousarray(data[starts[:, None] + np.arange(FIXED.itemsize)]).view(FIXED)[:, 0]
    n_ops, n_bases, flag, ends = r["n_ops"].astype(np.int64), r["n_bases"].astype(np.int64), r["flag"].astype(np.int32), starts + 4 + r["size"]
    ops_at = starts + FIXED.itemsize + r["name_size"]
    tags_at = ops_at + 4 * n_ops + (n_bases + 1) // 2 + n_bases
    odd = (n_bases < 0) | (tags_at > ends) | (r["name_size"] == 0)
    if odd.any():
        # nothing of these may be read below
        ops_at, tags_at, n_ops = np.where(odd, starts, ops_at), np.where(odd, ends, tags_at), np.where(odd, 0, n_ops)
    has_nm, nm, rg_at, rg_size, odd_tags, tag_bytes = _tag_values(data, tags_at, ends - tags_at)
    raw, bounds = _gathered(data, ops_at, 4 * n_ops)
    raw = raw.view("<u4")
    op, size, owner = raw & 15, (raw >> 4).astype(np.int64), np.repeat(np.arange(n), n_ops)
    bounds = bounds // 4
    inner = np.arange(len(op)) - bounds[:-1][owner]
    broken = np.bincount(owner[(op >= len(OPERATIONS)) | (size < 1)], minlength=n) > 0
    total = np.zeros((n, len(OPERATIONS)), np.int64)
    known = op < len(OPERATIONS)
    np.add.at(total, (owner[known], op[known]), size[known])
    M, I, D, N, S, H, _, E, X = total.T  # noqa: E741
    clip = (op == OPERATIONS.index("S")) | (op == OPERATIONS.index("H"))
    first, last = np.full(n, 1 << 20), np.full(n, -1)
    np.minimum.at(first, owner[~clip], inner[~clip])
    np.maximum.at(last, owner[~clip], inner[~clip])
    hard = op == OPERATIONS.index("H")
    broken |= (last < 0) | (np.bincount(owner[~clip], minlength=n) != last - first + 1)
    broken |= np.bincount(owner[hard & (inner > 0) & (inner < n_ops[owner] - 1)], minlength=n) > 0
    sums = lambda where: np.bincount(owner[where], weights=size[where], minlength=n).astype(np.int64)
    before, after = sums(inner < first[owner]), sums(inner > last[owner])
    used = M + E + X
    in_sequence = used + I + S
    length, span = in_sequence + H, used + D + N
    broken |= ((n_bases > 0) & (n_bases != in_sequence)) | (before + after >= length) | (span == 0) | (length >= 1 << 32)
    wrong, gaps = np.where(has_nm, nm - I - D, X), I + D
    asked = (flag & 1536 == 0) & with_identity
    broken |= asked & np.where(has_nm, (wrong < X) | (wrong > X + M), M > 0)
    mapped = (flag & 4 == 0) & (r["contig"] >= 0)
    paired = flag & 1 != 0
    odd |= odd_tags | (mapped & broken) | (paired & ((flag & 64 != 0) == (flag & 128 != 0)))
    odd |= np.bincount(owner[~known], minlength=n) > 0
    back = flag & 16 != 0
    begin, rest = np.where(back, after, before), np.where(back, before, after)
    with np.errstate(divide="ignore", invalid="ignore"):
        identity = ((used - wrong) / (used + gaps)).astype(np.float32)
    none, pos = ~mapped, r["pos"].astype(np.int64)
    if odd.any():
        return _one_by_one(buffer, starts, ordinal, with_identity)
    columns = [
        _texts(tag_bytes, rg_at, rg_size), _texts(data, starts + FIXED.itemsize, r["name_size"].astype(np.int64) - 1), np.where(paired, np.where(flag & 64 != 0, 1, 2), 0), np.where(none, flag | 4, flag),
        pa.array(length, mask=none), pa.array(begin, mask=none), pa.array(length - rest, mask=none), pa.array(np.where(back, "-", "+")), pa.array(r["contig"], mask=none), pa.array(pos, mask=none), pa.array(pos + span, mask=none),
        r["quality"], pa.array(identity, mask=none | ~asked), pa.array([""] * n), np.arange(ordinal, ordinal + n),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _one_by_one(buffer: bytes, starts: np.ndarray, ordinal: int, with_identity: bool) -> pa.RecordBatch:
    rows = []
    for k, at in enumerate(starts.tolist()):
        rows.append(record(buffer[at + 4 : at + 4 + int.from_bytes(buffer[at : at + 4], "little", signed=True)], ordinal + k, with_identity))
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)


def _ends(buffer: bytes, at: int, stop: int, most: int) -> tuple[list[int], int]:
    """Starts of at most ``most`` whole records that begin before ``stop``, and the place behind them."""
    number, starts, size = struct.Struct("<i").unpack_from, [], len(buffer)
    while at < stop and at + 4 <= size and len(starts) < most:
        n = number(buffer, at)[0]
        if n < 32:
            raise ValueError("a record is too short")
        if at + 4 + n > size:
            break
        starts.append(at)
        at += 4 + n
    return starts, at


def batches(pieces: Iterable[bytes], most: int | None, ordinal: int, with_identity: bool) -> Iterator[pa.RecordBatch]:
    """``most`` records (or all up to the end) of inflated bytes that start with one."""
    held, have, left = [], 0, 1 << 62 if most is None else most
    pieces, wanted = iter(pieces), PIECE
    while left:
        piece = next(pieces, None)
        if piece is not None:
            held.append(piece)
            have += len(piece)
            if have < wanted:
                continue
        buffer = b"".join(held)
        starts, at = _ends(buffer, 0, len(buffer), left)
        for a in range(0, len(starts), 10_000):
            yield decoded(buffer, np.array(starts[a : a + 10_000], dtype=np.int64), ordinal + a, with_identity)
        ordinal, left = ordinal + len(starts), left - len(starts)
        held, have = [buffer[at:]], len(buffer) - at
        # a record of many pieces is joined seldom
        wanted = max(PIECE, 2 * have)
        if piece is None:
            if left and (have or most is not None):
                raise ValueError("the file is cut off")
            return


@dataclass(frozen=True)
class Walk:
    """Places in a file are (block, byte in it). ``first`` is None where no record was found to begin in the split,
    ``after`` is that of the next one behind it."""

    first: tuple[int, int] | None
    after: tuple[int, int]
    n: int


def _guess(buffer: bytes, stop: int, lengths: np.ndarray) -> int | None:
    """The first byte before ``stop`` from which on all is records, as far as the buffer reaches."""
    data, longest = np.frombuffer(buffer + b"\0" * FIXED.itemsize, np.uint8), np.append(lengths, 0)

    def fits(at: np.ndarray) -> np.ndarray:
        r = np.ascontiguousarray(data[at[:, None] + np.arange(FIXED.itemsize)]).view(FIXED)[:, 0]
        fine = (r["size"] >= 32) & (r["name_size"] > 0) & (r["n_bases"] >= 0)
        for contig, pos in ((r["contig"], r["pos"]), (r["next_contig"], r["next_pos"])):
            fine &= (contig >= -1) & (contig < len(lengths)) & (pos >= -1) & ((contig < 0) | (pos <= longest[np.clip(contig, 0, len(lengths))]))
        fine &= 32 + r["name_size"].astype(np.int64) + 4 * r["n_ops"].astype(np.int64) + (r["n_bases"].astype(np.int64) + 1) // 2 + r["n_bases"] <= r["size"]
        name_end = at + FIXED.itemsize + r["name_size"] - 1
        return fine & ((name_end >= len(buffer)) | (data[np.minimum(name_end, len(buffer))] == 0))

    for a in range(0, min(stop, len(buffer) - FIXED.itemsize + 1), 1 << 16):
        own = np.arange(a, min(a + (1 << 16), stop, len(buffer) - FIXED.itemsize + 1))
        for start in own[fits(own)].tolist():
            at = start
            while at + FIXED.itemsize <= len(buffer) and fits(np.array([at]))[0]:
                at += 4 + int.from_bytes(buffer[at : at + 4], "little")
            if at + FIXED.itemsize > len(buffer):
                return start
    return None


def walked(path: str, a: int, b: int, size: int, lengths: np.ndarray, first: tuple[int, int] | None = None) -> Walk:
    """The records that begin in blocks from ``a`` up to ``b``: from ``first`` on, or from where they seem to begin."""
    source = blocks(path, first[0] if first else a, search=first is None, sums=False)
    held: list[bytes] = []
    #: Places of the held bytes' blocks, in the file and among them.
    where: list[tuple[int, int]] = []
    skip, n, begun, done, have = first[1] if first else 0, 0, first, False, 0

    def spot(at: int) -> tuple[int, int]:
        k = np.searchsorted([w for _, w in where], at, side="right") - 1
        return where[k][0], at - where[k][1]

    wanted = PIECE if first else 1 << 18
    while True:
        for block, data in source:
            where.append((block, have))
            held.append(data)
            have += len(data)
            if have >= wanted or (block >= b and begun is None):
                break
        else:
            done = True
        buffer = b"".join(held)
        stop = next((w for block, w in where if block >= b), len(buffer))
        if begun is None:
            found = _guess(buffer, stop, lengths)
            if found is None:
                if done or stop < len(buffer):
                    return Walk(None, (b, 0), 0)
                wanted = 4 * have
                continue
            skip, begun = found, spot(found)
        starts, at = _ends(buffer, skip, stop, 1 << 62)
        n += len(starts)
        if stop <= at < len(buffer):
            return Walk(begun, spot(at), n)
        if done:
            if at < len(buffer):
                raise ValueError("the file is cut off")
            return Walk(begun, (size, 0), n)
        # the bytes of the open record stay
        k = max(0, int(np.searchsorted([w for _, w in where], at, side="right")) - 1)
        gone = where[k][1]
        buffer, where, skip = buffer[gone:], [(block, w - gone) for block, w in where[k:]], at - gone
        held, have = [buffer], len(buffer)
        wanted = max(PIECE, 2 * have)


def plan(spark: SparkSession, path: str, split: int) -> list[tuple[int, int, int, int]] | None:
    """(block, byte, first ordinal, records) of each split with records; None for a file that one task reads."""
    with opened(path) as f:
        head = f.read(300)
        size = f.seek(0, 2)
        size = f.tell() if size is None else size
    if size <= split or block_size(head) is None:
        return None
    start, lengths = _behind_header(path, size)
    lengths = np.array(lengths, dtype=np.int64)
    cuts = [*range(start[0], size, split), size]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"].tolist():
                try:
                    w = walked(path, cuts[k], cuts[k + 1], size, lengths, start if k == 0 else None)
                    row = (k, *(w.first or (-1, -1)), *w.after, w.n)
                except (ValueError, zlib.error, struct.error):
                    # the guess, or the file; the driver finds out
                    row = (k, -1, -1, -1, -1, 0)
                yield pd.DataFrame([row], columns=["k", "block", "byte", "after_block", "after_byte", "n"])

    n = len(cuts) - 1
    found = spark.range(0, n, 1, n).mapInPandas(look, "k long, block long, byte long, after_block long, after_byte long, n long").toPandas().set_index("k")
    out, at, ordinal = [], start, 0
    for k in range(n):
        if at[0] >= cuts[k + 1]:
            continue
        block, byte, after_block, after_byte, count = found.loc[k].tolist()
        w = Walk((block, byte), (after_block, after_byte), count)
        if w.first != at or w.after[0] < 0:
            w = walked(path, cuts[k], cuts[k + 1], size, lengths, at)
        if w.n:
            out.append((*at, ordinal, w.n))
        at, ordinal = w.after, ordinal + w.n
    return out


def _behind_header(path: str, size: int) -> tuple[tuple[int, int], list[int]]:
    """The place of the first record, and the lengths of the contigs."""
    seen: list[tuple[int, int]] = []

    def told() -> Iterator[bytes]:
        for block, data in blocks(path, 0):
            seen.append((block, len(data)))
            yield data

    stream = Stream(path)
    stream.blocks = told()
    contigs = header(stream)
    if not stream.more():
        return (size, 0), [length for _, length in contigs]
    return (seen[-1][0], seen[-1][1] - len(stream.data)), [length for _, length in contigs]


@dataclass
class _Split(InputPartition):
    place: tuple[int, int, int, int] | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_identity: bool, plan: list[tuple[int, int, int, int]] | None):
        self.path, self.with_identity, self.plan = path, with_identity, plan

    def partitions(self) -> list[InputPartition]:
        return [_Split(None)] if self.plan is None else [_Split(tuple(p)) for p in self.plan] or [_Split((0, 0, 0, 0))]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if partition.place is None:
            stream = Stream(self.path)
            header(stream)
            yield from batches(_rest(stream), None, 0, self.with_identity)
        else:
            block, byte, ordinal, n = partition.place
            pieces = (data[byte if at == block else 0 :] for at, data in blocks(self.path, block))
            yield from batches(pieces, n, ordinal, self.with_identity)


def _rest(stream: Stream) -> Iterator[bytes]:
    yield stream.data
    yield from stream.blocks


class BamSource(DataSource):
    """``spark.read.format("bam").option("identity", "false").load(path)``; ``plan`` is that of :func:`plan`, without it one task reads the file."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("identity", "true") == "true", json.loads(self.options.get("plan", "null")))


def read_bam(spark: SparkSession, path: str, identity: bool = True, split: int = SPLIT) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Records for imports and the contigs of the header."""
    spark.dataSource.register(BamSource)
    contigs = header(Stream(path))
    return spark.read.format("bam").option("identity", str(identity).lower()).option("plan", json.dumps(plan(spark, path, split))).load(path), contigs
