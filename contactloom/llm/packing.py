"""Vector bin packing of token sequences by the dot-product heuristic.

An example demands several things at once: tokens, segments and loss-bearing tokens. One
sequence is open at a time; the example that goes in next is the one, of those that fit,
whose weighted demand has the largest dot product with what the sequence has left. Each
Spark partition packs its own examples from a pool of bounded size, so nothing is
shuffled, a hot source is packed where it lies, and a lost executor repeats only its
partitions. Instruction data come in through :func:`conversation_examples`, where all three demands
differ; of a document each piece is one segment and all ids bear loss. With ``cut``, examples may be cut: to fill a gap that nothing fits, and at a
partition's end, where the last tokens form sequences whose lengths are powers of two.

Defined results: an example without tokens is left out (documents always have their end
id); an example over a limit is cut; without ``cut``, or with too many segments, it stands alone
in a sequence with ``oversize`` true, never dropped. Repeated rows are packed each for itself. An empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import batches, filled_id, python_ready, restored_id
from contactloom.llm.tokens import encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how the packer works.

    ``pool``: examples to choose from, or more where they are so small that these don't fill two
    sequences; ``least``: the shortest piece that a cut to fill a gap makes.
    """

    tokens: int = 4096
    segments: int = 4096
    loss_tokens: int = 4096
    pool: int = 512
    least: int = 16


class Packer:
    """Places examples of one partition. ``pieces`` gets (key, start, length, sequence, offset, oversize)."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.total = np.zeros(3)
        n = 2 * limits.pool + 2
        self.demand = np.zeros((n, 3))
        self.at: list[tuple | None] = [None] * n
        self.free = list(range(n))
        self.sequence = 0
        self.pieces: list[tuple] = []

    def __len__(self) -> int:
        return len(self.at) - len(self.free)

    def add(self, key, tokens: int, segments: int, loss: int, start: int = 0) -> None:
        """An example; with cut, whole sequences come off its front first. A cut keeps the loss
        tokens at the end of the example, as a reply stands behind its prompt."""
        if segments > self.limits.segments or not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss_tokens):
            self.pieces.append((key, start, tokens, self.sequence, 0, True))
            self.sequence += 1
            return
        full = min(self.limits.tokens, self.limits.loss_tokens) if loss else self.limits.tokens
        while self.cut and tokens > full:
            self.pieces.append((key, start, full, self.sequence, 0, False))
            self.sequence += 1
            start, tokens, loss = start + full, tokens - full, min(loss, tokens - full)
        if not self.free:
            n = len(self.at)
            self.demand = np.concatenate([self.demand, np.zeros((n, 3))])
            self.at += [None] * n
            self.free += range(n, 2 * n)
        i = self.free.pop()
        self.demand[i] = tokens, segments, loss
        self.total += self.demand[i]
        self.at[i] = (key, start)
        if len(self) >= 2 * self.limits.pool and self._plenty():
            while len(self) > self.limits.pool and self._plenty():
                self.fill()

    def _plenty(self) -> bool:
        """Whether the pool would fill two sequences by one of the limits."""
        return bool((self.total >= 2 * self.capacity).any())

    def _take(self, i: int, n: int, offset: int) -> None:
        key, start = self.at[i]
        self.pieces.append((key, start, n, self.sequence, offset, False))
        left = int(self.demand[i, 0]) - n
        self.total -= self.demand[i]
        if left:
            self.at[i] = (key, start + n)
            self.demand[i] = left, self.demand[i, 1], min(self.demand[i, 2], left)
            self.total += self.demand[i]
        else:
            self.at[i] = None
            self.demand[i] = 0
            self.free.append(i)

    def fill(self) -> None:
        """Pack one sequence from the pool."""
        left, offset = self.capacity.copy(), 0
        live = self.demand[:, 0] > 0
        weight = 1 / np.maximum(self.capacity, 1) ** 2
        while True:
            fits = live & (self.demand <= left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, self.demand @ (weight * left), -1)))
                n = int(self.demand[i, 0])
            else:
                room = int(min(left[0], left[2]))
                cut = live & (self.demand[:, 1] <= left[1]) & (self.demand[:, 0] >= room + self.limits.least)
                if not self.cut or room < self.limits.least or not cut.any():
                    break
                i, n = int(np.argmax(np.where(cut, self.demand[:, 0], -1))), room
            used = np.array([n, self.demand[i, 1], max(0, self.demand[i, 2] - (self.demand[i, 0] - n))])
            self._take(i, n, offset)
            left -= used
            offset += n
            live[i] = False
        self.sequence += 1

    def finish(self) -> None:
        while len(self) and (not self.cut or (self.demand.sum(axis=0) > self.capacity).any()):
            self.fill()
        rest = int(self.demand[:, 0].sum())
        for bit in range(rest.bit_length() - 1, -1, -1):
            room = rest & (1 << bit)
            offset = 0
            while room:
                i = int(np.argmax(self.demand[:, 0] > 0))
                n = min(room, int(self.demand[i, 0]))
                self._take(i, n, offset)
                offset, room = offset + n, room - n
            self.sequence += bool(offset)

    def taken(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, limits: Limits = Limits(), remember: int | None = None) -> DataFrame:
    """Every id of every text (ids of ``path``, then ``end_id``) in exactly one piece.

    All ids bear loss and each piece is one segment. Columns: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. A null text is an empty one. ``remember``: stretches of text in a
    worker's table of ids, where less memory than usual is to be had for more time.
    """
    docs = python_ready(docs)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 33
        packer = Packer(limits, cut=True)
        held: dict[int, tuple] = {}
        count = 0

        def rows() -> pd.DataFrame:
            out = []
            for key, start, length, sequence, offset, _ in packer.taken():
                doc_id, ids, left = held[key]
                held[key] = (doc_id, ids, left - length)
                if left == length:
                    del held[key]
                out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + sequence, offset))
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for frame in frames:
            texts, keys = frame["text"].tolist(), frame["doc_id"].tolist()
            for a, b in batches(texts):
                ids, sizes = encoder(path, remember).encode(texts[a:b])
                for doc_id, own in zip(keys[a:b], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    held[count] = (doc_id, own, len(own))
                    packer.add(count, len(own), 1, len(own))
                    count += 1
                yield rows()
        packer.finish()
        yield rows()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return restored_id(docs.select(filled_id("doc_id"), "text").mapInPandas(pack, schema), "doc_id")


def conversation_examples(turns: DataFrame, path: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """id, n_tokens, n_segments and n_loss of each conversation (conv_id) of a table of turns (role, text): the ids of
    its texts with an end id for each turn, its turns, and the ids of turns of the ``learned`` roles.

    Turns are counted where they lie and summed on the map side, so a conversation of any size is three numbers in
    the shuffle. A null text has its end id alone, a turn of a null role isn't learned, turns without a conv_id are
    one conversation with a null id.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            sizes = [encoder(path).encode(texts[a:b])[1] + 1 for a, b in batches(texts)]
            n = np.concatenate([*sizes, np.zeros(0, dtype=np.int64)])
            yield pd.DataFrame({"id": frame["id"], "n": n, "loss": np.where(frame["role"].isin(learned), n, 0)})

    rows = python_ready(turns).select(F.col("conv_id").cast("string").alias("id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInPandas(count, "id string, n long, loss long")
    return counted.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_segments"), F.sum("loss").alias("n_loss"))


def pack_examples(examples: DataFrame, limits: Limits = Limits(), id_column: str = "id") -> DataFrame:
    """Pack whole examples by their demands; none is cut.

    ``examples`` has ``id_column``, n_tokens, n_segments and n_loss (null: 0). Returns the id as
    text, sequence_id, offset, length and oversize.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 33
        packer = Packer(limits, cut=False)

        def rows() -> pd.DataFrame:
            out = [(k, base + sequence, offset, n, over) for k, _, n, sequence, offset, over in packer.taken()]
            return pd.DataFrame(out, columns=["id", "sequence_id", "offset", "length", "oversize"])

        for frame in frames:
            for key, tokens, segments, loss in frame.itertuples(index=False):
                if tokens > 0:
                    packer.add(key, tokens, segments, loss)
            yield rows()
        packer.finish()
        yield rows()

    wanted = examples.selectExpr(f"cast(`{id_column}` as string) as id", *[f"coalesce(cast({c} as long), 0) as {c}" for c in ("n_tokens", "n_segments", "n_loss")])
    return wanted.mapInPandas(pack, "id string, sequence_id long, offset long, length long, oversize boolean")
