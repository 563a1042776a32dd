"""What the training-data operators share: shared storage, vectorised word hashing, table access.

Executors and the driver have no local folder in common, so every intermediate table
goes to the folder named by ``spark.checkpoint.dir`` through Spark's own writers.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.session import shared_dir, stored  # noqa: F401

MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


#: Bytes of an Arrow batch. Workers hold a batch several times over, and a batch of long texts may be large.
BATCH_BYTES = 8 << 20


def python_ready(df: DataFrame) -> DataFrame:
    """``df``, whose session hands batches of bounded size to Python workers from now on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return python_ready(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Stands for a null id inside Python workers, where a column of whole numbers with nulls would become floating.
NO_ID = -(1 << 63)


def filled_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def restored_id(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(NO_ID)))


def without_ids(docs: DataFrame, gone: DataFrame, broadcast_ids: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone``; rows without an id stay. The ids are broadcast
    if their count is below the bound, else both sides are shuffled."""
    gone = stored(gone.select(F.col("doc_id").cast("long").alias("_gone")).where("_gone is not null").distinct(), "gone")
    few = gone.count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def spread(column: str, salt: int) -> Column:
    """A fixed pseudo-random number in [0, 1) of a key, for bounded deterministic samples."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while (wish := f"_{wish}") in taken:
        pass
    return wish


@cache
def character_kinds() -> np.ndarray:
    """For each character 1 a letter or a mark, 2 a digit or another number, 0 anything else."""
    kind = {"L": 1, "M": 1, "N": 2}
    return np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[128:] = True


def word_spans(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of many texts at once.

    A word is a longest run of letters, any character above ASCII counting as one.
    Returns what :func:`spans` does.
    """
    return spans([b"" if t is None else t.lower().encode() for t in texts], LETTER)


def spans(parts: Sequence[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of bytes for which the 256-entry table ``inside`` is true. Returns the bytes, the starts and ends of the words in them, and for text ``i`` the
    word range ``bounds[i]:bounds[i + 1]``. Null texts have no words.
    """
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    letter = inside[data]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    text_at = np.concatenate([[1], np.cumsum([len(p) + 1 for p in parts]) + 1])
    return data, starts, ends, np.searchsorted(starts, text_at)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: Iterable[int | None]) -> list[np.ndarray]:
    """64-bit hashes of the first ``n`` bytes of each word (None: all bytes), one array for each length.

    A word's byte ``j`` is multiplied by a fixed number of ``j``, so one running sum serves
    every prefix length. Where only whole words are asked for, those of up to ``SHORT`` bytes are
    summed byte by byte instead, the n-th bytes of all words at once, which needs no array as long as the text.
    """
    lengths, sizes = list(lengths), ends - starts
    if lengths == [None]:
        sums = np.empty(len(sizes), dtype=np.uint64)
        long = np.flatnonzero(sizes > SHORT)
        if len(long):
            sums[long] = np.diff(_running(data, starts[long], sizes[long])[np.concatenate([[0], np.cumsum(sizes[long])])])
        by_size = np.argsort(np.minimum(sizes, SHORT + 1).astype(np.uint8), kind="stable")[: len(sizes) - len(long)]
        upto = np.searchsorted(sizes[by_size], np.arange(SHORT + 1), side="right")
        at, short = starts[by_size], np.zeros(len(by_size), dtype=np.uint64)
        for j, a in enumerate(upto[:-1].tolist()):
            if a == len(at):
                break
            short[a:] += (data[at[a:] + j].astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[j]
        sums[by_size] = short
        return [_mixed(sums, sizes, 0)]
    first = np.concatenate([[0], np.cumsum(sizes)])
    running = _running(data, starts, sizes)
    out = []
    for n in lengths:
        taken = sizes if n is None else np.minimum(sizes, n)
        out.append(_mixed(running[first[:-1] + taken] - running[first[:-1]], taken, 0 if n is None else 977 * n))
    return out


#: Bytes of a word that are summed one by one; fewer than there are multipliers.
SHORT = 24


def _running(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of the words' bytes times their multipliers before each byte, and before the end."""
    total = int(sizes.sum())
    inner = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = data[inner + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    running = np.zeros(total + 1, dtype=np.uint64)
    place = MULTIPLIERS[inner & 63] + (inner >> 6).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4E)
    np.cumsum(letters * place, out=running[1:])
    return running


def _mixed(sums: np.ndarray, taken: np.ndarray, salt: int) -> np.ndarray:
    h = sums ^ (taken.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def batches(texts: Sequence[str | None], budget: int = 1_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of rows with about ``budget`` characters each; a longer text is alone in its range."""
    give_back()
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if i > start and size + n > budget:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)
    give_back()
