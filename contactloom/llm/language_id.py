"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and taken as its runs of letters (with their marks), each between single
spaces; the n-grams are all windows of one to four characters of that, hashed into a table
of fixed size for each order. Counts come from a bounded, deterministic sample of labelled
rows (``per_language`` expected rows each; all rows where there are fewer). The
log-probability matrix is broadcast; its width goes down as languages go up, so that it never
passes ``MODEL_BYTES`` (but for 256 slots an order). A batch is scored sparsely: each text's n-grams become distinct features with
counts, and a text's score is the sum of count times row over its features. Long texts pass through in
pieces, so what a worker holds doesn't grow with them. Nothing is shuffled but the sample's counts.

Defined results: a null text or one without a letter is ``und`` with score 0; every other
text, of any length, is scored whole, the same way at every length; without a labelled row all texts are ``und``; an
empty table gives an empty table; of equally likely languages the first by name counts. Labels, source and ids never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import batches, character_kinds, free_name, id_bucket, python_ready, spread

UNKNOWN = "und"
ORDERS = 4
#: Slots of each order's table, as a power of two.
SLOT_BITS = 15
MODEL_BYTES = 256 << 20
PER_LANGUAGE = 3000
#: n-grams that count in full towards the certainty of a score; longer texts are averaged down to this.
CERTAIN = 200
#: Characters looked at together.
PIECE = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def features(codes: np.ndarray, ends: np.ndarray, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and starting place of every window of up to ORDERS characters that doesn't pass the end
    (``ends``: one for each character) of its text."""
    n = len(codes)
    padded = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(ORDERS, np.uint64)])
    gram, found, at = np.zeros(n, np.uint64), [], []
    for k in range(ORDERS):
        gram = gram * np.uint64(0x100000001B3) + padded[k : n + k]
        whole = np.flatnonzero(np.arange(k + 1, n + k + 1) <= ends)
        mixed = (gram[whole] ^ (gram[whole] >> np.uint64(29))) * ODD
        found.append((mixed >> np.uint64(64 - slot_bits)).astype(np.int64) + (k << slot_bits))
        at.append(whole)
    return np.concatenate(found), np.concatenate(at)


class Reader:
    """The normal form of a text that comes in pieces, as character codes."""

    def __init__(self) -> None:
        self.after_letter, self.held = False, np.array([32], dtype=np.uint32)

    def take(self, piece: str, last: bool) -> np.ndarray:
        """What can be windowed now; the last few characters are held back unless the text ends here."""
        data = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = character_kinds()[data] == LETTER
        before = np.concatenate([[self.after_letter], letter[:-1]]) if len(data) else letter
        kept = np.where(letter, data, np.uint32(32))[letter | before]
        self.after_letter = bool(letter[-1]) if len(data) else self.after_letter
        return np.concatenate([self.held, kept, np.full(int(last and self.after_letter), 32, np.uint32)])


#: What character_kinds says of a letter or a mark.
LETTER = 1


def streams(texts: Sequence[str | None], budget: int = PIECE) -> Iterator[tuple[list[int], list[np.ndarray], int]]:
    """Numbers of texts and their codes, many short texts or one piece of a long one at a time, and the place
    before which windows begin that count now."""
    numbers, codes, size = [], [], 0
    for i, text in enumerate(texts):
        small = (text or "").lower()
        if len(small) <= budget:
            numbers.append(i)
            codes.append(Reader().take(small, True))
            size += len(small)
            if size > budget:
                yield numbers, codes, sum(map(len, codes))
                numbers, codes, size = [], [], 0
            continue
        reader = Reader()
        for a in range(0, len(small), budget):
            last = a + budget >= len(small)
            stream = reader.take(small[a : a + budget], last)
            # windows that begin among the last characters wait for the next piece
            done = len(stream) if last else max(0, len(stream) - ORDERS + 1)
            yield [i], [stream], done
            reader.held = stream[done:]
    if numbers:
        yield numbers, codes, sum(map(len, codes))


def counted(texts: Sequence[str | None], slot_bits: int, budget: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, feature, count) of distinct features, in blocks; a long text's features come in several."""
    width = ORDERS << slot_bits
    for numbers, codes, done in streams(texts, budget):
        sizes = np.array([len(c) for c in codes])
        ends = np.repeat(np.cumsum(sizes), sizes)
        feature, at = features(np.concatenate(codes), ends, slot_bits)
        feature, at = feature[at < done], at[at < done]
        text = np.repeat(np.array(numbers, dtype=np.int64), sizes)[at]
        key, n = np.unique(text * width + feature, return_counts=True)
        yield key // width, key % width, n


@dataclass
class Model:
    """``weights``: log P(feature | language), one row for each feature; ``prior``: log P(language)."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    slot_bits: int

    def score(self, texts: Sequence[str | None], budget: int = PIECE) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        rows = max(1, (8 << 20) // len(self.languages))
        for text, feature, n in counted(texts, self.slot_bits, budget):
            for a in range(0, len(text), rows):
                part = slice(a, a + rows)
                own = text[part]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[first]] += np.add.reduceat(self.weights[feature[part]] * n[part, None].astype(np.float32), first, axis=0, dtype=np.float64)
            size += np.bincount(text, weights=n, minlength=len(texts))
        total = total * np.minimum(1, ORDERS * CERTAIN / np.maximum(size, 1))[:, None] + self.prior
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        # a text without a letter has only the window of its one space
        lettered = size > 1
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, model_bytes: int = MODEL_BYTES) -> Model:
    """Count n-grams on the executors over the sample of the rows where ``train`` holds."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    languages = [r["lang"] for r in found]
    slot_bits = SLOT_BITS
    while slot_bits > 8 and len(languages) * (ORDERS << slot_bits) * 4 > model_bytes:
        slot_bits -= 1
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), slot_bits)
    shares = docs.sparkSession.createDataFrame([(r["lang"], k, min(1.0, per_language / r["count"])) for k, r in enumerate(found)], "lang string, _place int, _share double")
    sample = rows.join(F.broadcast(shares), "lang").where(spread("doc_id", 4) < F.col("_share")).select("_place", "text")

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), ORDERS << slot_bits), dtype=np.int64)
        for frame in frames:
            texts, place = frame["text"].tolist(), frame["_place"].to_numpy()
            for a, b in batches(texts):
                for text, feature, n in counted(texts[a:b], slot_bits):
                    np.add.at(total, (place[a:b][text], feature), n)
        place, feature = np.nonzero(total)
        yield pd.DataFrame({"place": place, "feature": feature, "n": total[place, feature]})

    summed = sample.mapInPandas(counts, "place int, feature int, n long").groupBy("place", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((ORDERS << slot_bits, len(languages)), 0.5, dtype=np.float32)
    table[summed["feature"], summed["place"]] += summed["n"].to_numpy(dtype=np.float32)
    for k in range(ORDERS):
        part = table[k << slot_bits : (k + 1) << slot_bits]
        np.log(part / part.sum(axis=0, dtype=np.float64), out=part, casting="same_kind")
    sizes = np.array([r["count"] for r in found], dtype=np.float64)
    return Model(languages, table, np.log(sizes / sizes.sum()), slot_bits)


def predicted(docs: DataFrame, train: Column | None, name: str) -> DataFrame:
    """``docs`` with the struct ``name`` of lang_pred and score."""
    docs = python_ready(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, F.lit(True) if train is None else train))

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in frames:
            texts, names, scores = own.tolist(), [], []
            for a, b in batches(texts):
                lang, score = model.value.score(texts[a:b])
                names += lang
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate([*scores, np.zeros(0)])})

    return docs.withColumn(name, predict("text"))


def identify(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """The columns of ``docs`` (but for those named like a result) with lang_pred and score."""
    found = free_name(docs, "found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"lang_pred", "score"}]
    return predicted(docs, train, found).select(*kept, f"{found}.lang_pred", f"{found}.score")


def of_known_language(docs: DataFrame, least: float) -> DataFrame:
    """The documents with a language of at least this certainty, and their columns as they are."""
    found = free_name(docs, "found")
    rows = predicted(docs, None, found)
    return rows.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= least)).drop(found)


def held_out_identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows whose id's bucket modulo 4 is not 2."""
    held_out = id_bucket("doc_id", 4) == 2
    return identify(docs.select("doc_id", "text", "lang"), ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
