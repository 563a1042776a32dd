"""Token counts with a whole-token shortcut.

Before the job, every vocabulary string is put to the library alone; those that come back
as one token are proven: wherever such a string is a stretch or pre-token of a text, it
counts one. The proven strings (at most the vocabulary) are broadcast. Only what is not
proven is pre-tokenised and merged, once for each distinct stretch of a worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of any length is counted whole, in memory
that grows with it (1.2 GB for one of 100 MB); repeated rows are counted alike; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from contactloom.llm.common import batches, filled_id, python_ready, restored_id
from contactloom.llm.tokens import Encoder, byte_signs, library, stretches


def proven_strings(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes alone as exactly one token."""
    tokenizer, byte = library(path), byte_signs()
    strings = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(byte[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    return frozenset(s for s, e in zip(strings, tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter(Encoder):
    """Counts of tokens; remembers a number for each stretch in place of its ids."""

    def __init__(self, path: str, proven: frozenset[str]):
        self.proven = proven
        super().__init__(path)

    def _begin(self) -> None:
        self.known = {}
        self.ids = self.ends = np.zeros(0, dtype=np.int64)

    def _move(self, stretches: list[str]) -> None:
        self.known.update((s, self.aside[0][s]) for s in stretches)

    def _add(self, stretches: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(stretches, counts.tolist(), strict=True))

    def _learn(self, new: list[str]) -> None:
        proven = self.proven.intersection(new)
        self.known.update(dict.fromkeys(proven, 1))
        super()._learn([s for s in new if s not in proven])

    def count(self, texts: list[str | None]) -> np.ndarray:
        whole = {i: len(ids) for i, ids in self.whole(texts).items()}
        codes, distinct = stretches([None if i in whole else t for i, t in enumerate(texts)])
        self._turn()
        counts = np.append(0, self._found(distinct))[codes]
        out = np.diff(np.cumsum(counts)[codes == 0])
        for i, n in whole.items():
            out[i] = n
        return out


_COUNTER: dict[str, Counter] = {}


def _counter(path: str, proven: frozenset[str]) -> Counter:
    if path not in _COUNTER:
        _COUNTER[path] = Counter(path, proven)
    return _COUNTER[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). ``.model`` files are counted by
    sentencepiece, whose pieces cross any split that could be seen from outside, text by text."""
    docs = python_ready(docs)
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(frozenset() if path.endswith(".model") else proven_strings(path))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            of = lambda texts: np.array([len(x) for x in pieces.encode([t or "" for t in texts], num_threads=1)], dtype=np.int64)
        else:
            of = _counter(path, proven.value).count
        for frame in frames:
            texts = frame["text"].tolist()
            tokens = np.concatenate([of(texts[a:b]) for a, b in batches(texts)] or [np.zeros(0, dtype=np.int64)])
            sizes = np.array([0 if t is None else len(t.encode()) for t in texts], dtype=np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": sizes, "n_tokens": tokens, "over_limit": tokens > limit})

    rows = docs.select(filled_id(id_column).alias("doc_id"), docs[text_column].alias("text"))
    return restored_id(rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"), "doc_id")
