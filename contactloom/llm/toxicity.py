"""Toxicity scores from a convolutional text classifier, trained and run in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings. Filters
of several widths run over the words, each filter's largest answer in the text counts, and
a logistic layer joins them. Texts are scored whole, whatever their length. The scores are
calibrated on training rows kept apart (Platt, then moved so that 0.5 is the threshold
with the best F1 at the natural share of label 1); beside them stand thresholds calibrated by language, for
callers that flag documents whose language is known.

Training takes every labelled row. Rows are dealt by their id into shards of about ``Settings.characters``, stored as
hash numbers, in rows of about ``PIECE`` characters, as the JVM keeps buffers outside its heap as large as the largest row for each
that it hands on; no task and not the driver holds more than one shard. The embeddings' first guess counts
all shards' texts. Then each shard trains a copy of the network, and the copies are averaged (an embedding over the shards that moved
it), in ``rounds`` rounds; a single shard needs one. Calibration counts the answers to all rows kept apart, in narrow bins. What reaches the
driver has the size of the network for each of at most ``TASKS`` tasks, whatever the number of rows. The model has a fixed size and is
broadcast. Scoring is one pass without a shuffle.

Defined results: a null or empty text, or one without letters, gets the score of a text of
no words; without labelled rows of both kinds every score is the share of label 1 (0 if
there are no labels) and nothing is flagged; of rows that share a doc_id one text, the same in each run, is learned from; repeated labels of a document count once, as
1 if any is 1; an empty table gives an empty table.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import batches, id_bucket, prefix_hashes, python_ready, spread, stored, word_spans

SLOT_BITS = 16
#: Tasks of a pass over the shards.
TASKS = 24
#: Bins of an answer's unit, in which answers are counted for calibration.
BINS = 256
#: Words that are looked at together.
WORDS = 200_000
#: Characters of the texts in a stored row of a shard; a longer text is a row of its own.
PIECE = 250_000
#: Bytes of a row in which a task hands on what it made of its shards.
HANDED = 1 << 19
#: A file of shards is one row group, however it is split for reading, so that one task gets all rows of a shard; pages are small.
WHOLE_FILES = {"maxRecordsPerFile": 0, "parquet.block.size": 1 << 29, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: The word itself, and its first bytes.
VIEWS: tuple[int | None, ...] = (None, 4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    """Sizes of shards and network. ``support``: documents that an embedding's first guess needs."""

    #: Characters of a shard's texts, on average.
    characters: int = 8_000_000
    #: Rounds into which the epochs are cut where there are several shards.
    rounds: int = 3
    dim: int = 6
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    epochs: int = 12
    batch: int = 64
    rate: float = 0.1
    support: float = 4.0
    decay: float = 1e-3
    seed: int = 11
    #: Rows of label 1 that a language needs for a threshold of its own.
    own_threshold: int = 20


def word_numbers(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(views, words) embedding numbers, and the bounds of the texts among the words."""
    data, starts, ends, bounds = word_spans(texts)
    hashes = prefix_hashes(data, starts, ends, VIEWS)
    return np.stack([(h >> np.uint64(64 - SLOT_BITS)).astype(np.uint16) for h in hashes]), bounds


@dataclass
class Network:
    """``table``: (views, slots, dim); ``kernels``: for each width (width, dim, filters)."""

    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0

    def pooled(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Largest answers (texts, filters) with, for each width, where they stand; the padded vectors and the text starts.

        Each text is followed by as many empty words as the widest filter has places. Windows start at the text's
        words and at the first empty one, so none holds words of two texts and a text of no words has one window.
        """
        room = max(k.shape[0] for k in self.kernels)
        sizes = np.diff(bounds)
        starts = bounds[:-1] - bounds[0] + room * np.arange(len(sizes))
        place = np.arange(numbers.shape[1]) + room * np.repeat(np.arange(len(sizes)), sizes)
        vectors = np.zeros((numbers.shape[1] + room * len(sizes) + room, self.table.shape[2]), dtype=np.float32)
        summed = self.table[0][numbers[0]]
        for view in range(1, len(numbers)):
            summed += self.table[view][numbers[view]]
        vectors[place] = summed
        n, best, where = len(vectors) - room, [], []
        behind = (starts + sizes)[:, None] + np.arange(1, room)
        for kernel in self.kernels:
            answer = vectors[:n] @ kernel[0]
            for j in range(1, len(kernel)):
                answer += vectors[j : n + j] @ kernel[j]
            answer[behind.ravel()] = -np.inf
            best.append(np.maximum.reduceat(answer, starts, axis=0) if len(starts) else np.zeros((0, answer.shape[1]), np.float32))
            where.append(answer)
        return np.concatenate(best, axis=1), where, vectors, starts

    def logits(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        best = self.pooled(numbers, bounds)[0]
        return np.maximum(best + self.bias, 0) @ self.out + self.shift

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw = self.logits(*word_numbers(texts)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(raw * self.scale + self.offset, -60, 60)))


def first_guess(with_1: np.ndarray, with_0: np.ndarray, share: float, settings: Settings) -> Network:
    """A network whose embeddings' first entry is the shrunk log odds of the slot among the texts; ``with_1`` and
    ``with_0`` (views, slots) are numbers of texts of each label."""
    rng = np.random.default_rng(settings.seed)
    table = rng.normal(0, 0.05, (len(VIEWS), 1 << SLOT_BITS, settings.dim)).astype(np.float32)
    # one document of each kind doesn't count, else a rare word would tell its own training text
    with_1, with_0, prior = np.maximum(with_1 - 1, 0), np.maximum(with_0 - 1, 0), settings.support
    odds = np.log((with_1 + prior * share) / (with_0 + prior * (1 - share)) * (1 - share) / share)
    table[:, :, 0] = np.clip(odds, -4, 4)
    kernels = []
    for width in settings.widths:
        k = rng.normal(0, 0.1, (width, settings.dim, settings.filters)).astype(np.float32)
        k[:, 0, 0] = 1 / width
        k[0, 0, 1] = 0.7
        kernels.append(k)
    n = settings.filters * len(settings.widths)
    out = np.full(n, 0.05, dtype=np.float32)
    out[:: settings.filters] = 0.3
    return Network(table, kernels, np.full(n, -1.0, dtype=np.float32), out, 0.0)


def train(net: Network, numbers: list[np.ndarray], labels: np.ndarray, settings: Settings, epochs: int, seed: list[int]) -> np.ndarray:
    """Logistic loss by mini-batches. Only each filter's winning window has a gradient, so
    few embeddings change in a step; each keeps its own step size (Adagrad). Returns which embeddings moved."""
    rng = np.random.default_rng(seed)
    moved = np.zeros(net.table.shape[:2], dtype=bool)
    params = [net.table, *net.kernels, net.bias, net.out]
    memory = [np.full(p.shape, 0.05, dtype=np.float32) for p in params]
    shift_memory = 0.05
    for _ in range(epochs):
        order = rng.permutation(len(numbers))
        for a in range(0, len(order), settings.batch):
            part = order[a : a + settings.batch]
            bounds = np.concatenate([[0], np.cumsum([numbers[i].shape[1] for i in part])])
            joined = np.concatenate([numbers[i] for i in part], axis=1)
            best, answers, vectors, starts = net.pooled(joined, bounds)
            active = best + net.bias > 0
            hidden = np.where(active, best + net.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.shift, -30, 30)))
            slope = ((p - labels[part]) / len(part)).astype(np.float32)
            back = slope[:, None] * net.out * active
            grads = [None, *[np.zeros_like(k) for k in net.kernels], back.sum(axis=0), hidden.T @ slope + settings.decay * net.out]
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            room = max(settings.widths)
            sizes = np.diff(bounds)
            for w, (kernel, answer) in enumerate(zip(net.kernels, answers, strict=True)):
                own = slice(w * settings.filters, (w + 1) * settings.filters)
                for i in np.flatnonzero(active[:, own].any(axis=1)):
                    window = answer[starts[i] : starts[i] + sizes[i] + room]
                    top = window.argmax(axis=0)
                    for f in np.flatnonzero(active[i, own]):
                        g, at = back[i, own][f], top[f]
                        for j in range(len(kernel)):
                            grads[1 + w][j, :, f] += g * vectors[starts[i] + at + j]
                            if at + j < sizes[i]:
                                touched.append((joined[:, bounds[i] + at + j], g * kernel[j, :, f]))
            for k, grad in enumerate(grads[1:], 1):
                memory[k] += grad * grad
                params[k] -= settings.rate * grad / np.sqrt(memory[k])
            shift_grad = float(slope.sum())
            shift_memory += shift_grad**2
            net.shift -= settings.rate * shift_grad / shift_memory**0.5
            if touched:
                slots = np.stack([t[0] for t in touched]).astype(np.int64)
                moves = np.stack([t[1] for t in touched])
                for view in range(len(VIEWS)):
                    unique, which = np.unique(slots[:, view], return_inverse=True)
                    grad = np.zeros((len(unique), settings.dim), dtype=np.float32)
                    np.add.at(grad, which, moves)
                    moved[view, unique] = True
                    memory[0][view, unique] += grad * grad
                    net.table[view, unique] -= settings.rate * grad / np.sqrt(memory[0][view, unique])
    return moved


def calibrate(net: Network, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Platt scaling by Newton's method, with weights that restore the natural share of labels."""
    a, b = 1.0, 0.0
    soft = np.where(labels == 1, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        d, h = weights * (p - soft), weights * p * (1 - p) + 1e-9
        g = np.array([d @ raw + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[h @ raw**2 + 1e-3, h @ raw], [h @ raw, h.sum() + 1e-6]])
        move = np.linalg.solve(hess, g)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        a, b = a - move[0], b - move[1]
    net.scale, net.offset = float(max(a, 1e-3)), float(b)


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the best F1, between two scores."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum((weights * labels)[order])
    f1 = 2 * hit / (np.cumsum(weights[order]) + (weights * labels).sum())
    k = int(np.argmax(f1))
    after = scores[order][min(k + 1, len(order) - 1)]
    return float((scores[order][k] + after) / 2)


@dataclass
class Classifier:
    """``net`` is None where there was nothing to learn; then every score is ``share``."""

    net: Network | None
    share: float
    threshold: float
    by_language: dict[str, float]

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        return np.full(len(texts), self.share) if self.net is None else self.net.score(texts)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> Classifier:
    """Learn ``labels.toxic`` of the documents where ``usable`` (on doc_id) holds."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = {r["toxic"]: r["count"] for r in marked.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    n1, n0 = found.get(1, 0), found.get(0, 0)
    if not n1 or not n0:
        return Classifier(None, n1 / max(n1 + n0, 1), 1.1, {})
    shards = _shards(docs, marked, n1 + n0, settings)

    def counted(own: Iterator[Shard]) -> Iterator[dict]:
        kinds, seen = np.zeros((2, 2), dtype=np.int64), np.zeros((2, 2, len(VIEWS), 1 << SLOT_BITS), dtype=np.int32)
        for shard in own:
            for label, apart, numbers in zip(shard.labels, shard.apart, shard.texts, strict=True):
                kinds[int(apart), label] += 1
                for view in range(len(VIEWS)):
                    seen[int(apart), label, view, np.unique(numbers[view])] += 1
        yield {"kinds": kinds, "seen": seen}

    kinds, seen = np.zeros((2, 2), dtype=np.int64), np.zeros((2, 2, len(VIEWS), 1 << SLOT_BITS))
    for part in _passed(shards, counted):
        kinds, seen = kinds + part["kinds"], seen + part["seen"]
    if not kinds.sum(axis=0).all():
        return Classifier(None, n1 / (n1 + n0), 1.1, {})
    split = bool(kinds.all())
    learnt, (with_0, with_1) = (kinds[0], seen[0]) if split else (kinds.sum(axis=0), seen.sum(axis=0))
    net = first_guess(with_1, with_0, learnt[1] / learnt.sum(), settings)
    several = shards.select("shard").distinct().count() > 1
    rounds = min(settings.rounds, settings.epochs) if several else 1
    for k in range(rounds):
        epochs = settings.epochs * (k + 1) // rounds - settings.epochs * k // rounds
        net = _averaged(shards, net, settings, epochs, k, split)
    raw, y, weights, lang = _answers(shards, net, split)
    calibrate(net, raw, y, weights)
    # 0.5 is to be the best single threshold
    bar = min(max(best_threshold(1 / (1 + np.exp(-(raw * net.scale + net.offset).clip(-30, 30))), y, weights), 1e-6), 1 - 1e-6)
    net.offset -= float(np.log(bar / (1 - bar)))
    scores = 1 / (1 + np.exp(-np.clip(raw * net.scale + net.offset, -60, 60)))
    own = {}
    for x in {v for v in lang if isinstance(v, str)}:
        mine = lang == x
        if (y * weights)[mine].sum() >= settings.own_threshold:
            own[x] = best_threshold(scores[mine], y[mine], weights[mine])
    return Classifier(net, n1 / (n1 + n0), best_threshold(scores, y, weights), own)


@dataclass
class Shard:
    """Texts as word numbers (views, words) with their labels, languages, and which are kept apart."""

    number: int
    texts: list[np.ndarray]
    labels: np.ndarray
    apart: np.ndarray
    langs: list[str | None]


def _shard(rows: list) -> Shard:
    """The shard of its stored rows."""
    texts = []
    for r in rows:
        bounds, numbers = np.frombuffer(r.bounds, np.int64), np.frombuffer(r.numbers, np.uint16).reshape(len(VIEWS), -1)
        texts += [numbers[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    flat = lambda name: np.frombuffer(b"".join(getattr(r, name) for r in rows), np.uint8)
    return Shard(rows[0].shard, texts, flat("labels"), flat("apart").astype(bool), [x for r in rows for x in r.langs])


def _shards(docs: DataFrame, marked: DataFrame, n_labels: int, settings: Settings) -> DataFrame:
    """The labelled texts, the rows of a shard one after the other, in the order of a fixed random number of the id."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # up to this count the labels are broadcast
    marked = stored(marked, "marked")
    joined = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(marked) if n_labels <= 500_000 else marked, "doc_id")
    size = joined.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // settings.characters))
    columns = [F.floor(spread("doc_id", 4) * n).cast("int").alias("shard"), spread("doc_id", 2).alias("place"), "doc_id", F.xxhash64("text", "lang").alias("tie"), (spread("doc_id", 3) < 0.25).alias("apart"), (F.col("toxic") == 1).alias("label"), "lang", "text"]
    order = ["shard", "place", "doc_id", "tie"]
    rows = joined.select(*columns).repartition(n, "shard").sortWithinPartitions(*order)

    def row(shard: int, held: list[tuple]) -> pd.DataFrame:
        texts, numbers, sizes = [h[0] for h in held], [], []
        for a, b in batches(texts):
            own, bounds = word_numbers(texts[a:b])
            numbers.append(own[:, bounds[0] : bounds[-1]])
            sizes += np.diff(bounds).tolist()
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = lambda k: np.array([h[k] for h in held], dtype=np.uint8).tobytes()
        return pd.DataFrame({"shard": [shard], "bounds": [bounds.tobytes()], "numbers": [np.concatenate(numbers, axis=1).tobytes()], "labels": [flat(2)], "apart": [flat(1)], "langs": [[h[3] for h in held]]})

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, now, last = [], 0, None, None
        for frame in frames:
            for shard, doc, apart, label, own_lang, text in zip(*[frame[c].tolist() for c in ("shard", "doc_id", "apart", "label", "lang", "text")], strict=True):
                more = len(text) if isinstance(text, str) else 0
                if held and (shard != now or size + more > PIECE):
                    yield row(now, held)
                    held, size = [], 0
                # the first one of rows that share an id
                if (shard, doc) != last:
                    held.append((text, apart, label, own_lang if isinstance(own_lang, str) else None))
                    size += more
                now, last = shard, (shard, doc)
        if held:
            yield row(now, held)

    return stored(rows.mapInPandas(gathered, "shard int, bounds binary, numbers binary, labels binary, apart binary, langs array<string>"), "labelled", WHOLE_FILES)


def _passed(shards: DataFrame, what: Callable[[Iterator[Shard]], Iterator[dict]]) -> Iterator[dict]:
    """What each task makes of its shards; tasks come in any order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def own() -> Iterator[Shard]:
            held: list = []
            for frame in frames:
                for r in frame.itertuples(index=False):
                    if held and r.shard != held[0].shard:
                        yield _shard(held)
                        held = []
                    held.append(r)
            if held:
                yield _shard(held)

        for found in what(own()):
            data = zlib.compress(pickle.dumps(found), 1)
            for a in range(0, len(data), HANDED):
                yield pd.DataFrame({"found": [data[a : a + HANDED]], "last": [a + HANDED >= len(data)]})

    parts: list[bytes] = []
    for r in shards.coalesce(TASKS).mapInPandas(run, "found binary, last boolean").toPandas().itertuples(index=False):
        parts.append(r.found)
        if r.last:
            yield pickle.loads(zlib.decompress(b"".join(parts)))
            parts = []


def _averaged(shards: DataFrame, net: Network, settings: Settings, epochs: int, k: int, split: bool) -> Network:
    """The mean of the networks that each shard makes of ``net``, by their numbers of texts."""
    start = shards.sparkSession.sparkContext.broadcast(net)
    dense = lambda x: [*x.kernels, x.bias, x.out, np.array([x.shift])]

    def trained(own: Iterator[Shard]) -> Iterator[dict]:
        old, total, weight = start.value, None, 0
        table, weights = np.zeros(old.table.shape), np.zeros(old.table.shape[:2])
        for shard in own:
            learn = np.flatnonzero(~shard.apart) if split else np.arange(len(shard.labels))
            if not len(learn):
                continue
            texts, mine = shard.texts, copy.deepcopy(old)
            moved = train(mine, [texts[i] for i in learn], shard.labels[learn].astype(np.int64), settings, epochs, [settings.seed, k, shard.number])
            n = len(learn)
            weight += n
            table[moved] += n * (mine.table[moved].astype(np.float64) - old.table[moved])
            weights[moved] += n
            moves = [n * (x.astype(np.float64) - y) for x, y in zip(dense(mine), dense(old), strict=True)]
            total = moves if total is None else [x + y for x, y in zip(total, moves, strict=True)]
        if weight:
            at = np.flatnonzero(weights.ravel() > 0)
            yield {"at": at.astype(np.int32), "table": table.reshape(-1, table.shape[2])[at].astype(np.float32), "weights": weights.ravel()[at].astype(np.float32), "total": total, "weight": weight}

    table, weights, total, weight = np.zeros((net.table.shape[0] * net.table.shape[1], net.table.shape[2])), np.zeros(net.table.shape[0] * net.table.shape[1]), 0, 0
    for part in _passed(shards, trained):
        table[part["at"]] += part["table"]
        weights[part["at"]] += part["weights"]
        total = part["total"] if not weight else [x + y for x, y in zip(total, part["total"], strict=True)]
        weight += part["weight"]
    start.destroy()
    new = copy.deepcopy(net)
    new.table += (table / np.maximum(weights, 1)[:, None]).reshape(net.table.shape).astype(np.float32)
    *kernels, bias, out, shift = [x / weight for x in total]
    new.kernels = [(x + y).astype(np.float32) for x, y in zip(net.kernels, kernels, strict=True)]
    new.bias, new.out, new.shift = (net.bias + bias).astype(np.float32), (net.out + out).astype(np.float32), float(net.shift + shift[0])
    return new


def _answers(shards: DataFrame, net: Network, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The network's answers to the texts kept apart (all, where none are), each bin, label and language once, with
    labels, numbers of texts, and languages."""
    model = shards.sparkSession.sparkContext.broadcast(net)

    def asked(own: Iterator[Shard]) -> Iterator[dict]:
        found: Counter = Counter()
        for shard in own:
            check, texts = np.flatnonzero(shard.apart) if split else np.arange(len(shard.labels)), shard.texts
            at = 0
            while at < len(check):
                sizes = np.cumsum([texts[i].shape[1] for i in check[at : at + 5000]])
                part = check[at : at + max(1, int(np.searchsorted(sizes, WORDS)))]
                at += len(part)
                raw = model.value.logits(np.concatenate([texts[i] for i in part], axis=1), np.concatenate([[0], np.cumsum([texts[i].shape[1] for i in part])]))
                found.update(zip(np.rint(raw.astype(np.float64) * BINS).astype(int).tolist(), shard.labels[part].tolist(), [shard.langs[i] for i in part], strict=True))
        yield found

    found: Counter = Counter()
    for part in _passed(shards, asked):
        found.update(part)
    model.destroy()
    items = sorted(found.items(), key=lambda x: (x[0][0], x[0][1], x[0][2] or ""))
    return np.array([x[0] / BINS for x, _ in items]), np.array([x[1] for x, _ in items]), np.array([n for _, n in items], dtype=np.float64), np.array([x[2] for x, _ in items], dtype=object)


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted (score at least 0.5), threshold (of the document's language) and flagged."""
    docs = python_ready(docs)
    found = fit(docs, labels, usable, settings)
    model = docs.sparkSession.sparkContext.broadcast(found)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in frames:
            texts = own.tolist()
            yield pd.Series(np.concatenate([*[model.value.score(texts[a:b]) for a, b in batches(texts, 500_000)], np.zeros(0)]))

    threshold = F.lit(found.threshold)
    if found.by_language:
        threshold = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(found.by_language.items()) for x in kv])[lang], threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), threshold.alias("threshold"), score("text").alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged; learned where the id's bucket modulo 5 is not 0."""
    out = toxicity(docs, labels, id_bucket("doc_id", 5) != 0)
    return out.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "threshold", "flagged")
