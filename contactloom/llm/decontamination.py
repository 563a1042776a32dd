"""Benchmark passages in documents, found by the CGK embedding and bit-sampling LSH.

Words are lower-cased runs of letters, marks and digits, and each character of a script written without
spaces, so case, punctuation, signs and line breaks don't matter.
A document leaks an item if one of its word sequences is within ``edits`` of the item: word
edit distance at most ``rate`` times the item's words. The CGK embedding walks over a
sequence with random steps that depend on step and word; two sequences at a small edit
distance stay together for most of the walk, so edit distance becomes Hamming distance. Item-sized
windows of the documents and the items are embedded, a few positions of the walk are
sampled as a key, and windows that share a key with an item are candidates. Hamming distance
grows faster than the number of edits, most for insertions or deletions only, so no fixed number of
keys finds all: a window that holds enough of one item's word pairs is a candidate too. Each
candidate is then verified by exact edit distance, so the result is that of the rule.

Embedding every window would be waste: an edit spoils at most two neighbouring word pairs
of an item, so a window that doesn't hold enough of the pairs of items of its size can't
be within the limit. Neither pair test loses anything. Nor is a window embedded that begins with none of the
first ``edits + 1`` words of an item: a closest stretch may begin with a word it shares with the item, as leaving
out those before it costs no more. And a candidate that lacks more of the item's words than the limit isn't verified. All of it runs where the document lies;
nothing is shuffled but found (document, item) pairs. Items are taken in blocks of a
fixed size, so what is broadcast is bounded whatever the benchmark's size; where there are several, one pass
with a table of fixed size over all items' pairs leaves the texts that the blocks then search.

Defined results: null or empty texts leak nothing; items without a text, an id or a word
match nothing; texts and items may have any length; items of fewer than ``least_words`` words match where all their words stand in a row; repeated items (equal item_id)
give a pair once with the least distance; repeated documents give equal rows once; empty tables give an
empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import batches, character_kinds, filled_id, prefix_hashes, python_ready, restored_id, stored, without_ids

#: Characters of scripts written without spaces; each is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@cache
def kinds() -> np.ndarray:
    """For each character 0 outside of words, 1 in a word, 2 a word by itself."""
    out = (character_kinds() > 0).astype(np.uint8)
    for a, b in UNSPACED:
        out[a : b + 1] *= 2
    return out


def word_spans(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of many texts, lower-cased, the starts and ends of the words in them, and for text ``i``
    the word range ``bounds[i]:bounds[i + 1]``."""
    parts = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    kind = np.where(np.arange(256) < 128, kinds()[:256], 0).astype(np.uint8)[data]
    single = _mark_wide(data, kind)
    if single:
        # a character that is a word by itself is marked 3 at its first byte and 2 at the others
        edges = (kind[1:] != kind[:-1]) & ((kind[1:] != 2) | (kind[:-1] != 3)) | (kind[1:] == 3)
        starts, ends = np.flatnonzero(edges & (kind[1:] > 0)) + 1, np.flatnonzero(edges & (kind[:-1] > 0)) + 1
    else:
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
    text_at = np.concatenate([[1], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) + 1])
    return data, starts, ends, np.searchsorted(starts, text_at)


def _mark_wide(data: np.ndarray, kind: np.ndarray) -> bool:
    """Set the kinds of the bytes of all characters above ASCII; whether some are words by themselves."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x3F >> size - 1)
    rest = [(more, lead[more] + j) for j in (1, 2, 3) if len(more := np.flatnonzero(size > j))]
    for more, at in rest:
        code[more] = code[more] << 6 | data[at] & 0x3F
    own = kinds()[code]
    for more, at in rest:
        kind[at] = own[more]
    kind[lead] = own + (own == 2)
    return bool((own == 2).any())


@dataclass(frozen=True)
class Settings:
    """``hamming``: the part of the walk's positions in which sequences may differ and still share a key
    with probability ``recall``; from it follows the number of keys. What shares none is found by its word pairs."""

    rate: float = 0.15
    least_words: int = 8
    walks: int = 3
    sampled: int = 4
    hamming: float = 0.5
    recall: float = 0.99
    items_in_block: int = 20_000
    #: Occurrences of items' word pairs that are looked at together.
    pairs_at_once: int = 2_000_000
    #: Steps of walks that are held together.
    embedded_at_once: int = 500_000
    seed: int = 5

    def edits(self, words: int) -> int:
        return int(self.rate * words)

    def pairs(self, words: int) -> int:
        """Word pairs of the item that a window from the right start on holds at least. An edit spoils
        two, and each word that insertions push out at the end one more."""
        return max(1, words - 1 - 3 * self.edits(words))

    def keys(self) -> int:
        """Keys for each walk."""
        n = np.log(1 - self.recall) / np.log(1 - (1 - self.hamming) ** self.sampled)
        return int(np.ceil(n / self.walks))


def step_numbers(settings: Settings, size: int) -> np.ndarray:
    """One odd number for each walk and step. Those of a smaller size are the first ones of a larger size."""
    draw = lambda w: np.random.default_rng(settings.seed * 1000 + w).integers(1, 1 << 63, 2 * size, dtype=np.uint64)
    return np.stack([draw(w) for w in range(settings.walks)]) | np.uint64(1)


def sample_places(settings: Settings, size: int) -> np.ndarray:
    """For each (walk, sample) a row of the positions that make its key, as rows of :func:`walks`."""
    out = []
    for w in range(settings.walks):
        rng = np.random.default_rng([settings.seed, w, size])
        out += [np.sort(rng.choice(2 * size, settings.sampled, replace=False)) * settings.walks + w for _ in range(settings.keys())]
    return np.stack(out).astype(np.int32)


def walks(windows: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The CGK embeddings of word hashes, one sequence a row: its words, then as many zeros. Row ``step * walks + walk``
    of the result holds a column for each sequence. A walk advances by half a word a step in the mean; its first two
    steps for each word are those that keys sample from."""
    n, width = windows.shape
    at = np.repeat(np.arange(n)[None] * width, len(odd), axis=0)
    flat, out = np.ascontiguousarray(windows).ravel(), np.empty((width, *at.shape), dtype=np.uint64)
    for step in range(width):
        word = np.take(flat, at, out=out[step], mode="clip")
        at += (((word + np.uint64(step)) * odd[:, step, None]) >> np.uint64(63)).view(np.int64)
    return out.reshape(width * len(odd), n)


def sample_keys(windows: np.ndarray, odd: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A row of keys for each (walk, sample) of sequences as :func:`walks` takes them; no two samples have keys in common."""
    path = walks(windows, odd[:, : windows.shape[1]])
    key = np.uint64(0x243F6A8885A308D3) + np.arange(len(places), dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
    for rows in places.T:
        key = key ^ path[rows]
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def edit_distance(item: list[int], text: list[int], limit: int) -> tuple[int, int]:
    """The least word edit distance of the item to any stretch of the text, and where the stretch ends; (limit + 1, 0) beyond the limit.

    A column of the table of distances is kept as the bits of two whole numbers (where it goes up, where down), so a
    word of the text costs a few operations whatever the item's length.
    """
    at: dict[int, int] = {}
    for i, word in enumerate(item):
        at[word] = at.get(word, 0) | 1 << i
    top, every = 1 << len(item) - 1, (1 << len(item)) - 1
    up, down, last = every, 0, len(item)
    best, end = last, 0
    for j, word in enumerate(text, 1):
        same = at.get(word, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | every & ~(diagonal | up)
        left = up & diagonal
        last += bool(right & top) - bool(left & top)
        # the item may begin anywhere in the text, so no step comes in at the table's edge
        right, left = right << 1 & every, left << 1 & every
        vertical = same | down
        up, down = left | every & ~(vertical | right), right & vertical
        if last < best:
            best, end = last, j
    return (best, end) if best <= limit else (limit + 1, 0)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    h = words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def row_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    n = len(words) - size + 1
    h = np.full(max(n, 0), size, dtype=np.uint64)
    for j in range(size if n > 0 else 0):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


class Items:
    """A block of items by size: their words, word pairs and keys."""

    def __init__(self, ids: list[int], texts: list[str | None], settings: Settings):
        self.settings = settings
        data, starts, ends, bounds = word_spans(texts)
        [words] = prefix_hashes(data, starts, ends, [None])
        by_size: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = defaultdict(dict)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(dict)
        for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True):
            if 0 < b - a < settings.least_words:
                self.short[int(b - a)].setdefault(int(row_hashes(words[a:b], int(b - a))[0]), []).append(i)
            elif b > a:
                by_size[int(b - a)].setdefault(words[a:b].tobytes(), (words[a:b], []))[1].append(i)
        self.sizes = sorted(by_size)
        self.items: dict[int, list[tuple[np.ndarray, list[int]]]] = {s: list(by_size[s].values()) for s in self.sizes}
        self.odd = step_numbers(settings, self.sizes[-1] if self.sizes else 1)
        self.places = {s: sample_places(settings, s) for s in self.sizes}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.holders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.heads = {s: np.unique(np.concatenate([w[: settings.edits(s) + 1] for w, _ in self.items[s]])) for s in self.sizes}
        masks: dict[int, int] = defaultdict(int)
        for place, s in enumerate(self.sizes):
            keys, holder = [], []
            for a in range(0, len(self.items[s]), self._at_once(s)):
                windows = np.stack([np.pad(w, (0, s)) for w, _ in self.items[s][a : a + self._at_once(s)]])
                keys.append(sample_keys(windows, self.odd, self.places[s]).ravel())
                holder.append(np.tile(np.arange(a, a + len(windows)), len(self.places[s])))
            keys, holder = np.concatenate(keys), np.concatenate(holder)
            order = np.argsort(keys, kind="stable")
            bits = (8 * len(keys)).bit_length()
            slots = np.zeros(1 << bits, dtype=bool)
            slots[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.keys[s] = keys[order], holder[order], slots
            own = [np.unique(pair_hashes(w)) for w, _ in self.items[s]]
            for h in np.unique(np.concatenate(own)).tolist():
                masks[h] |= 1 << place % 64
            pairs, holder = np.concatenate(own), np.repeat(np.arange(len(own)), [len(h) for h in own])
            order = np.argsort(pairs, kind="stable")
            self.holders[s] = (pairs[order], holder[order])
        order = sorted(masks)
        self.pairs = np.array(order, dtype=np.uint64)
        self.masks = np.array([masks[h] for h in order], dtype=np.uint64)
        self.slots = np.zeros(1 << 22, dtype=bool)
        self.slots[(self.pairs >> np.uint64(42)).astype(np.int64)] = True

    def search(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item_id, distance, word at which the stretch ends) of all leaks in texts given by word hashes."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for size, known in self.short.items():
            hashes = row_hashes(words, size)
            at = np.flatnonzero(np.isin(hashes, np.array(list(known), dtype=np.uint64)))
            text = np.searchsorted(bounds, at, side="right") - 1
            for t, start in zip(text.tolist(), at.tolist(), strict=True):
                if start + size <= bounds[t + 1]:
                    for i in known[int(hashes[start])]:
                        found.setdefault((t, i), (0, start + size - int(bounds[t])))
        if not self.sizes or len(words) < 2:
            return [(t, i, d, e) for (t, i), (d, e) in found.items()]
        hashes = pair_hashes(words)
        maybe = self.slots[(hashes >> np.uint64(42)).astype(np.int64)]
        spots = np.flatnonzero(maybe)
        at = np.minimum(np.searchsorted(self.pairs, hashes[spots]), len(self.pairs) - 1)
        true = self.pairs[at] == hashes[spots]
        mask = np.zeros(len(words) + 1, dtype=np.uint64)
        mask[spots[true]] = self.masks[at[true]]
        mask[bounds[1:-1][bounds[1:-1] > 0] - 1] = 0  # pairs over the end of a text
        held = np.flatnonzero(mask)
        of_size = mask[held]
        padded = np.concatenate([words, np.zeros(self.sizes[-1], np.uint64)])
        for place, size in enumerate(self.sizes):
            edits, least = self.settings.edits(size), self.settings.pairs(size)
            spots = held[(of_size & np.uint64(1 << place % 64)) != 0]
            starts = _starts(spots, size, least)
            if not len(starts):
                continue
            text = np.searchsorted(bounds, starts, side="right") - 1
            end = bounds[text + 1]
            # a window may run over its text's end by as much as an item may have lost
            enough = np.searchsorted(spots, np.minimum(starts + size - 1, end)) - np.searchsorted(spots, starts) >= least
            use = enough & (starts + size - edits <= end)
            starts = starts[use]
            if not len(starts):
                continue
            head = self.heads[size]
            begin = np.flatnonzero(head[np.minimum(np.searchsorted(head, words[starts]), len(head) - 1)] == words[starts])
            candidates = self._candidates(padded, starts[begin], end[use][begin], text[use][begin], size)
            before = np.searchsorted(starts, spots, side="right") - 1
            spots = spots[(before >= 0) & (spots - starts[before] <= size - 2)]
            self._sharing(hashes, spots, bounds, size, 0, len(self.items[size]), candidates)
            for (t, k), at in candidates.items():
                item, ids = self.items[size][k]
                item = item.tolist()
                best, where = edits + 1, 0
                for first, last in _regions(sorted(at), size + 2 * edits):
                    low, high = max(int(bounds[t]), first - edits), min(int(bounds[t + 1]), last + size + 2 * edits)
                    stretch = words[low:high].tolist()
                    # each word of the item that the stretch lacks is an edit
                    if sum(map(set(stretch).__contains__, item)) < size - edits:
                        continue
                    d, e = edit_distance(item, stretch, edits)
                    if d < best:
                        best, where = d, low + e - int(bounds[t])
                if best <= edits:
                    for i in ids:
                        if (t, i) not in found or best < found[t, i][0]:
                            found[t, i] = (best, where)
        return [(t, i, d, e) for (t, i), (d, e) in found.items()]

    def _candidates(self, padded: np.ndarray, starts: np.ndarray, end: np.ndarray, text: np.ndarray, size: int) -> dict[tuple[int, int], set[int]]:
        """(text, item of this size) that share a key, with the starts of the windows."""
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        known, holder, slots = self.keys[size]
        shift = np.uint64(65 - len(slots).bit_length())
        for a in range(0, len(starts), self._at_once(size)):
            own = starts[a : a + self._at_once(size)]
            at = own[:, None] + np.arange(size)
            windows = np.zeros((len(own), 2 * size), dtype=np.uint64)
            windows[:, :size] = np.where(at < end[a : a + len(own), None], padded[at], np.uint64(0))
            keys = sample_keys(windows, self.odd, self.places[size]).ravel()
            maybe = np.flatnonzero(slots[(keys >> shift).view(np.int64)])
            low, high = np.searchsorted(known, keys[maybe], side="left"), np.searchsorted(known, keys[maybe], side="right")
            times = high - low
            item = holder[np.arange(times.sum()) + np.repeat(low - np.cumsum(times) + times, times)]
            pairs = np.unique(item * len(own) + np.repeat(maybe % len(own), times))
            for k, row in zip((pairs // len(own)).tolist(), (pairs % len(own)).tolist(), strict=True):
                out[int(text[a + row]), k].add(int(own[row]))
        return out

    def _at_once(self, size: int) -> int:
        """Sequences that are embedded together."""
        return max(1, self.settings.embedded_at_once // (2 * size * self.settings.walks))

    def _sharing(self, hashes: np.ndarray, spots: np.ndarray, bounds: np.ndarray, size: int, a: int, b: int, out: dict[tuple[int, int], set[int]]) -> None:
        """Add to ``out`` the windows that hold enough pairs of one of the items ``a`` to ``b`` of this size, by their first and last start."""
        least, (pairs, holder) = self.settings.pairs(size), self.holders[size]
        if b - a < len(self.items[size]):
            part = (holder >= a) & (holder < b)
            pairs, holder = pairs[part], holder[part]
        low = np.searchsorted(pairs, hashes[spots], side="left")
        times = np.searchsorted(pairs, hashes[spots], side="right") - low
        total = int(times.sum())
        if total > self.settings.pairs_at_once and b - a > 1:
            self._sharing(hashes, spots, bounds, size, a, (a + b) // 2, out)
            self._sharing(hashes, spots, bounds, size, (a + b) // 2, b, out)
            return
        k = holder[np.arange(total) + np.repeat(low - np.cumsum(times) + times, times)]
        at = np.repeat(spots, times)
        order = np.argsort(k, kind="stable")
        k, at = k[order], at[order]
        text = np.searchsorted(bounds, at, side="right") - 1
        first, last = slice(0, max(0, total - least + 1)), slice(least - 1, None)
        near = np.flatnonzero((k[first] == k[last]) & (text[first] == text[last]) & (at[last] - at[first] <= size - 2))
        for e in near.tolist():
            t = int(text[e])
            out[t, int(k[e])] |= {max(int(bounds[t]), int(at[e + least - 1]) - size + 2), int(at[e])}


def _starts(spots: np.ndarray, size: int, least: int) -> np.ndarray:
    """The starts of the windows of ``size`` words in which ``least`` of these word pairs lie, in ascending order."""
    near = np.flatnonzero(spots[least - 1 :] - spots[: max(0, len(spots) - least + 1)] <= size - 2)
    first, last = np.maximum(spots[near + least - 1] - size + 2, 0), spots[near]
    first[1:] = np.maximum(first[1:], last[:-1] + 1)
    times = last - first + 1
    return np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)


def _regions(at: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Ranges of starts whose windows overlap."""
    first = last = at[0]
    for x in at[1:]:
        if x > last + reach:
            yield first, last
            first = x
        last = x
    yield first, last


class Sieve:
    """A table of fixed size of the word pairs and short items of all items, to tell which texts need a search."""

    BITS = 28

    def __init__(self, settings: Settings):
        self.settings, self.sizes, self.short = settings, set(), set()
        self.table = np.zeros(1 << self.BITS - 3, dtype=np.uint8)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = hashes >> np.uint64(64 - self.BITS)
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, texts: Sequence[str]) -> None:
        data, starts, ends, bounds = word_spans(texts)
        [words] = prefix_hashes(data, starts, ends, [None])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b > a:
                few = b - a < self.settings.least_words
                (self.short if few else self.sizes).add(b - a)
                place, bit = self._place(row_hashes(words[a:b], b - a) if few else pair_hashes(words[a:b]))
                np.bitwise_or.at(self.table, place, bit)

    def _holds(self, hashes: np.ndarray) -> np.ndarray:
        place, bit = self._place(hashes)
        return (self.table[place] & bit) > 0

    def suspects(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text whether it holds a short item's place in the table, or a window with enough pairs that are in it."""
        n, found = len(words), np.zeros(len(bounds) - 1, dtype=bool)
        of_text = lambda at: np.searchsorted(bounds, at, side="right") - 1
        for size in self.short:
            found[of_text(np.flatnonzero(self._holds(row_hashes(words, size))))] = True
        if n > 1 and self.sizes:
            run = np.zeros(n + max(self.sizes), dtype=np.int32)
            np.cumsum(self._holds(pair_hashes(words)), out=run[1:n])
            run[n:] = run[n - 1]
            for size in self.sizes:
                found[of_text(np.flatnonzero(run[size - 1 : n + size - 1] - run[:n] >= self.settings.pairs(size)))] = True
        return found


def _suspects(texts: DataFrame, items: DataFrame, blocks: int, settings: Settings) -> DataFrame:
    """The texts that may hold one of the items, found in one pass however many items there are."""
    sieve = Sieve(settings)
    for block in range(blocks):
        sieve.add([r["text"] for r in _block(items, block, blocks)])
    held = texts.sparkSession.sparkContext.broadcast(sieve)

    def sift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["text"].tolist()
            for a, b in batches(own):
                data, starts, ends, bounds = word_spans(own[a:b])
                [words] = prefix_hashes(data, starts, ends, [None])
                yield frame.iloc[a:b][held.value.suspects(words, bounds)]

    return stored(texts.mapInPandas(sift, texts.schema), "suspects")


def _block(items: DataFrame, block: int, blocks: int) -> list:
    return items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, distance (word edits) and end_word (where the closest stretch ends) of each document and item it leaks."""
    docs = python_ready(docs)
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, end_word long"
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // settings.items_in_block))
    texts = docs.select(filled_id("doc_id"), "text").where(F.col("text").isNotNull())
    if blocks > 1:
        texts = _suspects(texts, items, blocks, settings)
    parts = []
    for block in range(blocks):
        rows = _block(items, block, blocks)
        held = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], settings))

        def search(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for frame in frames:
                own, keys, out = frame["text"].tolist(), frame["doc_id"].tolist(), []
                for a, b in batches(own):
                    data, starts, ends, bounds = word_spans(own[a:b])
                    [words] = prefix_hashes(data, starts, ends, [None])
                    out += [(keys[a + t], i, d, e) for t, i, d, e in held.value.search(words, bounds)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "end_word"])

        parts.append(texts.mapInPandas(search, schema))
    found = reduce(DataFrame.unionByName, parts)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word")).alias("_best"))
    return restored_id(best.select("doc_id", "item_id", "_best.distance", "_best.end_word"), "doc_id")


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that leak an item; rows without an id stay."""
    return without_ids(docs, leaks(docs, benchmark, settings))
