"""Exact token ids of whole texts with public tokenizer files, memoised by stretch.

The two shapes of files in ``SHAPES`` split their input before merging, and some of the splits can be seen
from outside: before white space, and between a run of Latin letters and the stops after
it. A stretch between two such places gets the same ids wherever it stands. So a worker
asks the library once for each stretch and looks the rest up. Its memory is bounded: a full
table is set aside and a new one begun, into which what is still used moves over. Texts with one of the four control characters on which
Python and the library disagree about white space go to the library whole, and so do all texts
where the file has another shape.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa

#: Kinds of bytes. A stretch is ``\s*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,;:!?#$%&*|]|$)|\s*\S+|\s+``.
OTHER, LETTER, STOP, WHITE, BETWEEN, LATIN, WIDE = range(7)
#: Stands around texts; one of ``DISPUTED``, so that no text that is cut has it.
EDGE = "\x1c"
#: Python counts these as white space, the Unicode property that the tokenizers use does not.
DISPUTED = ("\x1c", "\x1d", "\x1e", "\x1f")
#: A stretch that is one pre-token, and so shows its own end in the ids of many such stretches.
PLAIN = re.compile("[ ][A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Stretches in a table; a worker holds two.
FULL = 600_000
#: Stands between stretches that are encoded in one call; its last id belongs to no other text.
MARK = " \0"
CALL = 500

_KINDS = {LETTER: b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", STOP: b".,;:!?#$%&*|", WHITE: b"\t\n\v\f\r ", BETWEEN: EDGE.encode(), LATIN: b"\xc3", WIDE: b"\xc2\xe1\xe2\xe3"}
KIND = bytes(next((k for k, own in _KINDS.items() if b in own), OTHER) for b in range(256))
#: White space above ASCII.
WHITES = [np.frombuffer(c.encode(), dtype=np.uint8) for c in map(chr, range(128, 0x3001)) if c.isspace()]

_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
#: Normaliser and pre-tokenizer of files whose splits are those of stretches. Fixed values.
SHAPES = (
    (None, _BYTES | {"use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                _BYTES | {"use_regex": False},
            ],
        },
    ),
)

_LIBRARY: dict[str, object] = {}
_ENCODER: dict[str, Encoder] = {}


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: printable
    Latin-1 signs stand for themselves, the others follow from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The sign of each byte.
SIGNS = {b: c for c, b in byte_signs().items()}


def disputed(text: str) -> bool:
    return any(c in text for c in DISPUTED)


def known_shape(tokenizer) -> bool:
    """Whether texts may be cut into stretches: a known normaliser and pre-tokenizer, no randomness in the
    merges, and no added token that takes white space with it."""
    file = json.loads(tokenizer.to_str())
    added = [t for t in file.get("added_tokens") or [] if t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])]
    return (file.get("normalizer"), file.get("pre_tokenizer")) in SHAPES and not added and not file["model"].get("dropout") and file["model"]["type"] == "BPE"


def library(path: str):
    """The tokenizers library's object for a ``.json`` file, one for each process."""
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LIBRARY[path] = t
    return _LIBRARY[path]


def encoder(path: str, full: int | None = None) -> Encoder:
    """The process's encoder, which later tasks of the same worker use again. ``full``: stretches in a table, in place of FULL."""
    if path not in _ENCODER:
        _ENCODER[path] = Encoder(path)
    _ENCODER[path].full = full
    return _ENCODER[path]


def stretches(texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """The distinct stretches of many texts, and for each stretch in order its number from 1. A 0 stands
    before the first text and after each."""
    data = f"{EDGE}{EDGE.join([t or '' for t in texts])}{EDGE if texts else ''}".encode()
    signs = np.frombuffer(data, dtype=np.uint8)
    kind = np.frombuffer(bytearray(data).translate(KIND), dtype=np.uint8)
    above = np.flatnonzero(kind >= LATIN)
    latin = above[kind[above] == LATIN]
    wide = above[kind[above] == WIDE]
    kind[above] = OTHER
    latin = latin[(signs[latin + 1] != 0x97) & (signs[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    for white in WHITES if len(wide) else ():
        own = wide[signs[wide] == white[0]]
        for j in range(1, len(white)):
            own = own[signs[own + j] == white[j]]
        for j in range(len(white)):
            kind[own + j] = WHITE
    white, between, letter = kind == WHITE, kind == BETWEEN, kind == LETTER
    begins = between.copy()
    begins[1:] |= between[:-1]
    begins[1:] |= white[1:] & ~white[:-1]
    turns = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    first, after = turns[::2], turns[1::2]
    begins[after[(kind[after] == STOP) & ((kind[first - 1] == WHITE) | (kind[first - 1] == BETWEEN))]] = True
    starts = np.append(np.flatnonzero(begins), len(data))
    cut = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
    return cut.indices.to_numpy(), cut.dictionary.to_numpy(zero_copy_only=False)[1:].tolist()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start`` to ``start + count``, one range after another."""
    after = np.cumsum(counts)
    return np.arange(int(after[-1]) if len(after) else 0) + np.repeat(starts - after + counts, counts)


class Encoder:
    """Ids of texts as the library gives them for ``path``, without added special tokens."""

    full: int | None = None

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.stretches = known_shape(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ending = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Ids that end a plain stretch, or without such an ending those that begin one.
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith(ending) if ending else t.startswith("Ġ"))]] = True
        self.edge_ends = bool(ending)
        self.merger = self._merger()
        self._begin()
        self.aside = (self.known, self.ids, self.ends)
        self._begin()

    def _merger(self):
        """The model by itself, where it gives plain stretches that stand one after another the ids of the library: byte
        signs that are all known, merges alone, none of them over the beginning of a stretch, no added token of letters."""
        file = json.loads(self.tokenizer.to_str())
        model = file["model"]
        plain = file.get("normalizer") is None and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not self.stretches or not plain or any(PLAIN.fullmatch(" " + t["content"]) for t in file.get("added_tokens") or []):
            return None
        over = re.compile("[A-Za-z]Ġ|(?:^|Ã)[" + "".join(SIGNS[b] for b in range(0x80, 0xC0)) + "]Ġ")
        whole = all(c in model["vocab"] for c in SIGNS.values()) and not any(map(over.search, model["vocab"]))
        return self.tokenizer.model if whole else None

    def _plain_ids(self, part: list[str]) -> np.ndarray:
        """The ids of plain stretches that stand one after another."""
        if self.merger is None:
            [e] = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)
            return np.array(e.ids, dtype=np.uint32)
        signs = "".join(part).encode().decode("latin-1").translate(SIGNS)
        return np.fromiter(map(attrgetter("id"), self.merger.tokenize(signs)), dtype=np.uint32)

    def _begin(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _add(self, stretches: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = len(self.known), self.used
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(stretches) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(stretches)] = used + np.cumsum(counts)
        self.known.update(zip(stretches, range(n, n + len(stretches)), strict=True))
        self.used += len(ids)

    def _learn(self, new: list[str]) -> None:
        """Ask the library for stretches, many to a call: plain ones as they are, others between white space
        parted by a mark, the rest as texts of their own."""
        joined, single, plain = [], [], []
        for s in new:
            if PLAIN.fullmatch(s):
                plain.append(s)
                continue
            (joined if s[0].isspace() and not s[-1].isspace() and "\0" not in s else single).append(s)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)]
        if single:
            self._add(single, np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.array([len(x) for x in found]))
        for i in range(0, len(plain), CALL):
            part = plain[i : i + CALL]
            ids = self._plain_ids(part)
            edges = np.flatnonzero(self.edge[ids])
            counts = np.diff(edges, prepend=-1) if self.edge_ends else np.diff(edges, append=len(ids))
            if len(edges) != len(part) or counts.sum() != len(ids):
                raise ValueError("the tokenizer doesn't split at white space")
            self._add(part, ids, counts)
        mark = np.array(self.tokenizer.encode(MARK, add_special_tokens=False).ids, dtype=np.uint32)
        for i in range(0, len(joined), CALL):
            part = joined[i : i + CALL]
            [e] = self.tokenizer.encode_batch_fast([MARK.join(part) + MARK], add_special_tokens=False)
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == mark[-1])
            if len(ends) != len(part):
                raise ValueError("the tokenizer's mark isn't unique")
            of_mark = np.zeros(len(ids), dtype=bool)
            for k in range(len(mark)):
                of_mark[ends - k] = True
            self._add(part, ids[~of_mark], np.diff(ends, prepend=-1) - len(mark))

    def _found(self, distinct: list[str]) -> np.ndarray:
        """What is known of each stretch; unknown ones are learned."""
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new, aside = [distinct[i] for i in missing], self.aside[0]
            self._move([s for s in new if s in aside])
            self._learn([s for s in new if s not in aside])
            at[missing] = [self.known[s] for s in new]
        return at

    def _move(self, stretches: list[str]) -> None:
        """Take stretches over from the table that was set aside."""
        known, ids, ends = self.aside
        at = np.array([known[s] for s in stretches], dtype=np.int64)
        if len(at):
            counts = ends[at + 1] - ends[at]
            self._add(stretches, ids[_ranges(ends[at], counts)], counts)

    def _turn(self) -> None:
        if len(self.known) > (self.full or FULL):
            self.aside = (self.known, self.ids, self.ends)
            self._begin()

    def whole(self, texts: list[str | None]) -> dict[int, list[int]]:
        """Ids, by number, of texts that must not be cut into stretches."""
        return {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if t and (not self.stretches or disputed(t))}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. A null text has none."""
        whole = self.whole(texts)
        codes, distinct = stretches([None if i in whole else t for i, t in enumerate(texts)])
        self._turn()
        at = self._found(distinct)
        starts, counts = np.append(0, self.ends[at])[codes], np.append(0, self.ends[at + 1] - self.ends[at])[codes]
        ids = self.ids[_ranges(starts, counts)]
        bounds = np.cumsum(counts)[codes == 0]
        sizes = np.diff(bounds)
        if whole:
            parts = [np.array(whole[i], dtype=np.uint32) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return ids, sizes
