"""The dataset description: a Python-like literal, read without running anything."""

from __future__ import annotations

import ast
import re

MOST_BYTES, MOST_DEPTH = 16 << 20, 64
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>[-+]?\d[\d_.]*(?:[eE][-+]?\d+)?)|(?P<word>[A-Za-z_][\w.]*)|(?P<sign>[{}\[\](),:]))""", re.S)
WORDS = {"True": True, "False": False, "None": None}
#: Format names and the one version of each that is understood. Fixed values.
VERSIONS = {"pairs": "0.1.0", "concat": "0.2.0"}


def parse_literal(data: bytes | str):
    """Dicts, lists, strings, numbers and bare words (as strings). Repeated keys are an error."""
    text = data.decode() if isinstance(data, bytes) else data
    if len(text) > MOST_BYTES:
        raise ValueError("metadata is too large")
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"metadata can't be read at {at}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    value, end = _value(tokens, 0, 0)
    if end != len(tokens):
        raise ValueError("text behind the metadata")
    return value


def _value(tokens: list, at: int, depth: int):
    if depth > MOST_DEPTH or at >= len(tokens):
        raise ValueError("metadata is nested too deeply or cut off")
    kind, text = tokens[at]
    if kind == "text":
        return ast.literal_eval(text), at + 1
    if kind == "number":
        return (int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)), at + 1
    if kind == "word":
        return WORDS.get(text, text), at + 1
    if text in "[(":
        return _items(tokens, at + 1, depth, "]" if text == "[" else ")")
    if text == "{":
        return _entries(tokens, at + 1, depth)
    raise ValueError(f"unexpected {text!r} in metadata")


def _ended(tokens: list, at: int, close: str) -> bool:
    if at >= len(tokens):
        raise ValueError("metadata is cut off")
    return tokens[at] == ("sign", close)


def _items(tokens: list, at: int, depth: int, close: str):
    out = []
    while not _ended(tokens, at, close):
        value, at = _value(tokens, at, depth + 1)
        out.append(value)
        if not _ended(tokens, at, close):
            at = _expect(tokens, at, ",")
    return out, at + 1


def _entries(tokens: list, at: int, depth: int):
    out: dict = {}
    while not _ended(tokens, at, "}"):
        key, at = _value(tokens, at, depth + 1)
        at = _expect(tokens, at, ":")
        value, at = _value(tokens, at, depth + 1)
        if not isinstance(key, str) or key in out:
            raise ValueError(f"metadata keys are strings, each once: {key!r}")
        out[key] = value
        if not _ended(tokens, at, "}"):
            at = _expect(tokens, at, ",")
    return out, at + 1


def _expect(tokens: list, at: int, sign: str) -> int:
    if at >= len(tokens) or tokens[at] != ("sign", sign):
        raise ValueError(f"metadata: {sign!r} is missing")
    return at + 1


def checked(metadata: dict) -> dict:
    """The metadata if its format and version are understood."""
    kind, version = metadata.get("format"), metadata.get("format-version")
    if kind not in VERSIONS or version != VERSIONS[kind]:
        raise ValueError(f"format {kind!r} version {version!r} isn't supported")
    if metadata.get("read_idx_scope", "global") not in ("global", "shard"):
        raise ValueError("read_idx_scope is global or shard")
    return metadata


def literal(metadata: dict) -> str:
    return "{" + ",\n ".join(f"{k!r}: {v!r}" for k, v in metadata.items()) + "}\n"
