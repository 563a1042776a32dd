"""Coordinates and identity of an alignment from its CIGAR operations."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

OPERATIONS = "MIDNSHP=X"
TEXT = re.compile(rf"(\d+)([{OPERATIONS}])")


@dataclass(frozen=True)
class Placement:
    """Query interval on the forward strand of the read, reference span and identity (None if not asked for)."""

    read_length: int
    read_start: int
    read_end: int
    reference_span: int
    identity: float | None


def parse(text: str) -> list[tuple[int, str]]:
    ops = [(int(n), op) for n, op in TEXT.findall(text)]
    if not ops or "".join(f"{n}{op}" for n, op in ops) != text:
        raise ValueError(f"invalid CIGAR: {text!r}")
    return ops


def place(ops: list[tuple[int, str]], reverse: bool, sequence_length: int = 0, nm: int | None = None, with_identity: bool = True) -> Placement:
    total = dict.fromkeys(OPERATIONS, 0)
    for n, op in ops:
        if n < 1 or op not in total:
            raise ValueError("invalid CIGAR operation or length")
        total[op] += n
    shape = "".join(op for _, op in ops)
    if not re.fullmatch("H?S*[^HS]+S*H?", shape):
        raise ValueError("clips stand at an alignment's ends, hard ones outermost")
    used = total["M"] + total["="] + total["X"]
    in_sequence = used + total["I"] + total["S"]
    length = in_sequence + total["H"]
    span = used + total["D"] + total["N"]
    if sequence_length and sequence_length != in_sequence:
        raise ValueError("CIGAR and sequence differ in length")
    head = re.match("[HS]*", shape).end()
    tail = len(shape) - re.search("[HS]*$", shape).start()
    before = sum(n for n, _ in ops[:head])
    after = sum(n for n, _ in ops[len(ops) - tail :]) if tail else 0
    if before + after >= length or not span or length >= 1 << 32:
        raise ValueError("an alignment covers bases of read and reference")
    if reverse:
        before, after = after, before
    return Placement(length, before, length - after, span, _identity(total, used, nm) if with_identity else None)


def _identity(total: dict[str, int], used: int, nm: int | None) -> float:
    gaps = total["I"] + total["D"]
    if nm is None:
        if total["M"]:
            raise ValueError("identity of M operations needs the NM tag")
        wrong = total["X"]
    else:
        wrong = nm - gaps
        if not total["X"] <= wrong <= total["X"] + total["M"]:
            raise ValueError("NM tag and CIGAR disagree")
    return float(np.float32((used - wrong) / (used + gaps)))
