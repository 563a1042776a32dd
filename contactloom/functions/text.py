"""Numbers, sizes and reports as text."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.schema import InvalidInput

SCALE = {"k": 10**3, "m": 10**6, "g": 10**9}


def bin_size(text: str) -> int:
    """``10k``, ``1.5m``, ``1e4``: exact decimal times a power of a thousand, cut to a whole number."""
    plain = text.strip().lower().replace(" ", "")
    factor = SCALE.get(plain[-1:], 1)
    try:
        value = Decimal(plain[:-1] if factor > 1 else plain) * factor
    except InvalidOperation:
        raise InvalidInput(f"not a bin size: {text!r}") from None
    if not value.is_finite() or not 1 <= value < 1 << 63:
        raise InvalidInput(f"bin size out of range: {text!r}")
    return int(value)


@F.pandas_udf(T.StringType())
def plain_number(values: pd.Series) -> pd.Series:
    """The shortest decimal that reads back as the same number, without exponent or trailing zeros."""
    kind = values.dtype.type if values.dtype.kind == "f" else np.float64
    words = {"nan": "NaN", "inf": "inf", "-inf": "-inf"}
    return pd.Series([None if v is None else words.get(str(v)) or np.format_float_positional(kind(v), unique=True, trim="-") for v in values])


def to_json(report: dict) -> str:
    """Compact, keys in order."""
    return json.dumps(report, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a checksum that names a file's content."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h
