"""Copy numbers of contigs: declared in a small file, 1 where nothing is declared."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

from contactloom.sources.files import Folder

FILE = "cn.info"
MOST = (1 << 64) - 1
#: The number of a contig for which none is declared.
DEFAULT = 1


class CopyNumberError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class CopyNumbers:
    """``present``: the file exists, if empty; ``explicit``: what it declares."""

    present: bool
    explicit: dict[str, int]
    contigs: tuple[str, ...]

    def report(self) -> dict:
        every = dict.fromkeys(self.contigs, DEFAULT) | self.explicit
        rows = [{"contig": c, "copy_number": n} for c, n in every.items()]
        return {"present": self.present, "explicit": self.explicit, "declaration_count": len(self.explicit), "default": DEFAULT, "contigs": rows}


def value_of(contig: str, value: str | int, contigs: set[str]) -> int:
    """The number that is declared for a contig, given as a whole number or its digits."""
    if contig not in contigs:
        raise CopyNumberError("CN_UNKNOWN_CONTIG", contig)
    number = int(value) if isinstance(value, str) and re.fullmatch("[0-9]+", value) else value
    if type(number) is not int or number not in range(1, MOST + 1) or re.search(r"^#|[\s\0]|^$", contig):
        raise CopyNumberError("CN_VALUE", f"{contig}: {value}")
    return number


def parse(text: str, contigs: list[str]) -> dict[str, int]:
    """Declarations, one a line: contig and number. Blank lines and comments count for nothing."""
    known = set(contigs)
    rows = [f for f in map(str.split, text.splitlines()) if f and f[0][0] != "#"]
    if wrong := [f for f in rows if len(f) != 2]:
        raise CopyNumberError("CN_FORMAT", f"a line has a contig and a number: {' '.join(wrong[0])}")
    out = {contig: value_of(contig, value, known) for contig, value in rows}
    if len(out) < len(rows):
        raise CopyNumberError("CN_DUPLICATE", next(c for c, n in Counter(f[0] for f in rows).items() if n > 1))
    return out


def read(spark: SparkSession, path: str, contigs: list[str]) -> CopyNumbers:
    folder = Folder(spark, path)
    if not folder.exists(FILE):
        return CopyNumbers(False, {}, tuple(contigs))
    if folder.is_folder(FILE):
        raise CopyNumberError("CN_UNREADABLE", FILE)
    return CopyNumbers(True, parse(folder.read(FILE).decode(), contigs), tuple(contigs))


def replace(spark: SparkSession, path: str, contigs: list[str], numbers: dict[str, int]) -> CopyNumbers:
    """Declare exactly these: the file is replaced in one step."""
    known = set(contigs)
    lines = [f"{contig}\t{value_of(contig, numbers[contig], known)}\n" for contig in sorted(numbers)]
    Folder(spark, path).write(FILE, "".join(lines))
    return read(spark, path, contigs)


def update(spark: SparkSession, path: str, contigs: list[str], numbers: dict[str, int]) -> CopyNumbers:
    """Declare these besides the others. Nothing to declare: nothing is written."""
    now = read(spark, path, contigs)
    return replace(spark, path, contigs, now.explicit | numbers) if numbers else now
