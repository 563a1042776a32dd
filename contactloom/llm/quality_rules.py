"""Line-first cleaning with DataFrame functions only.

Every line is held against punctuation, navigation and boilerplate rules, lines that fail
go, and a document goes when it loses too large a part of its text. The base counts
(repeated windows, duplicate lines, symbols) are computed in the same pass. Each document
is one row from scan to result: nothing is exploded and nothing is shuffled, so a hot
source or a huge group of copies changes nothing.

Defined results: a null or empty text has no words, counts of 0, ``base_failed`` true and
``kept`` false. Repeated rows each get their own result. An empty table gives an empty
table. Texts of any length take the same path. Only ``text`` is read; :func:`clean` carries other columns of any name
through, :func:`measured` those whose names no result has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineRules:
    """``max_lost``: the part of the characters that may go with failing lines."""

    max_lost: float = 0.5
    #: A line has to end a sentence or a part of one, in whatever script; closing quotes, brackets and white space may follow.
    ends: str = ".!?…:;,。！？．：；，、｡؟۔؛،।॥"
    closers: str = "\"'”’»›)]」』】）》 \t\x0b\x0c\r\u00a0"
    #: Failing that, it has to hold a whole sentence.
    inner_end: str = r"""[.!?…]["'”’»)\]]*[\x20\x09-\x0D]|[。！？।॥؟۔]"""
    #: A menu: at least two bars, arrows or bullets, and no more than ``words_a_mark`` words for each.
    navigation_marks: str = "|•›»>"
    #: Those that close a quotation where one is opened.
    quote_marks: str = "|•>"
    opening: str = "[«‹]"
    words_a_mark: int = 4
    #: Runs of signs or exclamation marks, at least three and no fewer than one for so many words.
    noise: str = r"[#*$%&<>]{2,}|!!+"
    noise_marks: tuple[str, ...] = ("!!", "##", "**", "$$", "%%", "&&", "<<", ">>")
    words_a_noise: int = 4
    #: Phrases of notices (in lower case, between characters that are no letters), one for so many words.
    notices: tuple[str, ...] = (
        "licensed under", "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "cookie settings",
        "uses cookies", "use cookies", "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
        "subscribe to our", "subscribe now", "sign up for our", "copyright ©", "copyright [(]c[)]", "copyright [0-9]{4}", "© ?[0-9]{4}",
    )
    words_a_notice: int = 25
    #: Phrases of buttons and menus, which prose may hold as well.
    buttons: tuple[str, ...] = ("click here", "sign in", "sign up", "log in", "log out", "powered by", "read more", "skip to content")
    words_a_button: int = 6
    min_words: int = 50
    max_repeated_percent: int = 50


def phrases(of: tuple[str, ...]) -> str:
    return f"(?:^|[^a-z])(?:{'|'.join(of)})(?:[^a-z]|$)"


def passes(line: Column, small: Column, rules: LineRules) -> Column:
    """Whether a line with a word is kept; ``small`` is the line in lower case. What a rule counts is held against the line's words, so a long
    paragraph isn't lost to one sign or phrase. Plain substring tests stand before the patterns, which few lines then reach."""
    any_of = lambda text, marks: reduce(lambda a, b: a | b, [text.contains(m) for m in marks])
    words = F.size(F.array_remove(F.split(line, SPACE), ""))
    shut = F.rtrim(line, F.lit(rules.closers))
    ends = (shut != "") & F.lit(rules.ends).contains(F.right(shut, F.lit(1)))
    without = lambda marks: F.length(line) - F.length(F.translate(line, marks, ""))
    marks = F.when(line.rlike(rules.opening), without(rules.quote_marks)).otherwise(without(rules.navigation_marks))
    often = lambda of: F.regexp_count(small, F.lit(phrases(of)))
    some = any_of(small, [re.split(r"[\[?]", p)[0].rstrip() for p in rules.notices + rules.buttons])
    runs = F.regexp_count(line, F.lit(rules.noise))
    return (
        (ends | line.rlike(rules.inner_end))
        & ~(any_of(line, rules.navigation_marks) & (marks >= 2) & (rules.words_a_mark * marks >= words))
        & ~(any_of(line, rules.noise_marks) & (runs >= 3) & (rules.words_a_noise * runs >= words))
        & ~(some & (((often(rules.notices) > 0) & (rules.words_a_notice * often(rules.notices) >= words)) | ((often(rules.buttons) > 0) & (rules.words_a_button * often(rules.buttons) >= words))))
    )


def _window(at: Column) -> Column:
    """The 64-bit hash of the three words from place ``at`` on."""
    return F.xxhash64(F.get("_hashes", at), F.get("_hashes", at + 1), F.get("_hashes", at + 2))


def _repeated_positions() -> Column:
    """Start positions of 3-word windows that occur at least twice, as an array of longs.

    A window's hash, with its position in place of the low bits, is one long, so the sort is one of plain numbers:
    n log n for a text of any length. Equal windows are then neighbours, but for others that share the upper bits; so the
    full hashes of near neighbours that share them are compared.
    """
    keys, mask = F.col("_keys"), F.col("_mask")
    place = lambda k: k.bitwiseAND(mask).cast("int")

    def like(k: Column, other: Column) -> Column:
        return F.coalesce(k.bitwiseXOR(other).bitwiseAND(F.bitwise_not(mask)) == 0, F.lit(False)) & (_window(place(k)) == _window(place(other)))

    twice = F.filter(keys, lambda k, i: like(k, F.get(keys, i + 1)) | like(k, F.get(keys, i - 1)) | like(k, F.get(keys, i + 2)) | like(k, F.get(keys, i - 2)))
    return F.transform(twice, lambda k: k.bitwiseAND(mask))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost", "clean_text", "base_failed", "kept")


def _judged(docs: DataFrame, rules: LineRules) -> DataFrame:
    """The columns of ``docs`` by number (_c0, _c1, …), whatever their names, and _result with all of RESULTS."""
    names = [c.lower() for c in docs.columns]
    carried = [f"_c{i}" for i in range(len(names))]
    t = docs.toDF(*carried)
    t = t.withColumn("_text", F.coalesce(F.col(carried[names.index("text")]), F.lit("")))
    t = t.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    t = t.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    t = t.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "_good": F.filter(F.transform("_lines", lambda x: F.struct(x.alias("x"), F.lower(x).alias("small"))), lambda p: passes(p.x, p.small, rules)).x,
        }
    )
    starts = F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0)))
    t = t.withColumn("_mask", F.expr("shiftleft(1L, cast(ceil(log2(n_words + 1)) as int)) - 1"))
    t = t.withColumn("_keys", F.sort_array(F.transform(starts, lambda h, i: _window(i).bitwiseAND(F.bitwise_not(F.col("_mask"))).bitwiseOR(i.cast("long")))))
    t = t.withColumn("_sum", _repeated_positions())
    t = t.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform("_sum", lambda p: F.array(p, p + 1, p + 2))))).cast("long"),
            "clean_text": F.array_join("_good", "\n"),
        }
    )
    whole = F.length(F.array_join("_lines", "\n"))
    t = t.withColumn("lost", F.when(whole > 0, 1 - F.length("clean_text") / whole).otherwise(F.lit(0.0)))
    t = t.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated_percent * F.col("n_words")))
    t = t.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.max_lost))
    # a filter on a result must not be pushed down into the expressions that it comes from: they would be
    # computed anew for each word
    return t.select(*carried, F.explode(F.array(F.struct(*RESULTS))).alias("_result"))


def measured(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost (part of the
    characters in failing lines), clean_text, base_failed and kept. A column of ``docs`` with such a name gives way."""
    own = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in RESULTS]
    return _judged(docs, rules).select(*[F.col(f"_c{i}").alias(c) for i, c in own], *[F.col(f"_result.{c}") for c in RESULTS])


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, without the lines that fail; the same columns as ``docs``, whatever their names."""
    changed = {"text": F.col("_result.clean_text"), "n_chars": F.length("_result.clean_text").cast("long")}
    kept = _judged(docs, rules).where("_result.kept")
    return kept.select(*[changed.get(c.lower(), F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def oracle_sql(rules: LineRules = LineRules()) -> str:
    """The counts and verdicts in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    words = f"len(list_filter(regexp_split_to_array(x, {quote(SPACE)}), lambda w: w <> ''))"
    shut = f"rtrim(x, {quote(rules.closers)})"
    without = lambda marks: f"length(x) - length(translate(x, {quote(marks)}, ''))"
    marks = f"(CASE WHEN regexp_matches(x, {quote(rules.opening)}) THEN {without(rules.quote_marks)} ELSE {without(rules.navigation_marks)} END)"
    runs = f"len(regexp_extract_all(x, {quote(rules.noise)}))"
    often = lambda of: f"len(regexp_extract_all(lower(x), {quote(phrases(of))}))"
    passes = (
        f"(({shut} <> '' AND contains({quote(rules.ends)}, right({shut}, 1))) OR regexp_matches(x, {quote(rules.inner_end)}))"
        f" AND NOT ({marks} >= 2 AND {rules.words_a_mark} * {marks} >= {words}) AND NOT ({runs} >= 3 AND {rules.words_a_noise} * {runs} >= {words})"
        f" AND NOT ({often(rules.notices)} > 0 AND {rules.words_a_notice} * {often(rules.notices)} >= {words})"
        f" AND NOT ({often(rules.buttons)} > 0 AND {rules.words_a_button} * {often(rules.buttons)} >= {words})"
    )
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, k, text, list_filter(regexp_split_to_array(text, {quote(SPACE)}), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {quote(NOT_SPACE)})) AS lines FROM texts),
windows AS (SELECT k, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
counted AS (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS c FROM windows),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE c > 1) GROUP BY k),
base AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, length(array_to_string(lines, chr(10))) AS whole, length(coalesce(array_to_string(list_filter(lines, lambda x: {passes}), chr(10)), '')) AS good
  FROM split LEFT JOIN covered USING (k)),
judged AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeated_percent} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (whole = 0 OR 1 - good / CAST(whole AS DOUBLE) <= {rules.max_lost}) AS kept FROM judged"""
