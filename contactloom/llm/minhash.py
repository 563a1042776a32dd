"""Near-duplicate groups by MinHash with an inverted join over signature coordinates.

Documents are linked if the Jaccard similarity of their sets of word shingles reaches a
threshold; the groups are the connected components of the links.

1. One pass computes each text's shingle set, its size, a 128-bit fingerprint and a
   signature of ``coordinates`` minima. Equal sets collapse to one class, so copies cost
   one row from here on.
2. Each coordinate with its value is a token. Classes that agree in at least ``matches``
   coordinates share a token among any ``coordinates - matches + 1`` of each, taken in one
   common order. The order is rarest first, by counts of all tokens in a table of fixed size,
   so what many documents share (a licence, a passage) is hardly ever posted.
3. Star round: in each posting every class looks at the posting's most typical member. The
   star that a class meets most often is counted in full, then confirmed on the sets.
   Members of one star are one component; a posting within one component is done.
4. Rest round: pairs from different components that meet in short postings. Their collisions are merged: how
   many there were, and the last places of the two at which one was. What can still come behind those
   places is bounded, and a pair that can't reach ``matches`` any more is skipped. The coordinates behind the
   prefix, whose lists are long, are never merged: the pairs that are left look them up, each in the other's signature.
5. Members of long postings are joined exactly on their shingles, by the prefix filter: sets over
   the threshold share one of their rarest shingles at a place from which enough could
   follow. There classes outside the posting's largest component meet all others, so a large
   group of near copies never pairs with itself.
6. Surviving pairs are confirmed on the full sets and the components joined.

Nothing is dropped: long postings take the exact way of step 5. Where one class is in very many pairs, as the centre
of a great star is, its row is copied and its pairs spread over the copies. Every table is written to
the shared folder; the driver holds counts and two arrays of fixed size.

Defined results: texts of any length are taken whole, one alone in its batch where it is long, in memory of some ten times its
size; a text without words has an empty set, is linked with nothing and kept;
equal texts are one group; rows that share a doc_id are one document; rows without an id join
no group's name: they are kept only if no row with an id has an equal set; an empty table
gives an empty table. Extra columns are ignored by :func:`groups` and kept by
:func:`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import batches, filled_id, prefix_hashes, python_ready, restored_id, spans, stored, without_ids

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    """Links: 100 * intersection >= percent * union of sets of ``words``-word shingles.

    ``matches`` of ``coordinates`` is low enough that a pair at the threshold falls below it with
    probability under 1e-6. Postings over ``long`` members go the exact way. The tables of counts
    have ``token_slots`` and ``shingle_slots`` entries. ``broadcast_ids``: ids of a semi-join's small side.
    A class in more than ``many`` pairs has its pairs spread over ``copies`` keys.
    """

    words: int = 5
    percent: int = 85
    coordinates: int = 64
    matches: int = 38
    long: int = 32
    token_slots: int = 1 << 16
    shingle_slots: int = 1 << 18
    broadcast_ids: int = 500_000
    many: int = 20_000
    copies: int = 64
    seed: int = 17


def shingle_sets(texts: Sequence[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after another, and the bounds of the texts."""
    data, starts, ends, bounds = spans([b"" if t is None else t.encode().translate(LOWER) for t in texts], NOT_SPACE)
    [own] = prefix_hashes(data, starts, ends, [None])
    n = np.diff(bounds)
    sizes = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = np.arange(total[-1]) + np.repeat(bounds[:-1] - total[:-1], sizes)
    last = np.repeat(bounds[1:], sizes)
    odd = np.random.default_rng(99).integers(1, 1 << 63, words, dtype=np.uint64) | np.uint64(1)
    padded = np.concatenate([own, np.zeros(words, np.uint64)])
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(words):
        # behind a short text's end the place alone counts
        h += np.where(first + k < last, padded[first + k], np.uint64(k + 1)) * odd[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(28)
    for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True):
        h[a:b].sort()
    distinct = np.ones(len(h), dtype=bool)
    distinct[1:] = h[1:] != h[:-1]
    distinct[total[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(distinct)])
    return h[distinct], kept[total]


def signatures(sets: np.ndarray, bounds: np.ndarray, settings: Settings) -> np.ndarray:
    """(texts, coordinates) upper halves of the smallest hashes; zeros for empty sets."""
    rng = np.random.default_rng(settings.seed)
    odd = rng.integers(1, 1 << 63, settings.coordinates, dtype=np.uint64) | np.uint64(1)
    mask = rng.integers(0, 1 << 63, settings.coordinates, dtype=np.uint64)
    out = np.zeros((len(bounds) - 1, settings.coordinates), dtype=np.uint32)
    full = np.diff(bounds) > 0
    if full.any():
        starts = bounds[:-1][full]
        for k in range(settings.coordinates):
            least = np.minimum.reduceat((sets ^ mask[k]) * odd[k], starts)
            out[full, k] = (least >> np.uint64(32)).astype(np.uint32)
    return out


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for odd in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        mixed = sets * np.uint64(odd)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(odd ^ 0x5555_5555_5555_5554)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        out.append((run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
    return out


def _features(docs: DataFrame, settings: Settings) -> DataFrame:
    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches(texts):
                sets, bounds = shingle_sets(texts[a:b], settings.words)
                one, two = fingerprints(sets, bounds)
                marks = [s.tobytes() for s in signatures(sets, bounds, settings)]
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].to_numpy(), "n": np.diff(bounds), "f1": one, "f2": two, "signature": marks})

    return restored_id(docs.select(filled_id("doc_id"), "text").mapInPandas(compute, "doc_id long, n long, f1 long, f2 long, signature binary"), "doc_id")


def _tokens(signatures_: pd.Series, settings: Settings) -> np.ndarray:
    values = np.frombuffer(b"".join(signatures_), dtype=np.uint32).reshape(-1, settings.coordinates)
    return (np.arange(settings.coordinates, dtype=np.int64) << 32) | values.astype(np.int64)


def _slot(tokens: np.ndarray, slots: int) -> np.ndarray:
    mixed = tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % slots


def _slot_counts(rows: DataFrame, slots: int, tokens) -> np.ndarray:
    """How many of all rows' tokens fall in each slot of a table of fixed size."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, dtype=np.int64)
        for frame in frames:
            total += np.bincount(_slot(tokens(frame), slots).ravel(), minlength=slots)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"slot": own, "n": total[own]})

    summed = rows.mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(slots, dtype=np.int64)
    out[summed["slot"]] = summed["n"]
    return out


def _postings(classes: DataFrame, settings: Settings) -> DataFrame:
    """token, rep, n, the token's place in the class's order and how typical a class is (the mean log count of its
    tokens), for the prefix of each class."""
    counts = classes.sparkSession.sparkContext.broadcast(_slot_counts(classes.select("signature"), settings.token_slots, lambda f: _tokens(f["signature"], settings)))
    prefix = settings.coordinates - settings.matches + 1

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            tokens = _tokens(frame["signature"], settings)
            often = counts.value[_slot(tokens, settings.token_slots)]
            order = np.lexsort((tokens, often), axis=1)[:, :prefix]
            typical = np.log(often).mean(axis=1)
            kept = np.take_along_axis(tokens, order, axis=1)
            each = lambda c: np.repeat(c.to_numpy() if isinstance(c, pd.Series) else c, prefix)
            place = np.tile(np.arange(prefix, dtype=np.int32), len(frame))
            yield pd.DataFrame({"token": kept.ravel(), "rep": each(frame["rep"]), "n": each(frame["n"]), "place": place, "typical": each(typical)})

    return classes.select("rep", "n", "signature").mapInPandas(post, "token long, rep long, n long, place int, typical double")


def _merged(meetings: DataFrame, settings: Settings) -> DataFrame:
    """a, b and ``met``, their collisions in the postings, from one row (a, b, place_a, place_b) for each. Tokens that
    two classes share stand in the same order in both, so behind the last collision in the prefixes there are no more
    than the coordinates left to either, and pairs that can't come to ``matches`` are skipped. (A pair that also meets in a
    long posting may go here, as step 5 finds it.)"""
    merged = meetings.groupBy("a", "b").agg(F.count("*").alias("met"), F.greatest(F.max("place_a"), F.max("place_b")).alias("_last"))
    return merged.where(F.col("met") + (settings.coordinates - 1 - F.col("_last")) >= settings.matches).drop("_last")


def _with(pairs: DataFrame, end: str, table: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` joined to ``table`` (rep and other columns) on their column ``end``. A class in very many pairs
    would make one task of them all: its row is copied and its pairs are spread."""
    if pairs.count() <= settings.many:
        return pairs.join(table.withColumnRenamed("rep", end), end)
    often = stored(pairs.groupBy(end).count().where(F.col("count") > settings.many).select(F.col(end).alias("_often")), "often")
    if not often.limit(1).count():
        return pairs.join(table.withColumnRenamed("rep", end), end)
    # no more classes than pairs / many
    hot = F.broadcast(often)
    spread = pairs.join(hot, F.col(end) == F.col("_often"), "left").withColumn("_copy", F.when(F.col("_often").isNotNull(), F.pmod(F.xxhash64("a", "b"), F.lit(settings.copies))).otherwise(F.lit(0)).cast("int")).drop("_often")
    copies = F.when(F.col("_often").isNotNull(), F.sequence(F.lit(0), F.lit(settings.copies - 1))).otherwise(F.array(F.lit(0)))
    rows = table.join(hot, F.col("rep") == F.col("_often"), "left").withColumn("_copy", F.explode(copies)).drop("_often")
    return spread.join(rows.withColumnRenamed("rep", end), [end, "_copy"]).drop("_copy")


def _alike(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``matches`` coordinates."""
    marks = classes.select("rep", "signature")
    both = _with(_with(pairs.select("a", "b"), "a", marks.withColumnRenamed("signature", "_sa"), settings), "b", marks.withColumnRenamed("signature", "_sb"), settings)

    def agree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                same = _tokens(frame["_sa"], settings) == _tokens(frame["_sb"], settings)
                yield frame.loc[same.sum(axis=1) >= settings.matches, ["a", "b"]]

    return both.select("a", "b", "_sa", "_sb").mapInPandas(agree, "a long, b long")


def _sets_of(reps: DataFrame, classes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """rep and its shingle set as bytes, computed again from the texts: sets of all documents are never stored."""
    wanted = reps.select("rep").distinct().join(classes.select("rep", "f1"), "rep")
    wanted = stored(wanted, "wanted")
    few = wanted.count() <= settings.broadcast_ids
    rows = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"] == wanted["rep"]).select("rep", "f1", "text")

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches(texts):
                sets, bounds = shingle_sets(texts[a:b], settings.words)
                own = [sets[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                part = pd.DataFrame({"rep": frame["rep"].iloc[a:b].to_numpy(), "members": own})
                yield part[fingerprints(sets, bounds)[0] == frame["f1"].iloc[a:b].to_numpy()]

    return stored(rows.mapInPandas(compute, "rep long, members binary").dropDuplicates(["rep"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs that are linked, by their full sets."""
    both = _with(_with(pairs, "a", sets.withColumnRenamed("members", "_ma"), settings), "b", sets.withColumnRenamed("members", "_mb"), settings)

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["_ma"], frame["_mb"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                joined = np.concatenate([x, y])
                joined.sort(kind="stable")
                common = int((joined[1:] == joined[:-1]).sum())
                good.append(100 * common >= settings.percent * (len(joined) - common))
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    return both.select("a", "b", "_ma", "_mb").mapInPandas(confirm, "a long, b long")


def _fits(n: str, m: str, settings: Settings) -> Column:
    """Whether two sizes allow a link at all."""
    return 100 * F.least(n, m) >= settings.percent * F.greatest(n, m)


def _roots(links: DataFrame) -> DataFrame:
    """rep and comp, the root of its tree, for links of a class a to a more typical b; each a has one.
    Pointers are doubled until none changes."""
    tree = stored(links.select(F.col("a").alias("rep"), F.col("b").alias("comp")), "roots")
    while True:
        up = tree.select(F.col("rep").alias("comp"), F.col("comp").alias("_up"))
        tree = stored(tree.join(up, "comp", "left").select("rep", F.coalesce("_up", "comp").alias("comp"), F.col("_up").isNotNull().alias("_moved")), "roots")
        moved = tree.where("_moved").limit(1).count()
        tree = tree.select("rep", "comp")
        if not moved:
            return tree


def connected(edges: DataFrame) -> DataFrame:
    """node and the least node of its component, by alternating large and small stars until nothing changes.

    In a large star every greater neighbour of a node links to the least neighbour, in a small star the
    others do; both keep the components. All steps are aggregates and joins on nodes.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = stored(small, "edges")
        change = edges.exceptAll(small).limit(1).count() + small.exceptAll(edges).limit(1).count()
        edges = small
        if not change:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))


def _exact_pairs(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of different components that pass the prefix, size and place tests on their shingles.

    A set's shingles are ordered rarest first, by counts among these members. With overlap o needed
    for the link, two sets share a shingle among the first ``n - o + 1`` of each; ``place`` bounds
    what can follow a shared one.
    """
    spark = sets.sparkSession
    flat = lambda column: np.frombuffer(b"".join(column), dtype=np.uint64)
    counts = spark.sparkContext.broadcast(_slot_counts(sets.select("members"), settings.shingle_slots, lambda f: flat(f["members"])))

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rep, comp, data in zip(frame["rep"].tolist(), frame["comp"].tolist(), frame["members"], strict=True):
                own = np.frombuffer(data, dtype=np.uint64)
                n = len(own)
                first = n - -(-settings.percent * n // 100) + 1
                order = np.lexsort((own, counts.value[_slot(own, settings.shingle_slots)]))[:first]
                out.append(pd.DataFrame({"token": own[order].view(np.int64), "rep": rep, "comp": comp, "n": n, "place": np.arange(first)}))
            if out:
                yield pd.concat(out)

    rows = stored(members.join(sets, "rep").select("rep", "comp", "members").mapInPandas(post, "token long, rep long, comp long, n long, place long"), "shingles")
    per = rows.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp"))["comp"].alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    rows = stored(rows.join(per.select("token", "largest"), "token"), "shingles")
    a, b = rows.where("comp <> largest"), rows
    a, b = a.select("token", *[F.col(c).alias(f"{c}_a") for c in ("rep", "comp", "n", "place")]), b.select("token", "largest", *[F.col(c).alias(f"{c}_b") for c in ("rep", "comp", "n", "place")])
    needed = F.ceil(F.lit(settings.percent) * (F.col("n_a") + F.col("n_b")) / (100 + settings.percent))
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    once = (F.col("comp_b") == F.col("largest")) | (F.col("rep_a") < F.col("rep_b"))
    pairs = a.join(b, "token").where((F.col("comp_a") != F.col("comp_b")) & once & _fits("n_a", "n_b", settings) & (rest >= needed))
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept."""
    docs = python_ready(docs)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = stored(_features(docs, settings), "features")
    full = rows.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("signature").alias("signature")), "classes")

    postings = stored(_postings(classes, settings), "postings")
    star = postings.groupBy("token").agg(F.count("*").alias("size"), F.max(F.struct("typical", (-F.col("rep")).alias("minus"))).alias("top")).where("size > 1")
    star = star.select("token", "size", (-F.col("top.minus")).alias("centre"))
    postings = stored(postings.join(star, "token").select("token", "rep", "n", "place", "size", "centre"), "postings")

    # star round: of the centres that a class meets, the one it meets most often
    met = postings.where("rep <> centre").groupBy("rep", "centre").count()
    best = met.groupBy("rep").agg(F.max(F.struct("count", (-F.col("centre")).alias("minus"))).alias("top")).select(F.col("rep").alias("a"), (-F.col("top.minus")).alias("b"))
    first = stored(_alike(stored(best, "best"), classes, settings), "pairs")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    trees = _roots(_confirmed(first, _sets_of(ends(first), classes, docs, settings), settings))

    # rest round: what lies between components
    placed = postings.join(trees, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("token")
    placed = stored(placed.join(mixed, "token").select("token", "rep", "n", "place", "size", "comp"), "postings")
    short = placed.where(F.col("size") <= settings.long)
    x, y = (short.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "place", "comp")]) for s in "ab")
    near = x.join(y, "token").where((F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b")) & _fits("n_a", "n_b", settings))
    near = near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "place_a", "place_b")
    rest = stored(_alike(stored(_merged(near, settings), "merged"), classes, settings), "pairs")
    long = stored(placed.where(F.col("size") > settings.long).select("rep", "comp").distinct(), "members")
    sets = _sets_of(ends(rest).unionByName(long.select("rep")), classes, docs, settings)
    exact = _exact_pairs(long, sets.join(long.select("rep"), "rep", "left_semi"), settings)
    more = _confirmed(stored(rest.unionByName(exact).distinct(), "pairs"), sets, settings)

    root = lambda c: trees.select(F.col("rep").alias(c), F.col("comp").alias(f"root_{c}"))
    between = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = connected(between)
    labelled = classes.select("f1", "f2", "rep").join(trees, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    labelled = labelled.join(joined.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("least", "comp"))
    labelled = stored(labelled.select("f1", "f2", "rep", "comp"), "labels")
    least = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labelled = labelled.join(least, "comp").select("f1", "f2", "component_id")

    out = rows.join(labelled, ["f1", "f2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group, with the columns of ``docs``. Rows without an id stay; of rows that
    share an id one stays."""
    found = stored(groups(docs, settings), "groups")
    left = without_ids(docs, found.where("not kept"))
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not again.limit(1).count():
        return left
    again = stored(again.select(F.col("doc_id").alias("_again")), "again")
    same = left["doc_id"].cast("long") == again["_again"]
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id"]))


def oracle_sql(settings: Settings = Settings()) -> str:
    """The groups in DuckDB's SQL, by all shared shingles and the closure of the links."""
    upper = "".join(map(chr, range(65, 91)))
    n = settings.words
    shingle = " || chr(10) || ".join(f"words[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
long AS (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM split WHERE len(words) >= {n}),
sets AS (SELECT DISTINCT doc_id, {shingle} AS s FROM long UNION SELECT doc_id, array_to_string(words, chr(10)) FROM split WHERE len(words) BETWEEN 1 AND {n - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= {settings.percent} * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id, doc_id AS other FROM split UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)"""
