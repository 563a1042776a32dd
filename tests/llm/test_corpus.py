"""Quality rules, sharding, near-duplicates, decontamination, extraction and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm import decontamination, html_extraction, minhash, quality_rules, sharding

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


# --- quality rules


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(1)
    clean = "\n".join(sentence(rng, 12) for _ in range(8))
    texts = [
        None, "", " \n\t", "a b c a b c", clean, clean + "\nHome | News | Sport | Login", "\n".join(["Home | News | Sport"] * 40) + "\n" + sentence(rng, 30), clean.replace(" ", "### "),
        "x y z w " * 100, clean + "\n" + clean, "\x0bé a\x0cb\r\nc\n\n" + clean, " ".join(rng.choice(WORDS) for _ in range(40_000)), clean,
        "All rights reserved.\n" * 60, "#" * 5000 + clean,
    ]
    docs = spark.createDataFrame([(i, t, "k", True) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words boolean").repartition(3)
    found = {r.doc_id: r for r in quality_rules.measured(docs).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t), i
        assert not (r.kept and r.base_failed)
    kept = {i for i, r in found.items() if r.kept}
    assert {4, 5, 10, 12} <= kept and not {0, 1, 2, 3, 6, 7, 13} & kept
    assert found[5].clean_text == clean
    out = quality_rules.clean(docs.drop("kept", "n_words").withColumn("n_chars", F.length("text")))
    assert out.columns == ["doc_id", "text", "n_chars"] and {r.doc_id for r in out.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert quality_rules.measured(docs.limit(0)).count() == 0
    plan = quality_rules.measured(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_look_at_whole_lines_in_any_script(spark):
    long = " ".join(["word"] * 40)
    good = [
        "Dear all," + " " * 20, "यह एक वाक्य है।", "هل هذا سؤال؟", "这是一个句子。", "Elle a dit « bonjour » puis « au revoir » à tous ses amis de la ville.",
        f"A design in {long} dialog in the analog inlay, with one cookie and a copyright.", f"If a > b and b > c then {long}.", f"**Bold** {long} **bold** {long} **bold**.",
        f"The privacy policy was debated {long}.", 'He said: "So it is." ' + "\u00a0" * 30,
    ]
    bad = ["Home | News | Sport | Login.", "All rights reserved.", "We use cookies. Accept cookies.", "a### b&&& c*** d%%%.", "no end of a sentence", "»»»", "Click here to sign in."]
    docs = spark.createDataFrame([(i, f"{line}\n{long}.") for i, line in enumerate(good + bad)], "doc_id long, text string")
    found = {r.doc_id: r.clean_text.split("\n")[0] for r in quality_rules.measured(docs).collect()}
    assert [line for i, line in enumerate(good) if found[i] != line] == []
    assert [line for i, line in enumerate(bad, len(good)) if found[i] == line] == []


def test_clean_keeps_columns_of_any_name(spark):
    rng = random.Random(3)
    text = "\n".join(sentence(rng, 12) for _ in range(8))
    docs = spark.createDataFrame([(1, text + "\nno end", "a", "b", "c", "d", 5)], "doc_id long, text string, kept string, lost string, _keys string, `a.b` string, _c0 int")
    [r] = quality_rules.clean(docs).collect()
    assert quality_rules.clean(docs).columns == docs.columns and tuple(r) == (1, text, "a", "b", "c", "d", 5)


# --- sharding


def plain_level(values, cuts):
    return [0 if v is None else max(sum(c <= v for c in cuts) - 1, 0) for v in values]


def test_shards_equal_a_plain_order(spark):
    rng = random.Random(21)
    rows = [(i, sentence(rng, rng.randint(1, 30)), f"common_beginning_{rng.randrange(9)}" if i % 4 else None, "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(6)
    found = {r.doc_id: r for r in sharding.document_shards(docs).collect()}
    # levels of the source by cumulated rows, of the size by its quantiles, of the language all the same
    named, per, before, cuts = [r for r in rows if r[2]], Counter(r[2] for r in rows if r[2]), 0, {}
    for v in sorted(per):
        cuts.setdefault(before * 64 // len(named), v)
        before += per[v]
    assert sharding.string_cuts(docs, "source", 64) == sorted(cuts.values())
    source = plain_level([r[2] for r in rows], sorted(cuts.values()))
    sizes = sorted(len(r[1].encode()) + 16 for r in rows)
    quantiles = sorted({float(sizes[max(-(-k * len(sizes) // 64) - 1, 0)]) for k in range(1, 64)})
    size = [sum(q < len(r[1].encode()) + 16 for q in quantiles) for r in rows]
    curve = sharding.hilbert_index(np.array([source, [0] * len(rows), size]).T, sharding.BITS)
    order = sorted(range(len(rows)), key=lambda i: (curve[i], zlib.crc32(rows[i][1].encode()), rows[i][0]))
    want = {}
    for rank, i in enumerate(order):
        shard = rank * 40 // len(rows)
        want[i] = (shard, rank - -(-shard * len(rows) // 40))
    assert {i: (r.shard, r.slot) for i, r in found.items()} == want



def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1).max() == 1


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, "same" if i % 3 == 0 else sentence(rng, rng.randint(1, 40)), rng.choice(["src0", "src1", None]), rng.choice(["en", "de"]), "x") for i in range(1003)]
    rows += [(2000, None, None, None, "x"), (2000, None, None, None, "x"), (2001, "", "src0", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard string").repartition(5)
    found = sharding.document_shards(docs).collect()
    by_shard: dict[int, list] = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by_shard.values()]
    assert len(found) == len(rows) and set(by_shard) == set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "rows", None) for r in found)
    assert sharding.document_shards(docs.limit(0)).count() == 0
    few = sharding.document_shards(docs.limit(3)).collect()
    assert len({r.shard for r in few}) == 3
    table = sharding.pruning_table(sharding.document_shards(docs), ["size", "source"])
    assert table.count() == 40 and table.agg(F.sum("n_rows")).first()[0] == len(rows)
    # a range of sizes needs few of the shards
    assert table.where("min_size <= 40 and max_size >= 30").count() < 30


# --- near-duplicates


def plain_groups(rows):
    def lower(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, s) for i, s in sets.items() if s]
    for k, (i, s) in enumerate(items):
        for j, t in items[:k]:
            if 100 * len(s & t) >= 85 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    rng = random.Random(3)
    rows = []
    notice = " ".join(rng.choice(WORDS) for _ in range(60))
    for i in range(120):
        rows.append((i, sentence(rng, rng.randint(3, 90)) + (" " + notice if i % 2 else "")))
    base = [rng.choice(WORDS) for _ in range(150)]
    for i in range(200, 330):
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            p = rng.randrange(len(own))
            rng.choice([lambda o, p: o.__setitem__(p, rng.choice(WORDS) + "x"), lambda o, p: o.pop(p), lambda o, p: o.insert(p, "new")])(own, p)
        rows.append((i, " ".join(own)))
    rows += [(400 + i, rows[5][1].upper() if i % 2 else rows[5][1]) for i in range(60)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One  two"), (505, "one two three"), (506, " ".join(base * 400)), (507, "x " * 5000), (508, "x " * 300)]
    return rows


def test_groups_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, n string").repartition(4)
    want = plain_groups(rows)
    for long, many in ((32, 20_000), (4, 3), (1, 20_000)):
        found = {r.doc_id: r for r in minhash.groups(docs, minhash.Settings(long=long, many=many)).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == want, long
        assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_one_of_each_group_stays(spark):
    rows = near_rows()[:40] + [(3, near_rows()[3][1]), (3, near_rows()[3][1]), (None, near_rows()[4][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, a string")
    out = minhash.deduplicated(docs).collect()
    assert docs.columns == ["doc_id", "text", "a"] and sorted(r.doc_id for r in out if r.doc_id is not None) == list(range(40)) and sum(r.doc_id is None for r in out) == 2
    assert minhash.groups(docs.limit(0)).count() == 0 and minhash.deduplicated(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {r.node: r.least for r in minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == find(x) for x in parent)


# --- decontamination


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    S = decontamination.Settings()
    items = [(k, sentence(rng, rng.randint(8, 40))) for k in range(40)] + [(90, None), (91, "too short"), (None, sentence(rng, 20)), (5, sentence(rng, 22))]
    docs, planted = [], set()
    for i in range(160):
        own = sentence(rng, rng.randint(0, 120)).split()
        if i % 4 == 0:
            k, text = items[i % 40]
            part = text.split()
            for _ in range(rng.randint(0, S.edits(len(part)))):
                part[rng.randrange(len(part))] = "changed"
            p = rng.randint(0, len(own))
            own[p:p] = [w.upper() + "###" if i % 8 == 0 else w for w in part]
            planted.add((i, k))
        docs.append((i, " ".join(own) if i % 3 else "\n".join(own)))
    docs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[1][1]), (1002, items[1][1])]
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    want = {}
    for i, t in docs:
        for k, text in items:
            w = words(text)
            if k is not None and len(w) >= S.least_words:
                d, _ = decontamination.edit_distance(w, words(t), S.edits(len(w)))
                if d <= S.edits(len(w)):
                    want[i, k] = min(d, want.get((i, k), 99))
    assert planted <= set(want)
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 9):
        found = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(df, bench, decontamination.Settings(items_in_block=block)).collect()}
        assert set(found) <= set(want) and len(found) >= 0.98 * len(want)
        assert all(found[k] == want[k] for k in found)
    kept = decontamination.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, _ in docs if i is not None} - {i for i, _ in found})
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0


def edited(rng, own, kinds, n):
    """``own`` with n edits of these kinds, at places of the item itself."""
    places = {p: rng.choice(kinds) for p in rng.sample(range(len(own)), n)}
    return [x for p, w in enumerate(own) for x in {"insert": [w, f"new{rng.choice(WORDS)}"], "delete": [], "change": ["changed"], None: [w]}[places.get(p)]]


def test_all_edits_within_the_limit_are_found():
    rng = random.Random(11)
    S = decontamination.Settings(pairs_at_once=3000)
    items = [sentence(rng, n)[:-1].split() for n in (50, 59, 100, 150, 200) for _ in range(6)]
    held = decontamination.Items(list(range(len(items))), [" ".join(w) for w in items], S)
    for kinds in (["insert"], ["delete"], ["change"], ["insert", "delete", "change"]):
        texts = []
        for w in items:
            around = [sentence(rng, rng.randint(0, 60))[:-1].split() for _ in range(2)]
            texts.append(" ".join([*around[0], *edited(rng, w, kinds, S.edits(len(w))), *around[1]]))
        data, starts, ends, bounds = decontamination.word_spans(texts)
        [words] = decontamination.prefix_hashes(data, starts, ends, [None])
        found = {(t, i): d for t, i, d, _ in held.search(words, bounds)}
        assert [t for t in range(len(texts)) if (t, t) not in found] == [], kinds
        assert all(found[t, t] <= S.edits(len(w)) for t, w in enumerate(items))


def test_long_and_short_items_are_found():
    rng = random.Random(13)
    S = decontamination.Settings()
    items = [sentence(rng, n)[:-1].split() for n in (8, 9, 13, 20, 300, 400, 800) for _ in range(4)]
    held = decontamination.Items(list(range(len(items))), [" ".join(w) for w in items], S)
    sieve = decontamination.Sieve(S)
    sieve.add([" ".join(w) for w in items])
    for kinds in (["insert"], ["delete"], ["change"], ["insert", "delete", "change"]):
        texts = [" ".join([*sentence(rng, 40)[:-1].split(), *edited(rng, w, kinds, S.edits(len(w))), *sentence(rng, 30)[:-1].split()]) for w in items]
        data, starts, ends, bounds = decontamination.word_spans([*texts, "nothing of the kind", None])
        [words] = decontamination.prefix_hashes(data, starts, ends, [None])
        found = {(t, i): d for t, i, d, _ in held.search(words, bounds)}
        missed = [len(items[t]) for t in range(len(texts)) if (t, t) not in found]
        assert missed == [], kinds
        assert sieve.suspects(words, bounds).tolist() == [True] * len(texts) + [False, False]


def test_distances_equal_the_table():
    rng = random.Random(14)
    for _ in range(2000):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(2))
        row = list(range(len(a) + 1))
        best = (row[-1], 0)
        for j, w in enumerate(b, 1):
            last, row[0] = row[0], 0
            for i, own in enumerate(a, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (own != w))
            best = min(best, (row[-1], j))
        limit = rng.randint(0, 9)
        assert decontamination.edit_distance(a, b, limit) == (best if best[0] <= limit else (limit + 1, 0))


def test_very_long_texts(spark):
    rng = random.Random(15)
    item = sentence(rng, 30)
    long = " ".join([sentence(rng, 1000) for _ in range(150)] + [item])
    docs = spark.createDataFrame([(1, long, "s", "en"), (2, long + " x", "s", "en"), (3, item, "s", "en")], "doc_id long, text string, source string, lang string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.end_word) for r in decontamination.leaks(docs, bench).collect()) == [(1, 150_030), (2, 150_030), (3, 30)]
    assert {r.doc_id: r.component_id for r in minhash.groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.size for r in sharding.document_shards(docs).collect()} == {1: len(long) + 16, 2: len(long) + 18, 3: len(item) + 16}
    assert {r.doc_id for r in quality_rules.measured(docs).where("n_words > 150000").collect()} == {1, 2}


def test_items_of_any_script_are_found():
    items = ["天地玄黄，宇宙洪荒。日月盈昃，辰宿列张。", "12 + 7 = 19; 34 - 5 = 29; 8 * 9 = 72", "3 + 4 = 7", "吾輩は猫である", "one two three four’s “five” six—seven eight", "!?", "7"]
    held = decontamination.Items(list(range(len(items))), items, decontamination.Settings())
    texts = [f"before {i} after" for i in items] + ["before 天地玄黄宇宙洪荒日月盈昃辰宿列 after", "3 4", "7 of them", "One two, three four's five six - seven eight", "天地玄黄", None, ""]
    data, starts, ends, bounds = decontamination.word_spans(texts)
    [words] = decontamination.prefix_hashes(data, starts, ends, [None])
    found = {(t, i) for t, i, _, _ in held.search(words, bounds)}
    assert found == {(0, 0), (1, 1), (1, 6), (2, 2), (2, 6), (3, 3), (4, 4), (6, 6), (7, 0), (9, 6), (10, 4)}


def test_only_what_may_be_in_reach_is_embedded_and_verified(monkeypatch):
    rng = random.Random(16)
    first, item = (sentence(rng, 40)[:-1].split() for _ in range(2))
    # each of these but the last holds enough pairs of the item, and lacks more of its words than the limit
    item = [f"{w}{i}" for i, w in enumerate(item)]
    texts = [" ".join(["before"] * 30 + item[p : p + 27] + ["after"] * 30) for p in range(14)] + [" ".join(["before", *item, "after"])]
    held = decontamination.Items([0, 1], [" ".join(first), " ".join(item)], decontamination.Settings())
    verified, embedded = [], []
    distance, walks = decontamination.edit_distance, decontamination.walks
    monkeypatch.setattr(decontamination, "edit_distance", lambda *a: verified.append(a) or distance(*a))
    monkeypatch.setattr(decontamination, "walks", lambda windows, odd: embedded.extend(windows[:, 0].tolist()) or walks(windows, odd))
    data, starts, ends, bounds = decontamination.word_spans(texts)
    [words] = decontamination.prefix_hashes(data, starts, ends, [None])
    assert held.search(words, bounds) == [(14, 1, 0, 41)]
    assert len(verified) == 1
    data, starts, ends, _ = decontamination.word_spans([" ".join(first[:7] + item[:7])])
    assert embedded and set(embedded) <= set(decontamination.prefix_hashes(data, starts, ends, [None])[0].tolist())


def test_words_and_hashes_equal_a_plain_reading():
    rng = random.Random(17)
    alphabet = "abcXYZ019 _-.,\n\0\u00a0\u00adéßİΣ\u0301\u2019\ud800नमस्तेกาខ天地ー々ﾊ𠀀𝒜😀\U0010ffff"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "天", "a" * 24, "é" * 12 + "b", "x" * 200, "𠀀" * 40]
    kind = decontamination.kinds()
    for own in (texts, [t for t in texts if t and t.isascii()], [None, ""]):
        data, starts, ends, bounds = decontamination.word_spans(own)
        got = [[data[a:b].tobytes() for a, b in zip(starts[p:q], ends[p:q], strict=True)] for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
        want = []
        for t in own:
            words, last = [], 0
            for c in (t or "").lower():
                k = kind[ord(c)]
                if k == 1 and last == 1:
                    words[-1] += c
                elif k:
                    words.append(c)
                last = k
            want.append([w.encode("utf-8", "surrogatepass") for w in words])
        assert got == want
        whole, both = decontamination.prefix_hashes(data, starts, ends, [None]), decontamination.prefix_hashes(data, starts, ends, [3, None])
        assert whole[0].tolist() == both[1].tolist()


# --- extraction


def page(rng, host, k):
    text = [sentence(rng, rng.randint(3, 25)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in rng.sample(WORDS, rng.randint(3, 6)))
    body = "".join(f"<p>{t.replace('a', '&#97;', 1)}" + rng.choice(["</p>", ""]) for t in text[1:])
    inner = f"<h1>{text[0]}</h1><div class=share>Share this</div>{body}<div class='comments'><p>{sentence(rng, 5)}</div>"
    main = f"<main id=m>{inner}</main>" if host == "one" else f"<div class='post'><div class=body>{inner}</div></div>"
    html = f"<!DOCTYPE html><html><head><title>x</title><script>a('</p>')</script></head><body><nav><ul>{menu}</ul></nav><!-- {k} --><div class='ad banner'>{sentence(rng, 9)}</div>{main}<div class=credits>About this host and its people and more</div><footer>&copy; {host}</footer>"
    return html, " ".join(text)


def test_pages(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(60):
        host = "one" if k % 3 else "two"
        html, text = page(rng, host, k)
        rows.append((k, f"http://{host}.example/{k}", html, "x"))
        want[k] = text
    rows += [(100, None, None, "x"), (101, "http://one.example/e", "", "x"), (102, "nonsense", "<p>a &lt; b<br>c  d <b>e</b>f<p>g", "x"), (103, "http://lone.example/", "no markup < here", "x"), (0, rows[0][1], rows[0][2], "x")]
    want |= {100: "", 101: "", 102: "a < b c d ef g", 103: "no markup < here"}
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, main string").repartition(3)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_blocks_are_not_text(spark):
    rng = random.Random(7)
    rows = [(k, f"http://h.example/{k}", f"<body><article><p>Read this every day.</p><p>{sentence(rng, 30)}</p><p>{sentence(rng, 9)}</p></article></body>") for k in range(12)]
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert not any("every day" in r.text for r in found) and all(r.n_chars > 60 for r in found)


def test_raw_content_is_not_markup():
    for raw in ("<script>for(i=0;i<n;i++){s='a'}</script>", "<SCRIPT>if (a<b && c) x='\"'</Script >", "<style>a<b{}</style>", "<title>1 <a 'b</title>", "<script>'</scripts>'<!--</script>", "<svg><p>x</p></svg>"):
        assert html_extraction.parse_page(f"<body><p>one</p>{raw}<p>two</p></body>").texts == ["one", "two"], raw
    assert html_extraction.parse_page("<p>one</p><noscript><p>two</p>").texts == ["one", "two"]


def test_hostile_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<a " * 1_700_000, "<a " * 1_700_000 + ">", "<div>x" * 100_000, "<a \"'" * 300_001 + ">", "<div>" * 50_000 + "</x></p>" * 50_000, "<span>" * 50_000 + "<div>a</div>" * 50_000, "<ul>" + "<li><span>" * 60_000, "<!--" * 500_000, "<p><b>" * 60_000):
        html_extraction.parse_page(page)
    assert time.process_time() - began < 60
    deep = html_extraction.parse_page("<div>x" * 100_000)
    assert len(deep.paths) == len(deep.texts) == 100_000


def host_pages(rng, name, n, inside, start):
    """Pages of a host, ``inside`` making the body of a page's own paragraphs; and their texts."""
    rows, want = [], {}
    for k in range(n):
        own = [sentence(rng, rng.randint(12, 30)) for _ in range(rng.randint(2, 4))]
        rows.append((start + k, f"http://{name}.example/{k}", f"<html><body>{inside(own, k)}</body></html>"))
        want[start + k] = " ".join(own)
    return rows, want


def test_templates_tell_slots(spark):
    rng = random.Random(12)
    links = lambda: "".join(f"<a href='/{w}'>{w}</a> " for w in rng.sample(WORDS, 5))
    text = lambda own: "".join(f"<p>{x}</p>" for x in own)
    hosts = {
        # a menu whose name says nothing, and names that mislead
        "plain": lambda own, k: f"<div class=x9f>{links()}</div><div class=b2>{text(own)}</div>",
        "names": lambda own, k: f"<div class='nav'>{links()}</div><div class='post related'>{text(own)}</div>",
        "science": lambda own, k: f"<div class='social science'>{text(own)}<div class=related><p>{sentence(rng, 3)}</p></div></div>",
        "form": lambda own, k: f"<form action=x><div class=page>{text(own)}<footer>{sentence(rng, 4)}</footer></div></form>",
        # text outside of the article
        "article": lambda own, k: f"<div class=q1><p>{sentence(rng, 6)}</p></div><article>{text(own)}</article>",
        # two layouts, each with words of its own
        "two": lambda own, k: f"<div class=a><p>Words of the first kind of page.</p>{text(own)}</div>" if k % 2 else f"<section><h2>Second kind of page</h2>{text(own)}</section>",
        # links within an article are text
        "list": lambda own, k: f"<article><div class=t>{text(own[:-1])}</div><ul><li><a href=x>{own[-1]}</a></ul></article>",
    }
    rows, want = [], {}
    for i, (name, inside) in enumerate(hosts.items()):
        a, b = host_pages(rng, name, 16, inside, 100 * i)
        rows, want = rows + a, want | b
    # an odd page among the others changes nothing
    rows += [(900 + i, f"http://{name}.example/odd", f"<html><body><h3>Gone {i}</h3></body></html>") for i, name in enumerate(hosts)]
    want |= {900 + i: f"Gone {i}" for i in range(len(hosts))}
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    wrong = {k: (found[k], want[k]) for k in want if found[k] != want[k]}
    assert not wrong, list(wrong.items())[:3]


def test_slot_holds_all_text(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k in range(12):
        head, lead, body = sentence(rng, 5), sentence(rng, 12), [sentence(rng, 30) for _ in range(3)]
        inner = "".join(f"<p>{b}</p>" for b in body)
        rows.append((k, f"http://lead.example/{k}", f"<body><div class=x>About this host</div><article><h1>{head}</h1><p class=lead>{lead}</p><div class=body>{inner}</div></article></body>"))
        rows.append((100 + k, f"http://one.example/{k}", f"<body><div class=x>About this host</div><h1>{head}</h1><p>{body[0]}</p></body>"))
        want |= {k: " ".join([head, lead, *body]), 100 + k: f"{head} {body[0]}"}
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in found} == want


# --- the pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    item = sentence(rng, 20)
    docs = [(i, "\n".join(sentence(rng, 15) for _ in range(6)), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    docs = [(i, t if lang == "en" else t.replace("a", "ö"), lang, s) for i, t, lang, s in docs]
    docs += [(100, docs[4][1], "de", "s"), (101, docs[7][1] + "\nOne more line here.", "en", "s"), (102, docs[8][1] + "\n" + item, "de", "s"), (103, "short", "en", "s"), (104, None, None, None), (105, "\n".join(["Home | News | Sport | Video"] * 30), "en", "s")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    groups = plain_groups([(i, t) for i, t, _, _ in docs if i < 103])
    want = {i for i, (_, c) in groups.items() if i == c} - {102}
    assert {r.doc_id for r in rows} == want
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
