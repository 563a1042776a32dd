"""Toxicity and language identification: held-out accuracy, odd inputs."""

import zlib

import numpy as np
import pytest

from contactloom.llm import language_id, toxicity

SYLLABLES = {"en": "the ing ed tion and er th re at on".split(), "de": "sch ung ein der ich keit ge ver zu au".split(), "fr": "eau que les oir ai ement è ou tre é".split()}


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = np.random.default_rng(5), [], []
    for i in range(900):
        lang = ("en", "de", "fr")[i % 3]
        own = words(rng, lang, int(rng.integers(5, 60)))
        toxic = int(i % 5 == 0)
        if toxic:
            own.insert(int(rng.integers(0, len(own) + 1)), ("grobian", "VILLAIN!", "méchant,")[int(rng.integers(0, 3))])
        docs.append((i, " ".join(own), lang if i % 7 else None, "s", "clash"))
        labels.append((i, 1, toxic))
    docs += [(9000, None, "en", "s", ""), (9001, "", None, "s", ""), (9002, "12 34 !!", "en", "s", ""), (None, "the and", None, None, ""), (9003, "schung eau " * 30_000, "de", "s", "")]
    labels += [(0, 1, 1), (0, 1, 1), (9100, 1, None), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    rows = toxicity.held_out_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right >= 0.95 * len(held)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[9000] == by_id[9001] == by_id[9002] < 0.5


def test_toxicity_without_labels(corpus, spark):
    docs, labels = corpus
    assert {r.score for r in toxicity.held_out_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.held_out_toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.held_out_toxicity(docs.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_batches(corpus):
    docs, labels = corpus
    from contactloom.llm.common import id_bucket

    model = toxicity.fit(docs, labels, id_bucket("doc_id", 5) != 0)
    texts = ["the villain and", "", "the", None, "and ing"]
    together = model.score(texts)
    assert together == pytest.approx(np.concatenate([model.score([t]) for t in texts]), abs=1e-6)
    # a word counts wherever it stands in a long text
    far = "the and " * 40_000
    assert model.score([far + " villain"])[0] > 0.5 > model.score([far])[0]


def test_language_on_held_out_rows(corpus):
    docs, _ = corpus
    rows = language_id.held_out_identified(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang_pred == ("en", "de", "fr")[r.doc_id % 3] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by_id[9000] == by_id[9001] == by_id[9002] == ("und", 0.0) and by_id[9003][0] in ("de", "fr")
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_labels(corpus):
    from pyspark.sql import functions as F

    docs, _ = corpus
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(bare).collect()} == {"und"}
    assert language_id.held_out_identified(docs.limit(0)).count() == 0
    assert language_id.identify(docs).columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]


def plain_form(text):
    """The runs of letters and marks, in lower case, between single spaces."""
    import unicodedata

    out = " "
    for c in (text or "").lower():
        if unicodedata.category(c)[0] in "LM":
            out += c
        elif out[-1] != " ":
            out += " "
    return out if out[-1] == " " else out + " "


def plain_features(text):
    """How often each feature occurs, window by window."""
    from collections import Counter

    form, found = plain_form(text), Counter()
    for size in range(1, language_id.ORDERS + 1):
        for at in range(len(form) - size + 1):
            codes = np.array([ord(c) for c in form[at : at + size]], dtype=np.uint32)
            numbers, places = language_id.features(codes, np.full(size, size), language_id.SLOT_BITS)
            found[int(numbers[(places == 0)][-1])] += 1
    return found


def test_language_model_equals_a_plain_count(spark):
    from pyspark.sql import functions as F

    texts = [("x", "Schung, the eau!"), ("x", "日本語の文 3 é́"), ("y", "aa ab... 7 ÀB"), ("y", "ab"), ("y", None), ("z", "!!"), (None, "none")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["x", "y", "z"] and np.exp(model.prior) == pytest.approx(np.array([2, 2, 1]) / 5)
    counts = np.full((len(model.weights), 3), 0.5)
    for lang, t in texts:
        if lang and t:
            for f, n in plain_features(t).items():
                counts[f, "xyz".index(lang)] += n
    width = 1 << language_id.SLOT_BITS
    plain = np.concatenate([np.log(part / part.sum(axis=0)) for part in counts.reshape(-1, width, 3)])
    assert model.weights == pytest.approx(plain, rel=1e-4)
    for t in ("Schung the", "ab aa", "日本", "", "語 語 x"):
        found, total = plain_features(t), np.zeros(3)
        for f, n in found.items():
            total += n * plain[f]
        size = sum(found.values())
        total = total * min(1, language_id.ORDERS * language_id.CERTAIN / max(size, 1)) + model.prior
        name, score = model.score([t])
        if size == 1:
            assert name == ["und"] and score[0] == 0
        else:
            assert name == [model.languages[int(total.argmax())]] and score[0] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-3)


def test_pieces_of_long_texts_count_like_the_whole():
    from collections import Counter

    texts = ["ab, cd " * 40 + "1234567890" * 9 + "é é", "", "12" * 70, "xyz", None, "a" * 200, ". a" * 99 + "b"]
    for budget in (7, 30, 1 << 18):
        found = [Counter() for _ in texts]
        for text, feature, n in language_id.counted(texts, language_id.SLOT_BITS, budget):
            for t, f, k in zip(text.tolist(), feature.tolist(), n.tolist(), strict=True):
                found[t][f] += k
        assert found == [plain_features(t) for t in texts], budget


def test_a_column_named_like_a_result_is_kept(spark):
    docs = spark.createDataFrame([(i, f"the ing and {i}" if i % 2 else "die ung und", "en" if i % 2 else "de", "mine", "mine") for i in range(20)] + [(30, "7", "en", "mine", "mine")], "doc_id long, text string, lang string, score string, _found string")
    rows = language_id.of_known_language(docs, 0.5).collect()
    assert len(rows) == 20 and all((r.score, r._found) == ("mine", "mine") for r in rows)


def plain_logit(net, text):
    """The network word by word and window by window."""
    import re

    words = [w.encode() for w in re.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower())]
    vectors = []
    for w in words:
        numbers, _ = toxicity.word_numbers([w.decode()])
        vectors.append(sum(net.table[view][numbers[view][0]] for view in range(len(toxicity.VIEWS))))
    total, column = float(net.shift), 0
    for kernel in net.kernels:
        width, _, filters = kernel.shape
        for f in range(filters):
            best = -np.inf
            for at in range(len(vectors) + 1):
                best = max(best, sum(float(vectors[at + j] @ kernel[j, :, f]) for j in range(width) if at + j < len(vectors)))
            total += max(best + float(net.bias[column]), 0) * float(net.out[column])
            column += 1
    return total


def test_scores_equal_a_plain_forward_pass(corpus):
    docs, labels = corpus
    from contactloom.llm.common import id_bucket

    net = toxicity.fit(docs, labels, id_bucket("doc_id", 5) != 0).net
    for t in ("the villain and", "", None, "GROBIAN, und 7 méchant", "re at on " * 20):
        raw = plain_logit(net, t) * net.scale + net.offset
        assert net.score([t])[0] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-5)


def test_the_training_sample_is_bounded(corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    few = toxicity.fit(docs, labels, F.lit(True), toxicity.Settings(characters=2000, epochs=1))
    again = toxicity.fit(docs.repartition(5), labels.repartition(2), F.lit(True), toxicity.Settings(characters=2000, epochs=1))
    assert few.net is not None and few.score(["the villain"]) == pytest.approx(again.score(["the villain"]))


def test_every_labelled_row_is_learned_from(corpus):
    """Shards far smaller than the table give a network of all rows."""
    docs, labels = corpus
    from contactloom.llm.common import id_bucket

    model = toxicity.fit(docs, labels, id_bucket("doc_id", 5) != 0, toxicity.Settings(characters=30_000))
    rows = [r for r in docs.where("doc_id < 900").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    predicted = model.score([r.text for r in rows]) >= 0.5
    assert sum(p == (r.doc_id % 5 == 0) for p, r in zip(predicted, rows, strict=True)) >= 0.95 * len(rows)
    few = toxicity._shards(docs, labels.where("doc_id < 900").selectExpr("doc_id", "toxic").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic"), 900, toxicity.Settings(characters=3000)).collect()
    assert len(few) > 20 and sum(len(r.labels) for r in few) == 900


def test_shards_are_stored_and_handed_on_in_small_rows(spark):
    """The JVM's buffers are as large as its largest row; a shard still reaches one task, whole and in order."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(words(rng, "en", 1500)), "en" if i % 3 else None) for i in range(400)] + [(400, "the ing " * 60_000, "de"), (401, None, "de")], "doc_id long, text string, lang string").repartition(3)
    marked = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) toxic")
    shards = toxicity._shards(docs, marked, 402, toxicity.Settings(characters=1_000_000))
    rows = shards.collect()
    assert max(len(r.numbers) for r in rows if len(r.labels) > 1) < 1 << 20
    assert sum(len(r.labels) for r in rows) == 402

    def seen(own):
        yield [(s.number, [t.shape[1] for t in s.texts], s.labels.tolist(), s.langs, np.random.default_rng(1).bytes(2 << 20)) for s in own]

    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    found = []
    for size in (before, "10k"):
        spark.conf.set(key, size)
        try:
            found.append(sorted(x for part in toxicity._passed(shards, seen) for x in part))
        finally:
            spark.conf.set(key, before)
    assert found[0] == found[1] and len({x[0] for x in found[0]}) == len(found[0]) > 2
    assert all(len(x[1]) == len(x[2]) == len(x[3]) for x in found[0]) and sum(len(x[1]) for x in found[0]) == 402
    sizes = {r.doc_id: len(r.text.split()) if r.text else 0 for r in docs.collect()}
    assert sorted(n for x in found[0] for n in x[1]) == sorted(sizes.values())
