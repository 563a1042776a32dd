"""Token ids, counts, packing and files against the tokenizers library."""

import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contactloom.llm import packing, token_counts, token_files
from contactloom.llm.tokens import Encoder, library, stretches

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello there, world.  It's\n\nfine ", "a<|endoftext|> b", "x\x1cy z", "one two " * 3000, "ÀÉ é́ ñ.", "\0 \0", "Hello there, world.  It's\n\nfine "]
SIGNS = st.text(alphabet=st.sampled_from(list("aAbé .,'!\n\t\x1c ́#9<|>\0日ß")), max_size=40)


@pytest.fixture
def docs(spark):
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int").repartition(3)


def ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@given(texts=st.lists(SIGNS, max_size=6))
@settings(max_examples=150, deadline=None)
def test_memoised_ids_are_the_librarys(path, texts):
    found, sizes = Encoder(path).encode(texts)
    assert [x.tolist() for x in np.split(found, np.cumsum(sizes)[:-1])] == [ids(path, t) for t in texts] if texts else len(found) == 0
    assert token_counts.Counter(path, frozenset()).count(texts).tolist() == [len(ids(path, t)) for t in texts]


def test_a_full_table_is_set_aside(monkeypatch):
    monkeypatch.setattr("contactloom.llm.tokens.FULL", 3)
    e, c = Encoder(BYTE), token_counts.Counter(BYTE, frozenset(["a"]))
    for t in ("a b c d e", "a b c", "f g h i", "a", "d xylophones", "a d", "f g", "c xylophones b"):
        assert e.encode([t])[0].tolist() == ids(BYTE, t) and c.count([t]).tolist() == [len(ids(BYTE, t))]
        assert len(e.known) <= 8


WIDE = st.text(alphabet=st.sampled_from(list("aZé×÷ÿÀß .,|'#9\n\t\x85\xa0\u1680\u2000\u200a\u200b\u2028\u202f\u205f\u2060\u3000\u3001日😀¢â")), max_size=20)


@given(st.lists(st.one_of(st.none(), WIDE), max_size=5))
@settings(max_examples=500, deadline=None)
def test_texts_are_cut_where_the_pattern_cuts(texts):
    pattern = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,;:!?#$%&*|]|$)|\s*\S+|\s+")
    codes, distinct = stretches(texts)
    parts = np.split(codes, np.flatnonzero(codes == 0))[1:]
    assert len(set(distinct)) == len(distinct) and len(parts) == len(texts) + 1 and len(parts[-1]) == 1
    assert [[distinct[k - 1] for k in p[1:].tolist()] for p in parts[:-1]] == [pattern.findall(t or "") for t in texts]


class Watched(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __iter__(self):
        raise AssertionError("the whole table is read")


@pytest.mark.parametrize("kind", [Encoder, lambda path: token_counts.Counter(path, frozenset())])
def test_tables_are_asked_once_for_each_stretch_of_a_batch(kind):
    e = kind(BYTE)
    read = e.count if isinstance(e, token_counts.Counter) else e.encode
    read(["aside words"])
    e.aside = (Watched(e.known), e.ids, e.ends)
    e._begin()
    e.known = Watched()
    read(["one two words. " * 3000, "one two words. " * 3000])
    assert 0 < e.known.asked <= 10 and "one" in e.known and " words" in e.known


def test_the_model_alone_merges_plain_stretches(tmp_path):
    import json

    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZÀÉÖØßàéöøÿ") + ["th", "ing", "er", "ción", "tion"] * 5
    words = [" " + "".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3000)]
    e = Encoder(BYTE)
    assert e.merger is not None and Encoder(WORD).merger is None
    e.encode(words)
    assert [e.ids[e.ends[k] : e.ends[k + 1]].tolist() for k in map(e.known.get, words)] == [ids(BYTE, w) for w in words]
    file = json.loads(open(BYTE).read())
    for key, value in (("added_tokens", [file["added_tokens"][0] | {"content": "tion"}]), ("model", file["model"] | {"ignore_merges": True}), ("model", file["model"] | {"vocab": file["model"]["vocab"] | {"eĠt": 60_000}})):
        path = str(tmp_path / "other.json")
        open(path, "w").write(json.dumps(file | {key: value}))
        other = Encoder.__new__(Encoder)
        other.tokenizer, other.stretches = Tokenizer.from_file(path), True
        assert other._merger() is None


def test_proven_strings_are_single_tokens():
    proven = token_counts.proven_strings(BYTE)
    assert len(proven) > 40_000 and " the" in proven
    assert all(len(ids(BYTE, s)) == 1 for s in sorted(proven)[::500])


def test_counts(spark, docs):
    found = {r.doc_id: r for r in token_counts.token_counts(docs, BYTE, 1024).collect()}
    for i, t in enumerate(TEXTS):
        r = found[i if i != 4 else None]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), len(ids(BYTE, t)), len(ids(BYTE, t)) > 1024)
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0
    from sentencepiece import SentencePieceProcessor

    model = P.path("piece_bpe_32k.model")
    pieces = SentencePieceProcessor(model_file=model)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, model).collect()} == {(i if i != 4 else None): len(pieces.encode(t or "")) for i, t in enumerate(TEXTS)}


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=400), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_words_round_trip(values, zeros):
    x = np.array([0] * (zeros * 130) + values, dtype=np.uint64)
    words, groups, escapes = token_files.encode_words(x)
    assert (token_files.decode_words(words, groups, escapes, len(x)) == x).all()


def test_words_over_several_groups():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50_000, 30_000).astype(np.uint64)
    x[::911] = 1 << 61
    words, groups, escapes = token_files.encode_words(x)
    assert len(groups) == 4 and len(escapes) == len(x[::911]) and len(words) < len(x) // 2
    assert (token_files.decode_words(words, groups, escapes, len(x)) == x).all()
    block = token_files.write_block(np.array([5, 9]), np.array([10_000, 20_000]), x)
    names, lengths, back = token_files.read_block(block)
    assert names.tolist() == [5, 9] and lengths.tolist() == [10_000, 20_000] and (back == x).all()


def test_files_read_back(spark, docs):
    files = token_files.write_token_files(docs, BYTE)
    found = token_files.read_token_files(files).collect()
    order = sorted(range(len(TEXTS)), key=lambda i: (i != 4, i))
    start = 0
    by_id = {r.doc_id: r for r in found}
    for i in order:
        own = np.array(ids(BYTE, TEXTS[i]) + [0], dtype="<u4")
        r = by_id[i if i != 4 else None]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert {r.doc_id: r.ids for r in token_files.read_token_files(files, digest=False).collect()}[3] == [*ids(BYTE, TEXTS[3]), 0]
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), BYTE)).count() == 0


def check_pieces(rows, want, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = want[d][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d]) and r.ids_crc32 == zlib.crc32(own.tobytes())
            at += r.length
        assert at == len(want[d])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_pieces_hold_every_id_once(spark, docs):
    want = {(i if i != 4 else None): np.array(ids(WORD, t) + [2], dtype="<u4") for i, t in enumerate(TEXTS)}
    assert check_pieces(packing.pack_documents(docs, WORD).collect(), want, 4096) == 0
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_many_documents_waste_little():
    rng = np.random.default_rng(2)
    limits = packing.Limits(tokens=512, segments=20, loss_tokens=400, pool=64)
    packer, total = packing.Packer(limits, cut=True), 0
    for k, n in enumerate((rng.pareto(1.2, 3000) * 40 + 1).astype(int).tolist()):
        packer.add(k, n, 1, n // 2)
        total += n
    packer.finish()
    pieces = packer.taken()
    used: dict[int, list[int]] = {}
    for _, _, n, s, _, _ in pieces:
        used.setdefault(s, []).append(n)
    assert sum(map(sum, used.values())) == total and max(map(sum, used.values())) <= 512 and max(map(len, used.values())) <= 20


def test_examples_under_all_limits(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", int(a), int(b), int(a * rng.random())) for i, (a, b) in enumerate(zip(rng.integers(1, 900, 800), rng.integers(1, 6, 800), strict=True))]
    rows += [("long", 5000, 1, 10), ("none", 0, 1, 0), ("null", 10, None, None)]
    df = spark.createDataFrame(rows, "id string, n_tokens long, n_segments long, n_loss long").coalesce(1)
    limits = packing.Limits(tokens=1000, segments=8, loss_tokens=500)
    found = packing.pack_examples(df, limits).collect()
    demand = {r[0]: r[1:] for r in rows}
    assert sorted(r.id for r in found) == sorted(k for k in demand if k != "none")
    bins: dict[int, list] = {}
    for r in found:
        assert r.oversize == (r.id == "long" or demand[r.id][0] > 1000 or (demand[r.id][2] or 0) > 500)
        if not r.oversize:
            bins.setdefault(r.sequence_id, []).append(demand[r.id])
    for own in bins.values():
        assert sum(x[0] for x in own) <= 1000 and sum(x[1] or 0 for x in own) <= 8 and sum(x[2] or 0 for x in own) <= 500
    lower = max(sum(x[k] or 0 for b in bins.values() for x in b) / m for k, m in ((0, 1000), (1, 8), (2, 500)))
    assert len(bins) <= 1.15 * lower + 1


def test_tiny_documents_fill_sequences(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(6000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(docs, WORD).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(used.values()) == 18_000 and sum(n >= 4095 for n in used.values()) == 4


def test_conversations_under_three_limits(spark):
    rng = np.random.default_rng(3)
    turns = [(c, k, ("user", "assistant")[k % 2], "word " * int(rng.integers(0, 60))) for c in range(300) for k in range(int(rng.integers(1, 9)))]
    turns += [(900, 0, None, None), (901, 0, "assistant", ""), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(4)
    examples = packing.conversation_examples(frame, WORD)
    want = {}
    for c, _, role, text in turns:
        n = len(ids(WORD, text)) + 1
        t, k, loss = want.get(c, (0, 0, 0))
        want[c] = (t + n, k + 1, loss + n * (role == "assistant"))
    demand = {r.id: (r.n_tokens, r.n_segments, r.n_loss) for r in examples.collect()}
    assert demand == {None if c is None else str(c): d for c, d in want.items()}
    for limits in (packing.Limits(1024, 24, 400), packing.Limits(512, 200, 4096), packing.Limits(4096, 10, 4096)):
        rows = packing.pack_examples(examples.coalesce(1), limits).collect()
        assert sorted(str(r.id) for r in rows) == sorted(map(str, demand))
        used: dict = {}
        for r in rows:
            d = demand[r.id]
            u = used.setdefault(r.sequence_id, [0, 0, 0])
            assert r.offset == u[0] and r.length == d[0] and not r.oversize
            used[r.sequence_id] = [x + y for x, y in zip(u, d, strict=True)]
        capacity = (limits.tokens, limits.segments, limits.loss_tokens)
        assert all(x <= y for u in used.values() for x, y in zip(u, capacity, strict=True))
        # no packing needs fewer sequences than the fullest of the three dimensions
        least = max(-(-sum(d[k] for d in demand.values()) // capacity[k]) for k in range(3))
        assert len(used) <= 1.15 * least + 1, limits


def test_unknown_shapes_are_not_cut(tmp_path):
    import json

    file = json.loads(open(BYTE).read())
    file["pre_tokenizer"] = {"type": "Split", "pattern": {"String": "x y"}, "behavior": "Isolated", "invert": False}
    path = str(tmp_path / "other.json")
    open(path, "w").write(json.dumps(file))
    encoder, counter = Encoder(path), token_counts.Counter(path, frozenset())
    assert not encoder.stretches and Encoder(BYTE).stretches and Encoder(WORD).stretches
    texts = ["a x yb x y", "one two", None, ""]
    found, sizes = encoder.encode(texts)
    assert [x.tolist() for x in np.split(found, np.cumsum(sizes)[:-1])] == [ids(path, t) for t in texts]
    assert counter.count(texts).tolist() == [len(ids(path, t)) for t in texts]
