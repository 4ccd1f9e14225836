"""Spelling variants, token files and centroid clusters against brute force, the tokenizer's library, round trips and their edges."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connection
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnpike.llm import centroids, queries, simple8b, spelling, token_files

SF = "/root/testdata/sf0.001"
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, word string, n string, head int, key string, words int, shard string, block int, _row int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, first=0):
    """A table with columns whose names operators use inside."""
    return spark.createDataFrame([(None if t == "no id" else i + first, t, "w", "x", 1, "y", 2, "z", 3, 4) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ties."""
    long = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqr'[i % 8]}" for i in range(40_000))
    x = docs_of(spark, [None, "", "  \t\n ", long, long + " Ending", "No id", "no id", "ÀÉ K 😀 naïve x\xa0y ﬁn ée", "Colour colour colour color color COLOR", "x" * 30_000, "one<|endoftext|>two <|STARTOFTEXT|>"])
    return x.unionByName(x.where("doc_id in (1, 5, 8)")).unionByName(spark.createDataFrame([(None,) * 10], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 -----------------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    """Brute force over all pairs of words: {(word, form, root, n, n_near, form_n)}."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and near(x, w)] for w in words}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items()}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=7), max_size=60))
def test_merged_pairs_are_all_pairs_one_edit_apart(words):
    words = sorted(words)
    a, b = spelling.merged_pairs(words, np.zeros(len(words), int))
    assert sorted(tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


@pytest.mark.parametrize("most", [1, 5, 10**6])
def test_pairs_above_and_below_any_cut(spark, most):
    r = random.Random(most)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(500)})
    n = {w: r.choice([3, 4, 4, 9, 20]) for w in words}
    got = {(x.word, x.n_near, x.form, x.form_n) for x in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most).collect()}
    want = set()
    for w in words:
        close = [x for x in words if x != w and near(x, w)]
        if close:
            best = min(close, key=lambda x: (-n[x], x))
            want.add((w, len(close), best, n[best]))
    assert got == want


def test_spelling_variants_of_documents_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in queries.op11_spelling_variants(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == variants([(r.doc_id, r.text) for r in docs.collect()])


def test_spelling_variants_of_odd_rows(spark, odd, empty):
    got = [tuple(r) for r in spelling.spelling_groups(odd).collect()]
    assert len(got) == len(set(got)) and set(got) == variants([(r.doc_id, r.text) for r in odd.collect()])
    assert {r[0] for r in got} >= {"colour", "color"}
    out = spelling.spelling_groups(empty)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


def test_forms_lead_to_roots_over_several_steps(spark):
    words = ["abcde"] * 3 + ["abcdf"] * 6 + ["abcxf"] * 12 + ["abyxf"] * 24 + ["azyxf"] * 48 + ["tiewa"] * 6 + ["tiewb"] * 6 + ["tiewc"] * 3
    got = {r.word: (r.form, r.root) for r in spelling.spelling_groups(docs_of(spark, [" ".join(words)]), modulus=1 << 40).collect()}
    assert got["abcde"] == ("abcdf", "azyxf") and got["azyxf"] == (None, "azyxf") and got["tiewc"] == ("tiewa", "tiewa") and got["tiewb"] == (None, "tiewb")


# 12 -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.just(0), st.integers(0, 2**16), st.integers(0, 2**64 - 1), st.sampled_from([2**60 - 1, 2**60, 2**60 - 2])), max_size=300), max_size=5))
def test_simple8b_round_trip(documents):
    ids, sizes = np.array([x for d in documents for x in d], np.uint64), np.array([len(d) for d in documents], np.int64)
    words, n_words, escapes, n_escapes = simple8b.pack(ids, sizes)
    assert simple8b.unpack(words, escapes).tolist() == ids.tolist() and n_words.sum() == len(words) and n_escapes.sum() == len(escapes)
    a = b = 0
    for d, m, e in zip(documents, n_words.tolist(), n_escapes.tolist(), strict=True):
        assert simple8b.unpack(words[a : a + m], escapes[b : b + e]).tolist() == d
        a, b = a + m, b + e


def test_simple8b_words_of_many_documents_are_those_of_each():
    r = random.Random(4)
    documents = [[r.choice([0, 1, 7, 300, 49_000, 2**61]) if i % 3 else 0 for _ in range(r.choice([0, 1, 3, 50, 700]))] for i in range(120)]
    ids, sizes = np.array([x for d in documents for x in d], np.uint64), np.array([len(d) for d in documents], np.int64)
    words, n_words, escapes, _ = simple8b.pack(ids, sizes)
    alone = [simple8b.pack(np.array(d, np.uint64), np.array([len(d)])) for d in documents]
    assert words.tolist() == [w for x in alone for w in x[0].tolist()] and n_words.tolist() == [len(x[0]) for x in alone]
    assert simple8b.unpack(words, escapes).tolist() == ids.tolist()


def test_simple8b_words_by_hand():
    words, *_ = simple8b.pack(np.array([1] * 60 + [0] * 120 + [7] * 20, np.uint64), np.array([200]))
    assert [int(w) >> 60 for w in words] == [2, 1, 4] and int(words[0]) & (2**60 - 1) == 2**60 - 1


def digests(rows, tokenizer, end=2):
    """{(doc_id, start, n_tokens, crc)} by the library on whole texts; rows of one id in order of start are in ``rows``' order of codes, so only their multiset counts."""
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def check_tokens(df, model):
    tokenizer = Tokenizer.from_file(model)
    got = sorted((tuple(r) for r in token_files.token_digests(df, model, 2).collect()), key=lambda r: r[1])
    assert Counter((a, n, c) for a, _, n, c in got) == Counter(digests([(r.doc_id, r.text) for r in df.collect()], tokenizer))
    total = 0
    for _, start, n, _ in got:
        assert start == total
        total += n
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is None, x or 0))


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["it's we're I'M o'clock 'S ''s", "a\x1cb\x85c\xa0d", "½ ²3 ªº µ", "ÀÉÎ straße ÿ × ÷", "don’t é İ İstanbul ﬁ Σας ΣΑΣ", "a  b\tc\nd\r\ne f　g", "x<|startoftext|>y", "中文 テスト"] + [
        "".join(r.choice(" \n\tabTs'é😀<|.1²日́Ω\x1d\xa0") for _ in range(r.randint(0, 40))) for _ in range(n)
    ]


def test_token_files_hold_the_librarys_ids(spark, odd):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), docs_of(spark, odd_texts(600, 1)), odd):
        check_tokens(df, WORD_MODEL)


def test_token_files_of_a_tokenizer_whose_words_are_not_apart(spark, odd):
    check_tokens(odd, BYTE_MODEL)
    check_tokens(docs_of(spark, odd_texts(50, 2)), BYTE_MODEL)


def test_token_files_of_an_empty_table(spark, empty):
    out = token_files.token_digests(empty, WORD_MODEL, 2)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0


def encoder_of_words():
    with open(WORD_MODEL, encoding="utf-8") as f:
        raw = f.read()
    return token_files._Encoder(raw, True, [x["content"] for x in json.loads(raw).get("added_tokens", [])])


def held_ids(encoder, texts):
    found = encoder.ids(texts)
    out = []
    for ids, sizes in [found] if isinstance(found, tuple) else found:
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


def test_frequent_words_are_encoded_once_though_rare_ones_overflow(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 200)
    r, encoder, tokenizer, seen = random.Random(3), encoder_of_words(), Tokenizer.from_file(WORD_MODEL), Counter()
    apart = encoder._apart
    monkeypatch.setattr(encoder, "_apart", lambda words: (seen.update(words), apart(words))[1])
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(9))
    common = [word() for _ in range(20)]
    for _ in range(12):
        texts = [" ".join(common), " ".join(word() + "," for _ in range(40))]
        assert held_ids(encoder, texts) == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [seen[x] for x in common] == [1] * 20


@pytest.mark.parametrize(("cached", "at_once"), [(1, 1), (10, 5), (60, 1 << 18)])
def test_ids_are_the_librarys_while_words_are_forgotten(monkeypatch, cached, at_once):
    monkeypatch.setattr(token_files, "CACHED", cached)
    monkeypatch.setattr(token_files, "AT_ONCE", at_once, raising=False)
    encoder, tokenizer = encoder_of_words(), Tokenizer.from_file(WORD_MODEL)
    texts = odd_texts(300, 5) + ["", " ", "A" * 100 + ", b", "ab" * 5_000, "x\x00y\x01 \x1c \x7f, \xad\xad.", "it, it. it; ,,, , 5 5, #"] * 2
    for i in range(0, len(texts), 8):
        part = texts[i : i + 8]
        assert held_ids(encoder, part) == [tokenizer.encode(x, add_special_tokens=False).ids for x in part]
        assert max(map(len, encoder.known)) <= token_files.LONGEST


def test_signs_of_bytes_are_the_librarys():
    from tokenizers.pre_tokenizers import ByteLevel

    text = "".join(map(chr, [*range(0x20), *range(0x21, 0x100)])) + "日́😀"
    assert token_files._as_signs(text) == "".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text))


def test_blocks_decode_by_document_and_by_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(docs, WORD_MODEL, folder, 2, shards=8, block_bytes=10_000)
    tokenizer = Tokenizer.from_file(WORD_MODEL)
    want = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    read = {r.doc_id: r for r in token_files.read_tokens(spark, folder).collect()}
    assert {k: r.ids for k, r in read.items()} == want
    blocks = token_files.token_blocks(spark, folder).collect()
    assert len(blocks) > 20 and len({r.shard for r in blocks}) > 4
    for r in blocks:
        b = token_files.Block(bytes(r.payload))
        all_ids = b.ids().tolist()
        for i, doc in enumerate(b.doc_ids.tolist()):
            assert b.document(i).tolist() == want[doc]
        for i in range(len(b.offsets)):
            first, ids = b.run(i)
            assert all_ids[first : first + len(ids)] == ids.tolist()
        assert r.n_ids == len(all_ids)


# 13 -----------------------------------------------------------------------------------------------------------------


def clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, x) in zip(kept, found, strict=True) if x == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    per = Counter()
    for d, j in found:
        per[j] += d
    return Counter((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 20))
def test_the_nearest_is_the_nearest_of_all(seed, spread, dims):
    r = np.random.default_rng(seed)
    x, c = r.integers(-spread, spread, (60, dims)), r.integers(-spread, spread, (9, dims))
    number, distance = centroids.nearest(x, c, r.permutation(dims))
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_clusters_are_those_of_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Counter(map(tuple, queries.op13_centroid_clusters(spark, SF).collect()))
    assert got == clusters(rows)


def test_clusters_match_their_sql(spark):
    assert_same(queries.op13_centroid_clusters(spark, SF).toPandas(), queries.ORACLE_SQL["op13_centroid_clusters"], connection(SF))


def test_clusters_of_odd_vectors(spark):
    r = random.Random(1)
    rows = [(i, [float(np.float32(r.choice([-1.5, -0.01, 0.0, 0.7]))) for _ in range(64)]) for i in range(40)]
    rows += [(40, None), (41, []), (42, [0.5] * 63), (43, [0.5] * 65), (44, [0.5] * 63 + [None]), (45, [float("nan")] + [0.5] * 63), (46, [float("inf")] + [0.5] * 63), (None, [0.25] * 64), (3, rows[3][1]), (3, rows[4][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster string, n int, v int")
    assert Counter(map(tuple, centroids.cluster_report(df).collect())) == clusters(rows)
    few = df.where("vec_id < 5")
    assert Counter(map(tuple, centroids.cluster_report(few).collect())) == clusters([x for x in rows if x[0] is not None and x[0] < 5])
    for none in (df.where("vec_id = 41"), df.limit(0), df.where("vec_id is null")):
        out = centroids.cluster_report(none)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_a_component_without_exact_distances_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_report(df).collect()
    assert df.select(F.size("embedding")).first()[0] == 64
