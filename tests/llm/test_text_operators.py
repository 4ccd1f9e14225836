"""The text operators against brute force, exact round trips, held-out accuracy and their edges."""

import hashlib
import json
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connection
from pyspark.sql import functions as F

from tarnpike.llm import decontamination, jaccard, language_model, licenses, media, piece_codec, piece_model, quality, queries, segments, sharding, token_counts, url_filters, words

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, rep int, row string, bucket int, score string, _dropped long, slot string, language string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def docs_of(spark, texts, first=0):
    """A table with columns whose names operators use inside."""
    return spark.createDataFrame([(None if t == "no id" else i + first, t, "x", 1, "y", 2, "z", 3, "s", "en") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ties."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    x = docs_of(spark, [None, "", "  \t\n ", long, long + " end", "one two three four five six", "One  two\tthree four\nfive six", "a", "A", "no id", "ÀÉ K 😀 naïve\u2028x\xa0y"])
    return x.unionByName(x.where("doc_id in (1, 5)")).unionByName(spark.createDataFrame([(None,) * 10], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# words --------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85aAbBzZ09É😀-_~\x7f\x00\xa0\u3000")), max_size=20)), max_size=6))
def test_words_are_those_of_the_patterns(texts_):
    data, offsets = words.texts(pa.array(texts_, pa.string()))
    for pattern, mask in ((spaced, words.SPACED), (alnum, words.ALNUM)):
        rows, starts, lengths, h = words.words(data, offsets, mask)
        found = [(int(r), bytes(data[s : s + n]).decode().translate(LOWER)) for r, s, n in zip(rows, starts, lengths, strict=True)]
        want = [(i, w) for i, t in enumerate(texts_) for w in pattern(t)]
        assert found == want
        assert len({w for _, w in want}) == len(set(h.tolist()))


# 1 and 8 ------------------------------------------------------------------------------------------------------------


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["", " ", "  ", "a ", " a", "\n", " \n", "a \n b", "x▁y", "▁", "<s>hi</s>", "\r\n\r\n", "a  b   c"] + ["".join(r.choice(" \nab▁é😀<0xA>.日") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_token_counts_are_the_librarys(spark, documents, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (documents, docs_of(spark, odd_texts(400, 1)), odd):
        got = Counter(map(tuple, token_counts.token_counts(df, MODEL).collect()))
        want = Counter((r.doc_id, len((r.text or "").encode()), n, n > 4096) for r in df.collect() for n in [len(sp.encode(r.text or ""))])
        assert got == want


def test_token_counts_without_a_frequent_table(spark, documents, empty, monkeypatch):
    want = sorted(map(tuple, token_counts.token_counts(documents, MODEL).collect()))
    monkeypatch.setattr(token_counts, "FREQUENT", 1)
    monkeypatch.setattr(token_counts, "SLICE", 64)
    assert sorted(map(tuple, token_counts.token_counts(documents, MODEL).collect())) == want
    assert token_counts.token_counts(empty, MODEL).collect() == []


def unigram_twin(raw):
    """The same pieces as a Unigram model file with the scores that the codec uses."""
    model = piece_model.read_model(raw)

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for p, s, k in zip(model.pieces, piece_codec._scores(model), model.kinds, strict=True):
        x = b"\x0a" + number(len(p.encode())) + p.encode() + b"\x15" + struct.pack("<f", float(s)) + b"\x18" + number(k)
        out += b"\x0a" + number(len(x)) + x
    for n, v in piece_model._fields(raw):
        if n == 2:
            v = v.replace(b"\x18\x02 \x80", b"\x18\x01 \x80")
        if n in (2, 3):
            out += bytes([n << 3 | 2]) + number(len(v)) + v
    return out


def test_codec_is_the_librarys_unigram(spark, documents):
    with open(MODEL, "rb") as f:
        raw = f.read()
    twin = unigram_twin(raw)
    sp = sentencepiece.SentencePieceProcessor(model_proto=twin)
    codec = piece_codec.Codec(piece_codec.build_trie(piece_model.read_model(twin)))
    assert piece_model.read_model(twin).unigram
    texts_ = [r.text for r in documents.limit(60).collect()] + odd_texts(400, 2)
    same = 0
    for t, ids in zip(texts_, codec.encode_all(texts_), strict=True):
        want = sp.encode(t)
        same += ids == want
        cost = lambda x: sum(float(codec.trie.scores[i]) for i in x)
        assert len(ids) == len(want) and cost(ids) == pytest.approx(cost(want), rel=1e-5, abs=1e-3)  # ties aside
        assert codec.decode(ids) == t.replace("▁", " ") == sp.decode(want)
    assert same > 0.97 * len(texts_)


def test_codec_tables(spark, odd, empty):
    ids = piece_codec.encode_pieces(odd, MODEL)
    back = piece_codec.decode_pieces(ids, MODEL)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    digests = piece_codec.piece_digests(odd, MODEL).collect()
    flat = Counter((r.doc_id, len(r.ids), hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()) for r in ids.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in digests) == flat and all(r.round_trip for r in digests)
    assert piece_codec.encode_pieces(empty, MODEL).collect() == piece_codec.decode_pieces(ids.limit(0), MODEL).collect() == []


def test_ids_that_are_no_pieces(spark):
    x = spark.createDataFrame([(1, [10**6, None, -1, 3]), (2, None), (None, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in piece_codec.decode_pieces(x, MODEL).collect()}
    assert got[1].count("\u2047") == 3 and got[2] == got[None] == ""


def test_segments_make_up_the_text():
    for t in odd_texts(500, 3):
        joined = "".join(x if x[:1] == "\n" else " " + x for x in segments.segments(t))
        assert joined == (" " + t.replace("▁", " ") if t else "")


# 2 ------------------------------------------------------------------------------------------------------------------


def rule_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    best = None
    for rule, verdict in url_filters.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://Example.ORG/es/x?y=/z#q", "http://org", "http://org/", "http://notorg/", "https://a.com/fr/x#y", "https://a.com/de/", "x://example.org/en/12?", "x://u@example.org:80/en/1", "a://b://c.org/d", "http://É.org/È"]
    pages = spark.createDataFrame([(i, u, "a", 1) for i, u in enumerate(urls)] + [(None, "http://x.org/", "a", 1), (4, urls[4], "a", 1)], "page_id long, url string, suffix string, norm int")
    pages = pages.unionByName(spark.read.parquet(f"{SF}/pages.parquet").select((F.col("page_id") + 1000).alias("page_id"), "url", F.lit(None).cast("string").alias("suffix"), F.lit(0).alias("norm")))
    got = url_filters.judge_urls(pages)
    source = sorted(pages.select("page_id", "url").collect(), key=str)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.page_id, []).append(r)
    for r in source:
        host, path, rule = rule_by_hand(r.url)
        for g in by_id[r.page_id]:
            assert (g.host, g.path) == (host, path)
            assert g.rule == (rule and rule[0]) and g.verdict in ("allow", "block")
            assert g.verdict == rule[1] if rule else g.score is not None
    assert sum(map(len, by_id.values())) == len(source)
    assert len(by_id[4]) == 2


def test_trees_learn_lexical_urls(spark):
    r = random.Random(4)
    good = [f"http://{r.choice('abcde')}site.example/{r.choice(['news', 'about', 'blog'])}/{r.choice('xyz')}" for _ in range(400)]
    bad = [f"http://{r.randint(10**6, 10**9)}-{r.randint(100, 999)}.example/{r.randint(1, 10**9)}?id={r.randint(1, 99)}&s={r.random()}" for _ in range(400)]
    rules = [("good.test/", "allow"), ("bad.test/", "block")]
    labelled = [u.replace(".example", ".good.test") for u in good[:200]] + [u.replace(".example", ".bad.test") for u in bad[:200]]
    rows = [(i, u) for i, u in enumerate(labelled + good[200:] + bad[200:])]
    got = {x.page_id: x for x in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    right = [got[i].verdict == ("allow" if i < 600 else "block") for i in range(400, 800)]
    assert np.mean(right) > 0.95


def test_urls_without_examples(spark):
    x = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge_urls(x).collect()] == ["allow"]
    assert url_filters.judge_urls(x.limit(0)).collect() == []


# 3 ------------------------------------------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    names = [f"n{i}" for i in range(20)]
    a, b = sharding.lookup_table(names), sharding.lookup_table(names[:-1], sharding.table_size(20))
    counts = Counter(a)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 20
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 19) / len(a)
    assert moved < 0.1
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)


def test_assign_shards(spark, odd, empty, tmp_path):
    out = sharding.assign_shards(odd, "doc_id", 7)
    assert set(out.columns) == set(odd.columns) | {"shard"}
    table = sharding.lookup_table([f"shard-{i}" for i in range(7)])
    for r in out.collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % len(table)
        assert (r.slot, r.shard) == (slot, table[slot])
    assert out.count() == odd.count() and sharding.assign_shards(empty, "doc_id", 3).count() == 0
    sharding.write_shards(odd.select("doc_id", "text"), str(tmp_path / "out"), "doc_id", 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


# 4 ------------------------------------------------------------------------------------------------------------------


def components_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = spaced(t)
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets.setdefault(i, s)
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(seed, groups=6, copies=14, size=60):
    """Groups whose members link with some of each other and not with others, and texts that share a passage only."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{r.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(size)] = f"e{r.randint(0, 10**6)}"
            out.append(" ".join(w[: size - r.choice([0, 0, 0, 4, 9])]))
        out.append(" ".join(passage + base[:20]))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block, hot, spots", [(192, 100_000, 64), (5, 100, 1)])
def test_jaccard_is_exact(spark, documents, monkeypatch, block, hot, spots):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "SPOTS", spots)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    made = [(i + 10_000, t) for i, t in enumerate(near_copies(block))] + [(20_000 + i, t) for i, t in enumerate([None, "", " ", "a b", "A  b", "a b c", "a b c d e", "a b c d e f", "b", "B"])]
    df = spark.createDataFrame(rows + made, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == components_by_hand(rows + made)


def test_jaccard_edges(spark, odd, empty):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[0] == by[1] - {(0, 1)} | {(0, 0)} and by[2] == {(0, 2)}
    assert {c for _, c in by[4]} == {3} and by[5] == by[6] == {(2, 5)} and by[7] == by[8] == {(1, 7)}
    assert all(c is None for _, c in by[None])
    assert jaccard.jaccard_components(empty).collect() == []
    kept = jaccard.near_duplicates_dropped(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter({0: 1, 1: 2, 2: 1, 3: 1, 5: 2, 7: 1, 10: 1, None: 2})
    two = docs_of(spark, ["a b c d e f g"]).unionByName(docs_of(spark, ["q r s t u v w"])).unionByName(docs_of(spark, ["q r s t u v w"], 7))
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(two).collect()} == {(0, 0), (7, 0)}


# 5 ------------------------------------------------------------------------------------------------------------------


def test_language_model(spark, documents):
    rows = {r.doc_id: r for r in language_model.language_model_scores(documents).collect()}
    texts_ = {r.doc_id: [w.encode() for w in spaced(r.text)] + [None] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts_}
    counts = Counter(w for i, t in texts_.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts_.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0
    total = lambda k, h: sum(getattr(rows[i], k) for i in rows if held[i] == h)
    assert total("score", True) > total("base_score", True) and total("score", False) > total("base_score", False)


def _sampled(docs, buckets=32, roots=8):
    texts_ = docs.where("crc32(cast(doc_id as string)) % 7 <> 2").select(F.coalesce("text", F.lit("")).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(language_model._common(docs.select("text"), 1 << 40))
    return language_model.sample_model(texts_.mapInArrow(language_model._counted(buckets, common), language_model._MESSAGE), roots, common), common.value


@pytest.fixture(scope="module")
def seatings(documents):
    """The sampled model as plain dictionaries: per counted sweep customers and tables by context and word, and the root's."""
    model, common = _sampled(documents)
    unpack, first, n = language_model._unpack, language_model.BURN_IN, language_model.SWEEPS - language_model.BURN_IN
    shared, words_, state = language_model.SHARED, language_model.WORDS, language_model.STATE
    pairs, root, often = [{} for _ in range(n)], [{} for _ in range(n)], {}
    got = {(r.key, r.sender): unpack(r.payload)[0] for r in model.buckets.where(F.col("kind") == state).collect()}
    for m in model.buckets.where(F.col("kind") == shared).collect():
        r = language_model.Restaurants.unpacked(m.payload, common)
        for s in range(n):
            seats, at = got[m.key, first + s], 0
            for u, w, c in zip(r.contexts[r.context].tolist(), r.words[r.word].tolist(), r.count.tolist()):
                pairs[s].setdefault(u, {})[w] = (c, int(seats[at]) if c > 1 else 1)
                at += c > 1
    got = {(r.key, r.sender): unpack(r.payload)[1] for r in model.root.where(F.col("kind") == state).collect()}
    for m in model.root.where(F.col("kind") == words_).collect():
        *kinds, times = unpack(m.payload)
        kinds = language_model._decoded(kinds, common).tolist()
        often.update(zip(kinds, times.tolist()))
        for s in range(n):
            root[s].update(zip(kinds, got[m.key, first + s].tolist()))
    return model.setting, pairs, root, often


def test_language_model_by_hand(spark, documents, seatings):
    setting, pairs, root, often = seatings
    levels, d = setting.counted, setting.discount

    def probability(u, w):
        p = 0.0
        for level, below, shares in zip(levels, pairs, root, strict=True):
            own = below.get(u, {})
            customers, tables = sum(c for c, _ in own.values()), sum(t for _, t in own.values())
            base = (shares.get(w, 0.0) + (level.root_strength + setting.root_discount * level.tables) / (setting.kinds + 1)) / (level.root_strength + level.customers)
            c, t = own.get(w, (0, 0))
            p += (c - d * t + (level.strength + d * tables) * base) / (level.strength + customers)
        return p / len(levels)

    rows = {r.doc_id: r for r in language_model.language_model_scores(documents).collect()}
    for r in documents.orderBy("doc_id").limit(40).collect():
        _, token, first = language_model._tokens(*words.texts(pa.array([r.text])))
        w = token.tolist()
        u = [int(language_model.BEGIN), *w[:-1]]
        assert first.tolist() == [True] + [False] * (len(w) - 1)
        assert rows[r.doc_id].score == pytest.approx(sum(math.log10(probability(*x)) for x in zip(u, w, strict=True)), rel=1e-5)
        assert rows[r.doc_id].base_score == pytest.approx(sum(math.log10((often.get(x, 0) + 1) / (setting.tokens + setting.kinds + 1)) for x in w), rel=1e-9)
    # every context's probabilities, with one word that no text has, add up to one
    for u in [*list(pairs[0])[:20], 12345]:
        assert sum(probability(u, w) for w in [*often, 1]) == pytest.approx(1.0, abs=1e-6)


def test_language_model_seatings_are_valid(seatings):
    setting, pairs, root, often = seatings
    for below, level, shares in zip(pairs, setting.counted, root, strict=True):
        customers = Counter()
        for own in below.values():
            assert all(1 <= t <= c for c, t in own.values())
            customers.update({w: t for w, (c, t) in own.items()})
        assert sum(customers.values()) == level.customers and set(customers) == set(often) == set(shares)
        tables = {w: (customers[w] - x) / setting.root_discount for w, x in shares.items()}
        assert all(abs(t - round(t)) < 0.01 * t and 1 <= round(t) <= customers[w] for w, t in tables.items())
    assert len({level.strength for level in setting.levels}) > 1  # drawn


def _partitions(n):
    if n == 0:
        yield []
        return
    for p in _partitions(n - 1):
        yield [*p, 1]
        for i in range(len(p)):
            yield [*p[:i], p[i] + 1, *p[i + 1 :]]


def test_tables_are_drawn_from_the_posterior():
    strength, discount, others, share = 1.7, 0.4, 5, 0.23
    rising = lambda n: math.prod(i - discount for i in range(1, n))
    stirling = language_model._stirling(discount)
    for c in (2, 3, 5):
        weight = Counter()
        for p in _partitions(c):
            weight[len(p)] += math.prod(map(rising, p))
        assert [math.exp(x) for x in stirling[c, 1 : c + 1]] == pytest.approx([weight[t] for t in range(1, c + 1)])
        exact = np.array([weight[t] * share**t * math.prod(strength + discount * (others + k) for k in range(t)) for t in range(1, c + 1)])
        n = 40_000
        drawn = language_model._drawn(np.random.default_rng(c), np.full(n, c), np.full(n, others), np.full(n, share), strength, discount, stirling)
        assert np.bincount(drawn, minlength=c + 1)[1:] / n == pytest.approx(exact / exact.sum(), abs=0.012)
    many = language_model._drawn(np.random.default_rng(1), np.full(50, 5000), np.full(50, others), np.full(50, share), strength, discount, stirling)
    assert ((many >= 1) & (many <= 5000)).all() and 1 < many.mean() < 200
    assert language_model._log_gamma(np.array([0.01, 1.0, 7.5, 1e6])) == pytest.approx([math.lgamma(x) for x in (0.01, 1.0, 7.5, 1e6)], rel=1e-9, abs=1e-9)


def test_language_model_hot_pair_and_flushes(spark, monkeypatch):
    """One pair of words in most places: its bucket is scored by several tasks, and flushes of any size give the same scores."""
    rng = random.Random(5)
    rows = docs_of(spark, [" ".join("hot pair" if rng.random() < 0.8 else rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(300)]).repartition(6)
    seen = []
    crowded = language_model._crowded
    monkeypatch.setattr(language_model, "_crowded", lambda *a: seen.append(crowded(*a)) or seen[-1])
    a = {r.doc_id: r[1:] for r in language_model.language_model_scores(rows).collect()}
    assert seen[0] and max(seen[0].values()) > 2
    monkeypatch.setattr(language_model, "_crowded", lambda *_: {})
    b = {r.doc_id: r[1:] for r in language_model.language_model_scores(rows).collect()}
    assert all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)


def test_a_repeated_text_scores_apart(spark):
    """A text that the training texts have twice is likelier than one of the same words that they have once."""
    rng = random.Random(9)
    texts_ = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(260)]
    trained = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    rows = docs_of(spark, texts_ + texts_[:60])
    got = {r.doc_id: r.score / r.n_tokens for r in language_model.language_model_scores(rows).collect()}
    once = [got[i] for i in range(60, 260) if trained(i)]
    twice = [got[i] for i in range(60) if trained(i) and trained(i + 260)]
    assert np.mean([a > b for a in twice for b in once]) > 0.95  # area under the curve


def test_language_model_edges(spark, odd, empty):
    got = language_model.language_model_scores(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1} and len({(r.score, r.base_score) for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert language_model.language_model_scores(empty).collect() == []
    alone = language_model.language_model_scores(odd.where("doc_id is null")).collect()
    assert {(r.train_tokens, r.base_score, r.score, r.held_out) for r in alone} == {(0, 0.0, 0.0, False)}


# 6 ------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, odd, empty):
    for n in (0, 1, 191, 192, 193, 3072, 3073, 50_000):
        payload = media.padded(bytes(i % 251 for i in range(n)))
        raw = media.write_media(payload)
        t = media.tracks(raw)[0]
        assert media.stored_payload(raw) == payload and len(payload) % 192 == 0 and len(payload) >= max(n, 192)
        assert t["n_samples"] == len(payload) // 192 and t["codec"] == "raw " and t["duration"] == len(payload)
        assert all(t["samples"][k][0] >= len(raw) - len(payload) for k in t["keyframes"])
    for r in media.media_digests(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 5 and doc_id <> 1").collect():
        text = (r.text or "").encode()
        payload = media.padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        raw = media.write_media(payload)
        assert (r.media_bytes, r.media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert json.loads(r.feature)["samples"] == len(payload) // 192
    assert media.media_digests(empty).collect() == [] and media.media_digests(odd).count() == odd.count()


def test_media_columns_of_files(spark):
    good = media.write_media(media.padded(b"x" * 5000))
    files = [good, None, b"", b"\0\0\0\x08free", good[:300], good[:-1], good.replace(b"stsz", b"stsy"), struct.pack(">I4s", 4, b"moov"), b"\xff" * 64]
    x = spark.createDataFrame([(i, f, 1) for i, f in enumerate(files)], "id long, media binary, codec int")
    got = {r.id: r for r in media.media_columns(x, "id", "media").collect()}
    t = media.tracks(good)[0]
    assert got[0].codec == "raw " and got[0].seconds == pytest.approx(5184 / 8000) and [(k.offset, k.length) for k in got[0].keyframes] == [tuple(x) for x in t["samples"][t["keyframes"]].tolist()]
    assert got[1].media_bytes is None and got[1].media_error is None
    assert all(got[i].media_error for i in (2, 3, 4, 5, 6, 7, 8))
    assert got[0].tracks[0].track_id == 1 and [k.seconds for k in got[0].tracks[0].keyframes] == pytest.approx([k * 192 / 8000 for k in t["keyframes"]])


def test_nested_boxes(spark):
    deep = b""
    for _ in range(2000):
        deep = media._box(b"moov", deep)
    few = media._box(b"moov", media._box(b"udta", deep))  # what is no container is not entered
    x = spark.createDataFrame([(1, deep), (2, few)], "id long, media binary")
    got = {r.id: r.media_error for r in media.media_columns(x, "id", "media").collect()}
    assert got == {1: "boxes are nested too deep", 2: "no track"}


def _track(number, handler, codec, *tables, scale=1000):
    head = media._full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0))
    mdhd = media._full(b"mdhd", struct.pack(">IIII", 0, 0, scale, 0))
    stsd = media._full(b"stsd", struct.pack(">I", 1), media._box(codec, bytes(20)))
    return media._box(b"trak", head, media._box(b"mdia", mdhd, media._full(b"hdlr", struct.pack(">I4s12x", 0, handler)), media._box(b"minf", media._box(b"stbl", stsd, *tables))))


def test_two_tracks_packed_sizes_and_times(spark):
    """Audio before video; sizes of four bits; keyframes at times of uneven samples."""
    tables = lambda sizes, at, deltas, keys: (
        media._full(b"stz2", struct.pack(">II", 4, len(sizes)), bytes(a << 4 | b for a, b in zip(sizes[::2], [*sizes[1::2], 0], strict=False))),
        media._full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), media._full(b"stco", struct.pack(">II", 1, at)),
        media._full(b"stts", struct.pack(">I", len(deltas)), *(struct.pack(">II", *d) for d in deltas)), media._full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
    )
    moov = media._box(b"moov", _track(1, b"soun", b"mp4a", *tables([3, 5, 7], 0, [(3, 10)], [1])), _track(2, b"vide", b"avc1", *tables([1, 2, 3, 4], 4, [(2, 40), (2, 80)], [1, 3, 4])))
    (row,) = media.media_columns(spark.createDataFrame([(1, moov)], "id long, media binary"), "id", "media").collect()
    a, v = row.tracks
    assert (a.codec, v.codec, a.handler, v.handler) == ("mp4a", "avc1", "soun", "vide") and row.codec == "mp4a" and row.media_error is None
    assert [(k.offset, k.length, k.seconds) for k in v.keyframes] == [(4, 1, 0.0), (7, 3, 0.08), (10, 4, 0.16)] and v.seconds == pytest.approx(0.24)


def test_fragments(spark):
    """Samples of a fragment: sizes by sample, defaults of the track, a first sample that can be decoded alone."""
    empty_ = (media._full(b"stsz", bytes(8)), media._full(b"stsc", bytes(4)), media._full(b"stco", bytes(4)), media._full(b"stts", bytes(4)))
    trex = media._full(b"trex", struct.pack(">IIIII", 7, 1, 20, 0, 0x10000))
    moov = media._box(b"moov", _track(7, b"vide", b"hvc1", *empty_), media._box(b"mvex", trex))
    moof = lambda offset: media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7), flags=0x20000), media._full(b"trun", struct.pack(">IiI", 3, offset, 0), struct.pack(">3I", 4, 5, 6), flags=0x205)))
    file = moov + moof(len(moof(0)) + 8) + media._box(b"mdat", b"x" * 15)
    bad = moov + moof(10_000) + media._box(b"mdat", b"x" * 15)
    cut_off = moov + media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7)), media._full(b"trun", struct.pack(">I", 1 << 31), flags=0x200)))
    stray = media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 9))))
    got = {r.id: r for r in media.media_columns(spark.createDataFrame(list(enumerate([file, bad, cut_off, stray])), "id long, media binary"), "id", "media").collect()}
    assert got[0].media_error is None and got[0].n_samples == 3 and got[0].seconds == pytest.approx(0.06)
    assert [(k.offset, k.length) for k in got[0].keyframes] == [(len(file) - 15, 4)] and file[len(file) - 15 :] == b"x" * 15
    assert all(got[i].media_error for i in (1, 2, 3))


def test_runs_that_claim_more_samples_than_bytes(spark):
    empty_ = (media._full(b"stsz", bytes(8)), media._full(b"stsc", bytes(4)), media._full(b"stco", bytes(4)), media._full(b"stts", bytes(4)))
    moov = media._box(b"moov", _track(7, b"vide", b"hvc1", *empty_))
    run = media._full(b"trun", struct.pack(">I", 15_000))
    bomb = moov + media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7)), *[run] * 950))
    many = media._box(b"moov", *[_track(1, b"soun", b"mp4a", media._full(b"stsz", struct.pack(">II", 0, 0)), media._full(b"stsz", struct.pack(">II", 1, 500)))] * 50)
    began = time.perf_counter()
    got = {r.id: r.media_error for r in media.media_columns(spark.createDataFrame([(1, bomb), (2, many)], "id long, media binary"), "id", "media").collect()}
    assert got == {1: "more samples than bytes", 2: "more samples than bytes"}
    assert time.perf_counter() - began < 20
    began = time.perf_counter()
    assert media._described(bomb)["media_error"] and time.perf_counter() - began < 0.1


def test_data_of_a_second_track_in_a_fragment():
    """Without an own base, it goes on after the first one's, unless the fragment says that each begins with it."""
    empty_ = (media._full(b"stsz", bytes(8)), media._full(b"stsc", bytes(4)), media._full(b"stco", bytes(4)), media._full(b"stts", bytes(4)))
    moov = media._box(b"moov", _track(1, b"vide", b"hvc1", *empty_), _track(2, b"soun", b"mp4a", *empty_))

    def file(flags, offset, own):
        traf = lambda n, start, sizes: media._box(b"traf", media._full(b"tfhd", struct.pack(">I", n), flags=flags), media._full(b"trun", struct.pack(">I", len(sizes)) + (struct.pack(">i", start) if start is not None else b""), struct.pack(f">{len(sizes)}I", *sizes), flags=0x200 | (start is not None)))
        moof = media._box(b"moof", traf(1, offset, [4, 5]), traf(2, own, [3]))
        return moov + moof + media._box(b"mdat", b"x" * 12), len(moov), len(moof)

    raw, start, size = file(0, 0, None)
    raw, start, size = file(0, size + 8, None)
    first, second = media.tracks(raw)
    at = start + size + 8
    assert first["samples"].tolist() == [[at, 4], [at + 4, 5]] and second["samples"].tolist() == [[at + 9, 3]]
    raw, start, size = file(0x20000, 0, 0)
    raw, start, size = file(0x20000, size + 8, size + 8 + 9)
    first, second = media.tracks(raw)
    assert second["samples"].tolist() == [[start + size + 8 + 9, 3]]


# 7 ------------------------------------------------------------------------------------------------------------------


def licences_by_hand(text):
    w = alnum(text)
    starts = [(i, name) for p, name in licenses.BASE.items() for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
    places = [i for i, _ in starts]
    return len(w), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in starts}))


def test_licenses(spark, documents, odd, empty):
    r = random.Random(5)
    pool = "cc by CC-BY nc 4 0 all rights reserved general public license GNU Licensed under the apache version 2 x é . \n ALL".split(" ")
    made = docs_of(spark, [" ".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(300)])
    for df in (documents, made, odd):
        got = Counter((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in licenses.license_scan(df).collect())
        assert got == Counter((x.doc_id, *licences_by_hand(x.text)) for x in df.collect())
    assert licenses.license_scan(empty).collect() == []


def test_licence_notices(spark):
    notices = [t for _, t, _ in licenses.TEMPLATES]
    noise = ["plain prose about nothing at all"] * 40
    texts_ = [f"some words before it\n{t.title()}.\nand after" for t in notices] + noise + ["licensed under the apache"]
    got = {x.doc_id: x for x in licenses.license_scan(docs_of(spark, texts_)).collect()}
    for i, (name, _, _) in enumerate(licenses.TEMPLATES):
        assert name in got[i].labels.split(",") and got[i].score == 1.0
        assert (name, 4) in [(p.label, p.word) for p in got[i].places]
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(len(notices), len(texts_)))


def notices_by_hand(texts_):
    """Labels, score and places of each text: every template laid over it at every place."""
    cut = [t.split() for _, t, _ in licenses.TEMPLATES]
    split = [alnum(t) for t in texts_]
    counts = Counter(w for ws in split for w in set(ws))
    idf = {w: math.log((len(texts_) + 1) / (counts[w] + 1)) + 1e-3 for ws in cut for w in ws}
    for w in split:
        joined = f" {' '.join(w)} "
        labels, places, best = {x for p, x in licenses.BASE.items() if f" {p} " in joined}, [], 0.0
        for ws, (name, _, phrase) in zip(cut, licenses.TEMPLATES, strict=True):
            for b in range(-len(ws) + 1, len(w)):
                share = sum(idf[x] for p, x in enumerate(ws) if 0 <= b + p < len(w) and w[b + p] == x) / sum(idf[x] for x in ws)
                if round(share, 6) >= licenses.AGREES and f" {phrase} " in f" {' '.join(w[max(b, 0) : max(b + len(ws), 0)])} ":
                    places.append((name, b))
                    best = max(best, share)
        yield ",".join(sorted(labels | {name for name, _ in places})), round(min(best, 1.0), 6) if places else float(bool(labels)), Counter(places)


def test_several_notices_in_a_text(spark):
    r = random.Random(7)
    notices = [t for _, t, _ in licenses.TEMPLATES]
    prose = "the and of to in is for with this file use without software under version provided public domain source".split()
    words_ = lambda n: " ".join(r.choice(prose) for _ in range(n))
    damaged = lambda t: " ".join(w if r.random() < 0.9 else "x" for w in t.split())
    texts_ = [words_(30)] * 60 + [" ".join(f"{words_(r.randint(0, 40))} {t}" for t in pair) for pair in ((a, b) for a in notices for b in notices if a != b)]
    texts_ += [" ".join(f"{damaged(t)} {words_(20)}" for t in r.sample(notices, 5)) for _ in range(60)] + [" ".join(notices)]
    far = [t.replace(phrase, " ".join("x" * len(phrase.split()))) + f" {words_(9)} {phrase}" for _, t, phrase in licenses.TEMPLATES]  # the phrase stands elsewhere
    texts_ += [f"{words_(5)} {t}" for t in far]
    got = {x.doc_id: x for x in licenses.license_scan(docs_of(spark, texts_)).collect()}
    for i, (labels, score, places) in enumerate(notices_by_hand(texts_)):
        assert (got[i].labels, Counter((p.label, p.word) for p in got[i].places)) == (labels, places)
        assert got[i].score == pytest.approx(score, abs=1e-6)


def test_templates_of_any_length(spark):
    long = [f"w{i}" for i in range(1_000)]
    templates = [("long", " ".join(long), "w900 w901"), ("short", "some other notice here", "other notice")]
    texts_ = [" ".join(long[280:]), " ".join(["x"] * 700 + long), " ".join(reversed(long[:280])), "some other notice here", "nothing"]
    got = {x.doc_id: [(p.label, p.word) for p in x.places] for x in licenses.license_scan(docs_of(spark, texts_), templates=templates).collect()}
    assert got == {0: [("long", -280)], 1: [("long", 700)], 2: [], 3: [("short", 0)], 4: []}


# 9 ------------------------------------------------------------------------------------------------------------------


def area(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    k = y.sum()
    return (rank[y == 1].sum() - k * (k + 1) / 2) / (k * (len(y) - k))


def test_quality_on_held_out_rows(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(d, y)
    got = quality.quality_scores(d, model).join(y, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert area(held.quality.to_numpy(), held.score.to_numpy()) > 0.97
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    # held-out labels, language, source and the id's own value do not matter
    flipped = y.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_scores(d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), quality.fit_quality(d, flipped)).toPandas()
    assert (again.sort_values("doc_id").score.to_numpy() == quality.quality_scores(d, model).toPandas().sort_values("doc_id").score.to_numpy()).all()


def test_quality_edges(spark, odd, empty):
    y = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    for model in (quality.fit_quality(odd, y), quality.fit_quality(empty, y), quality.train([], np.zeros(0))):
        got = quality.quality_scores(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
        assert quality.quality_scores(empty, model).collect() == [] and quality.accepted(odd, model, threshold=0.0).count() == odd.count()
        assert quality.accepted(odd, model, threshold=1.1).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


def contamination_by_hand(docs, items, window=13):
    out = []
    for i, t in docs:
        w, hit, found = alnum(t), set(), set()
        for j, s in items:
            q = alnum(s)
            n = min(window, len(q))
            wins = {tuple(q[a : a + n]) for a in range(len(q) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in wins and j is not None:
                    hit |= set(range(a, a + n))
                    found.add(j)
        listed = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_decontamination_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    r = random.Random(6)
    letters = list("abc")
    items = [(i, " ".join(r.choice(letters) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 13, 14, 20, 40, 40])] + [(50, "a, b; c"), (51, None), (52, "..."), (None, "a b"), (0, "zz yy"), (11, "q")]
    docs = [(i, " ".join(r.choice(letters + ["d"]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs += [(100 + k, f"x y z {t} and then more") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (None, items[10][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(decontamination.contaminated_spans(d, b))
    want = contamination_by_hand(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = decontamination.decontaminated(d.withColumn("row", F.lit(1)), b)
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter(x for x, w in zip(docs, want, strict=True) if not w[5])


def test_decontamination_edges(spark, odd, empty):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.contaminated_spans(odd, b).count() == odd.count()
    assert decontamination.contaminated_spans(empty, b).collect() == []
    none = decontamination.contaminated_spans(odd, b.limit(0)).collect()
    assert all(r.spans == [] and r.items == [] for r in none) and decontamination.decontaminated(odd, b.limit(0)).count() == odd.count()


def test_winnowing_keeps_a_gram_of_every_run():
    g = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    rows = np.repeat(np.arange(3), 100)
    kept = set(decontamination.winnowed(rows, g, 9).tolist())
    for i in range(292):
        if rows[i] == rows[i + 8]:
            assert kept & set(range(i, i + 9))


# all together -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF).toPandas(), queries.ORACLE_SQL[name], connection(SF))


def test_pipeline_is_its_parts(spark, documents):
    import corpus_pipeline

    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    y = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.predicted for r in quality.quality_scores(documents, quality.fit_quality(documents, y)).collect()}
    kept = [(r.doc_id, r.text) for r in documents.collect() if score[r.doc_id]]
    group = components_by_hand(kept)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [x for x, w in zip(kept, contamination_by_hand(kept, items), strict=True) if not w[5]]
    codec = piece_codec.Codec(piece_codec.build_trie(piece_model.read_model(open(MODEL, "rb").read())))
    assert got == {i: codec.encode(t) for i, t in kept}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, SF).columns == documents.columns
