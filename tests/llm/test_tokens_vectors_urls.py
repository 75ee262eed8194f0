"""Token operators, top-k, packing and URL filters against brute force or the libraries themselves."""

import hashlib
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatewarden.llm import chunk_codec, packing, token_counts, topk, url_filter
from gatewarden.llm.bpe import default_path
from gatewarden.llm.common import table
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
PARTS = ["a", "the", " ", "  ", "\n", "'", "'s", "'re", "é", "日", "1", "22", "!", "<|endoftext|>", "<|endof", "\x1c", "\u3000", "\xa0", "🙂", "ing", "'ll", ", ", "word."]
texts = st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def codec():
    return chunk_codec.ChunkCodec(default_path())


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(default_path())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts)
def test_short_texts(library, codec, counter, text):
    ids = ids_of(library, text)
    assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert counter.prefixes(text).tolist() == [len(ids_of(library, text[:k])) for k in range(len(text) + 1)]
    assert counter.total(text) == len(ids)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_long_texts_through_chunks(library, codec, counter, seed):
    random.seed(seed)
    shared = "".join(random.choice(PARTS) for _ in range(1500))
    for text in (shared, "x" + shared + "y", shared * 2, "a" * 9000, "日本" * 5000, "x'" * 400):
        ids = ids_of(library, text)
        assert codec.encode(text) == ids and counter.total(text) == len(ids)


@pytest.mark.parametrize("text", [" " * 100_000 + "a", "\n" * 100_000, " \n\t" * 30_000 + "z", "<|endoftext|>" * 10_000, "<|endoftext|>" + "abc" * 20_000, "x'" * 40_000, "'re'll'd" * 10_000, "\u3000" * 40_000 + "日本" * 20_000])
def test_counts_of_long_runs_are_linear(library, counter, text):
    began = time.time()
    got = counter.prefixes(text)
    assert time.time() - began < 10
    for k in [*range(min(len(text), 40)), len(text) // 2, len(text) // 2 + 1, len(text) - 1, len(text)]:
        assert got[k] == len(ids_of(library, text[:k])), k


def test_shared_passages_are_encoded_once(codec):
    random.seed(1)
    passage = " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    own = chunk_codec.ChunkCodec(default_path())
    own.encode("one start " + passage)
    before = own.misses
    own.encode("quite another beginning, " + passage + " and end")
    assert own.hits >= before - 2 and own.misses - before <= 3  # all but the first and last chunk


def test_cuts_keep_characters_and_bounds():
    data_ = ("é日🙂" * 9000).encode()
    cuts = chunk_codec.cuts(data_)
    assert cuts[-1] == len(data_) and b"".join(data_[a:b].decode().encode() for a, b in zip([0, *cuts], cuts)) == data_
    assert max(np.diff([0, *cuts])) <= chunk_codec.MAX_CHUNK + 3
    assert chunk_codec.cuts(b"") == []


def test_small_store_changes_nothing(library):
    own = chunk_codec.ChunkCodec(default_path(), store_bytes=10)
    text = "some words, again and again; " * 900
    assert own.encode(text) == ids_of(library, text) and len(own.store) <= 1


def test_truncation(counter, library):
    text = "It's a longer text, with tokens & more tokens."
    k = counter.truncated(text, 5)
    assert len(ids_of(library, text[:k])) <= 5 < min(len(ids_of(library, text[:j])) for j in range(k + 1, len(text) + 1))
    assert counter.truncated(text, 0) == 0 and counter.truncated(None, 3) == 0


def test_token_frames(frame):
    docs = frame([(1, "some text", "c"), (2, None, "c"), (2, None, "c"), (3, "", "c")], "doc_id bigint, text string, n_tokens string")
    got = chunk_codec.encode(docs, outputs=("n_tokens", "ids", "decoded")).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids, r.decoded) for r in got] == [(2, [11246, 2420], "some text"), (0, [], ""), (0, [], ""), (0, [], "")]
    assert [r.decoded for r in chunk_codec.decode(chunk_codec.encode(docs)).orderBy("doc_id").collect()] == ["some text", "", "", ""]
    got = token_counts.count(docs, budget=1).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.fits_chars) for r in got] == [(2, 4), (0, 0), (0, 0), (0, 0)]
    assert chunk_codec.encode(docs.filter("doc_id > 9")).count() == 0


@data
def test_op3_and_op7(spark, library):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    counts = {r.doc_id: r for r in token_counts.op7(spark, SF).collect()}
    for r in chunk_codec.op3(spark, SF).collect():
        ids = ids_of(library, docs[r.doc_id])
        assert r.n_tokens == len(ids) == counts[r.doc_id].n_tokens
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[r.doc_id].n_bytes == len(docs[r.doc_id].encode()) and counts[r.doc_id].over_limit == (len(ids) > 1024)


@data
def test_op6_against_sql(spark):
    assert_same(topk.op6(spark, SF), topk.OP6_SQL, SF)


def _brute(rows, queries, k=5):
    out = {}
    for q, v in queries:
        s = [(-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q]
        out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("top", [3, 2**14, 2**28])
def test_topk_ties_and_sizes(frame, monkeypatch, top):
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "ROUND", 500)
    random.seed(top)
    rows = [(k, [float(random.randint(-top, top)) for _ in range(5)]) for k in range(60)]
    df = frame(rows, "id bigint, v array<double>")
    got = topk.search(df.filter("id % 5 = 0"), df).orderBy("query_id", "rank").collect()
    want = _brute(rows, [r for r in rows if r[0] % 5 == 0])
    assert {q: [(r.vec_id, r.score) for r in got if r.query_id == q] for q in want} == want


def test_products_beyond_a_long_stay_at_its_ends():
    big = np.array([[2.0**40, 2.0**40]])
    assert topk._product(big, np.array([[2.0**40, 2.0**40], [-(2.0**40), -(2.0**40)], [2.0**20, 1.0]])).tolist() == [[2**63 - 1, 1 - 2**63, 2**60 + 2**40]]


def test_topk_edge_cases(frame):
    rows = frame([(0, [0.5, -0.1]), (50, [1.0, float("nan")]), (1, None), (2, [None, 1.0]), (None, [1.0, 1.0]), (3, [0.25]), (3, [0.25]), (4, []), (0, [0.5, -0.1])], "vec_id bigint, embedding array<float>")
    df = topk.integral(rows)
    assert sorted((r.id, r.v) for r in df.collect()) == [(0, [128.0, -26.0]), (0, [128.0, -26.0]), (3, [64.0]), (3, [64.0])]
    got = topk.search(df.filter("id % 50 = 0"), df).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 3, 8192), (0, 2, 3, 8192)]
    assert topk.search(df.filter("id > 99"), df).count() == 0 and topk.search(df.filter("id > 99"), df.filter("id > 99")).count() == 0


def _checked(rows, lengths, capacities):
    pieces = {}
    bins = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_length, r.copy), []).append((r.piece_start, r.piece_length))
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    assert sorted((k[0] if k[0] is not None else -1, sum(n for _, n in v)) for k, v in pieces.items()) == sorted((d if d is not None else -1, n or 0) for d, n in lengths)
    for v in pieces.values():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
    for own in bins.values():
        used = sum(r.piece_length for r in own)
        assert {r.capacity for r in own} == {min(c for c in capacities if c >= used)}
        at = 0
        for r in sorted(own, key=lambda r: r.place):
            assert r.place == at
            at += r.piece_length


def _brute_pack(lengths, capacities, cost):
    """The same rules, looking at every bin and every size."""
    bins, out = [], []
    for k, n in enumerate(lengths):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n]
        if fits:
            i = min(fits)[1]
        else:
            best = None
            for c in sorted(capacities):
                if c < n:
                    continue
                filled, rest = n, lengths[k + 1 :]
                for m in rest:
                    if filled + m <= c:
                        filled += m
                value = (c + cost) / filled
                if best is None or value < best[0] - 1e-12:
                    best = (value, c)
            bins.append({"room": best[1], "used": 0})
            i = len(bins) - 1
        bins[i]["room"] -= n
        bins[i]["used"] += n
        out.append(i)
    return out, [min(c for c in capacities if c >= b["used"]) for b in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64)]), st.sampled_from([0, 5, 40]))
def test_packing_by_brute_force(lengths, capacities, cost):
    lengths = sorted(lengths, reverse=True)
    assert packing.pack(lengths, capacities, cost) == _brute_pack(lengths, capacities, cost)


def test_packed_frames(frame):
    random.seed(12)
    lengths = [(k, random.randint(0, 300)) for k in range(200)] + [(None, 7), (None, 7), (5, 999), (5, 999), (9, None)]
    df = frame(lengths, "doc_id bigint, length bigint")
    for shard in (1_024, 20):
        rows = packing.packed(df, (32, 64, 128), 4, shard).collect()
        _checked(rows, lengths, (32, 64, 128))
        used = sum(r.piece_length for r in rows)
        assert used >= (0.97 if shard == 1_024 else 0.9) * sum({r.bin: r.capacity for r in rows if r.bin is not None}.values())
    assert sorted(map(str, packing.packed(df.repartition(5), (32, 64, 128), 4, 20).collect())) == sorted(map(str, packing.packed(df, (32, 64, 128), 4, 20).collect()))
    assert packing.packed(df.filter("doc_id > 999")).count() == 0


@data
def test_op8(spark):
    rows = packing.op8(spark, SF).collect()
    docs = [(r.doc_id, len((r.text or "").encode())) for r in table(spark, SF, "documents").collect()]
    _checked(rows, docs, packing.CAPACITIES)


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def parsed(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([k for k in map(path.find, "?#") if k >= 0], default=len(path))]


def ruled(host, path):
    best = None
    for r in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best = r
    return best


URLS = ["http://A.example.com/en/1", "https://example.com/en/77", "http://xcom/en/1", "http://a.net/de/1", "https://b.example.net/de/8/9", "ftp://é.org/es/", None, "", "no-scheme/en/", "http://com/en/", "x://org?/es/", "http://h.org#/es/", "a://b://c.com/en/", "http://ÄB.COM/en/\n1", "HTTP://Q.NET/de/?x=://com/en/"]


def test_url_rules(frame):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0])]
    got = url_filter.judged(frame(rows, "page_id bigint, url string"), url_filter.Filter()).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parsed(r.url)
        rule = ruled(host, path)
        assert (r["filter"].host, r["filter"].path, r["filter"].rule) == (host, path, rule), r.url
        assert r["filter"].verdict == (RULES[rule] if rule else "allow")


def test_url_models():
    random.seed(13)
    good = [f"https://news.example/{random.choice(['science', 'arts'])}/{random.randint(1, 9999)}" for _ in range(300)]
    bad = [f"https://x{random.randint(1, 99)}.example/win-{random.choice(['cash', 'prize'])}?id={random.randint(1, 9999)}" for _ in range(300)]
    model = url_filter.fit([u for p in zip(good, bad) for u in p], [r for _ in good for r in (False, True)])
    assert model.probability("https://news.example/science/5") < 0.5 < model.probability("https://x7.example/win-cash?id=3")
    m = url_filter.Markov.fitted(["abab", "abc"])
    seen = set("abc" + url_filter.END)
    assert 0.9 < sum(m.chance("ab", c) for c in seen) <= 1.0
    assert url_filter.Filter().probability("http://a/") == 0.0 and url_filter.fit(["a://b"], [True]).accepted is None


def test_url_frames(frame):
    pages = frame([(1, "http://a.fr/x", "f", "h"), (2, None, "f", "h")], "page_id bigint, url string, filter string, _host string")
    got = url_filter.judged(pages, url_filter.Filter(), to="verdicts").collect()
    assert [(r.filter, r._host, r.verdicts.verdict) for r in got] == [("f", "h", "allow")] * 2
    assert url_filter.judged(pages.filter("page_id > 9"), url_filter.Filter()).count() == 0


@data
def test_op9(spark):
    urls = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    rows = url_filter.op9(spark, SF).collect()
    assert len(rows) == len(urls)
    pages = table(spark, SF, "pages").select("page_id", "url")
    rule, verdict = url_filter.rule_of(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    model = url_filter.fit(*url_filter.examples(pages.select("url", verdict.alias("verdict"))))
    for r in rows:
        host, path = parsed(urls[r.page_id])
        rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (RULES[rule] if rule else "block" if model.probability(urls[r.page_id]) >= url_filter.CUT else "allow")
