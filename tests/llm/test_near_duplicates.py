"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import os
import random
import re

import numpy as np
import pytest

from gatewarden.llm import near_duplicates, sieve, simhash
from gatewarden.llm.common import table, written

SF = "/root/testdata/sf0.001"


def brute_set(text, size=5):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_kept(docs):
    """The smallest id of each group of (id, text) linked at 0.8 or more; ids distinct."""
    docs = sorted(docs)
    found = [brute_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            x, y = found[a], found[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                i, j = top(a), top(b)
                up[max(i, j)] = min(i, j)
    return {docs[top(k)][0] for k in range(len(docs))}


def _families(seed):
    """Near copies around the bound, over shared boilerplate; short, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    boilerplate = [word() for _ in range(30)]
    out = [None, "", "one", "One", "one two", " ".join(boilerplate)]
    for _ in range(8):
        base = [word() for _ in range(rng.randint(20, 120))] + boilerplate
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own[: len(own) - rng.randint(0, 12)]))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "settled"), [(1024, 500_000), (7, 0)])
def test_every_pair_of_the_bound_is_found(frame, monkeypatch, block, settled):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "MEET", block)
    monkeypatch.setattr(simhash, "SETTLED", settled)
    docs = _families(block)
    got = near_duplicates.deduplicated(frame(docs, "doc_id bigint, text string"))
    assert {r.doc_id for r in got.collect()} == brute_kept(docs)


def test_elements_of_the_same_sets_meet_once(frame, monkeypatch):
    rng = random.Random(4)
    a = [f"w{rng.random()}" for _ in range(300)]
    rows = frame([(0, 0, " ".join(a)), (1, 1, " ".join([*a, "end"]))], "id bigint, row bigint, text string")
    met, dealt = [], near_duplicates._dealt
    monkeypatch.setattr(near_duplicates, "_dealt", lambda x, *columns: met.append(x.count()) or dealt(x, *columns))
    found = near_duplicates.candidates(written(near_duplicates.sets(rows), "sets"))
    assert found.count() == 1
    assert met[0] <= 6  # not one row for each of some sixty shared elements and set


def test_blocks_of_few_elements_lose_no_pair(frame, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HELD", 300)
    docs = _families(3)
    got = near_duplicates.deduplicated(frame(docs, "doc_id bigint, text string"))
    assert {r.doc_id for r in got.collect()} == brute_kept(docs)


def test_links_are_exact():
    a = [f"w{k}" for k in range(24)]  # 20 shingles; two words less leave 18, five less 15
    sets = [near_duplicates.shingles(" ".join(x)) for x in (a, a[:22], a[:20], a[:19])]
    assert [len(x) for x in sets] == [20, 18, 16, 15]
    assert sorted(near_duplicates.linked([sets[0], sets[2]])) == [(0, 1)]
    assert list(near_duplicates.linked([sets[0], sets[3]])) == []


def test_texts_without_a_partner_are_not_moved(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)  # the fine sketches take part, too
    texts = [" ".join(f"w{rng.random()}" for _ in range(150)) for _ in range(400)]
    docs = [(k, t) for k, t in enumerate([*texts, *[f"{texts[0]} end{k}" for k in range(6)], texts[1], texts[1]])] + [(407, texts[1])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        moved = _shuffled(spark)
        got = near_duplicates.deduplicated(spark.read.parquet(str(tmp_path / "docs"))).collect()
        moved = _shuffled(spark) - moved
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert moved < sum(len(t) for t in texts)  # once would be that much


def _shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("most", [4096, 1])
def test_a_sieve_keeps_all_keys_and_few_others(frame, monkeypatch, most):
    monkeypatch.setattr(sieve, "MOST", most)
    rng = random.Random(most)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(12_000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    held = sieve.sieve(frame([(k,) for k in keys], "key bigint")).value
    assert len(held) == min(most, 3)
    assert sieve.passing(held, np.array(keys, np.int64)).all()
    others = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 100_000)
    assert sieve.passing(held, others).mean() < (0.02 if most > 1 else 0.5)
    assert not sieve.passing(sieve.sieve(frame([], "key bigint")).value, others).any()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stage_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, SF, "documents")
    got = dict(pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert {r.doc_id for r in got.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
