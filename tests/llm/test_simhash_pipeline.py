"""SimHash components and the pipeline against brute force."""

import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gatewarden.llm import simhash
from gatewarden.llm.common import table
from tests.llm.test_near_duplicates import brute_kept

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    """Smallest id reachable over pairs of (id, fingerprint) at most three bits apart."""
    ids = [i for i, _ in fps]
    up = list(range(len(fps)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                up[top(a)] = top(b)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(top(k), []).append(k)
    return [min([ids[j] for j in groups[top(k)] if ids[j] is not None], default=None) for k in range(len(fps))]


def test_fingerprints():
    random.seed(14)
    texts = [None, "", "One", "one TWO", "A b\x0bc", "É b c é", "a\u2003b c d", "\x1ca b c"] + [" ".join(random.choice("abcAB") for _ in range(30)) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def _planted(seed, n=120):
    """Chains, stars and lone fingerprints; ids that are null or repeat."""
    rng = random.Random(seed)
    out = [(None, 0), (7, 0), (None, 12345 << 40)]
    k = 10
    for _ in range(n // 12):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append((k, fp))
            k += 1
            for b in rng.sample(range(64), rng.randint(0, 3)):
                fp ^= 1 << b
    out.append(out[-1])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
@pytest.mark.parametrize(("shard", "settled"), [(512, 500_000), (3, 0)])
def test_components(frame, monkeypatch, blocks, shard, settled):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "SETTLED", settled)
    monkeypatch.setattr(simhash, "blocks_for", lambda n: blocks)
    rows = _planted(blocks)
    fps = frame([(i, k, signed(f)) for k, (i, f) in enumerate(rows)], "doc_id bigint, row int, fp bigint")
    got = {r.row: r.component_id for r in simhash.grouped(fps).collect()}
    assert [got[k] for k in range(len(rows))] == brute_components(rows)


def test_hot_bucket_is_split(frame, monkeypatch):
    """Hundreds of fingerprints that agree on three of four blocks, in chains."""
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = random.Random(3)
    rows = [(k, rng.getrandbits(12)) for k in range(200)]
    fps = frame([(i, signed(f)) for i, f in rows], "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.grouped(fps).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows)


@pytest.mark.parametrize("settled", [500_000, 40, 0])
def test_long_chain(frame, monkeypatch, settled):
    """In one task, in rounds that end in one task, and in rounds alone."""
    monkeypatch.setattr(simhash, "SETTLED", settled)
    chain, fp = [], 0
    for k in range(64):
        chain.append((100 - k, fp))
        fp |= 1 << k
    fps = frame([(i, signed(f)) for i, f in chain], "doc_id bigint, fp bigint")
    assert {r.component_id for r in simhash.grouped(fps).collect()} == {37}


def test_tree_finds_all_within_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(8) for _ in range(300)]
    tree = simhash.Tree()
    for k, v in enumerate(values):
        tree.add(v, k)
    for q in range(256):
        assert sorted(tree.within(q)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_deduplicated(frame):
    rows = [(3, "alpha beta gamma delta", "x"), (1, "Alpha beta gamma delta", "x"), (1, "alpha beta gamma delta", "x"), (1, "alpha beta gamma delta", "x"), (2, "one two three four five", "y"), (None, "six seven eight nine", "z"), (None, None, "z"), (9, "", "z")]
    docs = frame(rows, "doc_id bigint, text string, _row string")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:3].lower()) for r in got.collect()) == [(0, "six"), (1, "alp"), (2, "one"), (9, "")]
    assert simhash.deduplicated(docs.filter("doc_id > 99")).count() == 0


@data
def test_op10(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10(spark, SF).collect()}
    assert {i: (f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))} == got


@data
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from gatewarden.llm import packing, pii, quality_rules, toxicity

    docs = table(spark, SF, "documents")
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "pii", "best_fit_packing"]
    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.op1(spark, SF).filter("kept").collect()}
    mild = stages["toxicity"](spark, docs, SF)
    assert {r.doc_id for r in mild.collect()} == {r.doc_id for r in toxicity.op2(spark, SF).filter("predicted = 0").collect()}
    single = stages["simhash_near_dedup"](spark, docs, SF)
    assert {r.doc_id for r in single.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    private = stages["pii"](spark, docs, SF)
    assert private.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in private.collect():
        assert r.text == pii.replaced(before[r.doc_id], pii.findings(before[r.doc_id], pii.KEY)) and len(r.text) == len(before[r.doc_id])
    plan = stages["best_fit_packing"](spark, docs, SF)
    assert sorted(map(str, plan.collect())) == sorted(map(str, packing.op8(spark, SF).collect()))


@data
def test_pipeline_runs_in_whole(spark):
    import corpus_pipeline as pipeline

    out = pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.collect()}
    assert ids and ids < {r.doc_id for r in table(spark, SF, "documents").collect()}


def test_pipeline_keeps_clashing_columns(frame, spark):
    import corpus_pipeline as pipeline

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    text = " ".join(f"word{k} text" for k in range(40))
    docs = frame([(1, text, "en", "q", "t"), (2, None, None, None, None)], "doc_id bigint, text string, lang string, quality string, toxicity string")
    for name, stage in pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert got.filter("doc_id = 1").first()[2:] == ("en", "q", "t")
    assert pipeline.STAGES[0][1](spark, docs, SF).filter(F.col("doc_id") == 2).count() == 0


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from gatewarden.llm import common

    def session(master):
        none = SimpleNamespace(get=lambda key, default=None: default)
        context = SimpleNamespace(master=master, getConf=lambda: none, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=none)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("local[4]"))
