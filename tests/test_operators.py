import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.operators import dashboard, evaluate, hmm, inference, retrieve, signatures, structure, vocabulary


def test_vocabulary(frame):
    rows = frame([(["a", "b", "a"],), (["deadbeef", "a", "x1y2z3x1y2z3"],)], "tokens array<string>")
    counts = vocabulary.token_counts(rows)
    assert {(r.kind, r.token): r.n for r in counts.collect()} == {("word", "a"): 3, ("word", "b"): 1, ("hex", "deadbeef"): 1, ("bas", "x1y2z3x1y2z3"): 1}
    assert {r.token for r in vocabulary.vocabulary(counts, 2, 1).collect()} == {"a", "deadbeef", "x1y2z3x1y2z3", *vocabulary.PREDEFINED}
    ids = {r.token: r.id for r in vocabulary.vocabulary_ids(counts).collect()}
    assert ids == {"a": 2, "b": 3, "deadbeef": 4, "x1y2z3x1y2z3": 5}
    assert [r.value for r in vocabulary.vocabulary_file(frame([("b",), ("a",)], "token string")).collect()] == ["<unk>", "<s>", "</s>", "a", "b"]


def test_tokenised_and_placeholders(frame):
    requests = frame([(1, "GET", "/a/zz?x=1", ""), (2, "PUT", "/a", ""), (3, "POST", "/a", "q=2"), (4, "GET", "/qq/ww/a/a/*/", "")], "id int, method string, url string, body string")
    rows = vocabulary.tokenised(requests)
    assert {r.id for r in rows.collect()} == {1, 3, 4}
    vocab = frame([("a",), ("x",), ("*",)], "token string")
    got = {r.id: r.seq for r in vocabulary.placeholders(rows, vocab).collect()}
    assert got[1] == "a __other__ x __other__" and got[4] == "__other__ a a *"
    assert {r.id: r.seq for r in vocabulary.placeholders(rows, vocab, repeat=True).collect()}[4] == "__other__ __other__ a a *"


def test_sequence_table_keeps_five_samples(frame):
    rows = frame([(k, "s", f"c{k}") for k in range(9)] + [(9, "t", "x")], "id int, seq string, content string")
    got = {r.seq: r for r in vocabulary.sequence_table(rows).collect()}
    assert got["s"].n == 9 and got["s"].ids == list(range(9)) and got["s"].samples == [f"c{k}" for k in range(5)]


def test_encoding(frame):
    ids = frame([("i", 2), ("love", 3), ("you", 4)], "token string, id long")
    rows = frame([(1, ["i", "love", "you"]), (2, ["z"]), (3, [])], "k int, tokens array<string>")
    assert {r.k: r.ids for r in vocabulary.encoded(rows, ids, 5, "k").collect()} == {1: [2, 3, 4, 0, 0], 2: [1, 0, 0, 0, 0], 3: [0, 0, 0, 0, 0]}
    assert {r.k: r.ids for r in vocabulary.encoded(rows, ids, 2, "k").collect()}[1] == [2, 3]


def test_numbered_over_many_partitions(spark):
    got = vocabulary.numbered(spark.range(1000).repartition(7), [F.desc("id")], 10, "n").collect()
    assert sorted((r.n, r.id) for r in got) == [(10 + k, 999 - k) for k in range(1000)]


def test_chunks():
    assert vocabulary.chunk_sizes(289, 10) == [29] * 9 + [28]


def test_model_scores_are_exact():
    rng = np.random.default_rng(1)
    start, trans, emit = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(3), 4)
    for shape in ("A", "AN", "SANS"):
        total = 0.0
        for path in itertools.product(range(4), repeat=len(shape)):
            p = start[path[0]]
            for k, s in enumerate(path):
                p *= emit[s, "ANS".index(shape[k])] * (trans[path[k - 1], s] if k else 1)
            total += p
        assert np.isclose(hmm.log_likelihood(shape, start, trans, emit), np.log(total))
    assert hmm.log_likelihood("", start, trans, emit) == 0.0
    assert hmm.log_likelihood("S", start, trans, np.array([[0.5, 0.5, 0.0]] * 4)) == -np.inf


def test_training_raises_likelihood():
    shapes, counts = ["NNNN", "NNN", "NNNNN"], [10, 5, 5]
    few, many = hmm.baum_welch(shapes, counts, iterations=1), hmm.baum_welch(shapes, counts, iterations=60)
    like = lambda m: sum(n * hmm.log_likelihood(s, *m) for s, n in zip(shapes, counts, strict=True))
    assert like(many) > like(few)
    assert hmm.log_likelihood("NNNN", *many) > -0.1 > -2.2 > hmm.log_likelihood("SSAA", *many)


def test_detection(frame):
    train = frame([(k, "GET", f"/a?id={1000 + k}", "", 0) for k in range(20)] + [(99, "GET", "/a?id=<x>", "", 1)], "id int, method string, url string, body string, label int")
    models = structure.train(train)
    assert [(r.identifier, r.param, r.n_values) for r in models.collect()] == [("GET|a|id", "id", 20)]
    test = frame([(1, "GET", "/a?id=1234", "", 0), (2, "GET", "/a?id=<script>", "", 1), (3, "GET", "/new?id=1", "", 0), (4, "GET", "/a?id=77", "", 1)], train.schema)
    got = {r.id: r for r in structure.detect(test, models).collect()}
    assert {k: (r.verdict, r.anomaly_params) for k, r in got.items()} == {1: ("normal", []), 2: ("attack", ["id"]), 3: ("unknown_structure", []), 4: ("normal", [])}
    assert [got[k].false_negative for k in (1, 2, 3, 4)] == [False, False, False, True]
    assert structure.counters(structure.detect(test, models)).first().asDict() == {"tp": 1, "fp": 1, "tn": 1, "fn": 1, "unknown": 1, "total": 4}


def test_nearest_in_blocks(spark, frame):
    random.seed(5)
    rows = [(k, [random.randint(0, 3) * 1.0 for _ in range(3)], k % 3) for k in range(60)]
    store = frame(rows, "vec_id long, embedding array<float>, label int")
    queries = store.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {q: [v for _, v in sorted((round(float(np.linalg.norm(np.subtract(rows[q][1], e))), 9), v) for v, e, _ in rows)][:6] for q in range(10)}
    for block in (2_000, 3):
        got = retrieve.nearest(queries, store, block=block).orderBy("query_id", "rank").collect()
        assert {q: [r.vec_id for r in got if r.query_id == q] for q in range(10)} == want


def test_metrics(frame):
    rows = frame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 10)], "y_true int, y_pred int")
    got = {r.label: r for r in evaluate.report(rows, n=3).collect()}
    assert (got["0"].precision, got["0"].recall, got["1"].precision, got["2"].recall) == (1.0, 0.5, 0.5, 0.5)
    assert got["macro avg"].support == 5
    b = evaluate.binary(rows).first()
    assert (b.accuracy, b.errors, b.total) == (0.8, 1, 5)
    assert evaluate.best_metric(frame([(0.9, 1), (0.8, 2), (0.95, 3), (0.95, 4)], "kpi double, epoch int")).first()[:] == (0.95, 3)


def test_length_bins(frame):
    got = {r.bin: r.n for r in evaluate.length_histogram(frame([(3999,), (4000,), (20000,), (None,)], "n long"), "n").collect()}
    assert got == {"0-4000": 1, "4001-8600": 1, "8601-10000": 0, "10001-12000": 0, "12000+": 1}


def _literal_clusters(texts):
    """Merges the closest active pair again and again, over a dense matrix."""
    n = len(texts)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    d = {(i, j): lev(texts[i], texts[j]) for i in range(n) for j in range(i + 1, n) if 0.667 <= len(texts[i]) / len(texts[j]) <= 1.5}
    d = {k: v for k, v in d.items() if v < (len(texts[k[0]]) + len(texts[k[1]])) / 4}
    ids, active = list(range(n)), [True] * n
    while True:
        free = [(v, i, j) for (i, j), v in d.items() if active[i] and active[j]]
        if not free:
            return d, ids
        _, i, j = min(free)
        a, b = min(ids[i], ids[j]), max(ids[i], ids[j])
        ids = [a if x == b else x for x in ids]
        active[j] = False


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_clusters(frame, seed):
    if seed is None:
        texts = ["/../../boot.ini", "/../../boot.inx", "/etc/passwd", "/etc/passwd1", "id=1' or 1=1"]
    else:
        random.seed(seed)
        base = ["".join(random.choice("abc") for _ in range(10)) for _ in range(5)]
        texts = [(lambda s, k: s[:k] + random.choice("abcd") + s[k + random.randint(0, 2) :])(random.choice(base), random.randint(0, 9)) for _ in range(30)]
    pairs, want = _literal_clusters(texts)
    rows = frame(list(enumerate(texts)), "idx long, text string")
    edges = signatures.similar_pairs(rows)
    assert {(r.i, r.j): r.d for r in edges.collect()} == pairs
    assert {r.idx: r.cluster for r in signatures.clusters(rows, edges).collect()} == dict(enumerate(want))


def test_signatures_and_rules(frame):
    rows = frame([(0, "<script>alert(1)</script>", 0), (1, "<script>alert(22)</script>", 0), (2, "x", 2), (3, "/", 3)], "idx long, text string, cluster long")
    found = signatures.signatures(rows)
    assert {r.cluster: (r.size, r.signature) for r in found.collect()} == {0: (2, r"<script>alert\(.*\)</script>"), 2: (1, "x")}
    marked = {r.cluster: (r.is_short, r.is_part) for r in signatures.bucketed(found).collect()}
    assert marked == {0: (False, False), 2: (True, False)}
    rule = signatures.rules(found.filter("cluster = 0"), F.lit("Types: Query:id, Path"), [F.col("cluster")]).first()
    assert rule.rule_id == 1_000_000 and rule.rule.startswith('SecRule ARGS_GET:id|REQUEST_FILENAME "@rx <script>') and "status:403" in rule.rule


@pytest.mark.parametrize(("line", "want"), [("Types: Query:id, Path", "ARGS_GET:id|REQUEST_FILENAME"), ("Types: Query:a$b, Query:id", "ARGS|REQUEST_BODY|ARGS|REQUEST_BODY"), ("Types: others", "REQUEST_URI"), ("Types: Body:q", "ARGS_POST:q")])
def test_rule_targets(spark, line, want):
    assert spark.range(1).select(signatures.rule_targets(F.lit(line)).alias("t")).first().t == want


def test_containment(frame):
    texts = ["abcdefghij", "xxabcdefghijyy", "bcd", "zzz", "abcdefghij", "q"]
    got = {r.s for r in signatures.contained(frame([(t,) for t in texts], "s string"), "s").collect()}
    assert got == {"abcdefghij", "bcd"}


def test_sizes_outlier_representative(frame):
    got = {r.bin: r.n for r in signatures.size_histogram(frame([(1,), (2,), (4,), (500,)], "size long")).collect()}
    assert got == {"1-1": 1, "2-2": 1, "3-5": 1, "6-10": 0, "11-20": 0, "21-50": 0, "51-100": 0, "101+": 1}
    members = frame([(0, k, t) for k, t in enumerate(["aaaa", "aaab", "aaac", "aaad", "aaae", "zzzzzzzz"])], "cluster long, idx long, text string")
    assert signatures.without_outlier(members).filter("idx = 5").count() == 0
    d = frame([(0, 0, 1, 1.0), (0, 1, 0, 1.0), (0, 0, 2, 5.0), (0, 2, 0, 5.0), (0, 1, 2, 1.0), (0, 2, 1, 1.0)], "cluster long, i long, j long, d double")
    assert signatures.representative(members.filter("idx < 3"), d).first().idx == 1


def test_dashboard(frame):
    rows = frame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:05", "b"), ("2024-01-01 00:00:31", "a"), (None, "c")], "t string, k string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.n for r in dashboard.counted(rows, "ts", 10).orderBy("bin").collect()] == [2, 0, 0, 1]
    assert dashboard.counted(rows, "ts", 10, fill=False).count() == 2
    assert dashboard.width_for(rows, "ts") == 60
    assert {r.k: r.t for r in dashboard.keep_last(rows.filter("t is not null"), ["k"], [F.col("ts")]).collect()} == {"a": "2024-01-01 00:00:31", "b": "2024-01-01 00:00:05"}
    assert dashboard.searched(rows, ["k"], "A|B").count() == 3 and dashboard.searched(rows, ["k"], ".", regex=False).count() == 0
    assert [(r.k, r.n) for r in dashboard.top_counts(rows, "k").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert [(r.k, r.place) for r in dashboard.page(rows.filter("t is not null"), 1, [F.col("ts")], 2).collect()] == [("a", 2)]
    assert dashboard.retained(rows, "ts", F.lit("2024-01-08 00:00:05").cast("timestamp")).count() == 2
    assert round(dashboard.axis_bound(dashboard.counted(rows, "ts", 10)).first().bound, 6) == 2.4


def test_verdicts(frame):
    rows = frame([(200, 7), (403, 7), (500, 7), (None, 7)], "status int, label int")
    assert [r.v for r in rows.select(dashboard.verdict_of(F.col("status"), F.col("label"), unexpected="label").alias("v")).collect()] == [0, 1, 7, -1]
    assert [r.v for r in rows.select(dashboard.verdict_of(F.col("status"), F.col("label")).alias("v")).collect()] == [0, 1, None, -1]


def test_router(frame):
    got = dashboard.router_lags(frame([("t", 0, 10, 4), ("t", 1, 9, 8), ("t", 2, 3, -1001)], "topic string, partition int, high long, committed long"))
    assert [(r.partition, r.lag) for r in got.collect()] == [(1, 0)]


def test_inference(spark, frame):
    tasks = inference.prepared(frame([("/a?x=1",), ("/b?y=' or 1=1",)], "request string"), [F.col("request")])
    assert sorted((r.task_id, r.state) for r in tasks.collect()) == [(1, "ready"), (2, "ready")]
    store = inference.embedded(frame([(k, f"case {k}", "x") for k in range(8)], "vec_id long, page_content string, attack_category string"), "page_content", inference.hash_encoder)
    got = {r.request: r for r in inference.two_stage(tasks, inference.echo_client, inference.hash_encoder, store).collect()}
    assert got["/a?x=1"].attack_type == "normal" and got["/a?x=1"].related == []
    assert got["/b?y=' or 1=1"].attack_type == "SQL Injection" and len(got["/b?y=' or 1=1"].related) == 6
    done = inference.direct(tasks, inference.echo_client)
    assert done.filter("state = 'completed'").count() == 2 and inference.remaining(tasks, done).count() == 0
    assert inference.one_stage(tasks, inference.echo_client, inference.hash_encoder, store).count() == 2
    assert inference.realtime_results(done).count() == 1
    assert inference.chat_template("Qwen2.5-7B") == "qwen" and inference.chat_template("x") == "plain"


def test_shuffle_is_seeded(spark):
    order = lambda seed, n: [r.id for r in dashboard.shuffled(spark.range(50).repartition(n), seed).collect()]
    assert order(1, 2) == order(1, 5) != order(2, 2) and sorted(order(1, 2)) == list(range(50))


def test_nearest_against_brute_force(frame, monkeypatch):
    """Blocks, rounds, ties, null vectors and repeated rows."""
    import random

    monkeypatch.setattr(retrieve, "BLOCK", 7)
    monkeypatch.setattr(retrieve, "ROUND", 200)
    rng = random.Random(3)
    store = [(k, [float(rng.randint(0, 3)) for _ in range(4)]) for k in range(60)] + [(99, None), (5, [1.0, 1.0, 1.0, 1.0])]
    queries = [(q, store[q][1]) for q in range(0, 60, 4)]
    got = retrieve.nearest(frame(queries, "query_id bigint, embedding array<double>"), frame(store, "vec_id bigint, embedding array<double>"), 5).collect()
    for q, v in queries:
        want = sorted((round(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)) ** 0.5, 9), i) for i, w in store if w)[:5]
        assert [(r.distance, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_by_position(frame):
    left, right = frame([(3,), (1,), (2,)], "a int"), frame([("x",), ("z",), ("y",)], "b string")
    got = evaluate.by_position(left, right, [F.col("a")], [F.col("b")])
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError):
        evaluate.by_position(left, right.limit(2), [F.col("a")], [F.col("b")])


def test_merged_lists(frame):
    a, b = frame([("a", ["a", "b"]), ("b", ["10"])], "key string, values array<string>"), frame([("c", ["1"]), ("a", ["bb"]), ("b", ["z"])], "key string, values array<string>")
    assert {r.key: r["values"] for r in vocabulary.merged_lists(a, b).collect()} == {"a": ["a", "b", "bb"], "b": ["10", "z"], "c": ["1"]}


def test_clusters_of_chains_and_ties(frame):
    """Edges in an order in which a node is taken, or saved, by what came before."""
    edges = [(0, 1, 3), (1, 2, 1), (2, 3, 2), (0, 3, 3), (3, 4, 1), (4, 5, 1), (1, 5, 4), (6, 7, 0)]
    up = {}
    for i, j, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if i not in up and j not in up:
            up[j] = i
    got = signatures.merged(frame(edges, "i long, j long, d int"))
    assert {r.node: r.into for r in got.collect()} == up
    rows = frame([(k, str(k)) for k in range(8)], "idx long, text string")

    def top(x):
        while x in up:
            x = up[x]
        return x

    got = signatures.clusters(rows, frame(edges, "i long, j long, d int"))
    assert {r.idx: r.cluster for r in got.collect()} == {k: top(k) for k in range(8)}
    none = frame([], "i long, j long, d int")
    assert {r.idx: r.cluster for r in signatures.clusters(rows, none).collect()} == {k: k for k in range(8)}


def test_signatures_of_many_tasks(frame):
    """Tasks at once give what each alone gives; findings of one task don't meet those of another."""
    texts = ["/../../boot.ini?x=1", "/../../boot.inx?x=1", "<script>alert(1)</script>", "<script>alert(22)</script>", "id=1' or 1=1 union", " "]
    done = [(t, n, x, "completed" if n != 4 or t else "ready") for t in (0, 1, 2) for n, x in enumerate(texts)]
    tasks = frame(done, "run long, n long, predicted_malicious string, state string")
    rows = signatures.abnormal_parts(tasks)
    assert {(r.type, r.text.strip() != "") for r in rows.collect()} == {("others", True)}
    assert rows.count() == 3 * 5 - 1
    cols = ["run", "size", "members", "types", "signature", "is_short", "is_part"]
    together = signatures.signatures_of_tasks(rows, "run", "n").select(cols).collect()
    apart = [r for t in (0, 1, 2) for r in signatures.signatures_of_tasks(rows.filter(f"run = {t}"), "run", "n").select(cols).collect()]
    assert sorted(map(str, together)) == sorted(map(str, apart))
    assert {r.run for r in together} == {0, 1, 2}


def test_contained_short_and_long(frame):
    random.seed(5)
    words = ["".join(random.choice("ab") for _ in range(random.randint(1, 14))) for _ in range(60)]
    want = {s for s in words if any(s != t and s in t for t in words)}
    assert {r.s for r in signatures.contained(frame([(w,) for w in words] + [("",), (None,)], "s string"), "s").collect()} == want


def test_templates_tokens_and_stamps(frame):
    assert inference.named_template("LLM-Research/Llama-3.2-3B-Instruct") == "llama3_2"
    assert inference.named_template("x/Llama_3-8b-y") == "llama3" and inference.named_template("Qwen2.5") is None
    rows = inference.with_tokens(frame([("a b",), (None,), ("",)], "t string"), "t", lambda xs: [len(x.split()) for x in xs])
    assert sorted(r.n_tokens for r in rows.collect()) == [0, 0, 2]
    from datetime import datetime

    from gatewarden.functions import text

    assert datetime.fromisoformat(frame([(1,)], "x int").select(text.iso_now().alias("t")).first().t).year >= 2024


def test_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from gatewarden.functions import lineage

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(session)
