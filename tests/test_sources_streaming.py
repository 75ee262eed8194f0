import json

import pytest
from pyspark.sql import functions as F

from gatewarden.operators import dashboard, inference, structure
from gatewarden.sources import readers, writers
from gatewarden.streaming import stages


def _write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_requests_keep_extras(spark, tmp_path):
    p = _write(tmp_path / "train.v1.jsonl", [{"id": 1, "method": "GET", "url": "/a", "body": None, "label": 0, "caseid": "c1"}])
    r = readers.requests(spark, p).first()
    assert (r.dataset, r.id, r.url, r.label, json.loads(r.extras)) == ("train", "1", "/a", 0, {"caseid": "c1"})
    out = str(tmp_path / "out")
    writers.dump_requests(readers.requests(spark, p).drop("dataset"), out)
    again = json.loads(spark.read.text(out).first().value)
    assert again["caseid"] == "c1" and again["url"] == "/a"


def test_malformed_lines(spark, tmp_path):
    p = _write(tmp_path / "x.jsonl", [{"method": "GET", "url": "/a"}, "{broken"])
    rows = readers.requests(spark, p, strict=False).collect()
    assert [r._corrupt_record for r in rows] == [None, "{broken"]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.requests(spark, p).collect()


def test_form_and_vendor_formats(spark, tmp_path):
    p = _write(tmp_path / "c.jsonl", [{"id": 1, "method": "POST", "url": "/a", "body": "x=1"}, {"id": 2, "method": "GET", "url": "/b", "body": ""}])
    assert [(r.url, r.body) for r in readers.form_requests(spark, p).collect()] == [("/a?x=1", None), ("/b", None)]
    p = _write(tmp_path / "t.jsonl", [{"id": 1, "method": "GET", "requestHeader": "GET /x?y HTTP/1.1", "protocolVersion": "1.1", "severity": "3"}])
    r = readers.telecom(spark, p).first()
    assert (r.url, r.HTTPversion, r.severity) == ("/x?y", "1.1", "3")


def test_header_table(spark, frame, tmp_path):
    frame([(0, "GET /a HTTP/1.1", None), (1, "POST /b HTTP/1.1", "x")], "id long, header string, body string").write.parquet(str(tmp_path / "h"))
    assert [(r.method, r.content) for r in readers.header_table(spark, str(tmp_path / "h")).orderBy("id").collect()] == [("GET", "/a"), ("POST", "/b x")]
    frame([(0, "GET /a UA: sqlmap/1", None)], "id long, header string, body string").write.parquet(str(tmp_path / "s"))
    with pytest.raises(Exception, match="scanner"):
        readers.header_table(spark, str(tmp_path / "s")).collect()


def test_tasks_lines_config(spark, tmp_path):
    (tmp_path / "task.jsonl").write_text(json.dumps([{"id": "1", "state": "ready", "request": {"system": "s", "user": "u"}}, {"id": "2", "state": "completed"}], indent=4))
    assert [(r.id, r.state) for r in readers.tasks(spark, str(tmp_path / "task.jsonl")).collect()] == [("1", "ready"), ("2", "completed")]
    (tmp_path / "l.txt").write_text(" a \n\n\tb\n")
    assert [r.value for r in readers.lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "", "b"]
    (tmp_path / "c.yaml").write_text('{"model": {"states": 4}, "name": "x"}')
    c = readers.load_config(str(tmp_path / "c.yaml"))
    assert c.model.states == 4 and c.name == "x"
    with pytest.raises(AttributeError):
        c.other  # noqa: B018


def test_dashboard_rows(frame):
    rows = frame([('{"starttimestamp":"2024-01-01T00:00:00","raw_request":{"starttimestamp":"","method":"GET","url":"/a"},"attack_type":"cross-site scripting"}',), ("{bad",), ('{"raw_request":{"starttimestamp":"2024-01-02T00:00:00"},"status_code":403}',)], "value string")
    got = readers.basic_rows(rows).collect()
    assert [(str(r.timestamp), r.status_code) for r in got] == [("2024-01-01 00:00:00", 200), ("2024-01-02 00:00:00", 403)]
    a = readers.analysis_rows(rows).first()
    assert (a.request, a.prediction_result) == ("GET /a", "Cross-site Scripting")


def test_writers(spark, frame, tmp_path):
    assert writers.dataset_path("/d", "n", ["a", "b"]) == "/d/n_a_b.jsonl"
    rows = frame([(1, "x", None), (2, None, "bad")], "id int, v string, error string")
    good, bad = writers.dead_letters(rows)
    assert (good.count(), bad.count()) == (1, 1)
    writers.write_vocabulary(frame([("b",), ("a",)], "token string"), str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()] == ["<unk>", "<s>", "</s>", "a", "b"]
    s = frame([(1, 2, ["m"], ["others"], "abc", True, False), (2, 1, ["m"], ["others"], "long one", False, True)], "cluster long, size long, members array<string>, types array<string>, signature string, is_short boolean, is_part boolean")
    assert sorted((r.cluster, r.bucket) for r in writers.cluster_report(s).collect()) == [(1, "short"), (2, "normal"), (2, "part")]
    writers.write_routed(frame([("a", 1), ("b", 2)], "verdict string, x int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_detection_stream_matches_batch(spark, frame, tmp_path):
    train = frame([(k, "GET", f"/a?id={1000 + k}", "", 0) for k in range(12)], "id int, method string, url string, body string, label int")
    models = structure.train(train)
    models.write.parquet(str(tmp_path / "models"))
    models = readers.models(spark, str(tmp_path / "models"))
    (tmp_path / "in").mkdir()
    rows = [{"id": "1", "method": "GET", "url": "/a?id=12", "label": 0, "starttimestamp": "2024-01-01T00:00:01"}, {"id": "2", "method": "GET", "url": "/a?id=<x>", "label": 1, "starttimestamp": "2024-01-01T00:00:09"}, "{broken", {"id": "3", "method": "GET", "url": "/new", "label": 0, "starttimestamp": "2024-01-01T00:00:31"}]
    _write(tmp_path / "in" / "a.txt", rows)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = stages.requests(stages.messages(spark, "files", str(tmp_path / "in"), per_trigger=1))
    stages.detection(stream, models, out, checkpoint).awaitTermination()
    assert {r.id: r.verdict for r in spark.read.json(f"{out}/all").collect()} == {"1": "normal", "2": "attack", "3": "unknown_structure"}
    assert spark.read.json(f"{out}/forward").count() == 2 and spark.read.json(f"{out}/dead").count() == 1
    _write(tmp_path / "in" / "b.txt", [rows[0] | {"id": "9"}])
    stages.detection(stream, models, out, checkpoint).awaitTermination()  # goes on from the checkpoint
    assert spark.read.json(f"{out}/all").count() == 4


def test_stream_counts_and_dedup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": str(k), "url": "/a", "starttimestamp": f"2024-01-01T00:00:{s:02d}"} for k, s in ((1, 1), (2, 5), (2, 5), (3, 31))]
    _write(tmp_path / "in" / "a.txt", rows)
    stream = stages.requests(stages.messages(spark, "files", str(tmp_path / "in")))
    for name, df, mode in (("bins", stages.windowed(stream), "complete"), ("uniq", stages.deduplicated(stream, ["id"]).select("id"), "append"), ("tot", stages.running_totals(stream, "id"), "complete")):
        stages.started(df, str(tmp_path / f"cp_{name}")).format("memory").queryName(name).outputMode(mode).start().awaitTermination()
    batch = dashboard.counted(spark.createDataFrame([(r["starttimestamp"],) for r in rows], "t string").withColumn("ts", F.col("t").cast("timestamp")), "ts", 10, fill=False)
    assert sorted(map(tuple, spark.table("bins").collect())) == sorted(map(tuple, batch.collect()))
    assert sorted(r.id for r in spark.table("uniq").collect()) == ["1", "2", "3"]
    assert {r.id: r.n for r in spark.table("tot").collect()} == {"1": 1, "2": 2, "3": 1}


def test_unknown_source_needs_connector(spark):
    with pytest.raises(Exception, match="kafka"):
        stages.messages(spark, "kafka", "localhost:9092", "waf")


def test_tasks_round_trip(spark, frame, tmp_path):
    """What is dumped is read back, from files of several rows, of one, and of none."""
    rows = [(str(k), "ready" if k % 2 else "completed", k) for k in range(6)]
    for parts in (1, 4, 8):
        tasks = frame(rows, "id string, state string, label int").repartition(parts)
        writers.dump_tasks(tasks, str(tmp_path / f"tasks{parts}"))
        got = readers.tasks(spark, str(tmp_path / f"tasks{parts}")).filter("id IS NOT NULL")
        assert sorted((r.id, r.state, r.label) for r in got.collect()) == rows


def test_lag_records_and_log(tmp_path):
    latest = '{"hmm": {"0": 10, "1": 5, "2": 3}}'
    got = stages.lag_records('{"hmm": {"0": 4, "1": 5}}', latest, "t")
    assert [(r["partition"], r["current_offset"], r["latest_offset"], r["lag"]) for r in got] == [(0, 4, 10, 5), (1, 5, 5, 0), (2, -1, 3, 0)]
    assert stages.lag_records("FileStreamSource", '{"logOffset": 1}', "t") == [] and stages.lag_records(None, None, "t") == []
    from types import SimpleNamespace

    source = SimpleNamespace(description="k", numInputRows=1, endOffset='{"hmm": {"0": 4}}', latestOffset=latest)
    event = SimpleNamespace(progress=SimpleNamespace(sources=[source], batchId=1, timestamp="t"))
    monitor = stages.LagMonitor(str(tmp_path / "lag.jsonl"), seconds=60, most=2)
    for _ in range(3):
        monitor.onQueryProgress(event)
    lines = [json.loads(x) for x in (tmp_path / "lag.jsonl").read_text().splitlines()]
    assert len(lines) == 3 and len(monitor.records) == 2 and lines[0]["topic"] == "hmm"


def test_messages_to_chosen_partitions(spark, frame):
    offsets = frame([("hmm", 0, 10, 4), ("hmm", 1, 10, 8), ("waf", 0, 5, 5)], "topic string, partition int, high long, committed long")
    rows = frame([("k", "v")], "k string, v string")
    to = lambda topic: stages.outgoing(rows, topic, F.col("v"), F.col("k"), dashboard.router_lags(offsets)).first()
    assert to("hmm").asDict() == {"topic": "hmm", "key": "k", "value": "v", "partition": 1}
    assert to("waf").partition == 0 and to("other").partition is None
    assert stages.outgoing(rows, "hmm", F.col("v")).first().partition is None


def test_smoke_pair(spark, tmp_path):
    stages.smoke_messages(spark).select("value").write.text(str(tmp_path / "in"))
    stream = stages.paced(spark, "files", str(tmp_path / "in"), per_second=1, seconds=2)
    stages.shown(stream, str(tmp_path / "cp"), "memory", "smoke").awaitTermination()
    assert sorted(r.value for r in spark.table("smoke").collect()) == ["Message 0", "Message 1", "Message 2"]


def test_classification_asks_once_and_writes_attacks(spark, frame, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "a.txt", [{"id": "1", "url": "/a?x=<b>"}, {"id": "2", "url": "/plain"}])
    stream = stages.requests(stages.messages(spark, "files", str(tmp_path / "in")))

    def classify(batch):
        rows = batch.select("id", F.col("url").alias("request"), F.lit(None).cast("string").alias("response"))
        return inference.direct(rows, inference.echo_client)

    stages.classification(stream, classify, str(tmp_path / "out"), str(tmp_path / "cp"), attacks=str(tmp_path / "attacks")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert [r.id for r in spark.read.json(str(tmp_path / "attacks")).collect()] == ["1"]


def test_persisted_rows_are_freed_on_failure(frame):
    rows = frame([(1,)], "x int")
    with pytest.raises(ValueError), stages.kept(rows) as held:
        assert held.is_cached
        raise ValueError
    assert not rows.is_cached
