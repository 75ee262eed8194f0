"""Streaming: sources behind one function, detection, classification, counts; what is batch elsewhere is reused here.

Delivery is at least once: a stage's progress is its checkpoint, and sinks written by ``foreachBatch`` name their output
by the batch, so a repeated batch overwrites what it wrote before.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from gatewarden.functions.text import row_hash
from gatewarden.operators.inference import realtime_results
from gatewarden.operators.structure import detect
from gatewarden.sources.readers import REQUEST, parsed


def messages(spark: SparkSession, kind: str, place: str, topic: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A stream of (value) lines: from a folder of text files ("files") or a broker's topic ("kafka", from the earliest
    offset; needs the connector's jar). ``per_trigger`` bounds files or offsets a batch, which limits the rate."""
    if kind == "kafka":
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", place).option("subscribe", topic).option("startingOffsets", "earliest")
        if per_trigger:
            stream = stream.option("maxOffsetsPerTrigger", per_trigger)
        return stream.load().select(F.col("value").cast("string").alias("value"))
    stream = spark.readStream.schema("value string").format("text")
    if per_trigger:
        stream = stream.option("maxFilesPerTrigger", per_trigger)
    return stream.load(place)


def requests(stream: DataFrame, schema: str = REQUEST) -> DataFrame:
    """Messages as requests; unreadable ones have _corrupt_record."""
    return parsed(stream.withColumn("raw", F.col("value")), "value", False, schema).withColumn("event_time", F.try_to_timestamp("starttimestamp"))


def started(rows: DataFrame, checkpoint: str, once: bool = True, seconds: int = 5) -> DataStreamWriter:
    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` persisted as long as they are worked on, however that ends."""
    rows = rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def run_batches(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    return started(rows, checkpoint, once).foreachBatch(each).start()


def detection(rows: DataFrame, models: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Requests to verdicts: anomalies and unknown structures to ``out``/forward, all to ``out``/all, unreadable messages
    to ``out``/dead. The models are a static table."""

    def each(batch: DataFrame, number: int) -> None:
        with kept(batch) as batch:
            bad = batch.filter(F.col("_corrupt_record").isNotNull() | F.col("url").isNull())
            bad.select("raw").write.mode("overwrite").json(f"{out}/dead/batch={number}")
            good = batch.filter(F.col("_corrupt_record").isNull() & F.col("url").isNotNull()).drop("_corrupt_record")
            with kept(detect(good, models)) as found:
                found.write.mode("overwrite").json(f"{out}/all/batch={number}")
                found.filter(F.col("verdict") != "normal").write.mode("overwrite").json(f"{out}/forward/batch={number}")

    return run_batches(rows, each, checkpoint, once)


def classification(rows: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, attacks: str | None = None) -> StreamingQuery:
    """Forwarded requests through a language-model stage; results by batch, and those that are attacks in a folder of
    their own that grows by each batch. A batch's answers are asked for once."""

    def each(batch: DataFrame, number: int) -> None:
        with kept(classify(batch)) as found:
            found.write.mode("overwrite").json(f"{out}/batch={number}")
            if attacks:
                realtime_results(found).write.mode("overwrite").json(f"{attacks}/batch={number}")

    return run_batches(rows, each, checkpoint, once)


def windowed(rows: DataFrame, width: str = "10 seconds", late: str = "7 days", slide: str | None = None) -> DataFrame:
    """(bin, n) by event time; state older than ``late`` is dropped."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return rows.withWatermark("event_time", late).groupBy(window.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bin"), "n")


def deduplicated(rows: DataFrame, columns: list[str], late: str = "7 days") -> DataFrame:
    """Rows whose hash over ``columns`` is new; hashes are kept as long as the watermark allows."""
    return rows.withWatermark("event_time", late).withColumn("row_hash", row_hash(*[F.col(c) for c in columns])).dropDuplicatesWithinWatermark(["row_hash"])


def running_totals(rows: DataFrame, by: str) -> DataFrame:
    """Counters in complete mode."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def lag_records(current: str | None, latest: str | None, now: str) -> list[dict]:
    """Per topic and partition, the offset reached, the latest one and the messages between, from a source's offsets as
    JSON ({topic: {partition: offset}}); a partition not read yet is at -1 and has no lag. Sources of other forms: none."""
    try:
        reached, ends = json.loads(current or "{}"), json.loads(latest or "{}")
    except ValueError:
        return []
    out = []
    for topic, parts in ends.items() if isinstance(ends, dict) else ():
        if not isinstance(parts, dict):
            continue
        own = reached.get(topic, {}) if isinstance(reached, dict) else {}
        for part, end in sorted(parts.items(), key=lambda p: int(p[0])):
            at = own.get(part, -1)
            # As ``text.lag_of`` has it.
            lag = max(0, end - at - 1) if at >= 0 else 0
            out.append({"topic": topic, "partition": int(part), "current_offset": at, "latest_offset": end, "lag": lag, "timestamp": now})
    return out


class LagMonitor(StreamingQueryListener):
    """Keeps, for the last ``most`` batches of each source, the rows read and the offsets reached and available; with a
    ``log`` (a file on the driver), appends a line of JSON for each partition, at most every ``seconds``."""

    def __init__(self, log: str | None = None, seconds: float = 10, most: int = 1_000):
        self.records: deque[dict] = deque(maxlen=most)
        self.log, self.seconds, self._last = log, seconds, float("-inf")

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        lines = []
        for s in event.progress.sources:
            self.records.append({"batch": event.progress.batchId, "source": s.description, "rows": s.numInputRows, "current": s.endOffset, "latest": s.latestOffset})
            lines += lag_records(s.endOffset, s.latestOffset, event.progress.timestamp)
        if self.log and lines and time.monotonic() - self._last >= self.seconds:
            self._last = time.monotonic()
            with open(self.log, "a", encoding="utf-8") as f:
                f.writelines(json.dumps(x) + "\n" for x in lines)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def outgoing(rows: DataFrame, topic: str, value: Column, key: Column | None = None, partitions: DataFrame | None = None) -> DataFrame:
    """(topic, key, value, partition) for a broker's sink. ``partitions``, one row a topic (topic, partition), names where
    messages go, as ``dashboard.router_lags`` chooses it; without it, or where it has none, the broker chooses."""
    out = rows.select(F.lit(topic).alias("topic"), (F.lit(None).cast("string") if key is None else key).alias("key"), value.alias("value"))
    if partitions is None:
        return out.withColumn("partition", F.lit(None).cast("int"))
    chosen = partitions.select("topic", F.col("partition").cast("int").alias("partition"))
    return out.join(F.broadcast(chosen.filter(F.col("topic") == topic).limit(1)), "topic", "left")


def paced(spark: SparkSession, kind: str, place: str, per_second: int, seconds: int, topic: str | None = None) -> DataFrame:
    """Messages no faster than so many a second, if ``started`` with the same ``seconds``: offsets of a broker count as
    messages, files as files. A trigger takes what its seconds allow."""
    return messages(spark, kind, place, topic, per_second * seconds)


def smoke_messages(spark: SparkSession, n: int = 3) -> DataFrame:
    """(key, value): n messages to try a sink with."""
    number = F.col("id").cast("string")
    return spark.range(n).select(number.alias("key"), F.concat(F.lit("Message "), number).alias("value"))


def shown(stream: DataFrame, checkpoint: str, sink: str = "console", name: str = "shown", once: bool = True) -> StreamingQuery:
    """What comes in, on the console or in a table in memory."""
    return started(stream, checkpoint, once).format(sink).queryName(name).start()


def to_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """(value, optionally key and partition) to a broker's topic, once all its replicas have it; needs the connector's jar."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3"}
    return started(rows, checkpoint, once).format("kafka").options(**options).start()
