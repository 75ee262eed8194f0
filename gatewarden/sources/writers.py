"""Writers: requests, routed results, vocabularies, sequences, reports, rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.functions.text import LABELS, UNPARSED
from gatewarden.operators.vocabulary import vocabulary_file

MAX_TAGS = 10


def serialised(rows: DataFrame, to: str = "value") -> DataFrame:
    """Rows as JSON objects; extras are merged in again."""
    if "extras" not in rows.columns:
        return rows.select(F.to_json(F.struct("*")).alias(to))
    own = F.to_json(F.struct(*[c for c in rows.columns if c != "extras"]))
    merged = F.concat(F.expr("substring(__o, 1, length(__o) - 1)"), F.lit(","), F.substring("extras", 2, 1 << 30))
    return rows.withColumn("__o", own).select(F.when(F.length("extras") > 2, merged).otherwise(F.col("__o")).alias(to))


def dataset_path(folder: str, name: str, tags: list[str]) -> str:
    if len(tags) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    return f"{folder.rstrip('/')}/{'_'.join([name, *tags])}.jsonl"


def dump_requests(rows: DataFrame, path: str) -> None:
    serialised(rows).write.mode("overwrite").text(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary_file(vocabulary).coalesce(1).write.mode("overwrite").text(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    sequences.write.mode("overwrite").parquet(path)


def write_routed(rows: DataFrame, path: str, by: str = "verdict") -> None:
    """One folder for each value of a column."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def write_detections(detected: DataFrame, path: str) -> None:
    """All results, and those that are attacks, under one path."""
    detected.write.mode("overwrite").json(f"{path}/all")
    detected.filter(F.col("verdict") != "normal").write.mode("overwrite").json(f"{path}/attacks")


def dead_letters(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull())


def dump_tasks(tasks: DataFrame, path: str) -> None:
    """Tasks as JSON arrays, one a file, which ``readers.tasks`` reads back; a partition's array is written as it comes."""

    def as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            lines = []
            for value in batch.column(0).to_pylist():
                lines.append(before + value)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    tasks.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(as_array, "value string").write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rules in order, a blank line after each."""
    rules.orderBy("rule_id").select(F.concat("rule", F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def cluster_report(signatures: DataFrame) -> DataFrame:
    """Clusters from small to large with what a report says of each, and where it goes."""
    head = F.format_string("Cluster size: %d - Types: %s", F.col("size"), F.array_join("types", ", "))
    body = F.concat_ws("\n", head, F.array_join("members", "\n"), F.concat(F.lit("Generated Signature: "), F.col("signature")))
    bucket = F.when(F.col("is_short"), F.array(F.lit("short"))).when(F.col("is_part"), F.array(F.lit("part"), F.lit("normal"))).otherwise(F.array(F.lit("normal")))
    return signatures.select("cluster", "size", "signature", body.alias("text"), F.explode(bucket).alias("bucket")).orderBy("size", "cluster")


def is_reportable(label: Column) -> Column:
    return ~label.isin(0, LABELS.index("Others"), UNPARSED)
