"""Readers. Schemas are given, never inferred; unknown keys of a request are kept as a JSON text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.text import parse_head, strip, text

REQUEST = "id string, method string, url string, body string, headers map<string,string>, starttimestamp string, status_code int, label int"
DENIED = REQUEST + ", endtimestamp string"
TELECOM = "id string, method string, requestHeader string, protocolVersion string, severity string, requestStatus string, responseCode string"
TASK = "id string, engin string, model string, request struct<system:string,user:string>, metadata map<string,string>, state string, label int, response struct<assistant:string>, setting string"
RESULT = f"endtimestamp string, request_id string, raw_request struct<{REQUEST.replace(' ', ':').replace(',:', ',')}>, predicted_malicious string, final_analysis string, related_attacks array<string>, attack_type string"
#: Header parts by which known scanners give themselves away.
SCANNERS = ("sqlmap", "nikto", "acunetix", "nessus", "w3af", "netsparker")


def requests(spark: SparkSession, path: str, strict: bool = True, schema: str = REQUEST) -> DataFrame:
    """JSON lines of requests with ``dataset`` (the file's name up to its first dot) and ``extras``: keys outside the
    schema as JSON. ``strict`` fails on a malformed line; else it comes as ``_corrupt_record``."""
    raw = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("dataset"))
    raw = raw.filter(F.trim("value") != "")
    return parsed(raw, "value", strict, schema)


def parsed(rows: DataFrame, column: str, strict: bool = False, schema: str = REQUEST) -> DataFrame:
    """Rows of JSON objects as columns; what can't be read has nulls and its text in _corrupt_record."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    names = [f.strip().split(" ")[0] for f in _top(schema)]
    full = schema if strict else schema + ", _corrupt_record string"
    got = rows.withColumn("_r", F.from_json(column, full, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}))
    every = F.from_json(column, "map<string,string>")
    extras = F.map_filter(every, lambda k, v: ~k.isin(*names))
    others = [c for c in rows.columns if c != column]
    return got.select(*others, "_r.*", F.to_json(F.when(F.size(extras) > 0, extras)).alias("extras"))


def _top(schema: str) -> list[str]:
    """The fields of a schema's first level."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def folded(requests: DataFrame) -> DataFrame:
    """A non-empty body goes to the URL's query; bodies are null after."""
    url = F.when(text(F.col("body")) != "", F.concat(F.col("url"), F.lit("?"), F.col("body"))).otherwise(F.col("url"))
    return requests.withColumns({"url": url, "body": F.lit(None).cast("string")})


def form_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of requests whose bodies count as part of the URL."""
    return folded(requests(spark, path, schema="id string, method string, url string, body string"))


def telecom(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a vendor's format: the URL is the second word of the request header."""
    raw = spark.read.schema(TELECOM).json(path)
    url = parse_head(F.col("requestHeader"))["url"]
    return raw.select("id", "method", url.alias("url"), F.lit(None).cast("string").alias("body"), F.col("protocolVersion").alias("HTTPversion"), "severity", "requestStatus", "responseCode")


def header_table(spark: SparkSession, path: str, content: str = "all", limit: int | None = None, scanners: tuple[str, ...] = SCANNERS) -> DataFrame:
    """A Parquet folder of (header, body, id) as (method, content, id); a scanner's header is an error."""
    rows = spark.read.parquet(path)
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    head = parse_head(F.col("header"))
    body = text(F.col("body"))
    what = {"url": head["url"], "body": body, "all": strip(F.concat(head["url"], F.lit(" "), body))}[content]
    bad = F.lower("header").rlike("|".join(scanners))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("scanner header in row "), F.col("id").cast("string")))).otherwise(head["method"])
    return rows.select(checked.alias("method"), what.alias("content"), "id")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, stripped; empty ones are kept."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value"))


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of tasks, one or more files."""
    return spark.read.schema(TASK).option("multiLine", True).json(path)


def labelled(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """Requests with labels; ``binary`` makes every label but 0 a 1."""
    rows = requests(spark, path)
    return rows.withColumn("label", (F.col("label") != 0).cast("int")) if binary else rows


def models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding, page_content, attack_category)."""
    return spark.read.parquet(path)


def basic_rows(rows: DataFrame, column: str = "value") -> DataFrame:
    """(timestamp, status_code) of raw JSON lines: the request's own time before the line's, status 200 by default."""
    field = lambda p: F.nullif(F.get_json_object(column, p), F.lit(""))
    time = F.coalesce(field("$.raw_request.starttimestamp"), field("$.starttimestamp"))
    ok = F.try_parse_json(F.col(column)).isNotNull()
    out = rows.filter(ok).select(F.try_to_timestamp(time).alias("timestamp"), F.coalesce(field("$.status_code").try_cast("int"), F.lit(200)).alias("status_code"))
    return out


def analysis_rows(rows: DataFrame, column: str = "value") -> DataFrame:
    """(timestamp, request, predict_malicious, prediction_result, llm_output) of result lines."""
    from gatewarden.functions.text import LABELS, raw_request

    ok = F.try_parse_json(F.col(column)).isNotNull()
    field = lambda p: F.get_json_object(column, p)
    kind = F.lower(field("$.attack_type"))
    named = F.coalesce(*[F.when(kind == x.lower(), x) for x in LABELS], F.initcap(kind))
    time = F.coalesce(F.nullif(field("$.raw_request.starttimestamp"), F.lit("")), F.nullif(field("$.starttimestamp"), F.lit("")))
    return rows.filter(ok).select(
        F.try_to_timestamp(time).alias("timestamp"),
        raw_request(field("$.raw_request.method"), field("$.raw_request.url"), field("$.raw_request.body")).alias("request"),
        field("$.predicted_malicious").alias("predict_malicious"),
        named.alias("prediction_result"),
        field("$.final_analysis").alias("llm_output"),
    )


def newest_first(report: DataFrame, order: str = "row_idx") -> DataFrame:
    return report.orderBy(F.desc(order))


@dataclass
class Config:
    """Options by name, read as attributes."""

    values: dict

    def __getattr__(self, name: str):  # noqa: ANN204
        try:
            value = self.values[name]
        except KeyError:
            raise AttributeError(name) from None
        return Config(value) if isinstance(value, dict) else value


def load_config(path: str) -> Config:
    """A configuration file: YAML where that library is installed, else JSON (which is YAML too)."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return Config(json.loads(content))
    return Config(yaml.safe_load(content))
