"""Requests by structure: identifiers, parameters, and verdicts from per-parameter sequence models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.functions.text import let, query_map_keys, query_pairs, sigmoid, text, url_parts, value_shape
from gatewarden.operators.hmm import MODEL, fit_groups, score

MIN_VALUES, THRESHOLD = 5, 0.1


def _json_body(headers: Column, body: Column) -> Column:
    kind = F.lower(text(F.coalesce(F.try_element_at(headers, F.lit("Content-Type")), F.try_element_at(headers, F.lit("content-type")))))
    return kind.contains("application/json") & F.try_parse_json(body).isNotNull()


def json_values(body: Column) -> Column:
    """(key, value) of a JSON object's members, in order of key; none for anything else."""
    members = F.from_json(body, "map<string,string>")
    pairs = F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.when(text(body).rlike(r"(?s)^\s*\{"), F.array_sort(F.coalesce(pairs, none))).otherwise(none)


def identifier(method: Column, url: Column, body: Column | None = None, headers: Column | None = None) -> Column:
    """METHOD|path|keys: the path without outer slashes in lower case and inner ones as underscores, the sorted names of
    the query's parameters for GET and of the body's for other methods."""
    verb = F.upper(text(method))
    split = url_parts(url)

    def of(u: Column) -> Column:
        path = F.replace(F.regexp_replace(F.lower(u["path"]), "^/+|/+$", ""), F.lit("/"), F.lit("_"))
        keys = query_map_keys(u["query"])
        if body is not None:
            own = query_map_keys(body)
            if headers is not None:
                names = F.array_sort(F.array_distinct(F.transform(json_values(body), lambda p: p["key"])))
                own = F.when(F.coalesce(_json_body(headers, body), F.lit(False)), names).otherwise(own)
            keys = F.when(verb == "GET", keys).otherwise(own)
        return F.concat_ws("|", verb, path, F.array_join(keys, "_"))

    return let(split, of)


def identified(requests: DataFrame, json: bool = False) -> DataFrame:
    """``requests`` (method, url, body) with their identifier; ``json`` reads JSON bodies by the Content-Type header."""
    headers = F.col("headers") if json else None
    return requests.withColumn("identifier", identifier(F.col("method"), F.col("url"), F.col("body"), headers))


def parameters(identified: DataFrame, json: bool = False) -> DataFrame:
    """A row for each parameter value: the query's first, then the body's."""
    pairs = F.concat(query_pairs(url_parts(F.col("url"))["query"]), query_pairs(F.col("body")))
    if json:
        pairs = F.concat(pairs, json_values(F.col("body")))
    return identified.withColumn("_p", F.explode(pairs)).select(*identified.columns, F.col("_p.key").alias("param"), F.col("_p.value").alias("value"))


def train(requests: DataFrame, min_values: int = MIN_VALUES, **options) -> DataFrame:  # noqa: ANN003
    """Models (identifier, param, ...) from requests labelled 0, for parameters with enough values.

    Distinct shapes with their counts are what a model needs; all of a parameter's train it.
    """
    rows = parameters(identified(requests.filter(F.col("label") == 0))).select("identifier", "param", value_shape(F.col("value")).alias("shape"))
    shapes = rows.groupBy("identifier", "param", "shape").agg(F.count("*").alias("n"))
    return fit_groups(shapes, ["identifier", "param"], min_values, **options)


def scored(requests: DataFrame, models: DataFrame) -> DataFrame:
    """(id, identifier, param, value, logp) of parameter values that have a model. Distinct shapes are scored once."""
    values = parameters(identified(requests)).select("id", "identifier", "param", "value", value_shape(F.col("value")).alias("shape"))
    shapes = values.select("identifier", "param", "shape").distinct().join(models, ["identifier", "param"])
    logs = score(shapes, "shape").select("identifier", "param", "shape", "logp")
    return values.join(logs, ["identifier", "param", "shape"]).drop("shape")


def is_anomalous(logp: Column, threshold: float = THRESHOLD, compat: bool = False) -> Column:
    """Whether the probability of a log-likelihood is under the threshold, as a bound on the logarithm.

    With ``compat``, a likelihood too small for a double's exponent counts as normal instead.
    """
    low = logp < math.log(threshold / (1 - threshold))
    return low & (logp >= -709.78) if compat else low


def detect(requests: DataFrame, models: DataFrame, threshold: float = THRESHOLD, compat: bool = False) -> DataFrame:
    """``requests`` with identifier, verdict (unknown_structure, attack, normal), anomalous parameters and, for requests
    labelled as attacks that look normal, false_negative."""
    rows = identified(requests)
    known = models.select("identifier").distinct().withColumn("_known", F.lit(True))
    bad = scored(requests, models).filter(is_anomalous(F.col("logp"), threshold, compat))
    bad = bad.groupBy("id").agg(F.array_sort(F.collect_set("param")).alias("anomaly_params"))
    out = rows.join(known, "identifier", "left").join(bad, "id", "left")
    empty = F.array().cast("array<string>")
    params = F.coalesce("anomaly_params", empty)
    verdict = F.when(F.col("_known").isNull(), "unknown_structure").when(F.size(params) > 0, "attack").otherwise("normal")
    out = out.withColumn("anomaly_params", params).withColumn("verdict", verdict).drop("_known")
    return out.withColumn("false_negative", (F.col("verdict") == "normal") & (F.col("label") != 0))


def counters(detected: DataFrame) -> DataFrame:
    """TP, FP, TN, FN, unknown and total; unknown structures count as positive."""
    positive, bad = F.col("verdict") != "normal", F.col("label") != 0
    named = {"tp": positive & bad, "fp": positive & ~bad, "tn": ~positive & ~bad, "fn": ~positive & bad, "unknown": F.col("verdict") == "unknown_structure"}
    return detected.agg(*[F.count_if(c).alias(n) for n, c in named.items()], F.count("*").alias("total"))


__all__ = ["MODEL", "counters", "detect", "identified", "identifier", "is_anomalous", "parameters", "scored", "sigmoid", "train"]
