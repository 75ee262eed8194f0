"""Metrics of predicted against true labels; everything is an aggregation to a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.operators.vocabulary import numbered
from gatewarden.functions.text import LABELS, UNPARSED, label_id, label_name, request_lines


def confusion(rows: DataFrame, y: str = "y_true", p: str = "y_pred", n: int = len(LABELS)) -> DataFrame:
    """(y, p0..., total, r0...): counts by true and predicted label of 0 to n - 1, and shares of the true label's rows."""
    inside = rows.filter(F.col(y).between(0, n - 1) & F.col(p).between(0, n - 1))
    counts = inside.groupBy(F.col(y).alias("y")).agg(*[F.count_if(F.col(p) == k).alias(f"p{k}") for k in range(n)], F.count("*").alias("total"))
    return counts.select("*", *[F.round(F.col(f"p{k}") / F.col("total"), 4).alias(f"r{k}") for k in range(n)])


def report(rows: DataFrame, y: str = "y_true", p: str = "y_pred", n: int = len(LABELS), digits: int = 4) -> DataFrame:
    """(label, precision, recall, f1, support) of each label, then macro and weighted averages; 0 where undefined."""
    counts = rows.agg(
        *[F.count_if((F.col(y) == k) & (F.col(p) == k)).alias(f"t{k}") for k in range(n)],
        *[F.count_if(F.col(p) == k).alias(f"p{k}") for k in range(n)],
        *[F.count_if(F.col(y) == k).alias(f"y{k}") for k in range(n)],
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)

    def of(k: int):  # noqa: ANN202
        t, pk, yk = (F.col(f"{c}{k}") for c in "tpy")
        a, b = ratio(t, pk), ratio(t, yk)
        return F.struct(F.lit(str(k)).alias("label"), a.alias("precision"), b.alias("recall"), ratio(2 * a * b, a + b).alias("f1"), yk.alias("support"))

    by_label = counts.select(F.explode(F.array(*[of(k) for k in range(n)])).alias("m")).select("m.*")
    names = ("precision", "recall", "f1")
    macro = by_label.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weights = F.sum("support")
    weighted = by_label.agg(*[F.when(weights > 0, F.sum(F.col(c) * F.col("support")) / weights).otherwise(0.0).alias(c) for c in names], weights.alias("support"))
    weighted = weighted.select(F.lit("weighted avg").alias("label"), *names, "support")
    return by_label.union(macro).union(weighted).select("label", *[F.round(c, digits).alias(c) for c in names], "support")


def binary(rows: DataFrame, y: str = "y_true", p: str = "y_pred", errors: int = UNPARSED) -> DataFrame:
    """Accuracy of attack or not, and how many predictions are the error code (which counts as an attack)."""
    same = (F.col(y) > 0) == (F.col(p) > 0)
    return rows.agg(F.round(F.avg(same.cast("double")), 6).alias("accuracy"), F.count_if(F.col(p) == errors).alias("errors"), F.count("*").alias("total"))


def analysed(answers: DataFrame, response: str = "response", strict: bool = False) -> DataFrame:
    """``answers`` with the label read from the response, as y_pred and its name."""
    out = answers.withColumn("y_pred", label_id(F.col(response), strict))
    return out.withColumn("prediction_result", label_name(F.col("y_pred")))


def attack_report(analysed: DataFrame, response: str = "response") -> DataFrame:
    """The rows of a report: those whose label is neither normal, others nor the error code."""
    rows = analysed.filter(~F.col("y_pred").isin(0, LABELS.index("Others"), UNPARSED))
    return rows.select(
        request_lines(F.col("method"), F.col("url"), F.col("body")).alias("request"),
        F.col("predicted_malicious").alias("predict_malicious"),
        "prediction_result",
        F.col(response).alias("llm_output"),
    )


def label_histogram(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)


#: Where length bins begin, and their names.
LENGTH_BINS = ((0, "0-4000"), (4_000, "4001-8600"), (8_600, "8601-10000"), (10_000, "10001-12000"), (12_000, "12000+"))


def length_histogram(rows: DataFrame, length: str) -> DataFrame:
    """(bin, n) of every bin, in order; bins hold their lower bound."""
    bins = rows.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(LENGTH_BINS)], "k int, least long, bin string")
    number = F.lit(0)
    for k, (least, _) in enumerate(LENGTH_BINS):
        number = F.when(F.col(length) >= least, F.lit(k)).otherwise(number)
    counts = rows.filter(F.col(length).isNotNull()).groupBy(number.alias("k")).agg(F.count("*").alias("n"))
    return bins.join(counts, "k", "left").select("k", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def length_stats(rows: DataFrame, length: str) -> DataFrame:
    return rows.agg(F.min(length).alias("least"), F.max(length).alias("most"), F.round(F.avg(length), 6).alias("average"), F.sum(length).alias("total"))


def best_metric(rows: DataFrame, kpi: str = "kpi", epoch: str = "epoch") -> DataFrame:
    """The row with the highest metric; of equal ones the earliest."""
    best = F.max(F.struct(F.col(kpi).alias("k"), (-F.col(epoch)).alias("e"))).alias("b")
    return rows.agg(best).select(F.col("b.k").alias("best"), (-F.col("b.e")).alias("epoch"))


def by_position(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The rows of two tables side by side, by their places in an order each; they must be equally long and share no
    column."""
    if left.count() != right.count():
        raise ValueError("tables of different lengths")
    if {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError("columns of one name")
    placed = numbered(left, left_order, 1, "_place").join(numbered(right, right_order, 1, "_place"), "_place")
    return placed.drop("_place")
