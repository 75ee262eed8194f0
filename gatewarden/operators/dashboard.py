"""What a dashboard shows: counts over time, de-duplicated rows, totals, search, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewarden.functions.text import row_hash

PAGE, RETENTION_DAYS = 15, 7
#: Widths of bins by the range that they cover, in seconds.
WIDTHS = ((3_600, 60), (21_600, 300), (86_400, 3_600), (None, 86_400))


def verdict_of(status: Column, label: Column, timed_out: Column | None = None, unexpected: str | None = None) -> Column:
    """200 is allowed (0), 403 denied (1), a timeout or error -1; another status is null, or the true label with
    ``unexpected`` = "label"."""
    other = label.cast("int") if unexpected == "label" else F.lit(None).cast("int")
    failed = status.isNull() if timed_out is None else timed_out
    return F.when(failed, -1).when(status == 200, 0).when(status == 403, 1).otherwise(other)


def binarised(label: Column) -> Column:
    """0 and -1 stay, all else is 1."""
    return F.when(label.isin(0, -1), label).otherwise(1).cast("int")


def _bin(ts: Column, width: int) -> Column:
    seconds = F.unix_seconds(F.date_trunc("second", ts))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(width)))


def counted(rows: DataFrame, ts: str, width: int, fill: bool = True) -> DataFrame:
    """(bin, n) by tumbling bins of ``width`` seconds; with ``fill``, empty bins between the first and last are there
    with 0. Null times are left out."""
    counts = rows.filter(F.col(ts).isNotNull()).groupBy(_bin(F.col(ts), width).alias("bin")).agg(F.count("*").alias("n"))
    if not fill:
        return counts
    ends = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    bins = ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {width} SECONDS"))).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def times_of(*branches: tuple[DataFrame, str]) -> DataFrame:
    """(ts) of several tables, each with the name of its column of times, one after another; null times are left out."""
    parts = [rows.select(F.col(ts).cast("timestamp").alias("ts")) for rows, ts in branches]
    return reduce(DataFrame.union, parts).filter("ts IS NOT NULL")


def stamp(form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The time of the query as text."""
    return F.date_format(F.current_timestamp(), form)


def width_for(rows: DataFrame, ts: str) -> int:
    """The bins' width for the rows' range: one row goes to the driver."""
    ends = rows.agg((F.unix_seconds(F.max(ts).cast("timestamp")) - F.unix_seconds(F.min(ts).cast("timestamp"))).alias("s")).first()["s"] or 0
    return next(w for most, w in WIDTHS if most is None or ends <= most)


def adaptive(rows: DataFrame, ts: str, fill: bool = True) -> DataFrame:
    return counted(rows, ts, width_for(rows, ts), fill)


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys, the last in an order."""
    columns = [c for c in rows.columns if c not in keys]
    # A maximum by a struct is partially aggregated; a ranking would send every row of a hot key to one task.
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*").select(*rows.columns)


def retained(rows: DataFrame, ts: str, now: Column | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last days before ``now``: the latest time there is, unless given."""
    if now is None:
        now = F.lit(rows.agg(F.max(ts).alias("m")).first()["m"])
    return rows.filter(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def hashed(rows: DataFrame, columns: list[str], to: str = "row_hash", separator: str = "\x1f") -> DataFrame:
    return rows.withColumn(to, row_hash(*[F.col(c) for c in columns], separator=separator))


def distinct_by_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    return hashed(rows, columns).dropDuplicates(["row_hash"])


def top_counts(rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts if n is None else counts.limit(n)


def totals(rows: DataFrame, denied: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(denied).alias("intercepted"))


def axis_bound(counts: DataFrame) -> DataFrame:
    """A fifth above the highest count."""
    return counts.agg((F.max("n") * 1.2).alias("bound"))


def searched(rows: DataFrame, columns: list[str], term: str, regex: bool = True) -> DataFrame:
    """Rows in which a column holds the term, in either case; nulls hold nothing."""
    found = F.lit(False)
    for c in columns:
        hit = F.col(c).rlike(f"(?iu){term}") if regex else F.contains(F.lower(c), F.lit(term.lower()))
        found = found | F.coalesce(hit, F.lit(False))
    return rows.filter(found)


def page(rows: DataFrame, number: int, order: list[Column], size: int = PAGE) -> DataFrame:
    """Page ``number`` (from 0) with the rows' places in the whole."""
    out = rows.orderBy(*order).offset(number * size).limit(size)
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)) + (number * size - 1))


def router_lags(offsets: DataFrame) -> DataFrame:
    """(topic, partition): of each topic the partition that is least behind, the first of equals."""
    from gatewarden.functions.text import lag_of

    lag = lag_of(F.col("high"), F.col("committed"))
    best = F.min(F.struct(lag.alias("lag"), "partition")).alias("b")
    return offsets.groupBy("topic").agg(best).select("topic", F.col("b.partition").alias("partition"), F.col("b.lag").alias("lag"))


def shuffled(rows: DataFrame, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Rows in an order that a seed decides, the same on every run: by a hash of the seed and the key columns."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *(keys or rows.columns)))
