"""Secret scans: base patterns, and character Markov models that tell random strings from ordinary identifiers.

Spans are found with split and regexp_extract_all: what lies between matches and the matches themselves give every
place. Candidates of the models are runs of CANDIDATE characters outside base spans; a run is a secret if its first-order
Markov log-likelihood as a random string, less that as an identifier, exceeds a threshold learned from labelled samples:
generated random strings, and generated numbers and the words of all documents with identifiers made of them.
All of it, training included, is DataFrame operations.

Edge cases: a null or empty text has no spans (counts 0, the hash of the empty string, an empty list); a text of n matches
costs n log n, however long; an empty table gives an empty result; equal spans of repeated rows are reported with each row; samples that are null, short or hold no known pair of characters teach nothing;
with no samples of either kind the models find nothing and base spans stay; extra columns pass through, but for one with the
result's name, whose place it takes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.common import SEPARATOR, let, table, written

#: Patterns in Java's syntax; (?i:...) there knows A-Z only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # matches of [0-9a-f]+ are whole runs, and these the long ones
MIN_VALUE, MIN_ACCESS = 8, 16
#: Runs that the models judge have MIN_RUN characters at least; a run starts where no such character is before it.
MIN_RUN = 16
CANDIDATE = rf"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{{{MIN_RUN},}}"
#: Kinds of characters: their order is that of the models' tables. Others count as one kind.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/=-"
SYMBOLS = len(ALPHABET) + 1
KINDS = ("assign", "access", "hex", "markov")
#: Random samples of each of four kinds; least occurrences of an ordinary word; words that identifiers are joined among.
RANDOM_SAMPLES, MIN_USES, IDENTIFIERS = 3_000, 2, 64
#: Added to each count of a character; weight of characters' own frequencies in those after another; share of ordinary
#: samples that may pass the threshold; least threshold per pair.
SMOOTHING, PRIOR, MAX_FALSE, MIN_MARGIN = 0.5, 8.0, 0.0005, 0.25


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Of an array, the values joined from the first to each: in rounds that double the reach, so that the work is
    n log n (an array grown element by element is copied each time)."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1

    def doubled(state: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(state, lambda x, i: F.when(i >= back, join(F.get(state, i - back), x)).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), rounds), values, doubled)


def _matches(text: Column, pattern: str, kind: str, valid: Callable[[Column], Column]) -> Column:
    """Spans (start, end, kind number, kind, value) of the leftmost matches that ``valid`` accepts."""
    none = F.array().cast("array<struct<start:int,end:int,k:int,kind:string,value:string>>")

    def located(found: Column, gaps: Column) -> Column:
        ends = running(F.transform(found, lambda x, i: F.length(gaps[i]) + F.length(x)), lambda a, b: a + b)

        def span(value: Column, end: Column) -> Column:
            return F.struct((end - F.length(value)).alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), value.alias("value"))

        return F.filter(F.zip_with(found, ends, span), lambda x: valid(x["value"]))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: located(found, gaps)))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _apart(runs: Column, base: Column) -> Column:
    """``runs`` that overlap no span of ``base``: none that starts before a run ends beyond its start, and none that starts
    at or after it starts before its end. Both are read off one sorted list."""
    latest = 2**31 - 1

    def of(both: Column) -> Column:
        is_base = lambda x: x["kind"] != "markov"
        ends = running(F.transform(both, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(is_base(x), x["start"]).otherwise(latest))), F.least))
        placed = F.arrays_zip(both.alias("x"), ends.alias("before"), starts.alias("after"))
        free = F.filter(placed, lambda p: ~is_base(p["x"]) & (p["before"] <= p["x"]["start"]) & (p["after"] >= p["x"]["end"]))
        return F.transform(free, lambda p: p["x"])

    some = (F.size(runs) > 0) & (F.size(base) > 0)
    return F.when(some, let(F.sort_array(F.concat(runs, base)), of)).otherwise(runs)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns in order of start, then kind."""
    whole = F.coalesce(text, F.lit(""))
    value = lambda m: F.regexp_extract(m, rf"^{ASSIGN}$", 1)
    parts = [
        _matches(whole, ASSIGN, "assign", lambda m: F.length(value(m)) >= MIN_VALUE),
        _matches(whole, ACCESS, "access", lambda m: F.length(m) >= MIN_ACCESS),
        _matches(whole, HEX, "hex", lambda m: F.lit(True)),
    ]
    return F.sort_array(F.concat(*parts))


def pairs(value: Column) -> Column:
    """The numbers of the pairs of neighbouring characters of a string."""
    places = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)))

    def joined(p: Column) -> Column:
        n = F.size(p) - 1
        return F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: a * SYMBOLS + b)

    return let(places, lambda p: F.when(F.size(p) > 1, joined(p)).otherwise(F.array().cast("array<int>")))


@dataclass(frozen=True)
class Models:
    """The log-likelihood ratio (random over ordinary) of each pair of characters, and the threshold per pair."""

    ratio: tuple[float, ...] = field(default=())
    threshold: float = math.inf

    def score(self, value: Column) -> Column:
        """The ratio of a string, per pair of characters."""
        by_pair = F.split(F.lit(",".join(map(repr, self.ratio))), ",").cast("array<double>")
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, i: s + F.get(by_pair, i))
        return let(pairs(value), lambda p: total(p) / F.greatest(F.size(p), F.lit(1)))


def fit(samples: DataFrame) -> Models:
    """The models of (value, label): 1 for random strings, 0 for ordinary identifiers. Pairs are counted by Spark; two
    thirds of the samples, by a hash, train the models, and the ordinary ones of the rest set the threshold."""
    rows = samples.filter(F.col("value").isNotNull() & F.col("label").isin(0, 1))
    rows = rows.select(F.col("label").cast("int").alias("label"), "value", (F.pmod(F.xxhash64("value"), F.lit(3)) == 0).alias("tests"))
    counted = rows.filter(~F.col("tests")).select("label", F.explode(pairs(F.col("value"))).alias("pair")).groupBy("label", "pair").count().collect()
    counts = {(r["label"], r["pair"]): r["count"] for r in counted}
    if {y for y, _ in counts} != {0, 1}:
        return Models()
    logs = {}
    symbols = range(SYMBOLS)
    for y in (0, 1):
        ends = [sum(counts.get((y, a * SYMBOLS + b), 0) for a in symbols) + SMOOTHING for b in symbols]
        for a in symbols:
            own = [counts.get((y, a * SYMBOLS + b), 0) + PRIOR * ends[b] / sum(ends) for b in symbols]
            total = math.log(sum(own))
            logs.update({(y, a * SYMBOLS + b): math.log(c) - total for b, c in enumerate(own)})
    ratio = tuple(logs[1, k] - logs[0, k] for k in range(SYMBOLS * SYMBOLS))
    score = Models(ratio).score(F.col("value"))
    ordinary = rows.filter(F.col("tests") & (F.col("label") == 0) & (F.length("value") >= MIN_RUN))
    high = ordinary.agg(F.percentile_approx(score, 1 - MAX_FALSE, 100_000).alias("t")).first()["t"]
    return Models(ratio, max(MIN_MARGIN, high or 0.0))


def random_samples(spark, n: int = RANDOM_SAMPLES) -> DataFrame:  # noqa: ANN001
    """Uniformly random strings over base64's characters, capitals and digits, and small letters and digits, of 20 to 64
    characters; the same on every run."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512)
    mixed = F.base64(F.unhex(digest))
    plain = F.translate(mixed, "+/=", "")
    size = (F.pmod(F.xxhash64("id"), F.lit(45)) + 20).cast("int")
    values = F.array(mixed, F.upper(plain), F.lower(plain), digest)
    return spark.range(n).select(F.explode(F.transform(values, lambda v: F.substr(v, F.lit(1), size))).alias("value"), F.lit(1).alias("label"))


def number_samples(spark, n: int = RANDOM_SAMPLES) -> DataFrame:  # noqa: ANN001
    """Numbers of 6 to 30 digits, which are ordinary; the same on every run."""
    digits = F.concat(*[F.abs(F.xxhash64("id", F.lit(k)) % 10**15).cast("string") for k in range(3)])
    return spark.range(n).select(F.substr(digits, F.lit(1), (F.pmod(F.xxhash64("id"), F.lit(25)) + 6).cast("int")).alias("value"), F.lit(0).alias("label"))


def ordinary_samples(documents: DataFrame, text: str = "text", least: int = MIN_USES) -> DataFrame:
    """The distinct words of all documents that occur ``least`` times at least, and identifiers made of them: words are
    grouped by a hash, about IDENTIFIERS a group, and each is joined with the two after it in the styles of identifiers.

    A word is letters between white space, with marks around it at most, so that pieces of random strings are none.
    Occurrences are counted before anything is sent; what is sent grows with the vocabulary.
    """
    tokens = documents.select(F.explode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SEPARATOR)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    word = F.regexp_extract("token", r"^[^A-Za-z0-9_+/=-]*([A-Za-z]{3,})[^A-Za-z0-9_+/=-]*$", 1)
    words = tokens.select(word.alias("word"), "n").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = written(words.select("word"), "words")
    groups = max(1, words.count() // IDENTIFIERS)
    near = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(groups)).alias("g")).agg(F.array_sort(F.collect_list("word")).alias("ws"))

    def styles(ws: Column) -> Column:
        joined = F.transform(
            F.slice(ws, 1, F.size(ws) - 2),
            lambda x, i: F.array(F.concat_ws("_", x, ws[i + 1], ws[i + 2]), F.concat_ws("-", F.lower(x), F.lower(ws[i + 1]), ws[i + 2]), F.concat(F.lower(x), F.initcap(ws[i + 1]), F.initcap(ws[i + 2]))),
        )
        return F.concat(ws, F.when(F.size(ws) > 2, F.flatten(joined)).otherwise(F.array().cast("array<string>")))

    return near.select(F.explode(styles(F.col("ws"))).alias("value"), F.lit(0).alias("label"))


def scanned(docs: DataFrame, models: Models, text: str = "text", to: str = "secrets") -> DataFrame:
    """``docs`` with ``to``: spans (start, end, k, kind, value) in order, base ones and those of the models."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def with_models(base: Column) -> Column:
        if not models.ratio:
            return base
        runs = _matches(whole, CANDIDATE, "markov", lambda v: models.score(v) > models.threshold)
        return F.sort_array(F.concat(base, let(runs, lambda r: _apart(r, base))))

    return docs.withColumn(to, let(base_spans(whole), with_models))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by its kind in brackets; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), new.alias("out")))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))


def of_kind(kind: str):  # noqa: ANN201
    return lambda x: x["kind"] == kind


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = fit(random_samples(spark).union(number_samples(spark)).union(ordinary_samples(docs)))
    out = scanned(docs, models)

    def digest(spans: Column) -> Column:
        counts = [F.size(F.filter(spans, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
        base = F.filter(spans, lambda x: x["kind"] != "markov")
        return F.struct(*counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))

    return out.select("doc_id", let(F.col("secrets"), digest).alias("d")).select("doc_id", "d.*")
