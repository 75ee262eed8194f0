"""Quality rules: a learned decision list over text statistics, grown, pruned and applied with DataFrame operations only.

``statistics`` gives a text's counts, ``fit`` learns an ordered list of threshold conjunctions by sequential covering
from labelled rows, ``DecisionList.column`` is that list as one conditional expression.

Edge cases: a null or empty text has no words and all counts zero; ties between equally good literals go to the first
feature in name order, then the lower threshold; repeated rows count as often as they occur; with no labelled rows, or
labels of one kind only, the list is empty and accepts everything; extra columns are left alone, but
for one with the result's name, whose place it takes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.common import SEPARATOR_CHARS, WORD, fresh, let, released, table, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Literals a rule may have, rules a list may have, candidate thresholds a feature, rejected rows a rule must cover.
MAX_LITERALS, MAX_RULES, THRESHOLDS, MIN_COVER = 3, 8, 24, 5
#: Most labelled rows that are learned from, chosen by a hash of the row, never by position.
MAX_LABELLED = 10_000
#: Least share of rejected rows among those a rule covers, on the pruning rows too.
MIN_PRECISION = 0.95


def _covered(ws: Column) -> Column:
    """Words inside windows of eight that occur twice or more. Windows are compared by a 64-bit hash of word hashes."""
    none = F.lit(0)

    def joined(hashes: Column, step: int) -> Column:
        """Of hashes of runs that begin at each word, those of runs twice as long."""
        n = F.size(hashes) - step
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))

    def of(hashes: Column) -> Column:
        windows = let(joined(hashes, 1), lambda two: let(joined(two, 2), lambda four: joined(four, 4)))
        found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), repeated(w)).otherwise(none))
        return F.when(F.size(hashes) > WINDOW, found)

    def repeated(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: covering(s))

    def covering(s: Column) -> Column:
        last = F.size(s) - 1
        same = F.filter(
            s,
            lambda x, k: ((k > 0) & (s[F.greatest(k - 1, none)]["h"] == x["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"])),
        )
        start = F.struct(F.lit(-WINDOW).alias("before"), none.alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(same, lambda x: x["i"])),
            start,
            lambda a, i: F.struct(i.alias("before"), (a["n"] + F.least(F.lit(WINDOW), i - a["before"])).alias("n")),
            lambda a: a["n"],
        )

    return F.coalesce(let(F.transform(ws, lambda w: F.xxhash64(w)), of), none)


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_upper, all long."""
    whole = F.coalesce(text, F.lit(""))
    no_symbols = F.translate(whole, SYMBOLS, "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    upper = F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", ""))

    def of(ws: Column) -> Column:
        parts = {
            "n_words": F.size(ws),
            "word_chars": F.length(F.translate(whole, SEPARATOR_CHARS, "")),
            "n_symbols": F.length(whole) - F.length(no_symbols),
            "n_lines": F.size(lines),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": _covered(ws),
            "n_upper": upper,
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in parts.items()])

    return let(words(whole), of)


def features(s: Column) -> dict[str, Column]:
    """The rates a rule may test, by name, from a struct of ``statistics``."""
    per = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))
    return {
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "mean_word_chars": per("word_chars", "n_words"),
        "repeat_word_rate": per("n_repeat_words", "n_words"),
        "symbol_rate": per("n_symbols", "word_chars"),
        "upper_rate": per("n_upper", "word_chars"),
        "words": s["n_words"].cast("double"),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


@dataclass(frozen=True)
class Literal:
    feature: str
    op: str
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x > self.threshold if self.op == ">" else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    covered: int = 0
    rejected: int = 0

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.column(values)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals))


@dataclass(frozen=True)
class DecisionList:
    """The first rule that fits rejects; a text that none fits is kept."""

    rules: tuple[Rule, ...] = field(default=())

    def rule_number(self, values: dict[str, Column]) -> Column:
        """Number from 1 of the first rule that fits, else null."""
        out = F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(values), F.lit(n)).otherwise(out)
        return out

    def keeps(self, values: dict[str, Column]) -> Column:
        return self.rule_number(values).isNull()


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained by a literal for each rejected row that it still covers."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _grown(rows: DataFrame, values: dict[str, Column], cuts: dict[str, list[float]], total: tuple[int, int]) -> list[Literal]:
    """Adds the best literal, one aggregation each, until no accepted row is covered or nothing is gained."""
    literals: list[Literal] = []
    p0, n0 = total
    while len(literals) < MAX_LITERALS and n0 and p0 >= MIN_COVER:
        options = [Literal(f, op, t) for f in sorted(cuts) for t in cuts[f] for op in (">", "<=")]
        inside = rows.filter(Rule(tuple(literals)).column(values)).select("y", *[v.alias(k) for k, v in values.items()])
        inner = {k: F.col(k) for k in values}
        counts = inside.groupBy("y").agg(*[F.count_if(o.column(inner)).alias(f"c{i}") for i, o in enumerate(options)]).collect()
        got = {r["y"]: r for r in counts}
        best, gain = None, 0.0
        for i, option in enumerate(options):
            p, n = (got[y][f"c{i}"] if y in got else 0 for y in (1, 0))
            if p >= MIN_COVER and (g := _gain(p, n, p0, n0)) > gain + 1e-9:
                best, gain, left = option, g, (p, n)
        if best is None:
            break
        literals.append(best)
        p0, n0 = left
    return literals


def _pruned(rows: DataFrame, values: dict[str, Column], literals: list[Literal]) -> Rule:
    """Drops final literals while the share of rejected rows among those covered by the pruning rows doesn't fall."""
    stages = [Rule(tuple(literals[:k])) for k in range(1, len(literals) + 1)]
    r = rows.agg(*[F.count_if(s.column(values) & (F.col("y") == y)).alias(f"s{k}_{y}") for k, s in enumerate(stages) for y in (0, 1)]).collect()[0]
    worth = lambda k: (r[f"s{k}_1"] - r[f"s{k}_0"]) / max(1, r[f"s{k}_1"] + r[f"s{k}_0"])
    best = max(range(len(stages)), key=lambda k: (worth(k), -k))
    return Rule(stages[best].literals, r[f"s{best}_1"] + r[f"s{best}_0"], r[f"s{best}_1"])


def fit(labelled: DataFrame, label: str = "reject", text: str = "text") -> DecisionList:
    """Learns a list from rows with a text and a label (1: reject, 0: accept; others are left out).

    Two thirds of the rows, by a hash of their text, grow rules; the rest prune them and must confirm ``MIN_PRECISION``.
    Each step is one aggregation over the rows; the driver sees counts only.
    """
    labelled = labelled.filter(F.col(label).isin(0, 1))
    stats = labelled.select(F.col(label).cast("int").alias("y"), F.xxhash64(text).alias("key"), statistics(F.col(text)).alias("s"))
    values = [v.alias(k) for k, v in features(F.col("s")).items()]
    # Base failures are left out after the table is written: before, the filter and with it the statistics would be
    # pushed below the join with the labels, to every document.
    stats = written(stats.select("y", (F.pmod("key", F.lit(3)) == 0).alias("prunes"), base_failed(F.col("s")).alias("bad"), *values), "quality")
    rows = stats.filter(~F.col("bad")).drop("bad")
    names = sorted(c for c in rows.columns if c not in ("y", "prunes"))
    values = {n: F.col(n) for n in names}
    grow, prune = rows.filter(~F.col("prunes")), rows.filter(F.col("prunes"))
    steps = [k / THRESHOLDS for k in range(1, THRESHOLDS)]
    # Thresholds midway between neighbouring quantiles of either kind, so that they stand clear of both.
    quantiles = grow.groupBy("y").agg(*[F.percentile_approx(n, steps + [0.0, 0.002, 0.998, 1.0], 10_000).alias(n) for n in names]).collect()
    cuts = {}
    for n in names:
        seen = sorted({v for r in quantiles for v in (r[n] or [])})
        middle = [(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)]
        cuts[n] = [middle[i * len(middle) // (2 * THRESHOLDS)] for i in range(2 * THRESHOLDS)] if len(middle) > 2 * THRESHOLDS else middle
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        none_fits = DecisionList(tuple(rules)).keeps(values)
        left = grow.filter(none_fits)
        counts = {r["y"]: r["count"] for r in left.groupBy("y").count().collect()}
        if counts.get(1, 0) < MIN_COVER or not counts.get(0):
            break
        literals = _grown(left, values, cuts, (counts[1], counts[0]))
        if not literals:
            break
        rule = _pruned(prune.filter(none_fits), values, literals)
        if rule.covered and rule.rejected < MIN_PRECISION * rule.covered or not rule.covered:
            break
        rules.append(rule)
    released(stats)
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", to: str = "quality") -> DataFrame:
    """``docs`` with ``to``: a struct of the statistics, base_failed, the number of the rule that rejects, kept."""
    docs, at = fresh(docs, s=statistics(F.col(f"`{text}`")))
    s = F.col(at["s"])
    failed = base_failed(s)
    number = rules.rule_number(features(s))
    parts = [s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")]
    verdict = F.struct(*parts, failed.alias("base_failed"), number.alias("rule"), (~failed & number.isNull()).alias("kept"))
    return docs.withColumn(to, verdict).drop(at["s"])


def training_rows(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Texts with ``reject``: 1 where ``labels.quality`` is 0, of at most about ``max_labelled`` rows with a label, those
    with the smallest hash of their id. So bounded, the labels are broadcast and no text moves."""
    marks = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", (1 - F.col("quality")).alias("reject")).dropna()
    total = marks.count()
    if total > max_labelled:
        marks = marks.filter(F.xxhash64("doc_id") < int(2**63 * (2 * max_labelled / total - 1)))
    return documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    out = judge(docs.select("doc_id", "text"), rules)
    q = F.col("quality")
    return out.select("doc_id", *[q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")])
