"""URL filters: host and path rules, and for URLs that no rule fits a ratio of character language models.

Two variable-order Markov models, of accepted and of rejected URLs, give each character's probability after the longest
context seen, smoothed by interpolation with the shorter ones (Witten-Bell). A URL's score is the difference of the two
log-likelihoods per character; a logistic curve fitted on labelled URLs that trained neither model turns it into a
probability of rejection, and CUT decides. Without labels of its own, the operator is trained on URLs that rules decide.

The models are fitted on at most MAX_EXAMPLES labelled URLs of each kind, those with the smallest hash, and keep at most
MAX_CONTEXTS contexts each (the most frequent), so what is broadcast is bounded; every URL is judged.

Edge cases: a null URL or one without "://" has empty host and path, fits no rule and is allowed (nothing is known
against it), as is every URL no rule decides when either kind has no examples; of rules of equal length that fit, the
first in the list wins; repeated rows each get a verdict; extra columns pass through, but for one with
the result's name, whose place it takes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewarden.llm.common import fresh, table

#: Verdict, host, path (the rules of the query).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ORDER, MAX_EXAMPLES, MAX_CONTEXTS, MAX_URL = 5, 5_000, 200_000, 4_096
#: Probability of rejection from which a URL is blocked.
CUT = 0.5
END = "\x03"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:  # noqa: ANN001
    """The longest rule that fits, as host and path, and its verdict; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def body(url: str | None) -> str:
    """What the models read: from the host on, without scheme; the host in lower case."""
    rest = (url or "").partition("://")[2]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    return rest[:cut].lower() + rest[cut:]


@dataclass
class Markov:
    """Counts of characters after contexts of 0 to ORDER characters."""

    after: dict[str, dict[str, int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)

    @classmethod
    def fitted(cls, texts: list[str], alphabet: int = 128) -> Markov:
        counts: dict[str, Counter] = {"": Counter()}
        for x in texts:
            s = "\x02" * ORDER + x + END
            for i in range(ORDER, len(s)):
                for n in range(ORDER + 1):
                    counts.setdefault(s[i - n : i], Counter())[s[i]] += 1
        if len(counts) > MAX_CONTEXTS:
            kept = sorted(counts, key=lambda c: (len(c) > 0, -sum(counts[c].values()), c))[:MAX_CONTEXTS]
            counts = {c: counts[c] for c in kept}
        return cls({c: dict(n) for c, n in counts.items()}, {c: sum(n.values()) for c, n in counts.items()})

    def chance(self, context: str, c: str) -> float:
        """Witten-Bell: what a context has seen, mixed with the next shorter one by the number of its kinds."""
        p = 1 / 256
        for n in range(len(context) + 1):
            shorter = context[len(context) - n :]
            seen = self.after.get(shorter)
            if seen is None:
                break
            total, kinds = self.totals[shorter], len(seen)
            p = (seen.get(c, 0) + kinds * p) / (total + kinds)
        return p


@dataclass
class Filter:
    accepted: Markov | None = None
    rejected: Markov | None = None
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, url: str | None) -> float:
        """Log-likelihood as rejected less that as accepted, per character."""
        if self.accepted is None or self.rejected is None:
            return 0.0
        s = "\x02" * ORDER + body(url) + END
        total = 0.0
        for i in range(ORDER, len(s)):
            context = s[i - ORDER : i]
            total += math.log(self.rejected.chance(context, s[i])) - math.log(self.accepted.chance(context, s[i]))
        return total / (len(s) - ORDER)

    def probability(self, url: str | None) -> float:
        if self.accepted is None or self.rejected is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.difference(url) + self.offset))))


def fit(urls: list[str], rejected: list[bool]) -> Filter:
    """Models from two thirds of the examples, the curve from the others (by position: callers order by a hash)."""
    train = [(u, r) for k, (u, r) in enumerate(zip(urls, rejected, strict=True)) if k % 3]
    rest = [(u, r) for k, (u, r) in enumerate(zip(urls, rejected, strict=True)) if k % 3 == 0]
    good, bad = [body(u) for u, r in train if not r], [body(u) for u, r in train if r]
    if not good or not bad:
        return Filter()
    out = Filter(Markov.fitted(good), Markov.fitted(bad), 1.0, 0.0)
    xs = [(out.difference(u), float(r)) for u, r in rest]
    if len({y for _, y in xs}) == 2:
        out.slope, out.offset = _curve(xs)
    return out


def _curve(xs: list[tuple[float, float]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a small penalty, by gradient steps of Newton's kind; both kinds weigh
    the same, so that the share of rejected examples among those at hand doesn't matter."""
    n1 = sum(y for _, y in xs)
    n0 = len(xs) - n1
    a, b = 1.0, 0.0
    for _ in range(200):
        ga, gb, haa, hab, hbb = 1e-2 * a, 0.0, 1e-2, 0.0, 1e-6
        for x, y in xs:
            w = 0.5 / n1 if y else 0.5 / n0
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            ga += w * (p - y) * x
            gb += w * (p - y)
            q = w * p * (1 - p)
            haa, hab, hbb = haa + q * x * x, hab + q * x, hbb + q
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return max(a, 1e-6), b


def examples(labelled: DataFrame, url: str = "url", most: int = MAX_EXAMPLES) -> tuple[list[str], list[bool]]:
    """At most ``most`` distinct URLs of each verdict ("allow" or "block"), those with the smallest hash among URLs of at
    most MAX_URL characters; both bounds are on what is learned from, not on what is judged."""
    kinds = []
    for v in ("allow", "block"):
        rows = labelled.filter((F.col("verdict") == v) & (F.length(url) <= MAX_URL)).select(F.col(url).alias("u")).distinct()
        kinds += [(r["h"], r["u"], v == "block") for r in rows.select("u", F.xxhash64("u").alias("h")).orderBy("h", "u").limit(most).collect()]
    kinds.sort(key=lambda r: r[:2])
    return [u for _, u, _ in kinds], [r for _, _, r in kinds]


def judged(pages: DataFrame, model: Filter, rules=RULES, url: str = "url", to: str = "filter") -> DataFrame:  # noqa: ANN001
    """``pages`` with ``to``: struct of host, path, rule, verdict and, where no rule decides, the probability of
    rejection."""
    rule, verdict = rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)
    pages, at = fresh(pages, host=host_of(F.col(url)), path=path_of(F.col(url)), rule=rule, verdict=verdict, p=F.lit(None).cast("double"))
    pages = pages.drop(at["p"])
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = pages.columns
    k, kv = names.index(url), names.index(at["verdict"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [own.probability(u) if x is None else None for u, x in zip(batch.column(k).to_pylist(), batch.column(kv).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*names, at["p"]])

    out = pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(at["p"], T.DoubleType())]))
    p = F.col(at["p"])
    decided = F.coalesce(F.col(at["verdict"]), F.when(p >= CUT, "block").otherwise("allow"))
    parts = [F.col(at[k]).alias(k) for k in ("host", "path", "rule")]
    return out.withColumn(to, F.struct(*parts, decided.alias("verdict"), p.alias("rejection"))).drop(*at.values())


def op9(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rule, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")))
    model = fit(*examples(pages.select("url", verdict.alias("verdict"))))
    f = F.col("filter")
    out = judged(pages, model)
    return out.select("page_id", *[f[k].alias(k) for k in ("host", "path", "rule", "verdict", "rejection")])
