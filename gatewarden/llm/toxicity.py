"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples and texts are unit TF-IDF vectors over all their words; document frequencies are counted over all documents (words
that no example holds count as unseen). A word's weight also grows with how far its count among label 1 is from chance: ``1 + (z / 2) ** 2``, at least 1,
so that every word counts and those that tell the labels apart count more (plain TF-IDF finds half of the held-out
toxic texts: see the README). No word is left out, whatever its label or frequency.

Examples stand in blocks of BLOCK. Words that few examples hold have postings, words that many hold a column a block with its
largest weight; together they bound the cosine that any example of a block can reach. The blocks with the highest
bounds are opened first, then all whose bound reaches the k-th best cosine found there, so the K neighbours are exact. Their
votes, weighted by closeness, are mapped to a probability by a logistic curve fitted to votes on the examples themselves,
each left out of its own.

At most MAX_EXAMPLES labelled rows teach, those with the smallest hash of id and text, so what is broadcast is bounded however
large the corpus is; every text is scored in whole, in one pass over its words, however long.

Edge cases: null and empty texts, and texts without any word of the examples, have no neighbours and get the score of an
empty vote; ties between equally close examples go to the one that stands first in the index (ordered by label, frequent
words and id); repeated rows count as often as they occur; with no labelled rows, or labels of one kind, every score is that
kind's share (0.0 without rows); an empty table gives an empty result; extra columns pass through, but for one with the
result's name, whose place it takes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import blake2b
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewarden.llm.common import others as kept_fields
from gatewarden.llm.common import table

MAX_EXAMPLES, K, BLOCK = 4_000, 15, 64
#: Blocks opened first; a word is frequent if one example in SHARE holds it; texts looked up together; results a worker keeps.
FIRST, SHARE, TOGETHER, KNOWN = 8, 25, 64, 50_000
#: Characters of texts looked up together, if more than one: postings of their words are in memory at once.
LONG = 400_000
#: Closeness 1 weighs 1 / NEAR; weight of the empty vote.
NEAR, EMPTY = 0.1, 0.5
WORDS = re.compile(r"\w+")

#: What sums in single precision may be off by.
SLACK = 1e-5

#: Terms, ascending, and their weights.
Vector = tuple[np.ndarray, np.ndarray]


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of runs one after another, and the runs' lengths."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size), size


def _together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Runs of at most TOGETHER texts and, but for single texts, LONG characters."""
    run, held = [], 0
    for x in texts:
        n = len(x or "")
        if run and (len(run) == TOGETHER or held + n > LONG):
            yield run
            run, held = [], 0
        run.append(x)
        held += n
    if run:
        yield run


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a whole text."""
    return WORDS.findall((text or "").lower())


@dataclass
class Index:
    """Unit vectors of examples. Terms are numbered from the most frequent down; their postings (examples in order, and
    weights) stand one after another."""

    numbers: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Weight of a word that no document holds.
    unseen: float = 1.0
    prior: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)

    @cached_property
    def blocks(self) -> int:
        return max(1, -(-len(self.labels) // BLOCK))

    @cached_property
    def frequent(self) -> int:
        """Terms below this number are frequent."""
        return int(np.searchsorted(-np.diff(self.starts), -len(self.labels) / SHARE, side="right"))

    @cached_property
    def columns(self) -> np.ndarray:
        """Weights of frequent terms by block and example, in single precision."""
        out = np.zeros((self.blocks * BLOCK, self.frequent), np.float32)
        end = self.starts[self.frequent]
        out[self.rows[:end], np.repeat(np.arange(self.frequent), np.diff(self.starts[: self.frequent + 1]))] = self.values[:end]
        return out.reshape(self.blocks, BLOCK, -1)

    @cached_property
    def largest(self) -> np.ndarray:
        """Largest weights of frequent terms by block."""
        return self.columns.max(axis=1)

    def vector(self, text: str | None) -> Vector:
        """The unit vector of a text, of which the index's terms are given; its other words count in its length."""
        words = words_of(text)
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        others = Counter(compress(words, (found < 0).tolist()))
        terms, times = np.unique(found[found >= 0], return_counts=True)
        weights = (1 + np.log(times)) * self.weight[terms]
        rest = (1 + np.log(np.fromiter(others.values(), np.float64, len(others)))) * self.unseen
        length = math.sqrt(float(weights @ weights + rest @ rest))
        return terms, weights / (length or 1.0)

    @cached_property
    def _forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings by example: terms, weights, and where each example's begin."""
        order = np.argsort(self.rows, kind="stable")
        terms = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
        return terms[order], self.values[order], np.searchsorted(self.rows[order], np.arange(len(self.labels) + 1))

    def example(self, number: int) -> Vector:
        """An example's vector."""
        terms, values, ends = self._forward
        own = slice(ends[number], ends[number + 1])
        return terms[own], values[own]

    @cached_property
    def _scratch(self) -> np.ndarray:
        return np.zeros(len(self.weight))

    def cosines(self, vector: Vector, numbers: np.ndarray) -> np.ndarray:
        """Exact cosines of a vector with examples, each of which holds a term."""
        terms, values, ends = self._forward
        at, size = _runs(ends[numbers], ends[numbers + 1])
        self._scratch[vector[0]] = vector[1]
        out = np.add.reduceat(self._scratch[terms[at]] * values[at], np.cumsum(size) - size)
        self._scratch[vector[0]] = 0.0
        return np.round(out, 12)

    def nearest(self, vectors: list[Vector], k: int = K, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples with the highest positive cosine, exactly: cosines and numbers, ties to the
        lower number. ``but``: for each vector an example that doesn't count. Bounds and sums are in single precision, so
        all that come within SLACK of the k-th best are computed anew."""
        m, split, blocks = len(vectors), self.frequent, self.blocks
        text = np.repeat(np.arange(m), [len(t) for t, _ in vectors])
        terms, weights = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
        often = terms < split
        query = np.zeros((m, split), np.float32)
        query[text[often], terms[often]] = weights[often]
        at, size = _runs(self.starts[terms[~often]], self.starts[terms[~often] + 1])
        place = np.repeat(text[~often] * (blocks * BLOCK), size) + self.rows[at]
        scores = np.bincount(place, np.repeat(weights[~often], size) * self.values[at], m * blocks * BLOCK).astype(np.float64, copy=False).reshape(m, blocks, BLOCK)
        bounds = scores.max(axis=2) + query @ self.largest.T

        def opened(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(axis=0)):
                own = np.flatnonzero(which[:, b])
                scores[own, b] += query[own] @ self.columns[b].T

        highest = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, highest, True, axis=1)
        opened(first)
        flat = scores.reshape(m, -1)
        if but is not None:
            flat[np.arange(m), but] = -1.0
        seen = np.take_along_axis(scores, highest[:, :, None], axis=1).reshape(m, -1)
        reach = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.zeros(m)
        rest = (bounds > SLACK) & (bounds >= reach[:, None] - SLACK) & ~first
        opened(rest)
        scores[~(first | rest)] = 0.0
        if but is not None:
            flat[np.arange(m), but] = -1.0
        out = []
        for i, vector in enumerate(vectors):
            hits = np.flatnonzero(flat[i] > max(reach[i] - SLACK, 0.0))
            if len(hits) > k:
                near = flat[i, hits]
                hits = hits[near >= np.partition(near, -k)[-k] - SLACK]
            values = self.cosines(vector, hits) if len(hits) else np.zeros(0)
            top = np.argsort(-values, kind="stable")[:k]
            top = top[values[top] > 0]
            out.append((values[top], hits[top]))
        return out

    def vote(self, cosines: np.ndarray, numbers: np.ndarray) -> float:
        """The share of label 1 among the neighbours by closeness, with an empty vote for the prior; where fewer than K are
        near, the prior takes the places left, at closeness 0."""
        weights = 1 / (NEAR + 1 - np.minimum(cosines, 1.0))
        empty = EMPTY + (K - len(numbers)) / (NEAR + 1)
        return (float(weights @ self.labels[numbers]) + empty * self.prior) / (float(weights.sum()) + empty)

    def score(self, vote: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * vote + b)))) if a else self.prior


def built(ids: np.ndarray, labels: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], terms: list[str], frequencies: np.ndarray, n: int, once: np.ndarray) -> Index:
    """The index over examples, given by numbers and counts of ``terms``; frequencies: documents that hold each, of ``n``;
    ``once``: the examples that words' weights are learned from."""
    sizes = [len(t) for t, _ in counts]
    row, term = np.repeat(np.arange(len(ids)), sizes), np.concatenate([t for t, _ in counts])
    value = 1 + np.log(np.concatenate([c for _, c in counts]).astype(float))
    # Of a word's examples, how many have label 1, against chance.
    held = np.bincount(term[once[row]], minlength=len(terms))
    yes = np.bincount(term[once[row] & (labels[row] == 1)], minlength=len(terms))
    share = labels[once].mean()
    z = (yes - held * share) / np.sqrt(held * share * (1 - share) + 1)
    weight = np.log((n + 2) / (frequencies + 1)) * (1 + (z / 2) ** 2)
    value = value * weight[term]
    length = np.sqrt(np.bincount(row, value * value, len(ids)))
    value = value / np.where(length > 0, length, 1.0)[row]
    # Numbers from the most frequent term down; examples by label and frequent words, so that blocks hold like ones.
    by_size = np.lexsort((np.arange(len(terms)), -np.bincount(term, minlength=len(terms))))
    number = np.argsort(by_size)
    marks = np.zeros((len(ids), 64), np.uint8)
    common = number[term] < 64
    marks[row[common], number[term[common]]] = 1
    like = np.packbits(marks, axis=1).view(">u8")[:, 0]
    place = np.argsort(np.lexsort((ids, like, -labels)))
    order = np.lexsort((place[row], number[term]))
    out = Index(dict(zip(terms, number.tolist(), strict=True)), weight[by_size], rows=place[row][order].astype(np.int32), values=value[order], unseen=math.log(n + 2), prior=float(labels.mean()))
    out.starts = np.searchsorted(number[term][order], np.arange(len(terms) + 1))
    out.labels, out.ids = (x[np.argsort(place)] for x in (labels, ids))
    return out


def _logistic(x: list[float], y: list[int]) -> tuple[float, float]:
    """Slope and offset of a probability curve by Newton steps, with targets drawn in by a pseudo-count (Platt)."""
    xs, n1 = np.array(x), sum(y)
    t = np.where(np.array(y) > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, math.log((n1 + 1) / (len(y) - n1 + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * xs + b, -30, 30)))
        g = np.array([((p - t) * xs).sum() + 1e-3 * a, (p - t).sum()])
        w = p * (1 - p)
        h = np.array([[(w * xs * xs).sum() + 1e-3, (w * xs).sum()], [(w * xs).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-6), float(b)


def held_out(doc_id):  # noqa: ANN001, ANN201
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def examples(documents: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """(id, y, text) of labelled documents, held-out ones excluded: at most ``most`` rows, those with the smallest hash of
    id and text."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    total = marks.count()
    if total > most:  # half as many again, as not every label has a document
        marks = marks.filter(F.xxhash64("doc_id") < int(2**63 * min(1.0, 3 * most / total - 1)))
    # Hashes of distinct ids can't crowd; still, only a side that was counted small is broadcast.
    marks = F.broadcast(marks) if total <= most or marks.count() <= 2 * most else marks
    rows = documents.select("doc_id", "text").join(marks, "doc_id").select(F.col("doc_id").cast("long").alias("id"), "y", "text")
    mixed = F.xxhash64("id", "text")
    # The limit leaves one partition, which is dealt out again for what follows.
    return rows.orderBy(F.xxhash64("id"), mixed, "y").limit(most).repartition(max(1, most // 128), mixed)


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[str], np.ndarray]:
    """Of (id, y, text): ids, labels, each text's term numbers and counts, the terms, and the first rows of equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Counter(words_of(x.as_py())) for x in batch.column(2)]
            marks = [int.from_bytes(blake2b((x.as_py() or "").encode(), digest_size=8).digest(), "big", signed=True) for x in batch.column(2)]
            terms, counts = pa.array([list(c) for c in own], pa.list_(pa.string())), pa.array([list(c.values()) for c in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64()), terms, counts], names=["id", "y", "mark", "terms", "counts"])

    found = rows.mapInArrow(run, "id bigint, y int, mark bigint, terms array<string>, counts array<bigint>").toArrow().combine_chunks()
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int8), [], [], np.zeros(0, bool)
    found = found.sort_by([("id", "ascending"), ("y", "ascending"), ("mark", "ascending")]).combine_chunks()
    ids = found["id"].fill_null(-1).to_numpy().astype(np.int64)
    labels = found["y"].to_numpy().astype(np.int8)
    lists, counts = (found[c].combine_chunks() for c in ("terms", "counts"))
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    order = np.argsort(np.array(names, object), kind="stable") if names else np.zeros(0, np.int64)
    number = np.argsort(order)
    codes = number[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    ends = np.cumsum([0, *[len(x) if x is not None else 0 for x in lists.to_pylist()]]) if names else np.zeros(len(ids) + 1, np.int64)
    times = counts.flatten().to_numpy()
    per_text = [(codes[a:b], times[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    pairs = np.stack([found["mark"].to_numpy(), labels.astype(np.int64)], axis=1)
    once = np.zeros(len(ids), bool)
    once[np.unique(pairs, axis=0, return_index=True)[1]] = True
    return ids, labels, per_text, [names[i] for i in order], once


def frequencies(documents: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and the number of documents."""
    spark = documents.sparkSession
    size, shared = len(terms), spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out, n = shared.value, np.zeros(size, np.int64), 0
        for batch in batches:
            n += len(batch)
            for x in batch.column(0):
                words = words_of(x.as_py())
                held = np.unique(np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)))
                out[held[held >= 0]] += 1
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *out[at]], pa.int64())], names=["term", "n"])

    found = documents.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["term"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(len(terms), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def _votes(spark, index: Index) -> tuple[list[float], list[int]]:  # noqa: ANN001
    """Votes on the examples, each left out of its own, and their labels."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in batch.column(0).to_pylist():
                numbers = list(range(start, min(start + TOGETHER, len(own.labels))))
                near = own.nearest([own.example(i) for i in numbers], but=numbers)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([own.vote(*x) for x in near])], names=["number", "vote"])

    tasks = -(-len(index.labels) // (4 * TOGETHER))
    found = spark.range(0, len(index.labels), TOGETHER, tasks).mapInArrow(run, "number int, vote double").toArrow().sort_by("number")
    return found["vote"].to_pylist(), index.labels.tolist()


def fit(rows: DataFrame, documents: DataFrame | None = None) -> Index:
    """The index over (id, y, text), of which there are at most MAX_EXAMPLES; the driver gets their words' counts. Document
    frequencies are those in ``documents`` (text), by default in the rows themselves."""
    ids, labels, counts, terms, once = _counted(rows)
    if not len(ids) or labels.min() == labels.max() or not terms:
        return Index(prior=float(labels.mean()) if len(ids) else 0.0)
    found, n = frequencies(rows if documents is None else documents, terms)
    out = built(ids, labels, counts, terms, found, n, once)
    out.curve = _logistic(*_votes(rows.sparkSession, out))
    return out


def score(docs: DataFrame, index: Index, text: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with ``to``: struct of score, label and evidence (the three closest examples with their cosine and
    label)."""
    kind = T._parse_datatype_string("struct<score:double,predicted:int,evidence:array<struct<id:bigint,cosine:double,label:int>>>")
    arrow = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    fields = kept_fields(docs, to)
    names = [f.name for f in fields]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[bytes, dict] = {}

        def results(texts: list[str | None]) -> list[dict]:
            marks = [blake2b((x or "").encode(), digest_size=16).digest() for x in texts]
            new = {m: x for m, x in zip(marks, texts, strict=True) if m not in known}
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = dict(zip(marks, texts, strict=True))
            near = own.nearest([own.vector(x) for x in new.values()]) if new and own.curve[0] else [(np.zeros(0), np.zeros(0, np.int64))] * len(new)
            for m, (cosines, numbers) in zip(new, near, strict=True):
                s = own.score(own.vote(cosines, numbers))
                evidence = [{"id": int(own.ids[i]), "cosine": float(c), "label": int(own.labels[i])} for c, i in zip(cosines[:3], numbers[:3], strict=True)]
                known[m] = {"score": s, "predicted": int(s >= 0.5), "evidence": evidence}
            return [known[m] for m in marks]

        for batch in batches:
            made = [r for texts in _together(x.as_py() for x in batch.column(at)) for r in results(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*names, to])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*fields, T.StructField(to, kind)]))


def model(documents: DataFrame, labels: DataFrame) -> Index:
    """The index that labelled documents give, with frequencies of all documents."""
    return fit(examples(documents, labels), documents)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, model(docs, table(spark, sf_dir, "labels")))
    t = F.col("toxicity")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), t["score"].alias("score"), t["predicted"].alias("predicted"), t["evidence"].alias("evidence"))
