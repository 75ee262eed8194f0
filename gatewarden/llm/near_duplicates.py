"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

Candidates are texts whose SimHash fingerprints over five-word shingles are linked (BK-trees, as in ``simhash``), and, as two texts
at the bound differ in about ten bits where trees look for three, texts whose sets of shingles a prefix filter can't rule
out. Every candidate is then checked exactly.

A text is the set of its shingles' 64-bit hashes. Two sets are linked if they share at least NUM / DEN of their union. All
such pairs are found: sets are put in one common order, and two that are linked share an element among the first
``n - ceil(n * NUM / DEN) + 1`` of each (prefix filter). Elements that a sample of texts holds often come last in the
order, so boilerplate rarely joins texts; the order decides how many sets meet, never which are linked.

Sets that share an element of their prefixes are candidates unless their sizes, or their counts of elements in BINS bins,
differ by more than linked sets can (counts differ by no more than the sets do). Components of candidates are compared pair by pair; a component of over BLOCK sets is split into blocks of which every two meet, so that no task takes
a whole component. Only texts of candidates are brought together, and hashed again. The links found are the edges of the
groups.

Edge cases: a null or empty text is the empty set, which is linked to itself only; texts with fewer words than a shingle
hash their whole sequence; repeated rows and null ids take part as any other; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.llm import simhash
from gatewarden.llm.common import released, written
from gatewarden.llm.sieve import maybe, passing, sieve
from gatewarden.llm.simhash import SEED, _Forest, components, of_hashes, one_of_each, shingle_hashes

#: Words of a shingle; the least similarity, as a fraction.
SHINGLE, NUM, DEN = 5, 4, 5
#: Sets of a block, on average, when texts are compared and when sketches meet; one text in SAMPLE is counted for the
#: order, and at most HOT elements come last. Elements of a block's sets together, on average, when texts are compared.
#: Bins of fine sketches: BINS of them don't tell sets of over some 3,000 elements apart, as chance differences are then below the bound.
BLOCK, MEET, SAMPLE, HOT, BINS = 1024, 4096, 16, 200_000, 128
HELD, FINE = 2_000_000, 2048
_TOKENS = 4096


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, size), dtype="<u8"))


def prefix_length(n: int) -> int:
    return n + (-NUM * n // DEN) + 1 if n else 0


def _frequent(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that several texts of the sample hold, ascending, and how many hold each."""
    sample = docs.select(F.col(f"`{text}`").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = [shingles(x.as_py(), size) for x in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["element"])

    counts = sample.mapInArrow(run, "element bigint").groupBy("element").agg(F.count("*").alias("n")).filter("n > 1")
    found = counts.orderBy(F.desc("n"), "element").limit(HOT).toArrow()
    elements = found["element"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(elements)
    return elements[order], found["n"].to_numpy()[order]


def sets(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` (id, row, text) as (id, row, key, n, prefix, sketch, fp): the key of equal sets, their size, the prefix as
    32-bit numbers (equal elements have equal ones), counts by bin, 255 at most, and the SimHash fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        often, counts = shared.value

        def prefix(found: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(often, found), max(len(often) - 1, 0))
            weight = np.where(often[at] == found, counts[at], 0) if len(often) else np.zeros(len(found))
            return found[np.lexsort((found, weight))][: prefix_length(len(found))].astype(np.uint32).view(np.int32)

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                hashes = [shingle_hashes(x.as_py(), size) for x in part.column(2)]
                found = [np.unique(np.array(h, dtype="<u8")) for h in hashes]
                fps = pa.array(np.array([of_hashes(h) for h in hashes], dtype=np.uint64).view(np.int64))
                keys = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in found], dtype=np.uint64).view(np.int64)
                made = [pa.array(keys), pa.array([len(x) for x in found], pa.int32()), pa.array([prefix(x) for x in found], pa.list_(pa.int32())), pa.array([_counts(x, BINS) for x in found], pa.binary()), fps]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["id", "row", "key", "n", "prefix", "sketch", "fp"])

    return docs.select("id", "row", F.col(f"`{text}`")).mapInArrow(run, "id bigint, row bigint, key bigint, n int, prefix array<int>, sketch binary, fp bigint")


def _dealt(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Rows (group, blocks, key, ...) with those of a group together, or of every two of its blocks, by key."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
    rows = rows.select(group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "key", *columns)
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "key")


def _blocks(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int").alias("blocks")


def near(n: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches don't rule out, by their places."""
    group = np.arange(len(n))
    # Bins of bins rule out most of what fine ones would.
    coarse = sketches.reshape(len(n), -1, BINS).sum(axis=1, dtype=np.int32) if sketches.shape[1] > BINS else None
    for i in range(len(n) - 1):
        j = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        j = j[(np.minimum(n[i], n[j]) * DEN >= np.maximum(n[i], n[j]) * NUM)]
        if len(j) and coarse is not None:
            apart = np.abs(coarse[j] - coarse[i]).sum(axis=1, dtype=np.int64)
            j = j[apart * (DEN + NUM) <= (n[i] + n[j]) * (DEN - NUM)]
        if len(j):
            apart = np.abs(sketches[j] - sketches[i]).sum(axis=1, dtype=np.int64)
            j = j[apart * (DEN + NUM) <= (n[i] + n[j]) * (DEN - NUM)]
            for other, at in zip(*np.unique(group[j], return_index=True), strict=True):
                group[group == other] = group[i]
                yield i, int(j[at])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of rows (element, x, y, key, n, sketch) that come group by group."""

    def ended(members: list[tuple]) -> pa.RecordBatch:
        pairs = []
        if len(members) > 1:
            sketches = np.frombuffer(b"".join(m[2] for m in members), np.uint8).reshape(len(members), -1).astype(np.int16)
            pairs = [(members[i][0], members[j][0]) for i, j in near(np.array([m[1] for m in members]), sketches)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    now, members = None, []
    for batch in batches:
        made = []
        for *group, key, n, sketch in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if group != now:
                made.append(ended(members))
                now, members = group, []
            members.append((key, n, sketch))
        yield from pa.Table.from_batches(made).combine_chunks().to_batches() if made else []
    yield ended(members)


def candidates(own: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the candidates among ``own`` (key, n, prefix, sketch), a table in which keys repeat."""
    # Only sets that may be there several times are moved to find out.
    several = maybe(sieve(own.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")), F.col("key"))
    own = own.select("key", "n", "prefix", "sketch")
    once = written(own.filter(~several).union(own.filter(several).dropDuplicates(["key"])), "once")
    rows = once.select("key", F.explode(F.array_distinct("prefix")).alias("element"))
    # Counted before they are shuffled: an element may be in a third of all prefixes. Elements in the same sets' prefixes
    # connect the same sets, so one of them stands for all; keys are hashes, so their number and exclusive or tell the sets.
    times = rows.groupBy("element").agg(F.count("*").alias("times"), F.bit_xor("key").alias("held")).filter("times > 1")
    stands = times.groupBy("times", "held").agg(F.min("element").alias("element"))
    stands = written(stands.select("element", _blocks(F.col("times"), MEET)), "stands")
    # Most elements of prefixes stand for nothing and aren't moved again.
    rows = _sifted(once, sieve(stands.select("element"))).join(stands, "element").select("element", "key", "blocks")
    met = _dealt(rows.join(once.select("key", "n", "sketch"), "key"), "element", "n", "sketch").mapInArrow(_met, "a bigint, b bigint")
    found = written(met.distinct(), "met")
    released(once, stands)
    return found


def _sifted(once: DataFrame, held: Broadcast) -> DataFrame:
    """(key, element) of ``once`` (key, prefix) for each element of a prefix that may be in the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, prefix = batch.column(0).to_numpy(), batch.column(1)
            keys, elements = np.repeat(key, prefix.value_lengths().to_numpy()), prefix.flatten().to_numpy()
            left = passing(held.value, elements)
            yield pa.RecordBatch.from_arrays([pa.array(keys[left]), pa.array(elements[left])], names=["key", "element"])

    return once.select("key", F.array_distinct("prefix").alias("prefix")).mapInArrow(run, "key bigint, element int")


def _held(nodes: DataFrame) -> tuple[Broadcast, Column]:
    """A sieve of the rows that ``nodes`` (id, row), a table, names, and the key that a row has there."""
    at = F.xxhash64("id", "row")
    return sieve(nodes.select(at)), at


def alike(own: DataFrame) -> DataFrame:
    """Edges (a, b) between keys of ``own`` (key, fp) whose SimHash fingerprints are linked, found with BK-trees."""
    nodes = written(own.groupBy("fp").agg(F.min("key").alias("node")), "nodes")
    same = own.select("fp", F.col("key").alias("a")).distinct().join(nodes, "fp").filter("a <> node").select("a", F.col("node").alias("b"))
    return same.union(simhash.links(nodes, simhash.blocks_for(nodes.count())))


def linked(found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among sets, by their places."""
    n = np.array([len(x) for x in found], dtype=np.int64)
    if len(found) == 2:
        common = np.array([[0, len(np.intersect1d(*found, assume_unique=True))], [0, 0]])
    else:
        elements, place, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(found)), n)
        several = times > 1
        number = np.cumsum(several) - 1
        inside = several[place]
        owner, place = owner[inside], number[place[inside]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common = np.zeros((len(found), len(found)), np.float64)
        for at in range(0, int(several.sum()), _TOKENS):
            i, j = np.searchsorted(place, [at, at + _TOKENS])
            part = np.zeros((len(found), _TOKENS), np.float32)
            part[owner[i:j], place[i:j] - at] = 1
            common += part @ part.T
    forest = _Forest()
    for i, j in zip(*np.nonzero(np.triu(common * (NUM + DEN) >= NUM * (n[:, None] + n[None, :]), 1)), strict=True):
        if forest.join(int(i), int(j)):
            yield int(i), int(j)


def _compared(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (component, x, y, key, text) that come group by group, and in a group by key."""

    def ended(keys: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = [(keys[i], keys[j]) for i, j in linked(found)] if len(keys) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    now, keys, found = None, [], []
    for batch in batches:
        for *group, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if group != now:
                yield ended(keys, found)
                now, keys, found = group, [], []
            if keys[-1:] != [key]:  # rows equal in every column
                keys.append(key)
                found.append(shingles(text, size))
    yield ended(keys, found)


def _members(parts: DataFrame, reps: DataFrame) -> DataFrame:
    """Where the text of each node of components (node, component) is, and into how many blocks its component is split:
    (component, all, blocks, key, n, id, row), all being its number of nodes."""
    whole = parts.select("node", "component").union(parts.select(F.col("component").alias("node"), "component")).distinct()
    found = written(whole.join(reps, F.col("node") == F.col("key")).select("component", "key", "n", "at.id", "at.row"), "parts")
    blocks = F.greatest(*[F.ceil(n / most).cast("int") for n, most in ((F.count("*"), BLOCK), (F.sum("n"), HELD))])
    sizes = found.groupBy("component").agg(F.count("*").alias("all"), blocks.alias("blocks"))
    out = written(found.join(sizes, "component").select("component", "all", "blocks", "key", "n", "id", "row"), "members")
    released(found)
    return out


def _fine(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(id, row, sketch), counts by FINE bins, of the rows of ``docs`` (id, row, text) that ``nodes`` (id, row), a table,
    names, and of few others."""
    held, at = _held(nodes)

    # The sieve is asked here, as a function of its own would take a second Python process for each task.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passing(held.value, batch.column(3).to_numpy())))
            made = [_counts(shingles(x.as_py(), size), FINE) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], names=["id", "row", "sketch"])

    return docs.select("id", "row", "text", at).mapInArrow(run, "id bigint, row bigint, sketch binary")


def _counts(found: np.ndarray, bins: int) -> bytes:
    """How many elements are in each bin, 255 at most."""
    return np.minimum(np.bincount((found % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def links(docs: DataFrame, own: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Edges (a, b) between keys that connect the sets that are linked; ``own``: the sets of ``docs``, a table."""
    met, near = candidates(own), alike(own)
    edges = written(met.union(near), "candidates")
    released(met)
    reps = own.groupBy("key").agg(F.min(F.struct("id", "row")).alias("at"), F.max("n").alias("n"))
    nodes = _members(components(edges), reps)
    large = F.col("blocks") > 1
    if not nodes.filter(large).isEmpty():
        # Fine sketches are a fraction of long texts, and part what coarse ones can't; they are made before they are moved.
        wide = nodes.filter(large).withColumn("blocks", F.ceil(F.col("all") / (2 * BLOCK)).cast("int"))
        fine = wide.join(_fine(docs, wide, size), ["id", "row"]).select("component", "blocks", "key", "n", "sketch")
        apart = components(written(_dealt(fine, "component", "n", "sketch").mapInArrow(_met, "a bigint, b bigint"), "apart"))
        small = nodes.filter(~large).select(F.col("key").alias("node"), "component")
        before, nodes = nodes, _members(apart.union(small), reps)
        released(before)
    held, at = _held(nodes)
    dealt = _dealt(nodes.join(docs.filter(maybe(held, at)), ["id", "row"]), "component", "text")
    return dealt.mapInArrow(lambda batches: _compared(batches, size), "a bigint, b bigint")


def rooted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, row, root) of ``docs`` (id, row, text), a table: the smallest key reachable by links."""
    own = written(sets(docs, size=size), "sets")
    groups = components(written(links(docs, own, size), "links")).withColumnRenamed("node", "key")
    found = own.select("id", "row", "key").join(groups, "key", "left").select("id", "row", F.coalesce("component", "key").alias("root"))
    found = written(found, "rooted")
    released(own, groups)
    return found


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row of each group stays, chosen as in ``simhash.deduplicated``."""
    return one_of_each(docs, lambda narrow: rooted(narrow.select("id", "row", "text"), size), doc_id, text)
