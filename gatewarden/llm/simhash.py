"""SimHash near-duplicates, searched with BK-trees.

``fingerprints`` gives each text's 64-bit fingerprint. Two that differ in at most RADIUS bits agree on at least
``blocks - RADIUS`` of ``blocks`` equal blocks of bits, so for each choice of that many blocks the fingerprints are dealt
out by the bits they have there, and only those dealt together are compared: no pair within the radius is lost. Each
group builds a BK-tree (children keyed by their integer Hamming distance to the parent) and looks itself up in it,
following only edges within the radius. A group of over SHARD members is dealt out again by parts of its other bits; what is
still over it is split: each member stands in the tree of one shard and is looked up in all of them, so that trees are bounded
and no task takes a whole group.

Trees travel by the exchange that builds them rather than by broadcast: broadcast to all, every fingerprint would meet
every tree, whose number grows with the corpus.

A group yields a spanning forest of its links, not all its pairs. Components come from alternating large-star and
small-star rounds over these edges, each round a written table; once SETTLED edges or fewer are left, one task joins them.

Edge cases: a null or empty text has fingerprint 0 and links like any other; texts of one or two words hash their whole
sequence; a null doc_id takes part in links but is never a component's id (null if no other is there); repeated rows are
kept, each with its component; very long texts are hashed in slices; an empty table gives an empty result; extra columns pass
through ``deduplicated``. Ids are whole numbers or their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.common import fresh
from gatewarden.llm.common import others as kept
from gatewarden.llm.common import released, table, written
from gatewarden.llm.sieve import maybe, sieve

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Members of a shard's tree, on average; fingerprints a bucket should hold, which decides the number of blocks.
SHARD, BUCKET = 512, 64
#: Edges that one task may hold (about 150 MB of its memory).
SETTLED = 500_000
#: Node ids of fingerprints that only rows without doc_id have start here.
NO_ID = 1 << 62
_SLICE = 200_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """Hashes of a text's shingles, repeats included; of its whole sequence if that is shorter."""
    from xxhash import xxh64_intdigest

    # On bytes, lower() knows A-Z only and split() exactly the six separators.
    w = (text or "").encode("utf-8").lower().split()
    parts = zip(*[w[k:] for k in range(size)], strict=False) if len(w) >= size else [w] if w else []
    return [xxh64_intdigest(b" ".join(x), SEED) for x in parts]


def of_hashes(h: list[int]) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if it is in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), _SLICE):
        part = np.array(h[at : at + _SLICE], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    return of_hashes(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint as a signed 64-bit integer."""
    from pyspark.sql import types as T

    others = kept(docs, text, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(len(others))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(found)], names=[*[f.name for f in others], to])

    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text}`")).mapInArrow(run, T.StructType([*others, T.StructField(to, T.LongType())]))


class Tree:
    """A BK-tree over (fingerprint, node)."""

    def __init__(self):
        self.root: list | None = None

    def within(self, fp: int) -> list[int]:
        """Nodes at most RADIUS bits away."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, node, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= RADIUS:
                found.append(node)
            if children:
                todo.extend([c for k, c in children.items() if d - RADIUS <= k <= d + RADIUS])
        return found

    def add(self, fp: int, node: int) -> None:
        new = [fp, node, {}]
        if self.root is None:
            self.root = new
            return
        at = self.root
        while True:
            d = (at[0] ^ fp).bit_count()
            child = at[2].get(d)
            if child is None:
                at[2][d] = new
                return
            at = child


class _Forest:
    """Joins nodes; says whether that linked something new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _links(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """Forest edges of rows (key..., is_query, fp, node) that come group by group, a group's members before its queries."""
    key = None
    tree, forest = Tree(), _Forest()
    for *now, is_query, fp, node in rows:
        if now != key:
            key, tree, forest = now, Tree(), _Forest()
        fp &= (1 << BITS) - 1  # distances are counted on unsigned numbers
        for other in tree.within(fp):
            if forest.join(node, other):
                yield node, other
        if not is_query:
            tree.add(fp, node)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    a, b = [], []
    for x, y in _links(rows()):
        a.append(x)
        b.append(y)
        if len(a) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _keys(fp: Column, blocks: int) -> list[Column]:
    """For each choice of blocks - RADIUS blocks, the bits of the fingerprint there."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - RADIUS):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        out.append(fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask)))
    return out


def _parts(fp: Column, choice: Column, blocks: int) -> Column:
    """The bits of a fingerprint in RADIUS + 1 equal parts of what a choice of blocks leaves, each in its place."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    out = F.array().cast("array<bigint>")
    for number, chosen in enumerate(combinations(range(blocks), blocks - RADIUS)):
        free = [i for k in range(blocks) if k not in chosen for i in range(edges[k], edges[k + 1])]
        cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
        masks = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        masked = F.array(*[fp.bitwiseAND(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m)) for m in masks])
        out = F.when(choice == number, masked).otherwise(out)
    return out


def blocks_for(n: int) -> int:
    """The fewest blocks whose buckets hold about BUCKET fingerprints or fewer."""
    for blocks in (4, 5, 6, 7):
        if n / 2 ** (BITS * (blocks - RADIUS) // blocks) <= BUCKET:
            break
    return blocks


def links(nodes: DataFrame, blocks: int) -> DataFrame:
    """Edges (a, b) that connect what the links among ``nodes`` (fp distinct, node) connect, as a table.

    A bucket of over SHARD members is dealt out again by what its fingerprints have in the other blocks: cut in
    RADIUS + 1 parts there, two within the radius agree on one part at least. What is still over SHARD is split into shards' trees.
    """
    keyed = nodes.select("fp", "node", F.posexplode(F.array(*_keys(F.col("fp"), blocks))).alias("choice", "bits"))
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n"))
    # Tables, so that their size is known: they are broadcast if small, else both sides are dealt out and skew can be split.
    hot = written(sizes.filter(F.col("n") > SHARD).select("choice", "bits", F.lit(True).alias("hot")), "hot")
    marked = keyed.join(hot, ["choice", "bits"], "left").withColumns({"part": F.lit(-1), "sub": F.lit(0).cast("long")})
    cold = marked.filter("hot IS NULL").drop("hot")
    again = marked.filter("hot").select("fp", "node", "choice", "bits", F.posexplode(_parts(F.col("fp"), F.col("choice"), blocks)).alias("part", "sub"))
    again = written(again, "again")
    key = ["choice", "bits", "part", "sub"]
    large = again.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > SHARD)
    large = written(large.select(*key, F.ceil(F.col("n") / SHARD).cast("int").alias("shards")), "large")
    placed = cold.select("fp", "node", *key).withColumn("shards", F.lit(1))
    placed = placed.union(again.join(large, key, "left").select("fp", "node", *key, F.coalesce("shards", F.lit(1))))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    placed = placed.withColumn("own", own).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    placed = placed.select(*key, "shard", (F.col("own") != F.col("shard")).alias("is_query"), "fp", "node")
    dealt = placed.repartition(*key, "shard").sortWithinPartitions(*key, "shard", "is_query", "fp")
    found = written(dealt.mapInArrow(_search, "a bigint, b bigint"), "links")
    released(hot, again, large)
    return found


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, itself included."""
    both = _both_ways(edges)
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    out = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
    released(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
    released(least)
    return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and the smallest node of their component, for all edges at once; smallest nodes themselves are left out."""
    forest = _Forest()
    for batch in batches:
        for a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            forest.join(a, b)
    nodes = list(forest.up)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, [forest.top(n) for n in nodes])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges but the components' own; the component is its smallest node. ``edges``
    must be a table; it is deleted, as are the tables of all rounds but the last."""
    now, size, before = edges, edges.count(), None
    while size > SETTLED:
        large = _large_star(now)
        after = _small_star(large)
        size, mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        released(now, large)
        now = after
        if (size, mark) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = size, mark
    found = written(now.select("a", "b").coalesce(1).mapInArrow(_settled, "node bigint, component bigint"), "components")
    released(now)
    return found


def rooted(fps: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``fps``, a table with ids and fingerprints, with ``root``: the smallest node reachable by links. A fingerprint's
    node is its smallest id, or a number from NO_ID on if it has none."""
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.col("fp"), 2)
    # Two fingerprints with one stand-in differ in the last two bits only, so they are linked in any case.
    nodes = fps.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).cast("long").alias("node"))
    nodes = written(nodes.select("fp", F.coalesce("node", stand_in).alias("node")), "nodes")
    found = components(links(nodes, blocks_for(nodes.count())))
    of_fp = nodes.join(found, "node", "left").select(F.col("fp").alias(fp), F.coalesce("component", "node").alias("root"))
    return fps.join(of_fp, fp)


def grouped(fps: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``fps`` with ``component_id``: the smallest id reachable by links, itself included; null where none has one."""
    root = F.col("root")
    return rooted(fps, doc_id, fp).withColumn("component_id", F.when(root < NO_ID, root)).drop("root")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked fingerprints stays."""
    return one_of_each(docs, lambda narrow: written(rooted(written(fingerprints(narrow), "fps")), "rooted"), doc_id, text)


def one_of_each(docs: DataFrame, groups_of: Callable[[DataFrame], DataFrame], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group stays: that with the smallest id, and of rows with the same id the one with the smallest
    hash of all columns; of rows equal in every column, one. ``groups_of`` gives (id, row, doc_id, text) its ``root``, as a table."""
    keyed, at = fresh(docs, row=F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), id=F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)))
    pair = [at["id"], at["row"]]
    narrow = keyed.select(F.col(at["id"]).alias("id"), F.col(at["row"]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = groups_of(narrow).select("id", "row", "root")
    best = found.groupBy("root").agg(F.min(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))
    several = written(best.filter("n > 1").select("root", "best"), "best")
    lost = found.join(several, "root").filter(F.struct("id", "row") != F.col("best")).select("id", "row")
    repeated = found.groupBy("id", "row").agg(F.count("*").alias("n")).filter("n > 1").select("id", "row")
    # What is neither lost nor repeated stays and isn't moved; what may be is settled by the exact join.
    open_ = maybe(sieve(lost.union(repeated).select(F.xxhash64("id", "row"))), F.xxhash64(*pair))
    released(several)
    stay = best.select(F.col("best.id").alias(at["id"]), F.col("best.row").alias(at["row"]))
    return keyed.filter(~open_).unionByName(keyed.filter(open_).join(stay, pair, "left_semi").dropDuplicates(pair)).drop(*pair)


def op10(spark, sf_dir: str) -> DataFrame:
    fps = written(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "fps")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(fps).select("doc_id", hexed.alias("fingerprint"), "component_id")

