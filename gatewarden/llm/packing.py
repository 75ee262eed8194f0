"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest capacity are cut into full bins and a remainder; nothing is dropped. Pieces are dealt to
shards of about SHARD by a hash, and each shard is packed by itself: pieces in falling order of length go to the open
bin that they leave least room in; if none has room, a bin is opened. The size to open is the one with the least cost a
unit filled, over the bin's likely content: the piece and the longest of the pieces still to come that fit beside it.
At the end each bin shrinks to the smallest permitted length that holds its contents, so the lengths are decided jointly
by what came together and not beforehand.

Lengths are numbers; the query takes UTF-8 bytes, which costs one pass over the texts. No text moves: only ids and
lengths are shuffled, and the result says where each piece goes.

Edge cases: null and empty texts have length 0 and get no bin (bin, capacity and place null), one row each; equal pieces
go in order of id and copy; repeated rows are packed as often as they occur; an empty table gives no rows; extra columns
are left alone.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.common import table

CAPACITIES = (2_048, 4_096, 8_192, 16_384)
#: What a bin costs besides its length: the overhead of one more sequence.
OPEN_COST = 64
SHARD = 1_024
RESULT = "doc_id bigint, doc_length bigint, copy bigint, piece bigint, piece_start bigint, piece_length bigint, bin string, capacity bigint, place bigint"


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, open_cost: int = OPEN_COST) -> tuple[list[int], list[int]]:
    """The bin of each length, which must be falling and at most the largest capacity, and each bin's capacity."""
    sizes = sorted(capacities)
    rising = lengths[::-1]  # those still to come are a prefix of this
    rooms: list[tuple[int, int]] = []  # (room, bin), by room
    bins, used, opened = [], [], []
    for k, length in enumerate(lengths):
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(opened)
            room = _best_size(length, sizes, rising, len(lengths) - k - 1, open_cost)
            opened.append(room)
            used.append(0)
        bins.append(b)
        used[b] += length
        if room > length:
            insort(rooms, (room - length, b))
    return bins, [next(s for s in sizes if s >= u) for u in used]


def _best_size(length: int, sizes: list[int], rising: list[int], left: int, open_cost: int) -> int:
    """The permitted size with the least cost for each unit that the piece and the longest later ones beside it fill."""
    best, least = sizes[-1], None
    for size in sizes:
        if size < length:
            continue
        filled, to = length, left
        while filled < size and (to := bisect_left(rising, size - filled + 1, 0, to)) > 0:
            to -= 1
            filled += rising[to]
        cost = (size + open_cost) / filled
        if least is None or cost < least - 1e-12:
            best, least = size, cost
    return best


def _shard_rows(shard: int, rows: list[tuple], capacities: tuple[int, ...], open_cost: int) -> Iterator[tuple]:
    """Rows (doc_id, doc_length, copy, piece, start, length) of a shard with bin, capacity and place in the bin."""
    rows.sort(key=lambda r: (-r[5], r[0] is None, r[0] or 0, *r[1:4]))
    bins, sizes = pack([r[5] for r in rows], capacities, open_cost)
    places = [0] * len(sizes)
    for r, b in zip(rows, bins, strict=True):
        yield (*r, f"{shard}-{b}", sizes[b], places[b])
        places[b] += r[5]


def packed(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, open_cost: int = OPEN_COST, shard: int = SHARD) -> DataFrame:
    """Rows of RESULT for (doc_id, length); a text is known by its id, its length and its number among equal rows. Equal
    rows are counted before they are numbered as copies, so ids that repeat, null ones too, spread over the shards."""
    largest = max(capacities)
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length"))
    n = rows.count()
    shards = max(1, -(-n // shard))
    counted = rows.groupBy("doc_id", "length").agg(F.count("*").alias("n"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pieces_of = F.greatest(F.ceil(F.col("length") / largest), F.lit(1)).cast("long")
    pieces = copies.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces_of - 1)))
    start = F.col("piece") * largest
    pieces = pieces.select("doc_id", F.col("length").alias("doc_length"), "copy", "piece", start.alias("piece_start"), F.least(F.col("length") - start, F.lit(largest)).alias("piece_length"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_length", "copy", "piece"), F.lit(shards)))
    names = ["doc_id", "doc_length", "copy", "piece", "piece_start", "piece_length", "bin", "capacity", "place"]
    types = [pa.string() if c == "bin" else pa.int64() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        now, own = None, []
        for batch in batches:
            for s, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != now and own:
                    yield made(list(_shard_rows(now, own, capacities, open_cost)))
                    own = []
                now = s
                own.append(tuple(row))
        if own:
            yield made(list(_shard_rows(now, own, capacities, open_cost)))

    filled = dealt.filter("piece_length > 0").select("shard", *names[:6]).repartition("shard").sortWithinPartitions("shard")
    empty = pieces.filter("piece_length = 0").select(*names[:6], F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("capacity"), F.lit(None).cast("long").alias("place"))
    return filled.mapInArrow(run, RESULT).unionByName(empty)


def byte_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def op8(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", byte_length(F.col("text")).alias("length")))
