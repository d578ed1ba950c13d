"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest permitted length are cut into full sequences and a
rest. Pieces are dealt by hash to shards of about ``shard`` pieces, so that shards pack on
their own, in parallel, with little lost at their ends. A shard packs its pieces from
the longest down: each goes to the open bin that it fills best, of equal ones to that opened last. Where none has room, all
permitted lengths are tried: each is filled, on paper, with the piece and the longest of the pieces still to
come that fit, and the length opens whose cost a word is then least. At the end every
bin is downsized to the least permitted length that holds its contents.

A sequence costs its length, a fixed overhead, and attention, which grows with the square
of the length: so neither the longest nor the shortest length is cheapest by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Permitted lengths, the overhead of a sequence, and the length at which attention costs as much as the rest; in words.
LENGTHS = (256, 512, 1024, 2048)
OVERHEAD, ATTENTION = 16, 32_768
#: Pieces of a shard, equal rows that are numbered at a time.
SHARD, COPIES = 20_000, 10_000


def cost(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return overhead + length + length * length / attention


class Waiting:
    """The sizes still to come: how many of each, and a bit for each size that is there."""

    def __init__(self, sizes: Sequence[int]):
        self.count = Counter(sizes)
        self.some = sum(1 << s for s in self.count)

    def drop(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.some ^= 1 << size

    def filled(self, room: int) -> int:
        """Words that the longest of the waiting pieces fill of ``room``, longest first."""
        begin, some = room, self.some & (1 << room + 1) - 1
        while some:
            size = some.bit_length() - 1
            room -= size * min(self.count[size], room // size)
            some &= (1 << min(size, room + 1)) - 1  # shorter ones that still fit
        return begin - room


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each piece (in the order given, longest first), each bin's length, and the length it opened with."""
    lengths = sorted(lengths)
    price = {x: cost(x, overhead, attention) for x in lengths}
    waiting = Waiting(sizes)
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by what they have left, as heaps with the last opened in front
    some = 0  # bit r: room[r] isn't empty
    bins, offsets, filled, opened = [], [], [], []

    def worth(length: int, size: int) -> tuple[float, int]:
        held = size + waiting.filled(length - size)
        return price[next(x for x in lengths if x >= held)] / held, length

    for size in sizes:
        waiting.drop(size)
        fit = some >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = -heappop(room[left])
            if not room[left]:
                some ^= 1 << left
        else:
            left = min((x for x in lengths if x >= size), key=lambda x: worth(x, size))
            b = len(filled)
            filled.append(0)
            opened.append(left)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += size
        left -= size
        if left:
            heappush(room[left], -b)
            some |= 1 << left
    return bins, offsets, [next(x for x in lengths if x >= f) for f in filled], opened


def _shard(lengths: Sequence[int], overhead: int, attention: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("tie", "ascending"), ("piece", "ascending")])
        bins, offsets, length, _ = pack(table.column("size").to_pylist(), lengths, overhead, attention)
        return pa.table(
            {
                "id": table.column("id"),
                "piece": table.column("piece"),
                "start": table.column("start"),
                "size": table.column("size"),
                "shard": table.column("shard"),
                "bin": pa.array(bins, pa.int32()),
                "bin_offset": pa.array(offsets, pa.int32()),
                "capacity": pa.array(np.array(length, dtype=np.int32)[bins] if bins else [], pa.int32()),
            }
        )

    return run


def packed(sized: DataFrame, id_col: str, size_col: str, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION, shard: int = SHARD) -> DataFrame:
    """(id, piece, start, size, bin_id string, bin_offset, capacity): one row a piece.

    Null or zero sizes pack nothing and give no row. Repeated rows are packed as often as
    they come; they are counted and numbered, so that rows of one id and size (all without
    an id, say) are dealt to all shards. Bins are named ``shard-number``; reruns on equal
    rows agree. An empty table gives an empty result.
    """
    top = max(lengths)
    sized = sized.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("total")).where("total > 0")
    equal = staged(sized.groupBy("id", "total").agg(F.count("*").alias("copies")), "packing-sizes")
    n = equal.agg(F.sum(F.col("copies") * F.ceil(F.col("total") / top))).first()[0] or 0  # one number
    shards = max(1, round(n / shard))
    # the copies of a row are written out in lots, and the lots spread first
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("id", "total", "lot")
    first = F.col("lot") * COPIES
    each = lots.select("id", "total", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)).alias("copy"))
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / top).cast("int"))))
    start = F.col("piece") * F.lit(top).cast("long")
    pieces = pieces.withColumn("start", start).withColumn("size", F.least(F.col("total") - start, F.lit(top)).cast("int"))
    tie = F.xxhash64("id", "total", "copy", "piece")
    dealt = pieces.withColumn("tie", tie).withColumn("shard", F.pmod("tie", F.lit(shards)).cast("int")).drop("total", "copy")
    done = dealt.groupBy("shard").applyInArrow(_shard(tuple(lengths), overhead, attention), _packed_type(sized.schema["id"].dataType.simpleString()))
    return done.select(F.col("id").alias(id_col), "piece", "start", "size", F.concat_ws("-", "shard", "bin").alias("bin_id"), "bin_offset", "capacity")


def _packed_type(id_type: str) -> str:
    return f"id {id_type}, piece int, start long, size int, shard int, bin int, bin_offset int, capacity int"
