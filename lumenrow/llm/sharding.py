"""Sharding by minimax contiguous partition, in DataFrame operations only.

Rows of equal text are one atomic group.  Groups are put in order of size,
largest first, so that the last to fill a shard are the smallest.  The smallest
capacity at which greedy filling needs no more than the wanted number of shards
is found by binary search, and the order is cut there.

The greedy check needs only how many groups have each size.  That table, with the
groups and bytes before each size, stays distributed.  The driver asks it where
prefixes of so many bytes end, for a block of capacities at once, and gets a row for
each question; so it holds numbers in proportion to the shards only.

At the smallest capacity many cuts are possible.  Of those, each is put nearest to its
even share of the bytes, with no shard empty while there are as many groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Capacities tried in one pass over the sizes.
TRIED = 256
#: Rows and groups are numbered inside this many parts first, so that no task numbers a whole shard.
PARTS = 4096


class Runs:
    """Groups in order, largest size first, asked by prefixes: (groups, bytes)."""

    def __init__(self, groups: DataFrame) -> None:
        """``groups``: weight, a row for each group."""
        runs = cut(groups.groupBy("weight").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.sqrt("weight"))), "sizes")
        sums = runs.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("bytes"))
        ahead = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("groups_ahead"), F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"))
        inside = Window.partitionBy("part").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c, x: (F.col(f"{c}_ahead") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(f"{c}_before")
        self.table = cut(runs.join(sums, "part").select("weight", "n", before("groups", F.col("n")), before("bytes", F.col("n") * F.col("weight"))), "runs", runs)
        r = self.table.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("bytes"), F.max("weight").alias("top")).first()
        self.end, self.top = (r["n"] or 0, r["bytes"] or 0), r["top"] or 0

    def ask(self, unit: int, places: list[int]) -> list[Row]:
        """The run that holds the group at each place, counted in groups (unit 0) or bytes (unit 1); places are before the end."""
        if not places:
            return []
        c = ("groups", "bytes")[unit]
        last = F.col(f"{c}_before") + F.col("n") * (F.col("weight") if unit else F.lit(1))
        asked = F.expr(f"array({', '.join(f'{x}L' for x in sorted(set(places)))})")
        rows = self.table.select("*", F.explode(F.filter(asked, lambda x: (x >= F.col(f"{c}_before")) & (x < last))).alias("place"))
        got = {r["place"]: r for r in rows.collect()}
        return [got[x] for x in places]

    def at_bytes(self, places: list[int], way: int) -> list[tuple[int, int]]:
        """The longest prefixes of no more bytes (way -1), the shortest of no fewer (1), or the nearest (0)."""
        inside = [(i, x) for i, x in enumerate(places) if 0 < x < self.end[1]]
        out = [self.end if x >= self.end[1] else (0, 0) for x in places]
        for (i, x), r in zip(inside, self.ask(1, [x for _, x in inside]), strict=True):
            fit, over = divmod(x - r["bytes_before"], r["weight"])
            fit += way > 0 and over > 0 or way == 0 and 2 * over >= r["weight"]
            out[i] = (r["groups_before"] + fit, r["bytes_before"] + fit * r["weight"])
        return out

    def at_groups(self, places: list[int]) -> list[tuple[int, int]]:
        inside = [(i, x) for i, x in enumerate(places) if 0 < x < self.end[0]]
        out = [self.end if x >= self.end[0] else (0, 0) for x in places]
        for (i, x), r in zip(inside, self.ask(0, [x for _, x in inside]), strict=True):
            out[i] = (x, r["bytes_before"] + (x - r["groups_before"]) * r["weight"])
        return out


def smallest_capacity(runs: Runs, shards: int) -> int:
    """By trying ``TRIED`` capacities at once, each filled greedily; that of an even share and one group more always does."""
    even = -(-runs.end[1] // shards)
    low, high = max(even, runs.top), even + runs.top
    while low < high:
        step = max(1, -(-(high - low) // TRIED))
        tried = list(range(low, high, step))
        ends = [0] * len(tried)
        for _ in range(shards):
            ends = [b for _, b in runs.at_bytes([e + c for e, c in zip(ends, tried, strict=True)], -1)]
        done = [c for c, e in zip(tried, ends, strict=True) if e == runs.end[1]]
        failed = [c for c, e in zip(tried, ends, strict=True) if e < runs.end[1]]
        low, high = max(failed, default=low - 1) + 1, min(done, default=high)
    return low


def cuts_at(runs: Runs, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Prefixes where shards 0 to ``shards`` - 2 end."""
    total, least = runs.end[1], [runs.end]
    for _ in range(shards - 1):  # the shortest prefixes whose rest fits into the shards that are left
        least.append(runs.at_bytes([least[-1][1] - capacity], 1)[0])
    least, cuts, last = least[::-1], [], (0, 0)
    for j in range(1, shards):
        most, near = runs.at_bytes([last[1] + capacity], -1)[0], runs.at_bytes([total * j // shards], 0)[0]
        low = max(least[j - 1][0], min(last[0] + 1, runs.end[0]))
        high = max(low, min(most[0], runs.end[0] - (shards - j)))
        last = runs.at_groups([min(max(near[0], low), high)])[0]
        cuts.append(last)
    return cuts


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot (from 0, gapless in each shard), grown_shard (null); a row for each row.

    A null text has no bytes: size 1, the checksum of nothing, and the group of the
    empty text.  Null ids are placed like others.  Repeated rows of one text share
    a shard and have slots of their own.  Of equal-sized groups the hash of the text
    decides the order.  Texts of any length count whole.  Other columns aren't read; an
    empty table gives none.  Copies of one text are joined with their shard under
    adaptive execution, which splits a hot one.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
    )
    rows = cut(rows, "rows")
    key = ["hash", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("copies")).withColumn("weight", F.col("size") * F.col("copies"))
    groups = cut(groups, "groups")
    runs = Runs(groups)
    ends = cuts_at(runs, smallest_capacity(runs, shards), shards)
    inside = [(shard, at) for shard, (at, _) in enumerate(ends) if at < runs.end[0]]
    # (size, groups of that size before the cut, shard that ends there)
    cuts = [(r["weight"], at - r["groups_before"], shard) for (shard, at), r in zip(inside, runs.ask(0, [at for _, at in inside]), strict=True)]
    discard(runs.table)

    # A size without a cut lies in one shard; among groups of a size with cuts, the place counts.
    ends = spark.createDataFrame(cuts or [(0, 0, 0)], "weight long, before long, shard int").filter("weight > 0")
    whole = F.lit(0)
    for size in sorted({c[0] for c in cuts}, reverse=True):
        last = max(c[2] for c in cuts if c[0] == size)
        whole = F.when(F.col("weight") < size, F.lit(last + 1)).otherwise(whole)
    cut_sizes = [c for c in {c[0] for c in cuts}]
    ranked = groups.withColumn("part", F.pmod("hash", F.lit(PARTS)))
    contested = ranked.filter(F.col("weight").isin(cut_sizes)) if cut_sizes else ranked.limit(0)
    sums = contested.groupBy("weight", "part").agg(F.count("*").alias("n"))
    sums = sums.select("weight", "part", (F.sum("n").over(Window.partitionBy("weight").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("ahead"))
    place = contested.join(sums, ["weight", "part"]).withColumn("place", F.coalesce("ahead", F.lit(0)) + F.row_number().over(Window.partitionBy("weight", "part").orderBy("hash", "text_crc32", "size")) - 1)
    first = {size: min(c[2] for c in cuts if c[0] == size) for size in cut_sizes}
    passed = F.broadcast(ends.select(F.col("weight").alias("w"), "before"))
    placed = place.join(passed, (F.col("weight") == F.col("w")) & (F.col("place") >= F.col("before")), "left").groupBy(*key, "weight").agg(F.count("w").alias("n"))
    begin = F.lit(0)
    for size, shard in first.items():
        begin = F.when(F.col("weight") == size, F.lit(shard)).otherwise(begin)
    placed = placed.select(*key, (begin + F.col("n")).cast("int").alias("shard"))
    rest = ranked.filter(~F.col("weight").isin(cut_sizes)) if cut_sizes else ranked
    dealt = rest.select(*key, whole.cast("int").alias("shard")).unionByName(placed)

    out = cut(rows.join(dealt, key).withColumn("part", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(PARTS))), "dealt", rows, groups)
    counts = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    slot = F.col("ahead") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "hash")) - 1
    return out.join(counts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
