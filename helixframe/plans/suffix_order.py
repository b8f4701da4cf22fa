"""Order of all suffixes of a collection of sequences, by prefix doubling over DataFrames.

A suffix (sid, pos) ends with its sequence's own sentinel; sentinels sort before all letters and among each other by
sid. Suffixes are first ranked by their first K symbols. Those that end within K symbols are unique by their sid; the
rest of each tied group is ordered by the ranks of the suffixes K, 2K, 4K ... symbols further on. Only tied suffixes
are read and ranked again, and each round is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.alphabet import collated
from .lineage import discard, materialize, shuffles_deleted

FIRST, BUCKET = 32, 8
#: Rows that one window may hold: where a bucket or a tied group has more, ranks come from running sums over ranges of distinct keys.
MOST = 1 << 22


def running(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, n, ...), their keys distinct, with `before`: the sum of n over all rows whose keys are smaller.

    Tasks get ranges of keys, cut by a sample, so that no bucket or group of keys falls to one of them.
    """
    cut = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id()))
    cut = cut.withColumn("part", F.shiftright("mid", 33))
    totals = cut.groupBy("part").agg(F.sum("n").alias("size"))  # a row for each range
    base = materialize(totals.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base")))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("mid")) - F.col("n")
    return cut.withColumn("own", own).join(base, "part").withColumn("before", F.col("base") + F.col("own")).drop("part", "mid", "own", "base")


def regrouped(rows: DataFrame, most: int) -> DataFrame:
    """rows (rk, next, ...) with rk moved up by the rows of its group whose next is smaller, and n, the rows that still tie. most: rows of the largest group."""
    if most <= MOST:
        ranked = rows.withColumn("place", F.rank().over(Window.partitionBy("rk").orderBy("next")) - 1)
        ranked = ranked.withColumn("rk", (F.col("rk") + F.col("place")).cast("long")).drop("place", "next")
        return ranked.withColumn("n", F.count("*").over(Window.partitionBy("rk")))
    rows = materialize(rows)
    places = running(rows.groupBy("rk", "next").agg(F.count("*").alias("n")), ["rk", "next"])
    first = places.groupBy("rk").agg(F.min("before").alias("first"))
    places = materialize(places.join(first, "rk").select("rk", "next", "n", (F.col("rk") + F.col("before") - F.col("first")).alias("to")))
    return rows.join(places, ["rk", "next"]).withColumn("rk", F.col("to")).drop("next", "to")


@shuffles_deleted
def suffix_array(sequences: DataFrame, known: DataFrame | None = None, first: int = FIRST, bucket: int = BUCKET) -> DataFrame:
    """(rk, sid, pos, sym) for sequences (sid, seq): rk counts from 0, sym is the symbol before the suffix ($ at its start).

    known: (sid, pos, part, known_rk), the orders of parts of the sequences, every suffix in one of them. Suffixes that
    tie are then ordered by the rank they have already, unless they come from different parts.
    """
    rows = sequences.select("sid", collated(F.col("seq")).cast("binary").alias("raw"))
    rows = rows.select("sid", "raw", F.explode(F.sequence(F.lit(0), F.length("raw"))).alias("pos"))
    key = F.substring(F.col("raw"), F.col("pos") + 1, F.lit(first)).cast("string")
    ends = F.length("raw") - F.col("pos") < first
    before = F.when(F.col("pos") == 0, "$").otherwise(F.translate(F.substring(F.col("raw"), F.col("pos"), F.lit(1)).cast("string"), "Z", "N"))
    rows = rows.select(
        "sid", "pos", F.when(ends, F.concat(key, F.lit("$"))).otherwise(key).alias("key"), F.when(ends, F.col("sid")).otherwise(F.lit(-1)).cast("long").alias("tie"), before.alias("sym")
    )
    if known is not None:
        rows = rows.join(known, ["sid", "pos"])
    also = [] if known is None else ["part", "known_rk"]
    rows = materialize(rows)
    # Distinct keys only are ranked, so that copies cost one row; a bucket is a short prefix, offset by the rows of the buckets before it.
    parts = F.lit(True) if known is None else F.min("part") != F.max("part")
    distinct = rows.groupBy("key", "tie").agg(F.count("*").alias("n"), ((F.count("*") > 1) & parts).alias("tied")).withColumn("bucket", F.substring("key", 1, bucket))
    sizes = distinct.groupBy("bucket").agg(F.sum("n").alias("size"), F.count("*").alias("keys"))
    offsets = materialize(sizes.withColumn("offset", F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).drop("size"))
    if (offsets.agg(F.max("keys")).first()[0] or 0) <= MOST:
        inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("key", "tie")) - F.col("n")
        ranked = distinct.withColumn("inside", inside).join(offsets, "bucket").select("key", "tie", (F.col("offset") + F.col("inside")).alias("rk"), "n", "tied")
    else:
        ranked = running(distinct.drop("bucket"), ["key", "tie"]).withColumnRenamed("before", "rk")
    state = rows.join(ranked, ["key", "tie"]).select("rk", "sid", "pos", "sym", "n", "tied", *also)
    settled = lambda df: df
    if known is not None:  # groups of one part are in that part's order already
        place = F.row_number().over(Window.partitionBy("rk").orderBy("known_rk")) - 1
        settled = lambda df: df.where("tied or n = 1").unionByName(df.where("not tied and n > 1").withColumn("rk", (F.col("rk") + place).cast("long")))
    # Rows that are settled stay where they were written; each round reads and writes those that still tie.
    done = [materialize(settled(state))]
    discard(rows, offsets)
    step, open_ = first, done[0].where("tied")
    while (most := open_.agg(F.max("n")).first()[0]) is not None:
        ranks = reduce(DataFrame.unionByName, [x.where("not tied").select("sid", "pos", "rk") for x in done]).unionByName(open_.select("sid", "pos", "rk"))
        later = ranks.select("sid", (F.col("pos") - step).alias("pos"), F.col("rk").alias("next"))
        again = regrouped(open_.drop("n", "tied").join(later, ["sid", "pos"]), most)
        mixed = F.lit(True) if known is None else F.min("part").over(Window.partitionBy("rk")) != F.max("part").over(Window.partitionBy("rk"))
        done.append(materialize(settled(again.withColumn("tied", (F.col("n") > 1) & mixed))))
        step, open_ = step * 2, done[-1].where("tied")
    out = reduce(DataFrame.unionByName, [x.where("not tied").select("rk", "sid", F.col("pos").cast("long").alias("pos"), "sym") for x in done])
    if len(done) < 3:
        out.scratch_tables = done
        return out
    out = materialize(out)
    discard(*done)
    return out


@shuffles_deleted
def from_symbols(bwt: DataFrame, lf: DataFrame) -> DataFrame:
    """(rk, sid, pos, sym) of a BWT (rk, sym) and its steps lf (rk, sym, to), by pointer jumping.

    The row that a step leads to knows the row before it; the rows of the sentinels are the first. In each round every
    row doubles how far it looks back, so that a sequence of n symbols takes log n joins.
    """
    back = lf.where("sym <> '$'").select(F.col("to").alias("rk"), F.col("rk").alias("head"), F.lit(1).cast("long").alias("away"))
    heads = bwt.join(back.select("rk"), "rk", "left_anti").select("rk", F.col("rk").alias("head"), F.lit(0).cast("long").alias("away"))
    state = materialize(back.unionByName(heads))
    while True:
        ahead = state.select(F.col("rk").alias("head"), F.col("head").alias("far"), F.col("away").alias("more"))
        after = materialize(state.join(ahead, "head").select("rk", F.col("far").alias("head"), (F.col("away") + F.col("more")).alias("away"), (F.col("more") > 0).alias("moved")))
        done = after.where("moved").isEmpty()
        discard(state)
        state = after
        if done:
            break
        state = state.drop("moved")
        state.scratch_folder = after.scratch_folder
    size = state.groupBy("head").agg(F.max("away").alias("size"))
    out = state.join(size, "head").join(bwt, "rk").select("rk", F.col("head").alias("sid"), (F.col("size") - F.col("away")).alias("pos"), "sym")
    out.scratch_tables = [state]
    return out
