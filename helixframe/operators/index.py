"""The index of a collection: sequences, suffix order, BWT and its runs, as tables that are written and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.alphabet import SYMBOLS
from ..plans.lineage import discard, materialize, shuffles_deleted
from ..plans.suffix_order import from_symbols, suffix_array
from ..sources.sequences import both_strands
from .kmers import positions

#: Rows of the BWT whose symbol counts are summed up in one block row; a rank is a block's sum plus a scan of one block.
BLOCK = 4096


def ordered(sequences: DataFrame, order: str) -> DataFrame:
    """Sequences with sid numbered anew: `io` keeps it, `rlo` orders by the reversed sequence, `rclo` by its reverse complement."""
    if order == "io":
        return sequences
    if order == "rlo":
        key = F.translate(F.reverse("seq"), "N", "Z")
    elif order == "rclo":
        key = F.reverse(F.translate("seq", "ACGTN", "43215"))
    else:
        raise ValueError(f"unknown order {order}")
    # Numbered per range of keys, so that no task sorts everything: rows before a range, plus the place in it.
    rows = sequences.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 8))
    before = rows.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("__base", F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).drop("n")
    rows = rows.join(materialize(before), "__bucket")
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", "sid")) - 1
    return rows.withColumn("sid", F.col("__base") + place).drop("__key", "__bucket", "__base")


def sums_before(blocks: DataFrame, names: list[str]) -> DataFrame:
    """blocks (block, names) with each name's sum over the blocks before. Summed in blocks of blocks, so that no task orders them all."""
    rows = blocks.withColumn("outer", (F.col("block") / BLOCK).cast("long"))
    outer = rows.groupBy("outer").agg(*(F.sum(c).alias(c) for c in names))
    top = Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.select("outer", *(F.coalesce(F.sum(c).over(top), F.lit(0)).alias(f"o{c}") for c in names))
    own = Window.partitionBy("outer").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(materialize(outer), "outer").select("block", *((F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"o{c}")).alias(c) for c in names))


class Index:
    """Tables sequences (sid, src_id, name, strand, seq, len) and sa (rk, sid, pos, sym)."""

    def __init__(self, sequences: DataFrame, sa: DataFrame):
        self.sequences, self.sa = sequences, sa

    @classmethod
    def build(cls, sources: DataFrame, order: str = "io", forward: bool = True, reverse: bool = True) -> "Index":
        """sources: (src_id, name, seq)."""
        sequences = ordered(both_strands(sources, forward, reverse), order)
        return cls(sequences, suffix_array(sequences))

    @classmethod
    def merge(cls, *indexes: "Index") -> "Index":
        """The index of all sequences, those of later indexes numbered after those of earlier ones.

        Every index's own order is used: only suffixes of different indexes that begin alike are compared anew.
        """
        if not indexes:
            raise ValueError("nothing to merge")
        base, parts, orders = 0, [], []
        for n, x in enumerate(indexes):
            parts.append(x.sequences.withColumn("sid", F.col("sid") + base).withColumn("src_id", F.col("src_id") + base // 2))
            orders.append(x.sa.select((F.col("sid") + base).alias("sid"), F.col("pos").cast("int").alias("pos"), F.lit(n).alias("part"), F.col("rk").alias("known_rk")))
            top = x.sequences.agg(F.max("sid")).first()[0]
            base += 0 if top is None else (top // 2 + 1) * 2
        sequences = reduce(DataFrame.unionByName, parts)
        return cls(sequences, suffix_array(sequences, reduce(DataFrame.unionByName, orders)))

    def append(self, sources: DataFrame) -> "Index":
        """This index with more sequences; src_id of the new ones counts from 0."""
        return Index.merge(self, Index.build(sources))

    @classmethod
    @shuffles_deleted
    def from_bwt(cls, bwt: DataFrame) -> "Index":
        """The index that a BWT (rk, sym) stands for; sequences come without names, and their strand is that of an index of both strands."""
        bwt = materialize(bwt.select("rk", "sym"))
        steps = from_symbols(bwt, cls(None, bwt).lf())
        sa = materialize(steps)
        discard(steps, bwt)
        # A sequence's symbols stand before its suffixes but the first.
        letters = F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "sym"))))
        rows = sa.groupBy("sid").agg(F.array_join(F.transform(letters, lambda x: x["sym"]), "").alias("seq"))
        src = F.floor(F.col("sid") / 2).cast("long")
        sequences = rows.select("sid", src.alias("src_id"), F.lit(None).cast("string").alias("name"), (F.col("sid") % 2).cast("byte").alias("strand"), "seq", F.length("seq").alias("len"))
        return cls(sequences, sa)

    def kmers(self, k: int) -> DataFrame:
        """(kmer, sid, pos) of every k-mer of the sequences: the seeds that the searches of exact.py can be given."""
        return positions(self.sequences, k, ("sid",)).select("kmer", "sid", "pos")

    def save(self, path: str, k: int | None = None) -> None:
        """Parquet tables; sa is written in ranges of rk, so that a read by rk touches few row groups, and k-mers, if k is given, in ranges of k-mers."""
        if k:
            self.kmers(k).repartitionByRange("kmer", "sid").sortWithinPartitions("kmer").write.parquet(f"{path}/kmers")
        self.sequences.write.parquet(f"{path}/sequences")
        self.sa.repartitionByRange("rk").sortWithinPartitions("rk").write.parquet(f"{path}/sa")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Index":
        """Raises ValueError where the tables do not belong together."""
        out = cls(spark.read.parquet(f"{path}/sequences"), spark.read.parquet(f"{path}/sa"))
        if out.sequences.count() != out.sa.where("pos = 0").count():
            raise ValueError("sequences and suffixes disagree")
        return out

    def require_both_strands(self) -> None:
        bad = self.sequences.where(F.col("strand") != F.pmod("sid", F.lit(2))).limit(1)
        one = self.sequences.agg((F.count("*") % 2 == 0) & (F.sum("strand") * 2 == F.count("*"))).first()[0]
        if not bad.isEmpty() or one is False:
            raise ValueError("the index holds one strand only")

    def bwt(self) -> DataFrame:
        return self.sa.select("rk", "sym")

    def blocks(self) -> DataFrame:
        """(block, c_0 ... c_5): symbols of each kind before row block * BLOCK. One row per BLOCK rows of the BWT."""
        names = [f"c_{i}" for i in range(len(SYMBOLS))]
        per = self.sa.groupBy((F.col("rk") / BLOCK).cast("long").alias("block")).agg(*(F.count_if(F.col("sym") == s).alias(c) for c, s in zip(names, SYMBOLS)))
        return sums_before(per, names)

    def acc(self) -> DataFrame:
        """(sym, acc): symbols smaller than sym."""
        n = self.sa.groupBy("sym").agg(F.count("*").alias("n"))
        every = self.sa.sparkSession.createDataFrame([(i, s) for i, s in enumerate(SYMBOLS)], "code int, sym string").join(F.broadcast(n), "sym", "left")
        return every.select("code", "sym", F.coalesce("n", F.lit(0)).alias("n")).withColumn("acc", F.sum("n").over(Window.orderBy("code")) - F.col("n")).select("sym", "acc")

    def lf(self) -> DataFrame:
        """(rk, sym, to): the row of the suffix one symbol longer; rows of $ lead to the sentinels' rows in their own order."""
        rows = self.sa.withColumn("block", (F.col("rk") / BLOCK).cast("long"))
        own = F.row_number().over(Window.partitionBy("block", "sym").orderBy("rk")) - 1
        rows = rows.withColumn("own", own).join(materialize(self.blocks()), "block").join(F.broadcast(self.acc()), "sym")
        before = F.element_at(F.array(*(F.col(f"c_{i}") for i in range(len(SYMBOLS)))), F.position(F.col("sym"), F.lit(SYMBOLS)).cast("int"))
        return rows.select("rk", "sym", (F.col("acc") + before + F.col("own")).alias("to"))

    def rank(self, at: DataFrame) -> DataFrame:
        """at: column k. (k, sym, c_0 ... c_5): the symbol of row k, and the symbols of each kind in the rows before it.

        Running counts inside each block that is asked for, so that many questions cost no more than one.
        """
        names = [f"c_{i}" for i in range(len(SYMBOLS))]
        asked = materialize(at.select("k", (F.col("k") / BLOCK).cast("long").alias("block")).distinct())
        rows = self.sa.select("rk", "sym", (F.col("rk") / BLOCK).cast("long").alias("block")).join(asked.select("block").distinct(), "block", "left_semi")
        so_far = Window.partitionBy("block").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select("block", F.col("rk").alias("k"), "sym", *(F.count_if(F.col("sym") == s).over(so_far).alias(f"s_{i}") for i, s in enumerate(SYMBOLS)))
        return rows.join(asked, ["block", "k"]).join(materialize(self.blocks()), "block").select("k", "sym", *((F.col(c) + F.col(f"s_{i}")).alias(c) for i, c in enumerate(names)))

    def runs(self) -> DataFrame:
        """(run_id, start, sym, len): maximal runs of equal symbols, by islands within blocks that are then joined up."""
        rows = self.bwt().withColumn("block", (F.col("rk") / BLOCK).cast("long"))
        w = Window.partitionBy("block").orderBy("rk")
        heads = rows.withColumn("new", F.coalesce(F.col("sym") != F.lag("sym").over(w), F.lit(True))).where("new")
        # A block's first row may go on from the block before; what is left has one row per run and block.
        edge = rows.groupBy((F.col("block") + 1).alias("block")).agg(F.max_by("sym", "rk").alias("prior"))
        goes_on = (F.col("rk") % BLOCK == 0) & F.coalesce(F.col("prior") == F.col("sym"), F.lit(False))
        heads = heads.join(edge, "block", "left").where(~goes_on).select("rk", "sym", "block")
        base = sums_before(heads.groupBy("block").agg(F.count("*").alias("base")), ["base"])
        place = F.row_number().over(Window.partitionBy("block").orderBy("rk")) - 1
        runs = heads.join(materialize(base), "block").select((F.col("base") + place).alias("run_id"), F.col("rk").alias("start"), "sym")
        following = runs.select((F.col("run_id") - 1).alias("run_id"), F.col("start").alias("stop"))
        total = self.sa.agg(F.count("*").alias("total"))
        out = runs.join(following, "run_id", "left").crossJoin(F.broadcast(total))
        return out.select("run_id", "start", "sym", (F.coalesce("stop", "total") - F.col("start")).alias("len"))

    def stat(self) -> DataFrame:
        """One row: sequences, symbols, runs and the symbols of each kind."""
        counts = self.sa.agg(F.count_if(F.col("sym") == "$").alias("sequences"), F.count("*").alias("symbols"), *(F.count_if(F.col("sym") == s).alias(f"n_{s.lower()}") for s in "ACGTN"))
        runs = self.runs().agg(F.count("*").alias("runs"))
        return counts.crossJoin(runs).select("sequences", "symbols", "runs", *(f"n_{s}" for s in "acgtn"))

    def get(self, rows: DataFrame) -> DataFrame:
        """rows: column k. (k, row, seq): sequence k and the row of its whole suffix, or the prefix before the suffix of row k >= sequences."""
        n = self.sequences.agg(F.count("*").alias("m"))
        asked = rows.select("k").distinct().crossJoin(F.broadcast(n))
        whole = asked.where("k < m").join(self.sequences.select(F.col("sid").alias("k"), "seq"), "k").join(self.sa.where("pos = 0").select(F.col("sid").alias("k"), F.col("rk").alias("row")), "k")
        part = asked.where("k >= m").join(self.sa.select(F.col("rk").alias("k"), "sid", "pos"), "k").join(self.sequences.select("sid", "seq"), "sid")
        first = self.sa.where("pos = 0").select("sid", F.col("rk").alias("row"))
        part = part.join(first, "sid").select("k", "row", F.col("seq").substr(F.lit(1), F.col("pos").cast("int")).alias("seq"))
        return whole.select("k", "row", "seq").unionByName(part)

    def sample(self, log2: int = 8) -> DataFrame:
        """(rk, sid, pos) of every 2^log2-th row after the sentinels."""
        m = self.sequences.agg(F.count("*").alias("m"))
        return self.sa.crossJoin(F.broadcast(m)).where((F.col("rk") >= F.col("m")) & ((F.col("rk") - F.col("m")) % (1 << log2) == 0)).select("rk", "sid", "pos")

    def locate(self, intervals: DataFrame, limit: int | None = None) -> DataFrame:
        """intervals: (id, lo, hi). (id, sid, pos) of the rows in [lo, hi), the first `limit` of each by (sid, pos) if given.

        Rows are met through blocks: an interval is cut at block ends, which turns the range join into an equi-join.
        """
        last = ((F.col("hi") - 1) / BLOCK).cast("long")
        cut = intervals.where("hi > lo").select("id", "lo", "hi", F.explode(F.sequence((F.col("lo") / BLOCK).cast("long"), last)).alias("block"))
        rows = self.sa.withColumn("block", (F.col("rk") / BLOCK).cast("long")).join(cut, "block").where("rk >= lo AND rk < hi").select("id", "sid", "pos")
        if limit is None:
            return rows
        place = F.row_number().over(Window.partitionBy("id").orderBy("sid", "pos"))
        return rows.withColumn("place", place).where(F.col("place") <= limit).drop("place")

