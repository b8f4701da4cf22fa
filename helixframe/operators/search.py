"""Searches in a saved suffix order: intervals of the order in place of occurrences.

Beside each row of the order stands the common prefix with the row before. The strings of k symbols are then the
stretches between rows whose common prefix is under k, for any k: counts of k-mers are differences of row numbers, and
no sequence is cut up again. A query's suffix is looked up among the stretches of its first symbols; inside such a
stretch only rows that differ from their neighbour within the query's length are compared with it, each standing for
all rows up to the next. How far each of them goes along with the query, and for how many rows it stands, is all that
the longest matches, their counts and the longest suffixes need.

The tables: sequences as in the index, and sa (rk, sid, pos, sym, lcp, key) in ranges of rk, key being the first 32
symbols where lcp is under 32. `stretches` (k, kmer, lo, hi) are kept for some k. Work and rows read follow what is
asked: the order's rows are read in the ranges where stretches of the query lie, which the files' statistics prune.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.alphabet import collated, uncollated
from ..plans.common_prefix import bits_for, common_prefixes, same_letters
from ..plans.lineage import discard, materialize, shuffles_deleted
from .exact import by_sequence, reaching
from .index import BLOCK, Index, sums_before
from .kmers import positions

#: Symbols kept beside a row of the order, and lengths whose stretches are kept with an index.
KEY, KEPT = 32, (12, 19)
#: Ranges of rows that one search asks the files for; neighbouring ranges are joined up beyond that.
RANGES = 64


def following(heads: DataFrame, total: int) -> DataFrame:
    """heads (rk, ...) with hi, the rk of the next of them, or total. In windows of one block each; the blocks' own first rows are met in blocks of blocks."""
    rows = heads.withColumn("block", (F.col("rk") / BLOCK).cast("long"))
    firsts = rows.groupBy("block").agg(F.min("rk").alias("first")).withColumn("outer", (F.col("block") / BLOCK).cast("long"))
    tops = firsts.groupBy("outer").agg(F.min("first").alias("top"))
    tops = materialize(tops.select("outer", F.lead("top").over(Window.orderBy("outer")).alias("beyond")))
    after = F.lead("first").over(Window.partitionBy("outer").orderBy("block"))
    nexts = materialize(firsts.join(tops, "outer").select("block", F.coalesce(after, "beyond", F.lit(total)).alias("after")))
    own = F.lead("rk").over(Window.partitionBy("block").orderBy("rk"))
    return rows.join(nexts, "block").withColumn("hi", F.coalesce(own, "after")).drop("block", "after")


class SearchIndex:
    def __init__(self, sequences: DataFrame, sa: DataFrame, stretches: DataFrame | None = None, kept: tuple[int, ...] = ()):
        self.sequences, self.sa, self.stretches, self.kept = sequences, sa, stretches, tuple(sorted(kept))
        self._total: int | None = None

    @classmethod
    @shuffles_deleted
    def save(cls, index: Index, path: str, kept: tuple[int, ...] = KEPT) -> None:
        """Write the tables of a search in an index; the order's rows go in ranges of rk."""
        raw = index.sequences.select("sid", collated(F.col("seq")).cast("binary").alias("raw"))
        order = materialize(index.sa)
        common = sa = common_prefixes(index.sequences, order)
        discard(order)
        key = F.when(F.col("lcp") < KEY, F.substring(F.col("raw"), F.col("pos").cast("int") + 1, F.lit(KEY)).cast("string"))
        sa = sa.join(raw, "sid").select("rk", "sid", "pos", "sym", "lcp", key.alias("key"))
        index.sequences.write.parquet(f"{path}/sequences")
        cls.write_order(sa, path, kept)
        discard(common)

    @classmethod
    def load(cls, spark: SparkSession, path: str, kept: tuple[int, ...] = KEPT) -> "SearchIndex":
        """Raises ValueError where the tables do not belong together."""
        read = spark.read.parquet
        out = cls(read(f"{path}/sequences"), read(f"{path}/sa"), read(f"{path}/stretches") if kept else None, kept)
        if out.total != out.sequences.agg(F.coalesce(F.sum(F.col("len") + 1), F.lit(0))).first()[0]:
            raise ValueError("sequences and suffixes disagree")
        return out

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self.sa.count()
        return self._total

    def intervals(self, k: int) -> DataFrame:
        """(kmer, lo, hi) of every distinct string of k symbols, N included: rows lo to hi - 1 of the order begin with it. kmer is collated."""
        if k in self.kept and self.stretches is not None:
            return self.stretches.where(F.col("k") == k).select("kmer", "lo", "hi")
        if k > KEY:
            return self.heads(k).select("kmer", "lo", "hi")
        heads = following(self.sa.where(F.col("lcp") < k).select("rk", F.substring("key", 1, k).alias("kmer")), self.total)
        return heads.where(F.length("kmer") == k).select("kmer", F.col("rk").alias("lo"), "hi")

    def heads(self, k: int, at_least: int = 1) -> DataFrame:
        """intervals(k) of at_least rows or more; their strings are looked up in the sequences only once the rows are counted."""
        rows = following(self.sa.where(F.col("lcp") < k).select("rk", "sid", "pos"), self.total).where(F.col("hi") - F.col("rk") >= at_least)
        raw = self.sequences.where(F.col("len") >= k).select("sid", collated(F.col("seq")).cast("binary").alias("raw"))
        kmer = F.substring(F.col("raw"), F.col("pos").cast("int") + 1, F.lit(k)).cast("string")
        return rows.join(raw, "sid").select(kmer.alias("kmer"), F.col("rk").alias("lo"), "hi").where(F.length("kmer") == k)

    def rows_near(self, cut: DataFrame, columns: list[str]) -> DataFrame:
        """The order's rows in the blocks named by cut, and few others: at most RANGES ranges are asked for, which the files' statistics are held against."""
        coarse = max(1, -(-self.total // (1 << 12)))
        parts = sorted(r.p for r in cut.select((F.col("block") * BLOCK / coarse).cast("long").alias("p")).distinct().collect())  # 4,096 at most
        spans: list[list[int]] = []
        apart = sorted((b - a for a, b in zip(parts, parts[1:])), reverse=True)
        apart = max(1, apart[RANGES - 1]) if len(apart) >= RANGES else 1
        for p in parts:
            if spans and p - spans[-1][1] <= apart:
                spans[-1][1] = p
            else:
                spans.append([p, p])
        inside: list[Column] = [(F.col("rk") >= a * coarse) & (F.col("rk") < (z + 1) * coarse + BLOCK) for a, z in spans]
        while len(inside) > 1:
            inside = [x | y for x, y in zip(inside[::2], inside[1::2])] + inside[len(inside) & ~1 :]
        return self.sa.where(inside[0] if inside else F.lit(False)).select("rk", *columns).withColumn("block", (F.col("rk") / BLOCK).cast("long"))

    def extensions(self, seqs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(qid, x, ext, n, lo), written: for each place x of asked (qid, x, kmer), the n occurrences of its k-mer that go along with the query seqs (qid, seq) for ext symbols, and the first of their rows."""
        bits = bits_for(seqs.agg(F.max(F.length("seq"))).first()[0])
        sized = seqs.select("qid", F.length("seq").alias("qlen"))
        hit = materialize(asked.join(self.intervals(k), "kmer").join(sized, "qid").select("qid", "x", "qlen", "lo", "hi"))
        cut = hit.withColumn("block", F.explode(F.sequence((F.col("lo") / BLOCK).cast("long"), ((F.col("hi") - 1) / BLOCK).cast("long"))))
        rows = self.rows_near(cut, ["sid", "pos", "lcp"]).join(cut, "block")
        rows = rows.where("rk >= lo AND rk < hi AND (rk = lo OR lcp < qlen - x)")
        n = F.coalesce(F.lead("rk").over(Window.partitionBy("qid", "x").orderBy("rk")), "hi") - F.col("rk")
        rows = materialize(rows.select("qid", "x", "rk", "sid", F.col("pos").cast("int").alias("pos"), n.alias("n")))
        mine = seqs.select("qid", F.col("seq").cast("binary").alias("mine"))
        raw = self.sequences.select("sid", F.col("seq").cast("binary").alias("raw"))
        pairs = rows.join(mine, "qid").join(raw, "sid")
        most = F.least(F.length("mine") - F.col("x"), F.length("raw") - F.col("pos"))
        ext = same_letters(F.col("mine"), F.col("x"), F.col("raw"), F.col("pos"), most, bits)
        out = materialize(pairs.select("qid", "x", "rk", ext.alias("ext"), "n").groupBy("qid", "x", "ext").agg(F.sum("n").alias("n"), F.min("rk").alias("lo")))
        discard(hit, rows)
        return out

    def begins(self, seqs: DataFrame, k: int) -> DataFrame:
        """(qid, x, kmer) of every k-mer of seqs."""
        rows = positions(seqs, k, ("qid",))
        return rows.select("qid", F.col("pos").alias("x"), collated(F.col("kmer").cast("string")).alias("kmer"))

    def seed(self, least: int) -> int:
        """The longest kept length that strings of `least` symbols have, or that length itself."""
        return max([k for k in self.kept if k <= least], default=min(least, KEY))

    def short_counts(self, strings: DataFrame, below: int) -> DataFrame:
        """(kmer, n) for distinct collated strings (kmer) under `below` symbols: rows that begin with them, summed over the longer strings that do and the suffixes that end before."""
        long = self.intervals(below).select("kmer", (F.col("hi") - F.col("lo")).alias("n"))
        ends = self.sa.where((F.col("lcp") < below) & (F.length("key") < below) & (F.length("key") > 0)).select(F.col("key").alias("kmer"), F.lit(1).cast("long").alias("n"))
        pieces = long.unionByName(ends.groupBy("kmer").agg(F.sum("n").alias("n")))
        pieces = pieces.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("kmer"), F.lit(below - 1))), lambda i: F.substring(F.col("kmer"), F.lit(1), i))).alias("kmer"))
        return pieces.join(strings, "kmer").groupBy("kmer").agg(F.sum("n").alias("n"))

    def string_counts(self, seqs: DataFrame) -> DataFrame:
        """(qid, cnt) of the strings (qid, seq) that occur."""
        edges, out = [*self.kept, None], []
        for k, stop in zip(edges, edges[1:]):
            some = materialize(seqs.where((F.length("seq") >= k) & (F.length("seq") < stop if stop else F.lit(True))))
            at = some.select("qid", F.lit(0).alias("x"), collated(F.substring("seq", 1, k)).alias("kmer"))
            whole = self.extensions(some, at, k).join(some.select("qid", F.length("seq").alias("m")), "qid").where("ext = m")
            out.append(whole.select("qid", F.col("n").alias("cnt")))
        least = self.kept[0]
        short = materialize(seqs.where((F.length("seq") > 0) & (F.length("seq") < least)).select("qid", collated(F.col("seq")).alias("kmer")))
        out.append(short.join(self.short_counts(short.select("kmer").distinct(), least), "kmer").select("qid", F.col("n").alias("cnt")))
        return reduce(DataFrame.unionByName, out)

    def count(self, queries: DataFrame) -> DataFrame:
        """(name, cnt): occurrences of each whole query, 0 included; an empty query occurs nowhere."""
        rows, seqs = by_sequence(queries)
        return rows.join(self.string_counts(seqs), "qid", "left").select("name", F.coalesce("cnt", F.lit(0)).alias("cnt"))

    def matches(self, seqs: DataFrame, min_len: int, min_occ: int) -> DataFrame:
        """(qid, st, en, cnt, lo) of supermaximal matches: rows lo to lo + cnt - 1 of the order begin with the match."""
        if min_len < 2:
            raise ValueError("min_len must be at least 2")
        k = self.seed(min_len)
        found = self.extensions(seqs, self.begins(seqs, k), k).where(F.col("ext") >= min_len)
        return reaching(found.select(F.col("qid").alias("name"), "x", (F.col("x") + F.col("ext")).alias("en"), "n", "lo"), min_occ).withColumnRenamed("name", "qid")

    def mem(self, queries: DataFrame, min_len: int = 19, min_occ: int = 1) -> DataFrame:
        """(name, st, en, cnt): the rows of exact.mem()."""
        rows, seqs = by_sequence(queries)
        return rows.select("qid", "name").join(self.matches(seqs, min_len, min_occ), "qid").select("name", "st", "en", "cnt")

    def mem_positions(self, queries: DataFrame, min_len: int = 19, min_occ: int = 1, max_pos: int = 5) -> DataFrame:
        """mem with n_pos and up to max_pos positions (ctg, strand, pos), the first in suffix order: of a match with many places only so many rows are read."""
        rows, seqs = by_sequence(queries)
        found = materialize(self.matches(seqs, min_len, min_occ))
        spots = self.locate(found.select(F.struct("qid", "st", "en").alias("id"), "lo", (F.col("lo") + F.col("cnt")).alias("hi")), max_pos)
        ctg = self.sequences.select("sid", F.col("name").alias("ctg"), "strand", "len")
        spots = spots.select("id.*", "rk", "sid", "pos").join(ctg, "sid").withColumn("sign", F.when(F.col("strand") == 0, "+").otherwise("-"))
        pos = F.when(F.col("strand") == 0, F.col("pos")).otherwise(F.col("len") - F.col("pos") - (F.col("en") - F.col("st")))
        lists = spots.groupBy("qid", "st", "en").agg(F.array_sort(F.collect_list(F.struct("rk", F.struct("ctg", F.col("sign").alias("strand"), pos.cast("long").alias("pos")).alias("p")))).alias("l"))
        out = rows.select("qid", "name").join(found.join(lists, ["qid", "st", "en"]), "qid")
        return out.select("name", "st", "en", "cnt", F.size("l").alias("n_pos"), F.transform("l", lambda x: x["p"]).alias("pos"))

    def locate(self, intervals: DataFrame, limit: int | None = None) -> DataFrame:
        """intervals: (id, lo, hi). (id, rk, sid, pos) of the rows from lo on, `limit` of each at most if given, before hi."""
        hi = F.col("hi") if limit is None else F.least(F.col("hi"), F.col("lo") + limit)
        cut = materialize(intervals.where("hi > lo").select("id", "lo", hi.alias("hi")))
        cut = cut.withColumn("block", F.explode(F.sequence((F.col("lo") / BLOCK).cast("long"), ((F.col("hi") - 1) / BLOCK).cast("long"))))
        return self.rows_near(cut, ["sid", "pos"]).join(cut, "block").where("rk >= lo AND rk < hi").select("id", "rk", "sid", "pos")

    @shuffles_deleted
    def ranks(self, fresh: DataFrame) -> DataFrame:
        """(sid, pos, at), written: for every suffix of sequences fresh (sid, seq), none of them in this order, the rows of this order that come before it; equal ones do.

        A suffix whose first symbols occur is placed inside their stretch, by the rows that differ from their neighbour
        within its length; any other, behind the stretches and short suffixes that are smaller.
        """
        k = self.kept[0]
        bits = bits_for(fresh.agg(F.max(F.length("seq"))).first()[0])
        raw = fresh.select("sid", collated(F.col("seq")).cast("binary").alias("mine"))
        every = raw.select("sid", "mine", F.explode(F.sequence(F.lit(0), F.length("mine"))).alias("pos"))
        key = F.substring(F.col("mine"), F.col("pos") + 1, F.lit(k)).cast("string")
        every = every.select("sid", "pos", (F.length("mine") - F.col("pos")).alias("rest"), F.when(F.length("mine") - F.col("pos") < k, F.concat(key, F.lit("$"))).otherwise(key).alias("key"))
        every = materialize(every)
        stretches = self.intervals(k).select(F.col("kmer").alias("key"), "lo", "hi")
        inside = materialize(every.join(stretches, "key"))
        # Where the first symbols do not occur: behind all keys that are smaller or equal, a bucket of first symbols at a time.
        short = self.sa.where((F.col("lcp") < k) & (F.length("key") < k)).groupBy(F.concat("key", F.lit("$")).alias("key")).agg((F.max("rk") + 1).alias("hi"))
        stops = stretches.select("key", "hi").unionByName(short).withColumn("bucket", F.substring("key", 1, 4))
        ends = stops.groupBy("bucket").agg(F.max("hi").alias("hi"))
        asked = every.join(inside.select("key").distinct(), "key", "left_anti").select("key").distinct().withColumn("bucket", F.substring("key", 1, 4))
        asked = materialize(asked)
        buckets = ends.unionByName(asked.select("bucket", F.lit(0).cast("long").alias("hi"))).groupBy("bucket").agg(F.max("hi").alias("hi"))  # some hundred rows
        base = materialize(buckets.select("bucket", F.coalesce(F.max("hi").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))
        both = stops.select("bucket", "key", "hi").unionByName(asked.select("bucket", "key", F.lit(None).cast("long").alias("hi")))
        last = F.max("hi").over(Window.partitionBy("bucket").orderBy("key"))
        placed = both.withColumn("at", last).where(F.col("hi").isNull()).join(base, "bucket").select("key", F.greatest(F.coalesce("at", F.lit(0)), "base").alias("at"))
        outside = every.join(placed, "key").select("sid", "pos", "at")
        # Inside a stretch: how many rows are smaller.
        cut = inside.withColumn("block", F.explode(F.sequence((F.col("lo") / BLOCK).cast("long"), ((F.col("hi") - 1) / BLOCK).cast("long"))))
        cut = cut.select(F.col("sid").alias("own"), F.col("pos").alias("x"), "rest", "lo", "hi", "block")
        rows = self.rows_near(cut, ["sid", "pos", "lcp"]).join(cut, "block").where("rk >= lo AND rk < hi AND (rk = lo OR lcp <= rest)")
        n = F.coalesce(F.lead("rk").over(Window.partitionBy("own", "x").orderBy("rk")), "hi") - F.col("rk")
        rows = materialize(rows.select("own", "x", "rest", "lo", "sid", F.col("pos").cast("int").alias("pos"), n.alias("n")))
        theirs = self.sequences.select("sid", collated(F.col("seq")).cast("binary").alias("raw"))
        pairs = rows.join(raw.withColumnRenamed("sid", "own"), "own").join(theirs, "sid")
        pairs = pairs.withColumn("same", same_letters(F.col("mine"), F.col("x"), F.col("raw"), F.col("pos"), F.least("rest", F.length("raw") - F.col("pos")), bits))
        letter = lambda c, at: F.substring(F.col(c), at + F.col("same") + 1, F.lit(1))  # noqa: E731  # empty behind the end, which sorts first
        before = letter("raw", F.col("pos")) <= letter("mine", F.col("x"))
        placed = pairs.groupBy(F.col("own").alias("sid"), F.col("x").alias("pos"), "lo").agg(F.sum(F.when(before, F.col("n")).otherwise(0)).alias("less"))
        out = materialize(placed.select("sid", "pos", (F.col("lo") + F.col("less")).alias("at")).unionByName(outside.select("sid", "pos", "at")))
        discard(every, inside, asked, base, rows)
        return out

    @shuffles_deleted
    def append(self, sources: DataFrame, path: str) -> "SearchIndex":
        """Write this order with the sequences of sources (src_id from 0, name, seq) added, to path.

        The added suffixes are ordered among themselves and then placed among the rows that are there, which keep their
        order: a row moves by the added ones before it, counted block by block. Common prefixes and keys are found anew
        only for added rows and the rows behind them.
        """
        spark = self.sa.sparkSession
        top = self.sequences.agg(F.max("src_id")).first()[0]
        shift = 0 if top is None else top + 1
        added = Index.build(sources.withColumn("src_id", F.col("src_id") + shift))
        fresh = materialize(added.sequences)
        ranks = self.ranks(fresh.select("sid", "seq"))
        new = added.sa.join(ranks.withColumn("pos", F.col("pos").cast("long")), ["sid", "pos"])
        new = materialize(new.select((F.col("rk") + F.col("at")).alias("rk"), "sid", "pos", "sym", "at"))
        discard(added.sa, ranks)
        block = lambda c: (F.col(c) / BLOCK).cast("long")
        per = new.groupBy(block("at").alias("block")).agg(F.count("*").alias("n"))
        every = spark.range(0, self.total // BLOCK + 1).select(F.col("id").alias("block")).join(per, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"))
        base = sums_before(every, ["n"]).withColumnRenamed("n", "base").join(per, "block", "left").select("block", "base", F.col("n").isNotNull().alias("touched"))
        base = materialize(base)
        old = self.sa.withColumn("block", block("rk")).join(base, "block")
        still = old.where("not touched").withColumn("rk", F.col("rk") + F.col("base"))
        marks = new.select(block("at").alias("block"), F.col("at").alias("rk"), F.lit(0).alias("kind"))
        moved = old.where("touched").withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
        moved = moved.withColumn("more", F.count_if(F.col("kind") == 0).over(Window.partitionBy("block").orderBy("rk", "kind"))).where("kind = 1").withColumn("rk", F.col("rk") + F.col("base") + F.col("more"))
        names = ["rk", "sid", "pos", "sym", "lcp", "key"]
        sequences = self.sequences.unionByName(fresh.select(self.sequences.columns))
        moved = materialize(still.select(names).unionByName(moved.select(names)).unionByName(new.select("rk", "sid", "pos", "sym"), allowMissingColumns=True))
        discard(base)
        rows = moved
        # Only rows whose neighbour is another one than before: the added ones, and those behind them.
        changed = materialize(new.select("rk").unionByName(new.select((F.col("rk") + 1).alias("rk"))).distinct())
        here = rows.join(changed, "rk", "left_semi").select("rk", "sid", F.col("pos").cast("int").alias("pos"))
        prior = rows.withColumn("rk", F.col("rk") + 1).join(changed, "rk", "left_semi").select("rk", F.col("sid").alias("other"), F.col("pos").cast("int").alias("at"))
        bits = bits_for(sequences.agg(F.max(F.length("seq"))).first()[0])
        raw = sequences.select("sid", collated(F.col("seq")).cast("binary").alias("raw"))
        pairs = here.join(prior, "rk", "left").join(raw, "sid").join(raw.select(F.col("sid").alias("other"), F.col("raw").alias("raw2")), "other", "left")
        same = same_letters(F.col("raw"), F.col("pos"), F.col("raw2"), F.col("at"), F.least(F.length("raw") - F.col("pos"), F.length("raw2") - F.col("at")), bits)
        pairs = pairs.select("rk", F.substring(F.col("raw"), F.col("pos") + 1, F.lit(KEY)).cast("string").alias("begin"), F.when(F.col("other").isNull(), 0).otherwise(same).alias("common"))
        pairs = materialize(pairs)
        rows = rows.join(pairs, "rk", "left").select(
            "rk", "sid", "pos", "sym", F.coalesce("common", "lcp").alias("lcp"), F.when(F.col("common").isNull(), F.col("key")).when(F.col("common") < KEY, F.col("begin")).alias("key")
        )
        sequences.write.parquet(f"{path}/sequences")
        self.write_order(rows, path, self.kept)
        discard(fresh, new, moved, changed, pairs)
        return SearchIndex.load(spark, path, self.kept)

    @staticmethod
    def write_order(sa: DataFrame, path: str, kept: tuple[int, ...]) -> None:
        sa.repartitionByRange("rk").sortWithinPartitions("rk").write.option("parquet.block.size", 16 << 20).parquet(f"{path}/sa")
        out = SearchIndex(None, sa.sparkSession.read.parquet(f"{path}/sa"))
        for k in kept:
            out.intervals(k).repartitionByRange("kmer").sortWithinPartitions("kmer").write.parquet(f"{path}/stretches/k={k}")

    def present(self, queries: DataFrame, min_len: int) -> DataFrame:
        """The rows of queries that share min_len symbols with the reference."""
        rows, seqs = by_sequence(queries, tuple(c for c in queries.columns if c not in ("name", "seq")))
        k = self.seed(min_len)
        found = self.extensions(seqs, self.begins(seqs, k), k).where(F.col("ext") >= min_len)
        return rows.join(found.select("qid").distinct(), "qid", "left_semi").select(*queries.columns)

    def suffix(self, queries: DataFrame) -> DataFrame:
        """(name, st, qlen, cnt): the longest suffix of each query that occurs, and its occurrences; st = qlen and cnt = 0 if none does."""
        rows, seqs = by_sequence(queries)
        sized = seqs.select("qid", F.length("seq").alias("qlen"))
        k = self.kept[0]
        long = self.extensions(seqs, self.begins(seqs, k), k).join(sized, "qid").where("x + ext = qlen")
        best = materialize(long.groupBy("qid").agg(F.min(F.struct("x", "n")).alias("s")).select("qid", F.col("s.x").alias("st"), F.col("s.n").alias("cnt")))
        tails = seqs.join(best, "qid", "left_anti").where(F.length("seq") > 0)
        tails = tails.select("qid", "seq", F.explode(F.sequence(F.lit(1), F.least(F.lit(k - 1), F.length("seq")))).alias("l"))
        tails = materialize(tails.select("qid", "l", collated(F.expr("substring(seq, length(seq) - l + 1, l)")).alias("kmer")))
        short = tails.join(self.short_counts(tails.select("kmer").distinct(), k), "kmer").groupBy("qid").agg(F.max(F.struct("l", "n")).alias("s"))
        short = short.join(sized, "qid").select("qid", (F.col("qlen") - F.col("s.l")).alias("st"), F.col("s.n").alias("cnt"))
        found = best.unionByName(short)
        out = rows.withColumn("qlen", F.length("seq")).join(found, "qid", "left")
        return out.select("name", F.coalesce("st", "qlen").cast("long").alias("st"), F.col("qlen").cast("long").alias("qlen"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def kount(indexes: list[SearchIndex], k: int = 51, min_occ: int = 100) -> DataFrame:
    """(kmer, cnt_1 ... cnt_n): k-mers over ACGT found min_occ times or more in at least one index, counted in all of them, for any k."""
    passing = []
    for x in indexes:
        rows = x.heads(k, min_occ) if k > KEY else x.intervals(k).where(F.col("hi") - F.col("lo") >= min_occ)
        passing.append(materialize(rows.where(~F.col("kmer").contains("Z")).select("kmer", (F.col("hi") - F.col("lo")).alias("n"))))
    if len(indexes) == 1:
        return passing[0].select("kmer", F.col("n").alias("cnt_1"))
    every = materialize(reduce(DataFrame.unionByName, passing).select("kmer").distinct().select(F.xxhash64("kmer").alias("qid"), uncollated(F.col("kmer")).alias("seq")))
    out = every
    for i, x in enumerate(indexes):
        out = out.join(x.string_counts(every).withColumnRenamed("cnt", f"cnt_{i + 1}"), "qid", "left")
    return out.select(F.col("seq").alias("kmer"), *(F.coalesce(f"cnt_{i + 1}", F.lit(0)).alias(f"cnt_{i + 1}") for i in range(len(indexes))))
