"""Windows and k-mers of sequences, and counts of k-mers across collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import reverse_complement
from ..sources.sequences import both_strands


def fa2line(sequences: DataFrame, reverse: bool = True) -> DataFrame:
    """(src_id, strand, line): each sequence, and its reverse complement, with N written as X."""
    return both_strands(sequences, True, reverse).select("src_id", F.col("strand").cast("int").alias("strand"), F.translate("seq", "N", "X").alias("line"))


def windows(sequences: DataFrame, k: int, step: int) -> DataFrame:
    """(name, st, en, seq) of positional windows; the last one is stretched to the end. st counts from 0, en is exclusive.

    Window i starts at i * step. It is the last one if another step would leave its end beyond the sequence.
    """
    if k < 1 or step < 1:
        raise ValueError("k and step must be positive")
    n = F.length("seq")
    # The last window is the first i with i * step + step + k > n.
    last = F.greatest(F.lit(0), F.ceil((n - step - k + 1) / F.lit(step))).cast("int")
    at = sequences.where(n > 0).select("name", "seq", F.col("seq").cast("binary").alias("raw"), last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    st = F.col("i") * step
    en = F.when(F.col("i") == F.col("last"), F.length("raw")).otherwise(st + k)
    return at.select("name", st.alias("st"), en.cast("int").alias("en"), F.substring(F.col("raw"), st + 1, en - st).cast("string").alias("seq"))


def full_windows(sequences: DataFrame, k: int, step: int) -> DataFrame:
    """(name, st, en, seq) of the windows of exactly k bases that begin every `step` bases."""
    if k < 1 or step < 1:
        raise ValueError("k and step must be positive")
    rows = sequences.where(F.length("seq") >= k).select("name", F.col("seq").cast("binary").alias("raw"))
    rows = rows.select("name", "raw", F.explode(F.sequence(F.lit(0), F.length("raw") - k, F.lit(step))).alias("st"))
    return rows.select("name", "st", (F.col("st") + k).alias("en"), F.substring(F.col("raw"), F.col("st") + 1, F.lit(k)).cast("string").alias("seq"))


def fa2kmer(sequences: DataFrame, k: int = 151, step: int = 50) -> DataFrame:
    """(header, seq): windows named name:start-end, counted from 1."""
    return windows(sequences, k, step).select(F.concat(F.col("name"), F.lit(":"), (F.col("st") + 1).cast("string"), F.lit("-"), F.col("en").cast("string")).alias("header"), "seq")


def positions(sequences: DataFrame, k: int, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, pos and kmer (binary) of every k-mer of sequences.seq.

    k-mers are cut from bytes: Spark cuts a string by walking from its start, which makes all k-mers of a long
    sequence cost its length squared.
    """
    rows = sequences.where(F.length("seq") >= k).select(*keep, F.col("seq").cast("binary").alias("raw"))
    rows = rows.select(*keep, "raw", F.explode(F.sequence(F.lit(0), F.length("raw") - k)).alias("pos"))
    return rows.select(*keep, "pos", F.substring(F.col("raw"), F.col("pos") + 1, F.lit(k)).alias("kmer"))


def counts(sequences: DataFrame, k: int, name: str = "cnt") -> DataFrame:
    """(kmer, cnt) of all k-mers over ACGT on both strands.

    One strand is counted; the other's counts follow by reverse complement of the distinct k-mers, which halves the
    rows before the shuffle.
    """
    plain = positions(sequences, k, ()).select(F.col("kmer").cast("string").alias("kmer")).where(~F.col("kmer").contains("N"))
    once = plain.groupBy("kmer").agg(F.count("*").alias("n"))
    both = once.select(F.explode(F.array(F.struct("kmer", "n"), F.struct(reverse_complement(F.col("kmer")).alias("kmer"), F.col("n")))).alias("s")).select("s.*")
    return both.groupBy("kmer").agg(F.sum("n").alias(name))


def kount(collections: list[DataFrame], k: int = 51, min_occ: int = 100) -> DataFrame:
    """(kmer, cnt_1 ... cnt_n): k-mers found min_occ times or more in at least one collection, counted in all of them."""
    each = [counts(c, k, "n").withColumn("src", F.lit(i)) for i, c in enumerate(collections)]
    rows = reduce(DataFrame.unionByName, each)
    cnt = [F.sum(F.when(F.col("src") == i, F.col("n")).otherwise(0)).alias(f"cnt_{i + 1}") for i in range(len(each))]
    most = F.greatest(*(F.col(f"cnt_{i + 1}") for i in range(len(each)))) if len(each) > 1 else F.col("cnt_1")
    return rows.groupBy("kmer").agg(*cnt).where(most >= min_occ)
