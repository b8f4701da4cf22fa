"""Sequence sources: FASTA/FASTQ, one sequence per line, and sequences derived from a text column."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.alphabet import derived, normalize, reverse_complement
from ..plans.lineage import fresh, materialize


#: Rows of a BWT that one window counts sentinels in.
STRETCH = 1 << 16


def from_table(df: DataFrame, id_col: str, text_col: str = "text", unknown: bool = True) -> DataFrame:
    """(src_id, name, seq) of a table with a text column. src_id is id_col, name its text; unknown: whether N is kept."""
    return df.select(F.col(id_col).cast("long").alias("src_id"), F.col(id_col).cast("string").alias("name"), derived(F.col(text_col), unknown).alias("seq"))


def read_fastx(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, record, name, comment, seq, qual) of FASTA or FASTQ files, plain or gzipped; record counts from 0 in each file.

    Files are split into records by Spark's text source itself, at the `>` or `@` that starts a line, so that large
    files are read by many tasks. FASTQ files that are not made of records of four lines are read line by line in
    order, one task for each such file: only there does a record's end depend on all before it. A FASTQ record whose
    quality has another length than its sequence, or is missing, is an error.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value")]
    lines = spark.read.text(paths).select(*at)
    # The first character of a file tells its kind: one row for each file.
    kinds = materialize(lines.where("trim(value) <> ''").groupBy("file").agg(F.min_by(F.substring("value", 1, 1), F.struct("block", "n")).alias("mark")))
    raw = spark.read.option("lineSep", "\n>").text(paths).select(*at)
    fasta = raw.join(kinds.where("mark = '>'"), "file", "left_semi")
    parts = F.split(F.regexp_replace("value", r"^\s*>|\r", ""), "\n")
    body = F.array_join(F.slice(parts, 2, F.size(parts)), "")
    fasta = in_order(fasta.where("trim(value) <> ''"), "record")
    records = fasta.select("file", "record", F.element_at(parts, 1).alias("head"), normalize(F.regexp_replace(body, r"\s", "")).alias("seq"), F.lit(None).cast("string").alias("qual"))
    rows = in_order(lines.join(kinds.where("mark = '@'"), "file", "left_semi").withColumn("value", F.regexp_replace("value", r"\r$", "")), "i")
    # Four lines make one record if that holds all through a file; its last lines may be blank.
    value = lambda k: F.max(F.when(F.col("i") % 4 == k, F.col("value")))
    four = rows.groupBy("file", F.expr("i div 4").alias("record")).agg(*(value(k).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))))
    four = materialize(four.where(F.concat_ws("", "head", "seq", "plus", "qual") != ""))
    fine = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    odd = materialize(four.where(~F.coalesce(fine, F.lit(False))).select("file").distinct())
    plain = four.join(odd, "file", "left_anti").select("file", "record", F.substring("head", 2, 1 << 30).alias("head"), normalize(F.col("seq")).alias("seq"), "qual")
    out = records.unionByName(plain)
    if not odd.isEmpty():
        out = out.unionByName(long_records(rows.join(odd, "file", "left_semi")))
    return out.select("file", "record", F.regexp_extract("head", r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace("head", r"^\S*", "")).alias("comment"), "seq", "qual")


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """rows (file, block, n, ...) with their number in the file: the place in the split, plus the rows of the file's splits before it."""
    count = rows.groupBy("file", "block").agg(F.count("*").alias("c"))
    base = materialize(count.withColumn("base", F.sum("c").over(Window.partitionBy("file").orderBy("block")) - F.col("c")).drop("c"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("n")) - 1
    return rows.withColumn("place", place).join(base, ["file", "block"]).withColumn(name, F.col("base") + F.col("place")).drop("place", "base", "block", "n")


def long_records(rows: DataFrame) -> DataFrame:
    """(file, record, head, seq, qual) of FASTQ lines (file, i, value) whose sequences or qualities may go over several lines.

    A quality ends when it is as long as the sequence, so that its lines may begin with any mark.
    """

    def run(batches):
        file, record, head, seq, qual, reading = None, 0, None, [], None, 0
        out: list[tuple] = []

        def close():
            nonlocal head, seq, qual, record
            if head is not None:
                whole = "".join(seq)
                if qual is not None and reading != len(whole):
                    raise ValueError(f"FASTQ record with a quality of another length: @{head}")
                out.append((file, record, head, whole, None if qual is None else "".join(qual)))
                record += 1
            head, seq, qual = None, [], None

        for batch in batches:
            for f, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f != file:
                    close()
                    file, record = f, 0
                if qual is not None:
                    qual.append(line)
                    reading += len(line)
                    if reading >= sum(map(len, seq)):
                        close()
                elif line[:1] in ("@", ">"):
                    close()
                    head = line[1:]
                elif line[:1] == "+" and head is not None:
                    qual, reading = [], 0
                elif head is not None:
                    seq.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (pa.string(), pa.int64(), *[pa.string()] * 3))], ["file", "record", "head", "seq", "qual"])
            out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (pa.string(), pa.int64(), *[pa.string()] * 3))], ["file", "record", "head", "seq", "qual"])

    parts = rows.repartition("file").sortWithinPartitions("file", "i").select("file", "value")
    found = parts.mapInArrow(run, "file string, record bigint, head string, seq string, qual string")
    return found.withColumn("seq", normalize(F.regexp_replace("seq", r"\s", "")))


def write_fastx(sequences: DataFrame, path: str, quality: str | None = None) -> None:
    """Write sequences (name, seq) as FASTA records, or as FASTQ with one quality letter all through; a missing name is written as *."""
    name = F.regexp_replace(F.coalesce(F.col("name"), F.lit("*")), r"[\r\n]", " ")
    if quality is None:
        text = F.concat(F.lit(">"), name, F.lit("\n"), "seq")
    else:
        text = F.concat(F.lit("@"), name, F.lit("\n"), "seq", F.lit("\n+\n"), F.regexp_replace("seq", ".", quality))
    sequences.select(text.alias("value")).write.text(path)


def write_bwt(bwt: DataFrame, path: str) -> None:
    """Write a BWT (rk, sym) as plain text in files that follow each other by name: stretches up to a sentinel, which is the text writer's record separator.

    What stands behind the last sentinel goes to a file of its own, its last symbol in place of the separator.
    """
    bwt = materialize(bwt.select("rk", "sym"))
    block = (F.col("rk") / STRETCH).cast("long")
    own = F.count_if(F.col("sym") == "$").over(Window.partitionBy("block").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1))
    per = bwt.where("sym = '$'").groupBy(block.alias("b")).agg(F.count("*").alias("n"))
    base = materialize(bwt.select(block.alias("block")).distinct().join(per, F.col("block") == F.col("b"), "left").select("block", F.coalesce("n", F.lit(0)).alias("n")))
    base = materialize(base.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base")))
    rows = bwt.withColumn("block", block).withColumn("own", own).join(base, "block").select("rk", "sym", (F.col("base") + F.col("own")).alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "sym"))), lambda x: x["sym"]), "")
    parts = materialize(rows.groupBy("part").agg(text.alias("text")))
    whole = parts.where(F.col("text").endswith("$"))
    whole.repartitionByRange("part").sortWithinPartitions("part").select(F.expr("substring(text, 1, length(text) - 1)").alias("value")).write.option("lineSep", "$").text(f"{path}/0-sentinels")
    rest = parts.where(~F.col("text").endswith("$")).first()  # one stretch at most
    if rest is not None:
        parts.where(F.col("part") == rest.part).select(F.expr("substring(text, 1, length(text) - 1)").alias("value")).coalesce(1).write.option("lineSep", rest.text[-1]).text(f"{path}/1-rest")


def read_bwt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(rk, sym) of BWTs in plain text, one path after the other and the files of a path by name: `$` and line ends are sentinels, other letters symbols or N.

    Spark's text source splits the files at sentinels, so that many tasks read a large one; what stands between two of
    them must fit into a task.
    """
    each = []
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        at = [F.lit(i).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value"]
        each.append(spark.read.option("lineSep", "$").option("recursiveFileLookup", "true").text(path).select(*at))
    rows = materialize(reduce(DataFrame.unionByName, each))
    # A file's last record has a sentinel behind it only if the file's bytes hold one more.
    files = rows.groupBy("path", "file", "size").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max(F.struct("block", "n")).alias("last"))
    files = materialize(files.where(F.col("bytes") > F.col("size")).select("path", "file", "last"))
    cut = rows.join(files, ["path", "file"], "left").withColumn("open", F.coalesce(F.struct("block", "n") == F.col("last"), F.lit(False)))
    symbols = F.regexp_replace(F.upper(F.translate("value", "\n", "$")), "[^ACGT$]", "N")
    cut = materialize(cut.select("path", "file", "block", "n", F.concat(symbols, F.when(F.col("open"), "").otherwise("$")).cast("binary").alias("text")))
    splits = cut.groupBy("path", "file", "block").agg(F.sum(F.length("text")).alias("c"))
    splits = materialize(splits.select("path", "file", "block", (F.sum("c").over(Window.orderBy("path", "file", "block")) - F.col("c")).alias("base")))  # a row for each split
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("path", "file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cut.withColumn("before", before).join(splits, ["path", "file", "block"]).where(F.length("text") > 0)
    rows = rows.select("text", (F.col("base") + F.col("before")).alias("at"), F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("i"))
    return rows.select((F.col("at") + F.col("i")).alias("rk"), F.substring(F.col("text"), F.col("i") + 1, F.lit(1)).cast("string").alias("sym"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, seq): one sequence per line; a blank line is an empty sequence. Names seq<n> are given where results are written."""
    return spark.read.text(paths).select(F.lit(None).cast("string").alias("name"), normalize(F.trim("value")).alias("seq"))


def read_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, len) of a list of names and lengths; rows without a positive length are left out."""
    rows = spark.read.option("sep", "\t").schema("name string, len string").csv(paths)
    return rows.select("name", F.expr("try_cast(len as int)").alias("len")).where("len > 0")


def both_strands(sequences: DataFrame, forward: bool = True, reverse: bool = True) -> DataFrame:
    """(sid, src_id, name, strand, seq, len): sid 2i is sequence i as it stands, 2i + 1 its reverse complement.

    With one strand only, sid is src_id.
    """
    if not forward and not reverse:
        raise ValueError("at least one strand is needed")
    rows = []
    if forward:
        rows.append(F.struct(F.lit(0).cast("byte").alias("strand"), F.col("seq").alias("seq")))
    if reverse:
        rows.append(F.struct(F.lit(1).cast("byte").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
    out = sequences.select("src_id", "name", F.explode(F.array(*rows)).alias("s"))
    sid = F.col("src_id") * 2 + F.col("s.strand") if len(rows) == 2 else F.col("src_id")
    return out.select(sid.alias("sid"), "src_id", "name", F.col("s.strand").alias("strand"), F.col("s.seq").alias("seq"), F.length("s.seq").alias("len"))


def numbered(df: DataFrame, bucket, order: list, name: str) -> DataFrame:
    """df with a dense number from 0 in the order given; bucket, a column that never falls along the order, splits the work. A missing bucket is one, the first."""
    b, p, n, base, of = (fresh(df.columns, c) for c in ("bucket", "place", "size", "base", "of"))
    rows = df.withColumn(b, bucket)
    sizes = rows.groupBy(F.col(b).alias(of)).agg(F.count("*").alias(n))
    # Summed in two levels, so that no task sees a row for every bucket of a large table.
    outer = sizes.groupBy(F.floor(F.col(of) / 4096).alias(p)).agg(F.sum(n).alias(base))
    outer = materialize(outer.select(F.col(p).alias(b), (F.sum(base).over(Window.orderBy(p)) - F.col(base)).alias(base)))
    inner = sizes.withColumn(p, F.floor(F.col(of) / 4096)).withColumn(n, F.sum(n).over(Window.partitionBy(p).orderBy(of)) - F.col(n))
    starts = materialize(inner.join(outer, F.col(p).eqNullSafe(F.col(b))).select(of, (F.col(n) + F.col(base)).alias(base)))
    place = F.row_number().over(Window.partitionBy(b).orderBy(*order)) - 1
    return rows.withColumn(p, place).join(starts, F.col(b).eqNullSafe(F.col(of))).withColumn(name, F.col(base) + F.col(p)).drop(b, p, base, of)


def turns(df: DataFrame) -> DataFrame:
    """(src_id, name, seq) of a conversations table, its turns numbered densely by (conv_id, turn)."""
    rows = numbered(df, F.floor(F.col("conv_id") / 256), ["conv_id", "turn"], "src_id")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("*")), F.lit("/"), F.coalesce(F.col("turn").cast("string"), F.lit("*")))
    return rows.select(F.col("src_id").cast("long").alias("src_id"), name.alias("name"), derived(F.col("text")).alias("seq"))
