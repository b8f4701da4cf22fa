"""Text formats of results: BED, PAF, end-to-end records and VCF, written as lines by Spark and read back as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.posthoc import FILTERS, INFO

VCF_COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")
#: Heads of the two kinds of lines of end-to-end records.
E2E_HEADER = ("CC", "CC\tQS\tname\tlength\talleles\tstrand\tlisted\ttotal", "CC\tQH\tcount\tscore\tedits\tcs")


def vcf_header(info: dict, filters: dict) -> list[str]:
    """info: name -> (column, one value for each allele, what it says); filters: name -> what it says."""
    lines = ["##fileformat=VCFv4.2"]
    lines += [f'##INFO=<ID={name},Number={"A" if each else 1},Type=Integer,Description="{says}">' for name, (_, each, says) in info.items()]
    lines += [f'##FILTER=<ID={name},Description="{says}">' for name, says in filters.items()]
    return [*lines, "#" + "\t".join(c.upper() for c in VCF_COLUMNS)]


def write_with_header(rows: DataFrame, header: list[str], path: str) -> None:
    """Write column value as text; the header stands in every part file, so that each is a file of its own."""
    head = "\n".join(header)

    def with_header(batches):
        import pyarrow as pa

        started = False
        for b in batches:
            if not started:
                yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
                started = True
            yield pa.RecordBatch.from_arrays([b.column(b.num_columns - 1)], ["value"])

    rows.mapInArrow(with_header, "value string").write.text(path)


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("*")) for c in columns))


def bed_lines(df: DataFrame) -> DataFrame:
    """(value): name, st, en and the other columns in their order; positions as ctg:strand:pos."""
    columns = [F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["ctg"], p["strand"], p["pos"].cast("string"))), "\t") if c == "pos" else F.col(c) for c in df.columns]
    return df.select(tabbed(*columns).alias("value"))


def paf_lines(df: DataFrame) -> DataFrame:
    """(value): the twelve columns of PAF and the tags AS, qh, rh, cg, cs, rs and ap; unmapped queries have stars."""
    first = ("qname", "qlen", "qst", "qen", "strand", "tname", "tlen", "tst", "ten", "mlen", "blen", "mapq")
    tag = lambda name, kind: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}:{kind}:"), F.col(name).cast("string")))
    places = F.when(F.size("ap") > 0, F.concat(F.lit("ap:Z:"), F.array_join("ap", ";"), F.lit(";")))
    return df.select(F.concat_ws("\t", tabbed(*first), tag("AS", "i"), tag("qh", "i"), tag("rh", "i"), tag("cg", "Z"), tag("cs", "Z"), tag("rs", "Z"), places).alias("value"))


def write_e2e(heads: DataFrame, hits: DataFrame, path: str) -> None:
    """One record of lines per query and strand: QS, a QH per allele, and the terminator."""
    per = hits.groupBy("qname", "strand").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "cs", "cnt", "score", "ed"))).alias("hits"))
    lines = F.transform(F.coalesce("hits", F.array().cast("array<struct<neg:bigint,cs:string,cnt:bigint,score:bigint,ed:bigint>>")), lambda h: F.concat_ws("\t", F.lit("QH"), h["cnt"].cast("string"), h["score"].cast("string"), h["ed"].cast("string"), h["cs"]))
    head = F.concat_ws("\t", F.lit("QS"), *(F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in ("qname", "qlen", "n_allele", "strand", "n_out", "total")))
    text = F.array_join(F.concat(F.array(head), lines, F.array(F.lit("//"))), "\n")
    per = per.select(F.col("qname").alias("of"), F.col("strand").alias("s"), "hits")
    rows = heads.join(per, F.col("qname").eqNullSafe(F.col("of")) & (F.col("strand") == F.col("s")), "left").select(text.alias("value"))
    write_with_header(rows, list(E2E_HEADER), path)


def read_e2e(spark: SparkSession, path: str) -> DataFrame:
    """(qname, strand, cnt, score, ed, cs) of the alleles of records as write_e2e writes them; a record is one row of the source."""
    rows = spark.read.option("lineSep", "\n//\n").text(path).where(F.col("value").contains("QS\t"))
    # The first record of a file stands under the file's head.
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.startswith("CC"))
    rows = rows.select(F.split(lines[0], "\t").alias("q"), F.explode(F.filter(lines, lambda x: x.startswith("QH"))).alias("h"))
    h = F.split("h", "\t")
    return rows.select(F.col("q")[1].alias("qname"), F.col("q")[4].alias("strand"), h[1].cast("long").alias("cnt"), h[2].cast("long").alias("score"), h[3].cast("long").alias("ed"), h[4].alias("cs"))


def write_vcf(df: DataFrame, path: str) -> None:
    """Lines in ranges of (chrom, pos), under the header of calls."""
    rows = df.select("chrom", "pos", tabbed(*VCF_COLUMNS).alias("value")).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    write_with_header(rows, vcf_header(INFO, FILTERS), path)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The first eight columns of VCF lines; lines that start with # are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    return rows.select(*(parts[i].alias(c) for i, c in enumerate(VCF_COLUMNS))).withColumn("pos", F.col("pos").cast("long")).withColumn("qual", F.col("qual").cast("int"))
