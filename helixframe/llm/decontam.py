"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of 10 consecutive words (an item of fewer words is one window). A window occurs in a
document only if all its words do, so under a fixed order of words by rarity the prefix that must be joined is its
single rarest word. Rarity is counted over all words of all documents. Each occurrence of that word in a document
fixes where the window would lie; it must lie inside the document (length and position bounds), and is then verified
word by word against the document's words at that place.

Texts are split into words once; the words are written and read for the counts, the search and the verification. When
the windows are few enough to be broadcast (`MAX_BROADCAST` of them, counted first), words are joined and verified in one
generated stage. Beyond that, words are counted before they are joined, the rarest words are joined by a shuffle, and
only the candidates are joined back to their documents for verification.

Defined results: null texts have no words. Items without words give no window. Items with a null id mark words as hit
but are not listed. Repeated rows are each returned; rows of equal id and different text are told apart by a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, fresh, materialize, table

WINDOW = 10
MAX_BROADCAST = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, letters and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text) -> F.Column:
    """The words of a text as they stand; ASCII letters are lower-cased where words are compared."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int, text_col: str, id_col: str) -> DataFrame:
    """(item_id, text, w, len): the windows of every item, as text and as words in lower case."""
    w = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    cut = items.select(F.col(id_col).alias("item_id"), w.alias("all")).where(F.size("all") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1))))
    cut = cut.select("item_id", "all", at.alias("at")).select("item_id", F.slice("all", F.col("at"), size).alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("text"), "w", F.size("w").alias("len"))


def split_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, h, w) of every row, written: h is a hash of the text, w its words as they stand."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), words(F.col(text_col)).alias("w")))


def hits(split: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, h, start, stop, text) of every occurrence of a window; split: split_words(), wins: windows(), written."""
    distinct = wins.groupBy("text").agg(F.first("w").alias("w"), F.first("len").alias("len"))
    few = distinct.count() <= MAX_BROADCAST
    # lower() may fold more than A-Z, so it can only let more candidates through; the verification is exact.
    vocabulary = distinct.select(F.explode("w").alias("word")).select(F.lower("word").alias("word")).distinct()
    seen = split.select(F.explode("w").alias("x")).select(F.lower("x").alias("word"))
    if few:
        rarity = seen.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:  # counted first: a frequent word travels as one row of each task
        rarity = seen.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")
    # Written: with its size known, Spark broadcasts it or splits words that are frequent among the windows.
    rarity = materialize(rarity)

    spread = distinct.select("text", "len", F.posexplode("w").alias("offset", "x")).withColumn("word", F.lower("x"))
    ranked = spread.join(rarity, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = ranked.groupBy("text").agg(F.min(F.struct("n", "word", "offset")).alias("a"), F.first("len").alias("len"))
    anchors = materialize(anchors.where("a.n > 0").select("text", "len", F.col("a.word").alias("word"), F.col("a.offset").alias("offset")))

    start = F.col("p") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.size("w"))
    same = F.translate(F.array_join(F.slice("w", start + 1, F.col("len")), " "), UPPER, LOWER) == F.col("text")
    if few:
        at = split.select("doc_id", "h", "w", F.posexplode("w").alias("p", "x"))
        found = at.join(F.broadcast(anchors), (F.lower("x") == F.col("word")) & inside & same)
    else:
        at = split.select("doc_id", "h", F.size("w").alias("n_words"), F.posexplode("w").alias("p", "x"))
        bounds = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
        candidates = at.join(anchors, (F.lower("x") == F.col("word")) & bounds).select(F.col("doc_id").alias("i"), F.col("h").alias("k"), "p", "offset", "len", "text").distinct()
        found = candidates.join(split, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")) & same)
    out = materialize(found.select("doc_id", "h", start.alias("start"), (start + F.col("len")).alias("stop"), "text").distinct())
    discard(anchors, rarity)
    return out


def contamination(split: DataFrame, items: DataFrame, size: int = WINDOW, item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, h, n_hit, items) of documents with a hit, written; items: sorted texts of the ids of items with occurring windows."""
    wins = materialize(windows(items, size, item_text, item_id))
    found = hits(split, wins)
    spans = found.select("doc_id", "h", "start", "stop").distinct()
    before = F.max("stop").over(Window.partitionBy("doc_id", "h").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))))
    covered = spans.withColumn("before", before).groupBy("doc_id", "h").agg(F.sum(new).alias("n_hit"))
    named = found.select("doc_id", "h", "text").distinct().join(wins.select("item_id", "text"), "text").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    named = named.select(F.col("doc_id").alias("i"), F.col("h").alias("k"), "items")
    out = materialize(covered.join(named, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("doc_id", "h", "n_hit", "items"))
    discard(wins, found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that hold a window of an item; all columns stay as they are."""
    i, k = fresh(docs.columns, "bad_id"), fresh(docs.columns, "bad_hash")
    split = split_words(docs, text_col, id_col)
    # Written: with its size known, Spark broadcasts it if it is small and shuffles the texts only if it is not.
    bad = contamination(split, items, size).select(F.col("doc_id").alias(i), F.col("h").alias(k))
    discard(split)
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(k)), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_words(table(spark, sf_dir, "documents"))
    bad = contamination(split, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("i"), F.col("h").alias("k"), "n_hit", "items")
    found = F.coalesce("items", F.array().cast("array<string>"))
    every = split.select("doc_id", "h", F.size("w").cast("long").alias("n_words"))
    return every.join(bad, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS t, least(len(w), 10) AS l FROM n),
sizes AS (SELECT DISTINCT l FROM win),
spot AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, sizes WHERE len(w) >= l),
here AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS t FROM spot),
hit AS (SELECT doc_id, p, here.l AS l, item_id FROM here JOIN win ON here.t = win.t AND here.l = win.l),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""
