"""Line-first cleaning, in DataFrame operations only: rules per line, then rejection of documents that lose too much.

Lines are judged before documents. A line fails if it repeats an earlier one; if it is mostly punctuation, holds no
letter, or shouts in runs of marks; if it is a navigation bar (bars, or other separators between items of a few words);
or if it is boilerplate (a known phrase, a copyright or page mark, or nothing but an address). Failing lines are removed;
a document that keeps less than half of the characters of its lines is rejected. Beside that verdict stand counts over the
whole text, computed inside each row with array functions: no shuffle, and no limit on a text's length. clean() gives
the documents that stay, with what is left of their texts.

How often a line stands in other documents plays no part: copies of a good document would take each other for boilerplate.

Words in repeated 3-word windows are found in two steps: windows are hashed next to their position into one sorted
array of longs, where equal hashes are neighbours; only those few are compared as text, so the count is exact.

Defined results: a null text has no words and no lines (all counts 0, base_failed true, kept false). Repeated rows
are judged each; a null id is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
MARKS = r"[!?#*$%&]{2,}"
LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
#: Separators of navigation bars, and the words that an item between them has at most on average.
SEPARATOR, ITEM_WORDS = r"[|»›•·→]|\x20[>/]\x20", 4
#: Lines of one address, a page number or a copyright mark; matched in lower case.
STRUCTURE = r"^\x20*(https?://|www\.)[^\x20]+\x20*$|^\x20*page\x20+[0-9]+(\x20+of\x20+[0-9]+)?\x20*$|©|\(c\)\x20*[12][0-9][0-9][0-9]"
#: Parts of texts without which no line can match STRUCTURE.
STRUCTURE_HINTS = ("://", "www.", "page", "©", "(c)")
#: Phrases of boilerplate lines, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "copyright", "licensed under", "license, version", "privacy policy", "cookie policy", "terms of use", "terms of service",
    "click here", "subscribe to", "sign in to", "enable javascript", "skip to content", "powered by",
)


def holds_any(text: F.Column, phrases: tuple[str, ...]) -> F.Column:
    """Whether a phrase occurs: plain substring searches, far cheaper than one pattern of alternatives."""
    lower, out = F.lower(text), F.lit(False)
    for phrase in phrases:
        out = out | lower.contains(phrase)
    return out


def badly_marked(line: F.Column) -> F.Column:
    """Whether a line's punctuation or separators break a rule."""
    runs, words = F.regexp_count(line, F.lit(MARKS)), F.regexp_count(line, F.lit(WORD))
    parts = F.regexp_count(line, F.lit(SEPARATOR))
    return (
        (F.regexp_count(line, F.lit(PUNCTUATION)) * 5 > F.length(line))
        | (F.regexp_count(line, F.lit(r"\|")) >= 2)
        | ((parts >= 2) & (words <= (parts + 1) * ITEM_WORDS))
        | ((runs >= 2) & (runs * 5 >= words))
        | ~line.rlike(LETTER)
    )


def boilerplate(line: F.Column) -> F.Column:
    return holds_any(line, BOILERPLATE) | F.lower(line).rlike(STRUCTURE)


def measured(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, counts, kept_chars, line_chars, clean text) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    df = df.select("doc_id", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.withColumn("n", F.size("w")).withColumn("bits", F.greatest(F.lit(24), F.length(F.bin("n"))))
    df = df.withColumn(
        "packed",
        F.expr("CASE WHEN n >= 3 THEN sort_array(transform(slice(w, 1, n - 2), (x, i) -> shiftleft(xxhash64(x, w[i + 1], w[i + 2]), bits) | i)) ELSE cast(array() AS array<bigint>) END"),
    )
    alike = "filter(packed, (x, i) -> shiftright(x, bits) = shiftright(get(packed, i - 1), bits) OR shiftright(x, bits) = shiftright(get(packed, i + 1), bits))"
    df = df.withColumn("alike", F.expr(alike))
    named = "sort_array(transform(alike, x -> named_struct('k', concat_ws(' ', slice(w, cast(x & (shiftleft(1L, bits) - 1) AS int) + 1, 3)), 'p', cast(x & (shiftleft(1L, bits) - 1) AS int))))"
    df = df.withColumn("named", F.expr(named))
    df = df.withColumn("spots", F.expr("sort_array(transform(filter(named, (x, i) -> x.k = get(named, i - 1).k OR x.k = get(named, i + 1).k), x -> x.p))"))
    covered = "aggregate(spots, named_struct('stop', 0, 'sum', 0L), (a, p) -> named_struct('stop', p + 3, 'sum', a.sum + p + 3 - greatest(p, a.stop)), a -> a.sum)"
    df = df.withColumn("single", F.array_distinct("lines")).withColumn("suspect", holds_any(F.col("t"), BOILERPLATE + STRUCTURE_HINTS))
    # A condition outside the lambdas, so that the whole text is searched once and not for each line.
    plain, strict = F.filter("single", lambda x: ~badly_marked(x)), F.filter("single", lambda x: ~(badly_marked(x) | boilerplate(x)))
    df = df.withColumn("passed", F.when(F.col("suspect"), strict).otherwise(plain))
    lengths = lambda c: F.expr(f"aggregate({c}, 0L, (a, x) -> a + length(x))")
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("single")).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        lengths("passed").alias("kept_chars"),
        lengths("lines").alias("line_chars"),
        F.array_join("passed", "\n").alias("clean_text"),
    )


def judged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, min_kept: int = MIN_KEPT_PERCENT) -> DataFrame:
    """measured() with base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    df = measured(docs, text_col, id_col).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("line_chars") * min_kept))


def clean(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str = "n_chars", **limits: int) -> DataFrame:
    """The rows of docs that are kept, with the lines that passed as their text and length_col (if there is one) set anew."""
    verdict, text = fresh(docs.columns, "verdict"), F.col(text_col)
    # The verdict travels inside the row, so that equal or missing ids mix nothing up and nothing is joined.
    # Written before rows are dropped: Spark would work out every rule once more for the filter.
    marked = materialize(judged(docs.select(text_col, F.struct(*docs.columns).alias(verdict)), text_col, verdict, **limits).select("doc_id", "clean_text", "kept")).where("kept")
    out = {c: F.col(f"doc_id.`{c}`") for c in docs.columns}
    out[text_col] = F.col("clean_text").cast(docs.schema[text_col].dataType)
    if length_col in out:
        out[length_col] = F.length("clean_text").cast(docs.schema[length_col].dataType)
    return marked.select(*(x.alias(c) for c, x in out.items()))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, x, i FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
single AS (SELECT doc_id, x, min(i) AS i FROM lines GROUP BY doc_id, x),
measured AS (SELECT doc_id, x, i, len(regexp_extract_all(x, '[!-/:-@\[-`{-~]')) AS marks, len(regexp_extract_all(x, '[|»›•·→]| [>/] ')) AS parts,
  len(regexp_extract_all(x, '\|')) AS bars, len(regexp_extract_all(x, '[!?#*$%&]{2,}')) AS runs, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM single),
good AS (SELECT doc_id, sum(length(x)) AS kept_chars, string_agg(x, chr(10) ORDER BY i) AS clean FROM measured
  WHERE NOT (marks * 5 > length(x) OR bars >= 2 OR (parts >= 2 AND n <= 4 * (parts + 1)) OR (runs >= 2 AND runs * 5 >= n) OR NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')
  OR regexp_matches(lower(x), 'all rights reserved|copyright|licensed under|license, version|privacy policy|cookie policy|terms of use|terms of service|click here|subscribe to|sign in to|enable javascript|skip to content|powered by')
  OR regexp_matches(lower(x), '^ *(https?://|www\.)[^ ]+ *$|^ *page +[0-9]+( +of +[0-9]+)? *$|©|\(c\) *[12][0-9][0-9][0-9]')) GROUP BY doc_id),
total AS (SELECT doc_id, sum(length(x)) AS line_chars, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars, coalesce(line_chars, 0) AS line_chars, coalesce(clean, '') AS clean
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN good USING (doc_id) LEFT JOIN total USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars * 100 >= line_chars * 50 AS kept, CAST(kept_chars AS BIGINT) AS kept_chars, sha256(clean) AS clean_sha256
FROM f
"""
