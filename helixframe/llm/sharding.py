"""Shards of nearly equal bytes that keep equal texts together: a minimax contiguous partition.

Groups of equal texts are laid out in order of the first 60 bits of their SHA-256 (texts that agree in these are one
group). Shards are contiguous stretches of that order. The smallest capacity that lets the groups fit into the shards
is found by binary search; a capacity is checked greedily, each shard taking as many groups as fit. The cuts then aim
at an equal share of what is left, never beyond the capacity, so that one huge group does not leave shards empty.

The driver never sees the groups. It works on a bounded number of marks: the order is cut into stretches by leading
bits, a grouped sum gives each stretch's bytes, and positions are known exactly at the stretches' ends. Inside a
stretch a check is taken for fit only if it fits at the known ends, and for unfit only if it would not fit at any
position; stretches in which a cut may fall are summed up again by further bits until the two bounds meet. All row
work is DataFrame operations: a document's shard follows from its own hash and the 23 cuts, without a join.

Defined results: a null text counts as an empty one (no bytes, crc32 0, together with empty texts). Repeated rows are
each placed; a null id sorts first. Exact repeats of id and text take neighbouring slots in either order. With fewer
groups than shards some shards stay empty. An empty table gives no rows. Other columns of the input play no part.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, partitions_for, table

SHARDS = 24
#: A document's size is its bytes and these.
ROW_BYTES = 8
#: Bits of the order's key, and marks that one round may bring to the driver: bounds of its memory, results do not depend on them.
KEY_BITS, FIRST_BITS, MARKS = 60, 14, 1 << 16
#: Spans of keys that one round may read.
SPANS = 48
#: Stretches that hold more than this share of all bytes are taken apart before the search.
HEAVY = 4096


def key_of(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, KEY_BITS // 4), 16, 10).cast("long")


class Marks:
    """Stretches of the order with their first key, bytes, depth in bits, and whether they hold one group only."""

    def __init__(self, rows: DataFrame):
        """rows: (key, size), written."""
        self.rows, self.of = rows, {}
        self.summed(rows, FIRST_BITS)

    def summed(self, rows: DataFrame, depth: int) -> None:
        per = rows.groupBy(F.shiftright("key", KEY_BITS - depth).alias("id")).agg(F.sum("size").alias("b"), F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n"))
        for r in per.collect():  # at most MARKS rows
            self.of[r.a] = (r.b, depth, r.a == r.z or depth == KEY_BITS, r.n)
        self.starts = sorted(self.of)
        self.ends, at = [0], 0
        for a in self.starts:
            at += self.of[a][0]
            self.ends.append(at)
        self.total = at

    def single(self, i: int) -> bool:
        return self.of[self.starts[i]][2]

    def refine(self, which: set[int]) -> None:
        """Sum the stretches `which` by further bits, the shallowest first, by as many as give no more than MARKS marks."""
        least_deep = min(self.of[self.starts[i]][1] for i in which)
        at = sorted(i for i in which if self.of[self.starts[i]][1] == least_deep)[: MARKS >> 1]
        # Spans of neighbours; where there are many, those with the fewest stretches between them are summed as one.
        apart = sorted((b - a for a, b in zip(at, at[1:])), reverse=True)
        apart = max(1, apart[SPANS - 1]) if len(apart) >= SPANS else 1
        spans = [[at[0], at[0]]]
        for i in at[1:]:
            if i - spans[-1][1] <= apart:
                spans[-1][1] = i
            else:
                spans.append([i, i])
        todo = [self.starts[i] for a, z in spans for i in range(a, z + 1)]
        few = [self.of[a][1:] for a in todo]
        depth = KEY_BITS
        while depth > least_deep + 1 and sum(1 if single else min(1 << max(0, depth - d), n) for d, single, n in few) > MARKS:
            depth -= 1
        following = [*self.starts, 1 << KEY_BITS]
        tests = [(F.col("key") >= following[a]) & (F.col("key") < following[z + 1]) for a, z in spans]
        for a in todo:
            del self.of[a]
        while len(tests) > 1:  # a balanced tree of ORs, which the scan's statistics can be held against
            tests = [x | y for x, y in zip(tests[::2], tests[1::2])] + tests[len(tests) & ~1 :]
        inside = tests[0]
        self.summed(self.rows.where(inside), depth)

    def before(self, at: int, open_: set[int] | None = None, reach: int = 0) -> int:
        """The last known end at or before `at`. A stretch that may hold a later one is added to open_, with `reach` neighbours."""
        i = bisect_right(self.ends, at) - 1
        if open_ is not None and at < self.total and self.ends[i] < at and not self.single(i):
            open_.update(j for j in range(max(0, i - reach), min(len(self.starts), i + reach + 1)) if not self.single(j))
        return self.ends[i]

    def after(self, at: int, open_: set[int], reach: int = 0) -> int:
        """The first known end at or after `at`."""
        self.before(max(0, at), open_, reach)
        return self.ends[bisect_left(self.ends, max(0, at))]

    def at_most(self, at: int) -> int:
        """No end at or before `at` lies beyond this."""
        i = bisect_right(self.ends, min(at, self.total)) - 1
        return self.ends[i] if i == len(self.starts) or self.single(i) else min(at, self.total)


def path(marks: Marks, capacity: int, shards: int, step) -> list[int]:
    """Where each shard ends if it takes all it can."""
    out = [0]
    for _ in range(shards):
        out.append(step(min(out[-1] + capacity, marks.total)))
    return out


def least(marks: Marks, shards: int, step, low: int) -> int:
    """The smallest capacity from `low` on with which shards that end by `step` hold everything."""
    high = max(low, marks.total)
    while low < high:
        mid = (low + high) // 2
        if path(marks, mid, shards, step)[-1] >= marks.total:
            high = mid
        else:
            low = mid + 1
    return low


def cut_keys(rows: DataFrame, shards: int = SHARDS) -> tuple[list[int], int]:
    """(the first keys of shards 1, 2, ..., the capacity) for rows (key, size), written."""
    marks = Marks(rows)
    if not marks.total:
        return [], 0
    while heavy := {i for i in range(len(marks.starts)) if not marks.single(i) and marks.of[marks.starts[i]][0] * HEAVY > marks.total}:
        marks.refine(heavy)
    while True:
        fits = least(marks, shards, marks.before, -(-marks.total // shards))
        may = least(marks, shards, marks.at_most, -(-marks.total // shards))
        if may == fits:
            break
        # Every cut of every capacity that is still in question lies between these two paths.
        first, last = path(marks, may, shards, marks.before), path(marks, fits, shards, marks.at_most)
        spans = [(bisect_right(marks.ends, a) - 1, bisect_right(marks.ends, z) - 1) for a, z in zip(first, last)]
        marks.refine({i for a, z in spans for i in range(max(0, a), min(z + 1, len(marks.starts))) if not marks.single(i)})
    while True:
        open_: set[int] = set()
        floor = [marks.total] * (shards + 1)  # the shards from s on can only hold what lies behind floor[s]
        for s in range(shards - 1, -1, -1):
            floor[s] = marks.after(floor[s + 1] - fits, open_, shards - s)
        ends = [0]
        for s in range(shards - 1):
            at = ends[-1]
            to = marks.before(at - (at - marks.total) // (shards - s), open_, s + 1)
            if to <= at < marks.total:
                to = marks.after(at + 1, open_)
            ends.append(max(to, floor[s + 1]))
        if not open_:
            return [marks.starts[bisect_left(marks.ends, e)] if e < marks.total else 1 << KEY_BITS for e in ends[1:]], fits
        marks.refine(open_)


def shard_of(key: Column, cuts: list[int]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key)) if cuts else F.lit(0)


def assign(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row of docs; slots follow the order of hash and id."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), key_of(text).alias("key"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    parts = partitions_for(spark, 0)
    # Ranges of key and id, so that copies of one text are split; the number of a row in its range is kept with it.
    rows = materialize(rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").withColumn("mid", F.monotonically_increasing_id()))
    cuts, _ = cut_keys(rows, shards)
    rows = rows.select("id", "size", "text_crc32", shard_of(F.col("key"), cuts).cast("int").alias("shard"), F.shiftright("mid", 33).alias("part"), "mid")
    # A row for each shard and range that meet: not more than both together.
    met = rows.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    base = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n") - F.col("first")
    met = materialize(met.select("shard", "part", base.alias("base")))
    return rows.join(met, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("mid")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> None:
    """Write docs as Parquet, a folder shard=<n> for each shard; equal texts lie in one folder, spread over as many files as tasks wrote them."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column shard already")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = materialize(docs.select(key_of(text).alias("key"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size")))
    cuts, _ = cut_keys(sizes, shards)
    docs.withColumn("shard", shard_of(key_of(text), cuts)).write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def at(list_of: str, sign: str, bound: str) -> str:
    return f"list_{'max' if sign == '<=' else 'min'}(list_filter({list_of}, lambda p: p {sign} {bound}))"


#: The same partition over a plain list of the groups' ends; crc32 by the table of its bytes.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, CAST('0x' || substr(sha256(coalesce(text, '')), 1, {KEY_BITS // 4}) AS BIGINT) AS k FROM documents),
e AS (SELECT doc_id, k, CAST(length(h) // 2 + {ROW_BYTES} AS BIGINT) AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM d, crc),
g AS (SELECT k, CAST(sum(sum(size)) OVER (ORDER BY k) AS BIGINT) AS hi, CAST(sum(size) AS BIGINT) AS b FROM e GROUP BY k),
p AS (SELECT list_prepend(0, list(hi ORDER BY hi)) AS p, max(hi) AS total FROM g),
c(lo, hi) AS (SELECT CAST(ceil(total / {SHARDS}) AS BIGINT), total FROM p UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN fits THEN (lo + hi) // 2 ELSE hi END FROM
  (SELECT lo, hi, list_reduce(list_prepend(CAST(0 AS BIGINT), range({SHARDS})), lambda x, s: {at('p', '<=', 'x + (lo + hi) // 2')}) = total AS fits FROM c, p WHERE lo < hi)),
w AS (SELECT lo AS capacity FROM c WHERE lo = hi LIMIT 1),
f(s, floor) AS (SELECT {SHARDS}, total FROM p UNION ALL SELECT s - 1, {at('p', '>=', 'floor - capacity')} FROM f, p, w WHERE s > 1),
z(s, stop) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT s + 1, greatest(floor, CASE WHEN even <= stop AND stop < total THEN {at('p', '>', 'stop')} ELSE even END) FROM
  (SELECT z.s, stop, total, p, floor, {at('p', '<=', f'stop + (total - stop + {SHARDS} - z.s - 1) // ({SHARDS} - z.s)')} AS even FROM z JOIN f ON f.s = z.s + 1, p WHERE z.s < {SHARDS} - 1)),
h AS (SELECT k, CAST((SELECT count(*) FROM z WHERE s > 0 AND stop <= g.hi - g.b) AS INT) AS shard FROM g)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM e JOIN h USING (k)
"""
