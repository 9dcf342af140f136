"""Packing by optimal length buckets: dynamic programming over the global length histogram, then token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quillstone.cluster import cut
from quillstone.llm import counts

BUCKETS, BUDGET = 8, 16384
SHARD_ROWS = 2_000_000  # rows of one length that are ordered in one place


def bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most so many buckets that minimise the padding when each text is padded to its bucket's bound.

    best[k][j] = min over i < j of best[k-1][i] + padding of lengths i+1..j. The padding satisfies the quadrangle
    inequality, so least minimisers grow with j and each layer is solved by divide and conquer. Of equal solutions the
    one with the least split points, seen from the last bucket, is taken.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, dtype=np.int64)
    many = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    mass = np.concatenate([[0], np.cumsum(size * np.asarray(counts, dtype=np.int64))])
    best = np.concatenate([[0], size * many[1:] - mass[1:]])  # one bucket
    froms: list[np.ndarray] = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        now, origin = best.copy(), np.zeros(n + 1, dtype=np.int64)
        work = [(1, n, 0, n - 1)]
        while work:
            a, b, lo, hi = work.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            cost = best[i] + size[j - 1] * (many[j] - many[i]) - (mass[j] - mass[i])
            k = int(cost.argmin())
            now[j], origin[j] = cost[k], i[k]
            work += [(a, j - 1, lo, int(i[k])), (j + 1, b, int(i[k]), hi)]
        best = now
        froms.append(origin)
    out, j = [], n
    for origin in reversed(froms):
        if j:
            out.append(int(size[j - 1]))
            j = int(origin[j])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, keep: bool = False) -> DataFrame:
    """Each row's id, length, bucket (0-based), its bound, batch (0-based in its bucket) and place in the batch; with `keep` its other columns too.

    A batch holds max(1, budget // bound) texts of one bucket, in the order of length, shard (0, but for lengths of more than SHARD_ROWS rows, which the
    id's hash spreads over shards) and id; a text longer than the budget has a batch of its own. Lengths are `length` if given, else the numbers of
    tokens that op8 counts. Null and empty texts have length 0 and no bucket, batch or place; null ids come first; rows equal in length and id follow
    each other in any order. Other columns are ignored, or kept: those called as one of the result's get underscores at their ends. Only what is asked for is
    shuffled; the driver sees one row for each distinct length and shard.
    """
    key = F.col(f"`{id_col}`")
    measure = counts.length(docs, text_col) if length is None else length
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != id_col]) if keep else F.lit(None)
    rows = cut(docs.select(key.alias("id"), F.coalesce(measure, F.lit(0)).cast("int").alias("length"), rest.alias("rest")))
    some = rows.where("length > 0")
    seen = sorted((r[0], r[1]) for r in some.groupBy("length").count().collect())
    tops = bounds([x[0] for x in seen], [x[1] for x in seen], buckets)
    spread = {n: -(-c // SHARD_ROWS) for n, c in seen if c > SHARD_ROWS}  # at most one for each SHARD_ROWS rows
    shard = F.lit(0)
    if spread:
        shards = F.create_map(*[F.lit(x) for pair in spread.items() for x in pair])
        shard = F.coalesce(F.pmod(F.xxhash64("id"), F.try_element_at(shards, F.col("length"))), F.lit(0)).cast("int")
        some = some.withColumn("shard", shard)
        held = sorted((r[0], r[1], r[2]) for r in some.groupBy("length", "shard").count().collect())
    else:
        some, held = some.withColumn("shard", shard), [(n, 0, c) for n, c in seen]
    places, at, bucket = [], 0, 0
    for n, k, c in held:
        while n > tops[bucket]:
            at, bucket = 0, bucket + 1
        places.append((n, k, bucket, tops[bucket], at))
        at += c
    kinds = StructType().add("n", IntegerType()).add("k", IntegerType()).add("bucket", IntegerType()).add("bound", IntegerType()).add("offset", LongType())
    offsets = docs.sparkSession.createDataFrame(places, kinds)
    within = Window.partitionBy("length", "shard").orderBy(F.col("id").asc_nulls_first())
    ranked = some.withColumn("rank", F.row_number().over(within) - 1)
    at = F.col("rank") + F.col("offset")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound"))).cast("bigint")
    placed = ranked.join(offsets, (F.col("length") == F.col("n")) & (F.col("shard") == F.col("k")))
    placed = placed.select("id", "length", "rest", "bucket", "bound", F.floor(at / room).cast("bigint").alias("batch"), (at % room).cast("bigint").alias("place"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bound", "int"), ("batch", "bigint"), ("place", "bigint"))]
    out = placed.union(rows.where("length = 0").select("id", "length", "rest", *none))
    own = ["length", "bucket", "bound", "batch", "place"]
    names: dict[str, str] = {}
    for c in docs.columns if keep else []:
        if c != id_col:
            name = c
            while name in own or name == id_col or name in names.values() or name != c and name in docs.columns:
                name += "_"
            names[c] = name
    return out.select(F.col("id").alias(id_col), *own, *[F.col("rest")[c].alias(n) for c, n in names.items()])


def sql(table: str = "lengths", buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same packing of a table (doc_id, length) as DuckDB SQL, for lengths of fewer than SHARD_ROWS rows; the dynamic program is one common table for each layer."""
    step = "\n".join(
        f"""d{k} AS MATERIALIZED (SELECT n, m AS best, m // 1000000 AS cost, (m % 1000000)::INT AS origin FROM (
  SELECT j.n AS n, min((p.cost + j.size::HUGEINT * (j.many - i.many) - (j.mass - i.mass)) * 1000000 + i.n) AS m FROM h j JOIN h i ON i.n < j.n JOIN d{k - 1} p ON p.n = i.n GROUP BY j.n)
  UNION ALL SELECT 0, 0, 0, 0),"""
        for k in range(2, buckets + 1)
    )
    back = ["b0 AS (SELECT (SELECT max(n) FROM h) AS n)"]
    for k in range(buckets, 1, -1):
        back.append(f"b{buckets - k + 1} AS (SELECT d.origin AS n FROM d{k} d JOIN b{buckets - k} USING (n) WHERE d.n > 0)")
    ends = " UNION ".join(f"SELECT n FROM b{k}" for k in range(buckets))
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, length FROM {table}),
g AS (SELECT length AS size, count(*) AS c FROM t WHERE length > 0 GROUP BY length),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY size) AS n, size, sum(c) OVER w AS many, sum(c * size) OVER w AS mass FROM g WINDOW w AS (ORDER BY size)
  UNION ALL SELECT 0, 0, 0, 0),
d1 AS MATERIALIZED (SELECT n, 0::HUGEINT AS best, size::HUGEINT * many - mass AS cost, 0 AS origin FROM h),
{step}
{", ".join(back)},
e AS MATERIALIZED (SELECT size AS bound, row_number() OVER (ORDER BY size) - 1 AS bucket FROM h WHERE n > 0 AND n IN ({ends})),
p AS (SELECT t.*, e.bucket, e.bound, row_number() OVER (PARTITION BY e.bucket ORDER BY length, doc_id) - 1 AS nth FROM t ASOF JOIN e ON t.length <= e.bound WHERE t.length > 0),
q AS (SELECT *, greatest(1, {budget} // bound) AS room FROM p)
SELECT doc_id, length, bucket::INT AS bucket, bound::INT AS bound, (nth // room)::BIGINT AS batch, (nth % room)::BIGINT AS place FROM q
UNION ALL SELECT doc_id, length, NULL, NULL, NULL, NULL FROM t WHERE length = 0"""
