"""Exact top-k search by BM25 with MaxScore.

Two passes. The first turns each document into the terms that any query asks for; document counts, frequencies and
lengths are aggregated over the whole corpus. The second builds postings in shards and searches each shard with
every query: terms are taken by falling score bound while the bounds still to come could lift an unseen document
into the top k (essential postings, traversed); from there on only documents already met are probed, and
dropped once what remains can't lift them. The shards' lists then merge.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from quillstone.cluster import Scratch, cut, ship
from quillstone.llm.common import lists, pieces

K, K1, B = 10, 1.2, 0.75
DIGITS, SLACK = 6, 2e-6  # scores are compared as rounded to so many digits
QUERY_CHARS = 4_000_000  # of queries taken at a time: bounds what is sent to the executors
SHARD_POSTINGS = 2_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _blocks(queries: DataFrame, most: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in queries.toLocalIterator():
        block.append((row[0], row[1] or ""))
        size += len(block[-1][1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


class Shard:
    """Postings of some documents: by term, document numbers and their scores, and each term's highest."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float, k1: float = K1, b: float = B):
        order = np.lexsort((docs, terms))
        self.docs, terms, tfs = docs[order], terms[order], tfs[order].astype(np.float64)
        self.score = idf[terms] * (tfs * (k1 + 1)) / (tfs + k1 * (1 - b + b * lengths[self.docs] / mean))
        self.offset = np.searchsorted(terms, np.arange(len(idf) + 1))
        self.bound = np.zeros(len(idf))
        np.maximum.at(self.bound, terms, self.score)
        self.sum = np.zeros(len(lengths))

    def top(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers, and scores, of all that may be among the k best of this shard: a superset only by ties."""
        terms = terms[self.bound[terms] > 0]
        terms = terms[np.argsort(-self.bound[terms], kind="stable")]
        rest = np.append(np.cumsum(self.bound[terms][::-1])[::-1], 0.0)
        met, least, total, touched = np.zeros(0, dtype=np.int64), -np.inf, self.sum, []
        for n, t in enumerate(terms):
            at = slice(self.offset[t], self.offset[t + 1])
            if rest[n] + SLACK >= least:  # essential
                docs = self.docs[at]
                new = docs[total[docs] == 0]
                touched.append(new)
                met = np.concatenate([met, new])
                total[docs] += self.score[at]
            else:
                met = met[total[met] + rest[n] + SLACK >= least]
                docs = self.docs[at]
                where = np.minimum(np.searchsorted(docs, met), len(docs) - 1)
                hit = docs[where] == met
                total[met[hit]] += self.score[at][where[hit]]
            if len(met) > k:
                least = np.partition(total[met], len(met) - k)[len(met) - k]
        best = met[total[met] + SLACK >= least]
        found = best, total[best].copy()
        for docs in touched:
            total[docs] = 0.0
        return found


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """For every row of queries its k best documents: query id, rank from 1, document id, score (BM25, six digits).

    Best is higher score, then lower id (null ids last); repeated documents are documents of their own, repeated queries are answered
    as often. Null texts count as no documents, empty ones do. Documents without a term of the query are never answers, so a
    query without words has none. Other columns are ignored. Queries are taken in blocks of bounded size, whatever their number.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType
    query_kind = queries.schema[query_id].dataType
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    asked = queries.select(F.col(f"`{query_id}`").alias("q"), F.col(f"`{query_text}`").cast("string").alias("t"))
    out = None
    for block in _blocks(asked, QUERY_CHARS):
        found = _answers(text, block, k, kind, query_kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], StructType().add("q", query_kind).add("rank", IntegerType()).add("id", kind).add("score", DoubleType()))
    return out.select(F.col("q").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def _answers(text: DataFrame, block: list[tuple], k: int, kind, query_kind) -> DataFrame:
    spark = text.sparkSession
    number: dict[str, int] = {}
    asked = [np.array(sorted({number.setdefault(w, len(number)) for w in words(t)}), dtype=np.int64) for _, t in block]
    vocabulary = spark.sparkContext.broadcast(number)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in pieces(batches):
            sizes, terms, tfs, per = [], [], [], []
            for t in batch.column(1).to_pylist():
                ws = words(t)
                sizes.append(len(ws))
                c = Counter(filter(known.__contains__, ws))
                terms += map(known.__getitem__, c)
                tfs += c.values()
                per.append(len(c))
            per = np.array(per)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int32()), lists(np.array(terms, dtype=np.int32), per, pa.int32()), lists(np.array(tfs, dtype=np.int32), per, pa.int32())], ["id", "size", "terms", "tfs"])

    scratch = Scratch(spark)
    schema = StructType().add("id", kind).add("size", IntegerType()).add("terms", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
    picked = scratch.put(text.mapInArrow(pick, schema))
    n, total = picked.agg(F.count("*"), F.sum("size")).first()
    df = np.zeros(len(number))
    for t, c in picked.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = c
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = max(1e-9, (total or 0) / max(n, 1))
    plan = spark.sparkContext.broadcast((idf, asked))

    def hunt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, asked = plan.value
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lengths = table.column("id").combine_chunks(), table.column("size").to_numpy().astype(np.float64)
            terms = table.column("terms").combine_chunks()
            per = np.diff(terms.offsets.to_numpy())
            docs = np.repeat(np.arange(len(lengths)), per)
            shard = Shard(docs, terms.flatten().to_numpy().astype(np.int64), table.column("tfs").combine_chunks().flatten().to_numpy(), lengths, idf, mean)
            qs, ds, ss = [], [], []
            for q, wanted in enumerate(asked):
                found, scores = shard.top(wanted, k)
                qs.append(np.full(len(found), q))
                ds.append(found)
                ss.append(np.round(scores, DIGITS))
            qs, ds, ss = (np.concatenate(x) if x else np.zeros(0) for x in (qs, ds, ss))
            return pa.RecordBatch.from_arrays([pa.array(qs, type=pa.int64()), ids.take(pa.array(ds, type=pa.int64())), pa.array(ss, type=pa.float64())], ["n", "id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).flatten())
            if size >= SHARD_POSTINGS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    some = picked.where(F.size("terms") > 0).mapInArrow(hunt, StructType().add("n", LongType()).add("id", kind).add("score", DoubleType()))
    best = Window.partitionBy("n").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], StructType().add("n", LongType()).add("q", query_kind))
    out = cut(ranked.join(names, "n").select("q", "rank", "id", "score"))
    scratch.close()
    return out


def sql(docs: str = "documents", queries: str = "benchmark", k: int = K) -> str:
    """The same search as DuckDB SQL."""
    split = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    return f"""
WITH q AS (SELECT DISTINCT item_id, unnest({split}) AS w FROM {queries}),
d AS MATERIALIZED (SELECT doc_id, {split} AS ws FROM {docs} WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
p AS MATERIALIZED (SELECT doc_id, len(ws) AS size, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1}) / (tf + {K1} * ({1 - B} + {B} * size / mean))), {DIGITS}) AS score
      FROM q JOIN p USING (w) JOIN f USING (w), n GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= {k}"""
