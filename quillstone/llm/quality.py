"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are its own make-up and its neighbours'. The field is trained on a bounded
sample of labelled documents, whose lines take the document's label to begin with and, after a first round,
good where the first field finds a line of a bad document like those of good ones. A document's quality is the mean, by
line length, of the probabilities that forward-backward gives its lines.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructType

from quillstone.cluster import ship
from quillstone.llm import crf
from quillstone.llm.common import pieces
from quillstone.llm.rules import STOP_WORDS

SAMPLE = 1500  # labelled documents of each class that the field is trained on
EXCERPT = 1 << 17  # characters of one of them
SAMPLE_COST = 12_000_000  # no further document of a class is taken once its excerpts cost so much: a character 1, a line LINE_COST
LINE_COST = 100
THRESHOLD = 0.5
_STOP = frozenset(STOP_WORDS)
_LOW, _UP, _NUM, _BLANK, _STOPS, _OTHER = range(6)


@cache
def _kinds() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        if k[0] in "LM":
            table[c] = _UP if k == "Lu" else _LOW
        elif k[0] == "N":
            table[c] = _NUM
        elif k[0] == "Z" or c in (9, 13):
            table[c] = _BLANK
    for ch in ".,;:!?'\"()-":
        table[ord(ch)] = _STOPS
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features, each text's number of lines, and each line's length in characters. A line is what newlines part; blank ones are left out."""
    lines: list[str] = []
    per = []
    for t in texts:
        own = [x for x in t.split("\n") if x and not x.isspace()]
        lines += own
        per.append(len(own))
    n = len(lines)
    per = np.array(per, dtype=np.int64)
    if not n:
        return np.zeros((0, 36)), per, np.zeros(0)
    size = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _kinds()[codes]
    at = np.cumsum(size) - size
    share = np.stack([np.add.reduceat(kinds == k, at, dtype=np.int64) for k in range(6)], axis=1) / size[:, None]
    words, distinct, stops, again = (np.zeros(n) for _ in range(4))
    for i, line in enumerate(lines):
        w = line.split()
        s = set(w)
        words[i], distinct[i] = len(w), len(s)
        stops[i] = sum(map(_STOP.__contains__, w)) / max(1, len(w))
    number = crf._numbers(per)
    inner = np.flatnonzero(number > 0)
    again[inner] = [lines[i] == lines[i - 1] for i in inner.tolist()]
    words = np.maximum(words, 1)
    own = np.column_stack([share, np.log1p(size), np.log1p(words), size / words / 10, np.log(distinct / np.sqrt(words) + 0.05), stops, again])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[inner] = own[inner - 1]
    after[inner - 1] = own[inner]
    return np.hstack([own, before, after]), per, size.astype(np.float64)


def document_scores(model: crf.Crf, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality of each text, its number of lines, and of those more likely bad. A text without lines has quality 0."""
    x, per, size = features(texts)
    good = model.marginals(x, per)[:, 1] if len(x) else np.zeros(0)
    doc = np.repeat(np.arange(len(per)), per)
    weight = np.bincount(doc, size, len(per))
    score = np.bincount(doc, size * good, len(per)) / np.maximum(weight, 1)
    return score, per, np.bincount(doc, good < 0.5, len(per)).astype(np.int64)


def fit(texts: list[str], labels: list[int]) -> crf.Crf:
    """The field of two classes from labelled documents. Without documents of both classes every line is taken to be good."""
    x, per, _ = features(texts)
    y = np.repeat(np.asarray(labels, dtype=np.int64), per)
    if len(set(y.tolist())) < 2:
        return crf.Crf(np.vstack([np.zeros((36, 2)), [[-3.0, 3.0]]]), np.zeros((2, 2)), np.zeros(36), np.ones(36))
    model = crf.train(x, y, per)
    # lines of bad documents that look like good ones alone
    alone = crf.Crf(model.weights, np.zeros((2, 2)), model.mean, model.scale).marginals(x, np.ones(len(x), dtype=np.int64))[:, 1]
    y = np.where((y == 0) & (alone > 0.8), 1, y)
    return crf.train(x, y, per)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> crf.Crf:
    """The field trained on at most `sample` labelled documents of each class, those with the least hashes of their ids: the same whatever the partitions.

    Of rows that share an id the one with the least hash of its text is taken, of a long text the first EXCERPT characters, and no more documents once they cost
    SAMPLE_COST, so that what the driver gets is bounded in bytes too. Null ids and texts aren't learned from.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("label").alias("label"))
    first = lambda k: marks.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample)
    marks = first(0).union(first(1))
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    part = F.substring("text", 1, EXCERPT)
    cost = F.length(part) + LINE_COST * (1 + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit(""))))
    sized = text.join(F.broadcast(marks), "id").select("id", "label", F.struct(F.xxhash64("text").alias("h"), cost.alias("cost")).alias("one"))
    sized = sized.groupBy("id").agg(F.first("label").alias("label"), F.min("one").alias("one")).orderBy(F.xxhash64("id"), "id")
    spent, chosen = [0, 0], []
    for r in sized.collect():  # at most 2 x sample small rows
        if spent[r["label"]] < SAMPLE_COST:
            spent[r["label"]] += r["one"]["cost"]
            chosen.append((r["id"], r["one"]["h"], r["label"]))
    if not chosen:
        return fit([], [])
    kinds = StructType().add("i", text.schema["id"].dataType).add("h", LongType()).add("label", IntegerType())
    wanted = docs.sparkSession.createDataFrame(chosen, kinds)
    rows = text.join(F.broadcast(wanted), (F.col("id") == F.col("i")) & (F.xxhash64("text") == F.col("h"))).select("id", "label", part.alias("text"))
    rows = rows.groupBy("id").agg(F.first("label").alias("label"), F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def classify(docs: DataFrame, model: crf.Crf, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each row's id, quality, number of lines, of bad lines, and whether it is kept (quality at the threshold or above).

    Null, empty and blank texts have quality 0 and no lines, and aren't kept. Repeated rows are scored alike; null
    ids are kept; other columns are ignored. One pass over whole texts, no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    sent: Broadcast = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score, lines, bad = document_scores(sent.value, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(score, 6)), pa.array(lines, type=pa.int32()), pa.array(bad, type=pa.int32()), pa.array(score >= threshold)], ["id", "quality", "lines", "bad_lines", "kept"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType().add("id", docs.schema[id_col].dataType).add("quality", DoubleType()).add("lines", IntegerType()).add("bad_lines", IntegerType()).add("kept", BooleanType())
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: crf.Crf, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text is of quality at the threshold or above, with all their columns, whatever they are called.

    Null, empty and blank texts are of quality 0 and go; repeated rows stay or go together; null ids and nulls elsewhere don't matter; long texts are scored whole; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        given = ["" if t is None else t for t in texts]
        sizes = np.cumsum([len(t) for t in given]) // (8 << 20) if given else np.zeros(0)
        parts = [document_scores(sent.value, [given[i] for i in np.flatnonzero(sizes == k)])[0] for k in np.unique(sizes)]
        return pd.Series(np.concatenate(parts) >= threshold if parts else [], dtype="boolean")

    return docs.where(good(F.col(f"`{text_col}`").cast("string")))
