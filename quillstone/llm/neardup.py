"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

Texts with the same set of shingles are one node. Nodes that share a band are compared with their bucket's least node
(its hub) first, which joins most copies. What is then left in buckets with several groups is compared in full where
a bucket is small; members of larger ones, say all documents with one licence text, are joined by their rarest
shingles instead (a prefix filter by sizes, which is exact), so that a passage that many documents share doesn't
pair them all. Signatures only turn pairs away that are far below the threshold; sets of shingles decide the rest.

SuperMinHash (Ertl 2017): each element draws a random permutation of the signature's places; its value at
step j is j plus a random fraction and goes to the permutation's j-th place. Values grow with the step, so once
every place holds less than j no later step can change anything and the document stops. Here step j
runs for all elements of a batch of documents at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from quillstone.cluster import Scratch, cut, ship
from quillstone.llm.common import lists, pieces

PLACES, BANDS, WORDS, THRESHOLD = 160, 40, 3, 0.5
MARGIN = 0.2  # beyond it from the threshold, estimates decide: five standard deviations
SMALL = 16  # members of a bucket that are compared pair by pair; larger ones go by their rarest shingles
RATIO = 1.15  # of the sizes in a class of sizes
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


@cache
def _wordlike() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of so many lower-cased words, and the index of each one's text. A text with fewer words is one shingle; one without words has none."""
    low = [t.lower() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1)
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _wordlike()[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chars = np.flatnonzero(inside)
    word = np.cumsum(first)[chars] - 1
    value = codes[chars].astype(np.uint64)
    value += (chars - at[word] + 1).astype(np.uint64) * _GOLD
    each = np.add.reduceat(_mix(value), np.searchsorted(chars, at))
    text = np.searchsorted(ends, at, side="right")
    n = len(each)
    made = each.copy()
    whole = np.ones(n, dtype=bool)
    for k in range(1, words):
        same = np.zeros(n, dtype=bool)
        same[: n - k] = text[k:] == text[: n - k]
        made *= _A
        made[: n - k] += np.where(same[: n - k], each[k:], np.uint64(0))
        whole &= same
    opens = np.ones(n, dtype=bool)
    opens[1:] = text[1:] != text[:-1]
    keep = whole | opens  # the first run of a short text stands for all of it
    return _mix(made[keep]), text[keep]


def signatures(hashes: np.ndarray, text: np.ndarray, texts: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, texts x places, as 32 random bits of the value that won each place. text: sorted."""
    best = np.full(texts * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    table: np.ndarray | None = None
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(places):
        if not len(hashes):
            break
        draw = _mix(hashes + np.uint64((j + 1) * int(_GOLD) & (1 << 64) - 1))
        slot = (j + (((draw & _LOW) * np.uint64(places - j)) >> _32)).astype(np.int16)
        if table is None and j == 6:  # few are left, mostly of short texts: now with their whole permutations
            table = np.tile(np.arange(places, dtype=np.int16), (len(hashes), 1))
            rows = np.arange(len(hashes))
            for i, (k, moved) in enumerate(swaps):
                table[rows, k] = moved
            swaps = []
        if table is None:
            here, there = np.full(len(hashes), j, dtype=np.int16), slot
            for k, moved in swaps:
                here = np.where(k == j, moved, here)
                there = np.where(k == slot, moved, there)
            swaps.append((slot, here))
        else:
            rows = np.arange(len(hashes))
            there = table[rows, slot]
            table[rows, slot] = table[:, j]
        np.minimum.at(best, text * places + there, (np.uint64(j) << _32) | (draw >> _32))
        open_ = (best.reshape(texts, places) >= np.uint64(j + 1) << _32).any(axis=1)[text]
        if not open_.all():
            hashes, text = hashes[open_], text[open_]
            swaps = [(k[open_], moved[open_]) for k, moved in swaps]
            table = None if table is None else table[open_]
    return (best & _LOW).astype("<u4").reshape(texts, places)


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles once, in ascending order."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], text[keep]


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, h, node, n, sig): 64-bit hashes of the text and of its set of shingles, the set's size, its signature; the last three are null where the text has no words. One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hashes, text = distinct(*shingles(texts, words))
            sig = signatures(hashes, text, len(texts))
            n = np.bincount(text, minlength=len(texts))
            none = n == 0
            node = np.zeros(len(texts), dtype=np.uint64)
            at = np.flatnonzero(~none)
            if len(at):
                node[at] = _mix(np.add.reduceat(_mix(hashes + _GOLD), (np.cumsum(n) - n)[at]) + n[at].astype(np.uint64))
            rows = [None if x else s.tobytes() for s, x in zip(sig, none)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node.view(np.int64), mask=none), pa.array(n, type=pa.int32(), mask=none), pa.array(rows, type=pa.binary())], ["id", "h", "node", "n", "sig"])

    schema = StructType().add("id", docs.schema[id_col].dataType).add("h", LongType()).add("node", LongType()).add("n", IntegerType()).add("sig", BinaryType())
    return _keyed(docs, id_col, text_col).select("id", "text", "h").mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def sets(texts: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, set) of the wanted (node, id, h): their shingles, made anew from the one row (id, text, h) that stands for each node."""
    rows = texts.join(wanted.select("node", F.col("id").alias("own"), F.col("h").alias("hash")), (F.col("h") == F.col("hash")) & F.col("id").eqNullSafe(F.col("own")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            given = batch.column(1).to_pylist()
            hashes, text = distinct(*shingles(given, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(hashes.view(np.int64), np.bincount(text, minlength=len(given)), pa.int64())], ["node", "set"])

    made = rows.select("node", "text").mapInArrow(run, StructType().add("node", LongType()).add("set", ArrayType(LongType())))
    return made.groupBy("node").agg(F.first("set").alias("set"))  # rows that repeat with id and text


def _alike(a: Column, b: Column) -> Column:
    """Share of the places at which two signatures agree: the estimate of the Jaccard similarity."""

    @F.pandas_udf("double")
    def share(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(x), dtype="<u4").reshape(len(x), -1)
        right = np.frombuffer(b"".join(y), dtype="<u4").reshape(len(y), -1)
        return pd.Series((left == right).mean(axis=1))

    return share(a, b)


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, share) of the pairs of nodes whose signatures agree at so many places or more."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", _alike(F.col("sig_a"), F.col("sig_b")).alias("share")).where(F.col("share") >= least)


def _verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, set) have a Jaccard similarity at the threshold or above."""
    side = lambda k: held.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    exact = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", shared.alias("s"), (F.size("set_a") + F.size("set_b")).alias("n"))
    return exact.where(F.col("s") >= threshold * (F.col("n") - F.col("s"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b), root the least node it is connected with.

    Union-find as alternating large-star and small-star steps; the edges end as stars round the roots, in a number of
    rounds that grows with the logarithm of the longest chain. Least neighbours are aggregated before they are joined back, so a node with very many links is no task of its own.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        least = pairs.groupBy("v").agg(F.min("u").alias("x")).select("v", F.col("v").alias("m"))  # what links to larger nodes ...
        lower = pairs.groupBy("u").agg(F.min("v").alias("m"))  # ... and the least of its smaller ones
        least = least.join(lower, F.col("v") == F.col("u"), "left").select("v", F.coalesce(lower["m"], least["m"]).alias("m"))
        large = pairs.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def bounds(most: int = 1 << 31) -> list[int]:
    """The least size of each class of sizes."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


def rare_pairs(ends: DataFrame, held: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes (node, root, n) of different roots, among them all whose sets (node, set) reach the threshold.

    Sets of x and y items reach it only with t / (1 + t) * (x + y) items in common; so, with all items in one order, the first
    x - that + 1 items of one and the first y - that + 1 of the other share one. Rare items come first, and those in one set only are never sent.
    """
    items = held.select("node", F.explode("set").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    kept = items.join(often, "item").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("items"))
    edges = F.array(*map(F.lit, bounds()))
    number = lambda n: F.size(F.filter(edges, lambda b: b <= n)) - 1
    rows = ends.join(kept, "node").withColumn("own", number(F.col("n")))
    rows = rows.withColumn("from", number(F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9)))).withColumn("to", number(F.floor(F.col("n") / threshold + 1e-9)))

    def first(c: Column) -> Column:
        """Items to send for partners of a class: the prefix less what no other set has."""
        least = F.greatest(F.get(edges, c), F.ceil(F.col("n") * threshold - 1e-9))
        common = F.ceil((F.col("n") + least) * (threshold / (1 + threshold)) - 1e-9)
        return F.greatest(F.lit(0), F.col("n") - common + 1 - (F.col("n") - F.size("items"))).cast("int")

    sent = F.flatten(F.transform(F.sequence("from", "to"), lambda c: F.transform(F.slice("items", F.lit(1), first(c)), lambda i: F.struct(i["item"].alias("item"), F.least(F.col("own"), c).alias("lo"), F.greatest(F.col("own"), c).alias("hi")))))
    sent = scratch.put(rows.select("node", "root", "own", F.explode(sent).alias("s")).select("node", "root", "own", "s.*"), "rare")
    mixed = sent.groupBy("item", "lo", "hi").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("item", "lo", "hi")
    sent = scratch.put(sent.join(mixed, ["item", "lo", "hi"], "left_semi"), "rare")
    x = sent.select("item", "lo", "hi", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("own").alias("own_a"))
    y = sent.select("item", "lo", "hi", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("own").alias("own_b"))
    same = x.where("lo = hi").join(y.where("lo = hi"), ["item", "lo", "hi"]).where("root_a < root_b").select("a", "b")
    other = x.where("lo < hi and own_a = lo").join(y.where("lo < hi and own_b = hi"), ["item", "lo", "hi"]).where("root_a != root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(other).distinct()


def grouped(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h, node, at) and nodes (node, root, first, rows, links): first is the least (no id, id, h, at) among a node's rows, links the number of other nodes it was found alike with. Texts without words have no node."""
    texts = _keyed(docs, id_col, text_col)
    rows = scratch.put(signed(docs, id_col, text_col, words).withColumn("at", F.monotonically_increasing_id()), "rows")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h", "at")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = scratch.put(nodes.select("node", "first", "first.id", "first.h", "rows", "n", "sig"), "nodes")
    wide = PLACES // BANDS * 4
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * wide + 1, F.lit(wide)))))
    bands = nodes.select("node", band.alias("key"))
    full = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.put(bands.join(full, "key"), "shared")
    stars = scratch.put(shared.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    least, sure, near = threshold - MARGIN, F.col("share") >= threshold + MARGIN, F.col("share") < threshold + MARGIN
    told = scratch.put(_estimated(stars, nodes, least), "told")
    roots = components(told.where(sure))
    # a bucket may hold nodes that aren't like its hub but like each other
    placed = shared.join(roots, "node", "left").select("key", "node", "members", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    ends = scratch.put(placed.join(mixed, "key", "left_semi").where("members > 2"), "mixed")  # a pair has been compared
    few, many = ends.where(F.col("members") <= SMALL), scratch.put(ends.where(F.col("members") > SMALL).select("node", "root").distinct(), "many")
    x, y = few.select("key", F.col("node").alias("a"), F.col("root").alias("root_a")), few.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    cross = x.join(y, "key").where("root_a < root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = scratch.put(cross.distinct().join(stars, ["a", "b"], "left_anti"), "cross")
    told = told.union(scratch.put(_estimated(cross, nodes, least), "told"))
    wanted = told.where(near).select(F.explode(F.array("a", "b")).alias("node")).union(many.select("node")).distinct()
    held = scratch.put(sets(texts, nodes.join(wanted, "node", "left_semi"), words), "sets")
    if many.head(1):
        rare = rare_pairs(many.join(nodes.select("node", "n"), "node"), held.join(many, "node", "left_semi"), threshold, scratch)
        told = told.union(scratch.put(_estimated(rare.join(stars.union(cross), ["a", "b"], "left_anti"), nodes, least), "told"))
    links = scratch.put(told.where(sure).select("a", "b").union(_verified(told.where(near).select("a", "b"), held, threshold)), "links")
    roots = components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    told = nodes.select("node", "first", "rows").join(roots, "node", "left").join(ends, "node", "left")
    return rows.select("id", "h", "node", "at"), told.select("node", F.coalesce("root", "node").alias("root"), "first", "rows", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Each row's id, its group's least id, the group's size in rows, the row's number of links, and whether the row stays (one row of each group does).

    Groups are the connected components of texts whose sets of word runs have a Jaccard similarity at the threshold or above; banding
    finds such a pair with a probability of 0.92 at 0.5, 0.98 at 0.55 and more above. links counts the rows with the same set and the other sets it was
    compared with and found alike (not each pair of a large group is). Null or wordless texts stay alone, with
    their own id as group and no links. Repeated rows are copies of each other. Null ids come last in a group; other columns, whatever they are called, are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        rows, nodes = grouped(docs, scratch, id_col, text_col, threshold, words)
        nodes = scratch.put(nodes, "told")
        groups = nodes.groupBy("root").agg(F.min("first").alias("one"), F.sum("rows").alias("size"))
        told = nodes.join(groups, "root").select("node", F.col("one.id").alias("group"), F.col("one.at").alias("stays"), "size", (F.col("links") + F.col("rows") - 1).alias("links"))
        some = rows.where("node is not null").join(told, "node").select("id", "group", "size", "links", (F.col("at") == F.col("stays")).alias("kept"))
        alone = rows.where("node is null").select("id", F.col("id").alias("group"), F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("links"), F.lit(True).alias("kept"))
        return cut(some.union(alone).toDF(id_col, "group_id", "group_size", "links", "kept"))
    finally:
        scratch.close()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The documents without near duplicates: of each group the row with the least id stays, with all its columns, whatever they are called.

    Null, empty and wordless texts all stay. Of rows that repeat with id and text one stays, and of rows that tie with the least id that with the least hash of its text.
    Null ids come last in a group. An empty table gives an empty one; long texts are taken whole.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        rows, nodes = grouped(docs, scratch, id_col, text_col, threshold, words)
        nodes = scratch.put(nodes, "told")
        groups = nodes.groupBy("root").agg(F.min("first").alias("one"))
        stays = nodes.join(groups, "root").select("node", F.struct("one.id", "one.h").alias("one"))
        mine = rows.where("node is not null").join(stays, "node").select("id", "h", F.struct("id", "h").eqNullSafe(F.col("one")).alias("stays"))
        marks = cut(mine.groupBy("id", "h").agg(F.max("stays").alias("stays"), F.count("*").alias("times")).where("not stays or times > 1").toDF("i", "k", "stays", "times"))
    finally:
        scratch.close()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))
    out = keyed.join(marks, same, "left_anti")
    again = marks.where("stays")
    if again.head(1):
        out = out.union(keyed.join(again, same, "left_semi").dropDuplicates(["id", "h"]))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
