"""Token counts by a compiled tokenizer that emits counts, never tokens.

Two transducers in series. The word splitter (pretokens) runs over chunks whose state maps compose by a
parallel prefix scan. The BPE transducer (bpe) reads the words' bytes, with every transition annotated with the change of the
number of canonical tokens. Every word enters it in its first state, so that words are chunks with constant maps: they need no
scan among themselves, run side by side, and a text's count is a difference of prefix sums over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quillstone.cluster import ship
from quillstone.llm import pretokens
from quillstone.llm.bpe import SLICE, TOKENIZER, MergeAutomaton, sent, transducer
from quillstone.llm.common import pieces

def count_texts(texts: list[str], auto: MergeAutomaton) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of tokens and of words."""
    stream, starts, ends, per = pretokens.spans(texts)
    sums = np.concatenate([[0], np.cumsum(transducer(auto).counts(stream, starts, ends))])
    at = np.cumsum(per)
    return sums[at] - sums[at - per], per


def length(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> Column:
    """Each text's number of tokens as a column of docs, 0 for null."""
    ship(docs.sparkSession)
    compiled = sent(docs, tokenizer)

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = ["" if t is None else t for t in texts]
            part = np.cumsum([len(t) for t in given]) // SLICE if given else np.zeros(0, np.int64)
            made = [count_texts([given[i] for i in np.flatnonzero(part == k)], compiled.value)[0] for k in np.unique(part)]
            yield pd.Series(np.concatenate(made) if made else [], dtype="int32")

    return counted(F.col(f"`{text_col}`").cast("string"))


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_tokens (BPE tokens), n_words (pieces of the splitter) and n_bytes (UTF-8).

    Null text: all three are null. Empty text: all three are 0. Repeated rows and null ids are kept as they
    are; other columns are ignored. No shuffle: one pass in Arrow batches, of which only counts come back.
    """
    ship(docs.sparkSession)
    compiled = sent(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=SLICE):
            given = batch.column(1).to_pylist()
            absent = np.array([t is None for t in given])
            tokens, words = count_texts([t or "" for t in given], compiled.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, mask=absent, type=pa.int64()), pa.array(words, mask=absent, type=pa.int64()), batch.column(2)], ["id", "n_tokens", "n_words", "n_bytes"])

    text = F.col(f"`{text_col}`").cast("string")
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.octet_length(text).alias("n_bytes"))
    schema = StructType().add("id", docs.schema[id_col].dataType).add("n_tokens", LongType()).add("n_words", LongType()).add("n_bytes", IntegerType())
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
