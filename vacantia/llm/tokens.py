"""Problem 6: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.merges import Transducer, decode, load_ranks, sufficient_lookahead
from vacantia.runtime import table

#: Where the public vocabularies lie on every machine of the cluster.
VOCABULARIES = "/opt/tokenizers"


@lru_cache(maxsize=4)
def _lookahead(path: str) -> int:
    return sufficient_lookahead(load_ranks(path))


@lru_cache(maxsize=2)
def transducer(path: str, lookahead: int) -> Transducer:
    """One transducer for each worker process."""
    return Transducer(load_ranks(path), lookahead)


@lru_cache(maxsize=2)
def _words(path: str) -> dict[int, bytes]:
    return {i: w for w, i in load_ranks(path).items()}


def encode(df: DataFrame, key: str, text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids): the ids of each text as it is, without special tokens; one row for each row of `df`.

    A null and an empty text give an empty list; blank texts are encoded like any other. Repeated rows stay repeated,
    null keys stay null. Nothing is shuffled; a text of any length is read in chunks.
    """
    look = _lookahead(vocabulary)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(vocabulary, look)
        for batch in batches:
            ids = [coder.encode(t) if t else () for t in batch.column(1).to_pylist()]
            offsets = pa.array([0, *accumulate(map(len, ids))], pa.int32())
            flat = pa.array([i for x in ids for i in x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "ids"])

    shape = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text)).mapInArrow(run, shape)


def lengths(df: DataFrame, keep: list[str], text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(*keep, tokens): the number of ids of each text; 0 for a null or empty one."""
    look = _lookahead(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(vocabulary, look)
        for batch in batches:
            n = [len(coder.encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    shape = T.StructType([*[df.schema[k] for k in keep], T.StructField("tokens", T.LongType())])
    return df.select(*keep, text).mapInArrow(run, shape)


def decoded(df: DataFrame, key: str, ids: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, text): the text of each list of ids; an empty text for an empty list, null for a null one."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary)
        for batch in batches:
            texts = [None if x is None else "".join(decode(x, words)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    shape = T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType())])
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, shape)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode(table(spark, folder, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_chars): code points of each document's text after encoding and decoding; the SQL counts the original."""
    return decoded(p6_ids(spark, folder), "doc_id", "ids").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip}
ORACLES = {"p6_roundtrip": "select doc_id, length(coalesce(text, '')) as n_chars, md5(coalesce(text, '')) as digest from documents"}
