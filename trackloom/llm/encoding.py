"""Encoding and decoding of whole corpora.

Defined results: null and empty texts have an empty list of ids (zero tokens), null lists of ids decode to null; ids
that the vocabulary doesn't have raise an error; texts are encoded whole whatever their length, without special tokens;
repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trackloom.llm.bpe import BYTE_BPE, TOKENIZERS, decode, token_bytes, transducer
from trackloom.operators.frames import need


def _with(df: DataFrame, key: str, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([df.schema[key], T.StructField(name, kind)])


def shipped_vocabulary(spark: SparkSession, tokenizers: str, vocabulary: str) -> str:
    """Send the vocabulary file to all executors; its name there."""
    spark.sparkContext.addFile(f"{tokenizers}/{vocabulary}")
    return vocabulary


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``key`` and ``ids``, the ids of each text."""
    need(df, [key, text])
    name = shipped_vocabulary(df.sparkSession, tokenizers, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(SparkFiles.get(name))
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for value in batch.column(1):
                flat.extend(machine.encode(value.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.array([], dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, _with(df, key, "ids", T.ArrayType(T.IntegerType())))


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the size of each text in tokens."""
    need(df, [*keep, text])
    name, n = shipped_vocabulary(df.sparkSession, tokenizers, vocabulary), len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(SparkFiles.get(name))
        for batch in batches:
            sizes = pa.array([machine.count(v.as_py()) for v in batch.column(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], sizes], names=[*keep, "n_tokens"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])
    return df.select(*keep, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizers: str = TOKENIZERS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``key`` and ``text``, the text of each list of ids."""
    need(df, [key, ids])
    name = shipped_vocabulary(df.sparkSession, tokenizers, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(SparkFiles.get(name))
        for batch in batches:
            texts = [None if v is None else "".join(decode(v, tokens)) for v in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, _with(df, key, "text", T.StringType()))
