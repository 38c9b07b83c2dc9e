"""Operator 10: byte-level BPE encoding and decoding of a text column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from concord.llm import byte_bpe
from concord.llm.kernels import slices
from concord.session import table


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, to: str = "ids") -> DataFrame:
    """Add column ``to`` (array<int>): the ids of the whole ``text`` (null or empty: an empty array).

    Other columns pass through, whatever their names; a column already named ``to`` is replaced.
    """
    given = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(*given)
        for whole in batches:
            for part in slices(whole, text, byte_bpe.RUN_BYTES):
                ids, begin = bpe.encode(part.column(part.schema.get_field_index(text)))
                made = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.astype(np.int32)))
                keep = [n for n in part.schema.names if n != to]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in keep), made], names=[*keep, to])

    schema = T.StructType([*(f for f in df.schema.fields if f.name != to), T.StructField(to, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None, to: str = "decoded") -> DataFrame:
    """Add column ``to`` (binary): the bytes of array column ``ids`` (null: empty)."""
    given = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(*given)
        for part in batches:
            column = part.column(part.schema.get_field_index(ids))
            made = pa.array([bpe.decode(np.asarray(x.values, dtype=np.int64)) if x.is_valid and len(x.values) else b"" for x in column], pa.binary())
            keep = [n for n in part.schema.names if n != to]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in keep), made], names=[*keep, to])

    schema = T.StructType([*(f for f in df.schema.fields if f.name != to), T.StructField(to, T.BinaryType())])
    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode each whole text, decode the ids again and return digests of both, without shipping the ids."""
    given = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(*given)
        decimal = np.array([str(i) for i in range(len(bpe.sizes))], dtype=object)
        for whole in batches:
            for part in slices(whole, text, byte_bpe.RUN_BYTES):
                ids, begin = bpe.encode(part.column(1))
                counts, listed, decoded = np.diff(begin), [], []
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    own = ids[a:b]
                    listed.append(hashlib.sha256(" ".join(decimal[own].tolist()).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(key, text).mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return round_trip(table(spark, sf_dir, "documents"))
