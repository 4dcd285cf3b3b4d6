"""Vector functions: dense expressions, sparse hashed vectors, dense hashed vectors by Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SETTINGS
from .text import features_of, tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """NaN where a vector is zero; NaN sorts last."""
    return F.coalesce(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(float("nan")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column) -> Column:
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero; what a negative number is rounded to keeps its sign, a zero too, as in DuckDB."""
    return F.signum(x) * F.round(F.abs(x), digits)


def squared_norms(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2"))


#: Digests of a feature, of which the first 8 bytes count, big-endian.
DIGESTS = {"md5": lambda b: hashlib.md5(b).digest()[:8], "blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest()}


def term_counts(features: pa.ListArray, dimension: int, digest: str) -> np.ndarray:
    """Signed counts by bucket, a row for each list of features; each distinct feature is hashed once."""
    found = features.flatten().dictionary_encode()
    hashes = np.frombuffer(b"".join(DIGESTS[digest](f.encode()) for f in found.dictionary.to_pylist()), dtype=">u8").astype(np.uint64)[found.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(features)), pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False))
    at = row * dimension + (hashes % np.uint64(dimension)).astype(np.int64)
    return np.bincount(at, weights=np.where(hashes & np.uint64(1), 1.0, -1.0), minlength=len(features) * dimension).astype(float).reshape(len(features), dimension)


def with_features(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit("")))).withColumn(name, features_of(F.col("_words"))).drop("_words")


def postings(df: DataFrame, key: str, text: str, dimension: int = SETTINGS.dimension, rows: int = 256) -> DataFrame:
    """Sparse hashed vectors: (key, bucket, weight).  A feature's 64-bit digest picks the bucket, its parity the sign.

    Every row of ``df`` is folded where it is read, each feature hashed once a batch; nothing is shuffled.
    """
    schema = T.StructType([df.select(key).schema[0], T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.LongType())])

    def fold(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                counts = term_counts(part.column("features"), dimension, "md5")
                row, bucket = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(counts[row, bucket].astype(np.int64))], names=schema.names)

    return with_features(df.select(key, text), text, "features").drop(text).mapInArrow(fold, schema)


def with_vectors(df: DataFrame, text: str = "content", dimension: int = SETTINGS.dimension, digest: str = "blake2b", rows: int = 256) -> DataFrame:
    """``df`` with embedding array<float>, the unit vector of hashed terms; no term gives the zero vector."""
    schema, columns = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]), df.columns

    def embed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = term_counts(part.column("_features"), dimension, digest)
                lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
                np.divide(out, lengths, out=out, where=lengths > 0)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimension), pa.int32()), pa.array(out.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), values], names=[*columns, "embedding"])

    return with_features(df, text, "_features").mapInArrow(embed, schema)


def hashed_dense(df: DataFrame, key: str, text: str, dimension: int = SETTINGS.dimension) -> DataFrame:
    """(key, embedding array<float>) by 8-byte BLAKE2b digests."""
    return with_vectors(df.select(key, text), text, dimension).select(key, "embedding")
