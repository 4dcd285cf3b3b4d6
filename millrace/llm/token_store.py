"""Token ids in a binary store: one zstandard dictionary, one frame per document, an offset index.

File format (a folder of Parquet files, so any store that Spark writes to will do):

* ``dictionary``: one row with the dictionary bytes, its SHA-256 and the item type of the ids;
* ``parts``: (part, before): the ids of all parts before this one, a part being what one task wrote;
* ``blocks``: rows (part, block, part_start, dict_hash, first_id, last_id, doc_ids, n_tokens, offsets, payload).
  ``payload`` is the concatenation of one zstandard frame per document, ``offsets`` (one more than
  documents) says where each frame lies.  Documents ascend by doc_id within a block, blocks within
  a part and parts among each other.

A short document is read by pruning blocks on first_id/last_id and decompressing its frame alone.
The dictionary is trained on whole id arrays of a bounded sample (``sample_rows`` documents, by hash
of the id); everything else covers all rows.

Defined results: null text is empty (its ids are the end id alone); null ids come first and can be
told apart only by their place; rows that repeat an id are stored row by row, in the order they are
read; no id, however often it repeats, is bound to one task; an empty table gives a store with no
blocks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, record, scratch, shuffle_partitions, stored, texts_of
from .encoding import PieceEncoder, encoder, encoding

END_ID = 0
_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("dict_hash", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
_FRAMES = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
BLOCKS_DDL = "part int, block int, part_start long, dict_hash string, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
DOCS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _serialised(one: PieceEncoder, text: str) -> tuple[bytes, int]:
    width = int(one.item[-1])
    raw = one.encode(text) + END_ID.to_bytes(width, "little")
    return raw, len(raw) // width


def train_dictionary(docs: DataFrame, vocabulary: str, sample_rows: int = 1500, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary from the id arrays of about ``sample_rows`` documents (empty if they are too few)."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31))).limit(2 * sample_rows)

    def encode(batches):
        with encoding(vocabulary) as one:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"ids": [_serialised(one, t)[0] for t in batch.column("text").to_pylist()]}, schema=pa.schema([("ids", pa.binary())]))

    samples = sorted(bytes(r.ids) for r in drawn.mapInArrow(encode, "ids binary").toLocalIterator())
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressed(docs: DataFrame, vocabulary: str, trained: bytes, level: int) -> DataFrame:
    """(doc_id, place, n_tokens, frame): every document encoded and compressed where it is read, so only frames travel.
    ``place`` (task and row) tells rows that repeat an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=level)
        with encoding(vocabulary) as one:
            for batch in pieces(batches, 512):
                counts, frames = [], []
                for text in batch.column("text").to_pylist():
                    raw, n = _serialised(one, text)
                    counts.append(n)
                    frames.append(press.compress(raw))
                yield record({"doc_id": batch.column("doc_id"), "place": np.arange(place, place + len(counts)), "n_tokens": counts, "frame": frames}, _FRAMES)
                place += len(counts)

    return docs.mapInArrow(run, "doc_id long, place long, n_tokens long, frame binary")


def write_store(docs: DataFrame, path: str, vocabulary: str, sample_rows: int = 1500, block_rows: int = 512, block_bytes: int = 1 << 20, level: int = 3) -> None:
    """Encode every text of (doc_id, text) and write the store to ``path``."""
    spark = docs.sparkSession
    docs = texts_of(docs)
    trained = train_dictionary(docs, vocabulary, sample_rows)
    dict_hash = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(bytearray(trained), dict_hash, encoder(vocabulary).item)], "dictionary binary, dict_hash string, item string").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, begin = TaskContext.get().partitionId(), 0, 0
        for batch in pieces(batches, block_rows):
            ends = np.cumsum(pc.binary_length(batch.column("frame")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(ends, before + block_bytes, side="right")) - at)
                rows = batch.slice(at, n)
                ids, counts = rows.column("doc_id"), rows.column("n_tokens").to_pylist()
                known = ids.drop_null().to_pylist()
                row = [part, number, begin, dict_hash, min(known, default=None), max(known, default=None), ids.to_pylist(), counts, [0, *(ends[at : at + n] - before).tolist()], b"".join(rows.column("frame").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)
                at, number, begin = at + n, number + 1, begin + sum(counts)

    # Written first: range partitioning looks at its input twice.
    frames = stored(_compressed(docs, vocabulary, trained, level), "token-frames")
    ordered = frames.repartitionByRange(shuffle_partitions(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place")
    ordered.mapInArrow(blocks, BLOCKS_DDL).write.parquet(f"{path}/blocks")
    tokens = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per write task
    tokens.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/parts")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, str, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row.dictionary), row.dict_hash, row.item


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids of all documents before the block; there is one row of ``parts`` per write task."""
    blocks, parts = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/parts")
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before", "part_start", "n_tokens")


def _frames(batches: Iterator[pa.RecordBatch], trained: bytes, dict_hash: str):
    """Each block with one function per document that unpacks its ids."""
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdDecompressor()
    for batch in pieces(batches, 16):
        for row in range(batch.num_rows):
            block = {name: batch.column(name)[row].as_py() for name in batch.schema.names if name != "payload"}
            if block["dict_hash"] != dict_hash:
                raise ValueError(f"block {block['part']}/{block['block']} was written with another dictionary")
            payload = memoryview(batch.column("payload")[row].as_buffer())
            yield block, [lambda lo=lo, hi=hi, data=payload: unpress.decompress(data[lo:hi]) for lo, hi in zip(block["offsets"], block["offsets"][1:], strict=False)]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    trained, dict_hash, item = _opened(spark, path)

    def documents(batches):
        for block, frames in _frames(batches, trained, dict_hash):
            ids = [np.frombuffer(frame(), dtype=item).astype("<u4") for frame in frames]
            counts = np.array([len(x) for x in ids], dtype=np.int64)
            columns = [block["doc_ids"], block["start"] + np.cumsum(counts) - counts, counts, [zlib.crc32(x.tobytes()) for x in ids]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _DOCS, strict=True)], schema=_DOCS)

    return _placed(spark, path).mapInArrow(documents, DOCS_DDL)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a short list of documents: blocks are pruned by their id range, other frames stay packed."""
    trained, dict_hash, item = _opened(spark, path)
    wanted = set(doc_ids)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def documents(batches):
        for block, frames in _frames(batches, trained, dict_hash):
            found = [(i, np.frombuffer(frame(), dtype=item).astype(np.int64)) for i, frame in zip(block["doc_ids"], frames, strict=True) if i in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(schema)], schema=schema)

    near = _placed(spark, path).where(F.exists(F.array(*map(F.lit, sorted(wanted))), lambda x: (x >= F.col("first_id")) & (x <= F.col("last_id"))))
    return near.mapInArrow(documents, "doc_id long, ids array<long>")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
