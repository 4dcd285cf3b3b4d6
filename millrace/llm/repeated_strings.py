"""Removal of bytes covered by repeated 200-byte strings, by distributed prefix doubling over sampled positions.

Positions are ranked by growing strings of bytes around them; they leave when their rank is unique, or
when all they stand for is known to repeat past the threshold, and only the others are ranked again.
Ranking every byte position would write tens of times the input, so ranks are kept for sampled
positions (anchors) only:

1. Every string of ``length`` bytes has an anchor: its leftmost least-hashed ``gram``-byte substring.
   Equal strings have equal anchors at equal offsets, so a string whose anchor's gram is unique is
   unique.  Consecutive strings of a document with one anchor are one row, whose context is all
   their bytes, up to 2 * length - gram.
2. First round: Spark counts rank pairs (gram, context).  A unique gram leaves; a context that repeats
   settles all strings of its rows, one of which goes on as a witness for other contexts; so do the
   rows of all other contexts, which lie at the ends of repeats.
3. Later rounds: a row is cut into runs of 32, then 8, then single offsets of the anchor in a string
   (``NODES``).  The bytes that all strings of a run share grow from the gram's 64 to 169, 193 and 200;
   their rank and the rank of the run's own context are the next pair, and the same rule holds.  At
   single offsets both are the string itself.
4. Spans of repeated strings are joined to the documents and cut out.

A rank is the 64-bit hash of the bytes ranked, so that no sort has to give it out; results are exact
up to collisions of these.  No unit of rows is ever gathered: counts are combined before the shuffle
and joined back.  Texts are UTF-8 bytes, whole; strings never cross documents.

Defined results: null text is empty; a text shorter than ``length`` loses nothing; rows are told apart
by id and a 64-bit hash of the text, so repeated and null ids keep their own results; rows that repeat
an id and its text are copies of each other like any others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, pieces, record, stored, texts_of
from .textkernel import _BYTE_VALUES, batch_blocks, mix64, powers

LENGTH, GRAM = 200, 64
#: Offsets of the anchor that are ranked together, round by round.
NODES = (32, 8, 1)
_PLACE_BITS = 26
_SPAN_BITS = 9


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt) -> np.ndarray:
    return mix64((sums[ends] - sums[starts]) * down[starts] + salt)


def _tag(text: bytes) -> int:
    """Tells rows with one id and different texts apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of one block: row, anchor, first and last start of the strings it is the anchor of, gram hash, context hash."""
    window, n = length - gram + 1, len(data)
    empty = np.zeros(0, dtype=np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums, down = _prefix_sums(data)
    grams = np.arange(n - gram + 1)
    hashes = _hash(sums, down, grams, grams + gram, np.uint64(gram))
    least = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | grams.astype(np.uint64)
    step = 1
    while 2 * step <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if window > step:
        least = np.minimum(least[: len(least) - (window - step)], least[window - step :])
    anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    start = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[row + 1])
    if not len(start):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    heads = np.flatnonzero(np.r_[True, (anchor[start][1:] != anchor[start][:-1]) | (np.diff(start) != 1)])
    first, last = start[heads], start[np.r_[heads[1:] - 1, len(start) - 1]]
    at = anchor[first]
    shape = ((at - first) * (2 * length) + (last - first)).astype(np.uint64) + np.uint64(1)
    return row[first], at, first, last, hashes[at], _hash(sums, down, first, last + length, shape)


def _chunks(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows, and pieces of very long rows that overlap by length - 1 bytes: (first row, place in it, bytes, offsets)."""
    for first, _, data, offsets in batch_blocks(texts):
        if len(offsets) > 2 or len(data) < 1 << 23:
            yield first, 0, data, offsets
            continue
        step = 1 << 22
        for at in range(0, max(1, len(data) - length + 1), step):
            part = data[at : at + step + length - 1]
            yield first, at, part, np.array([0, len(part)])


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, context, doc_id, tag, place): one row per anchor; place packs first start, anchor and last start."""
    schema = pa.schema([(c, pa.int64()) for c in ("gram", "context", "doc_id", "tag", "place")])

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            tags = np.array([_tag((t or "").encode()) for t in texts.to_pylist()], dtype=np.int64)
            for first, at, data, offsets in _chunks(texts, length):
                row, anchor, begin, end, grams, contexts = anchors_of(data, offsets, length, gram)
                base = offsets[row] - at
                place = ((begin - base) << _SPAN_BITS | (anchor - begin)) << _SPAN_BITS | (end - begin)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(contexts.view(np.int64)), ids.take(pa.array(first + row)), pa.array(tags[first + row]), pa.array(place)], schema=schema)

    return docs.mapInArrow(run, "gram long, context long, doc_id long, tag long, place long")


def _unpacked(df: DataFrame) -> DataFrame:
    """``place`` as first, ahead (anchor less first) and more (last start less first)."""
    mask = F.lit((1 << _SPAN_BITS) - 1)
    columns = {"first": F.shiftright("place", 2 * _SPAN_BITS), "ahead": F.shiftright("place", _SPAN_BITS).bitwiseAND(mask).cast("int"), "more": F.col("place").bitwiseAND(mask).cast("int")}
    return df.withColumns(columns).drop("place")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, body): whole texts, each compressed for its way through a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("body", pa.binary())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, 1024):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield record({"doc_id": batch.column("doc_id"), "tag": [_tag(t) for t in texts], "body": [press.compress(t) for t in texts]}, schema)

    return docs.mapInArrow(run, "doc_id long, tag long, body binary")


def _with_texts(packed: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """``packed`` with what ``lists`` (one row per doc_id and tag) holds for its rows."""
    keyed = lists.withColumnRenamed("doc_id", "_id").withColumnRenamed("tag", "_tag").hint("shuffle_hash")
    return packed.join(keyed, packed["doc_id"].eqNullSafe(F.col("_id")) & (packed["tag"] == F.col("_tag")), how).drop("_id", "_tag")


def _contexts(packed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(row, doc_id, tag, first, ahead, more, bytes) of the anchors' rows that are ranked again, numbered."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("ahead", pa.int32()), ("more", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        unpress, number = zstandard.ZstdDecompressor(), TaskContext.get().partitionId() << 40
        for batch in pieces(batches, 512):
            rows = [[] for _ in schema]
            for doc_id, tag, body, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "body", "places")), strict=True):
                text = unpress.decompress(body)
                for place in places:
                    begin, more = place["first"], place["more"]
                    for column, value in zip(rows, (number, doc_id, tag, begin, place["ahead"], more, text[begin : begin + more + length]), strict=True):
                        column.append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "ahead", "more")).alias("places"))  # at most a document's anchors
    # Rows that repeat an id and its text come once each: they repeat one another, and so they count.
    return _with_texts(packed, lists).mapInArrow(run, "row long, doc_id long, tag long, first long, ahead int, more int, bytes binary")


def _nodes(rows: DataFrame, size: int, parent: int, length: int) -> DataFrame:
    """(core, context, row, node): rank pairs of the runs of ``size`` offsets in the runs of ``parent`` offsets that
    the bits of column ``live`` name."""
    schema = pa.schema([("core", pa.int64()), ("context", pa.int64()), ("row", pa.int64()), ("node", pa.int32())])

    def run(batches):
        for batch in batches:
            number, ahead, more, live = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "ahead", "more", "live"))
            if not len(number):
                continue
            for first, end, data, offsets in batch_blocks(batch.column("bytes")):
                sums, down = _prefix_sums(data)
                low, high = (ahead - more)[first:end] // size, ahead[first:end] // size
                counts = high - low + 1
                which = np.repeat(np.arange(end - first), counts)
                node = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts - low, counts)
                keep = live[first:end][which] >> (node * size // parent) & 1 > 0
                which, node = which[keep], node[keep]
                anchor, at = offsets[which] + ahead[first:end][which], node * size
                top, bottom = np.minimum(ahead[first:end][which], at + size - 1), np.maximum((ahead - more)[first:end][which], at)
                salt = (node + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                core = _hash(sums, down, anchor - at, anchor - at - size + 1 + length, salt)
                shape = salt + ((top - at) * length + (bottom - at) + 1).astype(np.uint64)
                context = _hash(sums, down, anchor - top, anchor - bottom + length, shape)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), pa.array(number[first:end][which]), pa.array(node.astype(np.int32))], schema=schema)

    return rows.select("row", "ahead", "more", "live", "bytes").mapInArrow(run, "core long, context long, row long, node int")


def _reranked(nodes: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(row, node) of runs whose strings all repeat, and of those that are to be ranked again (none after the last round)."""
    cores = nodes.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1").select("core", (F.col("a") == F.col("b")).alias("alike"))
    if last:
        return nodes.join(cores.select("core"), "core", "left_semi").select("row", "node"), None
    again = stored(nodes.join(cores, "core"), "repeat-again")
    mixed = again.where("not alike")
    pairs = mixed.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("witness")).where("n > 1").select(F.col("core").alias("_core"), F.col("context").alias("_context"), "witness")
    judged = mixed.join(pairs, (F.col("core") == F.col("_core")) & (F.col("context") == F.col("_context")), "left")
    judged = stored(judged.select("row", "node", "witness"), "repeat-judged")
    settled = again.where("alike").select("row", "node").union(judged.where("witness is not null").select("row", "node"))
    return settled, judged.where("witness is null or witness = row").select("row", "node")


def _settled(rows: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, tag, first, end) of repeated strings in the ``rows`` of _contexts, a stored table."""
    live, parent, out = rows.withColumn("live", F.lit(-1).cast("long")), NODES[0], None
    narrow = rows.select(F.col("row").alias("_row"), "doc_id", "tag", "first", "ahead", "more")
    for size in NODES:
        nodes = stored(_nodes(live, size, parent, length), "repeat-nodes")
        done, again = _reranked(nodes, size == NODES[-1])
        runs = done.withColumn("size", F.lit(size))
        out = runs if out is None else out.union(runs)
        if again is not None:
            masks = again.groupBy(F.col("row").alias("_row")).agg(F.bit_or(F.expr("shiftleft(1L, node)")).alias("live"))
            live, parent = rows.join(masks, F.col("row") == F.col("_row")).drop("_row"), size
    spans = out.join(narrow, F.col("row") == F.col("_row"))
    high = F.least(F.col("ahead"), F.col("node") * F.col("size") + F.col("size") - 1)
    low = F.greatest(F.col("ahead") - F.col("more"), F.col("node") * F.col("size"))
    return spans.select("doc_id", "tag", (F.col("first") + F.col("ahead") - high).alias("first"), (F.col("first") + F.col("ahead") - low + length).alias("end"))


def _cut(packed: DataFrame, spans: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in pieces(batches, 512):
            rows = [[] for _ in schema]
            for doc_id, body, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "spans")), strict=True):
                text, kept, at, runs, gone = unpress.decompress(body), [], 0, 0, 0
                end = -1
                for span in sorted((s["first"], s["end"]) for s in found or ()):
                    if span[0] > end:  # a new maximal run
                        runs += 1
                        kept.append(text[at : span[0]])
                        begin = span[0]
                    else:
                        begin = end
                    if span[1] > end:
                        gone += span[1] - begin
                        end = at = span[1]
                kept.append(text[at:])
                for column, value in zip(rows, (doc_id, len(text), gone, runs, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    lists = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "end")).alias("spans"))  # at most a document's spans
    return _with_texts(packed, lists, "left").select("doc_id", "body", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    docs = texts_of(docs)
    ranked = stored(anchors(docs, length, gram), "repeat-anchors")
    classes = ranked.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"))
    per_gram = classes.groupBy("gram").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contexts")).where("rows > 1").drop("rows")
    classes = stored(classes.join(per_gram, "gram").where("n > 1 or contexts > 1"), "repeat-classes")
    found = stored(ranked.join(classes, ["gram", "context"]).select("gram", "context", "doc_id", "tag", "place", "n", "contexts"), "repeat-rows")
    dropped(ranked)
    sure = _unpacked(found.where("n > 1")).select("doc_id", "tag", "first", (F.col("first") + F.col("more") + length).alias("end"))
    open_rows = found.where("n = 1").select("doc_id", "tag", "place")
    witnesses = found.where("n > 1 and contexts > 1").groupBy("gram", "context").agg(F.min(F.struct("doc_id", "tag", "place")).alias("r")).select("r.*")
    packed = _packed(docs)
    rows = stored(_contexts(packed, _unpacked(open_rows.unionByName(witnesses)), length), "repeat-contexts")
    late = _settled(rows, length)
    return _cut(packed, sure.union(late))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
