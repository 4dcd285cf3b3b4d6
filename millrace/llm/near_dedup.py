"""MinHash near-deduplication with sequential Bayesian verification.

1. ``features``: the set of word shingles of a document as 64-bit hashes, a signature of
   ``bands * rows`` minima and two hashes of the whole set, one pass over the texts.
2. Documents with equal sets collapse to the one with the smallest id; only these go on.
3. ``candidate_groups``: documents that share a band meet: each with central documents of its bands
   first, then those that this left outside with all others of their family with which they share
   one of their rarest shingles, as every pair similar enough does.
4. ``_verified``: signature batches of a pair are compared one after another; the pair goes when the
   posterior probability (uniform prior) that its similarity reaches the threshold falls under
   ``miss``.  Survivors are verified on their full sets.
5. Connected components of the confirmed links give the groups.

A pair at the threshold shares no band with probability (1 - s**rows)**bands; there are as many bands
as it takes for 1e-8: 32 for 0.85, 47 for 0.8.  ``miss`` bounds what the pruning loses for each batch.

Defined results: null text is empty; a document without words has no shingles and is linked with
nothing; a null id is never linked and is its own component (null); rows that repeat an id are
one document whose rows share a component (if texts differ, any of them links); an empty table gives an empty result; other
columns are ignored by :func:`near_groups`, carried by :func:`drop_near_copies`.
"""

from __future__ import annotations

from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed, pieces, small_batches, stored, texts_of
from .components import components
from .sieve import Sieve, parted
from .textkernel import WORD_BLOCK_BYTES, batch_blocks, find_words, hash_spans, mix64, shingle_hashes

_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])
#: Rows of texts, signatures or sets that a task works on at once.
BATCH_ROWS = 512
#: log2 of the slots in which shingles of the last step's documents are counted: 4 MB.
SLOT_BITS = 20
FEATURES_DDL = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def shingle_sets(texts: pa.Array, size: int):
    """Row by row: the sorted distinct shingle hashes."""
    for first, end, data, offsets in batch_blocks(texts, WORD_BLOCK_BYTES):
        starts, ends, rows = find_words(data, offsets)
        shingles, rows, _ = shingle_hashes(hash_spans(data, starts, ends), rows, size)
        bounds = np.searchsorted(rows, np.arange(end - first + 1))
        for r in range(end - first):
            yield np.unique(shingles[bounds[r] : bounds[r + 1]])


def _multipliers(n: int) -> np.ndarray:
    return (np.random.default_rng(4242).integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def _signature(shingles: np.ndarray, multipliers: np.ndarray) -> bytes:
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), np.uint32(0xFFFFFFFF))
    for at in range(0, len(high), 512):  # stays in the cache
        np.minimum(least, (multipliers * high[at : at + 512]).min(axis=1), out=least)
    return least.tobytes()


def features(docs: DataFrame, size: int, hashes: int) -> DataFrame:
    def extract(batches):
        multipliers = _multipliers(hashes)
        for batch in pieces(batches, BATCH_ROWS):
            counts, a, b, signatures = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), size):
                counts.append(len(shingles))
                a.append(int((shingles.sum(dtype=np.uint64) + np.uint64(len(shingles))).view(np.int64)))
                b.append(int(np.bitwise_xor.reduce(mix64(shingles.copy())).view(np.int64)) if len(shingles) else 0)
                signatures.append(_signature(shingles, multipliers) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip((counts, a, b, signatures), list(_FEATURES)[1:], strict=True))], schema=_FEATURES)

    return docs.mapInArrow(extract, FEATURES_DDL)


def _buckets(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node): a document once for each band."""
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])

    def split(batches):
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, bands, rows).astype(np.uint64)
            key = np.tile(salt, (batch.num_rows, 1))
            for r in range(rows):
                key = mix64((key ^ minima[:, :, r]) * np.uint64(0x9E3779B97F4A7C15))
            nodes = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(nodes)], schema=schema)

    return signed.select("doc_id", "signature").mapInArrow(split, "bucket long, node long")


def least_matches(hashes: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """After n compared minima, the fewest matches at which P(similarity >= percent/100) is still ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper tail at t is the
    probability of at most m successes in n + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _loaded(docs: DataFrame, nodes: Sieve, size: int, hashes: int) -> DataFrame:
    """(node, signature, shingles) of the documents that ``nodes`` lets pass."""
    schema = pa.schema([("node", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])

    def attach(batches):
        multipliers = _multipliers(hashes)
        for batch in pieces(batches, BATCH_ROWS):
            batch = batch.filter(pa.array(nodes.rows(batch.column("doc_id"))))
            sets = list(shingle_sets(batch.column("text"), size))
            made = [pa.array([_signature(s, multipliers) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=schema).filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return docs.mapInArrow(attach, "node long, signature binary, shingles binary")


def alike(signatures: np.ndarray, head: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows of ``signatures`` that the posterior bound leaves after each batch of minima compared with ``head``."""
    left, done = np.arange(len(signatures)), 0
    matches = np.zeros(len(left), dtype=np.int64)
    for compared, needed in steps:
        matches += (signatures[left, done:compared] == head[done:compared]).sum(axis=1)
        keep, done = matches >= needed, compared
        left, matches = left[keep], matches[keep]
        if not len(left):
            break
    return left


def _verified(units: DataFrame, loaded: DataFrame, percent: int, miss: float, hashes: int) -> DataFrame:
    """Links (u, v) whose sets are similar enough, between the heads (side 0) and the members (side 1) that ``units``
    (unit, side, node, component; a stored table) puts together, but for those of one component.  A task holds the heads of one unit
    and a batch of members at a time."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(batches):
        steps, unit = least_matches(hashes, 32, percent, miss), None
        heads: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for batch in pieces(batches, BATCH_ROWS):
            keys, sides, nodes, groups = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "side", "node", "component"))
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("shingles")]
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, hashes)
            sizes = np.array([len(x) for x in sets])
            links = []
            for run in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(keys) else ():
                if keys[run[0]] != unit:
                    unit, heads = keys[run[0]], []
                heads += [(int(nodes[i]), int(groups[i]), signatures[i].copy(), sets[i].copy()) for i in run[sides[run] == 0]]
                mine = run[sides[run] == 1]
                for head, group, signature, shingles in heads:
                    near = mine[(groups[mine] != group) & (100 * np.minimum(sizes[mine], len(shingles)) >= percent * np.maximum(sizes[mine], len(shingles)))]
                    for i in near[alike(signatures[near], signature, steps)]:
                        both = np.intersect1d(shingles, sets[i], assume_unique=True).size
                        if 100 * both >= percent * (len(shingles) + sizes[i] - both):
                            links.append((head, int(nodes[i])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], schema=schema)

    near = Sieve(units, "node")

    def needed(batches):
        for batch in batches:
            yield batch.filter(pa.array(near.rows(batch.column("node"))))

    work = units.join(loaded.mapInArrow(needed, loaded.schema), "node").select("unit", "side", "node", "component", "signature", "shingles")
    return work.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(verify, "u long, v long")


def _pair_units(pairs: DataFrame, block: int) -> DataFrame:
    """Units for pairs (u, v) of different components: about ``block`` partners of one u behind a copy of it."""
    parts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    unit = F.xxhash64("u", "part").alias("unit")
    members = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select(unit, F.lit(1).alias("side"), F.col("v").alias("node"), F.lit(-1).cast("long").alias("component"))
    heads = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(unit, F.lit(0).alias("side"), F.col("u").alias("node"), F.lit(-2).cast("long").alias("component"))
    return members.unionByName(heads)


def _families(mixed: DataFrame) -> DataFrame:
    """(node, family, component): what the buckets of ``mixed`` (bucket, node, component) connect."""
    least = mixed.groupBy("bucket").agg(F.min("node").alias("v"))
    families = components(mixed.join(least, "bucket").select(F.col("node").alias("u"), "v")).withColumnRenamed("component", "family")
    families = families.union(families.select(F.col("family").alias("node"), "family").distinct())
    return stored(families.join(mixed.select("node", "component").distinct(), "node"), "minhash-families")


def _rarest(loaded: DataFrame, percent: int) -> DataFrame:
    """(node, shingle): of each of n shingles the n - ceil(percent * n / 100) + 1 rarest.

    Two sets whose similarity reaches ``percent`` share at least ceil(percent * n / 100) shingles, so one of these,
    whatever the order, if it is one for all.  Here it goes by how often the shingle's slot was seen, then by hash:
    what a template gives to all its documents comes last.  The table of slots has a fixed size.
    """

    def tally(batches):
        seen = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in pieces(batches, 512):
            flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), dtype=np.uint64)
            seen += np.bincount((flat >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(seen))
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(seen[slots])], names=["slot", "n"])

    found = loaded.mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2**SLOT_BITS rows
    seen = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
    seen[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 0xFFFFFFFF)

    def pick(batches):
        for batch in pieces(batches, 512):
            chosen = []
            for raw in batch.column("shingles"):
                shingles = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                order = np.argsort(seen[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")
                chosen.append(shingles[order[: len(shingles) + percent * -len(shingles) // 100 + 1]])
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), [len(x) for x in chosen])
            values = np.concatenate(chosen).view(np.int64) if chosen else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values)], names=["node", "shingle"])

    return loaded.mapInArrow(pick, "node long, shingle long")


def _rare_meetings(mixed: DataFrame, loaded: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, component): documents of a family that share one of their rarest shingles, those of several components."""
    known = _families(mixed)
    near = Sieve(known, "node")

    def needed(batches):
        for batch in batches:
            yield batch.filter(pa.array(near.rows(batch.column("node")))).select(["node", "shingles"])

    rare = _rarest(loaded.mapInArrow(needed, "node long, shingles binary"), percent)
    entries = rare.join(known, "node").select(F.xxhash64("family", "shingle").alias("bucket"), "node", "component")
    return stored(_repeated(entries, "component"), "minhash-rare")


def _rest_units(mixed: DataFrame, block: int) -> DataFrame:
    """Units in which the documents outside the largest component of a family meet all of the family.

    With o such documents among n, a family makes 2 * o * n / block rows.
    """
    known = _families(mixed)
    sizes = known.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).select(
        "family", F.col("most.component").alias("_largest"), F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("outer"), F.ceil(F.col("n") / block).cast("int").alias("inner")
    )
    dealt = known.join(largest, "family")
    part = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    unit = lambda i, j: F.xxhash64("family", i, j).alias("unit")
    heads = dealt.where("component <> _largest").select("*", part("outer").alias("i"), F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("j")).select(unit("i", "j"), F.lit(0).alias("side"), "node", "component")
    members = dealt.select("*", part("inner").alias("j"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i")).select(unit("i", "j"), F.lit(1).alias("side"), "node", "component")
    return heads.unionByName(members)


def _repeated(live: DataFrame, by: str) -> DataFrame:
    """The rows of buckets with two values or more of column ``by``."""
    live = live.repartition("bucket")
    several = live.groupBy("bucket").agg(F.min(by).alias("a"), F.max(by).alias("b")).where("a <> b").select("bucket")
    return live.join(several, "bucket", "left_semi")


def _mixed(live: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, node, score, component) of the buckets that hold several components."""
    return stored(_repeated(live.join(groups, "node", "left").select("bucket", "node", "score", F.coalesce("component", "node").alias("component")), "component"), "minhash-live")


def _central(bands: DataFrame) -> DataFrame:
    """(bucket, node, score) with the number of nodes in all buckets of the node: documents in the middle of a family
    share most bands with the others."""
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    scores = bands.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("score"))
    return stored(bands.join(scores, "node").select("bucket", "node", "score"), "minhash-live")


def _central_pairs(mixed: DataFrame, met: DataFrame | None) -> DataFrame:
    """(u, v): every node with the most central node of another component in its buckets, those in ``met`` (u) left out."""
    fresh = mixed if met is None else mixed.join(met.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    best = fresh.groupBy("bucket", "component").agg(F.max(F.struct("score", F.negative("node").alias("less"))).alias("best"))
    two = best.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("best")))).where("nth <= 2")
    two = two.groupBy("bucket").agg(F.max(F.when(F.col("nth") == 1, F.struct("component", "best"))).alias("one"), F.max(F.when(F.col("nth") == 2, F.col("best"))).alias("other"))
    chosen = mixed.join(two, "bucket").groupBy("node").agg(F.max(F.when(F.col("one.component") != F.col("component"), F.col("one.best")).otherwise(F.col("other"))).alias("best"))
    return chosen.where("best is not null").select((-F.col("best.less")).alias("u"), F.col("node").alias("v"))


def candidate_groups(bands: DataFrame, loaded: DataFrame, percent: int, miss: float, hashes: int, block: int = 512, report: list[int] | None = None) -> DataFrame:
    """(node, component) over all confirmed links between nodes that share a bucket of ``bands`` (bucket, node).

    Twice every node meets the most central node of another component in its buckets, which unites most of a family
    of copies at the cost of its size.  Buckets that still hold several components then make families, and those of a
    family's documents that share rare shingles smaller ones, in which the documents outside the largest component meet
    all others.  ``report`` gets the rows of each of the three steps.
    """
    links, pairs = None, None
    mixed = _central(bands).withColumn("component", F.col("node"))
    for step in range(3):
        if step < 2:
            pairs = stored(_central_pairs(mixed, pairs), "minhash-pairs")
        units = stored(_pair_units(pairs, block) if step < 2 else _rest_units(mixed, block), "minhash-units")
        if report is not None:
            report.append(units.count())
        found = _verified(units, loaded, percent, miss, hashes)
        links = stored(found if links is None else links.unionByName(found), "minhash-links")
        groups = components(links)
        freed(bands.sparkSession)
        if step == 2:
            return groups
        mixed = _mixed(mixed.drop("component"), groups)
        if step == 1 and not mixed.isEmpty():
            mixed = _rare_meetings(mixed, loaded, percent)
        if mixed.isEmpty():
            return groups


def bands_for(percent: int, rows: int, miss: float = 1e-8) -> int:
    """The fewest bands that a pair at the threshold misses all of with a probability of ``miss`` at most."""
    return ceil(log(miss) / log1p(-((percent / 100) ** rows)))


def near_groups(docs: DataFrame, percent: int = 80, size: int = 5, rows: int = 5, miss: float = 1e-7, **options) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their shingle sets.
    """
    with small_batches(docs.sparkSession):
        return _near_groups(docs, percent, size, rows, miss, **options)


def _near_groups(docs: DataFrame, percent: int, size: int, rows: int, miss: float, **options) -> DataFrame:
    bands = bands_for(percent, rows)
    docs, hashes = texts_of(docs), bands * rows
    found = stored(features(docs, size, hashes), "minhash-features")
    sets = stored(found.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node")), "minhash-sets")
    signed = found.join(sets.select(F.col("node").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"])
    shared = stored(_repeated(_buckets(signed, bands, rows), "node"), "minhash-bands")
    loaded = stored(_loaded(docs, Sieve(shared, "node"), size, hashes), "minhash-loaded")
    groups = candidate_groups(shared, loaded, percent, miss, hashes, **options)
    labels = sets.join(groups, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component"))
    full, empty = found.where("n_shingles > 0"), found.where("n_shingles = 0")  # all empty documents have one set
    joined = full.join(labels, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return joined.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns.

    Most rows stay where they are read: only those that the sieve over the dropped ids lets pass are joined.
    """
    gone = stored(near_groups(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "minhash-gone")
    part = parted(docs, "doc_id", Sieve(gone, "_gone"))
    suspects = part(True)
    return part(False).union(suspects.join(gone, suspects["doc_id"].cast("long") == gone["_gone"], "left_anti"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
