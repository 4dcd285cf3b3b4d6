"""What each of several filters removes, alone and in every order, from decision diagrams of failure masks.

1. Every document gets a mask of the filters it fails.  Spark counts the documents of each part by mask, with the
   labels that would be lost: at most 2**k rows a part, however large the part is.
2. For each part a count-weighted decision diagram is built over the masks: one level a filter, the low edge for
   documents that pass and the high edge for those that fail; leaves hold counts, equal subdiagrams are one node and
   every node knows the counts below it.
3. The orders of the filters are walked so that each differs from the one before by a swap of two neighbours, and the
   diagram follows by swapping those two levels in place.  The path of low edges from the root then gives the steps
   of the order: what the node's low edge holds is kept, what its high edge holds is removed.  A filter's failures
   are what it removes where it comes first, its unique failures what it removes where it comes last.

Defined results: a null part is the empty string, null text is empty; rows that repeat an id count each; a null id is
never a later copy, so it passes ``copies``, and it has no labels; labels that repeat an id count once, 1 if one of
them is 1; empty documents give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Filters an audit takes: all orders of them are reported, k! * k rows for each part.
MOST_FILTERS = 7
COUNTS = ["n", "good", "toxic"]
STEPS = [("part", pa.string()), ("filter_order", pa.string()), *((c, pa.int64()) for c in ("step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))]
STEPS_DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Diagram:
    """A count-weighted decision diagram of failure masks without skipped levels.

    A node is (low, high), numbers of nodes of the level below or of leaves; ``below[node]`` sums the leaves' counts.
    """

    def __init__(self, filters: int, counts: dict[int, tuple[int, ...]]):
        """``counts``: what each mask weighs; bit j of a mask is the filter that level j begins with."""
        width = len(next(iter(counts.values()), (0,)))
        self.nodes: list[tuple[int, int] | None] = []
        self.below: list[tuple[int, ...]] = []
        self.order, self.unique = list(range(filters)), [{} for _ in range(filters)]
        leaves: dict[tuple[int, ...], int] = {}

        def build(level: int, mask: int) -> int:
            if level < filters:
                return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))
            weight = counts.get(mask, (0,) * width)
            if weight not in leaves:
                leaves[weight] = self._add(None, weight)
            return leaves[weight]

        self.root = build(0, 0)

    def _add(self, edges: tuple[int, int] | None, weight: tuple[int, ...]) -> int:
        self.nodes.append(edges)
        self.below.append(weight)
        return len(self.nodes) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        known = self.unique[level]
        if (low, high) not in known:
            known[low, high] = self._add((low, high), tuple(map(sum, zip(self.below[low], self.below[high], strict=True))))
        return known[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one; nodes of ``level`` keep their numbers, so those above stay."""
        upper, self.unique[level + 1] = list(self.unique[level].values()), {}
        self.unique[level] = {}
        for node in upper:
            low, high = self.nodes[node]
            (ll, lh), (hl, hh) = self.nodes[low], self.nodes[high]
            self.nodes[node] = edges = (self._node(level + 1, ll, hl), self._node(level + 1, lh, hh))
            self.unique[level][edges] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def passing(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the path of documents that pass everything."""
        node = self.root
        for name in self.order:
            low, high = self.nodes[node]
            yield name, self.below[low], self.below[high]
            node = low


def neighbour_swaps(n: int) -> list[int]:
    """Levels to swap one after another, so that all orders of n things come up once: the largest travels through
    every order of the others, and these change while it rests at an end."""
    if n < 2:
        return []
    inner, out, down = neighbour_swaps(n - 1), [], True
    for turn in range(len(inner) + 1):
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if turn < len(inner):
            out.append(inner[turn] + down)
        down = not down
    return out


def _with_fresh_nodes(diagram: Diagram) -> Diagram:
    """The same order and counts without the nodes that swaps left behind."""
    counts = {}

    def collect(node: int, level: int, mask: int) -> None:
        if level == len(diagram.order):
            counts[mask] = diagram.below[node]
        else:
            low, high = diagram.nodes[node]
            collect(low, level + 1, mask)
            collect(high, level + 1, mask | 1 << level)

    collect(diagram.root, 0, 0)
    fresh = Diagram(len(diagram.order), counts)
    fresh.order = list(diagram.order)
    return fresh


def audited(part: str, names: str, counts: dict[int, tuple[int, ...]]) -> Iterator[tuple]:
    """Rows of one part: every order of the filters ``names``, step by step."""
    diagram, found = Diagram(len(names), counts), []
    for swap in [None, *neighbour_swaps(len(names))]:
        if swap is not None:
            diagram.swap(swap)
            if len(diagram.nodes) > 1 << (len(names) + 6):
                diagram = _with_fresh_nodes(diagram)
        found.append(list(diagram.passing()))
    fails, alone, shares = [0] * len(names), [0] * len(names), [0] * len(names)
    for steps in found:
        fails[steps[0][0]], alone[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]
        for name, _, removed in steps:
            shares[name] += removed[0]
    for steps in found:
        order = "".join(names[name] for name, _, _ in steps)
        for step, (name, kept, removed) in enumerate(steps, 1):
            yield part, order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shares[name]


def audit(masks: DataFrame, names: str) -> DataFrame:
    """(part, mask, n, good, toxic) counts of failure masks, bit j for ``names[j]``, to the rows of every order and step."""
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters of different names")
    schema = pa.schema(STEPS).set(2, pa.field("step", pa.int32()))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))  # at most 2**k rows

    def run(batches):
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                out = audited(part, names, {r["mask"]: tuple(r[c] for c in COUNTS) for r in rows})
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return parts.mapInArrow(run, STEPS_DDL)


def failure_masks(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], copies: str | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents (doc_id, source, text) by part and the conditions they fail.

    ``conditions``: named expressions over the column ``text``.  ``copies`` names a last filter, which documents fail
    whose text a smaller id has, anywhere in the table.  Texts are read once; only their digests meet, and those of
    texts that occur once meet nothing.
    """
    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    bits = sum((F.when(fails, 1 << j).otherwise(0) for j, fails in enumerate(conditions.values())), F.lit(0))
    narrow = stored(whole.select("doc_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "failure-masks")
    if copies is not None:
        first = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("digest", "first")
        later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
        narrow = narrow.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(later, 1 << len(conditions)).otherwise(0)).alias("mask"))
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(*(F.max(F.coalesce((labels[c] == 1).cast("long"), F.lit(0).cast("long"))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    counted = narrow.join(marks, "doc_id", "left").groupBy("part", "mask")
    return counted.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole texts: short, repetitive, loud, with symbols, copied."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    conditions = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.char_length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    return audit(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), conditions, copies="E"), "ABCDE")


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(worded.doc_id > first, false)} AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM worded LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, list_value(f.A, f.B, f.C, f.D, f.E) AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, i AS step FROM orders, letters),
hits AS (SELECT part, filter_order, step, o[step] AS letter, n, good, toxic, f[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda x: f[x])) = 0 AS there, len(list_filter(f, lambda x: x)) AS all_fails FROM masks, steps),
counted AS (SELECT part, filter_order, step, letter, sum(CASE WHEN there AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN there AND fails THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails AND NOT there THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND all_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN there AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN there AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM hits GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""
