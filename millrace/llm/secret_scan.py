"""Secrets in whole texts by one deterministic automaton of all rules.

The rules' regexes become one minimal automaton (:mod:`.automaton`), whose transition array reads every byte of a batch
once, for all rules together.  Its states tell for each rule whether a match may have begun and whether it is one by
now, so only stretches in which a rule accepts are looked at again: there the matches, leftmost first, each as long as
can be and none overlapping another of its rule, are read off with the automaton of that rule alone.  A match that is too
short is dropped but still takes its place.

Spans are in code points, their end exclusive.  Texts of a batch are scanned in blocks of about 2 MB, a longer text
alone; nothing is shuffled.

Defined results: null and empty texts have no spans; every row gives a row, whatever its id; rows that repeat are
scanned each; spans of one kind never overlap, those of different kinds may; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton, Pattern, combined, determinised, states_of
from .common import table, texts_of
from .textkernel import batch_blocks

SPANS = "spans array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``least``: characters of the match, or of its ``value``, the part from where the rule first accepts, that make it count."""

    kind: str
    pattern: str
    least: int = 1
    value: bool = False


# The base rules, whose kinds come first, in this order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, value=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Published forms of keys and tokens that the base rules do not know by themselves.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("login", r"://[A-Za-z0-9._~%!$&*+;=-]+:[A-Za-z0-9._~%!$&*+;=-]+@"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]+=*", 28),
)
RULES = BASE + MORE


class Scanner:
    """All rules as one automaton, and each alone for reading off its matches."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.alone = [determinised(Pattern(r.pattern)) for r in rules]
        self.all = combined(self.alone)

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start byte, rule, end byte) of all matches that count, in the texts between ``bounds``."""
        states = states_of(self.all, data, bounds)
        ends = np.flatnonzero(states >= self.all.first_accept)
        if not len(ends):
            return
        told, alive = self.all.accepts[states[ends]], self.all.lives[states]
        for n, rule in enumerate(self.rules):
            begins, stops = _stretches(alive & (1 << n) != 0, bounds, ends[told >> n & 1 == 1])
            if _is_run(self.alone[n]):  # the stretch is the match
                long = stops - begins >= rule.least
                yield from ((b, n, e) for b, e in zip(begins[long].tolist(), stops[long].tolist(), strict=True))
                continue
            limits, done = bounds[np.searchsorted(bounds, begins, side="right")], 0
            for begin, stop, limit in zip(begins.tolist(), stops.tolist(), limits.tolist(), strict=True):
                for start, end, first in _matches(self.alone[n], data[:limit], max(begin, done), stop):
                    done = end
                    if end - (first if rule.value else start) >= rule.least:
                        yield start, n, end


def _stretches(alive: np.ndarray, bounds: np.ndarray, accepted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rule may have begun all along, within one text, and accepts somewhere: first bytes, and the bytes after the last."""
    first, last = alive.copy(), alive.copy()
    first[1:] &= ~alive[:-1]
    last[:-1] &= ~alive[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(alive))]
    first[cuts], last[cuts - 1] = alive[cuts], alive[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hit = np.searchsorted(accepted, end) > np.searchsorted(accepted, begin)
    return begin[hit], end[hit]


def _is_run(automaton: Automaton) -> bool:
    """Whether the pattern is one class of bytes once or more, so that its matches are the longest runs of these."""
    rows = automaton.steps.reshape(-1, 1 << automaton.shift) >> automaton.shift
    accepting = np.flatnonzero(automaton.accepts)
    return len(accepting) == 1 and len(rows) == 3 and bool((rows[0] == rows[accepting[0]]).all())


def _matches(automaton: Automaton, data: np.ndarray, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the value) of leftmost longest matches that begin from ``at`` and before ``stop``.  What failed
    once at a place and in a state fails again, so time stays in proportion to the text."""
    steps, classes, shift, least, lives = automaton.steps, automaton.classes, automaton.shift, automaton.first_accept, automaton.lives
    failed: set[tuple[int, int]] = set()
    while at < stop:
        state, p, end, first, path = 0, at, -1, -1, []
        while p < len(data):
            state = int(steps[(state << shift) + int(classes[data[p]])]) >> shift
            if not lives[state] or (p, state) in failed:
                break
            p += 1
            if state >= least:
                end, first = p, p - 1 if first < 0 else first
            elif end < 0:
                path.append((p - 1, state))
        if end < 0:
            failed.update(path)
            at += 1
        else:
            yield at, end, first
            at = end


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans: array of kind, start, end), ordered by start and then as the rules are listed, for every row."""
    scanner, kinds = Scanner(rules), [r.kind for r in rules]
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, end, data, bounds in batch_blocks(texts):
                spans: list[list[dict]] = [[] for _ in range(end - first)]
                found = sorted(scanner.spans(data, bounds))
                rows = np.searchsorted(bounds, [f[0] for f in found], side="right") - 1
                for row in np.unique(rows).tolist():
                    own = [found[i] for i in np.flatnonzero(rows == row)] if len(spans) == 1 else found[np.searchsorted(rows, row) : np.searchsorted(rows, row, side="right")]
                    text = data[bounds[row] : bounds[row + 1]]
                    points = np.r_[0, np.cumsum(text & 0xC0 != 0x80)]
                    spans[row] = [{"kind": kinds[n], "start": int(points[a - bounds[row]]), "end": int(points[b - bounds[row]])} for a, n, b in own]
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(spans, schema.field("spans").type)], schema=schema)

    return texts_of(docs).mapInArrow(run, f"doc_id long, {SPANS}")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *(of(r.kind) for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _rule_sql(number: int, rule: Rule) -> str:
    """Matches are told apart from what lies between them, and lengths summed up give their places."""
    pattern = rule.pattern.replace("'", "''")
    measured = f"regexp_extract(m, '{pattern}', 1)" if rule.value else "m"
    return f"""SELECT doc_id, {number} AS n, '{rule.kind}' AS kind, stop - length(m) AS start, stop FROM (
  SELECT doc_id, m, sum(length(m) + length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_split_to_array(t, '{pattern}')[:-2]) AS p, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i FROM texts)) WHERE length({measured}) >= {rule.least}"""


SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_rule_sql(n, r) for n, r in enumerate(RULES))}),
listed AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, n) AS spans,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, n) FILTER (n < {len(BASE)}) AS base,
  {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)} FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN listed USING (doc_id)
"""
