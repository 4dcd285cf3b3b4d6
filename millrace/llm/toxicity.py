"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding: lower case, homoglyphs to the letters they imitate, digits and signs that stand for
letters to those letters, every other character that is neither letter nor mark to a space.

Learning (on at most about ``sample_rows`` labelled rows, drawn by hash; ``labels.toxic`` only):

* terms are word beginnings of 3 to ``longest`` letters and whole words that at least ``least``
  toxic texts and a ``share`` of them hold; of each, the number of distinct toxic and clean texts (texts that share a minimum shingle hash count once,
  so a group of near copies does not make its words look telling);
* terms that are telling enough (log odds ratio and log likelihood ratio) enter the lexicon; the
  weight is the log odds ratio, less the weight of shorter entries that match with it;
* words that a lexicon entry begins, alone or with the word before or after them, are exception phrases
  where clean texts hold them as readily: they match the automaton too and cancel the entry;
* a logistic curve over two length-normalised measures, log of the weight sum and log of the weight
  sum per hundred words, is fitted by Newton steps, giving a score between 0 and 1.

Defined results: null and empty texts have no match and get the score of no match; null ids are
never held out; labels that repeat or contradict count as they stand; null labels are ignored;
without labelled rows of both kinds every score is 0; an empty table gives an empty result; other
columns are ignored by :func:`scores`, carried by :func:`drop_toxic`.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, held_out, pieces, stored, texts_of

THRESHOLD = 0.7

# Characters that imitate Latin letters, then digits and signs used for letters.
_HOMOGLYPHS = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ё": "e", "ε": "e", "ɡ": "g", "һ": "h", "н": "h",
    "і": "i", "ı": "i", "ι": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "ⅼ": "l", "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o",
    "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ц": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x",
    "χ": "x", "у": "y", "γ": "y", "ᴢ": "z",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class _Fold(dict):
    """Translation table filled on demand: letters stay, everything unknown becomes a space."""

    def __missing__(self, code: int):
        char = chr(code)
        if char in _HOMOGLYPHS or char in _SIGNS:
            value = _HOMOGLYPHS.get(char) or _SIGNS[char]
        elif 0xFF41 <= code <= 0xFF5A:  # full-width letters
            value = chr(code - 0xFF41 + ord("a"))
        elif code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):  # invisible
            value = ""
        else:
            value = char if char.isalpha() or 0x300 <= code < 0x370 else " "
        self[code] = value
        return value


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words with a space before each and after the last."""
    return " " + " ".join((text or "").lower().translate(_FOLD).split()) + " "


@dataclass
class Model:
    """Patterns as they stand in folded text (a leading space is a word start), weights, exceptions and the curve."""

    weights: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found


def measures(automaton, text: str | None) -> tuple[float, float]:
    """Log of 1 + weight sum, log of 1 + weight sum per hundred words; matches inside an exception do not count."""
    folded = fold(text)
    if not len(automaton):
        return 0.0, 0.0
    found, spared = [], []
    for end, (length, weight) in automaton.iter(folded):
        (found if weight else spared).append((end - length + 1, end, weight))
    if spared:
        spared.sort()
        starts = [a for a, _, _ in spared]
        reach = list(accumulate((b for _, b, _ in spared), max))  # how far exceptions that begin here or before reach
        found = [x for x in found if not (k := bisect_right(starts, x[0])) or reach[k - 1] < x[1]]
    total = sum(w for _, _, w in found)
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def _terms(text: str, longest: int) -> set[str]:
    words = set(fold(text).split())
    out = {f" {w} " for w in words if 3 <= len(w) <= 40}
    for w in words:
        out.update(" " + w[:k] for k in range(3, min(len(w), longest) + 1))
    return out


def _family(text: str) -> int:
    """Least hash of the text's word triples: near copies mostly share it."""
    import xxhash

    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0) >> 1


def _term_rows(batch: pa.RecordBatch, longest: int, most: int = 20_000):
    """Distinct (term, family, toxic) of the texts, handed on as soon as there are ``most`` or more."""
    rows: dict[tuple[str, int, bool], None] = {}
    for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
        family = _family(text)
        rows.update(dict.fromkeys((t, family, bool(toxic)) for t in _terms(text, longest)))
        if len(rows) >= most:
            yield rows
            rows = {}
    yield rows


def _counted(sample: DataFrame, longest: int, least: int) -> dict[str, tuple[int, int]]:
    """(toxic, clean) families for each term that at least ``least`` toxic families hold."""
    schema = pa.schema([("term", pa.string()), ("family", pa.int64()), ("toxic", pa.bool_())])

    def spread(batches):
        for batch in pieces(batches, 64):
            for rows in _term_rows(batch, longest):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    toxic_first = sample.where("toxic").mapInArrow(spread, "term string, family long, toxic boolean").groupBy("term").agg(F.countDistinct("family").alias("t")).where(F.col("t") >= least)
    known = {r.term: r.t for r in toxic_first.collect()}  # at most sample words / least
    chosen = frozenset(known)
    clean = Counter()

    def count(batches):
        for batch in pieces(batches, 256):
            rows = list({(t, family) for text in batch.column("text").to_pylist() for family in [_family(text)] for t in _terms(text, longest) & chosen})
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "family"])

    for r in sample.where("not toxic").mapInArrow(count, "term string, family long").groupBy("term").agg(F.countDistinct("family").alias("c")).collect():
        clean[r.term] = r.c
    return {t: (n, clean[t]) for t, n in known.items()}


def _lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int, odds: float, evidence: float) -> dict[str, float]:
    """Entry and weight: the log odds ratio, less what its shorter entries bring already."""
    next_letters: dict[str, list[str]] = {}
    for term in counts:
        next_letters.setdefault(term[:-1], []).append(term[-1])

    def weight(term: str) -> float:
        t, c = counts[term]
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    def likelihood(term: str) -> float:
        """Log likelihood ratio of the term's spread over both kinds against one rate for all."""
        (t, c), out = counts[term], 0.0
        rate = (t + c) / (toxic + clean)
        for held, of in ((t, toxic), (c, clean)):
            for seen, expected in ((held, of * rate), (of - held, of * (1 - rate))):
                if seen > 0:
                    out += 2 * seen * math.log(seen / max(expected, 1e-9))
        return out

    telling = {t: n for t in counts if weight(t) >= odds and (n := likelihood(t)) >= evidence}
    above: dict[str, float] = {}  # total weight that a match of a chosen term brings, with its shorter entries
    chosen: dict[str, float] = {}
    for term in sorted(telling, key=lambda t: (len(t), t)):
        if any(counts[x][0] >= 0.95 * counts[term][0] for x in (term + c for c in next_letters.get(term, ())) if x in telling):
            continue  # the longer one says the same
        before = next((above[term[:k]] for k in range(len(term) - 1, 3, -1) if term[:k] in above), 0.0)
        if weight(term) - before >= 1.0:
            above[term] = weight(term)
            chosen[term] = weight(term) - before
    return chosen


def _exceptions(sample: DataFrame, entries: dict[str, float], toxic: int, clean: int, least: int) -> list[str]:
    """Whole words under an entry, and pairs of such a word and a neighbour, that clean texts hold at least as readily as toxic ones."""
    schema = pa.schema([("word", pa.string()), ("family", pa.int64()), ("toxic", pa.bool_())])

    def spread(batches):
        for batch in pieces(batches, 256):
            rows = {}
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = fold(text).split()
                under = {w for w in set(words) if any(f" {w}"[:k] in entries for k in range(4, len(w) + 2)) or f" {w} " in entries}
                if under:
                    family = _family(text)
                    phrases = {f" {w} " for w in under} | {f" {a} {b} " for a, b in zip(words, words[1:]) if a in under or b in under}
                    rows.update(dict.fromkeys((w, family, mark) for w in phrases))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    used = sample.mapInArrow(spread, "word string, family long, toxic boolean").groupBy("word").agg(F.countDistinct(F.when(F.col("toxic"), F.col("family"))).alias("t"), F.countDistinct(F.when(~F.col("toxic"), F.col("family"))).alias("c"))
    phrases = {r.word for r in used.where((F.col("c") >= least) & (F.col("t") * clean <= F.col("c") * toxic)).collect()}  # bounded by the sample
    return sorted(p for p in phrases if " " not in p.strip() or not {f" {w} " for w in p.split()} & phrases)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[float, float, float]:
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(3), np.diag([1e-4, ridge, ridge]) * len(x) * 1e-2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ beta)
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, longest: int = 8, least: int = 6, odds: float = 1.8, evidence: float = 30.0) -> Model:
    """A model from labelled rows of (doc_id, text) and (doc_id, toxic)."""
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["toxic"] == 1).alias("toxic")).where("doc_id is not null and toxic is not null").distinct()
    part = min(1.0, sample_rows / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 31)) < int(part * (1 << 31))).limit(2 * sample_rows)
    sample = stored(texts_of(docs).join(F.broadcast(drawn), "doc_id").select("text", "toxic"), "toxicity-sample")  # at most 2 * sample_rows ids are broadcast
    try:
        kinds = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(kinds) < 2:
            return Model({}, [], (-30.0, 0.0, 0.0))
        counts = _counted(sample, longest, least)
        weights = _lexicon(counts, kinds[True], kinds[False], odds, evidence)
        model = Model(weights, _exceptions(sample, weights, kinds[True], kinds[False], least), (0.0, 0.0, 0.0))

        def measured(batches):
            automaton = model.automaton()
            for batch in batches:
                both = [measures(automaton, t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

        rows = sample.mapInArrow(measured, "a double, b double, toxic boolean").collect()  # bounded by the sample
        model.curve = _fit(np.array([(r.a, r.b) for r in rows]), np.array([float(r.toxic) for r in rows]))
        return model
    finally:
        dropped(sample)


def _scored(model: Model):
    automaton, (c, a, b) = model.automaton(), model.curve

    def score(text: str | None) -> float:
        x, y = measures(automaton, text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y))))

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        score = _scored(model)
        for batch in pieces(batches, 1024):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score(t) for t in batch.column("text").to_pylist()], pa.float64())], schema=schema)

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` under the threshold, with all their columns, judged in place."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        score = _scored(model)
        for batch in pieces(batches, 1024):
            yield batch.filter(pa.array([score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from rows that are not held out (crc32 of the id, mod 3, is not 1)."""
    return learn(docs, labels.where(~held_out(labels["doc_id"], 3, 1)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scores(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
