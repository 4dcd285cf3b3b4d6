"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Text: ``A-Z`` lower-cased, words between white space, one end token per text.

1. Counts of all distinct training tokens are summed by Spark (64-bit hashes of words).
2. Every word seen ``floor`` times or more is put into a class by exchange.  The ``seed`` most frequent
   words come first: each round counts, by Spark over the bigram table, how often each word follows and
   precedes each class, and moves every word to the class that raises the class-bigram likelihood most,
   one half of the words after the other, until a round raises it by less than ``tolerance`` nats a
   token.  Then one more pass over all texts counts the classes next to each other word, and each is
   moved to its best class by the same rule; the class bigrams of two such words are counted with the classes
   of both.  Words seen less often form one more class; the end token
   is a class of its own.
3. P(token | previous) = P(class | previous class) * P(token | class).  Transitions are interpolated
   with the class frequency.  In the tail class known words are discounted and the discount goes to
   the one unknown word, so that it gets what new words really get; probabilities of each
   distribution sum to 1.
4. Scoring adds class transitions and the emissions of the ``frequent`` words, whose counts and classes
   travel with the tasks, in one pass over the texts; neighbours with a rarer word among them are
   joined with the counts and classes.

Everything but the frequent words' table grows with the corpus and stays in Spark.

Defined results: null text is empty and scores its end token; null ids are training rows; rows that
repeat an id count and score row by row; without training rows N and V are 0 and base scores follow the formula; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, held_out, pieces, stored, texts_of
from .sieve import Sieve
from .textkernel import batch_blocks, find_words, hash_spans

END = np.int64(-1)
#: Texts whose tokens a task holds at once while it counts.
BATCH_ROWS = 4096


def token_blocks(texts: pa.Array):
    """(first row, rows, token hashes, row of each token): words as 64-bit hashes and an END after each row's last word."""
    for first, end, data, offsets in batch_blocks(texts):
        starts, ends, rows = find_words(data, offsets)
        words = hash_spans(data, starts, ends).view(np.int64)
        words[words == END] = 0
        n = end - first
        sizes = np.bincount(rows, minlength=n) + 1
        tokens = np.full(len(words) + n, END)
        tokens[np.arange(len(words)) + rows] = words
        yield first, n, tokens, np.repeat(np.arange(n), sizes)


def token_counts(training: DataFrame) -> DataFrame:
    """(token, n) over all texts."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in pieces(batches, BATCH_ROWS):
            found = [tokens for _, _, tokens, _ in token_blocks(batch.column("text"))]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], schema=schema)

    return training.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _ids(tokens: np.ndarray, keys: np.ndarray, ids: np.ndarray, tail: int, end: int) -> np.ndarray:
    """Number of each token: its place in the vocabulary, ``tail`` or ``end``."""
    at = np.minimum(np.searchsorted(keys, tokens), max(len(keys) - 1, 0))
    out = np.where(keys[at] == tokens, ids[at], tail) if len(keys) else np.full(len(tokens), tail)
    return np.where(tokens == END, end, out)


def frequent_words(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """(token, n) of the words with the highest counts, at most ``most``, by falling count: the lowest count that
    still fits comes from a histogram over the logarithm of counts, so what is collected is bounded."""
    words = counts.where(F.col("token") != int(END))
    bins = words.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect()
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r.bin):
        total += r.words
        if total > most:
            break
        least = r.n
    if least is None:
        return []
    return sorted(((r.token, r.n) for r in words.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


def bigram_counts(training: DataFrame, keys: np.ndarray, ids: np.ndarray, size: int) -> DataFrame:
    """(a, b, n) over neighbouring tokens by number, ``size`` and more being the tail; a text begins after an end."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in pieces(batches, BATCH_ROWS):
            found = []
            for _, _, tokens, rows in token_blocks(batch.column("text")):
                now = np.where(tokens == END, size + 1, np.minimum(_ids(tokens, keys, ids, size, size + 1), size)).astype(np.int64)
                before = np.r_[size + 1, now[:-1]]
                before[np.r_[True, rows[1:] != rows[:-1]]] = size + 1
                found.append(before * (size + 2) + now)
            if found:
                pairs, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], schema=schema)

    return training.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _likelihood(table: np.ndarray) -> float:
    """Nats a token that class bigrams tell about the next class (the part of the likelihood that exchange changes)."""
    total = max(table.sum(), 1)
    return float((table * np.log(np.maximum(table, 1e-9) * (total / np.maximum(table.sum(1, keepdims=True) * table.sum(0, keepdims=True).astype(float), 1e-9)))).sum() / total)


def _gains(table: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """By class of a right and of a left neighbour: the gain of each free class."""
    k = len(table)
    rates = np.log((table + 0.5) / ((table.sum(1, keepdims=True) + 0.5 * k) * (table.sum(0, keepdims=True) + 0.5 * k)))
    return rates.T[:, :free].copy(), rates[:, :free].copy()


def neighbour_classes(training: DataFrame, others: DataFrame, keys: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> DataFrame:
    """(token, slot, next, n) for the tokens in ``others``: how often each comes before each class (slots from 0 on) and
    after it (from k on), and, with slot -1, before each token ``next`` in ``others``; the sieve lets some more tokens
    pass.  ``classes``: of the seed's words by number, then of all other words (one class) and of the end."""
    sieve, size, k = Sieve(others, "token", 25), len(classes) - 2, int(classes[-1]) + 1
    schema = pa.schema([("token", pa.int64()), ("slot", pa.int32()), ("next", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in pieces(batches, BATCH_ROWS):
            found, met = [], []
            for _, _, tokens, rows in token_blocks(batch.column("text")):
                number = np.where(tokens == END, size + 1, np.minimum(_ids(tokens, keys, ids, size, size + 1), size)).astype(np.int64)
                other, heads = (number == size) & sieve.passes(tokens), np.r_[True, rows[1:] != rows[:-1]]
                mine, both = np.flatnonzero(other), np.flatnonzero(other[:-1] & other[1:])  # an end lies between texts
                before = np.r_[k - 1, classes[number[:-1]]]
                before[heads] = k - 1
                found += [(tokens[mine], classes[number[mine + 1]]), (tokens[mine], k + before[mine])]  # an end always follows
                met.append((tokens[both], tokens[both + 1]))
            if found:
                tokens, slots = (np.concatenate(x) for x in zip(*found, strict=True))
                kinds, code = np.unique(tokens, return_inverse=True)
                pairs, counts = np.unique(code * (2 * k) + slots, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[pairs // (2 * k)]), pa.array((pairs % (2 * k)).astype(np.int32)), pa.array(np.zeros(len(pairs), np.int64)), pa.array(counts)], schema=schema)
                ahead, behind = (np.concatenate(x) for x in zip(*met, strict=True))
                pairs, counts = np.unique(np.searchsorted(kinds, ahead) * len(kinds) + np.searchsorted(kinds, behind), return_counts=True)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[pairs // len(kinds)]), pa.array(np.full(len(pairs), -1, np.int32)), pa.array(kinds[pairs % len(kinds)]), pa.array(counts)], schema=schema)

    return training.mapInArrow(run, "token long, slot int, next long, n long").groupBy("token", "slot", "next").agg(F.sum("n").alias("n"))


def best_classes(slots: DataFrame, table: np.ndarray, free: int) -> DataFrame:
    """(token, class): the class in which each token raises the likelihood most, given its neighbours' classes."""
    gain_of = np.concatenate(_gains(table, free))
    schema = pa.schema([("token", pa.int64()), ("class", pa.int32())])

    def choose(batches):
        for batch in batches:
            if batch.num_rows:
                slot, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("slots", "counts"))
                ends = np.cumsum(pc.list_value_length(batch.column("slots")).to_numpy(zero_copy_only=False))
                gains = np.add.reduceat(gain_of[slot] * n[:, None], np.r_[0, ends[:-1]])
                yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(gains.argmax(axis=1).astype(np.int32))], schema=schema)

    by_token = slots.groupBy("token").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts"))  # at most 2 k entries
    return by_token.mapInArrow(choose, "token long, class int")


def assign(training: DataFrame, words: DataFrame, keys: np.ndarray, ids: np.ndarray, seed: np.ndarray, table: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(token, n, class) with a class for those of ``words`` that have the one of all other words, and the class table.

    Each is moved there from the class of all others, by the rule of exchange.  The table is counted: pairs of two
    words outside the seed are joined with the classes of both.
    """
    k = len(table)
    others = k - 2
    found = stored(neighbour_classes(training, words.where(F.col("class") == others), keys, ids, seed), "lm-slots")
    slots, pairs = found.where("slot >= 0").drop("next"), found.where("slot < 0").drop("slot")
    chosen = stored(best_classes(slots, table, others), "lm-chosen").select(F.col("token").alias("_token"), F.col("class").alias("_class"))
    moved = words.join(chosen, F.col("token") == F.col("_token"), "left").select("token", "n", F.when(F.col("class") == others, F.coalesce("_class", F.lit(others))).otherwise(F.col("class")).cast("int").alias("class"))
    moved = stored(moved, "lm-classes")
    mine = moved.join(words.where(F.col("class") == others).select(F.col("token").alias("_token")), F.col("token") == F.col("_token"), "left_semi")
    sides = np.zeros((k, 2 * k))
    for r in slots.join(mine.select("token", "class"), "token").groupBy("class", "slot").agg(F.sum("n").alias("n")).collect():  # at most 2 k * k
        sides[r["class"], r.slot] = r.n
    right, left = sides[:, :k], sides[:, k:].T
    right[others] += table[others] - right.sum(0)  # the rest is of words that stay
    left[:, others] += table[:, others] - left.sum(1)
    both = np.zeros((k, k))  # pairs of two words outside the seed
    side = lambda token, name: mine.select(F.col("token").alias(token), F.col("class").alias(name))
    for r in pairs.join(side("token", "a"), "token").join(side("next", "b"), "next").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most k * k
        both[r.a, r.b] = r.n
    both[:, others] += right[:, others] - both.sum(1)  # again the rest
    both[others] += left[others] - both.sum(0)
    out = table.astype(float)
    out[others], out[:, others] = 0, 0
    out += np.where(np.arange(k) == others, 0, right) + np.where(np.arange(k)[:, None] == others, 0, left)
    out += both
    dropped(found)
    return moved, out


@dataclass
class Model:
    keys: np.ndarray  # sorted token hashes of the frequent words
    ids: np.ndarray  # their numbers, by falling frequency
    classes: np.ndarray  # class of each number; then the tail's and the end's
    transitions: np.ndarray  # log10 P(class | class)
    emissions: np.ndarray  # log10 P(word | class) of frequent words; 0 for the end; tail words are joined
    counts: np.ndarray  # counts of the numbers
    total: int  # N
    distinct: int  # V
    tail_total: int
    tail_distinct: int
    discount: float
    words: DataFrame  # (token, n, class) of all clustered words
    of_class: np.ndarray  # tokens of each class
    steps: list[float]  # likelihood before exchange, after each round over the seed, and with all words in classes


def _class_table(bigrams: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Class bigram counts, k * k numbers."""
    size = len(classes)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches):
        table = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            pair = batch.column("pair").to_numpy(zero_copy_only=False)
            np.add.at(table, classes[pair // size] * k + classes[pair % size], batch.column("n").to_numpy(zero_copy_only=False))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], schema=schema)

    table = np.zeros(k * k, dtype=np.int64)
    for r in bigrams.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r.cell] = r.n
    return table.reshape(k, k)


def _exchange(bigrams: DataFrame, classes: np.ndarray, table: np.ndarray, free: int, part: int, parts: int) -> np.ndarray:
    """Best class of every ``parts``-th frequent word given all others' classes.

    The gain of a word in class c is the sum over its neighbours' classes d of n * log of the class
    bigram rate n(c, d) / (n(c) n(d)), to the left and to the right.
    """
    size, k = len(classes), len(table)
    follow, precede = _gains(table, free)
    schema = pa.schema([("word", pa.int64()), ("slot", pa.int64()), ("n", pa.int64())])

    def sides(batches):
        for batch in batches:
            pair, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n"))
            a, b = pair // size, pair % size
            keys = []
            counts = []
            for word, slot in ((a, classes[b]), (b, k + classes[a])):  # right neighbours, left neighbours
                mine = (word < size - 2) & (word % parts == part)
                keys.append(word[mine] * (2 * k) + slot[mine])
                counts.append(n[mine])
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            values, inverse = np.unique(keys, return_inverse=True)
            sums = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values // (2 * k)), pa.array(values % (2 * k)), pa.array(sums)], schema=schema)

    def choose(batches):
        gains: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("word", "slots", "counts")), strict=True):
                slots, counts = np.array(slots), np.array(counts, dtype=float)
                right = slots < k
                gains[word] = (follow[slots[right]] * counts[right, None]).sum(0) + (precede[slots[~right] - k] * counts[~right, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(gains), pa.int64()), pa.array([int(g.argmax()) for g in gains.values()], pa.int64())], names=["word", "best"])

    by_slot = bigrams.mapInArrow(sides, "word long, slot long, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    by_word = by_slot.groupBy("word").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts"))  # at most 2 k entries
    out = classes.copy()
    for r in by_word.mapInArrow(choose, "word long, best long").collect():  # at most the vocabulary
        out[r.word] = r.best
    return out


def train(training: DataFrame, counts: DataFrame, vocabulary: int | None = None, classes: int = 48, floor: int = 5, tolerance: float = 0.005, parts: int = 2, seed: int = 8192, frequent: int = 131_072) -> Model:
    """``counts``: token_counts of ``training``, stored.  All words seen ``floor`` times are clustered (or the
    ``vocabulary`` most frequent, where that is given); the counts of at most ``frequent`` words travel with the tasks,
    those of all others are joined."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count(F.lit(1)).alias("V"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    top = frequent_words(counts, frequent)
    tokens, held = np.array([t for t, _ in top], dtype=np.int64), np.array([n for _, n in top], dtype=np.int64)
    order = np.argsort(tokens)
    keys, ids = tokens[order], order.astype(np.int64)
    chosen = counts.where((F.col("token") != int(END)) & (F.col("n") >= floor)) if vocabulary is None else counts.sparkSession.createDataFrame(top[:vocabulary], "token long, n long")
    n_words = chosen.count()
    size, k = min(seed, n_words, len(top)), classes + 2
    tail, end = classes, classes + 1
    bigrams = stored(bigram_counts(training, keys, ids, size), "bigrams")
    assigned = np.r_[np.arange(size) % classes, tail, end].astype(np.int64)
    table = _class_table(bigrams, assigned, k)
    best, before = (_likelihood(table), assigned, table), -np.inf
    steps = [best[0]]
    while size > classes and best[0] - before >= tolerance:
        before = best[0]
        for n in range(parts):
            assigned = _exchange(bigrams, assigned, table, classes, n, parts)
            table = _class_table(bigrams, assigned, k)
        best = max(best, (_likelihood(table), assigned, table), key=lambda x: x[0])
        steps.append(best[0])
    _, assigned, table = best
    seeded = counts.sparkSession.createDataFrame([(int(t), int(c)) for t, c in zip(tokens[:size], assigned[:size], strict=True)], "_token long, _class int")
    words = chosen.join(F.broadcast(seeded), F.col("token") == F.col("_token"), "left").select("token", "n", F.coalesce("_class", F.lit(tail)).alias("class"))
    words = stored(words, "lm-classes")
    dropped(bigrams)
    if n_words > size:
        words, table = assign(training, words, keys, ids, assigned, table)
        steps.append(_likelihood(table))
    ends = int(table[:, end].sum())
    of_class = np.zeros(k)
    for r in words.groupBy("class").agg(F.sum("n").alias("n")).collect():
        of_class[r["class"]] = r.n
    tail_total, tail_distinct = int(whole.N) - int(of_class.sum()) - ends, int(whole.V) - n_words - (ends > 0)
    of_class[tail], of_class[end] = tail_total, ends
    frequency = (of_class + 1.0) / (of_class.sum() + k)
    rows = table.sum(1, keepdims=True).astype(float)
    kinds = (table > 0).sum(1, keepdims=True) + 1.0
    transitions = (table + kinds * frequency) / (rows + kinds)
    discount = min(0.95, max(0.05, whole.once / max(1.0, whole.once + 2.0 * whole.twice)))
    class_of = {r.token: r["class"] for r in words.where(F.col("n") >= int(held.min())).collect()} if len(held) else {}  # at most ``frequent``
    numbers = np.array([class_of.get(t, tail) for t in tokens.tolist()] + [tail, end], dtype=np.int64)
    mine = numbers[: len(top)]
    emissions = np.where(mine == tail, np.log10(np.maximum(held - discount, 0.01) / max(tail_total, 1)), np.log10(held / np.maximum(of_class[mine], 1)))
    return Model(keys, ids, numbers, np.log10(transitions), np.r_[emissions, 0.0, 0.0], np.r_[held, 0, ends], int(whole.N), int(whole.V), tail_total, tail_distinct, discount, words, of_class, steps)


def scored(docs: DataFrame, counts: DataFrame, model: Model, modulus: int, remainder: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Each word that is not frequent is joined once, with the classes of its neighbours beside it; only where two of
    them meet are both joined for the transition between them.
    """
    size, k = len(model.keys), len(model.of_class)
    lists = (("token", pa.int64()), ("before", pa.int8()), ("after", pa.int8()), ("a", pa.int64()), ("b", pa.int64()))
    parts = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("frequent_base", pa.float64()), ("frequent", pa.float64()), *((c, pa.list_(t)) for c, t in lists)])

    def run(batches):
        base_of = np.log10((model_counts + 0.1) / (total + 0.1 * (distinct + 1)))
        done = TaskContext.get().partitionId() << 40  # rows are numbered once, in the written table
        for batch in batches:
            ids = batch.column("doc_id")
            for first, n, tokens, rows in token_blocks(batch.column("text")):
                numbers = _ids(tokens, keys, word_ids, size, size + 1).astype(np.int64)
                now, heads, other = classes[numbers], np.r_[True, rows[1:] != rows[:-1]], numbers == size
                before, after_other = np.r_[k - 1, now[:-1]], np.r_[False, other[:-1]]
                before[heads], after_other[heads] = k - 1, False
                value = np.where(other | after_other, 0.0, transitions[before, now]) + np.where(other, 0.0, emissions[numbers])
                base = np.where(other, 0.0, base_of[numbers])
                known = ~other & (model_counts[numbers] > 0)
                mine, both = np.flatnonzero(other), np.flatnonzero(other & after_other)  # an end always follows
                ends = lambda at: pa.array(np.r_[0, np.cumsum(np.bincount(rows[at], minlength=n))].astype(np.int32))
                singles = (tokens[mine], np.where(after_other[mine], -1, before[mine]).astype(np.int8), np.where(other[mine + 1], -1, now[mine + 1]).astype(np.int8))
                found = [pa.ListArray.from_arrays(ends(mine), pa.array(x)) for x in singles] + [pa.ListArray.from_arrays(ends(both), pa.array(x)) for x in (tokens[both - 1], tokens[both])]
                add = lambda x: np.bincount(rows, weights=x, minlength=n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(done + first, done + first + n)), ids.take(pa.array(np.arange(first, first + n))), pa.array(np.bincount(rows, minlength=n)), pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(add(value)), *found], schema=parts)
            done += batch.num_rows

    keys, word_ids, classes, transitions, emissions, model_counts, total, distinct = model.keys, model.ids, model.classes, model.transitions, model.emissions, model.counts, model.total, model.distinct
    rows = stored(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, frequent_base double, frequent double, token array<long>, before array<tinyint>, after array<tinyint>, a array<long>, b array<long>"), "lm-rows")
    info = model.words.unionByName(counts.join(model.words.select("token"), "token", "left_anti").select("token", "n", F.lit(k - 2).alias("class"))).where(F.col("token") != int(END))
    row_of, class_total = (F.array(*(F.lit(float(x)) for x in values)) for values in (transitions.ravel(), np.maximum(model.of_class, 1)))
    transition = lambda before, now: F.element_at(row_of, (before * k + now + 1).cast("int"))
    class_of = lambda column: F.coalesce(F.col(column), F.lit(k - 2)).cast("int")

    scale, left = model.total + 0.1 * (model.distinct + 1), max(model.tail_total, 1)
    unknown = model.discount * max(model.tail_distinct, 1) / left if model.tail_distinct else 1.0
    singles = rows.select("row", F.explode(F.arrays_zip("token", "before", "after")).alias("t")).select("row", "t.*").join(info, "token", "left")
    singles = singles.select("row", F.coalesce("n", F.lit(0)).alias("n"), class_of("class").alias("now"), F.col("before").cast("int").alias("before"), F.col("after").cast("int").alias("after"))
    n = F.col("n")
    emitted = F.when(F.col("now") < k - 2, F.log10(n / F.element_at(class_total, F.col("now") + 1))).when(n > 0, F.log10((n - model.discount) / left)).otherwise(F.log10(F.lit(unknown)))
    around = F.when(F.col("before") >= 0, transition(F.col("before"), F.col("now"))).otherwise(0.0) + F.when(F.col("after") >= 0, transition(F.col("now"), F.col("after"))).otherwise(0.0)
    tails = singles.groupBy("row").agg(F.sum((n > 0).cast("long")).alias("tail_known"), F.sum(F.log10((n + 0.1) / F.lit(scale))).alias("tail_base"), F.sum(emitted + around).alias("tail_score"))
    of = info.select("token", F.col("class").alias("class_a"))
    pairs = rows.select("row", F.explode(F.arrays_zip("a", "b")).alias("t")).select("row", "t.*")
    pairs = pairs.join(of.withColumnRenamed("token", "a"), "a", "left").join(of.select(F.col("token").alias("b"), F.col("class_a").alias("class_b")), "b", "left")
    met = pairs.groupBy("row").agg(F.sum(transition(class_of("class_a"), class_of("class_b"))).alias("pair_score"))
    joined = rows.drop(*(c for c, _ in lists)).join(tails, "row", "left").join(met, "row", "left")
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("frequent_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("frequent") + F.coalesce("tail_score", F.lit(0.0)) + F.coalesce("pair_score", F.lit(0.0))).alias("score"),
    )


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    training = docs.where(~held_out(F.col("doc_id"), 10, 0))
    counts = stored(token_counts(training), "lm-counts")
    return scored(docs, counts, train(training, counts), 10, 0)
