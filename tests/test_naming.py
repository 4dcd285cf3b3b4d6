"""Stored names against a replay one arrival after another, and running sums against plain ones."""

import itertools
import random

from pyspark.sql import functions as F

from millrace.operators.running import numbered, running_sums, with_ids
from millrace.sources.naming import rename_collisions


def replay(arrivals, old=()):
    taken, looked, out = set(old), {}, []
    for name in arrivals:
        stem, dot, ending = name.rpartition(".") if "." in name else (name, "", "")
        k = looked.get(name, 0)
        while True:
            at = name if k == 0 else f"{stem}_copy{'' if k == 1 else k}{dot}{ending}"
            if at not in taken:
                break
            k += 1
        looked[name] = k  # what is taken stays taken
        taken.add(at)
        out.append(at)
    return out


def stored_names(spark, arrivals, old=()):
    names = spark.createDataFrame(arrivals, "arrival long, name string")
    existing = spark.createDataFrame([(o,) for o in old], "name string") if old else None
    return {r.arrival: r.stored_name for r in rename_collisions(names, existing).collect()}


ENDINGS = ["", "_copy", "_copy2", "_copy3", "_copy5", "_copy_copy", "_copy_copy2", "_copy2_copy", "_copy1", "_copy02", "_copy2_copy2", "_copy_copy_copy", "_copy4"]


def test_a_thousand_histories_of_chained_names(spark):
    rng, rows, old, want = random.Random(5), [], [], {}
    for h in range(1000):
        pool = [f"h{h}x{e}{rng.choice(['.txt', '.pdf']) if h % 7 else ''}" for e in ENDINGS[: rng.randint(1, len(ENDINGS))]]
        arrivals, stored = [rng.choice(pool) for _ in range(rng.randint(0, 25))], rng.sample(pool, rng.randint(0, min(3, len(pool))))
        for i, (name, place) in enumerate(zip(arrivals, replay(arrivals, stored), strict=True)):
            rows.append((1000 * h + i, name))
            want[1000 * h + i] = place
        old += stored
    rng.shuffle(rows)
    assert stored_names(spark, rows, old) == want
    assert len(set(want.values()) | set(old)) == len(want) + len(old)


def test_one_name_with_a_hundred_thousand_arrivals(spark):
    rng = random.Random(2)
    names = ["a.txt"] * 100_000 + [f"a_copy{i}.txt" for i in range(2, 6000, 3)] * 2 + ["a_copy.txt"]
    rng.shuffle(names)
    got = stored_names(spark, list(enumerate(names)))
    assert [got[i] for i in range(len(names))] == replay(names)


def test_names_that_are_null_or_stored_already(spark):
    names = [(1, None), (2, "a.txt"), (3, None), (4, "a_copy.txt"), (5, "b"), (6, "b"), (7, ".txt"), (8, ".txt")]
    assert stored_names(spark, names, ["a.txt", "a_copy.txt", None, "c.txt"]) == {1: None, 2: "a_copy2.txt", 3: None, 4: "a_copy_copy.txt", 5: "b", 6: "b_copy", 7: ".txt", 8: "_copy.txt"}


def test_running_sums_over_one_key_and_many(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), i, rng.randint(-3, 9)) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for by in (["k"], []):
        want = {}
        for _, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]) if by else "", r[1])), key=lambda r: r[0] if by else 0):
            total = 0
            for _, i, v in own:
                want[i] = total
                total += v
        assert {r.i: r.before for r in running_sums(df, by, ["i"], F.col("v")).collect()} == want
    assert sorted(r.nth for r in numbered(df, [], ["i"]).collect()) == list(range(4000))
    assert running_sums(df.limit(0), ["k"], ["i"], F.col("v")).count() == 0


def test_null_ids_are_filled_after_the_largest(spark):
    df = spark.createDataFrame([(3, "c"), (None, "b"), (None, "a"), (7, "d")], "id int, name string")
    assert sorted((r.name, r.id) for r in with_ids(df, ["name"]).collect()) == [("a", 8), ("b", 9), ("c", 3), ("d", 7)]
    assert sorted(r.id for r in with_ids(df.where("id is null"), ["name"]).collect()) == [1, 2] and with_ids(df.limit(0), ["name"]).count() == 0
