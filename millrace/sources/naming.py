"""Stored names of arriving files: the first free of x.txt, x_copy.txt, x_copy2.txt and so on, in order of arrival.

Arrivals of one name stand in line for its places 0, 1, 2, ...; place k of x.txt is the name x_copyk.txt, which may also
arrive as it is.  So a place has two claimants only: the line of the name it is derived from, and the first arrival of the
very name.  In a line the place that the next arrival looks at never goes down, therefore place k is passed over if and
only if it is stored already or its own name arrived before the arrival that stands at it, which is so if no more than
``k - 1 - (arrivals of the line before that)`` places were passed over before.  Only places that are claimed twice need
this rule, one after another; all other arrivals follow from counts of what was passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_sums
from ..scratch import stored

#: A derived name: the stem and ending it comes from and, from the second copy on, the copy's number.
DERIVED = r"^(.*)_copy([2-9]|[1-9][0-9]{1,8})?((?:\.[^.]*)?)$"


def _derivation(name: str) -> tuple:
    """The name that ``name`` is derived from (null if from none), and its place there."""
    n = F.col(name)
    parent = F.when(n.rlike(DERIVED), F.concat(F.regexp_extract(n, DERIVED, 1), F.regexp_extract(n, DERIVED, 3)))
    number = F.regexp_extract(n, DERIVED, 2)
    return parent, F.when(number == "", 1).otherwise(number.try_cast("long")).cast("long")


def root_of(name: str):
    """The name that ``name`` derives from in the end: names of other roots never meet it."""
    return F.regexp_replace(name, r"(_copy([2-9]|[1-9][0-9]{1,8})?)+((?:\.[^.]*)?)$", "$3")


def _place(name: str, place: str):
    suffix = F.when(F.col(place) == 1, "_copy").otherwise(F.concat(F.lit("_copy"), F.col(place).cast("string")))
    ending = F.regexp_extract(name, r"(\.[^.]*)?$", 0)
    stem = F.expr(f"left({name}, length({name}) - length(regexp_extract({name}, '([.][^.]*)?$', 0)))")
    return F.when(F.col(place) == 0, F.col(name)).otherwise(F.concat(stem, suffix, ending))


def _passed_over(batches) -> Iterator[pa.RecordBatch]:
    """Which claimed places a line passes over; rows come by line and place, and only a count is kept."""
    line, passed = None, 0
    for batch in batches:
        over, before = [], []
        for name, limit in zip(batch.column("line").to_pylist(), batch.column("limit").to_pylist(), strict=True):
            if name != line:
                line, passed = name, 0
            over.append(limit is None or passed <= limit)
            before.append(passed)
            passed += over[-1]
        yield pa.RecordBatch.from_arrays([batch.column("line"), batch.column("place"), batch.column("claim"), pa.array(over), pa.array(before, pa.int64())], names=["line", "place", "claim", "over", "before"])


def rename_collisions(names: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds stored_name to (arrival, name), arrivals being different; ``existing`` (name) are stored already.

    Lines are settled from the outside in: x.txt before x_copy.txt before x_copy_copy.txt, a round for each depth that
    occurs.  Arrivals are numbered and counted in levels, however many share a name; a line's claimed places pass through
    one task, three numbers each, of which it keeps one.  A null name stays null; a name without an ending is derived
    without one.
    """
    spark = names.sparkSession
    rows = names.where("name is not null")
    old = (existing.select("name").where("name is not null").distinct() if existing is not None else spark.createDataFrame([], "name string")).select(F.col("name").alias("old"))
    lines = stored(rows.groupBy("name").agg(F.min("arrival").alias("first")), "lines")
    parent, place = _derivation("claim")
    # what else claims a place of a line: the first arrival of the very name, or a stored file (without a time)
    claims = lines.join(old, F.col("name") == F.col("old"), "left_anti").select(F.col("name").alias("claim"), F.col("first").alias("time")).unionByName(old.select(F.col("old").alias("claim"), F.lit(None).cast(lines.schema["first"].dataType).alias("time")))
    claims = claims.select("claim", "time", parent.alias("line"), place.alias("place")).where("line is not null")
    claims = claims.join(lines.select(F.col("name").alias("line")), "line", "left_semi")
    # arrivals of the line before each claim, and the number of each arrival in its line: one running count
    marks = rows.select(F.col("name").alias("line"), F.col("arrival").alias("at"), F.lit(1).alias("arrived"), F.lit(None).cast("string").alias("claim"))
    timed = claims.where("time is not null").select("line", F.col("time").alias("at"), F.lit(0).alias("arrived"), "claim")
    counted = stored(running_sums(marks.unionByName(timed), ["line"], ["at"], F.col("arrived"), "nth"), "arrivals")
    reached = counted.where("arrived = 0").select("claim", F.col("nth").alias("earlier"))
    claims = stored(claims.join(reached, "claim", "left"), "claims")

    # lines whose own name is taken when their first arrival comes: stored, or claimed by the line it derives from
    own = lines.join(old, F.col("name") == F.col("old"), "left").select("name", F.col("old").isNotNull().alias("taken"))
    inner = claims.where("time is not null").select(F.col("claim").alias("name"))
    known = stored(own.join(inner, "name", "left_anti"), "taken")
    settled, passed = [known], []
    while True:
        here = claims.join(known.select(F.col("name").alias("line"), "taken"), "line")
        limit = F.when(F.col("time").isNotNull(), F.col("place") - 1 - F.when(F.col("taken"), F.col("earlier")).otherwise(F.greatest(F.col("earlier") - 1, F.lit(0))))
        sorted_claims = here.select("line", "place", limit.alias("limit"), F.when(F.col("time").isNotNull(), F.col("claim")).alias("claim")).repartition("line").sortWithinPartitions("line", "place")
        told = stored(sorted_claims.mapInArrow(_passed_over, "line string, place long, claim string, over boolean, before long"), "passed-over")
        passed.append(told.where("over").select("line", (F.col("place") - F.col("before")).alias("at")))
        known = told.where("claim is not null").select(F.col("claim").alias("name"), (~F.col("over")).alias("taken"))
        if known.isEmpty():
            break
        settled.append(known)
    taken, over = settled[0], passed[0]
    for df in settled[1:]:
        taken = taken.unionByName(df)
    for df in passed[1:]:
        over = over.unionByName(df)

    # the n-th in line stands at its number plus the places passed over up to there
    numbered = counted.where("arrived = 1").join(taken.select(F.col("name").alias("line"), "taken"), "line").select("line", F.col("at").alias("arrival"), F.when(F.col("taken"), F.col("nth") + 1).otherwise(F.col("nth")).alias("stand"))
    events = numbered.select("line", F.col("stand").alias("at"), F.lit(1).alias("kind"), "arrival", F.lit(0).alias("gap")).unionByName(over.select("line", "at", F.lit(0).alias("kind"), F.lit(None).cast(names.schema["arrival"].dataType).alias("arrival"), F.lit(1).alias("gap")))
    moved = running_sums(events, ["line"], ["at", "kind"], F.col("gap"), "shift").where("kind = 1")
    placed = moved.select(F.col("line").alias("_line"), F.col("arrival").alias("_arrival"), F.when(F.col("at") == 0, 0).otherwise(F.col("at") + F.col("shift")).alias("_place"))
    named = rows.join(placed, (F.col("name") == F.col("_line")) & (F.col("arrival") == F.col("_arrival"))).withColumn("stored_name", _place("name", "_place"))
    return named.select(*names.columns, "stored_name").unionByName(names.where("name is null").withColumn("stored_name", F.lit(None).cast("string")))
