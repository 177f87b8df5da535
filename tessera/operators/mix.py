"""Mixing sources: exact numbers of rows from each, drawn by weight without replacement.

``shares`` says how many rows each source gives: in proportion to (rows x weight) ^ (1 / temperature), never more than it has, what is left over going to the others,
rounded by largest remainders so that the numbers add up exactly. ``draw`` takes them: a row's key is an exponential number of a hash of seed and row, divided by the row's
weight, and the least keys win, which is weighted sampling without replacement. A first pass counts keys by coarse steps and finds the step in
which the last key taken lies; the second takes all rows below it and ranks only that step's. Neither depends on how the rows are partitioned.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 4096  # of a key, each time it grows e-fold


def allocate(sizes: dict, total: int, temperature: float = 1.0, weights: dict | None = None) -> dict:
    """How many of ``total`` rows each source of ``sizes`` gives. All sources are given in whole if they have no more."""
    if temperature <= 0:
        raise ValueError("the temperature must be above 0")
    weights = weights or {}
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must be 0 or more")
    out = dict.fromkeys(sizes, 0)
    pull = {s: Fraction((n * weights.get(s, 1.0)) ** (1.0 / temperature)) for s, n in sizes.items() if n > 0 and weights.get(s, 1.0) > 0}
    left = max(0, total)
    while pull:  # sources that would give more than they have give all
        whole = sum(pull.values())
        full = [s for s in pull if pull[s] * left >= sizes[s] * whole]
        if not full:
            break
        for s in full:
            out[s] = sizes[s]
            del pull[s]
        left = max(0, total) - sum(out.values())
    whole = sum(pull.values())
    exact = {s: p * left / whole for s, p in pull.items()}
    for s, x in exact.items():
        out[s] = int(x)
    more = left - sum(int(x) for x in exact.values()) if pull else 0
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is None, str(s)))[:more]:
        out[s] += 1
    return out


def shares(df: DataFrame, total: int, source: str = "source", temperature: float = 1.0, weights: dict | None = None) -> dict:
    """``allocate`` for the sources of ``df``; a row a source reaches the driver."""
    return allocate({r[0]: r[1] for r in df.groupBy(source).agg(F.count(F.lit(1))).collect()}, total, temperature, weights)


def draw(df: DataFrame, wanted: dict, key: list[str], source: str = "source", weight: Column | None = None, seed: int = 1) -> DataFrame:
    """Exactly ``wanted[source]`` rows of each source (all it has, if fewer), the columns as they were.

    ``key``: columns that tell rows apart; rows that agree in them are drawn as rows of equal chance all the same, but which of them stays open. ``weight``: of a
    row, above 0 (others, and null, are only taken when nothing else is left); equal by default.
    """
    spark = df.sparkSession
    names = {n: _free(df.columns, n) for n in ("key", "step", "wanted", "last", "rank")}
    kind = df.select(F.col(source)).schema[0].dataType.simpleString()
    asked = spark.createDataFrame([(s, int(n)) for s, n in wanted.items() if n > 0], f"s {kind}, n long")
    w = F.coalesce((F.lit(1.0) if weight is None else weight).cast("double"), F.lit(0.0))
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    number = F.when(w > 0, -F.log(chance) / F.when(w > 0, w)).otherwise(F.lit(float("inf")))
    # keys are above 0, and their logarithms give steps in proportion to them
    step = F.when(number == float("inf"), F.lit(1 << 40)).otherwise(F.floor(F.log(number) * STEPS)).cast("long")
    rows = df.withColumns({names["key"]: number, names["step"]: step})
    counts = rows.groupBy(F.col(source).alias("s"), F.col(names["step"]).alias("step")).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("s").orderBy("step")) - F.col("c")
    edge = counts.alias("c").join(F.broadcast(asked.alias("a")), F.col("c.s").eqNullSafe(F.col("a.s"))).select("c.s", "step", "c", "n")  # a row a source
    edge = edge.withColumn("before", before).where("before < n")  # the steps that give rows
    edge = edge.groupBy("s").agg(F.max(F.struct("step", (F.col("n") - F.col("before")).alias("more"))).alias("last")).select("s", "last.step", "last.more")
    edge = edge.select(F.col("s").alias(names["wanted"]), F.col("step").alias(names["last"]), F.col("more").alias(names["rank"]))
    both = rows.join(F.broadcast(edge), F.col(source).eqNullSafe(F.col(names["wanted"])))  # a row a source
    below = both.where(F.col(names["step"]) < F.col(names["last"])).select(*df.columns)
    place = _free(list(names.values()) + df.columns, "place")
    order = Window.partitionBy(source).orderBy(names["key"], *key)
    at = both.where(F.col(names["step"]) == F.col(names["last"])).withColumn(place, F.row_number().over(order)).where(F.col(place) <= F.col(names["rank"])).select(*df.columns)
    return below.unionByName(at)


def _free(taken: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
