"""Classes of numbers within a tolerance, by leaders that are chosen in rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.sources.tables import landed


def leaders(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, seq) of each class's first member. values: by, value (a finite double), seq, tolerance (above 0).

    Going by seq, then value, a value within the tolerance of a leader belongs to the first such class, any other one leads a new
    class. Values fall into cells of half a tolerance, so a cell has one leader at most, and what is within the tolerance
    lies three cells away at most. In each round the first open value of a cell leads if no open value before it is
    within its tolerance; then all that new leaders cover are closed. Every round compares each value with the few
    firsts and leaders of its neighbour cells only, so no class, cell or key is gathered. The first open value of a key always
    leads, and values in no special order need few rounds; a chain of values, each within the tolerance of the one before,
    needs up to one round for every second member.
    """
    around = F.explode(F.sequence(F.col("home") - 3, F.col("home") + 3)).alias("cell")
    here = F.struct("seq", "value")
    open_ = landed(values.select(*by, "tolerance", "seq", "value", F.floor(F.col("value") / (F.col("tolerance") / 2)).alias("cell")), "open-values")
    found = []
    while not open_.isEmpty():
        first = open_.groupBy(*by, F.col("cell").alias("home")).agg(F.min(here).alias("f"), F.first("tolerance").alias("t"))
        near = first.select(*by, "home", "f", around).filter("cell <> home")
        before = open_.join(near, [*by, "cell"]).filter((here < F.col("f")) & (F.abs(F.col("value") - F.col("f.value")) <= F.col("tolerance")))
        new = landed(first.join(before.select(*by, "home").distinct(), [*by, "home"], "left_anti"), "leaders")
        found.append(new.select(*by, F.col("f.value").alias("value"), F.col("f.seq").alias("seq")))
        cover = new.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("f.value").alias("leader"), around.alias("at"))
        same = [F.col(c) == F.col(f"{c}_of") for c in by] + [F.col("cell") == F.col("at"), F.abs(F.col("value") - F.col("leader")) <= F.col("tolerance")]
        open_ = landed(open_.join(cover, reduce(lambda a, b: a & b, same), "left_anti"), "open-values")
    return reduce(DataFrame.unionByName, found) if found else values.select(*by, "value", "seq").limit(0)
