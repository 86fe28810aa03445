"""Exact quantiles of any column over all rows, by rounds of histograms instead of one sorted list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds, save

#: Buckets of a round, and values of an interval that are few enough to be sorted.
BUCKETS, FEW = 1024, 4096


def exact_quantiles(rows: DataFrame, value: str, by: tuple[str, ...], shares: tuple[float, ...], upper: bool = False) -> DataFrame:
    """(*by, share, quantile): quantiles of each group, linear between neighbours, or with ``upper`` the value at place floor(share n).

    A quantile lies between two places of the sorted values. Each round counts the values of the interval that holds a place in BUCKETS equal parts, with
    partial sums only, and goes on with the part that holds it, cut to its least and greatest value. Values are sorted once FEW are left; an interval of
    one value needs no sorting, however often it occurs. Nulls don't count.
    """
    shares = tuple(float(x) for x in shares)
    base = save(rows.select(*by, F.lit(0).alias("all"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"), "values")
    keys = [*by, "all"]
    span = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor(F.col("share") * F.col("n")), F.col("n") - 1).cast("double") if upper else F.col("share") * (F.col("n") - 1)
    asked = span.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", at)
    asked = asked.withColumn("place", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    # what lies ahead of the interval, and in it
    rounds = Rounds(base.sparkSession, "places")
    state = ("n", "lo", "hi", "ahead")
    open_places = rounds.put(asked.select(*keys, "share", "at", "place", "n", "lo", "hi", F.lit(0).cast("long").alias("ahead")))
    same = [*keys, "share", "at", "place"]
    joined = lambda places: base.join(places, [base[k].eqNullSafe(places[k]) for k in keys]).select(base["v"], *[places[c] for c in (*same, *state)]).where(F.col("v").between(F.col("lo"), F.col("hi")))
    wide = (F.col("n") > FEW) & (F.col("lo") < F.col("hi"))
    while not open_places.where(wide).isEmpty():
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        counted = joined(open_places.where(wide)).groupBy(*same, "ahead", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*same).orderBy("part"))
        placed = counted.withColumn("upto", F.col("ahead") + upto).withColumn("ahead", F.col("upto") - F.col("n"))
        chosen = placed.where((F.col("ahead") <= F.col("place")) & (F.col("place") < F.col("upto"))).select(*same, *state)
        open_places = rounds.put(chosen.unionByName(open_places.where(~wide)))
    single = open_places.where("lo = hi").select(*same, F.col("lo").alias("found"))
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("v")) - 1 + F.col("ahead")
    several = joined(open_places.where("lo < hi")).withColumn("rank", rank).where("rank = place").select(*same, F.col("v").alias("found"))
    ends = single.unionByName(several).groupBy(*keys, "share", "at").agg(F.min_by("found", "place").alias("low"), F.max_by("found", "place").alias("high"))
    between = F.col("low") + (F.col("at") - F.floor("at")) * (F.col("high") - F.col("low"))
    return save(ends.select(*by, "share", between.alias("quantile")), "quantiles")


def with_medians(grouped: DataFrame, rows: DataFrame, by: tuple[str, ...], medians: dict[str, str]) -> DataFrame:
    """``grouped`` (one row for each value of ``by``; one row without) with the exact medians of columns of ``rows``: {new name: column}."""
    for name, column in medians.items():
        found = exact_quantiles(rows, column, by, (0.5,)).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("quantile").alias(name))
        # medians are one row a group
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] if by else F.lit(True)
        grouped = grouped.join(found, on, "left").drop(*[f"_{k}" for k in by])
    return grouped
