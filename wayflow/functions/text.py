"""Column expressions that put results into words, and small lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def oneway_flag(oneway: Column, junction: Column, hw: Column) -> Column:
    """1 along, -1 against, 0 both ways, from map tags. Roundabouts and motorways are one-way unless the tag says no."""
    said = F.lower(F.coalesce(oneway, F.lit("")))
    implied = F.coalesce(junction.isin("roundabout", "circular"), F.lit(False)) | F.coalesce(hw.isin("motorway", "motorway_link"), F.lit(False))
    return F.when(said.isin("yes", "true", "1"), 1).when(said.isin("-1", "reverse"), -1).when(implied & (said != "no"), 1).otherwise(0)


def lane_count(tag: Column, rank: Column, oneway: Column) -> Column:
    """Lanes of a direction: the tag's number before a semicolon, halved for both directions (one at least); without a number by rank."""
    said = F.trim(F.substring_index(F.coalesce(tag, F.lit("")), ";", 1)).try_cast("double").cast("int")
    half = F.greatest(F.lit(1), F.floor(said / 2).cast("int"))
    return F.when(said > 0, F.when(oneway, said).otherwise(half)).otherwise(F.when(rank <= 1, 3).when(rank <= 3, 2).otherwise(1))


def next_occurrence(hour: Column, now: Column) -> Column:
    """Seconds from ``now`` (seconds past midnight) to a bare hour 1-11, morning or evening, whichever comes first."""
    wait = lambda h: F.pmod(h * 3600 - now, F.lit(86400))
    return F.least(wait(hour), wait(hour + 12))


def advisory(saving_s: Column, eta_gap_s: Column, avoids: Column, reliability: Column) -> Column:
    """Clauses that apply, joined."""
    clauses = F.array(
        F.when(saving_s > 60, F.concat(F.lit("saves "), F.round(saving_s / 60).cast("int").cast("string"), F.lit(" min"))),
        F.when(eta_gap_s > 90, F.lit("others promise too early")),
        F.when(avoids, F.lit("avoids an incident")),
        F.when(reliability > 0.90, F.lit("very predictable")).when(reliability < 0.75, F.lit("could vary a lot")),
    )
    return F.concat_ws("; ", F.filter(clauses, lambda c: c.isNotNull()))


def profile_style(risk: Column) -> Column:
    return F.when(risk > 1.2, "plays it safe").when(risk > 0.5, "balanced").otherwise("fastest")
