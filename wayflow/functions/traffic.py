"""Column expressions of calibration and traffic state."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEAST_KPH, STALE_S


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def congestion_from_count(count: Column, quiet: Column, busy: Column) -> Column:
    """Place of a count between a sensor's quiet and busy levels, 0 to 1; null without a usable baseline."""
    return F.when(busy - quiet >= 0.5, clip((count - quiet) / (busy - quiet), 0.0, 1.0))


def reading_to_congestion(count: Column, tracks: Column, moving: Column, quiet: Column, busy: Column) -> Column:
    """Busy and stalled shares in one figure. Null means unknown: too few detections and no baseline."""
    by_count = congestion_from_count(count, quiet, busy)
    stalled = 1 - F.coalesce(moving, F.lit(1.0))
    both = F.when(by_count.isNull(), clip(stalled, 0.0, 1.0)).otherwise(clip(0.45 * by_count + 0.55 * stalled, 0.0, 1.0))
    return F.when((F.coalesce(tracks, F.lit(0)) < 2) | (count < 0.5), by_count).otherwise(both)


def congested_kph(free: Column, congestion: Column, drop: float = 0.80) -> Column:
    return F.greatest(F.lit(LEAST_KPH), free * (1 - drop * congestion))


def reading_confidence(age: Column, tracks: Column, stale_s: float = STALE_S) -> Column:
    fresh = F.greatest(F.lit(0.0), 1 - age / stale_s)
    return clip(0.35 + 0.45 * fresh + 0.05 * F.least(tracks, F.lit(4)), 0.15, 0.95)


def edge_congestion(kph: Column, free: Column) -> Column:
    return clip(1 - kph / F.greatest(free, F.lit(1.0)), 0.0, 1.0)


def traffic_level(ratio: Column) -> Column:
    """0 (clear) to 3 (jammed) from speed over free flow."""
    congestion = (1 - ratio) / 0.8
    return sum(((congestion >= cut).cast("int") for cut in (0.30, 0.52, 0.72)), F.lit(0))


def mood(ratio: Column) -> Column:
    return F.when(ratio > 0.75, "clear").when(ratio > 0.55, "busy").when(ratio > 0.35, "slow").otherwise("jammed")


def junction_delay(kph: Column, free: Column, weight: Column) -> Column:
    """Seconds lost at a junction, by how far below free flow its approach is."""
    s = clip(1 / clip(kph / F.greatest(free, F.lit(1.0)), 0.05, 1.0) - 1, 0.0, 3.0)
    return (12 + 83 * s * s / (1 + s * s)) * weight


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(d) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def ground_distance(ya: Column, xa: Column, yb: Column, xb: Column, height: Column, width: Column, horizon: float = 0.18, near_m: float = 50.0, near_width_m: float = 35.0, trim: float = 1.0) -> Column:
    """Metres on a flat road between two points of a frame: along it the difference of their depths, across it by the scale at the depth of their middle row."""
    # share of the bottom row's depth; rows near the horizon are held at 4 % of the height below it
    depth = lambda y: (1 - horizon) * height / F.greatest(y - horizon * height, 0.04 * height)
    along = near_m * (depth(yb) - depth(ya))
    across = (xb - xa) * near_width_m / F.greatest(width, F.lit(1.0)) * depth((ya + yb) / 2)
    return trim * F.sqrt(along * along + across * across)


def local_clock(t: Column, zone: str = "UTC") -> Column:
    """Local wall-clock time without a zone of unix seconds."""
    at = F.timestamp_micros((t * 1000000).cast("bigint"))
    return F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz"))


def tod_bucket(t: Column, minutes: int, zone: str = "UTC") -> Column:
    """Number of the local time-of-day bucket of unix seconds."""
    clock = local_clock(t, zone)
    return F.floor((F.hour(clock) * 60 + F.minute(clock)) / minutes).cast("int")


def eta_percentile(mean: Column, sd: Column, z: float) -> Column:
    """Percentile of a log-normal travel time."""
    cv2 = F.pow(sd / mean, 2)
    return mean / F.sqrt(1 + cv2) * F.exp(z * F.sqrt(F.log1p(cv2)))


def roll_departure(clock: Column, now: Column, slack: float = 600.0, day: float = 86400.0) -> Column:
    """A clock time well before now means tomorrow's."""
    return F.when(clock < now - slack, clock + day).otherwise(clock)


def format_clock(seconds: Column) -> Column:
    m = F.floor(F.pmod(seconds, F.lit(86400)) / 60)
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def parse_clock(text: Column, default: float = 32400.0) -> Column:
    """The first clock time in a text ('8:45', '0845', '8.45am', 'at 9h30', '7pm') as seconds past midnight; otherwise the default."""
    s = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("."), F.lit(":"))
    h, m, half = (F.regexp_extract(s, r"(\d{1,2})[:h ]?(\d{2})?\s*(am|pm)?", i) for i in (1, 2, 3))
    hour = h.try_cast("int")
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    seconds = F.least(hour, F.lit(23)) * 3600 + F.least(F.coalesce(m.try_cast("int"), F.lit(0)), F.lit(59)) * 60
    return F.coalesce(F.when(h != "", seconds.cast("double")), F.lit(default))


@functools.cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters of the basic plane whose compatibility form has ASCII characters: those with one, its partners, and those with several."""
    one, to, more = [], [], {}
    for code in range(0x80, 0x10000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(code))
            to.append(plain)
        elif plain:
            more[chr(code)] = plain
    return "".join(one), "".join(to), more


def plain_ascii(text: Column) -> Column:
    """ASCII of the compatibility decomposition: accents fold, what has no ASCII form is dropped."""
    one, to, more = _plain_letters()
    table = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    spelt = F.when(text.rlike("[" + "".join(more) + "]"), each).otherwise(text)
    folded = F.regexp_replace(F.translate(spelt, one, to), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def normalise_name(text: Column) -> Column:
    """Lower case without accents, each run of other characters than letters, digits and blanks a blank; names in other scripts keep their letters, marks and numbers."""
    whole = F.coalesce(text, F.lit(""))
    key = F.trim(F.regexp_replace(F.lower(plain_ascii(whole)), "[^a-z0-9 ]+", " "))
    kept = F.trim(F.regexp_replace(F.lower(whole), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(key != "", key).otherwise(kept)


def sound_key(text: Column) -> Column:
    """Spelling folded to sound: soft c, hard c/ck/q, ph, an h that no vowel follows; doubled letters and blanks go."""
    x = normalise_name(text)
    for rule, put in ((r"c(?=[eiy])", "s"), (r"ck|c|q", "k"), ("ph", "f"), (r"h(?![aeiou])", ""), (r"(.)\1+", "$1"), (" ", "")):
        x = F.regexp_replace(x, rule, put)
    return x
