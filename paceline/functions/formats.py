"""Keys, labels and units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TARGET_MS = 20.0 / 3.6
MAX_TARGET_MS = 30.0
FEET_PER_METRE = 3.280839895
METRES_PER_MILE = 1609.344


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def mmss(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def gap_status(gap_s: Column, dead_band_s: float = 1.0) -> Column:
    """Negative is ahead; within the dead band neutral."""
    return F.when(F.abs(gap_s) < dead_band_s, "NEUTRAL").when(gap_s < 0, "AHEAD").otherwise("BEHIND")


def gap_time(seconds: Column) -> Column:
    """M:SS or H:MM:SS; ahead shows +, behind -, neutral no sign, no value ---."""
    s = F.abs(seconds).cast("bigint")
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    status = gap_status(seconds)
    sign = F.when(status == "NEUTRAL", "").when(status == "AHEAD", "+").otherwise("-")
    return F.when(~finite(seconds), "---").otherwise(F.concat(sign, F.when(s >= 3600, long).otherwise(short)))


def gap_distance(metres: Column, imperial: bool = False) -> Column:
    """Rounded once, in the unit shown; ahead is positive."""
    v = F.floor((metres * FEET_PER_METRE if imperial else metres) + 0.5).cast("bigint")
    sign = F.when(v == 0, "").when(v > 0, "+").otherwise("-")
    return F.when(~finite(metres), "---").otherwise(F.concat(sign, F.abs(v).cast("string"), F.lit(" ft" if imperial else " m")))


def window_fraction(gap_m: Column, gap_s: Column, window_m: float) -> Column:
    """The ghost's place in a window, -1 to 1."""
    inside = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -gap_m / window_m))
    return F.when(finite(gap_m), inside).when(gap_s > 0, 1.0).otherwise(0.0)


def target_ms(raw: Column) -> Column:
    return F.when(finite(raw) & (raw > 0) & (raw <= MAX_TARGET_MS), raw).otherwise(DEFAULT_TARGET_MS)


def source_key(started_ms: Column, metres: Column) -> Column:
    """Minute of the start and ten-metre bucket of the length, both truncated."""
    return F.concat(F.floor(started_ms / 60_000).cast("bigint").cast("string"), F.lit(":"), (metres / 10).cast("bigint").cast("string"))


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of a string of BMP letters."""
    letters = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    wrapped = F.aggregate(letters, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32)))
    return F.when(wrapped >= 2**31, wrapped - 2**32).otherwise(wrapped)


def route_key(name: Column, length_m: Column) -> Column:
    """Letters and digits of the name, and the length to 100 m; a name without
    any has its hash instead, a blank one the word route."""
    slug = F.substring(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), 1, 64)
    raw = F.btrim(name)
    hashed = F.concat(F.lit("route-"), F.lower(F.hex(F.pmod(string_hash(raw), F.lit(2**32)))))
    stem = F.when(slug != "", slug).when(raw == "", "route").otherwise(hashed)
    return F.concat(stem, F.lit("_"), (F.floor(length_m / 100 + 0.5) * 100).cast("bigint").cast("string"))


def kmh(ms: Column) -> Column:
    return ms * 3.6


def mph(ms: Column) -> Column:
    return ms * 3600.0 / METRES_PER_MILE


def from_kmh(v: Column) -> Column:
    return v / 3.6


def from_mph(v: Column) -> Column:
    return v * METRES_PER_MILE / 3600.0


def min_per_km(ms: Column) -> Column:
    """Minutes a kilometre; the same turns a pace into m/s. 0 when not moving."""
    return F.when(ms > 0, 1000.0 / (ms * 60.0)).otherwise(0.0)


def min_per_mile(ms: Column) -> Column:
    return F.when(ms > 0, METRES_PER_MILE / (ms * 60.0)).otherwise(0.0)


def behind_metres(deficit_s: Column, tpm: Column) -> Column:
    """Metres behind for a deficit in seconds, at a pace; null without one."""
    return F.when((tpm > 0) & (tpm < float("inf")), -deficit_s / tpm)


def redacted(text: Column) -> Column:
    """A log line without coordinates and names: what follows lat= or lng=, route and profile names, quoted names."""
    t = F.regexp_replace(text, r"(lat|lng)=-?\d+([.,]\d+)?", "$1=•")
    t = F.regexp_replace(t, r"name=.*?(?= routeLen=)", "name=•")
    t = F.regexp_replace(t, r"(active profile: id=\S+ name=).*", "$1•")
    return F.regexp_replace(t, r"\b(on|for) '[^']*'", "$1 '•'")


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON text as a struct: unknown fields are passed over, missing or unfit ones are null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})


def render_key(gap_s: Column, gap_m: Column, active: Column, estimated: Column, imperial: Column) -> Column:
    """What of a gap can be seen, as a struct: status, whole seconds and whole units of the distance shown."""
    whole = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(-(2**31))).otherwise(c.cast("int"))
    shown = F.when(imperial, gap_m * FEET_PER_METRE).otherwise(gap_m)
    pick = lambda c, rest: F.when(active, c).otherwise(rest)
    return F.struct(
        active.alias("active"), pick(estimated, F.lit(False)).alias("estimated"), pick(gap_status(gap_s), F.lit("NEUTRAL")).alias("status"),
        pick(whole(gap_s), F.lit(0)).alias("time_s"), pick(whole(shown), F.lit(0)).alias("distance"), imperial.alias("imperial"),
    )
