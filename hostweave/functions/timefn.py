"""Time-zone-free arithmetic on naive (NTZ) timestamps.

Every helper works on the wall-clock value itself, so results do not depend on
``spark.sql.session.timeZone``.
"""

from pyspark.sql import Column, functions as F

DAY_SECONDS = 86_400


def _epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def floor_div(value: Column, width: int) -> Column:
    """Whole-number division rounding down, without a detour through doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def to_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    since = ts - _epoch()
    whole = since.cast("bigint")
    # Whole seconds and the rest separately: both stay exact without wide decimals.
    rest = (since - whole * F.expr("interval '1' second")).cast("decimal(18,6)").cast("double")
    return whole * 1_000_000 + F.rint(rest * 1_000_000).cast("bigint")


def from_micros(micros) -> Column:
    micros = F.col(micros) if isinstance(micros, str) else micros
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def floor_to(ts, seconds: int) -> Column:
    """Start of the ``seconds``-wide bin (aligned to the epoch) holding ``ts``."""
    micros = to_micros(ts)
    return from_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def nanos_to_local(nanos, zone: str = "America/New_York") -> Column:
    """UTC nanoseconds to naive wall-clock time in ``zone``."""
    nanos = F.col(nanos) if isinstance(nanos, str) else nanos
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), from_micros(floor_div(nanos, 1000)))


def seconds_of_day(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
