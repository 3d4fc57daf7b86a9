"""Display texts."""

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent(value, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _col(value) * 100)


def verdict(prediction) -> Column:
    return F.when(_col(prediction) == 1, "MALICIOUS").otherwise("BENIGN")


def event_class(event) -> Column:
    """Coarse class of an event by its name; the first match wins."""
    event = _col(event)
    return (
        F.when(event.contains("EXEC"), "EXEC")
        .when(event.contains("WRITE"), "WRITE")
        .when(event.contains("READ"), "READ")
        .when(event.contains("SEND"), "SEND")
        .otherwise("OTHER"))


def clock(ts) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def step_weights_text(weights) -> Column:
    """``T1: 20.0% | T2: ...`` from an array of step weights."""
    parts = F.transform(
        _col(weights),
        lambda w, i: F.concat(F.lit("T"), (i + 1).cast("string"), F.lit(": "), percent(w)))
    return F.array_join(parts, " | ")
