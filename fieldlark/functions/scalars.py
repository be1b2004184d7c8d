"""Column functions for telemetry: rounding, clocks, strict parsing, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Plain decimal or scientific notation, no blanks, no suffix, no special names.
FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DAY = r"^\d{4}-\d\d-\d\d$"
CLOCK = r"^\d\d:\d\d:\d\d(\.\d*)?$"
DECIMAL_IN_TEXT = r"-?\d+\.\d+(?:[eE][+-]?\d+)?"


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value, the same in every engine: floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def utc(ts: Column) -> Column:
    """A timestamp without zone as an instant in UTC (the session's zone)."""
    return ts.cast("timestamp")


def naive(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(utc(ts)) / F.lit(1e6)


def seconds_between(a: Column, b: Column) -> Column:
    """``a`` minus ``b``, exact to the microsecond, as a double."""
    return (F.unix_micros(utc(a)) - F.unix_micros(utc(b))) / F.lit(1e6)


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(utc(a)) - F.unix_micros(utc(b))) / F.lit(6e7)


def hour_label(ts: Column) -> Column:
    """``YYYY-MM-DD HH:00:00`` as text."""
    return F.date_format(ts, "yyyy-MM-dd HH:00:00")


def milliseconds(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", utc(ts))


def iso_millis(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ``."""
    return F.date_format(utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def now_iso() -> Column:
    return iso_millis(F.current_timestamp())


def strict_float(text: Column) -> Column:
    """The number that ``text`` spells, else null; blanks and special names do not count."""
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def strict_int(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def padded_instant(day: Column, clock: Column) -> Column:
    """``day clock`` as text of fixed width: the fraction padded or cut to six digits."""
    second, fraction = F.split_part(clock, F.lit("."), F.lit(1)), F.split_part(clock, F.lit("."), F.lit(2))
    return F.concat(day, F.lit(" "), second, F.lit("."), F.rpad(fraction, 6, "0"))


def strict_instant(day: Column, clock: Column) -> Column:
    """The instant, or null unless both parts have their exact form and exist."""
    return F.when(day.rlike(DAY) & clock.rlike(CLOCK), F.try_to_timestamp(padded_instant(day, clock), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


def comma_decimal(text: Column) -> Column:
    """A number written with a decimal comma; null if it is not one."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def clipped(x: Column, low: float = 0.0) -> Column:
    """At least ``low``; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def no_nan(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def percent(flag: Column) -> Column:
    """Share of true among non-null, in percent (an aggregate)."""
    return F.avg(flag.cast("double")) * 100


def numbers(text: Column, digits: int = 4) -> Column:
    """The distinct decimals in a text, rounded."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DECIMAL_IN_TEXT), 0), lambda n: rounded(n.cast("double"), digits)))


def short_digest(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)
