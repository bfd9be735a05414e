"""Cleaning, casting and pricing expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.spans import FIXED_UNITS, parse_span


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A plain decimal number, which keeps out Java-only spellings such as "1d" or "0x1p3".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MONDAY_EPOCH_MICROS = -3 * FIXED_UNITS["d"]  # 1969-12-29, the Monday before the epoch


def to_numeric_coerce(c: Column | str, digits: int | None = 2) -> Column:
    """Text to double; anything that is not a number becomes null. Halves round to even."""
    c = _col(c).cast("string")
    value = F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))
    return value if digits is None else F.bround(value, digits)


def to_int_fill(c: Column | str, fill: int = 0) -> Column:
    """Text to long, cutting off decimals; anything that is not a number becomes ``fill``."""
    text = _col(c).cast("string")
    # Only whole numbers are tried: a failed attempt costs far more than the look at the text.
    exact = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint"))
    via_double = to_numeric_coerce(text, None).try_cast("bigint")
    return F.coalesce(exact, via_double, F.lit(fill).cast("bigint"))


def to_date(c: Column | str) -> Column:
    """The calendar day of a timestamp."""
    return F.to_date(_col(c))


def null_non_finite(c: Column | str) -> Column:
    """NaN and the infinities become null."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def iso_string(c: Column | str, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") -> Column:
    """A timestamp as ISO-8601 text."""
    return F.date_format(_col(c), pattern)


# The two timestamp spellings live tables are read back in, the first with
# fractional seconds, both followed by a zone offset.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS xx", "yyyy-MM-dd HH:mm:ss xx")


def parse_timestamps(c: Column | str, formats: Sequence[str] = TIMESTAMP_FORMATS, on_error: str = "raise") -> Column:
    """Text to timestamp by the first format that fits.

    ``on_error="raise"`` fails the job on text none fits, ``"null"`` keeps going.
    """
    c = _col(c)
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    if on_error == "null":
        return parsed
    if on_error != "raise":
        raise ValueError("on_error is 'raise' or 'null'")
    message = F.concat(F.lit("no timestamp format fits: "), c)
    return F.when(c.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("timestamp"))


def epoch_ms(c: Column | str) -> Column:
    return F.unix_millis(_col(c).cast("timestamp"))


def epoch_ns(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp")) * F.lit(1000).cast("bigint")


def from_epoch_ms(c: Column | str) -> Column:
    return F.timestamp_millis(_col(c))


def from_epoch_ns(c: Column | str) -> Column:
    """Nanoseconds to a timestamp, which holds microseconds: the last three digits are cut off."""
    return F.timestamp_micros(_floor_div(_col(c), 1000))


def _floor_div(c: Column, n: int) -> Column:
    """Whole-number division towards minus infinity, exact for any long."""
    n_lit = F.lit(n).cast("bigint")
    return F.call_function("div", c - F.pmod(c, n_lit), n_lit)


def local_to_utc(c: Column | str, zone: str) -> Column:
    """Wall-clock time in ``zone`` to UTC."""
    return F.to_utc_timestamp(_col(c).cast("timestamp"), zone)


def bucket(c: Column | str, span: str, dtype: str = "timestamp") -> Column:
    """The start of the interval a timestamp falls into.

    Fixed lengths count from the epoch (weeks from a Monday), months and years from the calendar.
    ``dtype`` is the type to return, ``timestamp`` or ``timestamp_ntz``.
    """
    months, micros = parse_span(span)
    if (months > 0) == (micros > 0):
        raise ValueError(f"a bucket is either fixed-length or in months: {span!r}")
    ts = _col(c).cast("timestamp")
    if micros > 0:
        origin = MONDAY_EPOCH_MICROS if micros % FIXED_UNITS["w"] == 0 else 0
        at = F.unix_micros(ts)
        start = at - F.pmod(at - F.lit(origin).cast("bigint"), F.lit(micros).cast("bigint"))
        return F.timestamp_micros(start).cast(dtype)
    index = F.year(ts) * 12 + F.month(ts) - 1
    first = index - F.pmod(index, F.lit(months))
    return F.make_date(F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1)).cast(dtype)


def slug(c: Column | str) -> Column:
    """Lower case with underscores for spaces."""
    return F.replace(F.lower(_col(c)), F.lit(" "), F.lit("_"))


def spread(bid: Column | str, ask: Column | str) -> Column:
    return _col(ask) - _col(bid)


def mid(bid: Column | str, ask: Column | str) -> Column:
    return (_col(bid) + _col(ask)) / 2


def notional(price: Column | str, volume: Column | str) -> Column:
    return _col(price) * _col(volume)


def trade_count(volume: Column | str, lot: float) -> Column:
    """Whole lots in a volume."""
    return F.floor(_col(volume) / F.lit(lot)).cast("bigint")


def side_from_sign(qty: Column | str) -> Column:
    """BUY for a positive quantity, else SELL."""
    return F.when(_col(qty) > 0, "BUY").otherwise("SELL")


def fill_price(side: Column | str, bid: Column | str, ask: Column | str, slip: Column | str) -> Column:
    """Buyers pay the ask plus the slip, sellers get the bid minus it."""
    buys = _col(side) == "BUY"
    return F.when(buys, _col(ask) + _col(slip)).otherwise(_col(bid) - _col(slip))


def limit_price(side: Column | str, price: Column | str, margin: Column | str) -> Column:
    """A limit above the price for a buyer and below it for a seller, by a relative margin."""
    buys = _col(side) == "BUY"
    return F.when(buys, _col(price) * (F.lit(1.0) + _col(margin))).otherwise(_col(price) * (F.lit(1.0) - _col(margin)))


def current(power: Column | str, voltage: Column | str) -> Column:
    """Power over voltage; null where the voltage is zero."""
    return F.try_divide(_col(power).cast("double"), _col(voltage).cast("double"))


def state_of_charge(level: Column | str) -> Column:
    return F.lit(60) + _col(level)


def renewable_power(base: Column | str, level: Column | str) -> Column:
    return _col(base) + _col(level) * F.lit(1000)


SESSION_OPEN_SECONDS = 9 * 3600 + 1800   # 09:30
SESSION_SECONDS = 6 * 3600 + 1800        # to 16:00


def session_timestamp(day: Column | str, draw: Column) -> Column:
    """A moment of the trading session 09:30 to 16:00 on ``day``, to the second, chosen by a hash."""
    second = F.pmod(draw, F.lit(SESSION_SECONDS + 1).cast("bigint"))
    start = F.unix_micros(_col(day).cast("date").cast("timestamp"))
    offset = (second + F.lit(SESSION_OPEN_SECONDS)) * F.lit(1_000_000).cast("bigint")
    return F.timestamp_micros(start + offset)


def stagger_timestamp(ts: Column | str, position: Column | str, count: int, interval: str) -> Column:
    """Spread ``count`` series over one frame: the i-th (from 0) is moved by interval/count*i."""
    months, micros = parse_span(interval)
    if months or micros <= 0 or count < 1:
        raise ValueError("need a positive fixed interval and at least one series")
    step = micros / count
    moved = F.unix_micros(_col(ts).cast("timestamp")) + F.round(_col(position) * F.lit(step)).cast("bigint")
    return F.timestamp_micros(moved)
