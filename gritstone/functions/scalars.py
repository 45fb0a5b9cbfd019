"""Scalar functions, all of Spark's own expressions. Times are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .visibility import millis

UNITS = {"MINUTES": "minute", "HOURS": "hour", "DAYS": "day", "MONTHS": "month"}
BUCKETS = {"FIVE_MINS": 300_000, "TEN_MINS": 600_000, "FIFTEEN_MINS": 900_000, "HALF_HOUR": 1_800_000, "HOUR": 3_600_000, "DAY": 86_400_000}
MAX_LONG = (1 << 63) - 1


def truncate(unit: str, ts: Column) -> Column:
    """The beginning of the minute, hour, day or month."""
    return F.date_trunc(UNITS[unit], ts).cast("timestamp_ntz")


def reverse_millis(unit: str, ts: Column) -> Column:
    """A number that sorts later times first."""
    return F.lit(MAX_LONG) - millis(truncate(unit, ts))


def from_reverse_millis(number: Column) -> Column:
    """Milliseconds of a reversed time."""
    return F.lit(MAX_LONG) - number


def bucket_floor(ts: Column, size_ms: int = BUCKETS["FIVE_MINS"]) -> Column:
    """Milliseconds of the bucket's beginning."""
    at = millis(ts)
    return at - F.pmod(at, F.lit(size_ms))


def reverse_digits(ts: Column) -> Column:
    """Eighteen digits that sort later times first: all nines less ``yyyyMMddHHmmssSSS``."""
    return F.lit(999_999_999_999_999_999) - F.date_format(ts, "yyyyMMddHHmmssSSS").cast("bigint")


def from_reverse_digits(number: Column) -> Column:
    """The time of such a number, to the millisecond."""
    digits = F.lpad((F.lit(999_999_999_999_999_999) - number).cast("string"), 17, "0")
    return F.to_timestamp_ntz(F.concat(F.substring(digits, 1, 14), F.lit("."), F.substring(digits, 15, 3)), F.lit("yyyyMMddHHmmss.SSS"))


def url_pairs(url: Column) -> Column:
    """The query string of a URL as an array of decoded (key, value); a key may come several times."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), F.url_decode(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("value")))


def full_match(value: Column, pattern: str) -> Column:
    """Whether the whole value matches, line feeds included; a null matches nothing."""
    return F.coalesce(value.rlike(f"(?s)^(?:{pattern})$"), F.lit(False))


def as_number(value: Column) -> Column:
    """A double, or null where the text is none."""
    return value.try_cast("double")


def as_boolean(value: Column) -> Column:
    """A boolean, or null where the text is none."""
    return value.try_cast("boolean")


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Z-order number of a point in degrees: the cell numbers' bits, those of x first."""
    size = 1 << bits
    cx = F.least(F.floor((x + 180) / 360 * size), F.lit(size - 1)).cast("bigint")
    cy = F.least(F.floor((y + 90) / 180 * size), F.lit(size - 1)).cast("bigint")
    return spread_bits(cx).bitwiseOR(F.shiftleft(spread_bits(cy), 1))


def spread_bits(n: Column) -> Column:
    """The bits of a number of up to 32 bits with a zero between any two: halves are moved apart, then quarters, and so on."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def metadata(meta: Column, key: str, default: str | None = None) -> Column:
    """A metadata entry, or the default."""
    return F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit(default))


def set_metadata(meta: Column, key: str, value: Column) -> Column:
    """The metadata with one entry set; empty values are not stored."""
    rest = F.map_filter(meta, lambda k, _: k != key)
    return F.when(F.coalesce(value, F.lit("")) == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))


def escape_key(key: Column) -> Column:
    """A key as an identifier: every character but letters, digits and underscores as its code between ``$``."""
    return F.array_join(F.transform(F.split(key, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9_]?$"), c).otherwise(F.concat(F.lit("$"), F.ascii(c).cast("string"), F.lit("$")))), "")
