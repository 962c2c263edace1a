"""Scalar functions as Column expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def trim_comma(c: Column) -> Column:
    """Strips one leading and one trailing comma at most."""
    return F.regexp_replace(c, "^,|,$", "")


def two_digits(c: Column) -> Column:
    """Puts a zero before text that isn't two characters long."""
    return F.when(F.length(c) == 2, c).otherwise(F.concat(F.lit("0"), c))


def field_of(record: Column, name: Column | str, separator: str = "|") -> Column:
    """The value of a `k=v|k=v` record's first pair of that name; pairs with an empty value or a second `=` don't count."""
    name = F.lit(name) if isinstance(name, str) else name
    pairs = F.transform(F.split(record, f"[{separator}]"), lambda p: F.split(p, "="))
    hits = F.filter(pairs, lambda p: (F.size(p) == 2) & (p[0] == name) & (p[1] != ""))
    return F.get(F.get(hits, F.lit(0)), F.lit(1))


def with_field(record: Column, name: str, value: Column | str, separator: str = "|") -> Column:
    """The record with every pair of that name given another value; unchanged where there is none."""
    value = F.lit(value) if isinstance(value, str) else value
    pairs = F.transform(F.split(record, f"[{separator}]"), lambda p: F.when(F.split(p, "=")[0] == name, F.concat(F.lit(f"{name}="), value)).otherwise(p))
    return F.array_join(pairs, separator)


def timestamp_of(c: Column) -> Column:
    """Text `yyyy-MM-dd HH:mm:ss` as a timestamp; null where it can't be read."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def before(a: Column, b: Column) -> Column:
    return F.coalesce(timestamp_of(a) < timestamp_of(b), F.lit(False))


def after(a: Column, b: Column) -> Column:
    return F.coalesce(timestamp_of(a) > timestamp_of(b), F.lit(False))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from b to a; 0 where either can't be read."""
    return F.coalesce(F.unix_timestamp(timestamp_of(a)) - F.unix_timestamp(timestamp_of(b)), F.lit(0)).cast("long")


def date_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH")


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parse_date_key(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd")))


def json_field(document: Column, name: Column | str) -> Column:
    """A top-level field by its name, scalars as text; null where the document is none."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.call_function("get_json_object", document, F.concat(F.lit("$."), name))


def first_param(document: Column, name: str) -> Column:
    """The first element of a task parameter's array."""
    return F.get(F.from_json(document, "map<string,array<string>>")[name], F.lit(0))


def ids_of(c: Column) -> Column:
    """Comma-separated ids as an array of longs; what is none is left out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def concat_long(a: Column, b: Column, separator: str) -> Column:
    return F.concat_ws(separator, F.coalesce(a.cast("string"), F.lit("null")), F.coalesce(b, F.lit("null")))


def salted(c: Column, n: int, by: Column) -> Column:
    """`i_text` with i below n, chosen by a hash so that a retried task salts alike."""
    return F.concat(F.pmod(F.xxhash64(by), F.lit(n)).cast("string"), F.lit("_"), c)


def unsalted(c: Column) -> Column:
    return F.regexp_replace(c, "^[0-9]+_", "")


def today() -> Column:
    """Today's date as yyyy-MM-dd, in the session's time zone."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), "yyyy-MM-dd")


def parse_day(c: Column) -> Column:
    """Text yyyy-MM-dd as a date; null where it can't be read."""
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


#: From each of these sizes on a double is a multiple of 2^-shift, so that size * 2^shift is exact and fits a long up to the next size.
_STEPS = [(0, 60), (3, 49), (13, 39), (22, 30), (31, 21), (40, 12), (49, 3)]


def half_up(x: Column, any_size: bool = False) -> Column:
    """Two decimals, half up on the double's exact binary value, in integer arithmetic.

    Without any_size, 0 <= x < 8 only (rates), null else. With it any value, negative ones away from zero like positive ones;
    from 2^53 on doubles are whole. NaN and infinities give null."""
    size = F.abs(x)

    def exact(shift: int) -> Column:
        scaled = (size * F.lit(float(1 << shift))).cast("bigint").cast("decimal(38,0)")
        half, one = F.lit(1 << shift - 1).cast("decimal(38,0)"), F.lit(1 << shift).cast("decimal(38,0)")
        return F.call_function("div", scaled * 100 + half, one).cast("double") / 100

    if not any_size:
        return F.when((x >= 0) & (x < 8), exact(60))
    out = F.when(F.isnan(x) | (size == float("inf")), F.lit(None).cast("double")).when(size >= float(1 << 53), size)
    for power, shift in reversed(_STEPS):
        out = out.when(size >= float(1 << power if power else 0), exact(shift))
    return F.when(x < 0, -out).otherwise(out)
