"""Column expressions shared by the operators.

All of these are native Catalyst expressions (codegen-friendly); none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.constants import (
    CARD_PATTERN,
    EMAIL_PATTERN,
    PHONE_PATTERN,
)
from tablelens.functions.names import quote

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Text accepted as a number: optional sign, digits with optional fraction or a
# bare fraction, optional exponent, or inf/infinity. Blanks around are allowed.
# Spark's own cast also takes suffixes such as `1d`/`1f`; this guard refuses them.
_NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Text accepted as a timestamp: ISO date with optional time, or a few common
# day/month layouts. A bare year such as `2025` is *not* a date.
_ISO_TEXT = (
    r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?\s*$"
)
_LAYOUTS = [
    (r"^\s*\d{4}/\d{1,2}/\d{1,2}\s*$", "yyyy/M/d"),
    (r"^\s*\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}\s*$", "yyyy/M/d H:mm:ss"),
    (r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$", "M/d/yyyy"),
    (r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?\s*$", "M/d/yyyy H:mm[:ss]"),
    (r"^\s*\d{1,2}\.\d{1,2}\.\d{4}\s*$", "d.M.yyyy"),
    (r"^\s*\d{8}\s*$", "yyyyMMdd"),
    (r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} (?i:am|pm)\s*$", "M/d/yyyy h:mm a"),
    (r"^\s*[A-Z][a-z]{2} \d{1,2}, \d{4}\s*$", "MMM d, yyyy"),
    (r"^\s*[A-Z][a-z]{3,8} \d{1,2}, \d{4}\s*$", "MMMM d, yyyy"),
    (r"^\s*\d{1,2}-[A-Z][a-z]{2}-\d{4}\s*$", "d-MMM-yyyy"),
]
# An ISO date and time with a zone: read as an instant, given in UTC.
_ZONED_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}(:?\d{2})?)\s*$"


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_missing(name: str, dt: T.DataType) -> Column:
    """Null, or NaN for floating columns (both count as missing)."""
    c = F.col(quote(name))
    if is_floating(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to null once, so every later aggregate skips it."""
    cols = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if is_floating(f.dataType):
            cols.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def to_number(c: Column, dt: T.DataType | None = None) -> Column:
    """Text or number -> double; anything not a plain number -> null."""
    if dt is not None and is_numeric_type(dt):
        return c.cast("double")
    if dt is not None and isinstance(dt, T.BooleanType):
        return c.cast("double")
    if dt is not None and not isinstance(dt, T.StringType):
        return F.lit(None).cast("double")
    s = F.trim(c.cast("string"))
    return F.when(c.cast("string").rlike(_NUMBER_TEXT), s.try_cast("double"))


def number_parses(c: Column, dt: T.DataType) -> Column:
    """True when the value reads as a number (for parse-share statistics)."""
    return to_number(c, dt).isNotNull()


def to_timestamp(c: Column, dt: T.DataType, numeric_as_epoch: bool = False) -> Column:
    """Any column -> timestamp_ntz; unparseable -> null.

    Strings: ISO forms through the cast, then a few fixed layouts, first hit
    wins. Numbers are not dates unless `numeric_as_epoch` (then epoch ns).
    """
    if isinstance(dt, (T.TimestampNTZType,)):
        return c
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if is_numeric_type(dt):
        if numeric_as_epoch:
            return F.timestamp_micros((c.cast("double") / 1000).cast("bigint")).cast(
                "timestamp_ntz"
            )
        return F.lit(None).cast("timestamp_ntz")
    if not isinstance(dt, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    s = F.trim(c)
    # `+0100` and `+01` are spelled `+01:00` for the cast; UTC is the session's zone
    zone = F.regexp_replace(F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([ T]\d{1,2}:\S*[+-]\d{2})$", "$1:00")
    branches = [
        F.when(s.rlike(_ISO_TEXT), s.try_cast("timestamp_ntz")),
        F.when(s.rlike(_ZONED_TEXT), F.to_utc_timestamp(zone.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")),
    ]
    for pattern, layout in _LAYOUTS:
        branches.append(
            F.when(
                s.rlike(pattern),
                F.try_to_timestamp(s, F.lit(layout)).cast("timestamp_ntz"),
            )
        )
    return F.coalesce(*branches)


#: The characters of the Unicode property White_Space.
_BLANKS = "".join(
    map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def trim_ws(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (Spark `trim` strips spaces only)."""
    return F.trim(c, F.lit(_BLANKS))


def _plain_text(c: Column, dt: T.DataType) -> Column:
    """Text of a value that no other value of its type has (equal values have equal texts:
    -0.0 is 0.0); null for null."""
    if is_floating(dt):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    if isinstance(dt, T.BinaryType):
        return F.hex(c)
    if isinstance(dt, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _framed(_plain_text(x, dt.elementType))), ""), F.lit("]"))
    if isinstance(dt, T.StructType):
        parts = [_framed(_plain_text(c[f.name], f.dataType)) for f in dt.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("("), *parts, F.lit(")")))
    return c.cast("string")


def _framed(text: Column) -> Column:
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a whole row: equal rows (nulls equal) have equal digests, and that two
    different rows share one is out of reach (below 2^-128 for any table)."""
    parts = [_framed(_plain_text(F.col(quote(f.name)), f.dataType)) for f in df.schema.fields]
    return F.unhex(F.sha2(F.concat(F.lit("row"), *parts), 256))


def pii_hit(c: Column) -> Column:
    """True when the text contains an email, a phone number or a card number.

    Every card-pattern match (13+ digits separated only by blanks or hyphens,
    starting and ending with a digit) also contains a phone-pattern match
    (digit, 7+ of digits/blanks/hyphens/parentheses, digit), so the row-level
    OR is decided by the email and phone searches alone; the backtracking
    card search never changes the answer and is skipped.
    """
    # whether an address occurs does not depend on how long its local part is: one
    # character of it keeps the search linear on long runs
    return c.rlike("(?U)" + EMAIL_PATTERN.replace("]+@", "]@", 1)) | c.rlike("(?U)" + PHONE_PATTERN)


def card_hit(c: Column) -> Column:
    """The card pattern on its own (for callers that need it separately)."""
    return c.rlike("(?U)" + CARD_PATTERN)


def as_text(c: Column, dt: T.DataType) -> Column:
    """Value as text; doubles in plain digits (never `1.2E9`)."""
    if isinstance(dt, T.StringType):
        return c
    if is_floating(dt):
        # Plain digits keep numbers visible to the digit patterns.
        return F.when(F.isnan(c) | F.abs(c).eqNullSafe(float("inf")), c.cast("string")).otherwise(
            F.coalesce(
                F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", ""),
                c.cast("string"),
            )
        )
    return c.cast("string")


def mask(c: Column, keep_last: int = 4) -> Column:
    """All but the last `keep_last` characters become `*`; short text unchanged."""
    n = F.length(c)
    return F.when(n <= keep_last, c).otherwise(
        F.concat(F.repeat(F.lit("*"), n - keep_last), F.substring(c, -keep_last, keep_last))
    )


def week_end(ts: Column) -> Column:
    """Sunday that ends the Monday–Sunday week containing `ts` (as a date)."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "Sun")


def period_label(ts: Column, freq: str) -> Column:
    """Period label: day (D), week-ending Sunday (W) or month end (M)."""
    f = freq.upper()
    if f == "D":
        return F.to_date(ts)
    if f == "W":
        return week_end(ts)
    if f == "M":
        return F.last_day(F.to_date(ts))
    raise ValueError(f"unknown frequency {freq!r}; use D, W or M")
