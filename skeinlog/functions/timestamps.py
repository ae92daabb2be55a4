"""Timestamps from epoch numbers and from texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Above the first, a number counts milliseconds, then microseconds, then nanoseconds.
MILLIS_ABOVE, MICROS_FROM, NANOS_FROM = 10**11, 10**14, 10**17

_ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
_PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}([.,]\d+)?$"
_MAIL_NAMED = r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{3,5}$"
_MAIL_OFFSET = r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"
_WHOLE = r"^[+-]?\d{1,19}$"
_FRACTION = r"^[+-]?\d{1,18}\.\d+$"


def epoch_micros(n: Column) -> Column:
    """Microseconds since 1970 of an epoch number whose size tells its unit; seconds up to 10**11 and below 0."""
    n = n.cast("long")
    return (
        F.when((n > MILLIS_ABOVE) & (n < MICROS_FROM), n * 1000)
        .when((n >= MICROS_FROM) & (n < NANOS_FROM), n)
        .when(n >= NANOS_FROM, F.expr("0L") + F.floor(n / F.lit(1000).cast("decimal(20,0)")).cast("long"))
        .otherwise(F.when(F.abs(n) < 9_000_000_000_000, n * 1_000_000))
    )


def parse_epoch(n: Column) -> Column:
    return F.timestamp_micros(epoch_micros(n))


def parse_timestamp(text: Column) -> Column:
    """A timestamp from one of the accepted layouts, or an epoch number as text; else NULL."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    mail = F.regexp_replace(text, r"^\w{3}, ", "")
    return (
        F.when(text.rlike(_ZONED), dotted.try_cast("timestamp"))
        .when(text.rlike(_PLAIN), F.concat(dotted, F.lit("Z")).try_cast("timestamp"))
        .when(text.rlike(_MAIL_NAMED), F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss zzz")))
        .when(text.rlike(_MAIL_OFFSET), F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss Z")))
        .when(text.rlike(_WHOLE), parse_epoch(text.try_cast("long")))
        # A JSON number with a fraction loses it.
        .when(text.rlike(_FRACTION), parse_epoch(F.substring_index(text, ".", 1).try_cast("long")))
    )
