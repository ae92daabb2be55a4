"""Values that the dashboard derives from entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a status may be, and how messages spell one.
STATUS_FIELDS = ("status", "http_status", "statusCode", "code")
KNOWN_STATUS = (200, 201, 204, 400, 401, 403, 404, 429, 500, 502, 503, 504)
STATUS_IN_MESSAGE = rf"(?i)status=(\d{{3}})|HTTP\s+(\d{{3}})|\[(\d{{3}})\]|\b({'|'.join(map(str, KNOWN_STATUS))})\b"


def extract_http_status(message: Column, fields: Column | None = None) -> Column:
    """The status as text: from a field, else from the message; NULL if there is none."""
    ways = [F.nullif(F.try_element_at(fields, F.lit(f)), F.lit("")) for f in STATUS_FIELDS] if fields is not None else []
    ways += [F.nullif(F.regexp_extract(message, STATUS_IN_MESSAGE, g), F.lit("")) for g in (1, 2, 3, 4)]
    return F.coalesce(*ways)


def status_class(status: Column) -> Column:
    n = status.try_cast("int")
    known = F.when(n >= 500, "5xx").when(n >= 400, "4xx").when(n >= 300, "3xx").otherwise("2xx")
    return F.when(status.isNotNull(), known)


def utc_clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def short_number(n: Column) -> Column:
    """1234567 as ``1.23M``, 1234 as ``1.2K``."""
    d = n.cast("double")
    return F.when(d >= 1e6, F.format_string("%.2fM", d / 1e6)).when(d >= 1e3, F.format_string("%.1fK", d / 1e3)).otherwise(n.cast("string"))


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def raw_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"})
