"""Exact reading of JSON lines: one Arrow batch at a time, for when the native reader's leniency matters.

Rejects what follows the object, keeps the last of equal keys, and spells numbers and nested values the way
the service does: shortest decimal form of a double, sorted keys, ``<``, ``>`` and ``&`` escaped.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no_constant(name: str):
    raise ValueError(name)


def stringify(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return _plain(value)
    text = _nested(value)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _plain(value: float) -> str:
    """The shortest decimal form, without an exponent."""
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _nested(value) -> str:
    """JSON text of a value inside another: numbers in their shortest form, with an exponent where very small or large."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_nested(k)}:{_nested(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_nested, value)) + "]"
    if isinstance(value, float):
        if value and not 1e-6 <= abs(value) < 1e21:
            return format(Decimal(repr(value)).normalize(), "e")
        return _plain(value)
    return json.dumps(value, ensure_ascii=False)


def read_object(line: str | None) -> dict[str, str | None] | None:
    """The object's values as texts, or None for anything but an object."""
    try:
        value = json.loads(line or "", parse_constant=_no_constant, parse_int=float)
    except (ValueError, RecursionError):
        return None
    return {k: stringify(v) for k, v in value.items()} if isinstance(value, dict) else None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def strict_json_map(lines: pd.Series) -> pd.Series:
    return lines.map(read_object)
