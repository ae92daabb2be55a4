"""Line parsers as columns: text, JSON, regular expression, automatic.

Each gives a struct ``timestamp, host, source, level, message, fields, error``; ``error`` is NULL for a parsed
line.  ``with_fallback`` turns unparsed lines into plain entries.  The time that stands in for a missing one
is an argument, so results can be repeated.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.level import DEFAULT, detect_level
from ..functions.let import let
from ..functions.timestamps import parse_timestamp

# Names of the columns in JSON lines; the first that is there wins.
JSON_ALIASES = {
    "timestamp": ("timestamp", "time", "ts", "@timestamp", "datetime"),
    "level": ("level", "severity", "lvl", "status"),
    "message": ("message", "msg", "log", "text"),
    "host": ("host", "hostname"),
    "source": ("source", "service", "app"),
}
# The same for the groups of regular expressions; the last that is there wins.
GROUP_ALIASES = {
    "timestamp": ("timestamp", "time", "ts"),
    "level": ("level", "severity", "lvl"),
    "message": ("message", "msg"),
    "host": ("host", "hostname"),
    "source": ("source", "service"),
}
NO_MATCH, EMPTY_LINE, NOT_JSON = "line does not match pattern", "empty line", "invalid JSON object"
FORMATS = ("text", "json", "regexp", "auto")


@dataclass(frozen=True)
class Context:
    """What a source adds to its lines."""

    host: str = ""
    source: str = ""
    tags: Mapping[str, str] = field(default_factory=dict)

    def fields(self) -> Column:
        if not self.tags:
            return F.lit(None).cast("map<string,string>")
        return F.create_map(*[F.lit(x) for kv in self.tags.items() for x in kv])


def _entry(timestamp, host, source, level, message, fields, error) -> Column:
    return F.struct(
        timestamp.alias("timestamp"), host.alias("host"), source.alias("source"), level.alias("level"),
        message.alias("message"), fields.cast("map<string,string>").alias("fields"), error.cast("string").alias("error"),
    )


def _strip_line_end(line: Column) -> Column:
    return F.regexp_replace(line, r"[\r\n]+\z", "")


def _blank_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def parse_text(line: Column, ctx: Context, now: Column) -> Column:
    text = _strip_line_end(line)
    error = F.when(text == "", EMPTY_LINE)
    return _entry(now, F.lit(ctx.host), F.lit(ctx.source), detect_level(text), text, ctx.fields(), error)


def parse_json(line: Column, ctx: Context, now: Column, strict: bool = False) -> Column:
    """JSON object lines.  The native reader accepts some trailing text and keeps numbers' own spelling;
    ``strict`` reads exactly, at the price of a Python step."""
    from ..functions.strict_json import strict_json_map

    def entry(text: Column, pairs: Column, lower: Column) -> Column:
        get = lambda name: F.try_element_at(lower, F.lit(name))
        full = lambda name: F.nullif(get(name), F.lit(""))
        names = [a for aliases in JSON_ALIASES.values() for a in aliases]
        rest = F.map_filter(pairs, lambda k, v: ~F.lower(k).isin(names) & v.isNotNull())
        fields = F.map_concat(ctx.fields(), rest) if ctx.tags else rest
        is_null = text == "null"
        return _entry(
            F.coalesce(*[parse_timestamp(get(a)) for a in JSON_ALIASES["timestamp"]], now),
            F.coalesce(*[full(a) for a in JSON_ALIASES["host"]], F.lit(ctx.host)),
            F.coalesce(*[full(a) for a in JSON_ALIASES["source"]], F.lit(ctx.source)),
            F.upper(F.coalesce(*[full(a) for a in JSON_ALIASES["level"]], F.lit(DEFAULT))),
            F.coalesce(*[get(a) for a in JSON_ALIASES["message"]], text),
            let(fields, lambda f: F.when(F.size(f) > 0, f).when(is_null, ctx.fields())),
            F.when(pairs.isNull() & ~is_null, NOT_JSON),
        )

    def read(text: Column, found: Column) -> Column:
        # Equal keys: the last one stays (the session's policy).
        pairs = F.when(text.startswith("{") & text.endswith("}"), F.map_from_entries(F.map_entries(found)))
        return let(pairs, lambda p: let(F.transform_keys(p, lambda k, v: F.lower(k)), lambda lower: entry(text, p, lower)))

    if strict:  # a Python step can't stand inside a lambda
        return let(strict_json_map(_blank_trim(line)), lambda found: let(_blank_trim(line), lambda text: read(text, found)))
    return let(_blank_trim(line), lambda text: read(text, F.from_json(text, "map<string,string>")))


_CLASSES = {
    "alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower",
    "space": "Space", "punct": "Punct", "xdigit": "XDigit", "blank": "Blank", "cntrl": "Cntrl", "print": "Print", "graph": "Graph",
}


def translate_pattern(pattern: str) -> tuple[str, dict[int, str]]:
    """A pattern with ``(?P<name>...)`` groups for Java's engine, and its groups' names by number."""
    out, names, at, number, in_class = [], {}, 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1 : at + 2] == "C":
                raise ValueError("\\C is not supported")
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if in_class:
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[at:]):
                if m[2] not in _CLASSES:
                    raise ValueError(f"unknown character class {m[2]}")
                out.append(f"\\{'P' if m[1] else 'p'}{{{_CLASSES[m[2]]}}}")
                at += len(m[0])
                continue
            if c == "[":
                c = "\\["
            elif c == "]":
                in_class = False
        elif c == "[":
            in_class = True
            if m := re.match(r"\[\^?\]", pattern[at:]):
                out.append(m[0][:-1] + "\\]")
                at += len(m[0])
                continue
        elif c == "(":
            if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[at:]):
                number += 1
                names[number] = m[1]
                out.append("(")
                at += len(m[0])
                continue
            if m := re.match(r"\(\?([a-zA-Z-]*)[:)]", pattern[at:]):
                if "U" in m[1]:
                    raise ValueError("(?U) is not supported")
            else:
                number += 1
        out.append(c)
        at += 1
    return "(?d)" + "".join(out), names


def parse_regexp(line: Column, pattern: str, ctx: Context, now: Column) -> Column:
    java, names = translate_pattern(pattern)
    # All groups of the match at once; a line without a match has none, and a group that took no part is empty.
    groups = lambda text: F.array(*[F.regexp_extract(text, java, n) for n in sorted(names)], F.regexp_like(text, F.lit(java)).cast("string"))
    return let(_strip_line_end(line), lambda text: let(groups(text), lambda got: _of_groups(text, got, names, ctx, now)))


def _of_groups(text: Column, got: Column, names: dict[int, str], ctx: Context, now: Column) -> Column:
    """The entry of a line whose groups, and whether it matches, are in ``got``."""
    found = {"host": [], "source": [], "level": [], "message": [], "timestamp": []}
    others: dict[str, Column] = {}
    for place, (_, name) in enumerate(sorted(names.items())):
        value = F.get(got, F.lit(place))
        target = next((t for t, aliases in GROUP_ALIASES.items() if name.lower() in aliases), None)
        if target:
            found[target].append(value)
        else:
            others[name] = value
    last = {t: v[::-1] for t, v in found.items()}
    filled = lambda t: [F.nullif(v, F.lit("")) for v in last[t]]
    pairs = F.create_map(*[x for k, v in others.items() for x in (F.lit(k), v)]) if others else None
    fields = ctx.fields() if pairs is None else F.map_concat(ctx.fields(), pairs) if ctx.tags else pairs
    return _entry(
        F.coalesce(*[parse_timestamp(v) for v in last["timestamp"]], now),
        F.coalesce(*filled("host"), F.lit(ctx.host)),
        F.coalesce(*filled("source"), F.lit(ctx.source)),
        F.upper(last["level"][0]) if last["level"] else F.lit(DEFAULT),
        last["message"][0] if last["message"] else text,
        fields,
        F.when(text == "", EMPTY_LINE).when(F.get(got, F.lit(len(names))) == "false", NO_MATCH),
    )


def parse_auto(line: Column, ctx: Context, now: Column, strict: bool = False) -> Column:
    """JSON if the line looks like an object and reads as one, else text of the untrimmed line."""
    def choose(trimmed: Column, as_json: Column) -> Column:
        as_text = parse_text(line, ctx, now)
        failed = as_text.withField("error", F.lit(EMPTY_LINE))
        looks = trimmed.startswith("{") & trimmed.endswith("}") & as_json["error"].isNull()
        return F.when(trimmed == "", failed).when(looks, as_json).otherwise(as_text)

    return let(parse_json(line, ctx, now, strict), lambda as_json: let(_blank_trim(line), lambda trimmed: choose(trimmed, as_json)))


def parser(fmt: str, ctx: Context, now: Column, pattern: str = "", strict: bool = False):
    """The parser of a source's format: a function from a line column to an entry column."""
    fmt = fmt.strip().lower() or "auto"
    if fmt == "text":
        return lambda line: parse_text(line, ctx, now)
    if fmt == "json":
        return lambda line: parse_json(line, ctx, now, strict)
    if fmt == "regexp":
        translate_pattern(pattern)
        return lambda line: parse_regexp(line, pattern, ctx, now)
    if fmt == "auto":
        return lambda line: parse_auto(line, ctx, now, strict)
    raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")


def with_fallback(parsed: Column, line: Column, ctx: Context, now: Column) -> Column:
    """Unparsed lines become INFO entries of the raw line without tags; ``error`` still tells them."""
    return let(parsed, lambda entry: _or_plain(entry, line, ctx, now))


def _or_plain(entry: Column, line: Column, ctx: Context, now: Column) -> Column:
    error = entry["error"]
    plain = _entry(now, F.lit(ctx.host), F.lit(ctx.source), F.lit(DEFAULT), line, F.lit(None), error)
    return F.when(error.isNull(), entry).otherwise(plain)


def parse_lines(lines: DataFrame, fmt: str, ctx: Context, now: Column, pattern: str = "", line_col: str = "value", strict: bool = False) -> DataFrame:
    """``lines`` with the entry's columns and ``_parse_error`` in place of the line."""
    line = F.col(line_col)
    parse = parser(fmt, ctx, now, pattern, strict)
    out = lines.withColumn("_e", with_fallback(parse(line), line, ctx, now))
    rest = [c for c in lines.columns if c != line_col]
    names = ("timestamp", "host", "source", "level", "message", "fields")
    return out.select(*rest, *[F.col(f"_e.{n}").alias(n) for n in names], F.col("_e.error").isNotNull().alias("_parse_error"))


def line_id(host: Column, path: Column, inode: Column, offset: Column) -> Column:
    """An id that a retried task gives again: made from where the line stands."""
    return F.sha2(F.concat_ws("|", host, path, inode.cast("string"), offset.cast("string")), 256)
