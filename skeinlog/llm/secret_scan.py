"""Secret scan: base patterns plus sliding-window Shannon entropy, in DataFrame functions only.

Base kinds are regular expressions.  Beyond them, *candidate strings* (maximal runs of one character
class) are scanned by a window of ``WINDOW`` characters.  The window moves one character at a time; the
counts of the entering and the leaving character change by one, and the sum of ``c * log2 c`` is carried
along, so the entropy of each window costs the same whatever the window's length.  A candidate whose best
window reaches its class's threshold is reported, unless the allow-list knows it or a base span covers
part of it.

Defined results: a null or empty text has no span (the digest is that of the empty string); texts of any
length are read whole; equal rows give equal rows; an empty table gives an empty one; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, quoted

#: Fixed values of the base patterns.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
#: A text without any of these in lower case has no keyword.
KEYWORD_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

WINDOW = 20
#: Entropy classes: name, characters of a run, what a run must hold besides, threshold in bits.
CLASSES = (
    ("entropy_hex", "0-9A-Fa-f", ("[0-9]", "[A-Fa-f]"), 3.12),
    ("entropy_base64", "A-Za-z0-9+/=_-", ("[0-9]", "[A-Z]", "[a-z]"), 3.77),
)
#: Allow-list: a candidate that matches is never a secret.  Fixed values.
ALLOW = (
    "(?:example|sample|dummy|placeholder|changeme|redacted|xxxx|your[_-])",
    "(?:01234567|12345678|abcdefgh|qwertyui)",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "^[/=_+-]*[a-z]+(?:[/=_+-]+[a-z]+)*[/=_+-]*[0-9]{0,4}$",
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def assign_pattern() -> str:
    words = "|".join(map(either_case, KEYWORDS))
    return rf"""({words})["']?\x20*[:=]\x20*["']?({ASSIGN_VALUE})"""


def access_pattern() -> str:
    # A run of the class is matched whole, so asking for its length in the pattern drops the same matches.
    return f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}"


def hex_pattern() -> str:
    return f"[0-9a-f]{{{HEX_MIN},}}"


def run_pattern(chars: str) -> str:
    return f"(?<![{chars}])[{chars}]{{{WINDOW},}}"


def _placed(text: Column, pattern: str, kind: str, gate: Column) -> Column:
    """Array of (start, rank, stop, kind, hit) of all matches: what lies between them gives their places.

    Texts that fail ``gate`` cannot match and are not searched.
    """
    none = F.array().cast("array<string>")
    hits = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    rank = KINDS.index(kind)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,hit:string>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), F.lit(kind).alias("kind"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(found):
        # Reached only where something matched.
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return _let(hits, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(start["out"]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_entropy(candidate: Column) -> Column:
    """The largest Shannon entropy in bits of any ``WINDOW`` neighbouring characters, by incremental counts."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    zero = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(float("inf")).alias("least")
    )

    def moved(counts, total, code, by):
        """Counts and sum of ``c * log2 c`` after one character came (``by`` 1) or went (-1)."""

        def changed(old):
            put = F.concat(F.slice(counts, F.lit(1), code), F.array(old + by), F.slice(counts, code + 2, 127 - code))
            return F.struct(put.alias("counts"), (total + F.element_at(weight, old + by + 1) - F.element_at(weight, old + 1)).alias("sum"))

        return _let(F.element_at(counts, code + 1), changed)

    def step(acc, pair):
        same = F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"))
        left = F.when(pair["out"] >= 0, moved(acc["counts"], acc["sum"], pair["out"], -1)).otherwise(same)
        n = acc["n"] + 1

        def seen(now):
            least = F.when(n >= WINDOW, F.least(acc["least"], now["sum"])).otherwise(acc["least"])
            return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), n.alias("n"), least.alias("least"))

        return _let(left, lambda x: _let(moved(x["counts"], x["sum"], pair["code"], 1), seen))

    def over(codes):
        gone = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), F.lit(1), F.size(codes))
        pairs = F.zip_with(codes, gone, lambda c, g: F.struct(c.alias("code"), g.alias("out")))
        return F.aggregate(pairs, zero, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW)

    return _let(F.transform(F.split(candidate, ""), lambda c: F.ascii(c) % 128), over)


def allowed(candidate: Column) -> Column:
    low = F.lower(candidate)
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | low.rlike(pattern)
    return out


def _secret_run(needs: tuple[str, ...], threshold: float):
    def keep(span):
        ok = ~allowed(span["hit"])
        for need in needs:
            ok = span["hit"].rlike(need) & ok
        return F.when(ok, window_entropy(span["hit"]) >= threshold).otherwise(False)

    return keep


def _show(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def with_spans(docs: DataFrame, text_col: str, base: str, found: str) -> DataFrame:
    """``docs`` and two arrays of (start, rank, stop, kind, hit): the base spans, and all spans."""
    names = {k: fresh(docs, f"spans_{k}") for k in ("text", "run", "keyword", *KINDS)}
    df = docs.withColumn(names["text"], F.coalesce(col(docs, text_col), F.lit("")))
    text = F.col(names["text"])
    patterns = {"assign": assign_pattern(), "access": access_pattern(), "hex": hex_pattern()}
    patterns |= {name: run_pattern(chars) for name, chars, _, _ in CLASSES}
    # Every kind but the assignment is a run of these characters that is as long as a window, at least.
    any_run = text.rlike(f"[A-Za-z0-9+/=_-]{{{WINDOW},}}+")
    keyword = reduce(or_, (F.contains(F.lower(text), F.lit(w)) for w in KEYWORD_HINTS))
    df = df.withColumns({names["run"]: any_run, names["keyword"]: keyword})
    gates = {k: F.col(names["keyword" if k == "assign" else "run"]) for k in patterns}
    df = df.withColumns({names[k]: _placed(text, p, k, gates[k]) for k, p in patterns.items()})
    values = F.regexp_extract_all(text, F.lit(assign_pattern()), F.lit(2))
    both = F.zip_with(names["assign"], values, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    kept = F.transform(F.filter(both, lambda x: F.length(x["v"]) >= ASSIGN_MIN), lambda x: x["s"])
    df = df.withColumn(names["assign"], F.when(F.size(names["assign"]) > 0, kept).otherwise(F.col(names["assign"])))
    df = df.withColumn(base, F.array_sort(F.concat(*[F.col(names[k]) for k in ("assign", "access", "hex")])))
    clear = lambda s: ~F.exists(base, lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"]))
    more = [F.filter(F.filter(F.col(names[k]), _secret_run(needs, least)), clear) for k, _, needs, least in CLASSES]
    df = df.withColumn(found, F.array_sort(F.concat(F.col(base), *more)))
    return df.drop(*names.values())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: id, counts of the base kinds, digest of the base spans, all spans as text and as an array."""
    df = docs.select(col(docs, id_col).alias(id_col), col(docs, text_col).alias("_text"))
    df = with_spans(df, "_text", "_base", "_all")
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select(
        F.col(quoted(id_col)),
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(_show(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _show(F.col("_all")).alias("spans"),
        F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))).alias("found"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; nothing else changes.

    Overlapping spans share a mask; null texts stay null.  Row-wise: no shuffle.
    """
    base, found = fresh(docs, "spans_base"), fresh(docs, "spans_all")
    out = with_spans(docs, text_col, base, found)
    text, spans = out[quoted(text_col)], out[quoted(found)]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] < acc["at"], F.array().cast("array<string>")).otherwise(F.array(gap, F.lit(mask)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    def finish(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    done = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
    return out.select(*[done.alias(c) if c == text_col else out[quoted(c)] for c in docs.columns])
