"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest.

The byte-level BPE never merges across pre-tokens, so a text's token count is the sum over its pre-tokens.
A first pass keeps a bounded summary of frequent words per partition (a counter pruned to its ``KEEP``
largest whenever it holds eight times as many) and merges the summaries over a tree; the driver encodes
the pre-tokens of the ``TABLE`` most frequent words and broadcasts pre-token -> length, at most ``2 * TABLE``
entries.  The second pass looks each pre-token up there, then in the worker's cache, and encodes only what
neither holds, in batches.  No pre-token is ever shuffled; the table decides speed, never results.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts are counted whole; equal rows give
equal rows; the special strings of the vocabulary inside a text count one token, as the library's default
has it; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, quoted

#: Fixed value: how the byte-level BPE cuts a text into pre-tokens.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over ASCII texts, for the faster engine.
PRE_TOKEN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters that the regex package and the tokenizer's engine may class apart, as their Unicode versions
#: differ; texts that hold one are encoded whole.
ODD = r"[\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D\U00010000-\U0010FFFF]"
KEEP, TABLE = 4096, 16384
#: Most entries of a worker's cache; it is emptied beyond.
CACHE = 400_000
ROWS_AT_ONCE = 128


def _encoder(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


def _pruned(counts: Counter, n: int) -> Counter:
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]))


def frequent_words(docs: DataFrame, text_col: str, keep: int = KEEP) -> list[tuple[str, int]]:
    """The most frequent white-space words of all texts, by summaries merged over a tree of tasks."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split())
                if len(counts) > 8 * keep:
                    counts = _pruned(counts, keep)
        yield pa.RecordBatch.from_pylist([{"words": json.dumps(_pruned(counts, keep))}])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for words in batch.column(0).to_pylist():
                counts.update(json.loads(words))
                counts = _pruned(counts, 4 * keep)
        yield pa.RecordBatch.from_pylist([{"words": json.dumps(counts)}])

    parts = docs.select(col(docs, text_col)).mapInArrow(summary, "words string")
    n = docs.rdd.getNumPartitions()
    while n > 16:
        n = max(1, n // 16)
        parts = parts.repartition(n).mapInArrow(merge, "words string")
    total: Counter = Counter()
    for row in parts.toLocalIterator():
        total.update(json.loads(row["words"]))
        total = _pruned(total, 4 * keep)
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))


def length_table(model: str, words: list[tuple[str, int]], size: int = TABLE) -> dict[str, int]:
    """Token lengths of the pre-tokens that the frequent words bring, at most ``size`` words' worth."""
    import regex

    find = regex.compile(PRE_TOKEN).findall
    pre = {" "} | {p for w, _ in words[:size] for p in find(" " + w)}
    pre = sorted(pre)
    return dict(zip(pre, (len(e.ids) for e in _encoder(model).encode_batch(pre, add_special_tokens=False)), strict=True))


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, keep: int = KEEP
) -> DataFrame:
    """One row a row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    special = [t["content"] for t in json.loads(model)["added_tokens"]]
    rows = docs.select(col(docs, id_col).alias(id_col), col(docs, text_col).alias("text_"))
    shared = spark.sparkContext.broadcast((model, special, length_table(model, frequent_words(rows, "text_", keep))))
    schema = rows.select(quoted(id_col), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, special, table = shared.value
        find_any, find_ascii, encoder = regex.compile(PRE_TOKEN).findall, re.compile(PRE_TOKEN_ASCII).findall, _encoder(model)
        odd = re.compile(ODD).search
        cut = regex.compile("|".join(map(regex.escape, special))).split if special else None
        frequent, cache = table, dict(table)

        def fill(cuts: list[list[str]], missing: set[str]) -> None:
            if len(cache) + len(missing) > CACHE + len(frequent):
                cache.clear()
                cache.update(frequent)
                missing = {p for found in cuts for p in found if p not in cache}
            for k in range(0, len(todo := list(missing)), 4096):
                part = todo[k : k + 4096]
                cache.update(zip(part, (len(e) for e in encoder.encode_batch_fast(part, add_special_tokens=False)), strict=True))

        for batch in batches:
            sizes, tokens = [], []
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                texts = batch.column(1).slice(at, ROWS_AT_ONCE).to_pylist()
                cuts, extra, missing = [], [], set()
                for text in texts:
                    text = text or ""
                    sizes.append(len(text.encode()))
                    find = find_ascii if text.isascii() else find_any
                    if find is find_any and odd(text):
                        extra.append(len(encoder.encode(text, add_special_tokens=False)))
                        cuts.append([])
                        continue
                    parts = cut(text) if cut else [text]
                    extra.append(len(parts) - 1)
                    found = [p for part in parts for p in find(part)] if len(parts) > 1 else find(text)
                    cuts.append(found)
                    missing.update(p for p in set(found) if p not in cache)
                fill(cuts, missing)
                for found, more in zip(cuts, extra, strict=True):
                    tokens.append(sum(map(cache.__getitem__, found)) + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    out = rows.mapInArrow(counted, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
