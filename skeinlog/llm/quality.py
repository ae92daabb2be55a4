"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are the trigrams of its bytes' classes (lower case, upper case, digit, white space,
punctuation by kind, ...) and, for words, how often one repeats the word before it.  Counts are damped,
weighted by inverse document frequency and projected by a truncated SVD.  Both the SVD and the neighbours
come from a bounded sample of labelled rows (``SAMPLE`` rows in order of the md5 of their id, texts of at
most ``LONGEST`` characters), so the broadcast is at most ``SAMPLE * RANK`` floats plus the projection.
Every document is compared with every labelled vector, block by block, and the labels of its
``NEIGHBOURS`` nearest vote with weights that grow with the cosine.

Defined results: null and empty texts get the share of good rows in the sample; without labelled rows
every score is 0.5; texts are read whole; equal texts score alike; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, give_back, quoted

SAMPLE, LONGEST = 6000, 20_000
RANK, NEIGHBOURS, SHARPNESS = 48, 25, 8
BLOCK = 256
N_CLASSES, N_SHAPES = 16, 16**3
N_TERMS = N_SHAPES + 2


def _byte_classes() -> np.ndarray:
    """Class of each byte: letters, digits, blanks, line ends, UTF-8 leads and tails, punctuation by kind."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 6
        elif b >= 0x80:
            out[b] = 7
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c == " ":
            out[b] = 3
        elif c.isspace() or b < 32:
            out[b] = 4
        elif c in ".,":
            out[b] = 5
        else:
            out[b] = 8 + b % 8
    return out


CLASSES = _byte_classes()


def term_counts(text: str) -> np.ndarray:
    """Counts of the terms of a whole text, a mebibyte at a time."""
    out = np.zeros(N_TERMS, np.float32)
    raw = text.encode("utf-8", "replace")
    for at in range(0, max(1, len(raw) - 2), 1 << 20):
        c = CLASSES[np.frombuffer(raw[at : at + (1 << 20) + 2], np.uint8)]
        if len(c) > 2:
            out[:N_SHAPES] += np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=N_SHAPES)
    words = text.split()
    same = sum(map(eq, words, words[1:]))
    out[N_SHAPES], out[N_SHAPES + 1] = 4 * same, 4 * (len(words) > 40) * max(0, len(words) // 4 - len(set(words)))
    return out


def _matrix(texts: list[str]) -> np.ndarray:
    x = np.empty((len(texts), N_TERMS), np.float32)
    for i, t in enumerate(texts):
        x[i] = term_counts(t)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in place: these matrices are the largest things around."""
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)
    return x


def fit(texts: list[str], labels: list[int], rank: int = RANK) -> dict:
    """Weights of the terms, the projection and the labelled rows' vectors.  Deterministic."""
    x = _matrix(texts)
    np.log1p(x, out=x)
    idf = np.log((1 + len(texts)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    x *= idf
    x = _unit(x)
    rng = np.random.default_rng(0)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(rank + 10, len(texts)))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    project = np.ascontiguousarray(vt[:rank].T, dtype=np.float32)
    return {"idf": idf, "project": project, "vectors": _unit(x @ project).astype(np.float32), "labels": np.array(labels, np.float32)}


def scores_of(model: dict, texts: list[str | None], neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> np.ndarray:
    """Scores of a block of texts: exact cosines with every labelled vector, then the weighted vote."""
    labels = model["labels"]
    prior = float(labels.mean()) if len(labels) else 0.5
    out = np.full(len(texts), prior)
    if not len(labels):
        return out
    x = _matrix([t or "" for t in texts])
    some = x.any(axis=1)
    np.log1p(x, out=x)
    x *= model["idf"]
    v = _unit(_unit(x) @ model["project"])
    cos = v @ model["vectors"].T
    k = min(neighbours, len(labels))
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3).astype(np.float64) ** sharpness
    vote = (weight * labels[near]).sum(1) / weight.sum(1)
    out[some] = np.clip(vote[some], 0, 1)
    return out


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled rows; ``labelled`` has the id and 0/1 in ``label_col``."""
    pick = labelled.where(col(labelled, label_col).isin(0, 1)).select(col(labelled, id_col).alias("id_"), col(labelled, label_col).cast("int").alias("y_"))
    pick = pick.where("id_ is not null").orderBy(F.md5(F.col("id_").cast("string")), "id_", "y_").limit(sample)
    texts = docs.select(col(docs, id_col).alias("id_"), col(docs, text_col).alias("x_")).where(F.length("x_") <= LONGEST)
    rows = texts.join(F.broadcast(pick), "id_").orderBy(F.md5(F.col("id_").cast("string")), "x_", "y_").limit(sample).collect()
    if not rows:
        return {"labels": np.zeros(0, np.float32)}
    model = fit([r["x_"] for r in rows], [r["y_"] for r in rows])
    del rows
    give_back()  # the driver stays, and has a limit of its own
    return model


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a score from 0 to 1: the weighted share of good neighbours."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A kept column of the score's name stays; the score is then called by that name and an underscore.
    out_col = fresh(docs.select(*map(quoted, keep)), out_col)
    rows = docs.select(col(docs, text_col).alias(fresh(docs, "text__")), *[docs[quoted(c)] for c in keep])
    schema = rows.select(*[rows[quoted(c)] for c in keep], F.lit(0.0).alias(out_col)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                s = scores_of(shared.value, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64())], names=[*keep, out_col])

    return rows.mapInArrow(scored, schema)


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; columns as they were."""
    name = fresh(docs, "quality_score")
    return score(docs, model, text_col, name).where(F.col(name) >= least).drop(name)
