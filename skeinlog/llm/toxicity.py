"""Toxicity by compression distance: two zstandard dictionaries, windows compressed with each.

Words of labelled toxic texts that ordinary texts hardly have mark where the toxic passages are.  One
dictionary is trained on those passages, one on ordinary text.  Both compressors get the ordinary
dictionary's content as common ground, the toxic one has the toxic dictionary before it.  A window of
``WINDOW`` bytes, every ``STRIDE`` bytes, is compressed with both: its gain is the ordinary length minus the
toxic length; every window is compressed (``GRAM`` bytes are the shortest match).  A text's largest gains and the number and density of windows that stand out go through a logistic curve,
calibrated on labelled texts that its dictionaries haven't seen.

Training uses a bounded sample: ``SAMPLE`` labelled rows a class in order of the md5 of their id, texts of
at most ``LONGEST`` characters.  The two dictionaries are some ten KB each, whatever the corpus.

Defined results: null and empty texts score as a text without any gain; without both labels in the sample
every score is the sample's mean label (0 without a sample); texts are read whole; equal texts score
alike; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, quoted

SAMPLE, LONGEST = 3000, 20_000
WINDOW, STRIDE, GRAM, LEAD = 32, 16, 5, 48
DICT_SIZE = 8192
#: A toxic marker is in at least so many toxic texts, in such a share of them, and in so many times the share of ordinary ones.
MARKER_TEXTS, MARKER_SHARE, MARKER_RATIO = 3, 0.012, 12.0
AROUND = 1
#: Gains that a window stands out by.
HIGH = (1, 2, 3, 4, 5)
BLOCK = 128
_WORDS = re.compile(r"\w{2,40}")


def markers(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words that toxic texts have and ordinary ones hardly do."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    a, b = Counter(), Counter()
    for texts, counts in ((toxic, a), (ordinary, b)):
        for t in texts:
            counts.update(set(_WORDS.findall(t)))
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    least = max(MARKER_TEXTS, MARKER_SHARE * n)
    return {w for w, c in a.items() if c >= least and (c / n) / ((b[w] + 0.5) / m) >= MARKER_RATIO}


def _passages(texts: list[str], marked: set[str]) -> list[bytes]:
    out = []
    for t in texts:
        for m in _WORDS.finditer(t):
            if m[0] in marked:
                raw = t[max(0, m.start() - AROUND) : m.end() + AROUND].encode()
                out.append(raw if len(raw) >= 8 else raw + raw)  # the trainer ignores shorter ones
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content that zstandard's trainer picks from the samples; the samples themselves where they are too few."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    try:
        if total < 4 * size:
            raise ValueError("too little for the trainer")
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()[-size:]
    except (ValueError, zstandard.ZstdError):
        return b"".join(dict.fromkeys(samples))[-size:]


class Gains:
    """Compressors of a fitted model; made once a worker."""

    def __init__(self, special: bytes, base: bytes):
        import zstandard

        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                6, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=14, min_match=GRAM
            )
            d.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=params)

        self.toxic, self.ordinary = compressor(special + base), compressor(base)
        # Each window follows a stretch that both dictionaries hold: a short input that barely compresses would
        # be stored as it is, and its gain be lost.  No match can reach over the bytes between the two.
        self.lead = base[-LEAD:] + bytes(range(GRAM - 1))

    def of(self, text: str) -> np.ndarray:
        """Gain of every window of the whole text."""
        raw = text.lower().encode("utf-8", "replace")
        n = max(1, -(-max(0, len(raw) - WINDOW) // STRIDE) + 1)
        tox, ordi, lead = self.toxic.compress, self.ordinary.compress, self.lead
        windows = (lead + raw[at : at + WINDOW] for at in range(0, n * STRIDE, STRIDE))
        return np.fromiter((len(ordi(w)) - len(tox(w)) for w in windows), float, n)


def summary(gains: np.ndarray) -> np.ndarray:
    """What the curve sees of a text: its largest gains, how many windows stand out, and how densely."""
    top = np.sort(gains)[::-1][:4]
    top = np.concatenate([top, np.zeros(4 - len(top))])
    high = np.array([(gains > h).sum() for h in HIGH], float)
    return np.concatenate([[1.0], top[[0, 1, 3]], np.log1p(high), 100 * high / (len(gains) + 10)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int]) -> dict:
    """Dictionaries from two thirds of the rows, the curve from the rest; then dictionaries from all rows."""
    lower = [t.lower() for t in texts]

    def dictionaries(rows: list[int]) -> tuple[bytes, bytes]:
        toxic, ordinary = ([lower[i] for i in rows if labels[i] == y] for y in (1, 0))
        raw = (t.encode() for t in ordinary)
        plain = [r[i : i + 96] for r in raw for i in range(0, len(r), 96)][:60_000]
        return _trained(_passages(toxic, markers(toxic, ordinary)), DICT_SIZE), _trained(plain, DICT_SIZE)

    n = len(texts)
    if not n or len(set(labels)) < 2:
        return {"prior": float(np.mean(labels)) if n else 0.0}
    part = [i for i in range(n) if i % 3]
    rest = [i for i in range(n) if i % 3 == 0]
    if len({labels[i] for i in part}) < 2 or len({labels[i] for i in rest}) < 2:
        part = rest = list(range(n))
    gains = Gains(*dictionaries(part))
    x = np.array([summary(gains.of(texts[i])) for i in rest])
    w = _logistic(x, np.array([labels[i] for i in rest], np.float64))
    special, base = dictionaries(list(range(n)))
    return {"special": special, "base": base, "curve": w}


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled rows of each class; ``labelled`` has the id and 0/1 in ``label_col``."""
    rows = []
    texts = docs.select(col(docs, id_col).alias("id_"), col(docs, text_col).alias("x_")).where(F.length("x_") <= LONGEST)
    for y in (0, 1):
        pick = labelled.where((col(labelled, label_col) == y) & col(labelled, id_col).isNotNull()).select(col(labelled, id_col).alias("id_"))
        pick = pick.orderBy(F.md5(F.col("id_").cast("string")), "id_").limit(sample)
        got = texts.join(F.broadcast(pick), "id_").orderBy(F.md5(F.col("id_").cast("string")), "x_").limit(sample).collect()
        rows += [(r["x_"], y) for r in got]
    return fit([r[0] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a score from 0 to 1; higher is likelier toxic."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A kept column of the score's name stays; the score is then called by that name and an underscore.
    out_col = fresh(docs.select(*map(quoted, keep)), out_col)
    rows = docs.select(col(docs, text_col).alias(fresh(docs, "text__")), *[docs[quoted(c)] for c in keep])
    schema = rows.select(*[rows[quoted(c)] for c in keep], F.lit(0.0).alias(out_col)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gains = Gains(m["special"], m["base"]) if "curve" in m else None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if gains:
                    z = [float(summary(gains.of(t or "")) @ m["curve"]) for t in part.column(0).to_pylist()]
                    s = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
                else:
                    s = [m["prior"]] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64())], names=[*keep, out_col])

    return rows.mapInArrow(scored, schema)
