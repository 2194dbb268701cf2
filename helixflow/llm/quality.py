"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

Training takes a bounded sample of labelled documents (``sample_rows``), which the driver fits in numpy with quantile
bins, logistic loss and monotonic constraints. Scoring walks all trees of a batch at once, level by level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_as_bytes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "distinct_share", "words_per_line", "wide_share", "longest_word")
#: Sign of the effect on quality that is allowed; 0: any.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "digit_share": -1}

SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 continuation byte, 2 white space, 3 symbol, 4 upper, 5 digit, 6 punctuation, 7 lead byte of a wide character
_CLASS[0x80:0xC0] = 1
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 2
_CLASS[list(b".,;:!?\"'()-_/[]{}@+=~^`\\")] = 6
_CLASS[list(SYMBOLS)] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[0xC0:] = 7


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(index) + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The five base counts, then FEATURES."""
    text = text or b""
    words = text.split()
    n = len(words)
    by = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    points = len(text) - int(by[1])
    word_chars = points - int(by[2])
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    c = max(word_chars, 1)
    features = [
        float(np.log1p(n)), word_chars / max(n, 1), by[3] / c, dup / max(len(lines), 1), repeat / max(n, 1), by[4] / c, by[5] / c, by[6] / c,
        len(set(words)) / max(n, 1), n / max(len(lines), 1), by[7] / c, float(max(map(len, words), default=0)),
    ]
    return [n, word_chars, int(by[3]), dup, repeat], features


class Trees:
    """Boosted trees as flat arrays: all nodes of all trees one after another; a leaf points to itself."""

    def __init__(self, feature, threshold, left, right, value, roots, start, depth):
        self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.start, self.depth = feature, threshold, left, right, value, roots, start, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x."""
        if not len(x):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting on quantile bins. A split on a constrained feature must order its leaves as the sign says,
    and bounds handed down keep every leaf below on its side. Without two classes the model is their constant rate."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    rate0 = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    start = float(np.log(rate0 / (1 - rate0)))

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    if len(y) == 0 or y.min() == y.max():
        roots.append(node())
        return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), start, 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    f = np.full(len(y), start)
    leaf = lambda g, h: g / (h + ridge)

    def grow(rows, level, low, high, grad, hess) -> int:
        k = node()
        g, h = grad[rows].sum(), hess[rows].sum()
        value[k] = rate * float(np.clip(leaf(g, h), low, high))
        best = (1e-6, None)
        if level < depth:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(e) + 1))[:-1]
                gr, hr = g - gl, h - hl
                vl, vr = np.clip(leaf(gl, hl), low, high), np.clip(leaf(gr, hr), low, high)
                gain = gl * vl - (hl + ridge) * vl**2 / 2 + gr * vr - (hr + ridge) * vr**2 / 2 - (g * leaf(g, h) / 2)
                gain[(hl < least) | (hr < least)] = -np.inf
                if s := monotone.get(j, 0):
                    gain[s * (vr - vl) < 0] = -np.inf
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (gain[b], (j, b, vl[b], vr[b]))
        if best[1] is None:
            f[rows] += value[k]
            return k
        j, b, vl, vr = best[1]
        mid = (vl + vr) / 2
        s = monotone.get(j, 0)
        go = binned[rows, j] <= b
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[s]
        feature[k], threshold[k] = j, float(edges[j][b])
        left[k] = grow(rows[go], level + 1, *bounds[0], grad, hess)
        right[k] = grow(rows[~go], level + 1, *bounds[1], grad, hess)
        return k

    everything = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(everything, 0, -np.inf, np.inf, y - p, np.maximum(p * (1 - p), 1e-6)))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), start, depth)


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs that fit, then the base counts and ``stats`` (array of FEATURES)."""
    return _mapped(docs, None, text)


def _mapped(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    import pyarrow as pa

    own = [c for c in docs.columns if c not in (*BASE, "stats", "quality_score")]
    schema = docs.select(*own).schema
    for name in BASE:
        schema = schema.add(name, "long")
    schema = schema.add("stats", T.ArrayType(T.DoubleType())) if trees is None else schema.add("quality_score", "double")

    def run(batches):
        for batch in batches:
            found = [statistics(t) for t in texts_as_bytes(batch.column(batch.schema.get_field_index(text)))]
            base = np.array([f[0] for f in found], np.int64).reshape(-1, len(BASE))
            x = np.array([f[1] for f in found], float).reshape(-1, len(FEATURES))
            last = pa.array(list(x), pa.list_(pa.float64())) if trees is None else pa.array(trees.score(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *(pa.array(base[:, k]) for k in range(len(BASE))), last], names=schema.names)

    return docs.mapInArrow(run, schema)


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents, those of least xxhash64(doc_id). Labels that are null, and
    documents without a label, are left out; a doc_id labelled more than once takes its lowest label."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = document_statistics(picked).select("doc_id", "quality", "stats").orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(2 * sample_rows).collect()
    x = np.array([r["stats"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([float(r["quality"] > 0) for r in rows])
    return fit_trees(x, y, {FEATURES.index(k): v for k, v in MONOTONE.items()})


def quality_rules(docs: DataFrame, trees: Trees, least_words: int = 50, repeat_percent: int = 50, threshold: float = 0.3) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality_score, base_failed and kept.

    Null or empty texts have no words and fail the base rules. Every row is judged on its own; repeated rows alike.
    Columns of docs that bear one of these names are replaced; an empty table gives an empty one.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = _mapped(docs.drop("base_failed", "kept"), trees)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= threshold))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees).select("doc_id", *BASE, "base_failed", "kept", "quality_score")
