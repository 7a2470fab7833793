"""A quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into ``FEATURES`` numbers.  Trees are grown
level by level on histograms of at most ``BINS`` quantile bins a feature, with
the logistic loss.  All trees are complete and of one depth, so the forest is
three flat arrays, and scoring walks all trees of all rows at once, one level a
step.

It learns from at most ``sample`` labelled documents, those of least hash of the
id, an id that occurs in several rows once (with its least label and least
statistics); their statistics are all the driver gets.  Language, source and id
are no inputs.

Defined cases: null text counts as empty, and empty texts get a score;
labels other than 0 and 1 are ignored; without labels every score is 0.5, with
labels of one kind all scores lie on its side; repeated rows get equal scores;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices
from .language_id import held_out

BINS = 64
FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "stops", "symbols", "other_marks", "beyond_ascii", "line_feeds", "byte_entropy",
    "distinct_words", "same_as_last", "log_line_length", "repeated_lines", "unended_lines", "log_longest_word", "short_words", "commonest_word", "distinct_triples", "marks_in_words", "log_lines",
]

_groups = np.zeros((256, 6), np.float64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"#$%&*<>|~^{}[]\\/=+_@`", b"!?\"'()-")):
    _groups[list(_chars), _k] = 1
_groups[128:, 5] = 1
_WORD_MARK = re.compile(r"[#$%&*<>|~^{}\[\]\\/=+_@`!]")


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``FEATURES``, over the whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    share = hist[hist > 0] / n
    upper, digits, stops, symbols, other, beyond = (hist @ _groups / n).tolist()
    words, lines = text.split(), text.split("\n")
    w, n_lines = max(1, len(words)), len(lines)
    count = Counter(words)
    lengths = list(map(len, words))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    filled = [s for s in map(str.strip, lines) if s]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(lengths) / w, upper, digits, stops, symbols, other, beyond, hist[10] / n, float(-(share * np.log2(share)).sum()),
        len(count) / w, sum(map(eq, words, words[1:])) / w, np.log1p(len(text) / n_lines), 1 - len(set(filled)) / max(1, len(filled)), sum(s[-1] not in ".!?:;" for s in filled) / max(1, len(filled)),
        np.log1p(max(lengths, default=0)), sum(x <= 3 for x in lengths) / w, max(count.values(), default=0) / w, triples / max(1, len(words) - 2), len(_WORD_MARK.findall(text)) / w, np.log1p(n_lines),
    ]


class Forest:
    """Complete trees of one depth as flat arrays ``feature, threshold`` (trees x inner nodes) and ``leaf``."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 2.0):
        self.trees, self.depth, self.rate, self.l2 = trees, depth, rate, l2
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.threshold = np.zeros((0, 2**depth - 1))
        self.leaf = np.zeros((0, 2**depth))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        n_inner, n_feat = 2**self.depth - 1, x.shape[1]
        flat = binned + np.arange(n_feat) * BINS
        margin = np.full(len(y), self.base)
        feature, threshold, leaf = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            f, t, node = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf), np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (n_feat * BINS) + flat).ravel()
                shape = (width, n_feat, BINS)
                g = np.bincount(at, np.repeat(grad, n_feat), width * n_feat * BINS).reshape(shape)
                h = np.bincount(at, np.repeat(hess, n_feat), width * n_feat * BINS).reshape(shape)
                gl, hl = g.cumsum(2), h.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                for k in range(width):
                    best = int(gain[k].argmax())
                    j, b = divmod(best, BINS)
                    if gain[k].flat[best] > 1e-6 and b < len(cuts[j]):
                        f[first + k], t[first + k] = j, cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
            end = node - n_inner
            value = -self.rate * np.bincount(end, grad, n_inner + 1) / (np.bincount(end, hess, n_inner + 1) + self.l2)
            margin += value[end]
            feature.append(f)
            threshold.append(t)
            leaf.append(value)
        self.feature, self.threshold, self.leaf = np.array(feature), np.array(threshold), np.array(leaf)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all trees of all rows take one level at a step."""
        tree, row = np.arange(len(self.feature))[None], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth if len(self.feature) else 0):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        margin = self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(1) if len(self.feature) else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-margin))


def _with_statistics(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most ``sample`` rows of two numbers

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _with_statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "label", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.mapInArrow(run, f"id {kind}, label int, x array<double>")
    found = measured.groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas()
    if not len(found):
        return Forest()
    found = found.assign(x=found["x"].map(tuple)).sort_values(["id", "label", "x"], kind="stable")
    return Forest().fit(np.array(found["x"].tolist()), found["label"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for each row; no shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [s for lo, hi in text_slices(texts) for s in forest.scores(_with_statistics(texts[lo:hi])).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64())], ["id", "held_out", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
