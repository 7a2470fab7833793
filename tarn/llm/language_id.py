"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes.  Filters of
several widths slide over a window; each keeps its largest response (max
pooling), and a dense layer with softmax turns the pooled responses into
languages.  A filter's response is a sum of weights looked up by byte and place,
so applying the network takes ``sum(WIDTHS)`` table look-ups a byte.  A
document's probabilities are those of its windows, weighted by their bytes; every
byte of the text is in one window.

The network is trained in numpy with Adam on a sample of labelled rows bounded
by about ``per_language`` rows for each language and ``sample`` rows in all, from
each of which one stretch of ``STRETCH`` characters at a hashed place is taken;
all bytes of the stretches are learned.  The sample and the training are
deterministic.  Any number of languages may occur.

Defined cases: a text that is null or has no letter is ``und`` with score 0,
and so is every text if there is nothing to learn from; rows without a language
are not learned from; repeated rows get equal results; an empty table gives an
empty table; no column but the text decides a prediction.  Columns of the input
that are named like a result (``lang_pred``, ``score``, in any case) give way to
it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back_memory, stash, text_slices, without

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
STRETCH = 512
UNDETERMINED = "und"


class ByteNet:
    """``tables[w][j, byte, filter]``, pooled over places, then ``dense`` and ``bias``."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = -1.0  # padding never wins the pooling
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest response of each filter in each window of ``x`` (windows x bytes), and its place."""
        best, at = [], []
        for w, table in zip(WIDTHS, self.tables, strict=True):
            n = x.shape[1] - w + 1
            act = table[0][x[:, :n]]
            for j in range(1, w):
                act += table[j][x[:, j : j + n]]
            if places:
                at.append(act.argmax(1))
            best.append(act.max(1))
        return np.concatenate(best, 1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), 64):
            z = np.maximum(self.pooled(x[i : i + 64])[0], 0) @ self.dense + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + 64] = z / z.sum(1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
        step, total = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                pick = order[lo : lo + batch]
                grads = self._gradients(x[pick], y[pick])
                step += 1
                speed = rate * (1 - 0.9 * step / total)
                for p, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                for t in self.tables:
                    t[:, 0] = -1.0

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        raw, at = self.pooled(x, places=True)
        hidden = np.maximum(raw, 0)
        z = hidden @ self.dense + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.dense.T) * (raw > 0)
        grads, rows, filters = [], np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        for k, (w, table, place) in enumerate(zip(WIDTHS, self.tables, at, strict=True)):
            g = np.zeros_like(table)
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[rows, place + j], filters), own)
            grads.append(g)
        return [*grads, hidden.T @ d, d.sum(0)]

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and score of texts, each cut into windows as a whole."""
        owner, chunks, sizes = [], [], []
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            n = -(-len(raw) // WINDOW)
            chunks.append(raw.ljust(n * WINDOW, b"\0"))
            owner += [i] * n
            sizes += [WINDOW] * (n - 1) + [len(raw) - (n - 1) * WINDOW] * (n > 0)
        x = np.frombuffer(b"".join(chunks), np.uint8).reshape(-1, WINDOW)
        total = np.zeros((len(texts), len(self.languages)))
        size = np.array(sizes, float)
        np.add.at(total, np.array(owner, int), self.probabilities(x) * size[:, None])
        weight = np.bincount(np.array(owner, int), size, len(texts))
        total /= np.maximum(weight, 1)[:, None]
        best = total.argmax(1)
        return [self.languages[b] for b in best], np.clip(total[np.arange(len(texts)), best], 0, 1).tolist()


def windows_of(stretch: str) -> list[bytes]:
    """All bytes of a stretch in windows; a short rest joins the window before it by overlapping it."""
    raw = stretch.encode("utf-8", "replace")
    starts = list(range(0, max(len(raw), 1), WINDOW))
    if len(starts) > 1 and len(raw) - starts[-1] < WINDOW // 4:
        starts[-1] = len(raw) - WINDOW
    return [raw[lo : lo + WINDOW].ljust(WINDOW, b"\0") for lo in starts]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept back from learning: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, per_language: int = 1500, sample: int = 100_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network learned from rows that are not held out; None if there are none."""
    hashed = F.xxhash64(F.lit("sample"), id_col)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & ~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.pmod(hashed, F.lit(1 << 30)).alias("place"),
        F.expr(f"substring(`{text_col}`, cast(1 + pmod(xxhash64('stretch', `{id_col}`), greatest(length(`{text_col}`) - {STRETCH}, 0) + 1) as int), {STRETCH})").alias("stretch"),
    )
    counts = stash(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n_languages = counts.count()
    if not n_languages:
        return None
    quota = max(1, min(per_language, sample // n_languages))
    # Spark broadcasts the counts if their written size allows, and shuffles the few columns of ``known`` else
    near = known.join(counts, "lang").where(F.col("place") < F.expr(f"cast({(1 << 30) * 1.1 * quota} / n + 1 as long)"))
    rows = near.orderBy("place", "lang", "stretch").limit(min(int(1.25 * quota * n_languages) + 64, sample)).select("lang", "stretch").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    x, y = [], []
    for r in rows:
        own = windows_of(r["stretch"])
        x += own
        y += [number[r["lang"]]] * len(own)
    net = ByteNet(languages)
    net.train(np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW), np.array(y))
    return net


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` behind its columns; no shuffle."""
    docs = without(docs, ["lang_pred", "score"], text_col)
    if net is None:
        return docs.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            letters = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = [], []
            for lo, hi in text_slices(texts, 1_000_000):
                a, b = net.predict([t if has else None for t, has in zip(texts[lo:hi], letters[lo:hi], strict=True)])
                names += a
                scores += b
            names = [n if has else UNDETERMINED for n, has in zip(names, letters, strict=True)]
            scores = [s if has else 0.0 for s, has in zip(scores, letters, strict=True)]
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns) - 2)] + ["lang_pred", "score"])
        give_back_memory()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = plain.select("*", has_letter_of(plain, at)).mapInArrow(run, f"{fields}, lang_pred string, score double")
    return found.toDF(*docs.columns, "lang_pred", "score")


def has_letter_of(df: DataFrame, at: int) -> Column:
    return F.coalesce(F.col(df.columns[at]).rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
