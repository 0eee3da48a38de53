"""Language identification by a byte convolutional network, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed_row
from .vectors import _LOWER, chunks, text_bytes

#: Bytes of a window, byte embedding size, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4, 5), 10
STEP = WINDOW - max(WIDTHS) + 1
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the accented Latin capitals, byte by byte."""
    out = _LOWER[data].copy()
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def window_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of the texts begin, and their documents.

    Windows overlap by the widest filter less one, so they hold every n-gram.
    """
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (WINDOW - STEP)) // STEP))
    doc = np.repeat(np.arange(len(size)), n)
    return offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STEP, doc


def window_bytes(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Fixed-length windows, padded with zeros behind their text."""
    at = start[:, None] + np.arange(WINDOW)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(at < offsets[1:][doc][:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts and their documents."""
    start, doc = window_starts(offsets)
    return window_bytes(data, offsets, start, doc), doc


class ByteNetwork:
    """Embedding, filters of several widths, ReLU, max pooling and softmax."""

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        wide = max(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((wide * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters = rng.normal(0, 0.3, self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x].reshape(len(x), WINDOW * EMBED)
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), STEP, max(WIDTHS) * EMBED), (s[0], EMBED * s[1], s[1]))
        return view.reshape(len(x) * STEP, -1)

    def _pooled(self, x: np.ndarray):
        y = (self._columns(x) @ self.filters).reshape(len(x), STEP, -1)
        return y

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(x), 64):
            h = np.maximum(self._pooled(x[a : a + 64]).max(axis=1) + self.bias, 0)
            out.append(_softmax(h @ self.out + self.out_bias))
        return np.concatenate(out)

    def means(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean probabilities of each text over all its windows."""
        first, doc = window_starts(offsets)
        total = np.zeros((len(offsets) - 1, len(self.out_bias)))
        for a in range(0, len(doc), 4096):
            p = self.probabilities(window_bytes(data, offsets, first[a : a + 4096], doc[a : a + 4096]))
            np.add.at(total, doc[a : a + 4096], p)
        return total / np.bincount(doc, minlength=len(total))[:, None]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.004, seed: int = 6) -> None:
        """Adam on cross-entropy; the pooled positions alone carry gradients."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        state = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in names}
        t, wide = 0, max(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                one = order[a : a + batch]
                xb, n = x[one], len(one)
                conv = self._pooled(xb)
                at = conv.argmax(axis=1)
                z = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0] + self.bias
                h = np.maximum(z, 0)
                g = _softmax(h @ self.out + self.out_bias)
                g[np.arange(n), y[one]] -= 1
                g /= n
                gz = (g @ self.out.T) * (z > 0)
                grams = xb[np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)]
                picked = self.embed[grams].reshape(n, len(self.bias), -1)
                ge = np.zeros_like(self.embed)
                back = (gz[:, :, None] * self.filters.T).reshape(-1, EMBED)
                np.add.at(ge, grams.reshape(-1), back)
                grads = {
                    "out": h.T @ g,
                    "out_bias": g.sum(axis=0),
                    "bias": gz.sum(axis=0),
                    "filters": np.einsum("nf,nfc->cf", gz, picked) * self.mask,
                    "embed": ge,
                }
                t += 1
                for name in names:
                    m, v = state[name]
                    m *= 0.9
                    m += 0.1 * grads[name]
                    v *= 0.999
                    v += 0.001 * grads[name] ** 2
                    getattr(self, name)[...] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: Column, fold_no: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold_no, F.lit(False))


def labelled_sample(rows: DataFrame, max_texts: int, max_languages: int) -> DataFrame:
    """At most max_texts // languages rows of each ``lang``, those with the smallest ``key``.

    Every language is in the sample whatever its share. Rows are thinned by a
    bound on the key, by language, before they are ranked, so the tasks that
    rank read a few times the sample however many rows there are.
    """
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    each = max(1, max_texts // max(1, len(counts)))
    bounds = [(k, -(1 << 63) + int(2**64 * 4 * each / n) if n > 4 * each else (1 << 63) - 1) for k, n in counts.items()]
    bound = F.broadcast(rows.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*rows.columns))
    return rows.join(bound, "lang").where("key <= bound").drop("bound").withColumn("place", place).where(F.col("place") <= each).drop("place")


def train_network(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_texts: int, epochs: int, max_languages: int = 1000):
    """The network and its languages, from at most ``max_texts`` labelled texts outside the held-out fold.

    Of each sampled text it sees two windows of ``WINDOW`` characters at places
    that a hash of id and text picks.
    """
    text = F.col(text_col)
    spot = lambda j: F.pmod(F.xxhash64(F.col(id_col), text, F.lit(j)), F.greatest(F.lit(1), F.length(text_col) - 200)) + 1
    labelled = (
        docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
        .select(
            F.xxhash64(F.lit(3), F.col(id_col), text).alias("key"),
            F.col(lang_col).cast("string").alias("lang"),
            *[F.substr(text, spot(j).cast("int"), F.lit(WINDOW)).alias(f"w{j}") for j in range(2)],
        )
    )
    sample = labelled_sample(labelled, max_texts, max_languages).toArrow().sort_by([(c, "ascending") for c in ("key", "lang", "w0", "w1")])
    langs = sorted(set(sample.column("lang").to_pylist()))
    if not langs:
        return None, []
    x, y = [], []
    code = np.array([langs.index(v) for v in sample.column("lang").to_pylist()])
    for j in range(2):
        data, offsets = text_bytes(sample.column(f"w{j}").combine_chunks())
        got, doc = windows(fold(data), offsets)
        first = np.searchsorted(doc, np.arange(len(code)))
        x.append(got[first])
        y.append(code)
    network = ByteNetwork(len(langs))
    network.train(np.concatenate(x), np.concatenate(y), epochs)
    return network, langs


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, langs = shared.value
        for batch in chunks(batches, limit=1 << 20):
            texts = batch.column("text")
            data, offsets = text_bytes(texts)
            letters = np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()])
            lang, score = [UNKNOWN] * len(letters), np.zeros(len(letters))
            if langs and letters.any():
                mean = network.means(fold(data), offsets)
                best = mean.argmax(axis=1)
                for i in np.flatnonzero(letters):
                    lang[i] = langs[best[i]]
                score = np.where(letters, np.clip(mean.max(axis=1), 0, 1), 0.0)
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)]
            yield pa.record_batch(columns, ["row", "doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: bool = False,
    max_texts: int = 6000,
    epochs: int = 4,
) -> DataFrame:
    """row, doc_id, held_out, lang_pred and score for every input row.

    The network learns from at most ``max_texts`` rows of ``labelled`` (by
    default ``docs``) with text and language, as many of each language, never
    from ids whose crc32 mod 4 is 2, and sees bytes alone. All windows of a
    text are scored, in slices of 64, so a text of any length takes little
    besides its bytes; the language has the highest mean probability (ties:
    the smaller name), which is the score. A learned value or ``und`` (score 0)
    where text is null or has no letter (``\\p{L}``), or nothing could be
    learned. ``row`` is the whole input row if ``carry``, else null. Null ids
    are not held out; repeated rows get equal results; empty tables give
    empty results.
    """
    model = train_network(docs if labelled is None else labelled, id_col, text_col, lang_col, max_texts, epochs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = packed_row(docs) if carry else F.lit(None).cast("boolean")
    base = docs.select(
        row.alias("row"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )
    kind = lambda c: base.schema[c].dataType.simpleString() if c != "row" else base.select("row").schema["row"].dataType.simpleString()
    schema = f"row {kind('row')}, doc_id {kind('doc_id')}, held_out boolean, lang_pred string, score double"
    return base.mapInArrow(_predict(shared), schema)
