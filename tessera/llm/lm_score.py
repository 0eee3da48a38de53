"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tasks_for
from .counting import Tally, split_slices
from .vectors import U64, chunks, long_column, mix, text_bytes, word_bounds, words

#: The token that ends a text; as a history it also stands for its beginning.
END = mix(np.array([0xE4D], U64))[0]
#: The base of the count levels.
LEVEL_BASE = 1.5
_PAIR = U64(0xD6E8FEB86659FD93)
_LEVEL_LOW = np.unique(np.floor(LEVEL_BASE ** np.arange(0, 110)).astype(np.float64))


def level(count: np.ndarray) -> np.ndarray:
    """The quantised count: the number of level bounds that it reaches."""
    return np.searchsorted(_LEVEL_LOW, count, side="right")


def level_value(q: np.ndarray) -> np.ndarray:
    """The middle of a level; 0 for level 0."""
    low = np.concatenate([[0.0], _LEVEL_LOW])
    high = np.concatenate([[0.0], _LEVEL_LOW[1:] - 1, [_LEVEL_LOW[-1]]])
    return (low[q] + high[q]) / 2


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the end token after each text, and n + 1 bounds."""
    data, offsets = text_bytes(batch.column("text"))
    h, doc, _, _ = words(data, offsets)
    n = len(offsets) - 1
    bounds = word_bounds(doc, n)
    out = np.empty(len(h) + n, U64)
    at = np.arange(len(h)) + doc
    out[at] = h
    ends = bounds[1:] + np.arange(n)
    out[ends] = END
    return out, np.concatenate([[0], ends + 1])


def _pairs(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of each token with the token before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = END
    return mix(before * _PAIR + tokens)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally(2_000_000)

    def rows():
        h, n = tally.take()
        return pa.record_batch([long_column(h), long_column(n)], ["h", "n"])

    for batch in chunks(batches):
        tally.add(_tokens(batch)[0])
        if tally.full():
            yield rows()
    if tally.parts:
        yield rows()


def _gather(most: int):
    """Rows packed to chunks of about ``most`` bytes of text: what one round of probes covers."""

    def pack(held):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.record_batch([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return run


def _unpack(rows: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a chunk, their token hashes and n + 1 bounds."""
    batches = pa.ipc.open_stream(rows).read_all().to_batches()
    parts = [_tokens(b) for b in batches]
    starts = np.cumsum([0, *(len(t) for t, _ in parts)])
    bounds = np.concatenate([[0], *(b[1:] + s for (_, b), s in zip(parts, starts))])
    return pa.Table.from_batches(batches), np.concatenate([t for t, _ in parts]), bounds


def _ship_grams(slices: int):
    """The distinct n-grams of each chunk by slice of the hash space, in the order of their hashes, and how often each is trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                table, tokens, bounds = _unpack(rows.as_py())
                held_out = table.column("held_out").to_numpy()
                trained = np.repeat(~held_out.astype(bool), np.diff(bounds))
                grams, back = np.unique(np.concatenate([tokens, _pairs(tokens, bounds)]), return_inverse=True)
                n = np.bincount(back, np.concatenate([trained, trained]), len(grams)).astype(np.int64)
                part, low = split_slices(grams, slices)
                cut = np.searchsorted(part, np.arange(slices + 1))
                out = []
                for s in np.flatnonzero(np.diff(cut)):
                    m = n[cut[s] : cut[s + 1]]
                    out.append((int(s), chunk, low[cut[s] : cut[s + 1]].tobytes(), np.minimum(m, 255).astype(np.uint8).tobytes(), m[m >= 255].tobytes()))
                types = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], ["slice", "chunk", "low", "n", "more"])

    return run


def _positions(low: np.ndarray, q, hashes: int, bits: int) -> np.ndarray:
    """The bits of items (n-gram, level): one row for each hash function."""
    item = mix((low.astype(U64) << U64(8)) + np.asarray(q).astype(U64))
    a, b = item & U64(0xFFFFFFFF), (item >> U64(32)) | U64(1)
    return np.stack([((a + U64(i) * b) & U64(0xFFFFFFFF)) * U64(bits) >> U64(32) for i in range(hashes)])


def fill(low: np.ndarray, n: np.ndarray, bits_per_item: int) -> tuple[bytes, int]:
    """One slice's part of the filter, as large as its items need, and its number of hash functions."""
    q = level(n)
    items = int(q.sum())
    size = max(8, items * bits_per_item // 8 + 1)
    hashes = max(1, min(8, round(math.log(2) * size * 8 / max(1, items))))
    filled = np.zeros(size * 8, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        filled[_positions(low[q >= j], j, hashes, size * 8)] = True
    return np.packbits(filled, bitorder="little").tobytes(), hashes


def _answer(slices: int, bits_per_item: int):
    """The owner of a slice adds up its counts, fills its part of the filter and answers the probes of every chunk."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("low")]
        counts = []
        for x, more in zip(rows.column("n"), rows.column("more")):
            m = np.frombuffer(x.as_py(), np.uint8).astype(np.int64)
            m[m == 255] = np.frombuffer(more.as_py(), np.int64)
            counts.append(m)
        low, back = np.unique(np.concatenate(lows), return_inverse=True)
        n = np.zeros(len(low), np.int64)
        np.add.at(n, back, np.concatenate(counts))
        s = key[0].as_py()
        model = LogFrequencyFilter({s: fill(low[n > 0], n[n > 0], bits_per_item)}, slices)
        q = model.probe(np.full(len(low), s), low).astype(np.uint8)[back]
        cut = np.cumsum([0, *map(len, lows)])
        return pa.table({"chunk": rows.column("chunk"), "slice": rows.column("slice"), "levels": pa.array([q[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    return run


class LogFrequencyFilter:
    """Counts by repeated membership probes; parts are owned by hash slices."""

    def __init__(self, parts: dict[int, tuple[bytes, int]], slices: int):
        self.slices = slices
        sizes = [len(parts[s][0]) if s in parts else 0 for s in range(slices)]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = np.frombuffer(b"".join(parts[s][0] for s in range(slices) if s in parts), np.uint8)
        self.hashes = np.array([parts[s][1] if s in parts else 0 for s in range(slices)])

    def levels(self, h: np.ndarray) -> np.ndarray:
        return self.probe(*split_slices(h, self.slices))

    def probe(self, part: np.ndarray, low: np.ndarray) -> np.ndarray:
        q = np.zeros(len(low), np.int64)
        size = ((self.start[1:] - self.start[:-1]) * 8)[part]
        live = np.flatnonzero(size > 0)
        j = 1
        while len(live):
            item = mix((low[live].astype(U64) << U64(8)) + U64(j))
            a, b = item & U64(0xFFFFFFFF), (item >> U64(32)) | U64(1)
            hit = np.arange(len(live))
            for i in range(int(self.hashes[part[live]].max())):
                x = live[hit]
                at = (((a[hit] + U64(i) * b[hit]) & U64(0xFFFFFFFF)) * size[x].astype(U64) >> U64(32)).astype(np.int64)
                yes = (self.bits[self.start[part[x]] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1
                hit = hit[(yes == 1) | (i >= self.hashes[part[x]])]
            live = live[hit]
            q[live] = j
            j += 1
            if j > 110:
                break
        return q


def _score(shared, n_total: int, n_types: int, prior: float, slices: int):
    """Per text: counts, the share of the base score that the head explains, and the model's score."""
    scale = n_total + n_types + 1

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        head_h, head_n = shared.value
        head_h, head_n = np.frombuffer(head_h, U64), np.frombuffer(head_n, np.int64)

        def exact(u):
            if not len(head_h):
                return np.zeros(len(u), bool), np.zeros(len(u))
            at = np.minimum(np.searchsorted(head_h, u), len(head_h) - 1)
            found = head_h[at] == u
            return found, np.where(found, head_n[at], 0).astype(float)

        table, tokens, bounds = _unpack(left.column("rows")[0].as_py())
        pairs = _pairs(tokens, bounds)
        grams = np.unique(np.concatenate([tokens, pairs]))
        cut = np.searchsorted(split_slices(grams, slices)[0], np.arange(slices + 1))
        levels = np.zeros(len(grams), np.uint8)
        for s, found in zip(right.column("slice").to_pylist(), right.column("levels")):
            levels[cut[s] : cut[s + 1]] = np.frombuffer(found.as_py(), np.uint8)
        u, back = np.unique(tokens, return_inverse=True)
        in_head, count = exact(u)
        estimate = np.where(in_head, count, level_value(levels[np.searchsorted(grams, u)]))
        seen = level_value(levels[np.searchsorted(grams, pairs)])
        before = np.empty_like(back)
        before[1:] = back[:-1]
        before[bounds[:-1]] = np.searchsorted(u, END)
        history = estimate[before]
        seen = np.minimum(seen, np.minimum(history, estimate[back]))
        p = (seen + prior * (estimate[back] + 1) / scale) / (history + prior)
        sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  no text is without a token
        known = in_head[back]
        # Words outside the head: distinct per text, to be counted by a join.
        rest = np.flatnonzero(~known)
        doc = np.searchsorted(bounds, rest, side="right") - 1
        code, m = np.unique(doc.astype(np.int64) * len(u) + back[rest], return_counts=True)
        owner = code // max(1, len(u))
        tail = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(len(bounds))), pa.int32()),
            pa.StructArray.from_arrays([long_column(u[code % max(1, len(u))]), long_column(m)], ["h", "m"]),
        )
        return pa.table(
            [
                table.column("doc_id"),
                table.column("held_out"),
                table.column("print"),
                long_column(np.diff(bounds)),
                long_column(sums(known.astype(np.int64))),
                pa.array(sums(np.where(known, np.log10(count[back] + 1), 0.0))),
                pa.array(sums(np.log10(p))),
                tail,
            ],
            ["doc_id", "held_out", "print", "n_tokens", "n_head", "head_log", "score", "tail"],
        )

    return run


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: int = 2,
    folds: int = 7,
    head: int = 500_000,
    bits_per_item: int = 12,
    prior: float = 200.0,
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(id as text) mod ``folds`` is not
    ``fold``. Texts are packed to chunks of about ``chunk_bytes``. A chunk sends
    its distinct 1- and 2-grams with their training counts to the owners of
    their hash slices. An owner sums and quantises the counts (levels of base
    1.5), fills its part of the log-frequency Bloom filter, which holds
    (n-gram, j) for every level j up to the n-gram's at ``bits_per_item``
    whatever the corpus, and sends the probed levels back to the chunks. So
    the filter grows with the n-grams, slice by slice, and is never gathered.
    A probe counts upwards through the levels until one is missing.

    score: log10 of the product of (seen + prior * p1) / (history + prior)
    with p1 = (count + 1) / (N + V + 1). base_score needs exact counts: the
    ``head`` most frequent words are broadcast (16 bytes each at most), the
    rest, rare by construction, meet their counts in a join.

    A text is hashed as a whole by one task, which takes about 40 times its
    bytes. The head takes whole bands of counts, so no tie is cut. Null text is
    empty: one end token. Null ids are trained on (their crc32 is
    null) and not held out. Rows that repeat id and text get equal rows. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    train = base.where(~F.col("held_out")).select("text")

    counts = materialise(train.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    n_total, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("h")).first()
    # The head is whole bands of counts, at most ``head`` words: no sort, and no task gathers candidates.
    band = F.floor(F.log("n") / math.log(1.05))
    least, words_so_far = None, 0
    for r in counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        words_so_far += r["count"]
        if words_so_far > head:
            break
        least = r["band"]
    top = counts.where(band >= least if least is not None else F.lit(False)).toArrow()
    top_h = top.column("h").to_numpy().view(U64)
    order = np.argsort(top_h)
    top_h, top_n = top_h[order], top.column("n").to_numpy()[order]

    shared = spark.sparkContext.broadcast((top_h.tobytes(), top_n.astype(np.int64).tobytes()))

    # Chunks are written once, so that requests and answers are about the same rows.
    slices = tasks_for(spark, docs)
    packed = materialise(base.withColumn("print", F.xxhash64("text")).mapInArrow(_gather(chunk_bytes), "chunk long, rows binary"), "lm-chunks")
    answers = (
        packed.mapInArrow(_ship_grams(slices), "slice int, chunk long, low binary, n binary, more binary")
        .groupBy("slice")
        .applyInArrow(_answer(slices, bits_per_item), "chunk long, slice int, levels binary")
    )
    id_type = base.schema["doc_id"].dataType.simpleString()
    main = materialise(
        packed.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            _score(shared, n_total, n_types, prior, slices),
            f"doc_id {id_type}, held_out boolean, print long, n_tokens long, n_head long, head_log double, score double, tail array<struct<h:long,m:long>>",
        ),
        "lm-scores",
    )
    tail = (
        main.where(F.size("tail") > 0)
        .dropDuplicates(["doc_id", "print"])
        .select("doc_id", "print", F.inline("tail"))
        .join(counts, "h")
        .groupBy(F.col("doc_id").alias("tail_id"), F.col("print").alias("tail_print"))
        .agg(F.sum("m").alias("n_tail"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("tail_log"))
    )
    joined = main.drop("tail").join(
        tail, F.col("doc_id").eqNullSafe(F.col("tail_id")) & (F.col("print") == F.col("tail_print")), "left"
    )
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_total)).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * math.log10(n_total + n_types + 1)).alias("base_score"),
        "score",
    )
