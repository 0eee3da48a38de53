"""Benchmark decontamination: a BM25 index of test items queried by every passage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .language_id import fold
from .vectors import U64, chunks, text_bytes, word_bounds, words

#: Everything in ASCII but letters and digits separates words here.
_SPLIT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
K1, B = 1.2, 0.75
#: Items of one index block.
BLOCK = 4
_GRAM = U64(0x9E3779B97F4A7C15)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Case-folded word hashes, the bounds of each text, and the bytes with word ends."""
    data, offsets = text_bytes(texts)
    low = fold(data)
    h, doc, _, end = words(low, offsets, _SPLIT, np.arange(256, dtype=np.uint8))
    return h, word_bounds(doc, len(texts)), low, end


def grams(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Hashes of n consecutive words (all of them, if fewer)."""
    n = max(1, min(n, len(h)))
    out = np.zeros(max(0, len(h) - n + 1), U64)
    for j in range(n):
        out = out * _GRAM + h[j : j + len(out)]
    return np.unique(out)


@dataclass
class Corpus:
    """What BM25 takes from all items: their number, mean length, and in how many a term is (terms sorted)."""

    items: int
    mean: float
    terms: np.ndarray
    count: np.ndarray


class BlockMaxIndex:
    """Postings with impacts divided by the item's own score, in blocks of items.

    With that scaling one threshold serves all items: an item that is wholly
    in a passage scores 1.
    """

    def __init__(self, item_ids: list, texts: pa.Array, corpus: Corpus | None = None):
        h, bounds, low, end = plain_words(texts)
        keep = np.flatnonzero(np.diff(bounds) > 0)
        self.items = [item_ids[i] for i in keep]
        self.words = [h[bounds[i] : bounds[i + 1]] for i in keep]
        self.parts = [self._split(w, low, end[bounds[i] : bounds[i + 1]]) for w, i in zip(self.words, keep)]
        self.longest = max((len(w) for w in self.words), default=0)
        self._post(corpus)

    @staticmethod
    def _split(w: np.ndarray, low: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Question and answer: the last sentences that make up a third of the item answer, else its last third."""
        third = max(1, len(w) // 3)
        stops = np.flatnonzero(np.isin(low[np.minimum(end, len(low) - 1)], [33, 46, 63])) + 1
        stops = stops[(stops > 0) & (stops <= len(w) - third)]
        cut = int(stops[-1]) if len(stops) else max(1, len(w) - third)
        return [(grams(x), min(3, len(x))) for x in (w[:cut], w[cut:] if cut < len(w) else w)]

    def _post(self, corpus: Corpus | None) -> None:
        n = len(self.words)
        length = np.array([len(w) for w in self.words], float)
        term, item, tf = [], [], []
        for i, w in enumerate(self.words):
            u, c = np.unique(w, return_counts=True)
            term.append(u)
            item.append(np.full(len(u), i))
            tf.append(c)
        if not n:
            self.terms = np.zeros(0, U64)
            return
        term, item, tf = np.concatenate(term), np.concatenate(item), np.concatenate(tf)
        self.terms, t = np.unique(term, return_inverse=True)
        corpus = corpus or Corpus(n, length.mean(), self.terms, np.bincount(t))
        df = corpus.count[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log(1 + (corpus.items - df + 0.5) / (df + 0.5))
        impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / corpus.mean))
        impact /= np.bincount(item, impact)[item]
        order = np.lexsort((item, t))
        t, self.item, self.impact = t[order], item[order], impact[order]
        self.first = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.top = np.maximum.reduceat(self.impact, self.first[:-1])
        # Block maxima, and the posting at which each block of a list begins.
        code = t * (n // BLOCK + 1) + self.item // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.block_first = np.searchsorted(t[begin], np.arange(len(self.terms) + 1))
        self.block = self.item[begin] // BLOCK
        self.block_top = np.maximum.reduceat(self.impact, begin)

    def split_terms(self, threshold: float) -> None:
        """Frequent terms that give no item over half the threshold are not essential.

        Items over the threshold then owe the rest to essential terms.
        """
        t = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        df = np.diff(self.first)
        order = np.argsort(-df, kind="stable")
        a, b = 0, len(order)
        low_mass = lambda m: np.bincount(self.item, self.impact * np.isin(t, order[:m]), minlength=len(self.items))
        while a < b:
            m = (a + b + 1) // 2
            if low_mass(m).max() <= threshold / 2:
                a = m
            else:
                b = m - 1
        self.essential = np.ones(len(self.terms), bool)
        self.essential[order[:a]] = False
        mass = low_mass(a)
        self.owed = np.zeros(len(self.items) // BLOCK + 1)
        np.maximum.at(self.owed, np.arange(len(mass)) // BLOCK, mass)
        self.owed = threshold - self.owed - 1e-9


def block_max_wand(index: BlockMaxIndex, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items whose score for a passage's distinct terms reaches the threshold."""
    at = {int(t): int(index.first[t]) for t in terms}
    block_at = {t: int(index.block_first[t]) for t in at}
    item, impact, first, block, block_first = index.item, index.impact, index.first, index.block, index.block_first
    found = []
    cursors = sorted(at, key=lambda t: item[at[t]])

    def skip(t: int, to: int) -> bool:
        end = int(first[t + 1])
        at[t] += int(np.searchsorted(item[at[t] : end], to))
        return at[t] < end

    def block_bound(t: int, target: int) -> tuple[float, int]:
        i, end = block_at[t], int(block_first[t + 1])
        while i < end and block[i] < target:
            i += 1
        block_at[t] = i
        if i == end or block[i] > target:
            return 0.0, target + 1
        return float(index.block_top[i]), target + 1

    while cursors:
        bound, pivot = 0.0, -1
        for i, t in enumerate(cursors):
            bound += index.top[t]
            if bound >= threshold - 1e-9:
                pivot = i
                break
        if pivot < 0:
            break
        target = int(item[at[cursors[pivot]]])
        while pivot + 1 < len(cursors) and item[at[cursors[pivot + 1]]] == target:
            pivot += 1
        ahead = cursors[: pivot + 1]
        if sum(block_bound(t, target // BLOCK)[0] for t in ahead) < threshold - 1e-9:
            # No item of this block can do it: go on with the next block, or with the next list's item.
            to = (target // BLOCK + 1) * BLOCK
            if pivot + 1 < len(cursors):
                to = min(to, int(item[at[cursors[pivot + 1]]]))
        elif item[at[cursors[0]]] == target:
            score = float(sum(impact[at[t]] for t in ahead))
            if score >= threshold - 1e-9:
                found.append((target, score))
            to = target + 1
        else:
            to = target
        live = [t for t in ahead if item[at[t]] >= to or skip(t, to)]
        cursors = sorted(live + cursors[pivot + 1 :], key=lambda t: item[at[t]])
    return found


def _search(shared: list, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, bounds, _, _ = plain_words(batch.column("text"))
            for one in shared:
                yield search(one.value, batch, h, bounds)

    def search(index: BlockMaxIndex, batch: pa.RecordBatch, h: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        size = max(128, 2 * index.longest)
        step = size // 2
        out = []
        place = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
        hits = np.flatnonzero(index.terms[place] == h)
        term = place[hits]
        doc = np.searchsorted(bounds, hits, side="right") - 1
        # Passages of 2 * step words, a step apart: a word lies in two.
        piece = (hits - bounds[doc]) // step
        last = np.maximum(1, -(-np.diff(bounds) // step) - 1)
        base = np.cumsum(last) - last
        strong = index.essential[term]
        passage = np.concatenate([base[doc] + np.minimum(piece, last[doc] - 1), base[doc] + np.maximum(piece - 1, 0)])
        both = np.concatenate([strong, strong])
        code = np.unique(passage[both] * len(index.terms) + np.concatenate([term, term])[both])
        p, t = code // len(index.terms), code % len(index.terms)
        n = index.block_first[t + 1] - index.block_first[t]
        row = np.repeat(np.arange(len(t)), n)
        b = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + index.block_first[t][row]
        key = p[row] * (len(index.owed)) + index.block[b]
        u, back = np.unique(key, return_inverse=True)
        likely = np.bincount(back, index.block_top[b], minlength=len(u)) >= index.owed[u % len(index.owed)]
        for x in np.unique(u[likely] // len(index.owed)):
            d = int(np.searchsorted(base, x, side="right") - 1)
            a = bounds[d] + (x - base[d]) * step
            here = h[a : min(a + size, bounds[d + 1])]
            i, j = np.searchsorted(hits, [a, a + len(here)])
            own = None
            for item, score in block_max_wand(index, np.unique(term[i:j]), threshold):
                own = own if own is not None else [grams(here, m) for m in (1, 2, 3)]
                shares = [float(np.isin(part, own[n - 1]).mean()) for part, n in index.parts[item]]
                if min(shares) >= overlap:
                    out.append((d, item, int(x - base[d]), score, *shares))
        ids = batch.column("doc_id").take(pa.array([o[0] for o in out], pa.int64()))
        return pa.record_batch(
            [
                ids,
                pa.array([str(index.items[o[1]]) for o in out], pa.string()),
                *[pa.array([o[k] for o in out], kind) for k, kind in ((2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64()))],
            ],
            ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"],
        )

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each term of each item once; without a term, the number of items with words and of their words."""
    for batch in batches:
        h, bounds, _, _ = plain_words(batch.column("text"))
        size = np.diff(bounds)
        item = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((item, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (item[order][1:] != item[order][:-1])
        terms = h[order][new].view(np.int64)
        none = np.zeros(len(terms), np.int64)
        yield pa.record_batch(
            [pa.array([*terms.tolist(), None], pa.int64()), pa.array(np.append(none + 1, (size > 0).sum())), pa.array(np.append(none, len(h)))],
            ["term", "n", "words"],
        )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    threshold: float = 0.6,
    overlap: float = 0.6,
    shard_items: int = 50_000,
    shards_a_pass: int = 4,
) -> DataFrame:
    """doc_id, item_id, passage, score, question_overlap, answer_overlap: one row for each pair.

    Every passage of every text (twice the longest item, half overlapping, so
    that an item lies whole in one) is a query on a BM25 index of the items.
    Scores are fractions of the item's own score. Upper bounds of whole blocks
    from essential terms pick passages; block-max WAND then returns every item
    at ``threshold`` or more; a hit counts if the passage holds ``overlap`` of
    the word trigrams of both the item's question and its answer (its last
    sentences, as many as make up a third of its words; the last third where
    that leaves no question). Case, punctuation and blanks don't matter.

    Shards of about ``shard_items`` items are broadcast, ``shards_a_pass`` for
    each pass over the texts, so what is sent at once has a bound; items over
    all shards together give the BM25 statistics, so scores don't depend on the
    shards. Null and empty texts and items without words match nothing.
    Repeated rows and items give one row for each pair, the best (of equal
    ones the first passage). Null ids are kept as null. Passages are of fixed
    length, so a text of any length takes memory for its words alone. Empty
    tables give empty results.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (benchmark, item_col)))
    schema = f"doc_id {id_type}, item_id string, passage long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text")).where("text is not null").distinct()
    shards = max(1, -(-items.count() // shard_items))
    if shards > 1:
        counted = materialise(items.mapInArrow(_item_terms, "term long, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "bm25-terms")
        total = counted.where("term is null").first()
    held = []
    for s in range(shards):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == s)
        mine = some.orderBy("item", "text").toArrow()
        corpus = None
        if shards > 1:
            terms = counted.join(some.mapInArrow(_item_terms, "term long, n long, words long").select("term").distinct(), "term").select("term", "n").toArrow()
            order = np.argsort(terms.column("term").to_numpy().view(U64))
            corpus = Corpus(total["n"], total["words"] / total["n"], terms.column("term").to_numpy().view(U64)[order], terms.column("n").to_numpy()[order])
        index = BlockMaxIndex(mine.column("item").to_pylist(), mine.column("text").combine_chunks(), corpus)
        if index.items:
            index.split_terms(threshold)
            held.append(spark.sparkContext.broadcast(index))
        if held and (len(held) == shards_a_pass or s == shards - 1):
            found = found.union(base.mapInArrow(_search(held, threshold, overlap), schema))
            held = []
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("passage")).alias("p"))).alias("best")
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            F.col("item_id").cast(item_type).alias("item_id"),
            (-F.col("best.p")).alias("passage"),
            "best.score",
            "best.question_overlap",
            "best.answer_overlap",
        )
    )
