"""Repeated byte strings by a common-prefix-aware distributed merge sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks_for
from .counting import split_slices
from .vectors import _BYTE, U64, chunks, mix, powers, prefix_hash, text_bytes

#: Fills suffixes beyond the end of a document; no byte of UTF-8.
PAD = 0xFF
#: Bytes of text taken at a time; arrays of eight bytes a byte are made of it.
CHUNK = 512 << 10
#: Suffixes that are resolved at a time, at least, where their groups end.
BLOCK = 50_000
#: Anchors are small hashes, so their slices come from another hash.
_SPREAD = U64(0xA0761D6478BD642F)


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-byte strings that are least in some window.

    A window is any ``length`` bytes of one document. Which position of it is
    least depends on its content alone, so equal windows have their anchors at
    equal offsets, and every window has one.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    s = prefix_hash(data)
    _, inverse = powers(n + 1)
    h = mix((s[k:] - s[:-k]) * inverse[: n - k + 1])
    short = (h >> U64(32)).astype(np.uint32) | np.uint32(1)
    span = length - k + 1
    least = _slide(short, span, np.minimum)
    # Windows that cross documents count for nothing.
    start = np.arange(n - length + 1)
    doc = np.searchsorted(offsets, start, side="right")
    least[start + length > offsets[np.minimum(doc, len(offsets) - 1)]] = 0
    edge = np.zeros(span - 1, np.uint32)
    most = _slide(np.concatenate([edge, least, edge]), span, np.maximum)
    at = np.flatnonzero(most == short)
    return at, h[at]


def _ship_anchors(length: int, k: int, slices: int):
    """Anchor hashes by slice; those that one chunk repeats are known at once.

    Of a string that repeats in a chunk only one occurrence goes to the slice
    that counts it, so a string that all documents share does not gather there.
    """

    def pack(h, pos, p1, p2):
        _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        part, low = split_slices(mix(h[first] ^ _SPREAD), slices)
        sure = np.flatnonzero(n[back] > 1)
        spread = (p1[sure].view(U64) % U64(slices)).astype(np.int64)
        order, other = np.argsort(part, kind="stable"), np.argsort(spread, kind="stable")
        cut = np.searchsorted(part[order], np.arange(slices + 1))
        known_cut = np.searchsorted(spread[other], np.arange(slices + 1))
        rows = []
        for s in range(slices):
            mine = order[cut[s] : cut[s + 1]]
            all_of = np.concatenate([first[mine], sure[other[known_cut[s] : known_cut[s + 1]]]])
            if len(all_of):
                _, one, where = np.unique(p1[all_of] ^ p2[all_of], return_index=True, return_inverse=True)
                used = all_of[one]
                rows.append((s, low[mine].tobytes(), where.astype(np.uint32).tobytes(), pos[all_of].tobytes(), p1[used].tobytes(), p2[used].tobytes()))
        types = (pa.int32(), *[pa.binary()] * 5)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["slice", "low", "at", "pos", "p1", "p2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, limit=CHUNK):
            data, offsets = text_bytes(batch.column("text"))
            at, h = anchors(data, offsets, length, k)
            doc = np.searchsorted(offsets, at, side="right") - 1
            p1, p2 = (batch.column(c).to_numpy()[doc] for c in ("p1", "p2"))
            held.append((h, (at - offsets[doc]).astype(np.uint32), p1, p2))
            size += len(h)
            if size > 250_000:
                yield pack(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield pack(*(np.concatenate(x) for x in zip(*held)))

    return run


def _by_document(p1: np.ndarray, p2: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row for each document, its values packed."""
    order = np.lexsort((p2, p1))
    p1, p2, values = p1[order], p2[order], values[order]
    new = np.ones(len(p1), bool)
    new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    first = np.flatnonzero(new)
    ends = [*first[1:], len(p1)]
    packed = [values[a:b].tobytes() for a, b in zip(first, ends)]
    return pa.table({"p1": pa.array(p1[first]), "p2": pa.array(p2[first]), "packed": pa.array(packed, pa.binary())})


def _repeated(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The anchors of one slice whose hash occurs twice, and those known before."""
    low, p1, p2, pos, sure = [], [], [], [], []
    for r in rows.to_pylist():
        mine = np.frombuffer(r["low"], np.uint32)
        at = np.frombuffer(r["at"], np.uint32)
        p1.append(np.frombuffer(r["p1"], np.int64)[at])
        p2.append(np.frombuffer(r["p2"], np.int64)[at])
        pos.append(np.frombuffer(r["pos"], np.uint32))
        low.append(np.concatenate([mine, np.zeros(len(at) - len(mine), np.uint32)]))
        sure.append(np.arange(len(at)) >= len(mine))
    low, p1, p2, pos, sure = (np.concatenate(x) for x in (low, p1, p2, pos, sure))
    counted = np.flatnonzero(~sure)
    counted = counted[np.argsort(low[counted], kind="stable")]
    x = low[counted]
    twice = np.zeros(len(x), bool)
    if len(x):
        twice[1:] = x[1:] == x[:-1]
        twice[:-1] |= twice[1:]
    keep = np.concatenate([counted[twice], np.flatnonzero(sure)])
    return _by_document(p1[keep], p2[keep], pos[keep])


def _front_code(sorted_rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix with the row before, and the bytes after it."""
    differs = sorted_rows[1:] != sorted_rows[:-1]
    lcp = np.zeros(len(sorted_rows), np.uint16)
    lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), sorted_rows.shape[1])
    rest = np.arange(sorted_rows.shape[1]) >= lcp[:, None]
    return lcp, sorted_rows[rest].tobytes()


def _ship_suffixes(length: int, k: int, slices: int):
    """Sorted, front-coded runs of the suffixes at candidate anchors.

    A record is the ``length`` bytes from the anchor on, then the
    ``length - k`` bytes before it, backwards. Equal records of a chunk become
    one, marked; their documents' spans are known already and go elsewhere.
    """
    before = length - k
    step = np.concatenate([np.arange(length), -1 - np.arange(before)]).astype(np.int32)
    width = length + before

    def records(batch):
        """The suffixes of a chunk's candidates, a few thousand at a time."""
        data, offsets = text_bytes(batch.column("text"))
        p1, p2 = (batch.column(c).to_numpy() for c in ("p1", "p2"))
        pos = [np.unique(np.frombuffer(b"".join(x), np.uint32)).astype(np.int64) for x in batch.column("packed").to_pylist()]
        doc = np.repeat(np.arange(len(pos)), [len(x) for x in pos])
        pos = np.concatenate(pos)
        for a in range(0, len(pos), 4096):
            d, p = doc[a : a + 4096], pos[a : a + 4096]
            left, right = np.minimum(p, before), np.minimum((offsets[1:] - offsets[:-1])[d] - p, length)
            inside = np.concatenate([np.arange(length) < right[:, None], np.arange(before) < left[:, None]], axis=1)
            at = np.clip((offsets[d] + p).astype(np.int32)[:, None] + step, 0, len(data) - 1)
            yield np.where(inside, data[at], np.uint8(PAD)), np.stack([p1[d], p2[d], p, left, right])

    def pack(rows, about):
        power, _ = powers(k)
        order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        rows, about = rows[order], about[:, order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        many = np.diff(np.concatenate([first, [len(rows)]])) > 1
        key = np.zeros(len(first), U64)
        for j in range(k):
            key += _BYTE[rows[first, j]] * power[j]
        part, _ = split_slices(mix(mix(key) ^ _SPREAD), slices)
        sure = about[:, many[np.cumsum(new) - 1]]
        spread = (sure[0].view(U64) % U64(slices)).astype(np.int64)
        about = np.concatenate([about[:, first], many[None, :].astype(np.int64)])
        known = np.stack([sure[0], sure[1], sure[2] - sure[3], sure[2] + sure[4]])
        out = []
        for s in np.union1d(part, spread):
            mine = part == s
            lcp, tails = _front_code(rows[first[mine]]) if mine.any() else (np.zeros(0, np.uint16), b"")
            out.append((int(s), lcp.tobytes(), tails, about[:, mine].tobytes(), known[:, spread == s].tobytes()))
        types = (pa.int32(), *[pa.binary()] * 4)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], ["slice", "lcp", "tails", "about", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, limit=CHUNK):
            for rows, about in records(batch):
                held.append((rows, about))
                size += len(rows)
                if size > 40_000:
                    yield pack(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1))
                    held, size = [], 0
        if size:
            yield pack(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1))

    return run


class FrontCoded:
    """A run of strings that is decoded as the merge goes through it: one string of it is whole at a time."""

    def __init__(self, lcp: np.ndarray, tails: bytes, width: int):
        self.lcp, self.tails, self.width = lcp.tolist(), memoryview(tails), width
        self.at, self.next, self.last = 0, 0, b""

    def __len__(self) -> int:
        return len(self.lcp)

    def __getitem__(self, i: int) -> bytes:
        """String i, which is the one asked for last or the one after it."""
        if i == self.next:
            p = self.lcp[i]
            self.last = self.last[:p] + self.tails[self.at : self.at + self.width - p]
            self.at += self.width - p
            self.next += 1
        return self.last


def _first_difference(a: bytes, b: bytes, start: int) -> int:
    x = int.from_bytes(a[start:], "big") ^ int.from_bytes(b[start:], "big")
    return len(a) - (x.bit_length() + 7) // 8 if x else len(a)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Loser-tree merge of sorted runs of equally long strings: (run, index, common prefix with the one before).

    Every string waits with the length of the prefix it has in common with
    the last string put out. Of two waiting strings the one with more in
    common is smaller; only when they tie is anything compared, from there on.
    """
    count = 1
    while count < len(runs):
        count *= 2
    done = (None, -1, -1, 0)  # text, common, run, index

    def head(r: int, i: int, common: int):
        return (runs[r][0][i], common, r, i) if r < len(runs) and i < len(runs[r][0]) else done

    def play(a, b):
        """The winner, and the loser with what it has in common with the winner."""
        if a[0] is None:
            return b, a
        if b[0] is None:
            return a, b
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        p = _first_difference(a[0], b[0], a[1])
        if p == len(a[0]) or a[0][p] < b[0][p]:
            return a, (b[0], p, b[2], b[3])
        return b, (a[0], p, a[2], a[3])

    losers = [done] * count

    def build(node: int):
        if node >= count:
            return head(node - count, 0, 0)
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while winner[0] is not None:
        _, common, r, i = winner
        yield r, i, common
        winner = head(r, i + 1, runs[r][1][i + 1] if i + 1 < len(runs[r][0]) else 0)
        node = (r + count) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _resolve(rows: np.ndarray, lcp: np.ndarray, left: np.ndarray, right: np.ndarray, many: np.ndarray, length: int, k: int):
    """For each suffix the least and greatest offset of its anchor in a repeated window.

    A window with the anchor at offset o is repeated if another suffix has
    length - o bytes in common after the anchor, which the common prefixes
    of the sorted order tell, and o bytes before it, told by a running hash.
    """
    n = len(rows)
    low, high = np.full(n, length), np.full(n, -1)
    power, _ = powers(length)
    before = np.zeros(n, U64)
    for o in range(length - k + 1):
        if o:
            before += _BYTE[rows[:, length + o - 1]] * power[o - 1]
        fits = np.flatnonzero((left >= o) & (right >= length - o))
        if not len(fits):
            continue
        block = np.cumsum(lcp < length - o)[fits].astype(U64)
        key = mix(mix(block) + before[fits])
        order = np.argsort(key)
        x = key[order]
        same = np.zeros(len(x), bool)
        same[1:] = x[1:] == x[:-1]
        same[:-1] |= same[1:]
        hit = np.zeros(len(x), bool)
        hit[order] = same
        at = fits[hit | many[fits]]
        low[at] = np.minimum(low[at], o)
        high[at] = o
    return low, high


def _merge(length: int, k: int):
    width = 2 * length - k

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        runs, about, known = [], [], []
        for r in table.to_pylist():
            lcp = np.frombuffer(r["lcp"], np.uint16)
            known.append(np.frombuffer(r["known"], np.int64).reshape(4, -1))
            if len(lcp):
                coded = FrontCoded(lcp, r["tails"], width)
                runs.append((coded, coded.lcp))
                about.append(np.frombuffer(r["about"], np.int64).reshape(6, -1))
        spans = [np.concatenate(known, axis=1)]

        def close(at: list[tuple[int, int]], lcp: list[int], text: list[bytes]) -> None:
            """The spans of whole groups of anchor strings."""
            p1, p2, pos, left, right, many = np.stack([about[r][:, j] for r, j in at], axis=1)
            rows = np.frombuffer(b"".join(text), np.uint8).reshape(-1, width)
            low, high = _resolve(rows, np.array(lcp), left, right, many > 0, length, k)
            hit = high >= 0
            spans.append(np.stack([p1[hit], p2[hit], (pos - high)[hit], (pos - low)[hit] + length]))

        at, lcp, text = [], [], []
        for r, j, common in merge_runs(runs) if runs else ():
            # Groups of one anchor string are apart where less than k bytes agree.
            if common < k and len(at) >= BLOCK:
                close(at, lcp, text)
                at, lcp, text = [], [], []
            at.append((r, j))
            lcp.append(common)
            text.append(runs[r][0][j])
        if at:
            close(at, lcp, text)
        p1, p2, a, b = np.concatenate(spans, axis=1)
        long = b - a >= length
        return _by_document(p1[long], p2[long], (a[long].astype(U64) << U64(32)) | b[long].astype(U64))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the spans; what is left of each document, as bytes."""
    for batch in chunks(batches):
        data, offsets = text_bytes(batch.column("text"))
        removed, spans, kept = [], [], []
        for i, packed in enumerate(batch.column("packed").to_pylist()):
            one = data[offsets[i] : offsets[i + 1]]
            gone = cuts = 0
            if packed:
                x = np.unique(np.frombuffer(b"".join(packed), U64))
                a, b = (x >> U64(32)).astype(np.int64), (x & U64(0xFFFFFFFF)).astype(np.int64)
                reach = np.maximum.accumulate(b)
                new = np.concatenate([[True], a[1:] > reach[:-1]])
                first, last = a[new], reach[np.concatenate([new[1:], [True]])]
                gone, cuts = int((last - first).sum()), len(first)
                left = np.concatenate([[0], last])
                one = np.concatenate([one[p:q] for p, q in zip(left, [*first, len(one)])])
            removed.append(gone)
            spans.append(cuts)
            kept.append(one.tobytes())
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes.

    Every byte that lies in a ``length``-byte string that also starts anywhere
    else (same document included) goes. Only suffixes at content-defined
    anchors are sorted, about one in (length - k) / 2 bytes: any repeated
    string holds an anchor at the same offset in each occurrence, and a record
    holds the bytes on both sides that a window around the anchor can reach, so
    nothing is missed. Anchors whose k bytes occur once drop out after an
    exchange of hashes; the others' suffixes travel as sorted front-coded runs,
    are merged by loser trees, and the common prefixes that the merge leaves
    tell which windows repeat.

    A text is worked on as a whole by one task, which takes about 40 times its
    bytes. Null text is empty; texts shorter than ``length`` stay whole. Rows that
    repeat id and text repeat each other, so both lose all long strings. Empty
    tables give empty results. Overlaps count as repeats.
    """
    spark = docs.sparkSession
    slices = tasks_for(spark, docs)
    base = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("p1", F.xxhash64("doc_id", "text"))
        .withColumn("p2", F.xxhash64(F.lit(71), "doc_id", "text"))
    )
    id_type = base.schema["doc_id"].dataType.simpleString()
    per_doc = "p1 long, p2 long, packed binary"
    gathered = lambda df: df.groupBy("p1", "p2").agg(F.collect_list("packed").alias("packed"))
    candidates = gathered(
        base.select("text", "p1", "p2")
        .mapInArrow(_ship_anchors(length, k, slices), "slice int, low binary, at binary, pos binary, p1 binary, p2 binary")
        .groupBy("slice")
        .applyInArrow(_repeated, per_doc)
    )
    spans = gathered(
        base.join(candidates, ["p1", "p2"])
        .select("doc_id", "text", "p1", "p2", "packed")
        .mapInArrow(_ship_suffixes(length, k, slices), "slice int, lcp binary, tails binary, about binary, known binary")
        .groupBy("slice")
        .applyInArrow(_merge(length, k), per_doc)
    )
    return (
        base.join(spans, ["p1", "p2"], "left")
        .select("doc_id", "text", "packed")
        .mapInArrow(_cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
