"""Token counts that follow edits: only touched regions are encoded again."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import chunks

#: Fixed value: the pattern that splits text before byte-pair merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(SPLIT)
#: Pre-tokens of a leaf when a tree is built, and how far behind its end a match can look
#: (the second letter of a contraction, or what follows the last of several blanks).
LEAF, AHEAD = 64, 2


class Encoder:
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, ranks: bytes, most: int = 300_000):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encode = tiktoken.Encoding("counts", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}
        self.most = most

    def counts(self, tokens: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[t] for t in tokens]
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = len(self.encode(t))
        return [known[t] for t in tokens]


class CountTree:
    """A segment tree over a document's pre-tokens: characters and tokens.

    A leaf holds about LEAF pre-tokens; inner nodes hold the sums of their
    children, so an edit rewrites a leaf or a few and the path above them. A
    leaf that insertions have made eight times as long has the leaves dealt
    anew, without encoding anything again.
    """

    def __init__(self, text: str, encoder: Encoder, kept: tuple[list[int], list[int]] | None = None):
        """The tree of a text; ``kept`` are the lengths and counts of its pre-tokens, where they are known."""
        self.encoder, self.reencoded = encoder, 0
        if kept is None:
            tokens = _SPLIT.findall(text)
            self._deal(tokens, encoder.counts(tokens))
            return
        lengths, counts = kept
        if sum(lengths) != len(text) or len(lengths) != len(counts):
            raise ValueError("the kept tree is of another text")
        ends = list(accumulate(lengths))
        self._deal([text[b - n : b] for b, n in zip(ends, lengths)], list(counts))

    def kept(self) -> tuple[list[int], list[int]]:
        """The lengths and counts of the pre-tokens: what a later run starts from."""
        return [len(t) for tokens, _ in self.leaves for t in tokens], [c for _, counts in self.leaves for c in counts]

    def _deal(self, tokens: list[str], counts: list[int]) -> None:
        self.leaves = [(tokens[a : a + LEAF], counts[a : a + LEAF]) for a in range(0, len(tokens), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (t, c) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, t)), sum(c)
        for node in range(self.size - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the leaf's first character."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of characters start to end.

        Splitting is memoryless from any pre-token's start, and looks ahead
        AHEAD characters. So it begins at the first pre-token that the edit can
        reach and goes on until it meets an old boundary behind the edit.
        """
        length = self.chars[1]
        start, end = min(start, length), min(end, length)
        leaf, base = self.find(max(0, start - AHEAD - 1))
        tokens, counts = self.leaves[leaf]
        keep, at = 0, base
        while keep < len(tokens) and at + len(tokens[keep]) + AHEAD <= start:
            at += len(tokens[keep])
            keep += 1
        head, head_counts = tokens[:keep], counts[:keep]
        begin, last = at, leaf
        text = "".join(tokens[keep:])
        reach = base + self.chars[self.size + leaf]  # old characters taken so far
        bounds = self._bounds(tokens[keep:], begin)
        shift = len(new) - (end - start)
        while True:
            while reach < end and last + 1 < len(self.leaves):
                last += 1
                more = self.leaves[last][0]
                bounds += self._bounds(more, reach)
                text += "".join(more)
                reach += self.chars[self.size + last]
            edited = text[: start - begin] + new + text[end - begin :]
            fresh, done, cut = [], begin, None
            limit = len(edited) if last + 1 == len(self.leaves) else len(edited) - AHEAD
            for m in _SPLIT.finditer(edited):
                if m.end() > limit:
                    break
                fresh.append(m.group())
                done = begin + m.end()
                old = done - shift
                if old >= end:
                    i = bisect_left(bounds, old)
                    if i < len(bounds) and bounds[i] == old:
                        cut = old
                        break
            if cut is not None or last + 1 == len(self.leaves):
                break
            last += 1  # the split has not met an old boundary yet
            more = self.leaves[last][0]
            bounds += self._bounds(more, reach)
            text += "".join(more)
            reach += self.chars[self.size + last]
        tail, tail_counts = [], []
        if cut is not None:
            at = begin
            for i in range(leaf, last + 1):
                t, c = self.leaves[i]
                for token, count in zip(t[keep if i == leaf else 0 :], c[keep if i == leaf else 0 :]):
                    if at >= cut:
                        tail.append(token)
                        tail_counts.append(count)
                    at += len(token)
        self.reencoded += len(fresh)
        for i in range(leaf + 1, last + 1):
            self._put(i, [], [])
        self._put(leaf, head + fresh + tail, head_counts + self.encoder.counts(fresh) + tail_counts)

    @staticmethod
    def _bounds(tokens: list[str], start: int) -> list[int]:
        out = []
        for t in tokens:
            out.append(start)
            start += len(t)
        out.append(start)
        return out

    def _put(self, leaf: int, tokens: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (tokens, counts)
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, tokens)), sum(counts)
        while node > 1:
            node //= 2
            self._add_up(node)
        if len(tokens) > 8 * LEAF:
            self._deal([t for x, _ in self.leaves for t in x], [c for _, x in self.leaves for c in x])

    def text(self) -> str:
        return "".join("".join(t) for t, _ in self.leaves)


#: The production edits: mail addresses and long numbers are masked.
MASKS = ((re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<email>"), (re.compile(r"(?<!\w)\d[\d -]{7,}\d(?!\w)"), "<number>"))


def masking_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) in the order of their places."""
    found = [(m.start(), m.end(), new) for pattern, new in MASKS for m in pattern.finditer(text)]
    found.sort()
    out, reach = [], 0
    for a, b, new in found:
        if a >= reach:
            out.append((a, b, new))
            reach = b
    return out


_TREE = "struct<lengths:array<int>,counts:array<int>>"


def _count(shared, make_edits, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in chunks(batches):
            rows = []
            edits_of = batch.column("edits").to_pylist() if make_edits is None else None
            trees = batch.column("tree").to_pylist() if "tree" in batch.schema.names else None
            after = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                edits = make_edits(text) if make_edits is not None else [(e["start"], e["end"], e["new"]) for e in edits_of[i] or []]
                known = trees[i] if trees else None
                tree = CountTree(text, encoder, (known["lengths"], known["counts"]) if known else None)
                before, pieces = tree.total, sum(len(t) for t, _ in tree.leaves)
                shift = 0
                for a, b, new in sorted(edits, key=lambda e: e[:2]):
                    tree.replace(a + shift, b + shift, new)
                    shift += len(new) - (b - a)
                rows.append((before, tree.total, len(edits), pieces, tree.reencoded))
                if keep:
                    after.append((tree.text(), dict(zip(("lengths", "counts"), tree.kept()))))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))]
            names = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_pieces", "n_reencoded"]
            if keep:
                lists = pa.list_(pa.int32())
                columns += [pa.array([t for t, _ in after], pa.string()), pa.array([t for _, t in after], pa.struct([("lengths", lists), ("counts", lists)]))]
                names += ["text_after", "tree"]
            yield pa.record_batch(columns, names)

    return run


def count_tokens(
    docs: DataFrame,
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken",
    edits: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    make_edits=masking_edits,
    max_vocabulary_bytes: int = 64 << 20,
    keep: bool = False,
    tree_col: str | None = None,
) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_pieces, n_reencoded for every input row.

    Each text becomes a segment tree over its pre-tokens. Edits replace code
    points start to end (positions in the unedited text, not overlapping):
    those of ``edits`` (id, start, end, new) where given, else those that
    ``make_edits`` derives from the text. Only pre-tokens that an edit and its
    boundary context touch are encoded again; sums are updated on the path to
    the root. ``vocabulary`` is a rank file that the driver reads and
    broadcasts (ValueError beyond ``max_vocabulary_bytes``).

    With ``keep`` each row also has text_after and tree, the lengths and counts
    of the edited text's pre-tokens. Given back as ``tree_col`` with that text,
    they are what the next batch of edits starts from: nothing but what it
    touches is split or encoded again.

    A text is worked on as a whole by one task, which takes about 100 times its
    bytes for its tree. Null text is empty: no tokens. Edits of ids without a row are ignored;
    rows that repeat an id all get its edits; edits with null ids apply to
    nothing. Empty tables give empty results.
    """
    with open(vocabulary, "rb") as file:
        ranks = file.read(max_vocabulary_bytes + 1)
    if len(ranks) > max_vocabulary_bytes:
        raise ValueError("the vocabulary file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    tree = [F.col(tree_col).cast(_TREE).alias("tree")] if tree_col else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *tree)
    id_type = base.schema["doc_id"].dataType.simpleString()
    if edits is not None:
        grouped = edits.groupBy(F.col(id_col).alias("doc_id")).agg(
            F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("new", F.lit("")).alias("new"))).alias("edits")
        )
        base, make_edits = base.join(grouped, "doc_id", "left"), None
    return base.mapInArrow(
        _count(shared, make_edits, keep),
        f"doc_id {id_type}, n_tokens long, n_tokens_after long, n_edits long, n_pieces long, n_reencoded long" + (f", text_after string, tree {_TREE}" if keep else ""),
    )
