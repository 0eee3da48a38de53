"""Secret scanning: patterns find candidates, a random forest removes false positives."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import chunks

#: Shapes of well-known credentials, case-insensitive for hex.
PATTERNS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:[\w+/=:;,.()\s-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?",
    "aws_access_key": r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{30,}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "jwt": r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
    "opaque": r"(?<![\w/+.@-])(?=[A-Za-z/+_-]*[0-9])(?=[0-9/+_-]*[A-Za-z])[\w/+=-]{20,}(?![\w@])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()), re.IGNORECASE)
#: Kind "assignment": what stands before ":" or "=", whatever precedes it in the name, and the value after it.
_NAME = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,3}\Z", re.IGNORECASE)
_NAME_MOST = 24
_VALUE = re.compile(r"\s{0,3}[\"']?([^\s\"']{6,})")
_ASSIGN = re.compile(r"[:=]")
#: A text without one of these holds no candidate.
_HINT = re.compile(r"[=:]|-----BEGIN|[\w/+=-]{16}")
_NEAR = re.compile(r"(?i)token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private")
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|\*\*\*|<|\$\{|test|todo|none|null|localhost")
_PATH = re.compile(r"(?i)(?:[/\\][a-z_.-]{2,}\d?){2}|\.(?:html?|png|jpe?g|js|css|py|java|md|txt|com|org)\b|^https?:")
_GROUPS = [string.ascii_lowercase, string.ascii_uppercase, string.digits, "-_", "/+=", "."]
_CLASS = np.full(256, len(_GROUPS))
for _i, _g in enumerate(_GROUPS):
    for _c in _g:
        _CLASS[ord(_c)] = _i
FEATURES = (
    "length", "entropy", "digit_share", "upper_share", "transition_share", "distinct_share", "longest_letters",
    "hex_share", "bigram_surprise", "dictionary_cover", "placeholder", "pathlike", "near_keyword", "after_equals",
    "quoted", "known_shape", "repeat_share", "neighbours", "body_length",
)
#: Words beside a candidate that are looked at, on each side.
BESIDE = 4


_WORD = re.compile(r"\b[^\W\d_]{3,}\b")


def pair_counts(counts: dict[str, int]) -> np.ndarray:
    """How often each letter pair (27 x 27, 0 for letters but a-z) occurs in counted words."""
    raw = np.frombuffer("".join(counts).encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where((raw >= 97) & (raw <= 122), raw - 96, 0)
    lengths = np.array([len(w) for w in counts], np.int64)
    inside = np.ones(len(code), bool)
    inside[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inside)
    n = np.repeat(np.array(list(counts.values()), np.int64), lengths)
    return np.bincount(code[at] * 27 + code[at + 1], n[at], 27 * 27).astype(np.int64)


class Vocabulary:
    """Frequent lower-case words and letter pairs of ordinary text."""

    def __init__(self, texts: list[str], most: int = 20_000):
        counts = Counter(w for t in texts for w in _WORD.findall(t.lower()))
        self.set(sorted(counts, key=lambda w: (-counts[w], w))[:most], pair_counts(counts) if counts else np.zeros(27 * 27))

    def set(self, words: list[str], pairs: np.ndarray) -> Vocabulary:
        self.words = set(words)
        pairs = pairs.reshape(27, 27) + 1.0
        self.surprise = -np.log2(pairs / pairs.sum(axis=1, keepdims=True))
        return self


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregated counts of words, and of letter pairs (by number, without a word)."""
    counts: Counter[str] = Counter()
    pairs = np.zeros(27 * 27, np.int64)

    def rows():
        nonlocal pairs
        pairs += pair_counts(counts)
        out = pa.record_batch([pa.array(list(counts), pa.string()), pa.nulls(len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "pair", "n"])
        counts.clear()
        return out

    for batch in chunks(batches):
        for t in batch.column("text").to_pylist():
            counts.update(_WORD.findall(t.lower()))
        if len(counts) > 500_000:
            yield rows()
    if counts:
        yield rows()
    at = np.flatnonzero(pairs)
    yield pa.record_batch([pa.nulls(len(at), pa.string()), pa.array(at, pa.int32()), pa.array(pairs[at])], ["word", "pair", "n"])


def corpus_vocabulary(texts: DataFrame, most: int) -> Vocabulary:
    """From all words of all texts: whole bands of the most frequent words, at most ``most``, and all letter pairs."""
    counted = texts.mapInArrow(_count_words, "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "secret-words")
    words = counted.where("word is not null")
    # No sort and no task that gathers candidates.
    band = F.floor(F.log("n") / math.log(1.05))
    least, so_far = None, 0
    for r in words.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        so_far += r["count"]
        if so_far > most:
            break
        least = r["band"]
    top = words.where(band >= least if least is not None else F.lit(False)).select("word").collect()
    pairs = np.zeros(27 * 27)
    for r in counted.where("pair is not null").collect():
        pairs[r["pair"]] = r["n"]
    return Vocabulary([]).set([r["word"] for r in top], pairs)


def beside(before: str, after: str) -> list[str]:
    """The neighbouring words of a candidate, the nearest on each side."""
    return [w.lower() for w in [*re.findall(r"[^\W\d_]{2,}", before)[-BESIDE:], *re.findall(r"[^\W\d_]{2,}", after)[:BESIDE]]]


class Neighbours:
    """How much a word beside a candidate speaks for a secret: smoothed log odds of labelled findings."""

    def __init__(self, findings: list[tuple[str, str, str, str, int]]):
        seen: list[Counter[str]] = [Counter(), Counter()]
        for _, _, before, after, label in findings:
            seen[label].update(set(beside(before, after)))
        total = [sum(1 for f in findings if f[4] == label) for label in (0, 1)]
        odds = lambda w: math.log((seen[1][w] + 5) / (total[1] + 10)) - math.log((seen[0][w] + 5) / (total[0] + 10))
        # Words that stand beside both alike say nothing.
        self.odds = {w: x for w in seen[0].keys() | seen[1].keys() if abs(x := odds(w)) > 0.7}

    def score(self, before: str, after: str) -> float:
        return sum(self.odds.get(w, 0.0) for w in set(beside(before, after)))


_ARMOUR = re.compile(r"-----[A-Z0-9 ]+-----", re.IGNORECASE)


def features(kind: str, value: str, before: str, after: str, vocabulary: Vocabulary, neighbours: Neighbours) -> list[float]:
    whole, value = value, _ARMOUR.sub("", value) if kind == "private_key" else value  # the key itself, not its frame
    body = re.sub(r"\s", "", value) if kind == "private_key" else value
    value = body or whole
    raw = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    share = counts[counts > 0] / n
    kinds = _CLASS[raw]
    low = value.lower()
    code = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in low]
    runs = re.findall(r"[^\W\d_]+", low)
    covered = sum(len(w) for w in runs if len(w) >= 3 and w in vocabulary.words)
    surprise = vocabulary.surprise[code[:-1], code[1:]].mean() if n > 1 and len(code) > 1 else 0.0
    return [
        n,
        float(-(share * np.log2(share)).sum()),
        float((kinds == 2).mean()),
        float((kinds == 1).mean()),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        len(share) / n,
        max((len(w) for w in runs), default=0),
        sum(c in "0123456789abcdef" for c in low) / len(low),
        float(surprise),
        covered / max(1, len(low)),
        float(bool(_PLACEHOLDER.search(value))),
        float(bool(_PATH.search(value))) if kind in ("assignment", "opaque") else 0.0,
        float(bool(_NEAR.search(before))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before) and bool(after)),
        float(kind not in ("assignment", "opaque")),
        float((raw[1:] == raw[:-1]).mean()) if n > 1 else 0.0,
        neighbours.score(before, after),
        float(len(body)),
    ]


class RandomForest:
    """Gini trees on bootstrap samples and random feature subsets."""

    def __init__(self, trees: int = 50, depth: int = 10, seed: int = 11):
        self.trees, self.depth, self.rng = trees, depth, np.random.default_rng(seed)
        self.roots: list = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        for _ in range(self.trees):
            i = self.rng.integers(0, len(x), len(x))
            self.roots.append(self._grow(x[i], y[i], self.depth))
        return self

    def _grow(self, x, y, depth):
        p = float(y.mean())
        if depth == 0 or len(y) < 4 or p in (0.0, 1.0):
            return p
        best = None
        for f in self.rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1])), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n, k = cut + 1, t[cut]
            m, j = len(y) - n, t[-1] - k
            gini = k * (n - k) / n + j * (m - j) / m
            i = int(gini.argmin())
            if best is None or gini[i] < best[0]:
                middle = (v[cut[i]] + v[cut[i] + 1]) / 2
                best = (gini[i], f, middle if middle < v[cut[i] + 1] else v[cut[i]])
        if best is None:
            return p
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node, rows):
            if not isinstance(node, tuple):
                out[rows] += node
                return
            left = x[rows, node[0]] <= node[1]
            if left.any():
                walk(node[2], rows[left])
            if not left.all():
                walk(node[3], rows[~left])

        for root in self.roots:
            walk(root, np.arange(len(x)))
        return out / max(1, len(self.roots))


def labelled_findings(words: list[str], n: int = 1500, seed: int = 4) -> list[tuple[str, str, str, str, int]]:
    """Generated labelled findings (kind, value, before, after, label), ``n`` of each label.

    Positives are random keys of every kind in the contexts in which keys leak;
    negatives are what the patterns also catch: words, paths, identifiers,
    placeholders, version strings, numbers, and the shape of every kind filled
    with an example. No real credential is involved.
    """
    rng = np.random.default_rng(seed)
    pick = lambda s, m: "".join(s[i] for i in rng.integers(0, len(s), m))
    some = lambda a: a[int(rng.integers(0, len(a)))]
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    capital = string.ascii_uppercase + string.digits
    names = ["token", "secret", "password", "api_key", "access_key", "auth"]
    words = words or ["lorem", "ipsum", "dolor", "amet"]
    cloud = lambda x, m: "".join(x[i % len(x)] for i in range(m))
    frame = lambda kind, body: f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
    lines = lambda m: "\n".join(pick(alnum + "/+", 64) for _ in range(m))
    # Known shapes: kind, a random value, and the same shape as documentation has it.
    known = {
        "aws_access_key": (lambda: "AKIA" + pick(capital, 16), lambda: "AKIA" + some([cloud("EXAMPLE", 16), "X" * 16, cloud("YOURKEYHERE", 16), cloud("0123456789", 16), pick(capital, 9) + "EXAMPLE"])),
        "github_token": (lambda: "ghp_" + pick(alnum, 36), lambda: "ghp_" + some(["x" * 36, cloud("yourtokenhere", 36), cloud("exampletoken", 36), "0" * 36])),
        "slack_token": (lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "xoxb-" + some(["your-token-here", "xxxxxxxxxxxx-xxxxxxxx", "example-token", "000000000000-000000"])),
        "jwt": (
            lambda: "eyJ" + pick(alnum, int(rng.integers(20, 60))) + "." + pick(alnum, int(rng.integers(30, 200))) + "." + pick(alnum + "-_", 43),
            lambda: "eyJ" + some(["header.eyJpayload.signature", "xxxxxxxxxx.xxxxxxxxxx.xxxxxxxxxx", cloud("example", 12) + ".payloadpayload.signature"]),
        ),
        "private_key": (
            lambda: frame(some(["", "RSA ", "EC ", "OPENSSH "]), lines(int(rng.integers(3, 28)))),
            lambda: some([frame(some(["", "RSA "]), some(["...", "example", "your key here", "x" * 64])), f"-----BEGIN {some(['', 'RSA ', 'EC '])}PRIVATE KEY-----"]),
        ),
    }
    plain = [
        lambda: pick(hexes, int(some([32, 40, 64]))), lambda: pick(hexes.upper(), 40), lambda: pick(alnum, int(rng.integers(16, 64))), lambda: pick(alnum + "/+", 40),
        lambda: pick(hexes, int(some([256, 512]))), lambda: pick(alnum + "/+", int(rng.integers(200, 800))), lambda: pick(alnum + "!#$%&*_-", int(rng.integers(12, 32))),
    ]
    #: Words that stand beside real findings and beside examples now and then.
    hints = {1: ["export", "prod", "deploy", "env", "login", "header"], 0: ["example", "sample", "docs", "replace", "see", "page"]}

    def context(kind: str, label: int) -> tuple[str, str]:
        """Text before and behind; but for a hint now and then it is the same for both labels."""
        q = some(['"', "'", "", ""])
        hint = [some(hints[label])] if rng.random() < 0.3 else []
        words_before = " ".join([some(words), *hint, some(words)])
        if kind == "opaque" or kind != "assignment" and rng.random() < 0.5:
            return f"{words_before} ", f" {some(words)}"
        name = some(names)
        if rng.random() < 0.4:
            name = some(["client", "db", "aws_secret", "my-app", "access"]) + some(["_", "-"]) + name
        if rng.random() < 0.3:
            name = name.upper()
        return f"{words_before} {name}{some([' = ', ': ', '='])}{q}", f"{q} {some(words)}"

    out = []
    for _ in range(n):
        kind = some(["assignment", "opaque"]) if rng.random() < 0.6 else some(list(known))
        value = known[kind][0]() if kind in known else some(plain)()
        if kind == "assignment" and rng.random() < 0.15:
            value += some(["!!", "###", "&&&", "%%%"])
        out.append((kind, value, *context(kind, 1), 1))
        word = [some(words) for _ in range(4)]
        number = str(int(rng.integers(1, 10**6)))
        wrong = [
            "-".join(word), "_".join(word) + number, "/" + "/".join(word) + ".html", "your_" + some(names) + "_here",
            "x" * int(rng.integers(8, 30)), "*" * int(rng.integers(6, 20)), "${" + word[0].upper() + "}", "example-" + word[0] + number, word[0] + word[1] + number,
            some(["changeme", "example", "placeholder", "test-key", "sample", "dummy", "none", "todo"]) + some(["", "-" + number, "-" + word[0]]),
            ".".join(word), "0" * int(rng.integers(8, 30)), word[0], "https://" + word[0] + ".com/" + word[1] + "/" + number,
            "-".join(some(words) for _ in range(60)), "/" + "/".join(some(words) for _ in range(50)) + number, some("=-_") * int(rng.integers(20, 800)),
            "/" + "/".join(some(words) + some(["", "-" + some(words), number[:1]]) for _ in range(int(rng.integers(3, 9)))) + number[:2],
            "_".join(some(words) for _ in range(4)) + "-v" + ".".join(number[:3]), some(words).title() + some(words).title() + some(words).title() + "Service" + number,
            some("-_").join(some(words) for _ in range(int(rng.integers(3, 7)))) + some("-_") + number[:1],
        ]
        kind = some(["assignment", "opaque"]) if rng.random() < 0.7 else some(list(known))
        value = known[kind][1]() if kind in known else some(wrong)
        out.append((kind, value, *context(kind, 0), 0))
    return out


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of every candidate of a text."""
    if not _HINT.search(text):
        return
    done = 0
    for m in _ASSIGN.finditer(text):
        if m.start() < done:
            continue
        from_ = max(done, m.start() - _NAME_MOST)
        name = _NAME.search(text[from_ : m.start()])
        value = _VALUE.match(text, m.end()) if name else None
        if value:
            for x in _FIND.finditer(text, done, from_ + name.start()):
                yield x.start(), x.end(), x.lastgroup
            yield value.start(1), value.end(1), "assignment"
            done = value.end(1)
    for x in _FIND.finditer(text, done):
        yield x.start(), x.end(), x.lastgroup


def _scan(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, vocabulary, neighbours = shared.value
        for batch in chunks(batches):
            rows, x = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for start, end, kind in candidates(text or ""):
                    value = text[start:end]
                    rows.append((i, start, end, kind, value))
                    x.append(features(kind, value, text[max(0, start - 40) : start], text[end : end + 40], vocabulary, neighbours))
            if not rows:
                continue
            p = forest.predict(np.array(x))
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array([r[0] for r in rows])),
                    *[pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.string()))],
                    pa.array(p),
                    pa.array(p >= threshold),
                ],
                ["doc_id", "start", "end", "kind", "value", "score", "is_secret"],
            )

    return run


def train_forest(findings: list[tuple[str, str, str, str, int]], vocabulary: Vocabulary) -> tuple[RandomForest, Neighbours]:
    """A forest on the findings; odds of words beside them come from the other half of the findings, not from their own."""
    halves = [findings[::2], findings[1::2]] if len(findings) > 3 else [findings, findings]
    x, y = [], []
    for mine, other in zip(halves, halves[::-1]):
        apart = Neighbours(other)
        x += [features(*f[:4], vocabulary, apart) for f in mine]
        y += [float(f[4]) for f in mine]
    return RandomForest().fit(np.array(x), np.array(y)), Neighbours(findings)


def scan_secrets(
    docs: DataFrame,
    findings: list[tuple[str, str, str, str, int]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    vocabulary_words: int = 20_000,
) -> DataFrame:
    """doc_id, start, end, kind, value, score, is_secret: one row for each candidate.

    Patterns find candidates of any length in whole texts; a random forest scores them on
    length, character classes and their transitions, letter-pair surprise,
    dictionary cover, path-likeness, placeholders and the odds of the words
    beside them. It is trained from labelled ``findings`` (kind, value, before,
    after, 0 or 1), by default generated ones. A private key is one finding from
    its first line to its last. Words and letter pairs are counted over all whole
    texts; the dictionary that is broadcast holds whole bands of the most
    frequent words, at most ``vocabulary_words``. Offsets count code points.

    Texts of any length are scanned whole, by one task each. Null and empty
    texts have no candidates; repeated rows give repeated
    findings; null ids are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    vocabulary = corpus_vocabulary(docs.where(text.isNotNull()).select(text.alias("text")), vocabulary_words)
    findings = findings or labelled_findings(sorted(vocabulary.words)[::7])
    forest, neighbours = train_forest(findings, vocabulary)
    shared = spark.sparkContext.broadcast((forest, vocabulary, neighbours))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(
        _scan(shared, threshold),
        f"doc_id {id_type}, start long, end long, kind string, value string, score double, is_secret boolean",
    )
