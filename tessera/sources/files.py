"""File sources: discovery, hashes, headers and the per-file cache."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.identity import canonical_json
from ..parse.extractors import Options, producer
from ..schema import NORMALIZER_VERSION, SCHEMA_VERSION

#: What is scanned, and what is left out unless the caller names others.
INCLUDE = ("**/*.{ts,tsx,css}",)
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.git/**", "**/.tessera/**")
#: In a glob a star stays inside one part of a path; two stars are any number of parts.
_GLOB = re.compile(r"(?P<parts>\*\*/)|(?P<rest>\*\*)|(?P<star>\*)|(?P<one>\?)|(?P<set>\[!?[^\]]+\])|(?P<brace>[{},])|(?P<text>.)", re.DOTALL)


def glob_regex(glob: str) -> str:
    """The pattern of a whole path that a glob stands for."""
    fixed, depth, out = {"parts": "(?:[^/]+/)*", "rest": ".*", "star": "[^/]*", "one": "[^/]"}, 0, []
    for m in _GLOB.finditer(glob):
        kind, text = m.lastgroup, m.group()
        if kind in fixed:
            out.append(fixed[kind])
        elif kind == "set":
            out.append("[^" + text[2:] if text[1] == "!" else text)
        elif kind == "brace" and (text != "," or depth):
            depth += {"{": 1, "}": -1, ",": 0}[text]
            out.append({"{": "(?:", "}": ")", ",": "|"}[text])
        else:
            out.append(re.escape(text))
    return "^" + "".join(out) + "$"


def discover(spark: SparkSession, root: str, exclude: tuple[str, ...] | None = None, include: tuple[str, ...] = INCLUDE) -> DataFrame:
    """(path, code, hash, bytes) of the files under a folder that a glob of ``include`` and none of ``exclude`` matches.

    Paths are relative with forward slashes. Parts that begin with a dot are
    left out unless a glob names such a part. A caller's ``exclude`` replaces
    the default one. Bytes that are no UTF-8 become U+FFFD. The last parts of
    the include globs prune the listing; rows have no order (see ``listing``).
    """
    out = EXCLUDE if exclude is None else exclude
    names = "{" + ",".join(g.rsplit("/", 1)[-1].replace("**", "*") for g in include) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    base = root if "://" in root else os.path.abspath(root)
    name = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + _quoted(base.rstrip("/")) + "/", "")
    code = F.make_valid_utf8(F.col("content").cast("string"))
    found = files.select(name.alias("path"), code.alias("code"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"))
    matches = lambda globs: reduce(or_, (F.col("path").rlike(glob_regex(g)) for g in globs), F.lit(False))
    dotted = tuple(g for g in include if re.search(r"(?:^|/)\.", g))
    hidden = F.col("path").rlike(r"(?:^|/)\.") & ~matches(dotted)
    return found.where(matches(include) & ~matches(out) & ~hidden)


def listing(sources: DataFrame) -> DataFrame:
    """(path, hash, bytes) in the order of paths."""
    return sources.select("path", "hash", "bytes").orderBy("path")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def from_table(docs: DataFrame, path, code) -> DataFrame:
    """(path, code, hash, bytes) of a table that holds source text."""
    made = docs.select(path.alias("path"), code.alias("code"))
    return made.withColumns({"hash": F.sha2(F.col("code").cast("binary"), 256), "bytes": F.octet_length("code").cast("long")})


def config_hashes(root: str, names: list[str]) -> dict[str, str]:
    """SHA-256 of a few configuration files; missing ones are left out."""
    out = {}
    for n in sorted(names):
        path = os.path.join(root, n)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                out[n.replace(os.sep, "/")] = hashlib.sha256(f.read()).hexdigest()
    return out


def files_digest(sources: DataFrame) -> DataFrame:
    """(file_count, files_digest): the hash of all [path, hash] pairs in path order.

    The digest is defined over one ordered list, so one task feeds it to the
    hash, pair by pair from a distributed sort: its time grows with the number
    of files, its memory doesn't.
    """

    def run(batches):
        total, n = hashlib.sha256(b"["), 0
        for batch in batches:
            for pair in zip(*(batch.column(c).to_pylist() for c in range(2))):
                total.update((b"," if n else b"") + canonical(pair).encode())
                n += 1
        total.update(b"]")
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.hexdigest()])], ["file_count", "files_digest"])

    return sources.select("path", "hash").orderBy("path").coalesce(1).mapInArrow(run, "file_count long, files_digest string")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def tool_versions(spark: SparkSession) -> dict[str, str]:
    """The versions of what parses and normalizes: a change of one must not meet older facts."""
    return {"spark": spark.version, "tessera-css-parser": __version__, "tessera-tsx-parser": __version__}


def build_header(sources: DataFrame, options: Options = Options(), configs: dict[str, str] | None = None, tools: dict[str, str] | None = None) -> dict:
    """The snapshot header; its cache_key hashes all the rest."""
    row = files_digest(sources).first()
    header = {
        "schema_v": SCHEMA_VERSION,
        "normalizer_v": NORMALIZER_VERSION,
        "tool_versions": tools if tools is not None else tool_versions(sources.sparkSession),
        "plugin_versions": {producer(n).split("@")[0]: __version__ for n in sorted(options.extractors)},
        "config_hashes": configs or {},
        "file_count": row["file_count"],
        "files_digest": row["files_digest"],
    }
    return header | {"cache_key": hashlib.sha256(canonical(header).encode()).hexdigest()}


def signature(header: dict) -> str:
    """What cached rows of a file depend on besides the file."""
    kept = {k: v for k, v in header.items() if k not in ("file_count", "files_digest", "cache_key")}
    return hashlib.sha256(canonical(kept).encode()).hexdigest()


def file_keys(sources: DataFrame, sign: str) -> DataFrame:
    return sources.withColumn("file_key", F.sha2(canonical_json(F.struct("hash", "path", F.lit(sign).alias("signature"))), 256))


def split_by_cache(keyed: DataFrame, cached_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keyed sources against the keys of a cache."""
    keys = cached_keys.select("file_key").distinct()
    return keyed.join(keys, "file_key", "left_semi"), keyed.join(keys, "file_key", "left_anti")
