"""tessera extract [folder]: facts of a source tree as NDJSON or one object."""

from __future__ import annotations

import argparse
import os
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from . import __version__
from .operators.extract import Extraction, extract
from .operators.output import coverage, format_coverage, ndjson, object_text
from .sources.cache import extract_cached
from .sources.files import INCLUDE, build_header, config_hashes, discover

EXIT_OK, EXIT_FAILED, EXIT_USAGE = 0, 1, 2


class _Usage(Exception):
    pass


class _Arguments(argparse.ArgumentParser):
    def error(self, message):
        raise _Usage(message)


def arguments() -> argparse.ArgumentParser:
    p = _Arguments(prog="tessera", add_help=False)
    p.add_argument("command", nargs="?")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--stats", "--coverage", action="store_true", help="counts by kind, certainty and source")
    p.add_argument("--out", "-o", help="file instead of the standard output")
    p.add_argument("--cache", help="folder of the cache (default: .tessera/cache in the scanned folder)")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--include", action="append", help="glob; may be repeated")
    p.add_argument("--exclude", action="append", help="glob; may be repeated")
    p.add_argument("--config", action="append", help="file that the header hashes; may be repeated")
    p.add_argument("--version", "-v", action="store_true")
    p.add_argument("--help", "-h", action="store_true")
    return p


def run(argv: list[str], spark=None, out=sys.stdout, err=sys.stderr) -> int:
    """Exit code: 0 done, version or help; 1 no command or a bad folder; 2 bad usage."""
    parser = arguments()
    try:
        a = parser.parse_args(argv)
    except _Usage as e:
        print(e, file=err)
        return EXIT_USAGE
    if a.version:
        print(__version__, file=out)
        return EXIT_OK
    if a.help or a.command is None:
        print(parser.format_usage().strip(), file=out)
        return EXIT_OK if a.help else EXIT_FAILED
    if a.command != "extract":
        print(f"unknown command {a.command}", file=err)
        return EXIT_USAGE
    if not os.path.isdir(a.path):
        print(f"not a folder: {a.path}", file=err)
        return EXIT_FAILED
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    sources = discover(spark, a.path, tuple(a.exclude) if a.exclude else None, tuple(a.include) if a.include else INCLUDE)
    configs, note, result = config_hashes(a.path, a.config or []), "", None
    if not a.no_cache:
        try:
            cached = extract_cached(sources, a.cache or os.path.join(os.path.abspath(a.path), ".tessera", "cache"), configs=configs)
            result, header, note = cached.result, cached.header, f", {cached.hits} cached"
        except (OSError, Py4JError, PySparkException) as e:  # a cache must not fail the run
            print(f"no cache: {str(e).splitlines()[0]}", file=err)
    if result is None:
        result, header = extract(sources), build_header(sources, configs=configs)
        result = Extraction.of(result.parsed.persist())
    pieces = object_text(header, result.facts, a.pretty) if a.json or a.pretty else (r[0] + "\n" for r in ndjson(result.facts).toLocalIterator())
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.writelines(pieces)
            f.write("\n" if a.json or a.pretty else "")
    else:
        for piece in pieces:
            out.write(piece)
        out.write("\n" if a.json or a.pretty else "")
    report = coverage(result.facts).collect()
    found = {(r["section"], r["key"]): r["n"] for r in report}
    total, unresolved = found.get(("total", "facts"), 0), found.get(("total", "unresolved"), 0)
    print(f"{total} facts from {header['file_count']} files, {unresolved} unresolved, {result.diagnostics.count()} diagnostics{note}", file=err)
    if a.stats:
        print(format_coverage(report), file=err)
    if a.no_cache:
        result.parsed.unpersist()
    return EXIT_OK


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
