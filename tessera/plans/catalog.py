"""Registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import certainty, is_unitless, value_type
from ..functions.identity import canonical_json, fact_id, sha256_hex
from ..functions.normalize import (
    format_number,
    normalize_color,
    normalize_keyword,
    normalize_length,
    normalize_property,
    normalize_shadow,
    normalize_url,
    normalize_value,
)
from ..functions.text import js_trim
from ..functions.utility import arbitrary_type, declared_value, looks_like_class, parse_token, rules_table, split_classes, strip_variants
from ..operators.assemble import diff, listed, numbered, owned_by, upsert
from ..operators.extract import extract, parse_sources, register_udtf, routed
from ..operators.output import coverage, fact_json, facts_from_json, flat, unresolved_rate
from ..sources.files import file_keys, files_digest, from_table, split_by_cache
from .policy import STANDARD, Policy, message, run_policy, sarif_results, scores
from .samples import SHEET_FACTS, VIEW_FACTS, page_styles, reviews, sheets, table, views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query under its function's name with its oracle."""

    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


def _facts(spark: SparkSession, sf_dir: str, of=views) -> DataFrame:
    return extract(of(spark, sf_dir)).facts


def _text(c: str) -> Column:
    return F.col(c).cast("string")


FLAT = 'fact_id, kind, file, line, col, "endLine", "endCol", source, certainty, diagnostic, raw, norm, value_type'


def _flat(facts: DataFrame) -> DataFrame:
    return flat(facts).drop("schema_v", "producer_v")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the pages' stylesheets and of one made-up stylesheet a part."""
    return flat(extract(page_styles(spark, sf_dir).unionByName(sheets(spark, sf_dir))).facts)


# -- normalizers ---------------------------------------------------------------
@query("""SELECT p_partkey, p_size || 'px' AS px, p_size || 'em' AS em, '0.5rem' AS rem, p_size || '%' AS pct, p_size || 'px' AS bare,
  CAST(NULL AS VARCHAR) AS two, CAST(NULL AS VARCHAR) AS word FROM part""")
def normalize_lengths(spark, sf_dir):
    s = _text("p_size")
    made = {"px": F.concat(s, F.lit(".0PX")), "em": F.concat(F.lit("+"), s, F.lit("EM")), "rem": F.lit(".50rem"), "pct": F.concat(F.lit(" "), s, F.lit("%")), "bare": s, "two": F.concat(s, F.lit("px 2px")), "word": F.lit("auto")}
    return table(spark, sf_dir, "part").select("p_partkey", *[normalize_length(v).alias(k) for k, v in made.items()])


@query("""SELECT p_partkey, '#' || printf('%02x%02x%02x', p_partkey % 256, p_size, (p_partkey * 7) % 256) AS rgb,
  '#' || printf('%02x%02x%02x', p_partkey % 256, p_size, (p_partkey * 7) % 256) AS hex6, '#' || printf('%02x', (p_size % 16) * 17) || '00ff' AS hex3,
  '#ff0000' AS hsl, '#ff000080' AS rgba, '#0000ff' AS named, '#00000000' AS clear, CAST(NULL AS VARCHAR) AS bad, '#00ff00' AS hwb, '#ffffff' AS oklab FROM part""")
def normalize_colors(spark, sf_dir):
    r, g, b = F.expr("p_partkey % 256"), F.col("p_size"), F.expr("(p_partkey * 7) % 256")
    made = {
        "rgb": F.format_string("rgb(%d, %d, %d)", r, g, b), "hex6": F.upper(F.format_string("#%02x%02x%02x", r, g, b)), "hex3": F.format_string("#%x0F", F.expr("p_size % 16")),
        "hsl": F.lit("hsl(0, 100%, 50%)"), "rgba": F.lit("rgba(255,0,0,0.5)"), "named": F.lit(" BLUE "), "clear": F.lit("transparent"), "bad": F.lit("not-a-color"),
        "hwb": F.lit("hwb(120deg 0% 0%)"), "oklab": F.lit("oklab(100% 0 0)"),
    }
    every = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.array(*made.values()), normalize_color).alias("every"))
    return every.select("p_partkey", *[F.get("every", F.lit(i)).alias(k) for i, k in enumerate(made)])


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS whole, CAST(o_orderkey AS VARCHAR) || '.5' AS half,
  CASE WHEN o_orderkey = 0 THEN '0' ELSE '-' || o_orderkey END AS negative, '0' AS zero, '0.5' AS point, '1e-7' AS tiny, '1e+21' AS large, '1e3' AS other FROM orders""")
def format_numbers(spark, sf_dir):
    k = _text("o_orderkey")
    made = {"whole": F.concat(F.lit("+0"), k, F.lit(".00")), "half": F.concat(k, F.lit(".50")), "negative": F.concat(F.lit("-"), k), "zero": F.lit("-0"), "point": F.lit(".5"), "tiny": F.lit("0.0000001"), "large": F.lit("1" + "0" * 21), "other": F.lit(" 1e3 ")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[format_number(v).alias(k) for k, v in made.items()])


@query("""SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z]', '', 'g') || '-color' AS camel, '--' || n_name AS custom,
  '-ms-' || regexp_replace(lower(n_name), '[^a-z]', '', 'g') || '-x' AS ms, '-webkit-box' AS dashed FROM nation""")
def normalize_properties(spark, sf_dir):
    w = F.regexp_replace(F.lower("n_name"), "[^a-z]", "")
    made = {"camel": F.concat(w, F.lit("Color")), "custom": F.concat(F.lit("--"), F.col("n_name")), "ms": F.concat(F.lit("ms"), F.initcap(w), F.lit("X")), "dashed": F.lit("-webkit-box")}
    return table(spark, sf_dir, "nation").select("n_nationkey", *[normalize_property(v).alias(k) for k, v in made.items()])


@query("SELECT page_id, 'url(' || url || ')' AS double_quoted, 'url(' || url || ')' AS single_quoted, 'url(' || url || ')' AS bare, CAST(NULL AS VARCHAR) AS no_url FROM pages")
def normalize_urls(spark, sf_dir):
    u = F.col("url")
    made = {"double_quoted": F.concat(F.lit('URL( "'), u, F.lit('" )')), "single_quoted": F.concat(F.lit("url('"), u, F.lit("')")), "bare": F.concat(F.lit("url("), u, F.lit(")")), "no_url": u}
    return table(spark, sf_dir, "pages").select("page_id", *[normalize_url(v).alias(k) for k, v in made.items()])


@query("""SELECT o_orderkey, '0 0 2px ' || o_orderpriority AS shadow, lower(o_orderpriority) AS keyword, o_orderpriority AS module, '  ' || o_orderpriority AS text FROM orders""")
def normalize_texts(spark, sf_dir):
    p = F.col("o_orderpriority")
    loose = F.concat(F.lit("  "), p)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", normalize_shadow(F.concat(F.lit("\t0  0\n 2px   "), p, F.lit(" "))).alias("shadow"), normalize_keyword(F.concat(p, F.lit("\n"))).alias("keyword"),
        normalize_value(F.lit("module"), F.concat(loose, F.lit(" "))).alias("module"), normalize_value(F.lit("string"), loose).alias("text"),
    )


_TYPES = "CASE p_partkey % 6 WHEN 0 THEN 'length' WHEN 1 THEN 'number' WHEN 2 THEN 'keyword' WHEN 3 THEN 'color' WHEN 4 THEN 'union' ELSE 'module' END"


@query(f"""SELECT p_partkey, {_TYPES} AS type, CASE p_partkey % 6 WHEN 0 THEN p_size || 'px' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN CAST(p_size AS VARCHAR)
  WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS norm FROM part""")
def normalize_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_TYPES).alias("type"), normalize_value(F.expr(_TYPES), F.concat(F.lit(" "), _text("p_size"))).alias("norm"))


@query("SELECT n_nationkey, lower(n_name) AS trimmed FROM nation")
def unicode_trim(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", js_trim(F.concat(F.lit("﻿  \t"), F.lower("n_name"), F.lit("　\n"))).alias("trimmed"))


# -- classifiers ---------------------------------------------------------------
_RAW = ["url(a.png)", "#FFF", "oklch(1 0 0)", "0 0 2px red", "10.5px", "0", "red", "1px solid", "Inherit"]
_PROP = ["color", "box-shadow", "border-top-color", "margin", "backgroundColor"]
_CASES = f"SELECT n_nationkey, r.raw, p.prop FROM nation, (SELECT unnest({_RAW!r}) AS raw) r, (SELECT unnest({_PROP!r}) AS prop) p"


def _kind_sql(colors: str, shadow: bool, prop: str = "prop") -> str:
    shadow_case = f"WHEN {prop} = 'box-shadow' THEN 'shadow'" if shadow else ""
    return f"""CASE WHEN raw = 'url(a.png)' THEN 'url' WHEN raw IN ('#FFF', 'oklch(1 0 0)') THEN 'color' {shadow_case}
      WHEN raw = '10.5px' THEN 'length' WHEN raw = '0' THEN 'number' WHEN raw IN ('red', 'Inherit') AND {prop} IN ({colors}) THEN 'color' ELSE 'keyword' END"""


@query(f"""SELECT n_nationkey, raw, prop, {_kind_sql("'color', 'border-top-color'", True)} AS sheet, {_kind_sql("'color', 'backgroundColor'", False)} AS inline_style,
  {_kind_sql("'color'", True)} AS css_in_js FROM ({_CASES})""")
def classify_values(spark, sf_dir):
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("raw"), F.lit(p).alias("prop")) for r in _RAW for p in _PROP]))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", pairs.alias("x")).select("n_nationkey", "x.raw", "x.prop")
    return rows.select("*", *[value_type("prop", "raw", place).alias(name) for place, name in (("sheet", "sheet"), ("inline", "inline_style"), ("css-in-js", "css_in_js"))])


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS unitless FROM part""")
def unitless_properties(spark, sf_dir):
    name = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'line-Height' WHEN 1 THEN 'width' ELSE 'marginTop' END")
    return table(spark, sf_dir, "part").select("p_partkey", is_unitless(name).alias("unitless"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'static-union' WHEN 2 THEN 'literal' WHEN 3 THEN 'unknown' ELSE 'dynamic' END AS certainty FROM part""")
def classify_certainty(spark, sf_dir):
    kind = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'union' WHEN 2 THEN NULL WHEN 3 THEN 'string' ELSE 'color' END")
    hint = F.expr("CASE WHEN p_partkey % 5 IN (1, 3, 4) THEN 'unknown' END")
    return table(spark, sf_dir, "part").select("p_partkey", certainty(kind, F.expr("p_partkey % 5 = 4"), hint).alias("certainty"))


@query("""SELECT p_partkey, 'length' AS px, 'color' AS hex, 'number' AS bare, 'keyword' AS calc, 'length' AS hinted_type, p_size || ' 0' AS hinted_raw, true AS class_like, false AS plain FROM part""")
def classify_arbitrary(spark, sf_dir):
    s = _text("p_size")
    hinted = declared_value(F.concat(F.lit("length:"), s, F.lit("_0")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", arbitrary_type(F.concat(s, F.lit("px"))).alias("px"), arbitrary_type(F.lit("#12345678")).alias("hex"), arbitrary_type(s).alias("bare"),
        arbitrary_type(F.lit("calc(1px_+_2px)")).alias("calc"), hinted["type"].alias("hinted_type"), hinted["raw"].alias("hinted_raw"),
        looks_like_class(F.lit("md:x")).alias("class_like"), looks_like_class(F.lit("active")).alias("plain"),
    )


@query("""SELECT p_partkey, 'px-[' || p_size || 'px]' AS bare, 'px' AS utility, 'px' AS prefix, p_size || 'px' AS arbitrary, true AS is_arbitrary,
  '-mt' AS negative_utility, 'mt' AS negative_prefix, 'p-2' AS nested FROM part""")
def parse_tokens(spark, sf_dir):
    s = _text("p_size")
    token = F.concat(F.lit("md:hover:px-["), s, F.lit("px]"))
    t, n = parse_token(token), parse_token(F.lit("-mt-[6px]"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", strip_variants(token).alias("bare"), *[t[c].alias(c) for c in ("utility", "prefix", "arbitrary", "is_arbitrary")],
        n["utility"].alias("negative_utility"), n["prefix"].alias("negative_prefix"), strip_variants(F.lit("[&_[data-x]]:p-2")).alias("nested"),
    )


@query("""SELECT p_partkey, prop AS property, p_size || 'px' AS norm FROM part, (SELECT unnest(['padding-left', 'padding-right']) AS prop)""")
def resolve_utilities(spark, sf_dir):
    t = parse_token(F.concat(F.lit("md:px-["), _text("p_size"), F.lit("px]")))
    rows = table(spark, sf_dir, "part").select("p_partkey", t["prefix"].alias("prefix"), declared_value(t["arbitrary"]).alias("v"))
    found = rows.select("*", F.col("v.type").alias("type")).join(F.broadcast(rules_table(spark)), ["prefix", "type"])
    return found.select("p_partkey", "property", normalize_value("type", "v.raw").alias("norm"))


@query("""SELECT doc_id, token, min(length(token) % 2) AS conditional, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS token FROM documents WHERE text IS NOT NULL) WHERE token <> '' GROUP BY doc_id, token""")
def split_and_dedupe_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(split_classes("text")).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.min(F.length("token") % 2).alias("conditional"), F.count(F.lit(1)).alias("n"))


# -- identity ------------------------------------------------------------------
@query("""SELECT o_orderkey, sha256('{"file":"o","kind":"import","loc":{"col":1,"endCol":2,"endLine":' || o_orderkey || ',"line":' || o_orderkey || '},"norm":null,"subject":{"import_kind":"named","local":"' || o_orderpriority || '","specifier":"' || o_orderstatus || '"}}') AS fact_id,
  '{"a":null,"b":"' || o_orderpriority || '","c":' || o_orderkey || '}' AS canonical FROM orders""")
def canonical_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    loc = F.struct(k.alias("line"), F.lit(1).alias("col"), k.alias("endLine"), F.lit(2).alias("endCol"))
    subject = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("name", "imported_from", "component", "prop", "owner", "attribute", "property", "selector", "media", "owner_component", "token", "utility", "element_id")], F.lit(None).cast("boolean").alias("is_dom"), F.lit(None).cast("boolean").alias("is_arbitrary"), F.col("o_orderstatus").alias("specifier"), F.col("o_orderpriority").alias("local"), F.lit("named").alias("import_kind"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", loc.alias("loc"), subject.alias("subject"), F.lit(None).cast("string").alias("norm"))
    canonical = canonical_json(F.struct(F.lit(None).cast("string").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_orderkey").alias("c")))
    return rows.select("o_orderkey", fact_id(F.lit("import"), F.lit("o"), "loc", "subject", "norm").alias("fact_id"), canonical.alias("canonical"))


@query("""SELECT count(*) AS file_count, sha256('[' || coalesce(string_agg('["d/' || doc_id || '.css","' || sha256(coalesce(text, '')) || '"]', ',' ORDER BY 'd/' || doc_id || '.css'), '') || ']') AS files_digest FROM documents""")
def header_digest(spark, sf_dir):
    return files_digest(_documents(spark, sf_dir))


def _documents(spark, sf_dir):
    return from_table(table(spark, sf_dir, "documents"), F.concat(F.lit("d/"), _text("doc_id"), F.lit(".css")), F.coalesce("text", F.lit("")))


@query("SELECT 'd/' || doc_id || '.css' AS path, sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents")
def content_hashes(spark, sf_dir):
    return _documents(spark, sf_dir).select("path", "hash", "bytes")


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN 'css' ELSE 'program' END AS language, count(*) AS n FROM documents WHERE doc_id % 4 < 3 GROUP BY 1""")
def route_by_extension(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("a.CSS", "a.tsx", "a.ts", "a.scss"))), (F.col("doc_id") % 4 + 1).cast("int"))
    routes = table(spark, sf_dir, "documents").select(routed(path).alias("route")).where("route is not null")
    return routes.groupBy(F.replace("route", F.lit("sheet"), F.lit("css")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


# -- extractors ----------------------------------------------------------------
def _extractor(name: str, where_spark: str, where_sql: str, of=views, facts: str = VIEW_FACTS):
    def run(spark, sf_dir):
        return _flat(_facts(spark, sf_dir, of).where(where_spark))

    run.__name__ = name
    query(f"WITH {facts} SELECT {FLAT} FROM facts WHERE {where_sql}")(run)


_extractor("extract_css", "true", "true", sheets, SHEET_FACTS)
_extractor("extract_imports", "kind = 'import'", "kind = 'import'")
_extractor("extract_elements", "kind = 'jsx.element'", "kind = 'jsx.element'")
_extractor("extract_attributes", "kind in ('jsx.prop', 'jsx.attribute')", "kind in ('jsx.prop', 'jsx.attribute')")
_extractor("extract_inline_style", "source = 'inline'", "source = 'inline'")
_extractor("extract_css_in_js", "source = 'css-in-js'", "source = 'css-in-js'")
_extractor("extract_classes", "kind = 'css.class'", "kind = 'css.class'")
_extractor("expand_arbitrary_values", "kind = 'css.declaration' and source = 'tailwind'", "kind = 'css.declaration' and source = 'tailwind'")


@query("""SELECT page_id, 1 AS n, '0' AS norm, 'p' AS selector FROM pages WHERE html LIKE '%<style>p{margin:0}</style>%'""")
def extract_page_styles(spark, sf_dir):
    facts = _facts(spark, sf_dir, page_styles)
    return facts.select(F.regexp_extract("file", r"\d+", 0).cast("long").alias("page_id"), F.lit(1).alias("n"), F.col("value.norm").alias("norm"), F.col("subject.selector").alias("selector"))


@query(f"WITH {SHEET_FACTS} SELECT file, line, raw FROM facts")
def extract_in_sql(spark, sf_dir):
    register_udtf(spark)
    sheets(spark, sf_dir).createOrReplaceTempView("sheet_sources")
    return spark.sql("SELECT x.file, x.loc.line AS line, x.raw FROM sheet_sources s, LATERAL extract_facts(s.path, s.code) x WHERE x.rec = 'obs'")


@query("""SELECT 'b/' || p_partkey || '.css' AS file, 'parse-error' AS reason FROM part WHERE p_partkey % 2 = 0""")
def parse_diagnostics(spark, sf_dir):
    code = F.when(F.col("p_partkey") % 2 == 0, "a { color: red").otherwise("a { color: red }")
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("b/"), _text("p_partkey"), F.lit(".css")).alias("path"), code.alias("code"))
    return extract(made).diagnostics.select("file", "reason")


@query("""SELECT 'r/' || n_nationkey || '.tsx' AS file, reason, raw FROM nation, (SELECT unnest([
  {'reason': 'template-with-expressions', 'raw': '`a${x}`'}, {'reason': 'imported-binding', 'raw': 'dep'}, {'reason': 'mutable-binding', 'raw': 'mut'},
  {'reason': 'unbound-identifier', 'raw': 'nope'}, {'reason': 'member-key-missing', 'raw': 'MAP.zz'}, {'reason': 'unsupported-node:CallExpression', 'raw': 'f()'},
  {'reason': 'unsupported-unary:!', 'raw': '!ok'}, {'reason': 'member-object-unresolved', 'raw': 'dep.x'}, {'reason': 'resolution-budget-exhausted', 'raw': 'TWO'}], recursive := true))""")
def resolver_reasons(spark, sf_dir):
    exprs = ["`a${x}`", "dep", "mut", "nope", "MAP.zz", "f()", "!ok", "dep.x", "TWO"]
    code = "import dep from 'dep';\nlet mut = 1;\nconst ONE = 1;\nconst TWO = ONE;\nconst MAP = { a: 1 };\nconst el = <X " + " ".join(f"p{i}={{{e}}}" for i, e in enumerate(exprs)) + " />;\n"
    made = table(spark, sf_dir, "nation").select(F.concat(F.lit("r/"), _text("n_nationkey"), F.lit(".tsx")).alias("path"), F.lit(code).alias("code"))
    return extract(made).facts.where("kind = 'jsx.prop'").select("file", F.col("diagnostic").alias("reason"), F.col("value.raw").alias("raw"))


@query("""SELECT 'u/' || n_nationkey || '.tsx' AS file, token, certainty FROM nation, (SELECT unnest([
  {'token': 'a-1', 'certainty': 'literal'}, {'token': 'b-1', 'certainty': 'static-union'}, {'token': 'c-1', 'certainty': 'static-union'},
  {'token': 'd:1', 'certainty': 'static-union'}, {'token': 'e-1', 'certainty': 'static-union'}, {'token': 'f-1', 'certainty': 'literal'}], recursive := true))""")
def collect_classes(spark, sf_dir):
    code = "const K = 'f-1';\nconst el = <i className={cn('a-1', on ? 'b-1' : 'c-1', { 'd:1': on, x: 'e-1' }, [K], on && 'a-1')} />;\n"
    made = table(spark, sf_dir, "nation").select(F.concat(F.lit("u/"), _text("n_nationkey"), F.lit(".tsx")).alias("path"), F.lit(code).alias("code"))
    return extract(made).facts.where("kind = 'css.class'").select("file", F.col("subject.token").alias("token"), "certainty")


# -- facts as a table ------------------------------------------------------------
@query(f"WITH {VIEW_FACTS} SELECT fact_id, row_number() OVER (ORDER BY file, line, col, kind, fact_id) AS place FROM facts")
def total_order(spark, sf_dir):
    return numbered(_facts(spark, sf_dir)).select("fact_id", "place")


@query(f"""WITH {SHEET_FACTS} SELECT sha256('{{"certainty":"literal","fact_id":"' || fact_id || '","file":"' || file || '","kind":"css.declaration","loc":{{"col":' || col || ',"endCol":' || "endCol" || ',"endLine":' || "endLine" || ',"line":' || line ||
  '}},"producer_v":"tessera-css@0.1.0","schema_v":"0.2.0","source":"plain-css","subject":' || subject || ',"value":{{"norm":"' || norm || '","raw":"' || raw || '","type":"' || value_type || '"}}}}') AS line_hash FROM facts""")
def ndjson_lines(spark, sf_dir):
    return _facts(spark, sf_dir, sheets).select(sha256_hex(fact_json()).alias("line_hash"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_last(spark, sf_dir):
    """Events as versions of one fact a user; the last in time stays."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(
        _text("user_id").alias("fact_id"), F.lit("events").alias("producer_v"), F.col("event_type").alias("source"), F.lit("literal").alias("certainty"), none.alias("diagnostic"),
        F.struct(_text("value").alias("raw")).alias("value"), "event_id", F.col("value").alias("amount"), F.struct("ts", "event_id").alias("place"),
    )
    return upsert(rows, order="place").select(F.col("fact_id").cast("long").alias("user_id"), "event_id", F.col("source").alias("event_type"), F.col("amount").alias("value"))


@query(f"WITH {SHEET_FACTS} SELECT kind, count(DISTINCT fact_id) AS n FROM facts GROUP BY kind")
def upsert_facts(spark, sf_dir):
    runs = _facts(spark, sf_dir, sheets).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    return upsert(runs, order="run").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN s THEN 'added' ELSE 'removed' END AS change, count(*) AS n FROM (
  SELECT p_partkey % 10 = 1 AS s FROM part WHERE p_partkey % 10 IN (0, 1)) GROUP BY 1""")
def diff_runs(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.sha2(_text("p_partkey"), 256).alias("fact_id"), (F.col("p_partkey") % 10).alias("m"))
    return diff(ids.where("m <> 1"), ids.where("m <> 0")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VIEW_FACTS} SELECT f.fact_id, x.fact_id AS element_id, CASE WHEN x.subject LIKE '%Tile%' THEN 'Tile' ELSE 'div' END AS element_name,
  CASE WHEN x.subject LIKE '%Tile%' THEN '@north/kit' END AS element_from FROM facts f JOIN facts x ON x.kind = 'jsx.element' AND f.subject LIKE '%"element_id":"' || x.fact_id || '"%' AND f.file = x.file""")
def join_elements(spark, sf_dir):
    return owned_by(_facts(spark, sf_dir)).select("fact_id", "element_id", "element_name", "element_from")


_UNRESOLVED = "certainty IN ('dynamic', 'unknown')"


@query(f"""WITH {VIEW_FACTS} SELECT 'kind' AS section, kind AS key, count(*) AS n FROM facts GROUP BY kind UNION ALL SELECT 'certainty', certainty, count(*) FROM facts GROUP BY certainty
  UNION ALL SELECT 'source', source, count(*) FROM facts GROUP BY source UNION ALL SELECT 'total', 'facts', count(*) FROM facts UNION ALL SELECT 'total', 'unresolved', count(*) FROM facts WHERE {_UNRESOLVED}
  UNION ALL SELECT 'reason', diagnostic, count(*) FROM facts WHERE {_UNRESOLVED} GROUP BY diagnostic""")
def coverage_report(spark, sf_dir):
    return coverage(_facts(spark, sf_dir))


@query(f"WITH {VIEW_FACTS} SELECT count(*) AS facts, count(*) FILTER ({_UNRESOLVED}) AS unresolved, count(*) FILTER ({_UNRESOLVED}) / count(*) AS unresolved_rate FROM facts")
def coverage_rate(spark, sf_dir):
    return unresolved_rate(_facts(spark, sf_dir))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_kind(spark, sf_dir):
    """Events as facts of their type, counted by the coverage report."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.lit("literal").alias("certainty"), F.lit("events").alias("source"), F.lit(None).cast("string").alias("diagnostic"))
    return coverage(rows).where("section = 'kind'").select(F.col("key").alias("event_type"), "n")


# -- policies --------------------------------------------------------------------
_RULES = {
    "hardcoded-color": "kind = 'css.declaration' AND value_type = 'color' AND certainty = 'literal'",
    "hardcoded-spacing": "kind = 'css.declaration' AND value_type = 'length' AND certainty = 'literal'",
    "no-arbitrary-tailwind": "kind = 'css.class' AND subject LIKE '%\"is_arbitrary\":true%'",
    "no-inline-style": "kind = 'css.declaration' AND source = 'inline'",
    "needs-review": "kind = 'css.declaration' AND certainty IN ('dynamic', 'unknown')",
}


def _policy(policy) -> None:
    def run(spark, sf_dir):
        return run_policy(_facts(spark, sf_dir), policy).select("fact_id", "file", "raw")

    run.__name__ = "policy_" + policy.id.replace("-", "_")
    query(f"WITH {VIEW_FACTS} SELECT fact_id, file, raw FROM facts WHERE {_RULES[policy.id]}")(run)


for _p in STANDARD.policies[:4]:
    _policy(_p)


@query("""SELECT 'w/' || c_custkey || '.tsx' AS file, property, raw, diagnostic FROM customer, (SELECT unnest([
  {'property': 'height', 'raw': 'INTERPOLATION_0px', 'diagnostic': 'styled-interpolation'}, {'property': 'color', 'raw': 'inherit', 'diagnostic': 'unnormalizable-color'},
  {'property': 'top', 'raw': 'x', 'diagnostic': 'mutable-binding'}], recursive := true))""")
def policy_needs_review(spark, sf_dir):
    return run_policy(_facts(spark, sf_dir, reviews), STANDARD.policies[4]).select("file", "property", "raw", "diagnostic")


@query(f"WITH {VIEW_FACTS} " + " UNION ALL ".join(f"SELECT '{p.id}' AS policy, '{p.level}' AS level, count(*) AS violations, CAST(count(*) = 0 AS INTEGER) AS score FROM facts WHERE {_RULES[p.id]}" for p in STANDARD.policies if p.level != "note"))
def policy_scores(spark, sf_dir):
    return scores(_facts(spark, sf_dir))


@query(f"""WITH {VIEW_FACTS}, named AS (SELECT *, json_extract_string(subject, '$.property') AS property FROM facts)
  SELECT '{STANDARD.policies[3].id}' AS policy, file, line, col, fact_id, '{{"ruleId":"no-inline-style","level":"warning","message":{{"text":"' || property ||
  '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || line || ',"startColumn":' || (col + 1) || ',"endLine":' || "endLine" ||
  ',"endColumn":' || ("endCol" + 1) || '}}}}}}],"partialFingerprints":{{"factId":"' || fact_id || '"}}}}' AS result FROM named WHERE source = 'inline'""")
def sarif_rows(spark, sf_dir):
    return sarif_results(_facts(spark, sf_dir)).where("policy = 'no-inline-style'")


@query("SELECT o_orderkey, 'order ' || o_orderkey || ' is ' || o_orderpriority || '; ' AS text FROM orders")
def render_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("nothing", F.lit(None).cast("string"))
    return rows.select("o_orderkey", message("order {o_orderkey} is {o_orderpriority}; {nothing}{missing}", rows.columns).alias("text"))


@query(f"""WITH {VIEW_FACTS} SELECT fact_id, raw FROM facts WHERE json_extract_string(subject, '$.property') = 'width' AND value_type = 'length' OR json_extract_string(subject, '$.is_arbitrary') = 'true'""")
def json_paths(spark, sf_dir):
    sql = "SELECT * FROM facts WHERE json->>'$.subject.property' = 'width' AND json_extract(json, '$.value.type') = 'length' OR json_extract(json, '$.subject.is_arbitrary') = 1"
    return run_policy(_facts(spark, sf_dir), Policy("paths", sql)).select("fact_id", "raw")


@query(f"WITH {VIEW_FACTS} SELECT {FLAT} FROM facts")
def json_round_trip(spark, sf_dir):
    """Facts as canonical JSON lines, read again."""
    return _flat(facts_from_json(_facts(spark, sf_dir).select(fact_json().alias("value"))))


@query(f"WITH {VIEW_FACTS} SELECT fact_id, norm FROM facts WHERE norm IS NOT NULL AND norm NOT IN ('#a1b2c3', 'flex', '@north/kit')")
def allow_list(spark, sf_dir):
    allowed = spark.range(1).select(F.explode(F.from_json(F.lit('["#a1b2c3", "flex", "@north/kit"]'), "array<string>")).alias("norm"))
    return listed(_facts(spark, sf_dir).where("value.norm is not null"), allowed, "value.norm", inside=False).select("fact_id", F.col("value.norm").alias("norm"))


@query("""SELECT 'hit' AS state, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'miss', count(*) FROM documents WHERE doc_id % 3 = 0""")
def cache_split(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    id_ = F.regexp_extract("path", r"\d+", 0).cast("long")
    before = docs.where(id_ % 3 != 0)
    hits, misses = split_by_cache(file_keys(docs, "s"), file_keys(before, "s"))
    both = hits.select(F.lit("hit").alias("state")).unionByName(misses.select(F.lit("miss").alias("state")))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VIEW_FACTS} SELECT kind, count(*) AS n FROM facts GROUP BY kind")
def assemble_facts(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 15 AS rows_per_file, count(*) AS files FROM customer")
def parse_once(spark, sf_dir):
    per = parse_sources(views(spark, sf_dir)).groupBy("file").agg((F.count(F.lit(1)) + 1).alias("n"))
    return per.groupBy(F.col("n").cast("int").alias("rows_per_file")).agg(F.count(F.lit(1)).alias("files"))
