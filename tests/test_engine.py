import hashlib
import io
import json
import re

import pytest
from pyspark.sql import functions as F

from tessera import cli, schema
from tessera.functions.normalize import format_number, normalize_color, normalize_keyword, normalize_length, normalize_property, normalize_value
from tessera.functions.utility import parse_token
from tessera.operators.assemble import diff, listed, numbered, sort_facts, upsert
from tessera.operators.extract import extract
from tessera.operators.output import coverage, fact_json, facts_from_json, ndjson, unresolved_rate
from tessera.parse import css, tsx
from tessera.parse.extractors import Options, extract_file, register
from tessera.plans.policy import STANDARD, Policy, PolicySet, condition, load_policies, run_policy, sarif, sarif_results, scores, translate
from tessera.sources.cache import extract_cached
from tessera.sources.files import build_header, discover, from_table

TSX = """import styled, { css as c } from 'styled-components';
import * as UI from '@acme/ui';
import './side.css';
const Box = styled(UI.Panel)`
  color: #FFF; padding: ${p => p.x}px;
`;
let mut = 1;
const S = { sm: 4, md: 8 } as const;
const M = { a: '1px', b: '2px' };
export const View = ({ on, k }: Props) => (
  <UI.Card {...rest} disabled tone={on ? 'a' : 'b'} m={mut}>
    <div style={{ WebkitBoxShadow: '0 0 1px red', zIndex: 2, top: -4, left: S.sm, right: M[k], [k]: 1 }} class={clsx('x', cond && 'y')} />
  </UI.Card>
);
"""

#: The digest of the stream of APP, from a run whose lines were read one by one.
PINNED = "1ce35cdbb61bd5f98921ed9b2c382a5f21765b343a983d85287f2a2f55d8659d"


def rows(spark, files):
    df = spark.createDataFrame(list(files.items()), "f string, t string")
    return from_table(df, F.col("f"), F.col("t"))


def one(spark, column_of, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column_of(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "function, pairs",
    [
        (normalize_color, {"#FFF": "#ffffff", "#abc": "#aabbcc", "rgb(255,0,0)": "#ff0000", "red": "#ff0000", "hsl(0, 100%, 50%)": "#ff0000", "rgba(255,0,0,0.5)": "#ff000080", "not-a-color": None, "": None, "hwb(120 0% 0%)": "#00ff00", "transparent": "#00000000", "lab(100% 0 0)": "#ffffff"}),
        (normalize_length, {"10.0PX": "10px", ".5rem": "0.5rem", "-2EM": "-2em", "50%": "50%", "0": "0px", "auto": None, "10px 20px": None}),
        (format_number, {"10.0": "10", "+3": "3", ".5": "0.5", "-0": "0", "007": "7"}),
        (normalize_keyword, {"  Bold ": "bold", "CENTER": "center"}),
        (normalize_property, {"backgroundColor": "background-color", "WebkitTransform": "-webkit-transform", "msFlex": "-ms-flex", "--myToken": "--myToken"}),
        (lambda v: normalize_value(F.lit("url"), v), {"url('a.png')": "url(a.png)", "noturl": None}),
    ],
)
def test_normalizers(spark, function, pairs):
    assert one(spark, function, list(pairs)) == list(pairs.values())


def test_css_positions_and_errors():
    found = css.parse("/* x */ .a { color : red !important; .b & { --x: {a:b}; } }\n@MEDIA print { top: 0 }")
    assert [(d.prop, d.value, d.selector, d.media) for d in found] == [("color", "red", ".a", None), ("--x", "{a:b}", ".b &", None), ("top", "0", None, "print")]
    for bad in ("a { color: red", "}", "a { nonsense }", 'a { b: "x }'):
        with pytest.raises(css.CssError):
            css.parse(bad)


@pytest.mark.parametrize("code", ["const x = <T,>(a: T): a is string => a as unknown as T;", "if (a < b && c > d) { f<number>(/x[/]y/g) }", "class A<T> extends B implements C { private x?: number = 1; get y() { return this.#z } static { } }", "type X = { [K in keyof T]?: `a${string}` } | (() => void); let a = b ? (c) : d;", "const el = <><a.b x:y='1' {...z}/>{/* c */}text {a < b}</>;", "label: for (const { a = 1, ...b } of c) continue label;", "export default async function* f() { yield* g(); }"])
def test_parser_reads(code):
    tsx.parse(code)


def test_parser_reports_errors():
    with pytest.raises(tsx.TsxError):
        tsx.parse("const = ;")
    assert extract_file("a.tsx", "<div>")[0]["reason"] == "parse-error"
    assert extract_file("a.js", "x") == []


def test_extraction(spark):
    x = extract(rows(spark, {"a.tsx": TSX}))
    got = {(r.kind, r.subject.property or r.subject.prop or r.subject.token or r.subject.local or r.subject.name, r.value and r.value.raw): r for r in x.facts.collect()}
    assert got["import", None, "./side.css"].subject.import_kind == "side-effect"
    assert got["css.declaration", "color", "#FFF"].subject.owner_component == "Box"
    assert got["css.declaration", "padding", "INTERPOLATION_0px"].diagnostic == "styled-interpolation"
    assert got["jsx.element", "UI.Card", None].subject.imported_from == "@acme/ui"
    assert got["jsx.prop", "tone", "on ? 'a' : 'b'"].certainty == "static-union"
    assert got["jsx.prop", "m", "mut"].diagnostic == "mutable-binding"
    assert got["css.declaration", "-webkit-box-shadow", "0 0 1px red"].value.type == "keyword"
    assert got["css.declaration", "z-index", "2"].value.norm == "2"
    assert got["css.declaration", "top", "-4"].value.norm == "-4px"
    assert got["css.declaration", "left", "S.sm"].diagnostic == "member-object-unresolved"
    assert got["css.declaration", "right", "M[k]"].certainty == "static-union"
    assert got["css.class", "y", "y"].certainty == "static-union"
    assert {r.reason for r in x.diagnostics.collect()} == {"spread-attribute", "computed-style-key", "unknown-classname"}


def test_known_ids_and_order(spark):
    facts = extract(rows(spark, {"Badge.tsx": "\n\n\n\n\n    <span\n" + "x={1}\n" * 9 + "    >b</span>;\n"})).facts
    first = facts.where("kind = 'jsx.element'").first()
    assert first.fact_id == "a203c8ecfc8098fd4e527a19c9d4c4c9a88474767d2ac6b818fca0b1cb483dbe"
    again = [r[0] for r in ndjson(facts.repartition(3)).collect()]
    assert again == [r[0] for r in ndjson(facts).collect()]
    assert json.dumps(json.loads(again[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == again[0]
    assert sort_facts(facts).count() == facts.count()


def test_upsert_diff_coverage_policies(spark):
    facts = extract(rows(spark, {"a.css": ".a { color: #FFF; margin: 2px; top: calc(1px) }", "b.tsx": TSX})).facts
    n = facts.select("fact_id").distinct().count()
    assert upsert(facts.unionByName(facts), facts).count() == n
    assert diff(facts, facts.where("kind <> 'import'")).count() == facts.where("kind = 'import'").count()
    report = {(r.section, r.key): r.n for r in coverage(facts).collect()}
    assert report["total", "facts"] == facts.count()
    assert unresolved_rate(facts.limit(0)).first().unresolved_rate == 0
    assert {r.policy: r.score for r in scores(facts).collect()}["hardcoded-color"] == 0
    log = sarif(facts)
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == sum(run_policy(facts, p).count() for p in STANDARD.policies)
    bundle = load_policies('{"name": "x", "policies": [{"id": "a", "sql": "SELECT * FROM facts WHERE json->>\'$.subject.property\' = \'color\'", "level": "error"}]}')
    assert run_policy(facts, bundle.policies[0]).count() == 2
    assert translate("json_extract(json, '$.subject.is_arbitrary') = 1") == "is_arbitrary"


def test_files_cache_and_cli(spark, tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.css").write_text(".a { color: #FFF; }")
    (root / "node_modules" / "b.css").write_text(".b { color: red; }")
    (root / ".h.css").write_text("x")
    found = discover(spark, str(root))
    assert [r.path for r in found.collect()] == ["a.css"]
    assert discover(spark, str(root), exclude=()).count() == 2
    header = build_header(found)
    assert header["file_count"] == 1 and len(header["cache_key"]) == 64
    runs = [extract_cached(found, str(tmp_path / "cache")) for _ in range(2)]
    assert [(r.hits, r.misses) for r in runs] == [(0, 1), (1, 0)]
    assert sorted(r.result.facts.first().fact_id for r in runs)[0] == extract(found).facts.first().fact_id
    (root / "a.css").write_text(".a { color: #000; }")
    changed = extract_cached(discover(spark, str(root)), str(tmp_path / "cache"))
    assert changed.misses == 1 and changed.result.facts.first().value.norm == "#000000"
    out, err = io.StringIO(), io.StringIO()
    assert cli.run(["extract", str(root)], spark, out, err) == 0 and json.loads(out.getvalue())["kind"] == "css.declaration"
    assert [cli.run(a, spark, out, err) for a in (["--version"], ["--help"], [], ["nope"], ["extract", "/nowhere"], ["--bad"])] == [0, 0, 1, 2, 1, 2]


def test_one_parse_for_every_query(spark):
    """Python reads each file once, whatever is asked of its facts."""
    from tessera.plans.catalog import QUERIES

    single = ["extract_css", "coverage_report", "policy_scores", "sarif_rows", "join_elements", "upsert_facts", "ndjson_lines", "expand_arbitrary_values", "assemble_facts"]
    for name in single:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


APP = {
    "Panel.tsx": TSX,
    "base.css": ".a { color: #FFF; margin: 0 4px; border-radius: 0 }\n@media print { .b { background: transparent; top: 3PX } }",
    "Tag.tsx": "const SIZE = 4;\nconst C = 'mt-[6px] md:hover:[&_[data-x=\"[y]\"]]:p-2';\nexport const T = () => <b className={C} style={{ left: -SIZE, top: +SIZE, color: 'red' }} x={-'a'} />;\n",
}


def test_pinned_stream(spark):
    """The whole stream of a small application: a change of any id, order or text shows."""
    x = extract(rows(spark, APP))
    lines = [r[0] for r in ndjson(x.facts).collect()]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == PINNED, lines
    assert {r.policy: r.violations for r in scores(x.facts).collect()} == {"hardcoded-color": 4, "hardcoded-spacing": 5, "no-arbitrary-tailwind": 1, "no-inline-style": 8}
    signed = {r.subject.property: r.value.norm for r in x.facts.where("source = 'inline' and file = 'Tag.tsx'").collect()}
    assert signed == {"left": "-4px", "top": "4px", "color": "#ff0000"}
    assert {r.diagnostic for r in x.facts.where("subject.prop = 'x' or subject.attribute = 'x'").collect()} == {"unsupported-unary:-"}


REASONS = """import styled from 'styled-components';
import dep from 'dep';
declare const Q: number;
const E = {};
const SP = { ...dep };
const FN = { a() {} };
const Bad = styled.div`${dep};`;
const Odd = styled.div`${dep}: 1px;`;
const el = <div {...dep} a={E[dep]} b={SP.x} c={FN[dep]} d={} f={Q} style={dep} className={`x-${dep} y`} />;
const two = <i style={{ ...dep, [dep]: 1, ok: 2 }} className={dep} class={[dep.x, f()]} />;
"""


def test_reason_codes(spark):
    x = extract(rows(spark, {"r.tsx": REASONS, "bad.css": "a { color: red"}))
    on_facts = {r.diagnostic for r in x.facts.where("diagnostic is not null").collect()}
    assert {"member-empty-object", "member-object-has-spread", "member-non-data-property", "empty-expression", "no-initializer", "imported-binding"} <= on_facts
    side = {(r.file, r.reason) for r in x.diagnostics.collect()}
    assert {r for f, r in side if f == "r.tsx"} == {
        "spread-attribute", "dynamic-style-object", "non-property-in-style", "computed-style-key", "styled-parse-error", "dynamic-styled-property",
        "dynamic-classname-segment", "unknown-classname", "dynamic-classname-call", "dynamic-classname",
    }
    assert ("bad.css", "parse-error") in side


def test_globs(spark, tmp_path):
    from tessera.sources.files import glob_regex, listing

    cases = {"**/*.{ts,tsx}": (["a.ts", "x/y/b.tsx"], ["a.css", "a.ts/x"]), "src/*.css": (["src/a.css"], ["src/x/a.css", "a.css"]), "**/dist/**": (["dist/a", "x/dist/y/z"], ["distant/a"]), "[!a]?.ts": (["bc.ts"], ["ac.ts", "b.ts"])}
    for glob, (yes, no) in cases.items():
        assert all(re.match(glob_regex(glob), x) for x in yes) and not any(re.match(glob_regex(glob), x) for x in no), glob
    for name, data in {"src/b.css": b".a { color: \xff }", "src/a.ts": b"let x = 1", "gen/c.css": b".c { top: 1px }", ".hid/d.css": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert [r.path for r in listing(discover(spark, str(tmp_path))).collect()] == ["gen/c.css", "src/a.ts", "src/b.css"]
    assert [r.path for r in discover(spark, str(tmp_path), exclude=("gen/**",), include=("**/*.css",)).collect()] == ["src/b.css"]
    assert discover(spark, str(tmp_path)).where("path = 'src/b.css'").first().code == ".a { color: \ufffd }"


def test_cache_survives_crashes_and_damage(spark, tmp_path):
    import shutil

    files = rows(spark, {"a.css": ".a { color: #FFF }", "b.css": ".b { top: 1px }"})
    cache = str(tmp_path / "cache")
    want = [r[0] for r in ndjson(extract(files).facts).collect()]
    run = lambda df=files: extract_cached(df, cache)
    assert (run().misses, run().hits) == (2, 2)
    first = next((tmp_path / "cache" / "runs").iterdir())
    shutil.rmtree(first / "files")  # as after a crash between the two writes
    again = run()
    assert again.misses == 2 and [r[0] for r in ndjson(again.result.facts).collect()] == want
    for f in (tmp_path / "cache" / "runs").glob("*/rows/*.parquet"):
        f.write_bytes(b"damaged")
    assert [r[0] for r in ndjson(run().result.facts).collect()] == want
    twice = run(files.union(files))
    assert [r[0] for r in ndjson(twice.result.facts).collect()] == want


def test_cli_options(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.css").write_text(".a { color: #FFF; }")
    (tmp_path / "b.css").write_text(".b { color: red; }")
    (tmp_path / "tw.config").write_text("1")
    out, err, target = io.StringIO(), io.StringIO(), str(tmp_path / "out.json")
    assert cli.run(["extract", str(tmp_path), "--json", "--no-cache", "--exclude", "x/**", "--config", "tw.config", "-o", target, "--stats"], spark, out, err) == 0
    text = open(target).read().rstrip("\n")
    made = json.loads(text)
    assert json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == text and [f["file"] for f in made["facts"]] == ["b.css"]
    assert set(made["snapshot_header"]["config_hashes"]) == {"tw.config"} and "by kind" in err.getvalue() and out.getvalue() == ""
    for note in ("0 cached", "1 cached"):
        err = io.StringIO()
        assert cli.run(["extract", str(tmp_path), "--include", "x/*.css", "--pretty"], spark, out, err) == 0 and note in err.getvalue()
    assert json.loads(out.getvalue().split("}\n{")[0] + "}")["facts"][0]["value"]["norm"] == "#ffffff"


def test_upsert_order_and_lists(spark):
    facts = extract(rows(spark, {"a.css": ".a { color: #FFF; top: 2px }"})).facts
    runs = facts.withColumn("run", F.lit(1)).union(facts.withColumn("producer_v", F.lit("a")).withColumn("run", F.lit(2)))
    assert {r.producer_v for r in upsert(runs, order="run").collect()} == {"a"}
    allowed = spark.createDataFrame([("#ffffff",)], "norm string")
    assert [r.value.norm for r in listed(facts, allowed, "value.norm").collect()] == ["#ffffff"]
    assert [r.value.norm for r in listed(facts, allowed, "value.norm", inside=False).collect()] == ["2px"]
    policy = Policy("many", "SELECT kind, count(*) AS fact_id FROM facts GROUP BY kind HAVING count(*) > 1")
    assert run_policy(facts, policy).count() == 1 and condition(policy) is None
    assert scores(facts, PolicySet("x", policies=(*STANDARD.policies, policy))).where("policy = 'many'").first().violations == 1
    assert not spark.catalog.tableExists("facts")


def test_registered_extractors_run_on_workers(spark):
    def words(parsed, ctx):
        for d in parsed:
            ctx.emit("css.class", "tailwind", ctx.loc(d), token=d.prop, raw=d.prop, typed_as="class")

    register("words", "sheet", words)
    got = extract(rows(spark, {"a.css": ".a { color: #FFF }"}), Options(extractors=("words", "css"))).facts.collect()
    assert {r.kind for r in got} == {"css.class", "css.declaration"}
    with pytest.raises(ValueError):
        extract(rows(spark, {"a.css": ""}), Options(extractors=("none",)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_split_is_parsed_by_many_tasks(spark):
    files = rows(spark, {f"{i}.css": "a { color: red }" for i in range(64)}).coalesce(1)
    assert extract(files).facts.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_numbering_parses_once(spark):
    placed = numbered(extract(rows(spark, APP)).facts).select("fact_id", "place")
    wanted = [r.fact_id for r in sort_facts(extract(rows(spark, APP)).facts).select("fact_id").collect()]
    assert [r.fact_id for r in sorted(placed.collect(), key=lambda r: r.place)] == wanted
    assert plan_of(placed).count("MapInArrow") == 1


def test_sarif_looks_at_conditions_before_ids(spark):
    facts = extract(rows(spark, APP)).facts
    found = sarif_results(facts)
    assert found.count() == sum(run_policy(facts, p).count() for p in STANDARD.policies)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("sha2(") :]  # plans are printed from the last step to the first
    assert "Filter" in below[: below.index("Generate explode")]


def test_element_rows_read_a_token_once(spark):
    """The parts of a class token are taken from one text, whatever its brackets."""
    tokens = spark.createDataFrame([("md:px-[2px]",), ("[&_[data-x]]:-mt-[a:b]",), ("p-2",)], "t string").select(parse_token(F.col("t")).alias("x"))
    assert [tuple(r.x) for r in tokens.collect()] == [("px", "px", "2px", True), ("-mt", "mt", "a:b", True), ("p", "p-2", None, False)]
    assert tokens._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_json_escapes_are_sought_once(spark):
    odd = ".a { content: '\x0b\x1f\\\\u000B'; color: #FFF }"
    facts = extract(rows(spark, {"a.css": odd, **APP})).facts
    lines = facts.select(fact_json().alias("value"))
    made = [json.loads(r.value) for r in lines.collect()]
    assert all(r.value == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r, m in zip(lines.collect(), made))
    assert "\x0b\x1f\\\\u000B" in next(m["value"]["raw"] for m in made if m["file"] == "a.css")
    assert sorted(map(str, facts_from_json(lines).collect())) == sorted(map(str, facts.collect()))
    read = facts_from_json(lines.sparkSession.createDataFrame(lines.collect(), "value string")).select(fact_json().alias("value"))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("u000B, ") == 1


def test_schema_and_registry(spark):
    assert [c["name"] for c in schema.column_manifest()] == "fact_id kind schema_v file line col endLine endCol source producer_v certainty diagnostic raw norm value_type".split()
    assert set(schema.json_schema()["$defs"]) == set(schema.KINDS)
    register("boom", "sheet", lambda parsed, ctx: 1 / 0)
    assert extract_file("a.css", "", Options(extractors=("boom",)))[0]["reason"] == "plugin-error"


def test_streaming(spark, tmp_path):
    from tessera.streaming.files import FactTable, stream_facts

    path = str(tmp_path / "in")
    rows(spark, {"a.css": ".a { color: red }"}).select("path", "code").write.parquet(path)
    facts = FactTable(spark, str(tmp_path / "facts"))
    stream_facts(spark.readStream.schema("path string, code string").parquet(path), facts, str(tmp_path / "ck")).awaitTermination()
    assert facts.read().count() == 1
    again = FactTable(spark, str(tmp_path / "facts"))  # as after a restart
    assert again.read().count() == 1
    again.merge(extract(rows(spark, {"b.css": ".b { top: 1px }"})).facts)
    assert FactTable(spark, str(tmp_path / "facts")).read().count() == 2
