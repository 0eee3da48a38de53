"""SQL policies over facts: bundles, scores, messages and SARIF."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    id: str
    sql: str
    level: str = "warning"
    guideline: str = ""
    message: str = ""
    help: str = ""


@dataclass(frozen=True)
class PolicySet:
    name: str
    version: str = "0"
    description: str = ""
    policies: tuple[Policy, ...] = field(default_factory=tuple)


#: The standard checks of a design system. Ids, levels and conditions.
STANDARD = PolicySet(
    "standard",
    "1",
    "Hard-coded values and inline styles",
    (
        Policy("hardcoded-color", "SELECT * FROM facts WHERE kind = 'css.declaration' AND value_type = 'color' AND certainty = 'literal'", "error", message="{property}: {raw}"),
        Policy("hardcoded-spacing", "SELECT * FROM facts WHERE kind = 'css.declaration' AND value_type = 'length' AND certainty = 'literal'", "warning", message="{property}: {raw}"),
        Policy("no-arbitrary-tailwind", "SELECT * FROM facts WHERE kind = 'css.class' AND is_arbitrary", "warning", message="{token}"),
        Policy("no-inline-style", "SELECT * FROM facts WHERE kind = 'css.declaration' AND source = 'inline'", "warning", message="{property}"),
        Policy("needs-review", "SELECT * FROM facts WHERE kind = 'css.declaration' AND certainty IN ('dynamic', 'unknown')", "note", message="{property}: {diagnostic}"),
    ),
)


def load_policies(text: str) -> PolicySet:
    """A bundle from its JSON text."""
    d = json.loads(text)
    known = Policy.__dataclass_fields__
    policies = tuple(Policy(**{k: v for k, v in p.items() if k in known}) for p in d.get("policies", []))
    return PolicySet(d.get("name", ""), d.get("version", "0"), d.get("description", ""), policies)


def facts_view(facts: DataFrame) -> DataFrame:
    """Flat columns and all subject fields, as policies see them."""
    subject = [F.col(f"subject.{c}").alias(c) for c in facts.schema["subject"].dataType.names]
    return facts.select(*_flat_columns(), "subject", *subject)


def _flat_columns() -> list[Column]:
    loc = [F.col(f"loc.{c}").alias(c) for c in ("line", "col", "endLine", "endCol")]
    value = [F.col("value.raw").alias("raw"), F.col("value.norm").alias("norm"), F.col("value.type").alias("value_type")]
    return [*map(F.col, ("fact_id", "kind", "schema_v", "file")), *loc, *map(F.col, ("source", "producer_v", "certainty", "diagnostic")), *value]


def translate(sql: str) -> str:
    """JSON path access in policy SQL as column access."""
    name = lambda m: m.group(1).replace("subject.", "").replace("value.type", "value_type").replace("value.", "").replace("loc.", "")
    sql = re.sub(r"json_extract\(\s*json\s*,\s*'\$\.([\w.]+)'\s*\)\s*=\s*1\b", name, sql)
    sql = re.sub(r"json_extract\(\s*json\s*,\s*'\$\.([\w.]+)'\s*\)", name, sql)
    sql = re.sub(r"json\s*->>\s*'\$\.([\w.]+)'", name, sql)
    return re.sub(r"\bjson\s*->>\s*'(\w+)'", name, sql)


def run_policy(facts: DataFrame, policy: Policy) -> DataFrame:
    """The violations of one policy: any SQL over a table called facts."""
    sql = translate(policy.sql).replace("{", "{{").replace("}", "}}")
    return facts.sparkSession.sql(re.sub(r"(?i)\b(from|join)\s+facts\b", r"\1 {facts}", sql), facts=facts_view(facts))


_CONDITION = re.compile(r"(?is)^\s*select\s+\*\s+from\s+facts\s+where\s+(.*?)[\s;]*$")
_MORE = re.compile(r"(?i)\b(?:select|group|order|having|limit|union|intersect|except|window|qualify|offset)\b")


def condition(policy: Policy) -> Column | None:
    """The policy as a condition on one fact, where it is no more than that."""
    found = _CONDITION.match(translate(policy.sql))
    return F.expr(found.group(1)) if found and not _MORE.search(re.sub(r"'(?:[^']|'')*'", "''", found.group(1))) else None


def _split(policies: PolicySet) -> tuple[list[tuple[Policy, Column]], list[Policy]]:
    both = [(p, condition(p)) for p in policies.policies]
    return [(p, c) for p, c in both if c is not None], [p for p, c in both if c is None]


def scores(facts: DataFrame, policies: PolicySet = STANDARD) -> DataFrame:
    """(policy, level, violations, score): 1 where nothing was found; notes don't score.

    Policies that are conditions are counted together in one pass; others run
    as queries of their own.
    """
    simple, other = _split(PolicySet(policies.name, policies=tuple(p for p in policies.policies if p.level != "note")))
    row = lambda p, n: F.struct(F.lit(p.id).alias("policy"), F.lit(p.level).alias("level"), n.alias("violations"), (n == 0).cast("int").alias("score"))
    parts = []
    if simple:
        counts = facts_view(facts).agg(*[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(simple)])
        parts.append(counts.select(F.inline(F.array(*[row(p, F.col(f"n{i}")) for i, (p, _) in enumerate(simple)]))))
    for p in other:
        parts.append(run_policy(facts, p).agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(row(p, F.col("n"))))))
    out = parts[0] if parts else facts.sparkSession.createDataFrame([], "policy string, level string, violations long, score int")
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def message(template: str, columns: list[str]) -> Column:
    """A template's text: {name} is a column, null or unknown ones are empty."""
    parts, at = [F.lit("")], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        if m.group(1) in columns:
            parts.append(F.coalesce(F.col(m.group(1)).cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def sarif_results(facts: DataFrame, policies: PolicySet = STANDARD) -> DataFrame:
    """One row a violation with its SARIF result as JSON; columns count from one.

    Each fact is tested for all policies that are conditions in one pass; only
    facts that one of them finds get ids and texts.
    """
    simple, other = _split(policies)

    def result(p: Policy, columns: list[str]) -> Column:
        place = F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn"), F.col("endLine"), (F.col("endCol") + 1).alias("endColumn"))
        made = F.struct(
            F.lit(p.id).alias("ruleId"),
            F.lit(p.level).alias("level"),
            F.struct(message(p.message, columns).alias("text")).alias("message"),
            F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), place.alias("region")).alias("physicalLocation"))).alias("locations"),
            F.struct(F.col("fact_id").alias("factId")).alias("partialFingerprints"),
        )
        return F.struct(F.lit(p.id).alias("policy"), F.to_json(made).alias("result"))

    parts = []
    if simple:
        view = facts_view(facts).where(reduce(or_, (c for _, c in simple)))
        found = F.array_compact(F.array(*[F.when(c, result(p, view.columns)) for p, c in simple]))
        parts.append(view.select("file", "line", "col", "fact_id", F.explode(found).alias("x")))
    for p in other:
        view = run_policy(facts, p)
        parts.append(view.select("file", "line", "col", "fact_id", result(p, view.columns).alias("x")))
    parts = [x.select("x.policy", "file", "line", "col", "fact_id", "x.result") for x in parts]
    out = parts[0] if parts else facts.sparkSession.createDataFrame([], "policy string, file string, line int, col int, fact_id string, result string")
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def sarif(facts: DataFrame, policies: PolicySet = STANDARD, tool: str = "tessera") -> dict:
    """A SARIF 2.1.0 log; the results are gathered on the driver."""
    rows = sarif_results(facts, policies).orderBy("policy", "file", "line", "col", "fact_id").toLocalIterator()
    rules = [{"id": p.id, "shortDescription": {"text": p.guideline or p.id}, "help": {"text": p.help}, "defaultConfiguration": {"level": p.level}} for p in policies.policies]
    return {
        "$schema": "https://json.schemastore.org/sarif-2.1.0.json",
        "version": "2.1.0",
        "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": [json.loads(r["result"]) for r in rows]}],
    }


def read_policies(spark: SparkSession, path: str) -> PolicySet:
    return load_policies("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
