"""Source text made from table columns: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW = """import {{ Tile }} from '@north/kit';
import styled from 'styled-components';
const INK = '#2E5AAC';
const Box = styled.div`color: #A1B2C3; width: {n}px;`;
const kinds = cva('p-2');
export function View() {{
  return <Tile size={{{n}}} className="m-[{n}px] flex"><div style={{{{ color: INK, width: {n} }}}} /></Tile>;
}}
"""
SHEET = """.c{k} {{
  color: RGB({s}, 0, 0);
  padding: {s}.0PX;
}}
@media (min-width: {s}px) {{
  .d {{ margin: 0 }}
}}
"""

REVIEW = """import styled from 'styled-components';
const Bar = styled.div`height: ${{p => p.h}}px; width: {n}px; color: inherit;`;
export const View = ({{ x }}) => <div style={{{{ top: x, left: {n} }}}} />;
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(template: str, **columns):
    """The template with {name} replaced by columns."""
    parts, rest = [], template.format(**{k: f"\0{k}\0" for k in columns})
    for i, piece in enumerate(rest.split("\0")):
        parts.append(F.lit(piece) if i % 2 == 0 else columns[piece].cast("string"))
    return F.concat(*parts)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component file a customer."""
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("v/"), F.col("c_custkey").cast("string"), F.lit(".tsx")).alias("path"), _filled(VIEW, n=n).alias("code")
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stylesheet a part."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("s/"), F.col("p_partkey").cast("string"), F.lit(".css")).alias("path"),
        _filled(SHEET, k=F.col("p_partkey"), s=F.col("p_size")).alias("code"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component file a customer, with values that a reader must look at."""
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("w/"), F.col("c_custkey").cast("string"), F.lit(".tsx")).alias("path"), _filled(REVIEW, n=n).alias("code"))


def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style elements of web pages as stylesheets."""
    css = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<style[^>]*>(.*?)</style>"), 1), "\n")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".css")).alias("path"), css.alias("code"))


_ID = """sha256('{"file":"' || file || '","kind":"' || kind || '","loc":{"col":' || col || ',"endCol":' || "endCol" || ',"endLine":' || "endLine" || ',"line":' || line || '},"norm":' || coalesce('"' || norm || '"', 'null') || ',"subject":' || subject || '}')"""
#: Expected facts as SQL over the columns that the text was made from.
VIEW_FACTS = f"""
c AS (SELECT 'v/' || c_custkey || '.tsx' AS file, CAST(c_nationkey AS VARCHAR) AS n, CAST(length(CAST(c_nationkey AS VARCHAR)) AS INTEGER) AS w FROM customer),
e AS (SELECT *,
  sha256('{{"file":"' || file || '","kind":"jsx.element","loc":{{"col":9,"endCol":' || (47 + 2 * w) || ',"endLine":7,"line":7}},"norm":null,"subject":{{"imported_from":"@north/kit","is_dom":false,"name":"Tile"}}}}') AS card,
  sha256('{{"file":"' || file || '","kind":"jsx.element","loc":{{"col":' || (47 + 2 * w) || ',"endCol":' || (86 + 3 * w) || ',"endLine":7,"line":7}},"norm":null,"subject":{{"imported_from":null,"is_dom":true,"name":"div"}}}}') AS div FROM c),
raw AS (
  SELECT 'import' AS kind, file, 1 AS line, 9 AS col, 1 AS "endLine", 13 AS "endCol", 'babel-jsx' AS source, 'literal' AS certainty, NULL AS diagnostic, '@north/kit' AS raw, '@north/kit' AS norm, 'module' AS value_type, '{{"import_kind":"named","local":"Tile","specifier":"@north/kit"}}' AS subject FROM e
  UNION ALL SELECT 'import', file, 2, 7, 2, 13, 'babel-jsx', 'literal', NULL, 'styled-components', 'styled-components', 'module', '{{"import_kind":"default","local":"styled","specifier":"styled-components"}}' FROM e
  UNION ALL SELECT 'css.declaration', file, 4, 12, 4, 50 + w, 'css-in-js', 'literal', NULL, '#A1B2C3', '#a1b2c3', 'color', '{{"element_id":null,"media":null,"owner_component":"Box","property":"color","selector":null}}' FROM e
  UNION ALL SELECT 'css.declaration', file, 4, 12, 4, 50 + w, 'css-in-js', 'literal', NULL, n || 'px', n || 'px', 'length', '{{"element_id":null,"media":null,"owner_component":"Box","property":"width","selector":null}}' FROM e
  UNION ALL SELECT 'css.class', file, 5, 14, 5, 24, 'tailwind', 'static-union', NULL, 'p-2', 'p-2', 'keyword', '{{"element_id":null,"is_arbitrary":false,"token":"p-2","utility":"p"}}' FROM e
  UNION ALL SELECT 'jsx.element', file, 7, 9, 7, 47 + 2 * w, 'babel-jsx', 'literal', NULL, NULL, NULL, NULL, '{{"imported_from":"@north/kit","is_dom":false,"name":"Tile"}}' FROM e
  UNION ALL SELECT 'jsx.element', file, 7, 47 + 2 * w, 7, 86 + 3 * w, 'babel-jsx', 'literal', NULL, NULL, NULL, NULL, '{{"imported_from":null,"is_dom":true,"name":"div"}}' FROM e
  UNION ALL SELECT 'jsx.prop', file, 7, 15, 7, 22 + w, 'babel-jsx', 'literal', NULL, n, n, 'number', '{{"component":"Tile","element_id":"' || card || '","prop":"size"}}' FROM e
  UNION ALL SELECT 'jsx.prop', file, 7, 23 + w, 7, 46 + 2 * w, 'babel-jsx', 'literal', NULL, 'm-[' || n || 'px] flex', 'm-[' || n || 'px] flex', 'string', '{{"component":"Tile","element_id":"' || card || '","prop":"className"}}' FROM e
  UNION ALL SELECT 'css.class', file, 7, 33 + w, 7, 46 + 2 * w, 'tailwind', 'literal', NULL, n || 'px', n || 'px', 'length', '{{"element_id":"' || card || '","is_arbitrary":true,"token":"m-[' || n || 'px]","utility":"m"}}' FROM e
  UNION ALL SELECT 'css.class', file, 7, 33 + w, 7, 46 + 2 * w, 'tailwind', 'literal', NULL, 'flex', 'flex', 'keyword', '{{"element_id":"' || card || '","is_arbitrary":false,"token":"flex","utility":"flex"}}' FROM e
  UNION ALL SELECT 'css.declaration', file, 7, 33 + w, 7, 46 + 2 * w, 'tailwind', 'literal', NULL, n || 'px', n || 'px', 'length', '{{"element_id":"' || card || '","media":null,"owner_component":null,"property":"margin","selector":null}}' FROM e
  UNION ALL SELECT 'jsx.attribute', file, 7, 52 + 2 * w, 7, 83 + 3 * w, 'babel-jsx', 'dynamic', 'unsupported-node:ObjectExpression', '{{ color: INK, width: ' || n || ' }}', NULL, 'dynamic', '{{"attribute":"style","element_id":"' || div || '","owner":"div"}}' FROM e
  UNION ALL SELECT 'css.declaration', file, 7, 61 + 2 * w, 7, 71 + 2 * w, 'inline', 'literal', NULL, '#2E5AAC', '#2e5aac', 'color', '{{"element_id":"' || div || '","media":null,"owner_component":"div","property":"color","selector":null}}' FROM e
  UNION ALL SELECT 'css.declaration', file, 7, 73 + 2 * w, 7, 80 + 3 * w, 'inline', 'literal', NULL, n, n || 'px', 'length', '{{"element_id":"' || div || '","media":null,"owner_component":"div","property":"width","selector":null}}' FROM e
),
facts AS (SELECT *, {_ID} AS fact_id FROM raw)
"""
SHEET_FACTS = f"""
c AS (SELECT 's/' || p_partkey || '.css' AS file, '.c' || p_partkey AS sel, p_size AS z, CAST(p_size AS VARCHAR) AS s, CAST(length(CAST(p_size AS VARCHAR)) AS INTEGER) AS w FROM part),
raw AS (
  SELECT 'css.declaration' AS kind, file, 2 AS line, 2 AS col, 2 AS "endLine", 21 + w AS "endCol", 'plain-css' AS source, 'literal' AS certainty, NULL AS diagnostic, 'RGB(' || s || ', 0, 0)' AS raw, '#' || lower(printf('%02x', z)) || '0000' AS norm, 'color' AS value_type, '{{"element_id":null,"media":null,"owner_component":null,"property":"color","selector":"' || sel || '"}}' AS subject FROM c
  UNION ALL SELECT 'css.declaration', file, 3, 2, 3, 16 + w, 'plain-css', 'literal', NULL, s || '.0PX', s || 'px', 'length', '{{"element_id":null,"media":null,"owner_component":null,"property":"padding","selector":"' || sel || '"}}' FROM c
  UNION ALL SELECT 'css.declaration', file, 6, 7, 6, 16, 'plain-css', 'literal', NULL, '0', '0', 'number', '{{"element_id":null,"media":"(min-width: ' || s || 'px)","owner_component":null,"property":"margin","selector":".d"}}' FROM c
),
facts AS (SELECT *, {_ID} AS fact_id FROM raw)
"""
