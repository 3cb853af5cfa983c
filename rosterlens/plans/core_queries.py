"""Queries on general data preparation: nested records and rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guarded_parse import FIELDS, guarded_parse
from ..operators.nested import child_table, json_elements, json_rejects
from ..sources.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """source_table, parent_key, text of all JSON there is."""
    bodies = table(spark, folder, "http_cache").filter(F.col("kind") == "json").select(F.lit("http_cache").alias("source_table"), F.col("url_hash").alias("parent_key"), F.col("body").alias("text"))
    held = table(spark, folder, "handle").select(F.lit("handle").alias("source_table"), F.col("handle_id").cast("string").alias("parent_key"), F.col("evidence").alias("text"))
    return bodies.unionByName(held).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return json_elements(_texts(spark, folder), "text", ["source_table", "parent_key"], values=False).select("source_table", "parent_key", "child_path")


def p6_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that are no complete JSON, which have no rows in p6_found, with the reason."""
    return json_rejects(_texts(spark, folder), "text", ["source_table", "parent_key"]).select("source_table", "parent_key", "reason")


def p6_evidence_table(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence records of handles as one flat table, linked to the handle: every element that holds any of these fields."""
    rows = json_elements(_texts(spark, folder).filter("source_table = 'handle'"), "text", ["parent_key"])
    names = {"tier": "$.tier", "source": "$.source", "source_url": "$.source_url", "authoritative": "$.authoritative", "observed_at": "$.observed_at"}
    return rows.select("parent_key", "child_path", "ordinal", *[F.get_json_object("value", p).alias(c) for c, p in names.items()]).filter(F.coalesce(*names).isNotNull())


def p6_relation_table(spark: SparkSession, folder: str) -> DataFrame:
    """The relations of cached artist answers, linked to the answer."""
    rows = json_elements(_texts(spark, folder).filter("source_table = 'http_cache'"), "text", ["parent_key"])
    return child_table(rows, "relations", {"type": "$.type", "resource": "$.url.resource"})


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return guarded_parse(table(spark, folder, "upload_line"), table(spark, folder, "parse_result"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).filter(F.col("reason").isin("quoting", "columns", "value")).select("line_id", "reason").distinct()


def p7_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).filter(F.col("reason").isNull()).select("line_id", "file_id", *FIELDS).distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p6_rejected, p6_evidence_table, p6_relation_table, p7_found, p7_loaded)}


_FIELD = {d: rf"""("(?:[^"]|"")*"|[^"{e}][^{e}]*|){e}""" for d, e in ((",", ","), (";", ";"), ("|", "[|]"), ("\t", "\t"))}


def _by_delimiter(make) -> str:
    plain = {",": ",", ";": ";", "|": "|", "\t": "\t"}
    return "CASE delimiter " + " ".join(f"WHEN '{d}' THEN {make(d, plain[d])}" for d in plain) + " END"


def _oracle_records() -> str:
    def cls(d: str) -> str:
        return "|" if d == "|" else d

    def lit(d: str) -> str:
        return "[|]" if d == "|" else d

    def strict(d: str, _: str) -> str:
        f = f"""(?:"(?:[^"]|"")*"|[^"{cls(d)}][^{cls(d)}]*)?"""
        return f"regexp_full_match(raw, '(?s){f}(?:{lit(d)}{f})*')"

    def fields(d: str, _: str) -> str:
        return f"""regexp_extract_all(raw || '{d}', '(?s)("(?:[^"]|"")*"|[^"{cls(d)}][^{cls(d)}]*|){lit(d)}', 1)"""

    return f"""
WITH f AS (SELECT DISTINCT file_id, delimiter, header, header_map FROM parse_result),
r AS (SELECT line_id, u.file_id, coalesce(raw_line, '') AS raw, delimiter, header,
        [header_map[h] for h in header] AS into_fields
      FROM (SELECT DISTINCT line_id, file_id, raw_line FROM upload_line) u JOIN f ON u.file_id = f.file_id),
s AS (SELECT *, {_by_delimiter(strict)} AS well FROM r),
p AS (SELECT *, CASE WHEN well THEN [CASE WHEN x[1:1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END for x in {_by_delimiter(fields)}] END AS fields FROM s),
v AS (SELECT *, {", ".join(f"CASE WHEN len(fields) = len(header) AND list_position(into_fields, '{c}') > 0 THEN trim(fields[list_position(into_fields, '{c}')], ' ') END AS v_{c}" for c in FIELDS)} FROM p),
d AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN len(fields) <> len(header) THEN 'columns'
   WHEN v_name = '' OR NOT regexp_full_match(v_row_id, '[0-9]+')
     OR (v_active_year <> '' AND NOT (regexp_full_match(v_active_year, '[0-9]{{4}}([.]0)?') AND coalesce(TRY_CAST(v_active_year[1:4] AS INT), 0) BETWEEN 1800 AND 2100)) THEN 'value' END AS reason FROM v)
"""


_TREE = """
WITH {each}
SELECT source_table, parent_key, child_path FROM (
  {union}
)"""


_CHILD_PATH = """regexp_replace(regexp_replace(replace(replace(regexp_replace({k}, '^[$][.]?', ''), '"', ''), '.', '/'), '[[]([0-9]+)[]]', '/\\1', 'g'), '^/', '')"""


def _tree(name: str, key: str, text: str, where: str) -> tuple[str, str]:
    """json_tree lists every value with its path; those of type OBJECT whose own step is a number are elements."""
    ctes = f"{name}_j AS (SELECT DISTINCT {key} AS parent_key, {text} AS j FROM {name} WHERE {where} AND json_valid({text}))"
    pick = f"""SELECT '{name}' AS source_table, parent_key, {_CHILD_PATH.format(k='t.fullkey')} AS child_path
  FROM {name}_j, json_tree(j) t WHERE t.type = 'OBJECT' AND t.fullkey LIKE '%]'"""
    return ctes, pick


def oracle_sql() -> dict[str, str]:
    a = _tree("http_cache", "url_hash", "body", "kind = 'json'")
    b = _tree("handle", "CAST(handle_id AS VARCHAR)", "evidence", "TRUE")
    evidence = f"""WITH h AS (SELECT DISTINCT CAST(handle_id AS VARCHAR) AS parent_key, evidence AS j FROM handle WHERE json_valid(evidence)),
t AS (SELECT parent_key, t.id, t.parent AS up, t.type, t.key, t.fullkey, t.value FROM h, json_tree(j) t),
e AS (SELECT * FROM t WHERE type = 'OBJECT' AND fullkey LIKE '%]' AND coalesce(value->>'$.tier', value->>'$.source', value->>'$.source_url', value->>'$.authoritative', value->>'$.observed_at') IS NOT NULL)
SELECT parent_key, {_CHILD_PATH.format(k='fullkey')} AS child_path, CAST(regexp_extract(fullkey, '[[]([0-9]+)[]]$', 1) AS INT) AS ordinal,
  value->>'$.tier' AS tier, value->>'$.source' AS source, value->>'$.source_url' AS source_url, value->>'$.authoritative' AS authoritative, value->>'$.observed_at' AS observed_at FROM e"""
    relations = f"""WITH h AS (SELECT DISTINCT url_hash AS parent_key, body AS j FROM http_cache WHERE kind = 'json' AND json_valid(body)),
t AS (SELECT parent_key, t.fullkey, t.value FROM h, json_tree(j) t WHERE t.type = 'OBJECT' AND regexp_matches(t.fullkey, '[.]"?relations"?([.][^.]+)?[[][0-9]+[]]$')),
e AS (SELECT *, regexp_extract(regexp_replace(fullkey, '[[][0-9]+[]]$', ''), '^(.*[]])', 1) AS owner FROM t)
SELECT parent_key, {_CHILD_PATH.format(k='fullkey')} AS child_path, nullif({_CHILD_PATH.format(k='owner')}, '') AS parent_path, CAST(regexp_extract(fullkey, '[[]([0-9]+)[]]$', 1) AS INT) AS ordinal,
  value->>'$.type' AS type, value->>'$.url.resource' AS resource FROM e"""
    rejected = """SELECT DISTINCT source_table, parent_key, CASE WHEN regexp_full_match(j, '[ \t\n\r]*') THEN 'empty' ELSE 'cut off' END AS reason FROM (
  SELECT 'http_cache' AS source_table, url_hash AS parent_key, body AS j FROM http_cache WHERE kind = 'json' UNION ALL SELECT 'handle', CAST(handle_id AS VARCHAR), evidence FROM handle) WHERE j IS NOT NULL AND NOT json_valid(j)"""
    return {
        "p6_evidence_table": evidence,
        "p6_relation_table": relations,
        "p6_rejected": rejected,
        "p6_found": _TREE.format(each=f"{a[0]}, {b[0]}", union=f"{a[1]} UNION ALL {b[1]}"),
        "p7_found": _oracle_records() + "SELECT line_id, reason FROM d WHERE reason IS NOT NULL",
        "p7_loaded": _oracle_records() + f"SELECT line_id, file_id, {', '.join(f'v_{c} AS {c}' for c in FIELDS)} FROM d WHERE reason IS NULL",
    }
