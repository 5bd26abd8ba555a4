"""Queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.operators import nested
from granthika.plans import documents, retrieval, service
from granthika.sources.tables import table


# The keys that hold objects, each with a typed table; p6_fields has the fields of any other.
HELD = (
    "amended_by", "amounts", "authority", "claims", "conditions", "conflicts", "contact", "dates", "details", "documents", "edges", "entities", "error", "evidence_graph", "excerpts", "facts", "failed_files",
    "grounding", "metadata", "nodes", "parties", "plan", "primary_provision", "provision_analysis", "provisions", "related", "sources", "supported_by", "timeline",
)
CITATION = {"act_name": "string", "section": "string", "authority_score": "double", "section_title": "string", "is_verified": "boolean", "page": "int"}


def _chat(spark: SparkSession, d: str) -> DataFrame:
    return nested.json_objects(table(spark, d, "chat_messages"), "chat_messages", "id", "sources_json")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return nested.json_objects(table(spark, d, "case_history"), "case_history", "id", "data_json")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _chat(spark, d).unionAll(_cases(spark, d))


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    chat = nested.json_scalars(table(spark, d, "chat_messages"), "chat_messages", "id", "sources_json")
    return chat.unionAll(nested.json_scalars(table(spark, d, "case_history"), "case_history", "id", "data_json"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(_nodes(spark, d))


def p6_shapes(spark: SparkSession, d: str) -> DataFrame:
    return nested.shapes(_nodes(spark, d))


def p6_citations(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the citations of chat messages, in a list or alone, with every scalar key they have."""
    nodes = _chat(spark, d).where(F.col("kind").isin("$", "$[]"))
    return nested.subtype_table(nodes, None, CITATION | {k: t for k, t in nested.typed_columns(nodes).items() if k not in CITATION})


def p6_cases(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the outermost objects of case_history."""
    return nested.subtype_table(_cases(spark, d).where(F.col("kind").rlike(r"^\$(\[\])*$")), None)


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """The scalar fields of objects of every kind."""
    return nested.field_values(_scalars(spark, d))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The scalars in arrays, by position."""
    return nested.array_values(_scalars(spark, d))


def _held(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.subtype_table(_nodes(spark, d).where(nested.last_key(F.col("kind")) == key), None)

    run.__name__, run.__doc__ = f"p6_{key}", f"The typed table of the objects under `{key}`."
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p6_found, p6_shapes, p6_citations, p6_cases, p6_fields, p6_values, *map(_held, HELD))}
    return own | retrieval.queries() | documents.queries() | service.queries()


P6_FOUND = r"""
WITH raw AS (
  SELECT 'chat_messages' AS src, id AS row_id, sources_json AS j FROM chat_messages UNION ALL SELECT 'case_history', id, data_json FROM case_history),
once AS (SELECT src, row_id, CASE WHEN json_valid(j) THEN j END AS j FROM raw),
twice AS (SELECT src, row_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN j ->> '$' END ELSE j END AS j FROM once WHERE j IS NOT NULL),
tree AS (SELECT src, row_id, t.fullkey, t.path, t.type FROM twice, json_tree(twice.j) t WHERE twice.j IS NOT NULL)
SELECT src, row_id, replace(fullkey, '"', '') AS path,
  CASE WHEN regexp_matches(fullkey, '^\$(\[\d+\])*$') THEN '' ELSE replace(regexp_replace(fullkey, '\.[^.\[\]]+(\[\d+\])*$', ''), '"', '') END AS parent_path
FROM tree WHERE type = 'OBJECT'
"""


# Scalars of the same trees: type and text as JSON writes them, the array or object that holds them, and its nearest object.
_P6_SCALARS = P6_FOUND.split("SELECT src, row_id, replace(fullkey")[0].replace("t.fullkey, t.path, t.type FROM", "t.fullkey, t.path, t.type, t.key, t.atom FROM").rstrip() + r""",
s AS (SELECT src, row_id, replace(path, '"', '') AS holder, key, fullkey, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'NULL' THEN 'null' WHEN type = 'BOOLEAN' THEN 'bool' ELSE 'number' END AS state, CASE WHEN type <> 'NULL' THEN json_extract_string(atom, '$') END AS value
  FROM tree WHERE type NOT IN ('OBJECT', 'ARRAY') AND fullkey <> '$')
"""
P6_VALUES = _P6_SCALARS + r"""SELECT src, row_id, holder AS path,
  CASE WHEN regexp_matches(holder, '^\$(\[\d+\])*$') THEN '' ELSE regexp_replace(holder, '\.[^.\[\]]+(\[\d+\])*$', '') END AS parent_path, regexp_replace(holder, '\[\d+\]', '[]', 'g') AS kind,
  regexp_extract(fullkey, '\[(\d+)\]$', 1)::INT AS "index", state AS type, value FROM s WHERE regexp_matches(fullkey, '\]$')"""
P6_FIELDS = _P6_SCALARS + r"""SELECT src, row_id, holder AS path, regexp_replace(holder, '\[\d+\]', '[]', 'g') AS kind, key, state AS type,
  CASE WHEN state = 'string' THEN value END AS as_string, CASE WHEN state = 'number' THEN value::DOUBLE END AS as_number, CASE WHEN state = 'bool' THEN value::BOOLEAN END AS as_bool FROM s WHERE NOT regexp_matches(fullkey, '\]$')"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND, "p6_values": P6_VALUES, "p6_fields": P6_FIELDS} | retrieval.oracle_sql() | documents.oracle_sql() | service.oracle_sql()
