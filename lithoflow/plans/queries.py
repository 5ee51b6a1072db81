"""Queries that show each operator on relational tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.functions import fields, first_number, has_suffix, parse_double, stem_first, stem_last, without
from lithoflow.operators.columns import composite_key, quantised, scalar_columns, to_wide
from lithoflow.operators.gather import trace_gather
from lithoflow.operators.knn import knn_join
from lithoflow.operators.presence import distinct_sorted, first_wins, last_wins, lookup, not_in, presence_matrix, present_in_all, prevalence
from lithoflow.plans import files
from lithoflow.plans.wells import inline_table, well_of
from lithoflow.sources.deviation import header_names, table_widths
from lithoflow.sources.las import section

#: Fixed values of the generated tables.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _customer_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")


def q_presence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return presence_matrix(_t(spark, sf, "customer"), _customer_facts(spark, sf), "c_custkey", "o_orderpriority", PRIORITIES)


def q_presence_sparse(spark: SparkSession, sf: str) -> DataFrame:
    facts = _t(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality_"), F.col("quality").cast("string")).alias("label"))
    return presence_matrix(_t(spark, sf, "documents"), facts, "doc_id", "label", ["quality_0", "quality_1"])


def q_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return prevalence(_t(spark, sf, "customer"), _customer_facts(spark, sf), "c_custkey", "o_orderpriority")


def q_division_all(spark: SparkSession, sf: str) -> DataFrame:
    return present_in_all(_customer_facts(spark, sf), "c_custkey", "o_orderpriority", PRIORITIES)


def q_left_anti(spark: SparkSession, sf: str) -> DataFrame:
    return not_in(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), "doc_id")


def q_distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_sorted(_t(spark, sf, "part"), "p_brand", "p_type")


def q_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return first_wins(_t(spark, sf, "documents"), ["lang"], ["doc_id"], ["source"])


def q_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return last_wins(_t(spark, sf, "conversations").where(F.col("role") == "user"), ["conv_id"], "turn", "text")


def _plane(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("TraceIdx"), F.get("embedding", 0).cast("double").alias("X"), F.get("embedding", 1).cast("double").alias("Y"), "label")


def q_knn(spark: SparkSession, sf: str) -> DataFrame:
    plane = _plane(spark, sf)
    points = plane.select(F.col("TraceIdx").alias("pt"), (F.col("X") + 0.001).alias("x0"), F.col("Y").alias("y0"))
    return knn_join(points, plane, 9).select(F.col("pt").cast("bigint").alias("pt"), F.col("rank").cast("bigint").alias("rank"), F.col("TraceIdx").alias("vec_id"))


def q_knn_union(spark: SparkSession, sf: str) -> DataFrame:
    return q_knn(spark, sf).select("vec_id").distinct()


def q_trace_gather(spark: SparkSession, sf: str) -> DataFrame:
    volume = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("TraceIdx"), F.col("embedding").alias("samples"))
    cube = trace_gather(q_knn_union(spark, sf).select(F.col("vec_id").alias("TraceIdx")), volume)
    return to_wide(cube, "samples", 64, ["TraceIdx"])


def q_wide_samples(spark: SparkSession, sf: str) -> DataFrame:
    return to_wide(_t(spark, sf, "embeddings"), "embedding", 64, ["vec_id"])


def q_scalar_columns(spark: SparkSession, sf: str) -> DataFrame:
    return scalar_columns(_t(spark, sf, "embeddings"))


def q_first_number(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", first_number("text").alias("number"))


def _document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as tables of lines, as files are read."""
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def q_header_line(spark: SparkSession, sf: str) -> DataFrame:
    return header_names(_document_lines(spark, sf), ["doc_id"]).select("doc_id", F.array_join("names", " ").alias("header"))


def q_ws_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.size(F.filter(fields("text"), lambda w: w != "")).cast("bigint").alias("n_tokens"))


def q_ragged_width(spark: SparkSession, sf: str) -> DataFrame:
    widths = table_widths(_document_lines(spark, sf), ["doc_id"])
    found = widths.select("doc_id", F.size("names").cast("bigint").alias("header_width"), F.col("widest").cast("bigint").alias("widest"))
    return found.withColumn("fits", F.col("header_width") == F.col("widest"))


def q_section_scan(spark: SparkSession, sf: str) -> DataFrame:
    role = F.col("role")
    return section(_t(spark, sf, "conversations"), role == "system", role.isin("system", "assistant"), ["conv_id"], "turn").select("conv_id", "turn", "role")


def q_stem_suffix(spark: SparkSession, sf: str) -> DataFrame:
    name = F.substring_index("url", "/", -1)
    pages = _t(spark, sf, "pages").select("page_id", name.alias("name"))
    return pages.select("page_id", "name", stem_first("name").alias("first"), stem_last("name").alias("last"), has_suffix("name", ".HTML", True).alias("is_html"))


def q_parse_skip(spark: SparkSession, sf: str) -> DataFrame:
    token = F.regexp_extract("props", r'"[^"]*"\s*:\s*"?([-+0-9.eE]+)"?', 1)
    return _t(spark, sf, "events").select("event_id", parse_double(token).alias("number")).where(F.col("number").isNotNull())


def q_inline_table(spark: SparkSession, sf: str) -> DataFrame:
    wanted = inline_table(spark, [("ASIA",), ("EUROPE",)], "r_name string")
    return wanted.join(_t(spark, sf, "region"), "r_name").select(F.col("ord").cast("bigint").alias("ord"), "r_name", F.col("r_regionkey").cast("bigint").alias("r_regionkey"))


def q_float32_cast(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", quantised("l_extendedprice").alias("price"))


def q_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(composite_key("r_name", "n_name").alias("key"))


def q_dict_default(spark: SparkSession, sf: str) -> DataFrame:
    labels = _t(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return lookup(_t(spark, sf, "documents").select("doc_id"), labels, "doc_id", ["quality"])


def q_strip_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", without("url", ".html").alias("name"), well_of(F.concat(F.lit("w"), F.col("page_id").cast("string"), F.lit("_traces.csv"))).alias("well"))


_CUSTOMER = "(SELECT DISTINCT o_custkey AS c_custkey, o_orderpriority FROM orders)"
_PLANE = "(SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_KNN = f"""
  SELECT pt, rank, vec_id FROM (
    SELECT p.vec_id AS pt, t.vec_id AS vec_id,
           row_number() OVER (PARTITION BY p.vec_id ORDER BY
             (t.x - (p.x + 0.001)) * (t.x - (p.x + 0.001)) + (t.y - p.y) * (t.y - p.y), t.vec_id) AS rank
    FROM {_PLANE} p, {_PLANE} t)
  WHERE rank <= 9"""
_SPACES = r"'\s+'"
_MARKS = ", ".join(f"""CAST(coalesce(max(CASE WHEN f.o_orderpriority = '{p}' THEN 1 ELSE 0 END), 0) AS INTEGER) AS "{p}\"""" for p in PRIORITIES)

SQL = {
    "presence_matrix": f"SELECT c.c_custkey, {_MARKS} FROM customer c LEFT JOIN {_CUSTOMER} f ON f.c_custkey = c.c_custkey GROUP BY c.c_custkey",
    "presence_sparse": """SELECT d.doc_id, CAST(max(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS INTEGER) AS quality_0,
        CAST(max(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS INTEGER) AS quality_1
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id""",
    "prevalence": f"SELECT o_orderpriority, (SELECT count(*) FROM customer) AS total_rows, count(*) AS ones FROM {_CUSTOMER} WHERE c_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_orderpriority",
    "division_all": f"SELECT c_custkey FROM {_CUSTOMER} WHERE o_orderpriority IN ({', '.join(f"'{p}'" for p in PRIORITIES)}) GROUP BY c_custkey HAVING count(DISTINCT o_orderpriority) = 5",
    "left_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "distinct_sorted": "SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2",
    "first_wins": "SELECT lang, arg_min(source, doc_id) AS source FROM documents GROUP BY lang",
    "last_wins": "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "knn": _KNN,
    "knn_union": f"SELECT DISTINCT vec_id FROM ({_KNN})",
    "trace_gather": f"SELECT k.vec_id AS \"TraceIdx\", {', '.join(f'e.embedding[{i + 1}] AS \"S{i}\"' for i in range(64))} FROM (SELECT DISTINCT vec_id FROM ({_KNN})) k JOIN embeddings e ON e.vec_id = k.vec_id",
    "wide_samples": f"SELECT vec_id, {', '.join(f'embedding[{i + 1}] AS \"S{i}\"' for i in range(64))} FROM embeddings",
    "scalar_columns": "SELECT vec_id, label FROM embeddings",
    "first_number": r"SELECT doc_id, CAST(nullif(regexp_extract(text, '[-+]?\d*\.\d+|\d+'), '') AS DOUBLE) AS number FROM documents",
    "header_line": f"""WITH h AS (SELECT doc_id, string_split(text, chr(10))[2] AS line FROM documents WHERE len(string_split(text, chr(10))) > 1)
        SELECT doc_id, array_to_string(regexp_split_to_array(trim(regexp_replace(line, '^#+', ''), ' ' || chr(9) || chr(13)), {_SPACES}), ' ') AS header FROM h""",
    "ws_tokens": f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, {_SPACES}), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents",
    "ragged_width": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), w AS (
        SELECT doc_id, CAST(len(regexp_split_to_array(trim(regexp_replace(lines[2], '^#+', ''), ' ' || chr(9) || chr(13)), {_SPACES})) AS BIGINT) AS header_width,
               CAST(list_max(list_transform(list_filter(lines[3:], lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''), lambda x: len(regexp_split_to_array(trim(x, ' ' || chr(9) || chr(13)), {_SPACES})))) AS BIGINT) AS widest
        FROM l WHERE len(lines) > 1)
        SELECT doc_id, header_width, widest, header_width = widest AS fits FROM w WHERE widest IS NOT NULL""",
    "section_scan": """WITH s AS (SELECT *, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS s FROM conversations),
        e AS (SELECT *, min(CASE WHEN role = 'assistant' AND turn > s THEN turn END) OVER (PARTITION BY conv_id) AS e FROM s)
        SELECT conv_id, turn, role FROM e WHERE turn > s AND (turn < e OR e IS NULL) AND role IS DISTINCT FROM 'system'""",
    "stem_suffix": r"""WITH n AS (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages)
        SELECT page_id, name, string_split(name, '.')[1] AS first, regexp_replace(name, '^(\.*[^.].*)\.[^.]*$', '\1') AS last,
               lower(name) LIKE '%.html' AS is_html FROM n""",
    "parse_skip": r"""SELECT event_id, TRY_CAST(regexp_extract(props, '"[^"]*"\s*:\s*"?([-+0-9.eE]+)"?', 1) AS DOUBLE) AS number FROM events
        WHERE TRY_CAST(regexp_extract(props, '"[^"]*"\s*:\s*"?([-+0-9.eE]+)"?', 1) AS DOUBLE) IS NOT NULL""",
    "inline_table": "SELECT CAST(v.ord AS BIGINT) AS ord, v.r_name, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM (VALUES ('ASIA', 0), ('EUROPE', 1)) v(r_name, ord) JOIN region r ON r.r_name = v.r_name",
    "float32_cast": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price FROM lineitem",
    "composite_key": "SELECT concat_ws('_', r_name, n_name) AS key FROM nation JOIN region ON n_regionkey = r_regionkey",
    "strip_suffix": "SELECT page_id, replace(url, '.html', '') AS name, 'w' || page_id AS well FROM pages",
    "dict_default": "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[f"q_{name}"] for name in SQL} | files.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | files.oracle_sql()
