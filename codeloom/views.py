"""Code-graph views over the star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

LANGUAGE_OF = "CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.ts' WHEN 'fr' THEN '.go' WHEN 'es' THEN '.rs' ELSE '.txt' END"
PATH = f"source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || {LANGUAGE_OF}"


def view_sql(duck: bool) -> dict[str, str]:
    """View name to SELECT; the dialects differ in two function names."""
    octets = (lambda x: f"strlen({x})") if duck else (lambda x: f"octet_length({x})")
    sha = (lambda x: f"sha256({x})") if duck else (lambda x: f"sha2({x}, 256)")
    ref = "'ref_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING)"
    kind = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'calls' WHEN 'AO' THEN 'imports' WHEN 'NF' THEN 'inherits' WHEN 'NO' THEN 'implements' WHEN 'RF' THEN 'type_ref' ELSE 'read' END"
    file = "'supp' || CAST(l_suppkey AS STRING) || '.py'"
    return {
        "v_files": f"""SELECT doc_id, {PATH} AS file_path, text AS content, CAST({octets('text')} AS BIGINT) AS size, lang FROM {{documents}}""",
        "v_manifest": f"""SELECT {PATH} AS file_path, lang AS language, CAST(doc_id AS DOUBLE) AS mtime, CAST({octets('text')} AS BIGINT) AS size,
            CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 5 = 0 THEN 'warn' ELSE 'ok' END AS parse_status FROM {{documents}}""",
        "v_symbols": """SELECT file_path || ':' || name || ':' || kind || ':' || CAST(start_line AS STRING) AS symbol_id, * FROM (
            SELECT replace(p_name, ' ', '_') AS name,
              CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'LARGE' THEN 'class' WHEN 'MEDIUM' THEN 'method' WHEN 'PROMO' THEN 'interface' WHEN 'SMALL' THEN 'type_alias' ELSE 'enum' END AS kind,
              replace(p_brand, '#', '_') || '/' || p_type || '/part_' || CAST(p_partkey AS STRING) || '.py' AS file_path,
              p_size AS start_line, CAST(p_size + p_partkey % 40 AS INT) AS end_line, 'def ' || replace(p_name, ' ', '_') || ' ( a ,  b )' AS signature, 'python' AS language,
              CASE WHEN p_partkey % 3 = 0 THEN 'pkg.mod' ELSE '' END AS module_path, CASE WHEN p_type = 'MEDIUM' THEN 'C' || CAST(p_size AS STRING) END AS container_name,
              CASE WHEN p_partkey % 2 = 0 THEN 'Doc of ' || p_name END AS docstring, p_partkey FROM {part}) AS s""",
        "v_edges": f"""SELECT {sha("concat_ws('|', kind, file_path, CAST(start_line AS STRING), CAST(column AS STRING), ref_text, source_symbol_id)")} AS edge_id, * FROM (
            SELECT 'order:' || CAST(l_orderkey AS STRING) AS source_symbol_id, CASE WHEN l_partkey % 7 <> 0 THEN 'part:' || CAST(l_partkey AS STRING) END AS target_symbol_id,
              {kind} AS kind, {file} AS file_path, l_linenumber AS start_line, l_linenumber AS end_line, CAST(l_quantity AS INT) AS column, {ref} AS ref_text FROM {{lineitem}}) AS e""".replace("AS column", "AS `column`" if not duck else 'AS "column"').replace("CAST(column", "CAST(`column`" if not duck else 'CAST("column"'),
        "v_part_edges": f"""SELECT e.edge_id, e.source_symbol_id, e.target_symbol_id, e.kind, replace(p_brand, '#', '_') || '/' || p_type || '/part_' || CAST(p_partkey AS STRING) || '.py' AS file_path, e.start_line, e.ref_text
            FROM {{v_edges}} AS e JOIN {{part}} AS p ON e.target_symbol_id = 'part:' || CAST(p_partkey AS STRING)""",
        "v_edge_manifest": """SELECT 'supp' || CAST(s_suppkey AS STRING) || '.py' AS file_path, 'python' AS language, CAST(s_suppkey AS DOUBLE) AS mtime,
            CAST(abs(round(s_acctbal * 100)) AS BIGINT) AS size, 'ok' AS parse_status FROM {supplier} WHERE s_suppkey % 11 <> 0""",
        "v_inherits": """SELECT 'customer:' || CAST(c_custkey AS STRING) AS source_symbol_id, 'nation:' || CAST(c_nationkey AS STRING) AS target_symbol_id FROM {customer}
            UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 'region:' || CAST(n_regionkey AS STRING) FROM {nation}""",
        "v_calls": """SELECT 'u' || CAST(user_id AS STRING) AS session_id, event_type AS tool, CAST(ceil(value * 100) AS BIGINT) AS naive_tokens,
            CAST(event_id % 97 * 40 AS BIGINT) AS actual_tokens, ts, event_id FROM {events}""",
    }


TABLES = ("documents", "part", "lineitem", "supplier", "customer", "nation", "events", "embeddings", "pages", "orders")


class Views:
    """The tables and views of a data directory as DataFrames; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = view_sql(False)[name]
        given = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **given | ({"v_edges": self.edges} if "{v_edges}" in text else {}))

    @cached_property
    def files(self):
        return self.view("v_files")

    @cached_property
    def manifest(self):
        return self.view("v_manifest")

    @cached_property
    def symbols(self):
        from pyspark.sql import functions as F

        from codeloom.functions import scalars as S

        s = self.view("v_symbols")
        key = S.symbol_key(F.col("module_path"), F.col("file_path"), F.col("container_name"), F.col("name"), F.col("kind"))
        s = s.withColumn("symbol_key", key)
        return s.withColumn("symbol_key_exact", S.symbol_key_exact(F.col("symbol_key"), F.col("signature")))

    @cached_property
    def edges(self):
        return self.view("v_edges")

    @cached_property
    def part_edges(self):
        """Edges as if each stood in the file of the part that it points at."""
        return self.view("v_part_edges")

    @cached_property
    def edge_manifest(self):
        return self.view("v_edge_manifest")

    @cached_property
    def inherits(self):
        return self.view("v_inherits")

    @cached_property
    def calls(self):
        return self.view("v_calls")


def duck(query: str, *names: str) -> str:
    """A DuckDB query over the named views."""
    texts = view_sql(True)
    views = ", ".join(f"{n} AS ({texts[n].format(**{t: t for t in (*TABLES, "v_edges")})})" for n in names)
    return f"WITH RECURSIVE {views} {query}" if "WITH RECURSIVE" not in query else query.replace("WITH RECURSIVE", f"WITH RECURSIVE {views}," , 1)
