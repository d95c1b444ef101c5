"""Symbol and edge queries: filters first, then a total order, then the page.

An argument that is None or empty is no predicate. Each answer is a DataFrame; ``page`` probes one row
beyond the page so that the caller knows whether to hand out a cursor.
"""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.lineage import cut
from codeloom.schemas import EDGE_KINDS, EDGE_ORDER, PAGE, SYMBOL_KINDS, SYMBOL_ORDER

SYMBOL_COLUMNS = ["symbol_id", "name", "kind", "file_path", "start_line", "end_line", "signature", "symbol_key", "container_name", "module_path"]


class InvalidArguments(ValueError):
    """A query argument outside its domain."""


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def equal(column: str, value) -> Column | None:
    return F.col(column) == F.lit(value) if value or value is False else None


def kind_of(value: str | None, allowed: tuple[str, ...]) -> str | None:
    if value and value not in allowed:
        raise InvalidArguments(f"unknown kind {value!r}")
    return value


def encode_cursor(offset: int, at: tuple[int, int, int] | None = None) -> str:
    """at: the same place as a generation of a store, a bucket, and how many of its rows come before."""
    return base64.b64encode(json.dumps({"offset": offset} | ({"at": at} if at else {})).encode()).decode()


def decode_cursor(cursor: str | None) -> int:
    """Any malformed cursor is the first page."""
    try:
        return max(0, int(json.loads(base64.b64decode(cursor or ""))["offset"]))
    except (ValueError, KeyError, TypeError):
        return 0


def cursor_place(cursor: str | None) -> tuple[int, int, int] | None:
    """What ``encode_cursor`` was given as ``at``; None if nothing, or if malformed."""
    try:
        generation, bucket, skip = map(int, json.loads(base64.b64decode(cursor or ""))["at"])
        return (generation, bucket, skip) if skip >= 0 else None
    except (ValueError, KeyError, TypeError):
        return None


def cursor_column(offset: Column) -> Column:
    """The same cursor as an expression."""
    return F.base64(F.encode(F.concat(F.lit('{"offset": '), offset.cast("string"), F.lit("}")), "UTF-8"))


def page(df: DataFrame, order: tuple[str, ...], limit: int, cursor: str | None = None, probe: bool = False) -> DataFrame:
    rows = df.orderBy(*order)
    offset = decode_cursor(cursor)
    return (rows.offset(offset) if offset else rows).limit(limit + probe)


def paged(df: DataFrame, limit: int, cursor: str | None = None) -> tuple[list, str | None]:
    """Rows of a probing page, and the next cursor if the probe found a row."""
    rows = df.collect()
    return rows[:limit], encode_cursor(decode_cursor(cursor) + limit) if len(rows) > limit else None


def query_symbols(symbols: DataFrame, file_path=None, kind=None, name_like=None, name_regex=None) -> DataFrame:
    return where_all(
        symbols,
        equal("file_path", file_path),
        equal("kind", kind_of(kind, SYMBOL_KINDS)),
        F.col("name").like(name_like) if name_like else None,
        F.col("name").rlike(f"(?i){name_regex}") if name_regex else None,
    )


def get_symbols(symbols, file_path=None, kind=None, name_pattern=None, max_results=PAGE["symbols"], cursor=None, probe=False) -> DataFrame:
    found = query_symbols(symbols, file_path, kind, name_regex=name_pattern)
    return page(found.select(*SYMBOL_COLUMNS), SYMBOL_ORDER, max_results, cursor, probe)


def get_symbol(symbols: DataFrame, symbol_id: str | None = None, symbol_key: str | None = None) -> DataFrame:
    """One symbol; the id wins over the key, and of several with one key the least id."""
    if not (symbol_id or symbol_key):
        raise InvalidArguments("symbol_id or symbol_key is required")
    at = F.col("symbol_id") == symbol_id if symbol_id else F.col("symbol_key") == symbol_key
    return symbols.where(at).orderBy("symbol_id").limit(1).select(*SYMBOL_COLUMNS, "docstring")


def symbol_dicts(symbols: DataFrame) -> DataFrame:
    """Symbols as flat records of the fields that a client reads; empty texts are null."""
    empty = ("container_symbol_id", "docstring")
    fields = ("symbol_id", "symbol_key", "symbol_key_exact", "container_symbol_id", "name", "kind", "file_path", "start_line", "end_line", "signature", "docstring", "language")
    return symbols.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in empty else F.col(c) for c in fields])


def query_edges(edges: DataFrame, source_id=None, target_id=None, kind=None, file_path=None) -> DataFrame:
    return where_all(
        edges, equal("source_symbol_id", source_id), equal("target_symbol_id", target_id), equal("kind", kind_of(kind, EDGE_KINDS)), equal("file_path", file_path)
    )


def get_edges(edges, max_results=PAGE["edges"], cursor=None, probe=False, **filters) -> DataFrame:
    return page(query_edges(edges, **filters), EDGE_ORDER, max_results, cursor, probe)


def get_chunks(chunks, file_path=None, has_vector=None, max_results=PAGE["chunks"]) -> DataFrame:
    """Chunks of a file, with or without vectors."""
    found = where_all(chunks, equal("file_path", file_path), None if has_vector is None else F.coalesce("has_vector", F.lit(False)) == has_vector)
    return page(found, ("file_path", "start_line", "chunk_id"), max_results)


def get_diagnostics(diagnostics, max_results=PAGE["diagnostics"]) -> DataFrame:
    return page(diagnostics, ("file_path",), max_results)


def _edges(edges: DataFrame, max_results: int) -> DataFrame:
    return page(edges, EDGE_ORDER, max_results)


def get_imports(edges, file_path=None, symbol_id=None, max_results=PAGE["edges"]) -> DataFrame:
    rows = _edges(query_edges(edges, source_id=symbol_id, kind="imports", file_path=file_path), max_results)
    return rows.select(
        F.left("edge_id", F.lit(8)).alias("edge_id"), "source_symbol_id", F.coalesce("target_symbol_id", F.lit("")).alias("target_symbol_id"),
        "ref_text", "file_path", F.col("start_line").alias("line"),
    )


def get_dependents(edges, symbol_id, max_results=PAGE["edges"]) -> DataFrame:
    rows = _edges(query_edges(edges, target_id=symbol_id), max_results)
    return rows.select("source_symbol_id", "kind", "ref_text", "file_path", F.col("start_line").alias("line"))


def find_references(edges, symbol_id, max_results=PAGE["edges"]) -> DataFrame:
    return _edges(query_edges(edges, target_id=symbol_id), max_results).select("source_symbol_id", "kind", "ref_text", "file_path", "start_line", "column")


def get_call_graph(edges, symbol_id, direction="outgoing", max_results=PAGE["edges"]) -> DataFrame:
    end = {"source_id": symbol_id} if direction == "outgoing" else {"target_id": symbol_id}
    rows = _edges(query_edges(edges, kind="calls", **end), max_results)
    target = F.coalesce("target_symbol_id", F.lit("")).alias("target_symbol_id")
    return rows.select("source_symbol_id", target, "ref_text", "file_path", F.col("start_line").alias("line"))


def get_hierarchy(edges, symbol_id, direction="ancestors", max_results=PAGE["edges"]) -> DataFrame:
    end = {"source_id": symbol_id} if direction == "ancestors" else {"target_id": symbol_id}
    rows = _edges(query_edges(edges, kind="inherits", **end), max_results)
    return rows.select("source_symbol_id", F.coalesce("target_symbol_id", F.lit("")).alias("target_symbol_id"), "kind")


def ancestors_closure(edges: DataFrame, symbol_id: str) -> DataFrame:
    """Extension: all ancestors over INHERITS with their least distance.

    The pairs of the edges are written once, and each hop writes the ancestors that it is the first to find, until it finds
    none; a circle ends too.
    """
    steps = query_edges(edges, kind="inherits").where("target_symbol_id IS NOT NULL").select(F.col("source_symbol_id").alias("s"), F.col("target_symbol_id").alias("t"))
    steps = cut(steps.distinct())
    schema = "ancestor string, distance int"
    fronts, front = [], edges.sparkSession.createDataFrame([(symbol_id, 0)], schema)
    while True:
        front = front.join(steps, F.col("ancestor") == F.col("s")).select(F.col("t").alias("ancestor"), F.lit(len(fronts) + 1).alias("distance")).distinct()
        for found in fronts:
            front = front.join(found.select("ancestor"), "ancestor", "left_anti")
        front = cut(front)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, fronts) if fronts else front
        fronts.append(front)


def resolve_symbol(symbols, name, kind=None, file_context=None) -> DataFrame:
    """Candidates of exactly this name, those of the context file first."""
    rows = where_all(symbols, F.col("name") == name, equal("kind", kind_of(kind, SYMBOL_KINDS)))
    first = F.when(F.col("file_path") == F.lit(file_context or ""), 0).otherwise(1)
    return rows.orderBy(first, *SYMBOL_ORDER).select("symbol_id", "symbol_key", "name", "kind", "file_path", "signature")


def file_summary(symbols, edges, file_path, max_results=PAGE["file_summary"]) -> DataFrame:
    """One row: the file's symbols in order, and counts of symbols, edges and imports."""
    mine = page(symbols.where(F.col("file_path") == file_path), SYMBOL_ORDER, max_results)
    s = mine.agg(
        F.sort_array(F.collect_list(F.struct("start_line", "symbol_id", "name", "kind", "end_line", "signature"))).alias("x"), F.count("*").alias("symbol_count")
    )
    e = edges.where(F.col("file_path") == file_path).agg(F.count("*").alias("edge_count"), F.count_if(F.col("kind") == "imports").alias("import_count"))
    fields = ("name", "kind", "start_line", "end_line", "signature")
    # both sides are single rows
    return s.join(e, F.lit(True)).select(
        F.lit(file_path).alias("file_path"), F.transform("x", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("symbols"), "symbol_count", "edge_count", "import_count"
    )


def snippet(files: DataFrame, file_path: str, start_line: int = 1, end_line: int = 0, max_lines: int = PAGE["snippet_lines"]) -> DataFrame:
    """One row: a range of a file's lines, at most ``max_lines``; end 0: as far as that goes."""
    text = F.regexp_replace("content", r"\r\n?", "\n")
    lines = F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")
    total = F.size("lines")
    start = F.greatest(F.lit(1), F.lit(start_line))
    wanted = F.lit(end_line) if end_line > 0 else total
    end = F.least(wanted, F.lit(max(1, start_line) + max_lines - 1), total)
    return files.where(F.col("file_path") == file_path).select("file_path", lines.alias("lines")).select(
        "file_path", start.alias("start_line"), end.alias("end_line"), total.alias("total_lines"),
        F.array_join(F.slice("lines", start, F.greatest(end - start + 1, F.lit(0))), "").alias("content"), (end < total).alias("truncated"),
    )


def repo_overview(state: DataFrame, is_dirty: bool = False, current_head: str | None = None) -> DataFrame:
    w, e, r = "workspace_state", "embedding", "repo_stats"
    return state.select(
        F.lit(True).alias("indexed"), "generation", f"{w}.head_commit", f"{r}.file_count", F.col(f"{e}.provider").alias("embedding_provider"),
        F.col(f"{e}.model").alias("embedding_model"), f"{r}.total_tokens", f"{r}.median_file_tokens", f"{r}.p75_file_tokens",
        F.lit(is_dirty).alias("is_dirty"), F.lit(current_head).alias("current_head"),
    )


def semantic_rows(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", "file_path", "start_line", "end_line", F.col("distance").alias("score"), "symbol_ids", S.preview(F.col("content")).alias("content_preview"))
