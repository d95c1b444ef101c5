"""Table schemas, enumerations and defaults."""

# The members of the data model's enumerations.
SYMBOL_KINDS = ("function", "method", "class", "interface", "type", "variable", "import", "module", "type_alias", "enum")
EDGE_KINDS = ("imports", "calls", "inherits", "implements", "type_ref", "read", "write")
REFERENCE_KINDS = ("import", "call", "read", "write", "type", "inherit", "string", "comment")
PARSE_STATUSES = ("ok", "warn", "error")
PROGRESS_STATES = ("queued", "running", "committing", "completed", "failed", "cancelled")


def table(spec: str) -> str:
    """A schema as DDL text, which readers and createDataFrame take; it needs no session."""
    return " ".join(spec.split())


SYMBOLS = table("""symbol_id string NOT NULL, symbol_key string NOT NULL, symbol_key_exact string NOT NULL, name string NOT NULL, kind string NOT NULL,
    file_path string NOT NULL, start_line int NOT NULL, end_line int NOT NULL, signature string NOT NULL, language string NOT NULL, module_path string,
    container_symbol_id string, container_name string, docstring string, index_generation int, indexed_at timestamp""")
EDGES = table("""edge_id string NOT NULL, source_symbol_id string NOT NULL, source_scope string, target_symbol_id string, kind string NOT NULL, file_path string NOT NULL,
    start_line int NOT NULL, end_line int NOT NULL, column int NOT NULL, ref_text string NOT NULL, resolution_confidence double, resolution_method string,
    resolver_id string, resolved_at_generation int, index_generation int, indexed_at timestamp""")
CHUNKS = table("""chunk_id string NOT NULL, file_path string NOT NULL, content string NOT NULL, start_line int, end_line int, symbol_ids array<string>,
    symbol_key_exact string, language string, is_symbol_chunk boolean, has_vector boolean, was_truncated boolean, vector array<float>, embedding_text string,
    content_hash string, content_hash8 string, content_length_chars int, content_lines int, embedded_hash8 string, vector_key string, vector_updated_at timestamp,
    index_generation int, indexed_at timestamp""")
DIAGNOSTICS = table("""file_path string NOT NULL, parse_status string, error_count int,
    error_spans array<struct<start_line:int,start_column:int,end_line:int,end_column:int,type:string>>, indexed_at timestamp""")
MANIFEST = table("file_path string NOT NULL, language string, mtime double, size long, parse_status string")
IMPORTS = table("file_path string NOT NULL, module string NOT NULL, resolved_path string")
ALIASES = table("file_path string NOT NULL, name string NOT NULL, target_file string NOT NULL, target_name string NOT NULL")
#: Reverse indexes: what a key is asked by, and which names have a trigram, each with the bucket of the files that it is in.
ASKS = table("what string NOT NULL, key string NOT NULL, bucket int NOT NULL")
GRAMS = table("key string NOT NULL, h long NOT NULL, bucket int NOT NULL")
#: Vectors under what they were made of: embedder, settings and the text's hash.
VECTORS = table("key string NOT NULL, vector array<float> NOT NULL")
PACKAGE_ROOTS = table("path string NOT NULL, language string, package_name string")
STATE = table("""schema_version int, generation int,
    workspace_state struct<head_commit:string,is_dirty:boolean,default_branch:string,indexed_at:string>,
    embedding struct<provider:string,model:string,dimension:int,normalized:boolean>,
    repo_stats struct<file_count:long,total_bytes:long,total_tokens:long,median_file_tokens:long,p75_file_tokens:long,p90_file_tokens:long>""")
TOOL_CALLS = table("session_id string, tool string, naive_tokens long, actual_tokens long, ts timestamp_ntz")

TABLES = {"symbols": SYMBOLS, "edges": EDGES, "chunks": CHUNKS, "diagnostics": DIAGNOSTICS, "manifest": MANIFEST, "imports": IMPORTS, "aliases": ALIASES, "state": STATE, "package_roots": PACKAGE_ROOTS}
POSTINGS = {"asks": ASKS, "grams": GRAMS, "vectors": VECTORS}
KEYS = {"symbols": "symbol_id", "edges": "edge_id", "chunks": "chunk_id", "diagnostics": "file_path", "manifest": "file_path"}

# Page sizes and other limits that answers depend on.
PAGE = {"symbols": 50, "edges": 200, "chunks": 200, "file_summary": 500, "vector": 10, "diagnostics": 10_000, "snippet_lines": 120, "candidates": 200}
SYMBOL_ORDER = ("file_path", "start_line", "symbol_id")
EDGE_ORDER = ("file_path", "start_line", "column", "edge_id")
