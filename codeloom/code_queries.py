"""Queries over code: files made of whole documents, parsed, resolved, chunked and indexed.

The documents hold no code, so each line of a document becomes a block of code, of one of four kinds in turn, that
bears the line's letters in its names. What a block holds is written down beside it as rows, from which the
DuckDB twins are made; ``@`` stands for the line's name, ``+`` for an at sign.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.lineage import cut, together
from codeloom.operators import chunking, resolve
from codeloom.plans.parse import operator as parse
from codeloom.registry import query
from codeloom.sources.config import Config

PYTHON = [
    """class C@(Base, mod.Other):
    \"""About @.\"""
    +wrap(1)
    def run(self, x: int) -> str:
        def inner(y):
            return y
        return inner(
            x,
        )
""",
    """from pkg.@ import a, b as c
import os.path as p
""",
    """async def @(a, *, b=len("x")):
    return await go(a)(b)
""",
    """def @(a, b):
    class Local:
        def go(self):
            return @(a, b)
    return Local().go()
""",
]
#: block, name, kind, first and last line, signature, container, docstring
PYTHON_SYMBOLS = [
    (0, "C@", "class", 0, 8, "class C@(Base, mod.Other)", None, "About @."),
    (0, "run", "method", 3, 8, "def run(self, x: int) -> str", "C@", None),
    (0, "inner", "method", 4, 5, "def inner(y)", "C@", None),
    (2, "@", "function", 0, 1, 'async def @(a, *, b=len("x"))', None, None),
    (3, "@", "function", 0, 4, "def @(a, b)", None, None),
    (3, "Local", "class", 1, 3, "class Local", None, None),
    (3, "go", "method", 2, 3, "def go(self)", "Local", None),
]
#: block, kind, text, first and last line, what stands before it on its line, and the scope's name, kind and line
PYTHON_EDGES = [
    (0, "inherits", "Base", 0, 0, "class C@(", "C@", "class", 0),
    (0, "inherits", "mod.Other", 0, 0, "class C@(Base, ", "C@", "class", 0),
    (0, "calls", "wrap(1)", 2, 2, "    +", "C@", "class", 0),
    (0, "calls", "inner(\n            x,\n        )", 6, 8, "        return ", "run", "method", 3),
    (1, "imports", "from pkg.@ import a", 0, 0, "", None, None, None),
    (1, "imports", "from pkg.@ import b as c", 0, 0, "", None, None, None),
    (1, "imports", "import os.path as p", 1, 1, "", None, None, None),
    (2, "calls", 'len("x")', 0, 0, "async def @(a, *, b=", "@", "function", 0),
    (2, "calls", "go(a)(b)", 1, 1, "    return await ", "@", "function", 0),
    (2, "calls", "go(a)", 1, 1, "    return await ", "@", "function", 0),
    (3, "calls", "@(a, b)", 3, 3, "            return ", "go", "method", 2),
    (3, "calls", "Local().go()", 4, 4, "    return ", "@", "function", 0),
    (3, "calls", "Local()", 4, 4, "    return ", "@", "function", 0),
]
SCRIPT = [
    """import d@, { a as b, type T } from './m@';
import './side@';
""",
    """/** About @. */
export default class K@<T> extends B.C implements I, J {
  static async run(x: number): Promise<T> { return go(x).then(y => done(`${y} ${last(/[(]/)}`)); }
  field = (z) => kept(z);
}
""",
    """export const f@ = async (y: string): Promise<string> => {
  return g(y);
};
""",
    """export interface P@ extends Q { a: number; }
type U@ = P@ | null;
enum E@ { A, B }
async function h@<T>(x: T): T {
  return h@(x);
}
""",
]
SCRIPT_SYMBOLS = [
    (1, "K@", "class", 1, 4, "class K@ extends B.C implements I, J", None, "About @."),
    (1, "run", "method", 2, 2, "static async run(x: number): Promise<T>", "K@", None),
    (2, "f@", "function", 0, 2, "const f@ = (y: string): Promise<string>", None, None),
    (3, "P@", "interface", 0, 0, "interface P@ extends Q", None, None),
    (3, "U@", "type_alias", 1, 1, "type U@ = P@ | null", None, None),
    (3, "E@", "enum", 2, 2, "enum E@ { A, B }", None, None),
    (3, "h@", "function", 3, 5, "async function h@<T>(x: T): T", None, None),
]
RUN = "  static async run(x: number): Promise<T> { return "
SCRIPT_EDGES = [
    (0, "imports", "import d@ from './m@'", 0, 0, "", None, None, None),
    (0, "imports", "import a as b from './m@'", 0, 0, "", None, None, None),
    (0, "imports", "import T from './m@'", 0, 0, "", None, None, None),
    (0, "imports", "import './side@';", 1, 1, "", None, None, None),
    (1, "inherits", "B.C", 1, 1, "export default class K@<T> extends ", "K@", "class", 1),
    (1, "implements", "I", 1, 1, "export default class K@<T> extends B.C implements ", "K@", "class", 1),
    (1, "implements", "J", 1, 1, "export default class K@<T> extends B.C implements I, ", "K@", "class", 1),
    (1, "calls", "go(x)", 2, 2, RUN, "run", "method", 2),
    (1, "calls", "go(x).then(y => done(`${y} ${last(/[(]/)}`))", 2, 2, RUN, "run", "method", 2),
    (1, "calls", "done(`${y} ${last(/[(]/)}`)", 2, 2, RUN + "go(x).then(y => ", "run", "method", 2),
    (1, "calls", "last(/[(]/)", 2, 2, RUN + "go(x).then(y => done(`${y} ${", "run", "method", 2),
    (1, "calls", "kept(z)", 3, 3, "  field = (z) => ", "K@", "class", 1),
    (2, "calls", "g(y)", 1, 1, "  return ", "f@", "function", 0),
    (3, "calls", "h@(x)", 4, 4, "  return ", "h@", "function", 3),
]
#: Other languages: extension, language, a file, and its symbols: name, kind, first and last line, signature, container.
OTHERS = [
    (".js", "javascript", "const m@ = require('./m');\nfunction* s@(a) {\n  return t(a);\n}\n", [("s@", "function", 2, 4, "function* s@(a)", None)]),
    (".go", "go", "package p\n\ntype T@ struct {\n\tn int\n}\n\nfunc (t *T@) Get(a int) int {\n\treturn go1(a)\n}\n", [("T@", "type", 3, 5, "type T@ struct", None), ("Get", "function", 7, 9, "func (t *T@) Get(a int) int", None)]),
    (".rs", "rust", "use std::fmt;\npub struct S@ { n: u32 }\nimpl S@ {\n    pub fn size(&self) -> u32 { self.n }\n}\n", [("S@", "class", 2, 2, "pub struct S@", None), ("size", "method", 4, 4, "pub fn size(&self) -> u32", "S@")]),
    (".java", "java", "import a.B;\npublic class J@ {\n    int run(int x) {\n        return help(x);\n    }\n}\n", [("J@", "class", 2, 6, "public class J@", None), ("run", "method", 3, 5, "int run(int x)", "J@")]),
    (".c", "c", "#include <a.h>\nstruct N@ { int v; };\nint add@(int a) {\n    return f(a);\n}\n", [("N@", "class", 2, 2, "struct N@", None), ("add@", "function", 3, 5, "int add@(int a)", None)]),
    (".cpp", "cpp", "#include <v>\nclass V@ {\n    int at(int i) { return get(i); }\n};\n", [("V@", "class", 2, 4, "class V@", None), ("at", "method", 3, 3, "int at(int i)", "V@")]),
    (".cs", "c_sharp", "using System;\ninterface I@ { }\nclass D@ {\n    void Go(int x) { Call(x); }\n}\n", [("I@", "interface", 2, 2, "interface I@", None), ("D@", "class", 3, 5, "class D@", None), ("Go", "method", 4, 4, "void Go(int x)", "D@")]),
    (".swift", "swift", "import UIKit\nstruct W@ {\n    func draw(_ n: Int) { paint(n) }\n}\n", [("W@", "class", 2, 4, "struct W@", None), ("draw", "method", 3, 3, "func draw(_ n: Int)", "W@")]),
    (".kt", "kotlin", "import a.b\nobject O@ {\n    fun call(x: Int): Int { return dial(x) }\n}\n", [("O@", "class", 2, 4, "object O@", None), ("call", "method", 3, 3, "fun call(x: Int): Int", "O@")]),
]


def offsets(blocks: list[str]) -> list[int]:
    """First lines of the blocks, from 0, and the line after the last."""
    out = [0]
    for b in blocks:
        out.append(out[-1] + b.count("\n"))
    return out


def letters(c):
    return F.regexp_replace(c, "[^A-Za-z]", "")


def code_files(v, blocks: list[str], extension: str, language: str, spread: bool = False):
    """A file for each document, a block for each of its lines. spread: by as many tasks as the session has, however few files the documents lie in."""

    def block(line, i):
        name = F.concat(F.lit("n"), letters(line), F.lit("_"), (i + 1).cast("string"))
        pick = F.lit(blocks[-1])
        for k, text in enumerate(blocks[:-1]):
            pick = F.when(i % len(blocks) == k, F.lit(text)).otherwise(pick)
        return F.replace(F.replace(pick, F.lit("@"), name), F.lit("+"), F.lit("@"))

    code = F.array_join(F.transform(F.split("content", "\n"), block), "")
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(extension))
    files = v.files.repartition("doc_id") if spread else v.files
    return files.select("doc_id", path.alias("file_path"), F.lit(language).alias("language"), code.alias("content"))


def lines_sql(blocks: list[str], extension: str) -> str:
    """A row for each line: its file, block, name, and the code line that its block begins on."""
    at = offsets(blocks)
    return f"""(SELECT doc_id, 'doc_' || doc_id || '{extension}' AS file_path, (i - 1) % {len(blocks)} AS block, 'n' || regexp_replace(line, '[^A-Za-z]', '', 'g') || '_' || i AS n,
        1 + {at[-1]} * ((i - 1) // {len(blocks)}) + {at[:-1]}[(i - 1) % {len(blocks)} + 1] AS base FROM (
        SELECT doc_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM v_files) s)"""


def literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


def symbols_sql(blocks, extension, rows) -> str:
    named = lambda c: f"replace(t.{c}, '@', n)"
    return f"""(SELECT file_path, {named('name')} AS name, kind, CAST(base + a AS INTEGER) AS start_line, CAST(base + b AS INTEGER) AS end_line, {named('signature')} AS signature, {named('container')} AS container_name,
        {named('doc')} AS docstring, file_path || ':' || {named('name')} || ':' || kind || ':' || (base + a) AS symbol_id FROM {lines_sql(blocks, extension)} l JOIN (VALUES {values(rows)}) AS t(block, name, kind, a, b, signature, container, doc) USING (block))"""


def edges_sql(blocks, extension, rows) -> str:
    return f"""(SELECT file_path, kind, replace(ref, '@', n) AS ref_text, CAST(base + a AS INTEGER) AS start_line, CAST(base + b AS INTEGER) AS end_line, CAST(length(replace(prefix, '@', n)) AS INTEGER) AS "column",
        CASE WHEN scope IS NULL THEN file_path || ':<module>' ELSE file_path || ':' || replace(scope, '@', n) || ':' || scope_kind || ':' || (base + c) END AS source_symbol_id
        FROM {lines_sql(blocks, extension)} l JOIN (VALUES {values(rows)}) AS t(block, kind, ref, a, b, prefix, scope, scope_kind, c) USING (block))"""


def python_files(v, spread: bool = False):
    return code_files(v, PYTHON, ".py", "python", spread)


def script_files(v):
    return code_files(v, SCRIPT, ".ts", "typescript")


SYMBOL = ["file_path", "name", "kind", "start_line", "end_line", "signature", "container_name", "docstring", "symbol_id"]
EDGE = ["file_path", "kind", "ref_text", "start_line", "end_line", "column", "source_symbol_id"]
PY_SYMBOLS, PY_EDGES = symbols_sql(PYTHON, ".py", PYTHON_SYMBOLS), edges_sql(PYTHON, ".py", PYTHON_EDGES)


# parsing


@query(f"SELECT * FROM {PY_SYMBOLS} s", "v_files")
def parse_python(v):
    return parse.symbols_of(parse.parse_files(python_files(v), parts=("symbols",))).select(*SYMBOL)


@query(f"SELECT * FROM {PY_EDGES} e", "v_files")
def parse_python_edges(v):
    return parse.edges_of(parse.parse_files(python_files(v), parts=("edges",))).select(*EDGE)


@query(f"SELECT * FROM {symbols_sql(SCRIPT, '.ts', SCRIPT_SYMBOLS)} s", "v_files")
def parse_typescript(v):
    return parse.symbols_of(parse.parse_files(script_files(v), parts=("symbols",))).select(*SYMBOL)


@query(f"SELECT * FROM {edges_sql(SCRIPT, '.ts', SCRIPT_EDGES)} e", "v_files")
def parse_typescript_edges(v):
    return parse.edges_of(parse.parse_files(script_files(v), parts=("edges",))).select(*EDGE)


OTHER_SYMBOLS = [(k, *s) for k, (_, _, _, found) in enumerate(OTHERS) for s in found]


@query(
    f"""SELECT file_path, t.language, replace(t.name, '@', n) AS name, kind, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, replace(t.signature, '@', n) AS signature, replace(t.container, '@', n) AS container_name
    FROM (SELECT 'doc_' || doc_id || e.extension AS file_path, e.k, e.language, 'n' || regexp_replace(content, '[^A-Za-z]', '', 'g') AS n FROM v_files JOIN (VALUES {values([(k, e, x) for k, (e, x, _, _) in enumerate(OTHERS)])}) AS e(k, extension, language) ON doc_id % {len(OTHERS)} = e.k) f
    JOIN (SELECT s.*, e.language FROM (VALUES {values(OTHER_SYMBOLS)}) AS s(k, name, kind, a, b, signature, container) JOIN (VALUES {values([(k, x) for k, (_, x, _, _) in enumerate(OTHERS)])}) AS e(k, language) USING (k)) t ON t.k = f.k""",
    "v_files",
)
def parse_languages(v):
    """A file of one of nine further languages for each document, with the letters of its whole text in its names."""
    k = F.col("doc_id") % len(OTHERS)
    pick = lambda column: F.element_at(F.array(*[F.lit(x[column]) for x in OTHERS]), (k + 1).cast("int"))
    code = F.replace(pick(2), F.lit("@"), F.concat(F.lit("n"), letters(F.col("content"))))
    files = v.files.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), pick(0)).alias("file_path"), pick(1).alias("language"), code.alias("content"))
    return parse.symbols_of(parse.parse_files(files, parts=("symbols",))).select("file_path", "language", "name", "kind", "start_line", "end_line", "signature", "container_name")


@query(
    f"""SELECT 'doc_' || doc_id || '.py' AS file_path, 'error' AS parse_status, CAST(1 AS INTEGER) AS error_count, CAST(1 + {offsets(PYTHON)[-1]} * (k // 4) + {offsets(PYTHON)[:-1]}[k % 4 + 1] AS INTEGER) AS start_line
    FROM (SELECT doc_id, len(string_split(content, chr(10))) AS k FROM v_files WHERE doc_id % 3 <> 1) s""",
    "v_files",
)
def parse_diagnostics(v):
    """Files that end in a line that is no Python, one kind or another; every third has none."""
    broken = F.when(F.col("doc_id") % 3 == 0, "def f(:\n").when(F.col("doc_id") % 3 == 2, "x = (1,\n").otherwise("")
    found = parse.diagnostics_of(parse.parse_files(python_files(v).withColumn("content", F.concat("content", broken)), parts=("errors",)))
    return found.select("file_path", "parse_status", "error_count", F.col("error_spans")[0]["start_line"].alias("start_line"))


# resolution


@query(
    f"""SELECT e.file_path, e.kind, e.ref_text, e.start_line, e.source_symbol_id, coalesce(f.t, g.t) AS target_symbol_id, CASE WHEN f.t IS NOT NULL THEN 1.0::DOUBLE WHEN g.t IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS resolution_confidence,
    CASE WHEN f.t IS NOT NULL THEN 'same_file' WHEN g.t IS NOT NULL THEN 'unique_name' END AS resolution_method
    FROM (SELECT *, CASE WHEN kind <> 'imports' THEN nullif(regexp_extract(split_part(ref_text, '(', 1), '([A-Za-z_$][A-Za-z0-9_$]*)\\s*$', 1), '') END AS asked FROM {PY_EDGES} e) e
    LEFT JOIN (SELECT file_path, name, min(symbol_id) AS t FROM {PY_SYMBOLS} s GROUP BY file_path, name HAVING count(*) = 1) f ON f.file_path = e.file_path AND f.name = e.asked
    LEFT JOIN (SELECT name, min(symbol_id) AS t FROM {PY_SYMBOLS} s GROUP BY name HAVING count(*) = 1) g ON g.name = e.asked""",
    "v_files",
)
def resolve_edge_targets(v):
    """Targets in an edge's own file are found in the file's row; that row is written once, without what no target depends on."""
    whole = cut(resolve.own_targets(parse.names_held(parse.parse_files(python_files(v), parts=("symbols", "edges"), whole=True))))
    done = resolve.resolve_by_name(parse.edges_of(whole), parse.names_of(whole))
    return done.select("file_path", "kind", "ref_text", "start_line", "source_symbol_id", "target_symbol_id", "resolution_confidence", "resolution_method")


@query(
    """SELECT 'doc_' || a.doc_id || '.py' AS file_path, 'helper_' || ((a.doc_id + 1) % 3) || '(x)' AS ref_text, CASE WHEN b.doc_id IS NOT NULL THEN 'doc_' || b.doc_id || '.py:helper_' || (b.doc_id % 3) || ':function:3' END AS target_symbol_id,
    CASE WHEN b.doc_id IS NOT NULL THEN 'import' END AS resolution_method FROM v_files a LEFT JOIN v_files b ON b.doc_id = a.doc_id + 1""",
    "v_files",
)
def resolve_imported_targets(v):
    """Each file imports the next one and calls a function of a name that a third of all files have."""
    i = F.col("doc_id")
    code = F.format_string("from doc_%d import helper\n\ndef helper_%d(x):\n    return helper_%d(x)\n", i + 1, i % 3, (i + 1) % 3)
    files = v.files.select(F.format_string("doc_%d.py", i).alias("file_path"), F.lit("python").alias("language"), code.alias("content"))
    parsed = cut(parse.parse_files(files, parts=("symbols", "edges")))
    edges = parse.edges_of(parsed)
    done = resolve.resolve_targets(edges, parse.symbols_of(parsed), resolve.resolve_imports(edges, files.select("file_path")))
    return done.where("kind = 'calls'").select("file_path", "ref_text", "target_symbol_id", "resolution_method")


@query(
    """, n AS (SELECT doc_id AS i, doc_id % 8 AS k, doc_id // 8 AS b FROM v_files),
    brought AS (SELECT n.i, p.i AS j, CASE WHEN n.k < 6 THEN 'g_' ELSE 'c_' END || n.b AS name, CASE WHEN n.k = 1 THEN 'h_' WHEN n.k < 6 THEN 'g_' ELSE 'c_' END || n.b AS there
        FROM n JOIN n p ON n.k > 0 AND p.i = n.i + CASE WHEN n.k = 6 THEN 1 ELSE -1 END),
    ways AS (SELECT i, name, j, there, 1 AS hops FROM brought UNION ALL SELECT w.i, w.name, a.j, a.there, hops + 1 FROM ways w JOIN brought a ON a.i = w.j AND a.name = w.there WHERE hops < 9),
    ended AS (SELECT w.*, 'doc_' || w.j || '.py:' || w.there || ':function:1' AS t FROM ways w JOIN n ON n.i = w.j AND n.k = 0 AND w.there = 'h_' || n.b)
    SELECT 'doc_' || n.i || '.py' AS file_path, CASE WHEN dotted THEN 'm.' ELSE '' END || CASE WHEN n.k < 6 THEN 'g_' ELSE 'c_' END || n.b || '(x)' AS ref_text, e.t AS target_symbol_id,
        CASE WHEN e.t IS NULL THEN 0.0::DOUBLE WHEN NOT dotted AND e.hops = 1 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS resolution_confidence, CASE WHEN e.t IS NOT NULL THEN CASE WHEN NOT dotted AND e.hops = 1 THEN 'import' ELSE 're_export' END END AS resolution_method
    FROM n CROSS JOIN (VALUES (TRUE), (FALSE)) d(dotted) LEFT JOIN brought a ON dotted AND a.i = n.i LEFT JOIN ended e ON e.i = CASE WHEN dotted THEN a.j ELSE n.i END AND e.name = CASE WHEN n.k < 6 THEN 'g_' ELSE 'c_' END || n.b""",
    "v_files",
)
def resolve_reexported_targets(v):
    """Of eight documents, the first defines a function, the second imports it under another name, the next four each import it from the
    one before, and the last two import a name from each other; each calls the name, and asks the imported module for it."""
    i = F.col("doc_id")
    k, b = i % 8, F.floor(i / 8).cast("string")
    path = lambda n: F.concat(F.lit("doc_"), n.cast("string"))
    files = v.files.select("doc_id", F.concat(path(i), F.lit(".py")).alias("file_path"))
    name = F.concat(F.when(k < 6, "g_").otherwise("c_"), b)
    module = path(F.when(k == 6, i + 1).otherwise(i - 1))
    text = F.concat(F.lit("from "), module, F.lit(" import "), F.when(k == 1, F.concat(F.lit("h_"), b, F.lit(" as "), name)).otherwise(name))
    edge = lambda kind, ref, n: (F.lit(kind).alias("kind"), ref.alias("ref_text"), F.concat_ws("|", "file_path", F.lit(n)).alias("edge_id"))
    none = F.lit(None).cast("string")
    given = files.where(k > 0).select("file_path", *edge("imports", text, "0"))
    for n, prefix in (("1", ""), ("2", "m.")):
        given = given.unionAll(files.select("file_path", *edge("calls", F.concat(F.lit(prefix), name, F.lit("(x)")), n)))
    edges = cut(resolve.unresolved(given.withColumn("target_symbol_id", none)))
    symbols = files.where(k == 0).select("file_path", F.concat(F.lit("h_"), b).alias("name"), F.concat("file_path", F.lit(":h_"), b, F.lit(":function:1")).alias("symbol_id"))
    imports = cut(resolve.resolve_imports(edges, files.select("file_path")))
    ways = cut(resolve.routes(resolve.aliases(edges, imports), symbols))
    done = resolve.resolve_targets(edges, symbols, imports, ways)
    return done.where("kind = 'calls'").select("file_path", "ref_text", "target_symbol_id", "resolution_confidence", "resolution_method")


@query(
    """SELECT f.file_path, f.module, p.file_path AS resolved_path, p.file_path IS NULL AND f.module NOT LIKE '.%' AS is_external, CASE WHEN p.file_path IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM (
    SELECT file_path, split_part(file_path, '/', 1) AS source, CASE doc_id % 5 WHEN 0 THEN split_part(file_path, '/', 1) || '.en.doc_' || (doc_id + 8) WHEN 1 THEN '.doc_' || (doc_id + 4) WHEN 2 THEN '..en.doc_' || (doc_id + 3) WHEN 3 THEN 'json.decoder' ELSE 'nowhere' END AS module,
    CASE doc_id % 5 WHEN 0 THEN split_part(file_path, '/', 1) || '/en/doc_' || (doc_id + 8) WHEN 1 THEN split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) || '/doc_' || (doc_id + 4) WHEN 2 THEN split_part(file_path, '/', 1) || '/en/doc_' || (doc_id + 3) END AS base FROM v_files) f
    LEFT JOIN v_files p ON p.file_path = f.base || '.py'""",
    "v_files",
)
def resolve_python_imports(v):
    """Absolute, relative, two-level relative, standard and unknown modules of every file, against all files."""
    i, path = F.col("doc_id"), F.col("file_path")
    source = F.substring_index(path, "/", 1)
    module = (
        F.when(i % 5 == 0, F.concat(source, F.format_string(".en.doc_%d", i + 8))).when(i % 5 == 1, F.format_string(".doc_%d", i + 4))
        .when(i % 5 == 2, F.format_string("..en.doc_%d", i + 3)).when(i % 5 == 3, "json.decoder").otherwise("nowhere")
    )
    found = resolve.resolve_python(v.files.select("file_path", module.alias("module")), v.files, ["."])
    return found.select("file_path", "module", "resolved_path", "is_external", "confidence")


@query(
    """SELECT f.file_path, f.module, p.file_path AS resolved_path, f.module LIKE 'react%' AS is_external FROM (
    SELECT file_path, CASE doc_id % 4 WHEN 0 THEN './doc_' || (doc_id + 5) WHEN 1 THEN '../de/doc_' || (doc_id + 2) WHEN 2 THEN '@/de/doc_' || (doc_id + 9) ELSE 'react-dom' END AS module,
    CASE doc_id % 4 WHEN 0 THEN split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) || '/doc_' || (doc_id + 5) WHEN 1 THEN split_part(file_path, '/', 1) || '/de/doc_' || (doc_id + 2) WHEN 2 THEN 'src0/de/doc_' || (doc_id + 9) END AS base FROM v_files) f
    LEFT JOIN v_files p ON p.file_path = f.base || '.ts'""",
    "v_files",
)
def resolve_script_imports(v):
    """Relative, parent, alias and package modules of every file, against all files."""
    i = F.col("doc_id")
    module = F.when(i % 4 == 0, F.format_string("./doc_%d", i + 5)).when(i % 4 == 1, F.format_string("../de/doc_%d", i + 2)).when(i % 4 == 2, F.format_string("@/de/doc_%d", i + 9)).otherwise("react-dom")
    found = resolve.resolve_script(v.files.select("file_path", module.alias("module")), v.files, {"@/*": ["./src0/*"]})
    return found.select("file_path", "module", "resolved_path", "is_external")


@query(
    """SELECT file_path, trim(text) AS text, nullif(CASE doc_id % 4 WHEN 0 THEN 'pkg.' || lang WHEN 1 THEN '.' || lang WHEN 2 THEN lang || '.x' ELSE './' || lang END, '') AS module FROM (
    SELECT file_path, doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'from pkg.' || lang || ' import a' WHEN 1 THEN 'from .' || lang || ' import b as c' WHEN 2 THEN 'import ' || lang || '.x as y' ELSE 'import { z } from ''./' || lang || '''' END AS text FROM v_files WHERE lang IS NOT NULL) f""",
    "v_files",
)
def modules_of_imports(v):
    i, lang = F.col("doc_id"), F.col("lang")
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("from pkg."), lang, F.lit(" import a"))).when(i % 4 == 1, F.concat(F.lit("from ."), lang, F.lit(" import b as c")))
        .when(i % 4 == 2, F.concat(F.lit("import "), lang, F.lit(".x as y"))).otherwise(F.concat(F.lit("import { z } from './"), lang, F.lit("'")))
    )
    language = F.when(i % 4 == 3, "typescript").otherwise("python")
    return v.files.where("lang IS NOT NULL").select("file_path", text.alias("text"), resolve.module_of_import(text, language).alias("module"))


@query("SELECT unnest(CASE WHEN count(*) FILTER (WHERE doc_id % 2 = 0) > 0 THEN ['src', 'lib'] ELSE ['src'] END) AS root FROM v_files", "v_files")
def package_roots(v):
    base = F.when(F.col("doc_id") % 2 == 0, "lib/").otherwise("src/")
    return resolve.package_roots(v.files.select(F.concat(base, F.col("lang"), F.lit("/__init__.py")).alias("file_path")))


# chunks of symbols and of what is between them


def piece(k: int, a: int, b: int) -> str:
    return "".join(f"{x}\n" for x in PYTHON[k].split("\n")[a : b + 1])


def head(*lines: str) -> str:
    return "".join(f"{x}\n" for x in lines)


#: block, first and last line, ids of symbols (name, kind and line; a semicolon between), header after the file's line
CHUNKS = [
    (0, 0, 8, "C@:class:0;run:method:3;inner:method:4", head("Symbol: %.C@:class (class)", "Signature: class C@(Base, mod.Other)", "Docstring: About @."), piece(0, 0, 8)),
    (1, 0, 1, "", "", piece(1, 0, 1)),
    (2, 0, 1, "@:function:0", head("Symbol: %.@:function (function)", 'Signature: async def @(a, *, b=len("x"))'), piece(2, 0, 1)),
    (3, 0, 4, "@:function:0", head("Symbol: %.@:function (function)", "Signature: def @(a, b)"), piece(3, 0, 4)),
    (3, 1, 3, "Local:class:1;go:method:2", head("Symbol: %.Local:class (class)", "Signature: class Local"), piece(3, 1, 3)),
]
#: where a class of more than five lines is one chunk for each method
LARGE = [
    (0, 0, 2, "", "", piece(0, 0, 2)),
    (0, 3, 8, "C@:class:0;run:method:3", head("Class: C@", "Symbol: %.C@.run:method (method)", "Signature: def run(self, x: int) -> str"), piece(0, 3, 8)),
    (0, 4, 5, "C@:class:0;inner:method:4", head("Class: C@", "Symbol: %.C@.inner:method (method)", "Signature: def inner(y)"), piece(0, 4, 5)),
    *CHUNKS[1:],
]


def chunks_sql(rows) -> str:
    ids = "array_to_string(list_transform(CASE WHEN ids = '' THEN [] ELSE string_split(ids, ';') END, lambda x: file_path || ':' || replace(split_part(x, ':', 1), '@', n) || ':' || split_part(x, ':', 2) || ':' || (base + CAST(split_part(x, ':', 3) AS INTEGER))), ',')"
    return f"""SELECT file_path, CAST(base + a AS INTEGER) AS start_line, CAST(base + b AS INTEGER) AS end_line, {ids} AS symbol_ids, head <> '' AS is_symbol_chunk,
    'File: ' || file_path || chr(10) || replace(replace(head, '@', n), '%', 'doc_' || doc_id) || chr(10) || replace(replace(content, '@', n), '+', '@') AS embedding_text
    FROM {lines_sql(PYTHON, '.py')} l JOIN (VALUES {values(rows)}) AS t(block, a, b, ids, head, content) USING (block)"""


def chunked(v, **options):
    """Each file is made, parsed and chunked in one row, by one task: nothing is written or shuffled on the way."""
    return chunking.chunk_whole(parse.symbols_held(parse.parse_files(python_files(v), parts=("symbols",), whole=True)), **options)


def chunks(v, **options):
    return chunked(v, **options).select("file_path", "start_line", "end_line", F.array_join("symbol_ids", ",").alias("symbol_ids"), "is_symbol_chunk", "embedding_text")


@query(chunks_sql(CHUNKS), "v_files")
def chunk_symbols(v):
    return chunks(v)


@query(f"SELECT file_path, start_line, end_line, CAST(row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line DESC) AS INTEGER) AS position FROM ({chunks_sql(CHUNKS)}) c", "v_files")
def chunk_positions(v):
    return chunking.in_order(chunked(v)).select("file_path", "start_line", "end_line", "position")


@query(chunks_sql(LARGE), "v_files")
def chunk_large_classes(v):
    return chunks(v, large=5)


# index jobs


def versions(v):
    """Files before and after: of the documents some are added, some deleted, some moved down by a comment."""
    i = F.col("doc_id")
    more = F.format_string("from doc_%d import only_%d\n\ndef only_%d():\n    return only_%d(only_%d())\n", i + 1, i + 1, i, i + 1, i + 2)
    files = cut(python_files(v, spread=True).withColumn("content", F.concat(more, "content")).withColumns({"size": F.length("content").cast("long"), "mtime": F.lit(1.0)}))
    moved = i % 7 == 0
    content = F.when(moved, F.concat(F.lit("# moved\n\n"), F.col("content"))).otherwise(F.col("content"))
    now = files.where(i % 11 != 0).withColumns({"content": content, "size": F.col("size") + F.when(moved, 9).otherwise(0)})
    return files.where(i % 13 != 0).drop("doc_id"), now.drop("doc_id")


def differences(ours, theirs):
    """missing, extra: how many rows of ``theirs`` lack in ``ours``, and the other way, as exceptAll counts them, in one pass over both."""
    n = ours.select("*", F.lit(1).alias("__n")).unionByName(theirs.select("*", F.lit(-1).alias("__n"))).groupBy(*ours.columns).agg(F.sum("__n").alias("__n"))
    over = lambda sign: F.coalesce(F.sum(F.greatest(F.lit(0), sign * F.col("__n"))), F.lit(0)).cast("long")
    return n.agg(over(F.lit(-1)).alias("missing"), over(F.lit(1)).alias("extra"))


TABLES = ("chunks", "diagnostics", "edges", "imports", "manifest", "symbols")


@query(f"SELECT * FROM (VALUES {', '.join(f'({t!r}, 0::BIGINT, 0::BIGINT)' for t in TABLES)}) AS t(\"table\", missing, extra)")
def incremental_equals_full(v):
    """How many rows of a full index the incremental one lacks, and has beyond it, for each table."""
    from codeloom.lineage import folder
    from codeloom.operators.planning import changed_files
    from codeloom.plans.indexer import build, update
    from codeloom.sources.store import Store

    before, now = versions(v)
    place, config = f"{folder(v.spark)}/{uuid.uuid4().hex}", Config()
    ours, theirs = Store(v.spark, f"{place}/incremental"), Store(v.spark, f"{place}/full")

    def incremental():
        build(ours, 1, ours.stage(1, "files", before), config, True)
        ours.publish(1)
        listing = ours.stage(2, "listing", now.drop("content"))
        changes = ours.stage(2, "changes", changed_files(ours.read("manifest"), listing))
        todo = ours.stage(2, "files", now.join(changes.where("status <> 'deleted'"), "file_path", "left_semi"))
        update(ours, 2, listing, todo, changes, config, True)
        ours.publish(2)

    def full():
        build(theirs, 1, theirs.stage(1, "files", now), config, True)
        theirs.publish(1)

    together(v.spark, incremental, full)
    out = None
    for t in TABLES:
        a, b = (s.read(t).drop("index_generation", "indexed_at", "vector_updated_at") for s in (ours, theirs))
        row = differences(a, b).select(F.lit(t).alias("table"), "missing", "extra")
        out = row if out is None else out.unionAll(row)
    return out
