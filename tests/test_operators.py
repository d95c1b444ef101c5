import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import chunking, lookup, planning, resolve, stats, vector

MANIFEST = "file_path string, language string, mtime double, size long, parse_status string"


def manifest(spark, *files):
    return spark.createDataFrame([(p, "python", float(i), s, "ok") for i, (p, s) in enumerate(files)], MANIFEST)


def symbols(spark, *rows):
    """(file, name, kind, start, end, container)"""
    full = [(f"{f}:{n}:{k}:{s}", f"{f}.{n}:{k}", f"{f}.{n}:{k}:x", n, k, f, s, e, f"def {n}", c, None, "") for f, n, k, s, e, c in rows]
    return spark.createDataFrame(
        full, "symbol_id string, symbol_key string, symbol_key_exact string, name string, kind string, file_path string, start_line int, end_line int, signature string, container_name string, docstring string, module_path string"
    )


def edges(spark, *rows):
    """(source, target, kind, file)"""
    return spark.createDataFrame(
        [(f"{i:064d}", s, t, k, f, i, i, 0, "f()") for i, (s, t, k, f) in enumerate(rows)],
        "edge_id string, source_symbol_id string, target_symbol_id string, kind string, file_path string, start_line int, end_line int, column int, ref_text string",
    )


@pytest.mark.parametrize(
    "sizes, want",
    [([400, 1200, 800], (3, 2400, 1800, 600)), (list(range(100, 1001, 100)), (10, 5500, 4125, 413)), ([], (0, 0, 0, 0)), ([600], (1, 600, 450, 450))],
)
def test_repo_stats(spark, sizes, want):
    r = stats.repo_stats(manifest(spark, *[(f"f{i}", s) for i, s in enumerate(sizes)])).first()
    assert (r.file_count, r.total_bytes, r.total_tokens, r.median_file_tokens) == want


def test_naive_tokens(spark):
    m = manifest(spark, ("a.py", 400), ("b.py", 600), ("c.py", 200))
    cost = lambda *f: stats.naive_tokens(spark.createDataFrame([(x,) for x in f], "file_path string"), m).first()[0]
    assert (cost("a.py", "b.py"), cost("a.py", "a.py"), cost("zz"), cost()) == (750, 300, 0, 0)
    own = lambda m, p: stats.naive_tokens_of_file(m, p).first()[0]
    assert (own(m, "b.py"), own(m, "zz"), own(manifest(spark), "a")) == (450, 300, 0)


def test_session_metrics(spark):
    calls = spark.createDataFrame([("s", "snippet", 5000, 800), ("s", "snippet", 3000, 600), ("s", "symbols", 2000, 300)], "session_id string, tool string, naive_tokens long, actual_tokens long")
    tools = {r.tool: r for r in stats.tool_metrics(calls).collect()}
    assert tools["snippet"].calls == 2 and tools["snippet"].tokens_saved == 6600
    total = stats.session_totals(calls)
    assert total.first().total_saved == 8300 and total.first().percent_saved == 83.0
    text = stats.metrics_markdown(stats.tool_metrics(calls), total).first()[0]
    assert "| snippet | 2 | 6,600 |" in text and "Percent saved: 83.0%" in text


def test_partition_plan(spark):
    f = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    rows = planning.plan_partitions(f("src/a.py", "src/b.py", "tests/t.py", "README.md")).collect()
    assert [(r.root_path, r.weight) for r in rows] == [("src", 2), (".", 1), ("tests", 1)]
    assert [(r.root_path, r.weight) for r in planning.plan_partitions(f("a/x.py", "b/y.py", "c/z.py"), min_files=2).collect()] == [("__coalesced__", 3)]
    subs = spark.createDataFrame([("libs",), ("libs/deep",)], "path string")
    found = {r.file_path: (r.root_path, r.kind) for r in planning.partition_roots(f("libs/deep/x.py", "libs/y.py", "libsx/z.py"), subs).collect()}
    assert found == {"libs/deep/x.py": ("libs/deep", "submodule"), "libs/y.py": ("libs", "submodule"), "libsx/z.py": ("libsx", "top_level")}


def test_changes_and_upserts(spark):
    old = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 5), ("d", 1.0, 5)], "file_path string, mtime double, size long")
    new = spark.createDataFrame([("a", 1.0005, 5), ("b", 1.5, 5), ("c", 1.0, 6), ("e", 1.0, 5)], "file_path string, mtime double, size long")
    assert {r.file_path: r.status for r in planning.changed_files(old, new).collect()} == {"b": "modified", "c": "modified", "d": "deleted", "e": "added"}
    batch = spark.createDataFrame([("a", 9.0, 1), ("a", 8.0, 2), ("z", 1.0, 3)], "file_path string, mtime double, size long")
    out = {r.file_path: r.mtime for r in planning.upsert(old, batch, "file_path", "mtime").collect()}
    assert out == {"a": 9.0, "b": 1.0, "c": 1.0, "d": 1.0, "z": 1.0}


def test_staleness(spark):
    state = spark.sql("SELECT named_struct('head_commit', 'abc') AS workspace_state")
    check = lambda s, h, d: planning.staleness(s, h, d).first()
    assert check(state.limit(0), "abc", False).reason == "no_index"
    assert check(state, "def", True).reason == "head_changed" and check(state, "def", True).head_changed
    assert check(state, "abc", True).reason == "worktree_dirty"
    assert not check(state, "abc", False).is_stale and not check(state, None, False).is_stale


def test_lookups(spark):
    s = symbols(spark, ("a.py", "process", "function", 1, 2, None), ("b.py", "process", "function", 1, 2, None), *[("c.py", f"f{i}", "method", i, i, "C") for i in range(8)])
    rows, cursor = lookup.paged(lookup.get_symbols(s, max_results=3, probe=True), 3)
    assert len(rows) == 3 and cursor
    again, _ = lookup.paged(lookup.get_symbols(s, max_results=3, cursor=cursor, probe=True), 3, cursor)
    assert len(again) == 3 and not {r.symbol_id for r in rows} & {r.symbol_id for r in again}
    last, none = lookup.paged(lookup.get_symbols(s, max_results=20, probe=True), 20)
    assert len(last) == 10 and none is None
    assert [r.file_path for r in lookup.resolve_symbol(s, "process", file_context="b.py").collect()] == ["b.py", "a.py"]
    assert lookup.get_symbols(s, name_pattern="^F[0-3]$").count() == 4
    assert lookup.get_symbol(s, symbol_id="c.py:f1:method:1", symbol_key="x").first().name == "f1"
    for bad in (lambda: lookup.get_symbols(s, kind="nope"), lambda: lookup.get_symbol(s)):
        with pytest.raises(lookup.InvalidArguments):
            bad()


def test_graph(spark):
    e = edges(spark, ("x", "y", "calls", "a"), ("y", "z", "calls", "a"), ("x", None, "calls", "b"), ("A", "B", "inherits", "a"), ("B", "C", "inherits", "a"), ("A", "I", "implements", "a"), ("m", None, "imports", "a"))
    assert [r.target_symbol_id for r in lookup.get_call_graph(e, "x").collect()] == ["y", ""]
    assert [r.source_symbol_id for r in lookup.get_call_graph(e, "z", "incoming").collect()] == ["y"]
    assert [r.target_symbol_id for r in lookup.get_hierarchy(e, "A").collect()] == ["B"]
    assert [r.source_symbol_id for r in lookup.get_hierarchy(e, "B", "descendants").collect()] == ["A"]
    assert {(r.ancestor, r.distance) for r in lookup.ancestors_closure(e, "A").collect()} == {("B", 1), ("C", 2)}
    assert lookup.get_dependents(e, "I").count() == 1 and lookup.get_imports(e, file_path="a").first().edge_id == "0" * 8
    r = lookup.file_summary(symbols(spark, ("a", "f", "function", 3, 4, None)), e, "a").first()
    assert (r.symbol_count, r.edge_count, r.import_count, r.symbols[0].name) == (1, 6, 1, "f")


@pytest.mark.parametrize(
    "content, args, want",
    [("a\nb\nc\n", {}, (1, 3, 3, False)), ("1\n2\n3\n4\n5\n6\n", {"start_line": 3, "end_line": 5}, (3, 5, 6, True)), ("x\n" * 50, {"max_lines": 10}, (1, 10, 50, True)), ("x\n" * 50, {"end_line": 40, "max_lines": 5}, (1, 5, 50, True)), ("", {}, (1, 0, 0, False))],
)
def test_snippet(spark, content, args, want):
    r = lookup.snippet(spark.createDataFrame([("f", content)], "file_path string, content string"), "f", **args).first()
    assert (r.start_line, r.end_line, r.total_lines, r.truncated) == want
    assert r.content == "".join(content.splitlines(True)[r.start_line - 1 : r.end_line])


def chunks_of(spark, content, *syms, **options):
    files = spark.createDataFrame([("f.py", content, "python")], "file_path string, content string, language string")
    return sorted(chunking.chunk_files(files, symbols(spark, *[("f.py", *s) for s in syms]), **options).collect(), key=lambda r: (r.start_line, r.end_line))


def test_chunks_of_a_class(spark):
    text = "import os\nX = 1\n" + "".join(f"line {i}\n" for i in range(3, 12))
    out = chunks_of(spark, text, ("U", "class", 3, 11, None), ("a", "method", 4, 5, "U"), ("b", "method", 6, 8, "U"), ("c", "method", 9, 11, "U"))
    assert [(r.start_line, r.end_line, r.is_symbol_chunk, len(r.symbol_ids)) for r in out] == [(1, 2, False, 0), (3, 11, True, 4)]
    assert "File: f.py" in out[1].embedding_text and "Signature: def U" in out[1].embedding_text and out[1].content == text[text.index("line 3") :]


def test_chunks_of_a_large_class(spark):
    text = "".join(f"l{i}\n" for i in range(1, 19))
    out = chunks_of(spark, text, ("U", "class", 1, 18, None), ("a", "method", 7, 12, "U"), ("b", "method", 13, 18, "U"), large=10)
    assert [(r.start_line, r.end_line, r.is_symbol_chunk) for r in out] == [(1, 6, False), (7, 12, True), (13, 18, True)]
    assert "Class: U" in out[1].embedding_text


def test_chunks_of_functions_and_gaps(spark):
    out = chunks_of(spark, "a\nb\n\nc\nd\n", ("f", "function", 1, 2, None), ("g", "function", 4, 5, None))
    assert [(r.start_line, r.end_line) for r in out] == [(1, 2), (4, 5)]
    assert [(r.start_line, r.end_line) for r in chunks_of(spark, "# c\n" * 100)] == [(1, 50), (41, 90), (81, 100)]
    assert chunks_of(spark, "") == []
    nested = chunks_of(spark, "x\n" * 9, ("f", "function", 1, 6, None), ("in_f", "function", 2, 3, None), ("T", "interface", 7, 9, None), ("in_T", "enum", 8, 8, None))
    assert [(r.start_line, r.end_line) for r in nested] == [(1, 6), (7, 9)]


def test_chunks_of_many_symbols(spark):
    """Spans of random symbols, nested and in any order, against a loop."""
    r = random.Random(3)
    for large in (4, 120):
        syms = []
        for i in range(60):
            start = r.randrange(1, 70)
            kind = r.choice(["class", "class", "method", "method", "method", "function", "enum"])
            syms.append((f"s{i}" if kind != "class" else f"C{r.randrange(9)}x{i}", kind, start, start + r.randrange(9), None))
        classes = [s for s in syms if s[1] == "class"]
        syms = [(*s[:4], r.choice(classes)[0] if s[1] == "method" else None) for s in syms]
        want = []
        for c in classes:
            mine = [s for s in syms if s[1] == "method" and s[4] == c[0] and c[2] <= s[2] <= c[3]]
            want += [(s[2], min(s[3], 80), 2) for s in mine] if mine and c[3] - c[2] + 1 > large else [(c[2], min(c[3], 80), 1 + len(mine))]
        functions, ends = [], [c[2:4] for c in classes]
        for s in sorted((s for s in syms if s[1] == "function"), key=lambda s: (s[2], -s[3], f"f.py:{s[0]}:{s[1]}:{s[2]}")):
            if all(a > s[2] or b < s[2] for a, b in [*(c[2:4] for c in classes), *functions]):
                want.append((s[2], min(s[3], 80), 1))
                ends.append(s[2:4])
            functions.append(s[2:4])
        for s in sorted((s for s in syms if s[1] == "enum"), key=lambda s: (s[2], -s[3], f"f.py:{s[0]}:{s[1]}:{s[2]}")):
            if all(a > s[2] or b < s[2] for a, b in ends):
                want.append((s[2], min(s[3], 80), 1))
            ends.append(s[2:4])
        out = chunks_of(spark, "x\n" * 80, *syms, large=large)
        assert sorted((c.start_line, c.end_line, len(c.symbol_ids)) for c in out if c.is_symbol_chunk) == sorted(want)
        free = [n for n in range(1, 81) if not any(a <= n <= b for a, b, _ in want)]
        assert [n for c in out if not c.is_symbol_chunk for n in range(c.start_line, c.end_line + 1)] == free


def test_names_of_long_texts(spark):
    """The name that an edge asks for, in time linear in the words of its text."""
    want = {"a.b9c(x)": "b9c", "9abc": "abc", "x y ": "y", "f\n (": "f", "a.": "", "(f)": "", "": "", "go().then(a)": "go", "a b9": "b9", "a 9": "", "$x1\t(": "$x1", "é_a": "_a", "a-12b": "b", "import a.b as c": "c"}
    rows = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.n for r in rows.select("t", resolve.named(F.col("t")).alias("n")).collect()} == want
    began = time.time()
    long = spark.range(8).select(F.concat(F.lit("from pkg."), F.repeat(F.lit("n"), F.lit(40_000)), F.lit(" import a."), F.col("id")).alias("t"))
    assert [r.n for r in long.select(resolve.named(F.col("t")).alias("n")).collect()] == [""] * 8
    assert time.time() - began < 8


def test_targets_within_files(spark):
    """Targets found in files' rows, then by names, are those that joins find."""
    from codeloom.plans.parse import operator as parse

    r = random.Random(8)
    texts = ["".join(f"def {r.choice('abcdefghij')}{r.randrange(6)}():\n    return {r.choice('abcdefghijk')}{r.randrange(6)}(1)(2)\n" for _ in range(r.randrange(30))) for _ in range(12)]
    texts += ["import os\nclass A(B, os.C): pass\n", "def f(:\n", "", "x = (lambda: 1)()\n"]
    files = spark.createDataFrame([(f"f{i}.py", "python" if i != 3 else "none", t) for i, t in enumerate(texts)], "file_path string, language string, content string")
    parsed, whole = parse.parse_files(files).cache(), resolve.own_targets(parse.names_held(parse.parse_files(files, whole=True)))
    want = resolve.resolve_targets(parse.edges_of(parsed), parse.symbols_of(parsed))
    found = resolve.resolve_by_name(parse.edges_of(whole), parse.names_of(whole))
    assert found.columns == want.columns and sorted(map(tuple, found.drop("indexed_at").collect()), key=str) == sorted(map(tuple, want.drop("indexed_at").collect()), key=str)
    assert {x.resolution_method for x in found.collect()} == {"same_file", "unique_name", None}


def test_resolvers(spark):
    have = ["src/myapp/__init__.py", "src/myapp/models.py", "src/myapp/auth/__init__.py", "src/myapp/auth/middleware.py", "src/components/Button.tsx", "src/components/index.ts", "src/utils/helpers.ts", "src/foo.service.ts"]
    files = spark.createDataFrame([(p,) for p in have], "file_path string")
    assert [r.root for r in resolve.package_roots(files).collect()] == ["src"]
    asked = [("src/myapp/auth/middleware.py", m) for m in ("myapp.models", "myapp.auth", "..models", ".", "os.path", "numpy", ".gone")]
    out = {r.module: (r.resolved_path, r.is_external) for r in resolve.resolve_python(spark.createDataFrame(asked, "file_path string, module string"), files, ["src"]).collect()}
    assert out == {
        "myapp.models": ("src/myapp/models.py", False), "myapp.auth": ("src/myapp/auth/__init__.py", False), "..models": ("src/myapp/models.py", False),
        ".": ("src/myapp/auth/__init__.py", False), "os.path": (None, True), "numpy": (None, True), ".gone": (None, False),
    }
    asked = [("src/api/client.ts", m) for m in ("../utils/helpers", "../components", "@/utils/helpers", "@components/Button", "react", "../foo.service", "")]
    aliases = {"@/*": ["src/*"], "@components/*": ["src/components/*"]}
    out = {r.module: (r.resolved_path, r.is_external) for r in resolve.resolve_script(spark.createDataFrame(asked, "file_path string, module string"), files, aliases).collect()}
    assert out == {
        "../utils/helpers": ("src/utils/helpers.ts", False), "../components": ("src/components/index.ts", False), "@/utils/helpers": ("src/utils/helpers.ts", False),
        "@components/Button": ("src/components/Button.tsx", False), "react": (None, True), "../foo.service": ("src/foo.service.ts", False), "": (None, False),
    }


def test_vector_search(spark):
    rows = [("c1", "src/a.py", "python", [1.0, 0.0], ["s1"]), ("c2", "src/test_b.py", "python", [0.9, 0.1], []), ("c3", "lib/c.ts", "typescript", [0.0, 1.0], ["s2"]), ("c4", "src/d.py", "python", None, [])]
    t = spark.createDataFrame(rows, "chunk_id string, file_path string, language string, vector array<double>, symbol_ids array<string>")
    ids = lambda **k: [r.chunk_id for r in vector.vector_search(t, [1.0, 0.0], **k).collect()]
    assert ids() == ["c1", "c2", "c3"] and ids(top_k=1) == ["c1"]
    assert ids(exclude_tests=True) == ["c1", "c3"] and ids(language="typescript") == ["c3"] and ids(path_prefix="src/") == ["c1", "c2"]
    s = spark.createDataFrame([("s2", "class")], "symbol_id string, kind string")
    assert ids(symbol_kind="class", symbols=s) == ["c3"]


def test_progress_aggregates(spark):
    f = spark.createDataFrame([("p", "done"), ("p", "todo"), ("q", "failed")], "partition string, state string")
    r = stats.partition_progress(f).first()
    assert r.partition_files_total == {"p": 2, "q": 1} and r.partition_files_done == {"p": 1, "q": 1} and r.files_failed == 1
    e = spark.range(30).select("id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("message"))
    assert stats.last_errors(e, "id").first().errors == [f"e{i}" for i in range(10, 30)]


def test_approximate_statistics(spark):
    sizes = spark.range(1, 1001).select("id", (F.col("id") * 10).alias("size"))
    exact, near = stats.repo_stats(sizes).first(), stats.repo_stats(sizes, 10000).first()
    assert (near.file_count, near.total_bytes) == (exact.file_count, exact.total_bytes) == (1000, 5005000)
    assert abs(near.median_file_tokens - exact.median_file_tokens) < 10 and abs(near.p90_file_tokens - exact.p90_file_tokens) < 10
    assert tuple(stats.repo_stats(sizes.where("false"), 100).first()) == (0, 0, 0, 0, 0, 0)


def test_a_circle_of_ancestors_ends(spark):
    edges = spark.createDataFrame([("a", "b", "inherits"), ("b", "c", "inherits"), ("c", "a", "inherits"), ("c", "d", "inherits"), ("x", "a", "inherits"), ("a", "z", "calls")], "source_symbol_id string, target_symbol_id string, kind string")
    assert {tuple(r) for r in lookup.ancestors_closure(edges, "a").collect()} == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}
    assert lookup.ancestors_closure(edges, "z").count() == 0
    chain = spark.range(30).select(F.col("id").cast("string").alias("source_symbol_id"), (F.col("id") + 1).cast("string").alias("target_symbol_id"), F.lit("inherits").alias("kind"))
    assert lookup.ancestors_closure(chain, "5").agg(F.max("distance"), F.count("*")).first() == (25, 25)


def test_imports_do_not_depend_on_the_order_of_rows(spark):
    files = spark.range(60).select(F.format_string("p/m%d.py", "id").alias("file_path"))
    imports = spark.range(400).select(F.format_string("p/f%d.py", F.col("id") % 40).alias("file_path"), F.format_string("p.m%d", F.col("id") % 90).alias("module")).repartition(7).distinct()
    imports = imports.withColumn("r", F.rand()).orderBy("r").drop("r")  # another order each time it is computed
    found = resolve.resolve_python(imports, files, ["."]).collect()
    assert len(found) == imports.count() and all(r.resolved_path == (f"p/m{r.module[3:]}.py" if int(r.module[3:]) < 60 else None) for r in found)


def test_resolvers_by_language(spark, monkeypatch):
    monkeypatch.setattr(resolve, "RESOLVERS", dict(resolve.RESOLVERS))

    @resolve.register_resolver("go")
    def go(imports, files, aliases):
        return imports.join(files.select(F.col("file_path").alias("resolved_path")), F.expr("resolved_path = concat(module, '.go')"), "left")

    edges = spark.createDataFrame([("a.go", "imports", 'import "lib"'), ("b.rs", "imports", 'use "x"'), ("c.py", "imports", "import d"), ("c.py", "calls", "f()")], "file_path string, kind string, ref_text string")
    files = spark.createDataFrame([("lib.go",), ("d.py",), ("a.go",)], "file_path string")
    assert {tuple(r) for r in resolve.resolve_imports(edges, files).collect()} == {("a.go", "lib", "lib.go"), ("b.rs", "x", None), ("c.py", "d", "d.py")}


@pytest.mark.parametrize("top, n", [(10, 7), (5000, 300), (10**6, 2000), (2**45, 500), (0, 3)])
def test_percentiles_are_exact(spark, monkeypatch, top, n):
    import random

    import numpy as np

    rng = random.Random(top)
    values = [rng.randint(0, top) if rng.random() < 0.7 else top // 2 for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in [*values, None, None]], "size long").repartition(5)
    at = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    theirs = df.agg(F.percentile("size", F.array(*map(F.lit, at)))).first()[0]
    for bins in (4096, 3):
        monkeypatch.setattr(stats, "BINS", bins)
        assert stats.percentiles(df, "size", at) == theirs == pytest.approx(np.percentile(values, [100 * p for p in at]).tolist(), rel=1e-12)


def test_percentiles_of_nothing_and_of_negative_numbers(spark):
    df = spark.createDataFrame([(None,), (None,)], "size long")
    assert stats.percentiles(df, "size", [0.5]) == [None] and stats.percentiles(df.where("false"), "size", [0.5, 0.9]) == [None, None]
    signed = spark.createDataFrame([(x,) for x in (-(2**60), -5, -1, 0, 3, 2**50)], "size long")
    assert stats.percentiles(signed, "size", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) == [-(2.0**60), -5.0, -1.0, 0.0, 3.0, 2.0**50]
