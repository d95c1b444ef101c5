import io
import json
import os
import subprocess
import time

import pytest

from codeloom import api, cli, mcp
from codeloom.operators import lookup
from codeloom.plans import indexer
from codeloom.plans.indexer import Guard, full_index, incremental_index
from codeloom.sources.config import Config, load_config, load_tsconfig
from codeloom.sources.files import read_tree, walk
from codeloom.sources.files_io import Lock, LockHeld
from codeloom.sources.git import Git
from codeloom.sources.store import Store
from codeloom.streaming import metrics

MAIN = "from utils import helper\n\nclass Calculator(Base):\n    def add(self, a, b):\n        return helper(a) + b\n\ndef main():\n    helper(1)\n"


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=x", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    write(root, {"main.py": MAIN, "utils.py": "def helper(x):\n    return x\n", "pkg/__init__.py": "", "server.ts": "export function createServer(): void { go(); }\n", "bad.py": "def (\n", ".gitignore": ".codeloom/\nout.py\n", "out.py": "x = 1\n", "vendor/v.py": "y = 1\n"})
    git(root, "init")
    git(root, "add", "-A")
    git(root, "commit", "-m", "one")
    return root


def test_index_query_and_reindex(spark, repo, capsys):
    assert cli.main(["status", "--repo-root", repo, "--exit-stale"], spark) == 3
    assert cli.main(["index", "--repo-root", repo, "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (out["generation"], out["files_indexed"], out["files_failed"]) == (1, 5, 0)
    store = cli.open_store(spark, repo, load_config(repo))
    server = api.Server(spark, repo, store)
    s = metrics.Progress.read(os.path.join(repo, ".codeloom", "progress.json"))
    assert (s["state"], s["files_total"], s["files_done"], s["partitions_done"], s["partition_files_total"]) == ("completed", 5, 5, 2, {".": 4, "pkg": 1})
    assert {r.file_path for r in store.read("manifest").collect()} == {"main.py", "utils.py", "pkg/__init__.py", "server.ts", "bad.py"}
    found = server.call("get_symbols", {"name_pattern": "calc"})
    assert [s["name"] for s in found["symbols"]] == ["Calculator"] and found["_meta"]["generation"] == 1 and not found["_meta"]["stale"]
    helper = server.call("resolve_symbol", {"name": "helper"})["candidates"][0]
    assert {d["source_symbol_id"] for d in server.call("get_dependents", {"symbol_key": helper["symbol_key"]})["dependents"]} == {"main.py:add:method:4", "main.py:main:function:7"}
    assert server.call("find_references", {})["error"] == "invalid_args"
    assert server.call("get_snippet", {"file_path": "../x"})["error"] == "invalid_args"
    assert server.call("nope")["error"] == "Unknown tool: nope"
    assert server.call("semantic_search", {"query": "helper return x", "max_results": 1})["results"][0]["file_path"] == "utils.py"
    assert server.call("get_file_summary", {"file_path": "main.py"})["symbol_count"] == 3
    assert server.call("get_repo_overview")["file_count"] == 5 and len(server.list_tools()) == 16
    assert server.session.metrics()["total_naive"] > 0 and "error" in server.read_resource("x") and server.read_resource("codeloom://status")["indexed"]

    write(repo, {"main.py": MAIN + "\ndef multiply(a, b):\n    return a * b\n"})
    os.remove(os.path.join(repo, "bad.py"))
    assert {c["file_path"]: c["status"] for c in server.call("get_changed_files")["changes"]} == {"main.py": "modified", "bad.py": "deleted"}
    assert "multiply" in server.call("get_diff", {"file_path": "main.py"})["diff"]
    assert cli.main(["index", "--repo-root", repo, "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (out["generation"], out["files_indexed"], out["files_deleted"]) == (2, 1, 1)
    names = {r.name for r in store.read("symbols").collect()}
    assert {"multiply", "helper", "createServer"} <= names and store.read("diagnostics").count() == 0
    assert store.read("symbols", 1).count() == 5  # the generation before is whole
    assert [r.file_path for r in indexer.changes_since(spark, Git(repo, ".codeloom/index"), store.read("manifest"), store.read("manifest"), store.state().workspace_state.head_commit).collect()] == ["main.py"]
    git(repo, "add", "-A")
    git(repo, "commit", "-m", "two")
    assert incremental_index(spark, repo, store).generation == 3  # the manifest knows all, but the commit is another
    assert incremental_index(spark, repo, store).generation == 3  # nothing changed
    assert store.compact(1) == {"status": "ok", "kept": [3], "dropped": [1, 2]}
    assert cli.main(["doctor", "--repo-root", repo], spark) == 0 and cli.main(["progress", "--repo-root", repo], spark) == 0
    lock = Lock(os.path.join(repo, ".codeloom", "index.lock"))
    with lock:
        assert cli.main(["index", "--repo-root", repo], spark) == 2


def test_no_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "idx"))
    server = api.Server(spark, str(tmp_path), store)
    assert server.index_state() == (0, True) and server.call("get_symbols")["symbols"] == [] and server.call("get_repo_overview")["indexed"] is False
    assert server.call("semantic_search", {"query": "x"})["error"] == "no_index"
    assert incremental_index(spark, str(tmp_path), store).needs_full_index
    assert cli.main(["doctor", "--repo-root", str(tmp_path)], spark) == 4


def test_tree_source(spark, tmp_path):
    write(str(tmp_path), {"a/__init__.py": "x\r\ny", ".hidden/b.py": "", "node_modules/c.js": "", "d.py": "z"})
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    assert walk(str(tmp_path)) == ["a/__init__.py", "bad.py", "d.py"]
    rows = {r.file_path: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert rows["a/__init__.py"].content == "x\ny" and rows["bad.py"].content == "\ufffd\ufffd" and rows["d.py"].size == 1


def test_git(repo, tmp_path):
    g = Git(repo)
    assert g.is_repo() and len(g.head()) == 40 and "vendor/v.py" in g.tracked() and "out.py" not in g.tracked()
    assert g.ignored(["out.py", "main.py"]) == ["out.py"] and g.submodules() == [] and g.mtime("HEAD") > 0 and g.mtime("none") == 0.0
    none = Git(str(tmp_path))
    assert not none.is_repo() and none.head() is None and none.diff("x") is None


def test_config(tmp_path):
    assert load_config(str(tmp_path)).index.exclude == ["vendor/**", "generated/**", "**/*.min.js"]
    write(str(tmp_path), {".codeloom/config.toml": "[index]\nmin_partition_files = 4\nunknown = 1\n", "tsconfig.json": '{ // c\n "compilerOptions": {"paths": {"@/*": ["./src/*"]}} /* x */ }'})
    assert load_config(str(tmp_path)).index.min_partition_files == 4 and not hasattr(load_config(str(tmp_path)).index, "unknown")
    assert load_tsconfig(str(tmp_path)) == {"@/*": ["./src/*"]}
    write(str(tmp_path), {".codeloom/config.toml": "[[["})
    assert load_config(str(tmp_path)) == Config()
    assert cli.main(["init", "--repo-root", str(tmp_path), "--dry-run"]) == 0 and cli.main(["languages", "--json"]) == 0


def test_lock(tmp_path):
    lock = Lock(str(tmp_path / "l"))
    with lock, pytest.raises(LockHeld):
        Lock(lock.path).acquire()
    assert not lock.is_locked()
    for text in ("junk", json.dumps({"pid": 2**22 + 1, "host": __import__("socket").gethostname(), "acquired_at": "2999-01-01T00:00:00+00:00"}), json.dumps({"pid": 1, "host": "other", "acquired_at": "2000-01-01T00:00:00+00:00"})):
        (tmp_path / "l").write_text(text)
        assert lock.break_if_stale() and not os.path.exists(lock.path)


def test_guard():
    g = Guard()
    assert g.try_start() and not g.try_start() and g.is_pending and g.finish() and g.try_start() and not g.finish()
    assert Guard.should_block(True, 5) and Guard.should_block(True, -1) and not Guard.should_block(True, 6) and not Guard.should_block(False, 1)


def test_progress(tmp_path):
    p = metrics.Progress(str(tmp_path / "p.json"))
    assert metrics.payload(p.snapshot()) == {"active": False, "progress": None}
    p.start()
    p.register({"src": 2, "lib": 1})
    p.running()
    p.file_done("src", "a")
    p.file_done("lib", "b", "boom")
    s = metrics.Progress.read(p.path)
    assert (s["state"], s["files_done"], s["files_failed"], s["partitions_done"], s["errors"]) == ("running", 1, 1, 1, ["b: boom"])
    for i in range(30):
        p.file_done("src", f"f{i}", "e")
    assert len(p.snapshot()["errors"]) == 20
    p.complete()
    p.running()
    assert p.snapshot()["state"] == "completed" and p.active is None and "completed" in metrics.progress_line(p.snapshot())


def test_log(tmp_path):
    from codeloom.sources import log

    for _ in range(2):
        logger = log.setup(str(tmp_path), Config({"server": {"log_file": "x.log", "log_level": "debug", "log_max_size_mb": "big"}}), "codeloom.test")
    logger.debug("hello %s", "there", extra={"files": 3})
    lines = [json.loads(x) for x in (tmp_path / "x.log").read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["message"] == "hello there" and lines[0]["files"] == 3 and lines[0]["level"] == "debug"


def test_session(tmp_path):
    s = metrics.Session(str(tmp_path))
    for naive, actual in ((5000, 800), (3000, 400), (4000, 600)):
        s.record("t", naive, actual)
    assert s.metrics()["total_saved"] == 10200 and s.metrics()["percent_saved"] == 85.0 and s.saved == 10200
    assert s.delta() == {"calls": 3, "saved": 10200} and s.delta() == {"calls": 0, "saved": 0}
    s.end()
    assert s.delta() == {"calls": 3, "saved": 10200} and metrics.Session.last(str(tmp_path)) is None
    s.persist()
    assert metrics.Session.last(str(tmp_path))["total_saved"] == 10200
    assert json.loads((tmp_path / "last-session.json").read_text())["metrics"]["total_naive"] == 12000 and "| t | 3 | 10,200 |" in s.markdown()


def test_hooks(tmp_path, capsys):
    root, folder = str(tmp_path), str(tmp_path / ".codeloom" / "metrics")
    assert cli.main(["on-stop", "--repo-root", root]) == cli.main(["on-session-end", "--repo-root", root]) == 0
    s = metrics.Session(folder)
    s.record("get_symbols", 2000, 500)
    s.record("get_symbol", 10, 90)
    s.persist()
    assert cli.main(["on-stop", "--repo-root", root]) == 1 and "~1.4k tokens saved, 2 calls" in capsys.readouterr().err
    assert cli.main(["on-stop", "--repo-root", root]) == 0 and capsys.readouterr().err == ""
    s.record("get_snippet", 3_000_000, 1)
    s.persist()
    assert cli.main(["on-stop", "--repo-root", root]) == 1 and "~3.0M tokens saved, 3 calls" in capsys.readouterr().err
    assert cli.main(["on-session-end", "--repo-root", root]) == 1
    lines = capsys.readouterr().err.splitlines()
    assert [x.split()[0] for x in lines[1:]] == ["get_snippet", "get_symbols", "total:"] and not os.path.exists(os.path.join(folder, "last-reported.json"))


def test_streams(spark, tmp_path):
    calls = spark.createDataFrame([("s", "a", 10, 4), ("s", "a", 1, 5), ("u", "b", 7, 7)], "session_id string, tool string, naive_tokens long, actual_tokens long")
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    out = metrics.stream_to_table(metrics.running_metrics(stream), "live_metrics", str(tmp_path / "ck"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, metrics.running_metrics(calls).collect())) == [("s", "a", 2, 11, 9, 6), ("u", "b", 1, 7, 7, 0)]


def test_watch(spark, repo, tmp_path):
    seen = []
    query = metrics.watch(spark, repo, lambda: seen.append(1) or 1 / 0, str(tmp_path / "ck"), 0.2)
    try:
        time.sleep(4)
        os.utime(os.path.join(repo, ".git", "HEAD"))
        for _ in range(60):
            if seen:
                break
            time.sleep(0.5)
        assert seen and query.isActive
    finally:
        query.stop()


def rows_of(store, table):
    """A table's rows without what tells one run from another."""
    df = store.read(table).drop("index_generation", "indexed_at", "vector_updated_at")
    if table == "manifest":
        df = df.drop("mtime")
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("tracked", [True, False])
def test_incremental_equals_full(spark, tmp_path, tracked):
    root = str(tmp_path / "tree")
    write(root, {
        "a.py": "def helper(x):\n    return x\n\nclass Base:\n    pass\n",
        "b.py": "from a import helper, Base\nimport late\n\nclass Mine(Base):\n    def run(self):\n        return helper(1) + only() + late.soon()\n",
        "c.py": "def only():\n    return helper(2)\n\ndef gone():\n    return 1\n",
        "d.py": "gone()\nhelper(3)\nsoon()\n",
        "e.ts": "import { f } from './f';\nexport const g = (): number => f(1);\n",
        "h.go": "package h\n\nfunc H() int { return soon() }\n",
        "pkg/__init__.py": "",
    })
    if tracked:
        git(root, "init")
        git(root, "add", "-A")
        git(root, "commit", "-m", "one")
    store = Store(spark, str(tmp_path / "idx"))
    parsed = spark.sparkContext.accumulator(0)
    first = full_index(spark, root, store, counter=parsed)
    assert parsed.value == first.files_indexed == 7 and first.embedding_tokens > 0
    steps = [
        # moved symbols
        ({"a.py": "# one\n\n\n\ndef helper(x):\n    return x\n\nclass Base:\n    pass\n"}, [], 1),
        # an added file: a name that was the only one is not, an import and a call get a target
        ({"late.py": "def soon():\n    return 1\n\ndef only():\n    return 2\n", "f.ts": "export function f(x: number): number { return x; }\n"}, [], 2),
        # a deleted file, and a symbol that moves from one file to another
        ({"c.py": "def helper(x):\n    return 2\n", "d.py": "gone()\nhelper(3)\n\ndef gone():\n    pass\n"}, ["a.py"], 2),
        # nothing but a deletion
        ({}, ["f.ts"], 0),
    ]
    for k, (files, gone, count) in enumerate(steps):
        write(root, files)
        for name in gone:
            os.remove(os.path.join(root, name))
        parsed = spark.sparkContext.accumulator(0)
        out = incremental_index(spark, root, store, counter=parsed)
        assert (out.files_indexed, out.files_deleted, parsed.value, out.embedding_errors) == (count, len(gone), count, 0)
        fresh = Store(spark, str(tmp_path / f"full{k}"))
        full_index(spark, root, fresh)
        for table in ("symbols", "edges", "chunks", "diagnostics", "manifest", "imports"):
            assert rows_of(store, table) == rows_of(fresh, table), (k, table)
        ids = {r.symbol_id for r in store.read("symbols").collect()}
        assert all(r.target_symbol_id in ids for r in store.read("edges").where("target_symbol_id IS NOT NULL").collect())
        assert store.read("chunks").where("NOT has_vector").isEmpty()


def test_errors_of_files_are_kept(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(root, {f"g{i}.py": "x = 1\n" for i in range(25)})
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "z.py"))
    out = full_index(spark, root, Store(spark, str(tmp_path / "idx")))
    assert (out.files_indexed, out.files_failed) == (25, 1) and [e.split(":")[0] for e in out.errors] == ["z.py"]


def test_store_pages(spark, tmp_path):
    store = Store(spark, str(tmp_path / "idx"))
    root = str(tmp_path / "tree")
    write(root, {f"p{i}.py": f"import q\n\ndef f{i}():\n    return q.x({i})\n" for i in range(4)} | {"bad.py": "def (\n"})
    full_index(spark, root, store, embedding=False)
    pages, cursor = [], None
    while True:
        rows, cursor = lookup.paged(store.get_edges(cursor, 3, probe=True, kind="imports"), 3, cursor)
        pages.append(len(rows))
        if cursor is None:
            break
    assert pages == [3, 1]
    assert {r.file_path for r in store.get_chunks("p1.py").collect()} == {"p1.py"} and store.get_chunks(has_vector=True).isEmpty()
    assert store.get_chunks(has_vector=False).count() == store.read("chunks").count() > 4
    assert [r.file_path for r in store.get_diagnostics().collect()] == ["bad.py"]
    store.set_diagnostics(store.read("diagnostics").where("file_path = ''"))
    assert store.get_diagnostics().count() == 1
    store.set_diagnostics(spark.createDataFrame([("p1.py", "warn", 1)], "file_path string, parse_status string, error_count int"))
    assert [r.parse_status for r in store.get_diagnostics().collect()] == ["warn"]


def test_staleness_when_the_commit_is_gone(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(root, {"a.py": "x = 1\n"})
    git(root, "init")
    git(root, "add", "-A")
    git(root, "commit", "-m", "one")
    config = Config({"server": {"auto_reindex": True, "check_interval": 0}})
    store = Store(spark, str(tmp_path / "idx"))
    full_index(spark, root, store, config)
    git(root, "commit", "--amend", "-m", "two")
    git(root, "reflog", "expire", "--expire=now", "--all")
    git(root, "gc", "--prune=now")
    server = api.Server(spark, root, store, config)
    row = api.check_staleness(server).first()
    assert (row.is_stale, row.reason, row.changed_file_count) == (True, "head_changed", -1)
    write(root, {"a.py": "def late():\n    return 1\n"})
    assert [s["name"] for s in server.call("get_symbols")["symbols"]] == ["late"] and store.generation() == 2


def test_submodules_and_ignored_files(spark, tmp_path):
    inner, root = str(tmp_path / "inner"), str(tmp_path / "tree")
    write(inner, {"s.py": "y = 1\n"})
    git(inner, "init")
    git(inner, "add", "-A")
    git(inner, "commit", "-m", "one")
    write(root, {"a.py": "x = 1\n", ".gitignore": "out.py\n", "out.py": "z = 1\n"})
    git(root, "init")
    git(root, "-c", "protocol.file.allow=always", "submodule", "add", inner, "lib/inner")
    assert {"a.py", "lib/inner/s.py"} <= set(Git(root).tracked()) and "lib/inner" not in Git(root).tracked()
    for mode in ("git", "walk"):
        found = {r.file_path for r in read_tree(spark, root, mode).collect()}
        assert {"a.py", "lib/inner/s.py"} <= found and "out.py" not in found


def test_protocol(spark, tmp_path):
    server = api.Server(spark, str(tmp_path), Store(spark, str(tmp_path / "idx")), session=metrics.Session(str(tmp_path / "m")))
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05", "capabilities": {}, "clientInfo": {"name": "t", "version": "0"}}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": "x", "method": "tools/call", "params": {"name": "get_symbols", "arguments": {"kind": "class"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nope"}},
        {"jsonrpc": "2.0", "id": 5, "method": "resources/list"},
        {"jsonrpc": "2.0", "id": 6, "method": "resources/read", "params": {"uri": "codeloom://languages"}},
        {"jsonrpc": "2.0", "id": 7, "method": "resources/read", "params": {"uri": "codeloom://x"}},
        {"jsonrpc": "2.0", "id": 8, "method": "prompts/list"},
        {"jsonrpc": "2.0", "id": 9, "method": "ping"},
    ]
    out = io.StringIO()
    mcp.serve(server, [*map(json.dumps, lines), "", "{", "[]"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, "x", 4, 5, 6, 7, 8, 9, None, None] and all(x["jsonrpc"] == "2.0" for x in got)
    by = {x["id"]: x for x in got}
    assert by[1]["result"]["protocolVersion"] == "2024-11-05" and set(by[1]["result"]["capabilities"]) == {"tools", "resources"}
    assert len(by[2]["result"]["tools"]) == 16 and all(t["inputSchema"]["type"] == "object" for t in by[2]["result"]["tools"])
    answer = by["x"]["result"]
    assert not answer["isError"] and json.loads(answer["content"][0]["text"])["symbols"] == []
    assert by[4]["result"]["isError"] and len(by[5]["result"]["resources"]) == 4 and "python" in by[6]["result"]["contents"][0]["text"]
    assert by[7]["error"]["code"] == -32602 and by[8]["error"]["code"] == -32601 and by[9]["result"] == {} and [x["error"]["code"] for x in got[-2:]] == [-32700, -32600]


def test_model_files(tmp_path, monkeypatch):
    from codeloom.functions import embed

    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.delenv("HF_HOME", raising=False)
    with pytest.raises(embed.ProviderUnavailable):
        embed.model_file()
    write(str(tmp_path), {".cache/huggingface/hub/models--o--m/snapshots/1/onnx/model.onnx": "", ".cache/codeloom/models/model.onnx": "", "own.onnx": ""})
    assert embed.model_file("o/m").endswith("models--o--m/snapshots/1/onnx/model.onnx") and embed.model_file() == str(tmp_path / ".cache/codeloom/models/model.onnx")
    assert embed.model_file(str(tmp_path / "own.onnx")) == str(tmp_path / "own.onnx")
    assert embed.dimension_of(Config({"embedding": {"model": "voyage-code-3"}}).embedding) == 1024 and embed.dimension_of(Config().embedding) is None
