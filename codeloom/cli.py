"""Command line: init, index, status, progress, doctor, languages, serve; on-stop and on-session-end for a client's hooks.

Exit codes: 0 done, 1 error, 2 index locked, 3 stale (with --exit-stale), 4 doctor found issues. A hook that has savings to
show writes them to the error stream and ends with 1, which makes clients show them.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from codeloom import api, mcp
from codeloom.plans.indexer import full_index, incremental_index
from codeloom.sources.config import config_path, default_config, load_config, save_default_config
from codeloom.sources.files_io import Lock, LockHeld
from codeloom.sources.git import Git
from codeloom.sources.store import Store
from codeloom.streaming.metrics import Progress, Session, human, payload, progress_line, session_lines


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("codeloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def place(root: str, *parts: str) -> str:
    return os.path.join(root, ".codeloom", *parts)


def open_store(spark, root: str, config) -> Store:
    path = config.paths.index_dir
    return Store(spark, path if "://" in path or os.path.isabs(path) else os.path.join(os.path.abspath(root), path))


def bootstrap(spark, root: str, config=None, force: bool = False, embedding: bool = True):
    """A first index, or a reindex of what changed, under the lock."""
    if not os.path.exists(config_path(root)):
        save_default_config(config_path(root))
    config = config or load_config(root)
    store = open_store(spark, root, config)
    progress = Progress.of(root, place(root, "progress.json"))
    with Lock(place(root, "index.lock")):
        progress.start("full" if force or not store.generation() else "incremental")
        try:
            if force or not store.generation():
                out = full_index(spark, root, store, config, embedding, progress)
            else:
                progress.running()
                out = incremental_index(spark, root, store, config, embedding)
            if store.generation() % config.compaction.auto_compact_interval == 0:
                store.compact(config.compaction.keep_generations)
        except Exception as e:
            progress.fail(str(e)[:500])
            raise
        progress.complete()
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, *flags):
        p = commands.add_parser(name)
        p.add_argument("--repo-root", default=".")
        for flag in flags:
            p.add_argument(flag, action="store_true")
        return p

    command("init", "--dry-run")
    command("index", "--force", "--no-embed", "--break-stale-lock", "--progress", "--json").add_argument("--provider")
    command("status", "--json", "--exit-stale")
    command("progress", "--json", "--watch").add_argument("--interval-ms", type=int, default=250)
    command("doctor")
    command("languages", "--json")
    command("serve")
    command("on-stop")
    command("on-session-end")
    a = parser.parse_args(argv)
    root = os.path.abspath(a.repo_root)
    config = load_config(root)
    if a.command == "init":
        if a.dry_run:
            print(default_config())
        elif os.path.exists(config_path(root)):
            print(f"{config_path(root)} exists")
        else:
            save_default_config(config_path(root))
            print(f"wrote {config_path(root)}")
        return 0
    if a.command == "languages":
        found = api.languages()
        print(json.dumps(found) if a.json else "\n".join(f"{k}: {', '.join(v)}" for k, v in found.items()))
        return 0
    if a.command == "on-stop":
        new = Session.report(place(root, "metrics"))
        if new:
            print(f"codeloom: {human(new['saved'])} tokens saved, {new['calls']} calls", file=sys.stderr)
        return 1 if new else 0
    if a.command == "on-session-end":
        lines = session_lines(Session.last(place(root, "metrics")) or {})
        Session.forget(place(root, "metrics"))
        if lines:
            print("\n".join(lines), file=sys.stderr)
        return 1 if lines else 0
    if a.command == "progress":
        before = None
        while True:
            s = Progress.read(place(root, "progress.json"))
            line = json.dumps(payload(s)) if a.json else progress_line(s) if s else "no operation"
            if line != before:
                print(before := line, flush=True)
            if not a.watch or s is None or s["state"] in ("completed", "failed", "cancelled"):
                return 0
            time.sleep(max(10, a.interval_ms) / 1000)
    lock = Lock(place(root, "index.lock"))
    if a.command == "index":
        if a.break_stale_lock:
            lock.break_if_stale()
        if lock.is_locked():
            print("the index is locked", file=sys.stderr)
            return 2
        if a.provider:
            config.embedding.provider = a.provider
        try:
            out = bootstrap(spark or session(), root, config, a.force, not a.no_embed)
        except LockHeld:
            print("the index is locked", file=sys.stderr)
            return 2
        except Exception as e:  # noqa: BLE001
            print(f"error: {e}", file=sys.stderr)
            return 1
        print(json.dumps(vars(out)) if a.json else f"generation {out.generation}: {out.files_indexed} files, {out.symbols} symbols, {out.edges} edges, {out.chunks} chunks, {out.files_failed} failed")
        return 0
    spark = spark or session()
    server = api.Server(spark, root, open_store(spark, root, config), config, Session(place(root, "metrics")))
    if a.command == "status":
        stale = api.check_staleness(server).first().asDict()
        out = server.get_repo_overview() | {"stale": stale["is_stale"], "reason": stale["reason"], "changed_file_count": stale["changed_file_count"]}
        out.pop("_naive_tokens", None)
        print(json.dumps(out) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
        return 3 if a.exit_stale and stale["is_stale"] else 0
    if a.command == "doctor":
        issues = [
            text
            for bad, text in (
                (not os.path.isdir(place(root)), "no .codeloom directory: run init"),
                (not server.store.generation(), "no index: run index"),
                (lock.is_locked(), "the index lock is held"),
                (not Git(root).is_repo(), "not a git repository"),
            )
            if bad
        ]
        print("\n".join(issues) or "no issues")
        return 4 if issues else 0
    mcp.serve(server, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
