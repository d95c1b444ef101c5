"""The tool and resource interface: named queries with arguments, answered as JSON-ready dictionaries.

Every answer has an envelope ``_meta``; a baseline cost (the tokens of reading the files that the answer
draws on) is kept for the session's metrics. Answers are pages, so they are small.
"""

from __future__ import annotations

import json
import logging
import math
import os
import subprocess
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from codeloom import __version__
from codeloom.functions import embed
from codeloom.functions.scalars import LANGUAGES, TOKENS_PER_BYTE
from codeloom.operators import lookup, planning, stats, trigrams, vector
from codeloom.operators.lookup import InvalidArguments
from codeloom.plans.indexer import Guard, incremental_index
from codeloom.schemas import PAGE, SYMBOL_KINDS
from codeloom.sources.config import Config
from codeloom.sources.files_io import Lock, LockHeld
from codeloom.sources.git import Git
from codeloom.sources.store import Store
from codeloom.streaming.metrics import Progress, Session, payload

SCHEMA_VERSION = 1


class NoIndex(RuntimeError):
    """There is no index yet."""


class ProviderMismatch(RuntimeError):
    """The index was embedded by another provider."""


class Blocked(RuntimeError):
    """The index is being rebuilt."""


# The error codes of answers.
CODES = {NoIndex: "no_index", embed.ProviderUnavailable: "provider_unavailable", ProviderMismatch: "provider_mismatch", LockHeld: "index_locked", InvalidArguments: "invalid_args", Blocked: "blocked"}


def error_of(e: Exception, details: dict | None = None) -> dict:
    code = next((c for k, c in CODES.items() if isinstance(e, k)), "internal_error")
    return {"error": code, "message": str(e)} | ({"details": details} if details else {})


def paginated(meta: dict, data: dict, total: int, returned: int, cursor: str | None = None) -> dict:
    return {"_meta": meta} | data | {"total_count": total, "returned_count": returned} | ({"next_cursor": cursor} if cursor else {})


def plain(row) -> dict:
    return row.asDict(recursive=True)


@dataclass
class Tool:
    run: Callable
    parameters: dict
    required: tuple = ()


class Server:
    """Answers tool calls over a store, a repository and a session."""

    def __init__(self, spark, root: str, store: Store, config: Config | None = None, session: Session | None = None, progress: Progress | None = None):
        self.spark, self.root, self.store = spark, os.path.abspath(root), store
        self.config, self.session, self.progress = config or Config(), session or Session(), progress or Progress.of(root)
        self.git = Git(root, self.config.paths.index_dir)
        self.guard, self.looked = Guard(), -math.inf
        text, number = {"type": "string"}, {"type": "integer"}
        edge = {"symbol_id": text, "symbol_key": text}
        self.tools = {
            "get_symbols": Tool(self.get_symbols, {"file_path": text, "kind": text, "name_pattern": text, "max_results": number | {"default": PAGE["symbols"]}, "cursor": text}),
            "get_symbol": Tool(self.get_symbol, edge),
            "get_imports": Tool(self.get_imports, {"file_path": text, "symbol_id": text}),
            "get_dependents": Tool(self.get_dependents, edge),
            "get_call_graph": Tool(self.get_call_graph, {"symbol_id": text, "direction": text | {"enum": ["outgoing", "incoming"], "default": "outgoing"}}, ("symbol_id",)),
            "get_hierarchy": Tool(self.get_hierarchy, {"symbol_id": text, "direction": text | {"enum": ["ancestors", "descendants"], "default": "ancestors"}}, ("symbol_id",)),
            "find_references": Tool(self.find_references, edge),
            "resolve_symbol": Tool(self.resolve_symbol, {"name": text, "kind": text, "file_context": text}, ("name",)),
            "get_snippet": Tool(self.get_snippet, {"file_path": text, "start_line": number | {"default": 1}, "end_line": number | {"default": 0}, "max_lines": number | {"default": PAGE["snippet_lines"]}}, ("file_path",)),
            "get_diff": Tool(self.get_diff, {"file_path": text, "base_ref": text, "head_ref": text, "context_lines": number | {"default": 3}}, ("file_path",)),
            "get_changed_files": Tool(self.get_changed_files, {"base_ref": text, "head_ref": text | {"default": "HEAD"}, "include_worktree": {"type": "boolean", "default": True}}),
            "semantic_search": Tool(self.semantic_search, {"query": text, "max_results": number | {"default": PAGE["vector"]}, "file_filter": text}, ("query",)),
            "get_file_summary": Tool(self.get_file_summary, {"file_path": text}, ("file_path",)),
            "get_repo_overview": Tool(self.get_repo_overview, {}),
            "get_session_metrics": Tool(self.get_session_metrics, {}),
            "get_index_progress": Tool(self.get_index_progress, {"operation_id": text}),
        }

    # routing

    def list_tools(self) -> list[dict]:
        return [{"name": n, "inputSchema": {"type": "object", "properties": t.parameters, "required": list(t.required)}} for n, t in self.tools.items()]

    def index_state(self) -> tuple[int, bool]:
        """Generation and staleness; (0, True) without an index."""
        try:
            state = self.store.state()
            if state is None:
                return 0, True
            head, stored = self.git.head(), state.workspace_state.head_commit
            return state.generation, bool(head and stored and head != stored) or self.git.is_dirty()
        except Exception:  # noqa: BLE001  whatever is wrong, there is no usable index
            return 0, True

    def handle(self, tool: str, arguments: dict | None = None) -> dict:
        """An answer without its envelope; failures are answers too."""
        known = self.tools.get(tool)
        if known is None:
            return {"error": f"Unknown tool: {tool}"}
        arguments = {k: v for k, v in (arguments or {}).items() if k in known.parameters}
        try:
            missing = [p for p in known.required if not arguments.get(p)]
            if missing:
                raise InvalidArguments(f"missing: {', '.join(missing)}")
            return known.run(**arguments)
        except Exception as e:  # noqa: BLE001
            return error_of(e)

    def refresh(self) -> bool:
        """Brings a stale index up to date: here if few files changed, else in the background; one run at a time. True if a run was begun."""
        row = check_staleness(self).first()
        if row.reason == "no_index" or not row.is_stale or not self.guard.try_start():
            return False

        def run():
            again = True
            while again:
                try:
                    with Lock(os.path.join(self.root, ".codeloom", "index.lock")):
                        incremental_index(self.spark, self.root, self.store, self.config)
                except LockHeld:  # another process is at it
                    pass
                finally:
                    again = self.guard.finish() and self.guard.try_start()

        if self.guard.should_block(row.is_stale, row.changed_file_count, self.config.server.max_blocking_reindex_files):
            run()
        else:
            threading.Thread(target=run, daemon=True).start()
        return True

    def _look(self) -> None:
        """Refreshes, if the configuration asks for it and the last look is long enough ago; a failed run leaves the index as it is."""
        now = time.monotonic()
        if not self.config.server.auto_reindex or now - self.looked < self.config.server.check_interval:
            return
        self.looked = now
        try:
            self.refresh()
        except Exception:  # noqa: BLE001
            logging.getLogger("codeloom").exception("reindexing failed")

    def call(self, tool: str, arguments: dict | None = None) -> dict:
        self._look()
        began = time.monotonic()
        data = self.handle(tool, arguments)
        naive = data.pop("_naive_tokens", 0)
        actual = math.ceil(len(json.dumps(data, default=str)) * TOKENS_PER_BYTE)
        if naive > 0:
            self.session.record(tool, naive, actual)
            self.session.persist()
        generation, stale = self.index_state()
        meta = {
            "schema_version": SCHEMA_VERSION, "server_version": __version__, "request_id": uuid.uuid4().hex[:8], "generation": generation, "stale": stale,
            "duration_ms": round((time.monotonic() - began) * 1000), "session_tokens_saved": self.session.saved,
        }
        out = {"_meta": meta} | data
        if naive > actual:
            out["_hint"] = f"saved about {naive - actual} tokens against reading the files"
        return out

    # costs

    def _first(self, df, default=0):
        row = df.first()
        return row[0] if row and row[0] is not None else default

    def _cost_of_rows(self, rows) -> int:
        return self._first(stats.naive_tokens(rows, self.store.read("manifest")))

    def _cost_of_file(self, path: str | None) -> int:
        if path:
            return self._first(stats.naive_tokens_of_file(self.store.read("manifest"), path))
        return self._state("repo_stats.total_tokens")

    def _state(self, field: str):
        return self._first(self.store.read("state").select(field))

    def _edges_answer(self, name: str, rows, **more) -> dict:
        found = [plain(r) for r in rows.collect()]
        paths = self.spark.createDataFrame([(r.get("file_path"),) for r in found if r.get("file_path")], "file_path string")
        return {name: found, "count": len(found), "_naive_tokens": self._cost_of_rows(paths)} | more

    def _id(self, symbol_id, symbol_key) -> str:
        """An id, or the id of a key."""
        if symbol_id:
            return symbol_id
        if not symbol_key:
            raise InvalidArguments("symbol_id or symbol_key is required")
        row = lookup.get_symbol(self.store.read("symbols"), symbol_key=symbol_key).first()
        if row is None:
            raise InvalidArguments(f"no symbol has the key {symbol_key!r}")
        return row.symbol_id

    # tools

    def get_symbols(self, file_path=None, kind=None, name_pattern=None, max_results=PAGE["symbols"], cursor=None):
        only = (lambda rows: lookup.query_symbols(rows, file_path, kind, name_regex=name_pattern)) if file_path or kind or name_pattern else None
        generation = self.store.generation()
        if file_path:
            buckets = {self.store.bucket(file_path, generation)}
        else:
            buckets = trigrams.buckets_with(self.store, name_pattern, generation=generation) if name_pattern else None
        lookup.kind_of(kind, SYMBOL_KINDS)  # also where no bucket is read
        rows, following = self.store.page("symbols", max_results, cursor, only, lookup.SYMBOL_COLUMNS, buckets, generation)
        return {"symbols": [plain(r) for r in rows], "next_cursor": following, "count": len(rows), "_naive_tokens": self._cost_of_file(file_path)}

    def get_symbol(self, symbol_id=None, symbol_key=None):
        row = lookup.get_symbol(self.store.read("symbols"), symbol_id, symbol_key).first()
        return {"symbol": plain(row) if row else None, "_naive_tokens": self._cost_of_file(row.file_path) if row else 0}

    def get_imports(self, file_path=None, symbol_id=None):
        cost = self._cost_of_file(file_path) if file_path else self._state("repo_stats.median_file_tokens")
        return self._edges_answer("imports", lookup.get_imports(self.store.read("edges", files=[file_path] if file_path else None), file_path, symbol_id)) | {"_naive_tokens": cost}

    def get_dependents(self, symbol_id=None, symbol_key=None):
        return self._edges_answer("dependents", lookup.get_dependents(self.store.read("edges"), self._id(symbol_id, symbol_key)))

    def get_call_graph(self, symbol_id, direction="outgoing"):
        return self._edges_answer("edges", lookup.get_call_graph(self.store.read("edges"), symbol_id, direction), direction=direction)

    def get_hierarchy(self, symbol_id, direction="ancestors"):
        return self._edges_answer("edges", lookup.get_hierarchy(self.store.read("edges"), symbol_id, direction), direction=direction)

    def find_references(self, symbol_id=None, symbol_key=None):
        return self._edges_answer("references", lookup.find_references(self.store.read("edges"), self._id(symbol_id, symbol_key)))

    def resolve_symbol(self, name, kind=None, file_context=None):
        return self._edges_answer("candidates", lookup.resolve_symbol(self.store.read("symbols"), name, kind, file_context).limit(PAGE["candidates"]))

    def _inside(self, path: str) -> str:
        full = os.path.realpath(os.path.join(self.root, path))
        if os.path.commonpath([full, os.path.realpath(self.root)]) != os.path.realpath(self.root):
            raise InvalidArguments("the path is outside the repository")
        return full

    def get_snippet(self, file_path, start_line=1, end_line=0, max_lines=PAGE["snippet_lines"]):
        full = self._inside(file_path)
        try:
            with open(full, encoding="utf-8", errors="replace") as f:
                lines = f.readlines()
        except OSError as e:
            return {"error": f"cannot read {file_path}: {e.strerror}"}
        start = max(1, start_line)
        end = min(end_line or len(lines), start + max_lines - 1, len(lines))
        content = "".join(lines[start - 1 : end])
        cost = math.ceil(os.path.getsize(full) * TOKENS_PER_BYTE)
        return {"file_path": file_path, "start_line": start, "end_line": end, "total_lines": len(lines), "content": content, "truncated": end < len(lines), "_naive_tokens": cost}

    def get_diff(self, file_path, base_ref=None, head_ref=None, context_lines=3):
        diff = self.git.diff(file_path, base_ref, head_ref, context_lines)
        return {"file_path": file_path, "diff": diff or "", "has_changes": diff is not None}

    def get_changed_files(self, base_ref=None, head_ref="HEAD", include_worktree=True):
        changes = self.git.changes(base_ref, head_ref, include_worktree) if base_ref else self.git.changes("HEAD", worktree=include_worktree)
        rows = [
            {"status": c["status"], "old_path": c["old_path"], "new_path": c["file_path"]} if c["status"] == "renamed" else {"status": c["status"], "file_path": c["file_path"]}
            for c in changes
        ]
        return {"changes": rows, "count": len(rows)}

    def semantic_search(self, query, max_results=PAGE["vector"], file_filter=None):
        state = self.store.state()
        if state is None:
            raise NoIndex("build an index first")
        e = self.config.embedding
        if state.embedding.provider and state.embedding.provider != e.provider:
            raise ProviderMismatch(f"the index is of {state.embedding.provider}, the configuration names {e.provider}")
        try:
            vector_of = embed.build(e.provider, **embed.settings(e))
        except embed.ProviderUnavailable as error:
            return error_of(error) | {"results": []}
        hits = vector.vector_search(self.store.below("chunks", file_filter or ""), vector_of([query])[0], max_results)
        return self._edges_answer("results", lookup.semantic_rows(hits), query=query)

    def get_file_summary(self, file_path):
        row = lookup.file_summary(self.store.read("symbols", files=[file_path]), self.store.read("edges", files=[file_path]), file_path).first()
        return plain(row) | {"_naive_tokens": self._cost_of_file(file_path)}

    def get_repo_overview(self):
        row = lookup.repo_overview(self.store.read("state"), self.git.is_dirty(), self.git.head()).first()
        return (plain(row) | {"_naive_tokens": row.total_tokens}) if row else {"indexed": False}

    def get_session_metrics(self):
        return self.session.metrics() | {"formatted": self.session.markdown()}

    def get_index_progress(self, operation_id=None):
        return payload(self.progress.snapshot(operation_id))

    # resources

    def resources(self) -> list[str]:
        return [f"codeloom://{n}" for n in ("status", "languages", "metrics", "index-progress")]

    def read_resource(self, uri: str) -> dict:
        name = uri.removeprefix("codeloom://")
        if name == "status":
            generation, stale = self.index_state()
            return {"indexed": generation > 0, "generation": generation, "stale": stale}
        if name == "languages":
            return {"languages": languages()}
        if name == "metrics":
            return self.session.metrics()
        if name == "index-progress":
            return payload(self.progress.snapshot())
        return {"error": f"Unknown resource: {uri}"}


def languages() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for ext, language in LANGUAGES.items():
        out.setdefault(language, []).append(ext)
    return {k: sorted(v) for k, v in sorted(out.items())}


def check_staleness(server: Server):
    """The staleness row, with the number of files changed since the index's commit (-1 if it can't be known)."""
    state = server.store.read("state")
    head = server.git.head()
    stored = server.store.state()
    changed = None
    if stored is not None and stored.workspace_state.head_commit and head != stored.workspace_state.head_commit:
        try:
            changed = server.git.changes_frame(server.spark, stored.workspace_state.head_commit)
        except subprocess.CalledProcessError:
            changed = None
    return planning.staleness(state.select(F.col("workspace_state")), head, server.git.is_dirty(), changed)
