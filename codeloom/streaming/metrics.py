"""Streams: tool-call metrics, progress, and changes of a repository's state."""

from __future__ import annotations

import json
import os
import threading
import uuid
from copy import deepcopy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from codeloom.functions import scalars as S
from codeloom.sources.files_io import read_json, write_json


def running_metrics(calls: DataFrame) -> DataFrame:
    """Per session and tool, for a streaming or a batch frame: calls, token sums and savings (update mode)."""
    saved = S.tokens_saved(F.col("naive_tokens"), F.col("actual_tokens"))
    return calls.groupBy("session_id", "tool").agg(
        F.count("*").alias("calls"), F.sum("naive_tokens").alias("naive_tokens"), F.sum("actual_tokens").alias("actual_tokens"), F.sum(saved).alias("running_saved")
    )


def windowed_metrics(calls: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Extension: calls and savings in tumbling event-time windows, with a watermark."""
    stamped = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    saved = F.sum(S.tokens_saved(F.col("naive_tokens"), F.col("actual_tokens")))
    return stamped.groupBy(F.window("ts", size).alias("w"), "tool").agg(F.count("*").alias("calls"), saved.alias("saved")).select(F.col("w.start").alias("start"), "tool", "calls", "saved")


def sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of a user's calls, split where none comes for ``gap``."""
    stamped = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = stamped.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls"))
    return rows.select("session_id", F.col("w.start").alias("start"), "calls")


def stream_to_table(stream: DataFrame, table: str, checkpoint: str, mode: str = "complete"):
    """Runs a stream over all that is available into an in-memory table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


class RepositoryReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"]

    def _times(self):
        out = []
        for name in ("HEAD", "index"):
            try:
                out.append(os.stat(os.path.join(self.root, ".git", name)).st_mtime)
            except OSError:
                out.append(0.0)
        return out

    def initialOffset(self):
        return {"times": self._times(), "n": 0}

    def read(self, start):
        now = self._times()
        if now == start["times"]:
            return iter([]), start
        return iter([(now[0], now[1])]), {"times": now, "n": start["n"] + 1}

    def readBetweenOffsets(self, start, end):
        return iter([tuple(end["times"])] if start != end else [])

    def commit(self, end):
        pass


class RepositorySource(DataSource):
    """``spark.readStream.format("repository").load(root)``: a row whenever HEAD or the index file changes; a missing file is of time 0."""

    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return "head_mtime double, index_mtime double"

    def simpleStreamReader(self, schema):
        return RepositoryReader(self.options)


def watch(spark, root: str, on_change, checkpoint: str, seconds: float = 2.0):
    """Starts a stream that calls ``on_change`` when the repository changes; its errors do not stop the stream."""
    spark.dataSource.register(RepositorySource)

    def batch(df, _):
        if not df.isEmpty():
            try:
                on_change()
            except Exception as e:  # noqa: BLE001  a callback's failure is its own
                print(f"change callback failed: {e}")

    stream = spark.readStream.format("repository").load(root)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


class Progress:
    """State of index operations: queued, running, committing, then completed or failed. Snapshots go to a JSON file at once."""

    ERRORS = 20

    def __init__(self, path: str | None = None):
        self.path, self._lock = path, threading.RLock()
        self._all: dict[str, dict] = {}
        self.active: str | None = None
        self.last: str | None = None

    _of: dict[str, Progress] = {}

    @classmethod
    def of(cls, root: str, path: str | None = None) -> Progress:
        """The one tracker of a repository in this process."""
        found = cls._of.setdefault(os.path.realpath(root), cls(path))
        found.path = found.path or path
        return found

    def start(self, mode: str = "full") -> str:
        with self._lock:
            op = uuid.uuid4().hex
            self._all[op] = {
                "operation_id": op, "mode": mode, "state": "queued", "partitions_total": 0, "files_total": 0, "partitions_done": 0, "files_done": 0, "files_failed": 0,
                "current_partition": None, "current_file": None, "partition_files_total": {}, "partition_files_done": {}, "errors": [],
            }
            self.active = self.last = op
            self._save()
            return op

    def _now(self) -> dict:
        return self._all[self.active or self.last]

    def _set(self, **values):
        with self._lock:
            if self._now()["state"] not in ("completed", "failed", "cancelled"):
                self._now().update(values)
                self._save()

    def register(self, partitions: dict[str, int]):
        self._set(partition_files_total=dict(partitions), partition_files_done=dict.fromkeys(partitions, 0), partitions_total=len(partitions), files_total=sum(partitions.values()))

    def running(self):
        self._set(state="running")

    def committing(self):
        self._set(state="committing", current_partition=None, current_file=None)

    def file_done(self, partition: str, path: str, error: str | None = None):
        with self._lock:
            s = self._now()
            done = s["partition_files_done"]
            done[partition] = done.get(partition, 0) + 1
            s["files_done"] += error is None
            s["files_failed"] += error is not None
            s["current_partition"], s["current_file"] = partition, path
            s["partitions_done"] = sum(done.get(p, 0) >= n for p, n in s["partition_files_total"].items())
            if error is not None:
                s["errors"] = [*s["errors"], f"{path}: {error}"][-self.ERRORS :]
            self._save()

    def partitions_done(self, counts: dict[str, tuple[int, int]], errors: list[str] = ()):
        """Files done and failed of each partition, as a job counted them."""
        done = {p: d + f for p, (d, f) in counts.items()}
        with self._lock:
            total = self._now()["partition_files_total"]
            self._set(
                partition_files_done=done, files_done=sum(d for d, _ in counts.values()), files_failed=sum(f for _, f in counts.values()),
                partitions_done=sum(done.get(p, 0) >= n for p, n in total.items()), errors=[*self._now()["errors"], *errors][-self.ERRORS :],
            )

    def complete(self):
        self._set(state="completed")
        self.active = None
        self._save()

    def fail(self, error: str):
        with self._lock:
            self._set(errors=[*self._now()["errors"], error][-self.ERRORS :], state="failed")
            self.active = None
            self._save()

    def snapshot(self, operation_id: str | None = None) -> dict | None:
        with self._lock:
            return deepcopy(self._all.get(operation_id or self.active or self.last))

    def _save(self):
        if self.path:
            write_json(self.path, {"active_operation_id": self.active, "last_operation_id": self.last, "operations": self._all})

    @staticmethod
    def read(path: str) -> dict | None:
        """The active operation's snapshot of a file, else the last one's."""
        data = read_json(path) or {}
        return data.get("operations", {}).get(data.get("active_operation_id") or data.get("last_operation_id"))


def payload(snapshot: dict | None) -> dict:
    return {"active": snapshot is not None, "progress": snapshot}


def human(n: int) -> str:
    """1234 as ~1.2k, 2500000 as ~2.5M."""
    return f"~{n / 1_000_000:.1f}M" if n >= 1_000_000 else f"~{n / 1000:.1f}k" if n >= 1000 else f"~{n}"


def session_lines(m: dict) -> list[str]:
    """A session's savings by tool, the largest first, and in all; none if nothing was saved."""
    if not m.get("total_saved"):
        return []
    tools = sorted((t for t in m["tools"] if t["tokens_saved"]), key=lambda t: -t["tokens_saved"])
    lines = [f"  {t['tool']:<24} {t['calls']}x  {human(t['tokens_saved']):>8} tokens saved" for t in tools]
    return ["codeloom: session complete", *lines, f"  total: {human(m['total_saved'])} tokens saved ({m['percent_saved']:.1f}%)"]


def progress_line(s: dict, width: int = 20) -> str:
    n = s["files_done"] + s["files_failed"]
    full = int(width * n / s["files_total"]) if s["files_total"] else 0
    return f"[{'#' * full}{'-' * (width - full)}] {s['state']} {n}/{s['files_total']} files, {s['files_failed']} failed"


class Session:
    """Tool calls of this session, held on the driver: a handful of numbers for each tool."""

    def __init__(self, folder: str | None = None):
        self.id, self.folder, self.tools, self.saved = uuid.uuid4().hex[:12], folder, {}, 0
        self._lock = threading.Lock()

    def record(self, tool: str, naive: int, actual: int) -> None:
        with self._lock:
            t = self.tools.setdefault(tool, [0, 0, 0])
            t[0], t[1], t[2] = t[0] + 1, t[1] + naive, t[2] + actual
            self.saved += max(0, naive - actual)

    def metrics(self) -> dict:
        with self._lock:
            rows = [{"tool": k, "calls": c, "naive_tokens": n, "actual_tokens": a, "tokens_saved": max(0, n - a)} for k, (c, n, a) in sorted(self.tools.items())]
        naive, actual = sum(r["naive_tokens"] for r in rows), sum(r["actual_tokens"] for r in rows)
        saved = max(0, naive - actual)
        return {"tools": rows, "total_naive": naive, "total_actual": actual, "total_saved": saved, "percent_saved": round(100 * saved / naive, 1) if naive else 0.0}

    def persist(self) -> None:
        if self.folder:
            from datetime import datetime, timezone

            data = {"session_id": self.id, "timestamp": datetime.now(timezone.utc).isoformat(), "metrics": self.metrics()}
            write_json(os.path.join(self.folder, "last-session.json"), data)
            write_json(os.path.join(self.folder, "sessions", f"{self.id}.json"), data)

    def delta(self) -> dict:
        """Calls and savings since the last report, which is kept in a file beside the session's."""
        path = os.path.join(self.folder or "", "last-reported.json")
        now = {"calls": sum(t[0] for t in self.tools.values()), "saved": self.saved}
        last = (read_json(path) or {}) if self.folder else {}
        before = last if last.get("session_id") == self.id else {}
        if self.folder:
            write_json(path, now | {"session_id": self.id})
        return {k: now[k] - before.get(k, 0) for k in now}

    def end(self) -> None:
        """Forgets what was last reported."""
        if self.folder:
            Session.forget(self.folder)

    @staticmethod
    def forget(folder: str) -> None:
        try:
            os.remove(os.path.join(folder, "last-reported.json"))
        except OSError:
            pass

    @staticmethod
    def report(folder: str) -> dict | None:
        """Calls, and savings since the last report, of the session whose metrics were written last; None if nothing more was saved."""
        data = read_json(os.path.join(folder, "last-session.json"))
        m = data.get("metrics") if isinstance(data, dict) else None
        if not m:
            return None
        path = os.path.join(folder, "last-reported.json")
        last = read_json(path)
        before = last.get("saved", 0) if isinstance(last, dict) and last.get("session_id") == data.get("session_id") else 0
        now = {"calls": sum(t["calls"] for t in m["tools"]), "saved": m["total_saved"], "session_id": data.get("session_id")}
        if now["saved"] <= before:
            return None
        write_json(path, now)
        return {"calls": now["calls"], "saved": now["saved"] - before}

    @staticmethod
    def last(folder: str) -> dict | None:
        """The metrics of the session before; None if there is none or its file can't be read."""
        data = read_json(os.path.join(folder, "last-session.json"))
        return data.get("metrics") if isinstance(data, dict) else None

    def markdown(self) -> str:
        m = self.metrics()
        lines = ["", "### Session Metrics", "", "| Tool | Calls | Tokens saved |", "| :--- | :---: | :--- |"]
        lines += [f"| {t['tool']} | {t['calls']} | {t['tokens_saved']:,} |" for t in m["tools"]]
        totals = [("Tokens without index", f"{m['total_naive']:,}"), ("Actual tokens returned", f"{m['total_actual']:,}"), ("Total tokens saved", f"{m['total_saved']:,}"), ("Percent saved", f"{m['percent_saved']:.1f}%")]
        return "\n".join([*lines, "", "**Totals:**", *[f"- {k}: {v}" for k, v in totals]])

    def json(self) -> str:
        return json.dumps(self.metrics())
