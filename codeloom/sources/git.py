"""Version control as a source: state on the driver, lists as DataFrames."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

# What the letters of a name-status listing stand for.
STATUS = {"R": "renamed", "A": "added", "D": "deleted", "M": "modified"}


class Git:
    def __init__(self, root: str, index_dir: str | None = None):
        self.root, self.index_dir = root, index_dir

    def run(self, *args: str, check: bool = False) -> str:
        """What a command prints; nothing if it fails, unless that is to be an error."""
        done = subprocess.run(["git", "-C", self.root, *args], capture_output=True, text=True, check=check, errors="replace")
        return done.stdout if done.returncode == 0 else ""

    def is_repo(self) -> bool:
        return self.run("rev-parse", "--is-inside-work-tree").strip() == "true"

    def head(self) -> str | None:
        return self.run("rev-parse", "HEAD").strip() or None

    def default_branch(self) -> str | None:
        """What the remote calls its head, else main or master, whichever there is."""
        remote = self.run("symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip()
        return remote.removeprefix("origin/") or next((b for b in ("main", "master") if self.run("rev-parse", "--verify", f"refs/heads/{b}")), None)

    def _ours(self, paths) -> list[str]:
        """Without the index's own directory."""
        return [p for p in paths if p and not (self.index_dir and p.startswith(self.index_dir.rstrip("/") + "/"))]

    def status(self) -> list[tuple[str, str]]:
        """Porcelain code and path of each change in the worktree."""
        entries, out = self.run("status", "--porcelain", "-z", "-uall").split("\0"), []
        i = 0
        while i < len(entries):
            if e := entries[i]:
                out.append((e[:2], e[3:]))
                i += e[0] in "RC"  # the old name follows
            i += 1
        ours = set(self._ours(p for _, p in out))
        return [x for x in out if x[1] in ours]

    def is_dirty(self) -> bool:
        return bool(self.status())

    def untracked(self) -> list[str]:
        return self._ours(self.run("ls-files", "-z", "--others", "--exclude-standard").split("\0"))

    def staged(self) -> list[str]:
        return self._ours(self.run("diff", "-z", "--name-only", "--cached").split("\0"))

    def tracked(self) -> list[str]:
        """Tracked files that are there and untracked ones that are not ignored; a submodule's stand for the submodule."""
        subs, gone = self.submodules(), set(self.run("ls-files", "-z", "--deleted").split("\0"))
        own = self._ours(self.run("ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0"))
        inside = [f"{s}/{p}" for s in subs for p in Git(os.path.join(self.root, s)).tracked()]
        return sorted(({p for p in own if p not in subs} | set(inside)) - gone)

    def submodules(self) -> list[str]:
        entries = self.run("config", "--file", ".gitmodules", "-z", "--get-regexp", r"^submodule\..*\.path$").split("\0")
        return sorted(e.split("\n", 1)[1] for e in entries if "\n" in e)

    def ignored(self, paths: list[str]) -> list[str]:
        """Those of ``paths`` that ignore rules name; the ones in a submodule by its own rules."""
        own, out = list(paths), []
        for sub in self.submodules():
            inside = [p for p in own if p.startswith(f"{sub}/")]
            own = [p for p in own if not p.startswith(f"{sub}/")]
            if inside:
                out += [f"{sub}/{p}" for p in Git(os.path.join(self.root, sub)).ignored([p.removeprefix(f"{sub}/") for p in inside])]
        done = subprocess.run(["git", "-C", self.root, "check-ignore", "-z", "--stdin"], input="\0".join(own), capture_output=True, text=True)
        return out + [p for p in done.stdout.split("\0") if p]

    def changes(self, base: str, head: str | None = None, worktree: bool = True) -> list[dict]:
        """Changes since ``base`` with real statuses; renames have both paths; other codes are left out. Raises if ``base`` is unknown."""
        out = []
        fields = self.run("diff", "-z", "--name-status", "-M", *([f"{base}..{head}"] if head and not worktree else [base]), check=True).split("\0")
        i = 0
        while i + 1 < len(fields):
            code = fields[i][:1]
            if code in "RC":
                if code == "R":
                    out.append({"status": "renamed", "file_path": fields[i + 2], "old_path": fields[i + 1]})
                i += 3
                continue
            if code in STATUS:
                out.append({"status": STATUS[code], "file_path": fields[i + 1], "old_path": None})
            i += 2
        if worktree:
            out += [{"status": "added", "file_path": p, "old_path": None} for p in self.untracked()]
        ours = set(self._ours(x["file_path"] for x in out))
        return sorted((x for x in out if x["file_path"] in ours), key=lambda x: x["file_path"])

    def diff(self, path: str, base: str | None = None, head: str | None = None, context: int = 3) -> str | None:
        spec = [f"{base}..{head}"] if base and head else [base] if base else []
        return self.run("diff", f"-U{context}", *spec, "--", path) or None

    def mtime(self, name: str) -> float:
        """Of HEAD or index in the repository's directory; 0 if it is missing."""
        try:
            return os.stat(os.path.join(self.root, ".git", name)).st_mtime
        except OSError:
            return 0.0

    def changes_frame(self, spark: SparkSession, *args, **kwargs) -> DataFrame:
        rows = [(x["status"], x["file_path"], x["old_path"]) for x in self.changes(*args, **kwargs)]
        return spark.createDataFrame(rows, "status string, file_path string, old_path string")

    def paths_frame(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.createDataFrame([(p,) for p in paths], "file_path string")
