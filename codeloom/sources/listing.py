"""Listing of file trees by the executors, level by level, on any store.

A frontier of directories is a table; tasks list its directories, what they find is written, and the directories among it are the next
frontier. No list of paths is on the driver, which learns only whether there is a next level. A local or mounted tree is
listed by the operating system, any other through the file systems that Arrow knows.

``walk``: all files but those in hidden and pruned directories; links to directories are not followed; in a repository without what its
ignore rules name. ``git``: files that are tracked and there, and untracked ones that are not ignored; each task asks version control about
the directories that it lists. A submodule's files are listed by the submodule's own rules, below its path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.lineage import cut
from codeloom.sources.git import Git

FOUND = "kind string, path string, repo string, size long, mtime double, error string"


@dataclass
class Tree:
    """A tree's files by paths relative to its root, which may be of any store."""

    root: str

    def __post_init__(self):
        self.local = "://" not in self.root or self.root.startswith("file://")
        if self.local:
            self.top = self.root.removeprefix("file://")

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def children(self, path: str) -> Iterator[tuple[str, bool | None]]:
        """Names in a directory, and whether each is a directory; None for a link to one."""
        if self.local:
            with os.scandir(os.path.join(self.top, path)) as entries:
                for e in entries:
                    yield e.name, e.is_dir() if not e.is_symlink() else None if e.is_dir() else False
        else:
            from pyarrow import fs

            system, top = self._remote()
            for info in system.get_file_info(fs.FileSelector(f"{top}/{path}".rstrip("/"))):
                yield info.base_name, info.type == fs.FileType.Directory

    def stat(self, path: str) -> tuple:
        """size, mtime, error of a file."""
        try:
            if self.local:
                found = os.stat(os.path.join(self.top, path))
                return found.st_size, found.st_mtime, None
            system, top = self._remote()
            info = system.get_file_info(f"{top}/{path}")
            return info.size, info.mtime.timestamp() if info.mtime else None, None
        except OSError as e:
            return None, None, str(e)

    def text(self, path: str) -> tuple[str | None, str | None]:
        """Content and error of a file; line ends are those of text files."""
        try:
            if self.local:
                with open(os.path.join(self.top, path), encoding="utf-8", errors="replace") as f:
                    return f.read(), None
            system, top = self._remote()
            with system.open_input_stream(f"{top}/{path}") as f:
                return f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), None
        except OSError as e:
            return None, str(e)


def joined(*parts: str) -> str:
    return "/".join(p for p in parts if p)


class Rules:
    """What version control says about files and directories of a tree on this machine; a repository is named by its path in the tree."""

    def __init__(self, tree: Tree):
        self.tree, self._subs = tree, {}

    def git(self, repo: str) -> Git:
        return Git(os.path.join(self.tree.top, repo))

    def submodules(self, repo: str) -> set[str]:
        if repo not in self._subs:
            self._subs[repo] = {joined(repo, s) for s in self.git(repo).submodules()}
        return self._subs[repo]

    def repo_of(self, path: str, repo: str) -> str:
        """The repository of a directory in one of ``repo``."""
        return path if path in self.submodules(repo) and path != repo else repo

    def listed(self, repo: str, directories: list[str]) -> set[str]:
        """Files right in these directories that are tracked and there, or untracked and not ignored."""
        inner = [d.removeprefix(repo).lstrip("/") for d in directories]
        magic = [":(glob,top)" + joined(d.replace("\\", "\\\\").replace("*", "\\*").replace("?", "\\?").replace("[", "\\["), "*") for d in inner]
        out = self.git(repo).run("ls-files", "-z", "--cached", "--others", "--exclude-standard", "--", *magic)
        return {joined(repo, p) for p in out.split("\0") if p and not p.endswith("/")} - self.submodules(repo)

    def ignored(self, repo: str, paths: list[str]) -> set[str]:
        """Those of ``paths`` in a repository that its ignore rules name."""
        inner = [p.removeprefix(repo).lstrip("/") for p in paths]
        return {joined(repo, p) for p in self.git(repo).ignored(inner)} if inner else set()

    def barren(self, repo: str, directories: list[str]) -> set[str]:
        """Ignored directories without a tracked file, where nothing is to be found."""
        gone = self.ignored(repo, directories)
        if not gone:
            return gone
        names = sorted(d.removeprefix(repo).lstrip("/") for d in gone)
        tracked = self.git(repo).run("ls-files", "-z", "--cached", "--", *[f":(literal,top){n}" for n in names]).split("\0")
        held = {"/".join(p.split("/")[:k]) for p in tracked if p for k in range(1, p.count("/") + 1)}
        return {d for d in gone if d.removeprefix(repo).lstrip("/") not in held}


def expanded(tree: Tree, mode: str, frontier: list[tuple[str, str | None]]) -> Iterator[tuple]:
    """What lies right in the directories of ``frontier`` (path, repository): rows of FOUND, directories to go on with and files."""
    rules = Rules(tree)
    by: dict[str | None, list[str]] = {}
    for path, repo in frontier:
        by.setdefault(repo, []).append(path)
    for repo, directories in by.items():
        below: list[str] = []
        files: list[str] = []
        for d in directories:
            try:
                for name, is_directory in tree.children(d):
                    if is_directory and not (name == ".git" if mode == "git" else name.startswith(".") or name in S.PRUNED):
                        below.append(joined(d, name))
                    elif is_directory is False or (is_directory is None and mode == "git"):
                        files.append(joined(d, name))
            except OSError as e:
                yield "error", d, repo, None, None, str(e)
        if repo is not None:
            repos = {d: rules.repo_of(d, repo) for d in below}
            own = [d for d in below if repos[d] == repo]
            if mode == "git":
                named = rules.listed(repo, directories)
                files = [f for f in files if f in named]
                barren = rules.barren(repo, own)
                below = [d for d in below if d not in barren]
            else:
                gone = rules.ignored(repo, files)
                files = [f for f in files if f not in gone]
        else:
            repos = dict.fromkeys(below)
        for d in below:
            yield "directory", d, repos[d], None, None, None
        for f in files:
            yield "file", f, repo, *tree.stat(f)


def mode_of(tree: Tree, mode: str) -> tuple[str, str | None]:
    """walk or git for ``auto``, and the path of the repository that the tree is, if it is one."""
    is_repo = tree.local and os.path.exists(os.path.join(tree.top, ".git"))
    mode = ("git" if is_repo else "walk") if mode == "auto" else mode
    return mode, "" if tree.local and (is_repo or mode == "git") else None


def list_tree(spark: SparkSession, root: str, mode: str = "auto", directories: int = 64) -> DataFrame:
    """file_path, size, mtime, error of the files of a tree that all executors reach; mode: auto, walk or git.

    Tasks list about ``directories`` directories each. A directory that can't be listed has no rows.
    """
    import pyarrow as pa

    tree = Tree(root)
    mode, repo = mode_of(tree, mode)

    def run(batches):
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64(), pa.float64(), pa.string()]
        for b in batches:
            asked = list(zip(b.column("path").to_pylist(), b.column("repo").to_pylist(), strict=True))
            for a in range(0, len(asked), directories):
                rows = list(expanded(tree, mode, asked[a : a + directories]))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names)

    frontier, out = spark.createDataFrame([("", repo)], "path string, repo string"), None
    while True:
        level = cut(frontier.mapInArrow(run, FOUND))
        files = level.where("kind = 'file'").select(F.col("path").alias("file_path"), "size", "mtime", "error")
        out = files if out is None else out.unionAll(files)
        below = level.where("kind = 'directory'").select("path", "repo")
        n = below.count()
        if not n:
            return out
        frontier = below.repartition(-(-n // directories), "path")
