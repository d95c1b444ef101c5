"""Listing of trees by the executors: the same rows as a walk on the driver, in repositories, with submodules, links and odd names."""

import os
import subprocess

import pytest

from codeloom.sources.files import TreeSource, read_tree, walk
from codeloom.sources.git import Git
from codeloom.sources.listing import Tree, list_tree


def write(root, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write(text)


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=x", "-c", "protocol.file.allow=always", *args], check=True, capture_output=True)


FILES = {
    "a.py": "x = 1\r\ny = 2\r", "src/deep/er/still/b.py": "", "src/c [1].py": "c", "src/st*r.py": "s", "src/ü mit.py": "u", "node_modules/x.js": "1", ".hidden/h.py": "h", "src/.dot.py": "d", "out/gen.py": "g", "out/kept.py": "k",
    "logs/1.log": "l", "logs/a/2.log": "l", "logs/a/in.py": "i", ".gitignore": "*.log\nout/\nnode_modules/\n", "sub dir/x.py": "x",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    inner, root = str(tmp_path_factory.mktemp("inner")), str(tmp_path_factory.mktemp("tree"))
    write(inner, {"s.py": "y = 1\n", "p/q.py": "", "t.tmp": "t", ".gitignore": "*.tmp\n"})
    git(inner, "init")
    git(inner, "add", "-A")
    git(inner, "commit", "-m", "one")
    write(root, FILES)
    git(root, "init", "-b", "main")
    git(root, "submodule", "add", inner, "libs/my mod")
    write(root, {"libs/my mod/new.py": "n", "libs/my mod/t.tmp": "t"})
    git(root, "add", "-A")
    git(root, "add", "-f", "out/kept.py")
    git(root, "commit", "-m", "one")
    write(root, {"src/untracked.py": "u", "gone.py": "g"})
    git(root, "add", "gone.py")
    os.remove(os.path.join(root, "gone.py"))
    os.symlink("src", os.path.join(root, "link"))
    os.symlink("nowhere", os.path.join(root, "broken.py"))
    return root


def test_git_listing_is_that_of_version_control(spark, repo):
    want = Git(repo).tracked()
    assert {"out/kept.py", "libs/my mod/new.py", "libs/my mod/p/q.py", "src/untracked.py", "link"} <= set(want) and not {"gone.py", "out/gen.py", "libs/my mod/t.tmp", "logs/1.log"} & set(want)
    rows = list_tree(spark, repo, directories=2).collect()
    assert sorted(r.file_path for r in rows) == want
    assert {r.file_path for r in rows if r.error} == {"broken.py"} and all(r.mtime > 0 for r in rows if not r.error)
    assert Git(repo).submodules() == ["libs/my mod"] and Git(repo).default_branch() == "main"


@pytest.mark.parametrize("name", ["tree", "repo"])
def test_walk_is_that_of_the_driver(spark, repo, tmp_path, name):
    root = repo if name == "repo" else str(tmp_path)
    if name == "tree":
        write(root, FILES)
        os.symlink(root, os.path.join(root, "src/circle"))
    want = walk(root)
    want = sorted(set(want) - set(Git(root).ignored(want)))
    assert sorted(r.file_path for r in list_tree(spark, root, "walk", directories=2).collect()) == want
    found = {r.file_path: r for r in read_tree(spark, root, "walk").collect()}
    assert sorted(found) == want and found["a.py"].content == "x = 1\ny = 2\n" and found["src/deep/er/still/b.py"].size == 0
    spark.dataSource.register(TreeSource)
    theirs = {r.file_path: r for r in spark.read.format("source_tree").option("mode", "walk").load(root).collect()}
    assert theirs == found


def test_other_stores(tmp_path, monkeypatch):
    """A store that only Arrow's file systems reach: here a mock of one in a sub-tree of this machine's."""
    from pyarrow import fs

    root = str(tmp_path)
    write(root, FILES)
    far = Tree("mock://bucket")
    monkeypatch.setattr(far, "_remote", lambda: (fs.SubTreeFileSystem(root, fs.LocalFileSystem()), ""))
    near = Tree(root)
    assert sorted(far.children("src")) == sorted(near.children("src")) and far.text("a.py") == near.text("a.py")
    assert far.stat("a.py")[0] == near.stat("a.py")[0] and far.text("none.py")[0] is None


def test_no_tree(spark, tmp_path):
    assert list_tree(spark, str(tmp_path)).count() == 0 and list_tree(spark, str(tmp_path / "none")).count() == 0
