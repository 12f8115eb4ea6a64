"""Walking a directory tree, and which of its paths ignore files leave out.

Rules come, the first to the last to decide, from the user's global excludes, the
repository's .git/info/exclude, the folders above the root up to the repository's top,
and each folder on the way down.  The driver lists the top of the tree only; each folder
there is walked by a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.predicates import glob_regex

IGNORE_FILES = (".gitignore", ".ignore")


class IgnoreRules:
    """The rules of one directory's ignore files; the last one that matches decides."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = line.rstrip("\n").rstrip("\r")
            if not line.endswith("\\ "):
                line = line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].removeprefix("\\") if line[keep:].startswith(("\\#", "\\!")) else line[keep:]
            only_folders = line.endswith("/")
            self.rules.append((re.compile(glob_regex(line)[: -len("(?:/.*)?$")] + "$"), keep, only_folders))

    def decides(self, path: str, is_folder: bool) -> bool | None:
        """True to ignore, False to keep, None if no rule matches. path: relative to folder."""
        out = None
        for pattern, keep, only_folders in self.rules:
            if (is_folder or not only_folders) and pattern.match(path):
                out = not keep
        return out


def _lines(path: str) -> list[str]:
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.readlines()


def read_rules(root: str, folder: str) -> IgnoreRules | None:
    lines = [line for name in IGNORE_FILES for line in _lines(os.path.join(root, folder, name))]
    return IgnoreRules(folder, lines) if lines else None


def global_excludes() -> str:
    """The user's excludes file: what core.excludesFile names, or its usual place."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    for config in (os.path.expanduser("~/.gitconfig"), f"{home}/git/config"):
        for line in _lines(config):
            if m := re.match(r"(?i)\s*excludesfile\s*=\s*\"?([^\"\n]+)", line):
                return os.path.expanduser(m[1].strip())
    return f"{home}/git/ignore"


class Above:
    """Rules from outside the walked tree, for paths relative to its root."""

    def __init__(self, root: str):
        root = os.path.realpath(root)
        top, folders = root, []
        while not os.path.exists(os.path.join(top, ".git")) and os.path.dirname(top) != top:
            top = os.path.dirname(top)
            folders.append(top)
        if not os.path.exists(os.path.join(top, ".git")):
            top, folders = root, []  # no repository: only the user's excludes
        self.inside = [os.path.relpath(root, f).replace(os.sep, "/") for f in reversed(folders)] + ["."]
        outer = [IgnoreRules("", _lines(global_excludes())), IgnoreRules("", _lines(os.path.join(top, ".git", "info", "exclude")))]
        parents = [IgnoreRules("", [x for n in IGNORE_FILES for x in _lines(os.path.join(f, n))]) for f in reversed(folders)]
        self.sets = [(self.inside[0], r) for r in outer] + list(zip(self.inside, parents))

    def decides(self, path: str, is_folder: bool) -> bool | None:
        for prefix, rules in reversed(self.sets):
            if (out := rules.decides(path if prefix == "." else f"{prefix}/{path}", is_folder)) is not None:
                return out
        return None


def walk_files(root: str, no_ignore: bool = False, skip: tuple[str, ...] = (), below: str = "", deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """(relative path, size, mtime in even seconds) of the regular files below root.

    Ignore files are honoured unless no_ignore; `skip` are folders left out (an index).
    Hidden files are listed: leaving them out is the search's choice.  Only the folder
    `below` and what it holds is walked; without deep, folders come as (path, -1, -1).
    """
    skip = tuple(os.path.realpath(s) for s in skip)
    above = None if no_ignore else Above(root)

    def ignored(path: str, is_folder: bool, rules: list[IgnoreRules]) -> bool:
        for r in reversed(rules):  # the innermost folder's rules come first
            if (out := r.decides(path[len(r.folder) + 1 if r.folder else 0 :], is_folder)) is not None:
                return out
        return bool(above and above.decides(path, is_folder))

    def rules_of(folder: str, rules: list[IgnoreRules]) -> list[IgnoreRules]:
        return [*rules, own] if not no_ignore and (own := read_rules(root, folder)) else rules

    parts = below.split("/") if below else []
    rules: list[IgnoreRules] = []
    for k in range(len(parts)):
        rules = rules_of("/".join(parts[:k]), rules)
    todo = [(below, rules)]
    while todo:
        folder, rules = todo.pop()
        rules = rules_of(folder, rules)
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            continue
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_folder = e.is_dir(follow_symlinks=False)
            if e.name == ".git" and is_folder or is_folder and os.path.realpath(e.path) in skip or ignored(path, is_folder, rules):
                continue
            if is_folder:
                if deep:
                    todo.append((path, rules))
                else:
                    yield path, -1, -1
            elif e.is_file(follow_symlinks=False):
                s = e.stat()
                yield path, s.st_size, int(s.st_mtime) // 2 * 2


def _walk_task(batches: Iterator[pa.RecordBatch], root: str, no_ignore: bool, skip: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, size, mtime in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = list(walk_files(root, no_ignore, skip, folder)) if size < 0 else [(folder, size, mtime)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "mtime"])


def walk(spark: SparkSession, root: str, no_ignore: bool = False, skip: tuple[str, ...] = (), spread: int = 256) -> DataFrame:
    """(path, size, mtime) of the files below root: folders of the top levels, at least
    `spread` where there are so many, are walked by tasks."""
    top = list(walk_files(root, no_ignore, skip, deep=False))
    while 0 < sum(s < 0 for _, s, _ in top) < spread:
        opened = [row for p, s, m in top for row in (walk_files(root, no_ignore, skip, p, False) if s < 0 else [(p, s, m)])]
        if len(opened) <= len(top):
            break
        top = opened
    rows = spark.createDataFrame(top, "path string, size long, mtime long")
    folders = sum(s < 0 for _, s, _ in top)
    return rows.repartition(max(1, min(folders, spread)), "path").mapInArrow(partial(_walk_task, root=root, no_ignore=no_ignore, skip=skip), "path string, size long, mtime long")
