"""File trees as a DataFrame, through a Python data source.

``spark.read.format("filetree").option("root", dir).load()`` after ``register(spark)``. The driver lists only the upper levels of
the tree, until it has ``FOLDERS`` folders; each of them is walked, pruned and read by a task of its own, and the files above them in
groups of ``GROUP_FILES``. The driver neither looks into files nor holds the paths of the whole tree.
``path``, ``name``, ``size``, ``mod_time``, ``is_dir``, ``is_binary``; ``content`` is read only with
``option("content", "true")``, so listing stays cheap. The folder must be visible to all executors.

Options: include, exclude (comma-separated globs on the base name; exclude first), dirs, depth (of directories; files one
deeper still appear), hidden. Unreadable entries are left out; a symbolic link to a directory counts as a file.
"""

from __future__ import annotations

import os
import shutil
import re
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Directories that are never entered.
IGNORED = frozenset((".git", "node_modules", "vendor", ".vscode", ".idea", "dist", "build", "bin", "obj", "__pycache__", ".venv", "target"))
SCHEMA = "path string, name string, size bigint, mod_time string, is_dir boolean, is_binary boolean, content binary"
#: Folders at which the driver stops listing, and files of one task above them.
FOLDERS, GROUP_FILES = 512, 1_000


def glob_regex(glob: str) -> re.Pattern:
    """A base-name glob: ``*`` ``?`` ``[...]`` and backslash; no ``**`` and no braces."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "^" else body) + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return re.compile("".join(out) + r"\Z", re.S)


def extension_globs(text: str) -> list[str]:
    """``js, ts`` as ``*.js``, ``*.ts``; tokens that begin with ``*`` are kept."""
    return [t if t.startswith("*") else f"*.{t.lstrip('.')}" for t in (x.strip() for x in text.split(",")) if t]


def is_binary(head: bytes) -> bool:
    return b"\0" in head[:512]


class Rules:
    """What of a tree is listed: globs on base names, folders, depth, hidden entries."""

    def __init__(self, include: list[str] = (), exclude: list[str] = (), dirs: bool = False, depth: int = 0, hidden: bool = False) -> None:
        self.inc, self.exc = [glob_regex(g) for g in include], [glob_regex(g) for g in exclude]
        self.dirs, self.depth, self.hidden = dirs, depth, hidden

    def entries(self, folder: str, level: int) -> tuple[list[tuple[str, bool]], list[str]]:
        """(listed entries as (path, is directory), folders to enter) of a folder, both by name; nothing of an unreadable one."""
        listed, enter = [], []
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return listed, enter
        for e in found:
            if e.name.startswith(".") and not self.hidden:
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name in IGNORED or (self.depth > 0 and level > self.depth):
                    continue
                enter.append(e.path)
                if self.dirs:
                    listed.append((e.path, True))
            elif not any(p.match(e.name) for p in self.exc) and (not self.inc or any(p.match(e.name) for p in self.inc)):
                listed.append((e.path, False))
        return listed, enter

    def walk(self, folder: str, level: int = 1) -> Iterator[tuple[str, bool]]:
        """(path, is directory) of everything listed below a folder."""
        todo = [(folder, level)]
        while todo:
            at, n = todo.pop()
            listed, enter = self.entries(at, n)
            yield from listed
            todo += [(x, n + 1) for x in reversed(enter)]


class _Group(InputPartition):
    """Entries, or a folder to walk with its level."""

    def __init__(self, entries: list[tuple[str, bool]], folder: str = "", level: int = 0) -> None:
        super().__init__((entries, folder, level))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = options

    def _flag(self, name: str) -> bool:
        return str(self.o.get(name, "")).lower() in ("1", "true", "yes")

    def _rules(self) -> Rules:
        split = lambda k: [g for g in (x.strip() for x in self.o.get(k, "").split(",")) if g]
        return Rules(split("include"), split("exclude"), self._flag("dirs"), int(self.o.get("depth", 0)), self._flag("hidden"))

    def partitions(self) -> list[InputPartition]:
        rules, groups, own = self._rules(), [], []
        todo = [(self.o.get("root", "."), 1)]
        while todo and len(todo) < FOLDERS:
            folder, level = todo.pop(0)
            listed, enter = rules.entries(folder, level)
            todo += [(x, level + 1) for x in enter]
            own += listed
            while len(own) >= GROUP_FILES:
                groups.append(_Group(own[:GROUP_FILES]))
                own = own[GROUP_FILES:]
        return [*groups, *([_Group(own)] if own or not (groups or todo) else []), *(_Group([], f, n) for f, n in todo)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        whole = self._flag("content")
        entries, below, level = partition.value
        for path, folder in self._rules().walk(below, level) if below else entries:
            try:
                st = os.stat(path)
                body = b""
                if not folder:
                    with open(path, "rb") as f:
                        body = f.read() if whole else f.read(512)
            except OSError:
                if folder or not os.path.lexists(path):
                    continue
                st, body = os.lstat(path), b""
            when = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(st.st_mtime))
            yield path, os.path.basename(path), st.st_size, when, folder, is_binary(body), body if whole and not folder else None


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)


def file_tree(spark: SparkSession, root: str, include: str = "", exclude: str = "", dirs: bool = False, depth: int = 0, hidden: bool = False, content: bool = False) -> DataFrame:
    register(spark)
    options = {"root": root, "include": include, "exclude": exclude, "dirs": dirs, "depth": depth, "hidden": hidden, "content": content}
    return spark.read.format("filetree").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load()


def expand(patterns: list[str]) -> list[str]:
    """Files of the patterns in their order, duplicates kept; a pattern without a match is a literal path if it exists. None at all is an error."""
    import glob

    out = []
    for p in patterns:
        out += sorted(glob.glob(p)) or ([p] if os.path.exists(p) else [])
    if not out:
        raise FileNotFoundError("no input file found")
    return out


def write_atomic(path: str, data: bytes | Iterable[bytes]) -> None:
    """Replace a file in one step: the new bytes, whole or piece by piece, are written beside it and synced first.

    Where the folder does not let a file be renamed onto another, the new bytes are copied over the old ones.
    """
    tmp = f"{path}.docframe-{os.getpid()}.tmp"
    try:
        with open(tmp, "wb") as f:
            for part in (data,) if isinstance(data, bytes) else data:
                f.write(part)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(tmp, os.stat(path).st_mode & 0o7777)
        try:
            os.replace(tmp, path)
        except OSError:
            shutil.copyfile(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)
