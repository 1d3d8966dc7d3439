"""A folder tree as a data source: files (empty ones too), folders, and a row for each folder that can't be read.

    spark.dataSource.register(FolderTree)
    spark.read.format("folder_tree").option("exclude", '["~$*", "old/*"]').load(root)

Folders down to a level are the partitions; each is listed where Spark runs it, the deepest with all below. Links to
folders aren't followed, so that no circle is walked; links to files are files. root is a path that workers can open.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What is left out of every tree.
EXCLUDED = ("$RECYCLE.BIN", "System Volume Information", "~$*", "Thumbs.db", "desktop.ini", ".DS_Store", "~*.tmp")
SCHEMA = "kind string, path string, relative_path string, name string, size long, modified timestamp, error string"


def excluding(patterns: list[str]) -> Callable[[str, str], bool]:
    """Whether a name, or for patterns with a slash a relative path, matches a pattern of * and ?, in any case."""
    plain = [p.strip().replace("\\", "/").rstrip("/") for p in patterns if p and p.strip()]
    compiled = {deep: [re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in re.sub(r"\*+", "*", p.lstrip("/"))) + r"\Z", re.I | re.S) for p in plain if p and ("/" in p) == deep] for deep in (False, True)}
    return lambda name, relative: any(p.match(name) for p in compiled[False]) or any(p.match(relative) for p in compiled[True])


@dataclass
class Folder(InputPartition):
    relative: str
    below: bool  # with all below it, or its own files alone

    def __init__(self, relative: str, below: bool):
        self.relative, self.below = relative, below


class FolderReader(DataSourceReader):
    def __init__(self, root: str, exclude: list[str], levels: int):
        self.root, self.exclude, self.levels = root, exclude, levels

    def partitions(self) -> list[InputPartition]:
        """Folders above the last level alone, those at it with what lies below."""
        out, now = [], [""]
        for _ in range(self.levels):
            out += [Folder(f, False) for f in now]
            now = [child for f in now for child, is_dir, _ in self._entries(f, []) if is_dir]
        return out + [Folder(f, True) for f in now]

    def _entries(self, relative: str, errors: list[str]) -> list[tuple[str, bool, os.DirEntry]]:
        """(relative path, whether it is a folder, entry) of a folder in order of names; what fails is added to errors."""
        left_out, found = excluding([*EXCLUDED, *self.exclude]), []
        try:
            with os.scandir(os.path.join(self.root, relative)) as listed:
                for entry in listed:
                    own = f"{relative}/{entry.name}" if relative else entry.name
                    if not left_out(entry.name, own):
                        found.append((own, entry.is_dir(follow_symlinks=False), entry))
        except OSError as e:
            errors.append(f"{type(e).__name__}: {e.strerror or e}")
        return sorted(found, key=lambda x: x[2].name)

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.relative]
        while todo:
            relative = todo.pop()
            errors: list[str] = []
            entries = self._entries(relative, errors)
            full = os.path.join(self.root, relative) if relative else self.root
            for e in errors:
                yield "error", full, relative, os.path.basename(full), None, None, e
            for own, is_dir, entry in entries:
                try:
                    if not is_dir and entry.is_file():
                        s = entry.stat()
                        yield "file", entry.path, own, entry.name, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), None
                except OSError as e:
                    yield "error", entry.path, own, entry.name, None, None, f"{type(e).__name__}: {e.strerror or e}"
            if not errors:
                yield "dir", full, relative, os.path.basename(full), None, None, None
            if partition.below:
                todo += [own for own, is_dir, _ in reversed(entries) if is_dir]


class FolderTree(DataSource):
    """Options: path, exclude (a JSON list of patterns) and levels (2 by default)."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        root = re.sub("^file:(//)?(?=/)", "", self.options["path"]).rstrip("/") or "/"
        return FolderReader(root, json.loads(self.options.get("exclude", "[]")), int(self.options.get("levels", "2")))
