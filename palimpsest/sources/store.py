"""Files through Hadoop's FileSystem, so that a root can be on any file system that Spark reads and writes.

A commit is a file that exactly one writer can bring into being. HDFS and the like rename without replacing, and a local disk
links without replacing; on object stores a rename is a copy that replaces what is there, so roots on them are refused.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from ..errors import UnsupportedStore

#: Schemes whose file systems move a file to its name atomically, and only if the name is free.
EXCLUSIVE = frozenset({"file", "hdfs", "viewfs", "abfs", "abfss", "ofs"})


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        self.scheme = self._fs.getUri().getScheme()
        if self.scheme not in EXCLUSIVE:
            raise UnsupportedStore(f"{root}: {self.scheme} can't create a file for one writer alone")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if ":/" in name or name.startswith("/") else f"{self.root}/{name}" if name else self.root)

    def _local(self, path) -> str:
        return self._fs.makeQualified(path).toUri().getPath()

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one by that name already. Readers see the whole file or none, and of several writers exactly one succeeds."""
        path = self._path(name)
        self._fs.mkdirs(path.getParent())
        staged = self._path(f"_staged/{self._jvm.java.util.UUID.randomUUID().toString()}")
        self._write(staged, text)
        if self.scheme != "file":
            won = self._fs.rename(staged, path)
        else:
            try:
                os.link(self._local(staged), self._local(path))
                won = True
            except FileExistsError:
                won = False
        self._fs.delete(staged, False)
        return won

    def newest(self, folder: str) -> tuple[int, str | None]:
        """The last version of a small file that is kept as versions in a folder, and its text; (0, None) if there is none."""
        names = [n for n in self.names(folder) if n.endswith(".json")]
        return (int(names[-1].removesuffix(".json")), self.read(f"{folder}/{names[-1]}")) if names else (0, None)

    def succeed(self, folder: str, version: int, value: object) -> bool:
        """Writes the version after ``version``; False if another writer has."""
        return self.create(f"{folder}/{version + 1:020d}.json", json.dumps(value, indent=1))

    def write(self, name: str, text: str) -> None:
        """Writes a small file at a place of which this writer is the only one."""
        self._fs.mkdirs(self._path(name).getParent())
        self._write(self._path(name), text)

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, True)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        return [n for n, _ in self.dated(folder)]

    def dated(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder and when each was last written, in seconds."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted((n, s.getModificationTime() / 1000) for s in self._fs.listStatus(path) if not (n := s.getPath().getName()).startswith("."))

    def files(self, folder: str) -> list[tuple[str, int]]:
        """(path below the folder, bytes) of all files under it, but for those that Spark passes over: names that begin with a dot or underscore."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        top, found = self._fs.makeQualified(path).toString().rstrip("/") + "/", []
        each = self._fs.listFiles(path, True)
        while each.hasNext():
            s = each.next()
            name = s.getPath().toString().removeprefix(top)
            if not any(part[0] in "._" for part in name.split("/")):
                found.append((name, s.getLen()))
        return sorted(found)

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._path(new).getParent())
        self._fs.rename(self._path(old), self._path(new))

    def copy(self, old: str, new: str) -> None:
        target = self._path(new)
        self._fs.mkdirs(target.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(old), target.getFileSystem(self._conf), target, False, self._conf)
