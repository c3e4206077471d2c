"""A table's current version as a list of folders.

Writers put data into new folders and then *publish* a small JSON file that
names the folders of the new version.  Publishing is one rename that fails
if the version exists, so readers see the old version or the new one whole,
a job that dies leaves the old one, and of two writers one gets an error.
Data folders are never rewritten; those that no kept version names are
removed by ``clean``.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class AlreadyPublished(RuntimeError):
    """Another writer published this version first."""


class Published:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")]

    def content(self, version: int) -> dict:
        path = self._path("versions", f"{version:012d}.json").toString()
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def latest(self) -> tuple[int, dict]:
        """(version, what it names); (0, {}) before the first one."""
        found = self.versions()
        return (found[-1], self.content(found[-1])) if found else (0, {})

    def new_folder(self, name: str) -> str:
        return f"{self.root}/data/{name}-{uuid.uuid4().hex}"

    def names_in(self, folder: str) -> list[str]:
        """What lies in a folder that ``new_folder`` named."""
        return self._names(folder.removeprefix(f"{self.root}/"))

    def publish(self, content: dict, after: int) -> int:
        """Make ``content`` version ``after`` + 1; fails if that one exists."""
        fs, draft = self._fs(), self._path("drafts", uuid.uuid4().hex)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        target = self._path("versions", f"{after + 1:012d}.json")
        fs.mkdirs(target.getParent())
        context = self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, target, plain)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass()):
                raise
            raise AlreadyPublished(f"version {after + 1} of {self.root}") from e
        return after + 1

    def clean(self, keep: int = 2) -> None:
        """Remove versions but the last ``keep`` and the folders that only they
        name.  Readers of a kept version lose nothing; call it from the one
        writer, since a folder that is not published yet looks unused."""
        found = self.versions()
        used = json.dumps([self.content(v) for v in found[-keep:]])
        fs = self._fs()
        for v in found[:-keep]:
            fs.delete(self._path("versions", f"{v:012d}.json"), False)
        for name in self._names("data"):
            if f"/data/{name}" not in used:
                fs.delete(self._path("data", name), True)
