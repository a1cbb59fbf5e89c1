"""Cached objects by key: bytes and JSON under a folder, listed by prefix and scanned as a table."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPORARY = ".tmp-"


class Blobs:
    """Keys are paths without empty, ``.`` or ``..`` parts. A put writes beside its place and renames, so readers see whole objects."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _path(self, key: str) -> str:
        if not key or any(part in ("", ".", "..") for part in key.split("/")):
            raise ValueError(f"bad key {key!r}")
        return f"{self.folder}/{key}"

    def put(self, key: str, value: bytes) -> None:
        fs, path = self._fs()
        target = path(self._path(key))
        fs.mkdirs(target.getParent())
        aside = path(target.getParent(), f"{TEMPORARY}{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(value))
        stream.close()
        if not fs.rename(aside, target):
            fs.delete(target, False)  # file systems that don't rename over a file
            fs.rename(aside, target)

    def put_json(self, key: str, value) -> None:
        self.put(key, json.dumps(value).encode())

    def has(self, key: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._path(key)))

    def get(self, key: str) -> bytes | None:
        if not self.has(key):
            return None
        return bytes(self.spark.read.format("binaryFile").load(self._path(key)).select("content").first()[0])

    def get_json(self, key: str):
        """The object as JSON; null if it is missing, an error if it is no JSON."""
        value = self.get(key)
        return None if value is None else json.loads(value)

    def delete(self, key: str) -> bool:
        fs, path = self._fs()
        return fs.delete(path(self._path(key)), False)

    def list(self, prefix: str = "") -> list[str]:
        """The keys with a prefix in order; objects that are being written are hidden. For folders that the driver can list."""
        fs, path = self._fs()
        root = path(self.folder)
        if not fs.exists(root):
            return []
        base = fs.getFileStatus(root).getPath().toUri().getPath().rstrip("/") + "/"
        files, keys = fs.listFiles(root, True), []
        while files.hasNext():
            at = files.next().getPath()
            if not at.getName().startswith((TEMPORARY, ".")):
                keys.append(at.toUri().getPath()[len(base) :])
        return sorted(k for k in keys if k.startswith(prefix))

    def scan(self, pattern: str = "*") -> DataFrame:
        """(key, content) of all objects whose name fits the pattern, read by the executors."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(self.folder)
        base = self.folder.split("://", 1)[-1]
        key = F.substring_index(F.col("path"), f"{base}/", -1)
        return found.where(~F.regexp_like("path", F.lit(r"/\.[^/]*$"))).select(key.alias("key"), "content")
