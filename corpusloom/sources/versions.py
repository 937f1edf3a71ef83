"""Numbered versions of a stored table or index: readers see the last one that was published whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """Manifests below ``root/manifest``: small JSON objects that name a version's files.

    A manifest is written beside and renamed to its number, so it is there whole or
    not at all, and a number is given once: of two writers one gets FileExistsError.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, *parts: str) -> list[str]:
        """Names below a folder of the root; none where it isn't there."""
        fs, path = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("manifest") if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict:
        stream = self._fs().open(self._path("manifest", f"{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, manifest) of the last version; (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def publish(self, number: int, manifest: dict) -> None:
        jvm, fs = self.spark._jvm, self._fs()
        beside, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"{number}.json")
        out = fs.create(beside)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(beside), fs.makeQualified(final), none)
        except Exception as e:
            fs.delete(beside, False)
            if fs.exists(final):
                raise FileExistsError(f"version {number} of {self.root} was published by another writer") from e
            raise

    def delete(self, *parts: str) -> None:
        self._fs().delete(self._path(*parts), True)
