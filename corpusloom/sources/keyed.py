"""Tables in buckets of keys: a merge rewrites the buckets that its rows fall into and no other file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import Versions

BUCKETS = 64
_BUCKET = "_bucket"


class KeyedTable:
    """A table whose rows lie in folders by a hash of their key; a manifest names each bucket's folder.

    A merge writes the new folders of touched buckets, then publishes: readers see
    the version before or after it, whole.  A state, such as a watermark, goes with
    the rows into the same version.  The number of buckets is fixed when the table
    is made; a bucket should be a few hundred megabytes at most.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.keys, self.versions = spark, list(keys), Versions(spark, root)
        self.buckets = self.versions.latest()[1].get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    @property
    def number(self) -> int:
        return self.versions.latest()[0]

    @property
    def state(self) -> dict:
        return self.versions.latest()[1].get("state", {})

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Each bucket's folder, below the table's root."""
        manifest = self.versions.latest()[1] if version is None else self.versions.read(version)
        return {int(b): f for b, f in manifest.get("folders", {}).items()}

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of a version (None: the last), of some buckets if given; None before the first version."""
        manifest = self.versions.latest()[1] if version is None else self.versions.read(version)
        if not manifest:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.versions.root}/{f}" for b, f in sorted(manifest["folders"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, wanted: DataFrame) -> DataFrame | None:
        """The rows with the keys of ``wanted``; only their buckets are read."""
        some = wanted.select(*self.keys).distinct()
        found = self.read(only=self._touched(some))
        return None if found is None else found.join(some, self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most as many as there are buckets

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], state: dict | None = None) -> list[int]:
        """Replace the touched buckets' rows by ``combine(old, new)``; the buckets that were rewritten.

        ``combine`` keeps keys in their buckets: it may change, add and drop rows of
        the keys in ``new``.  ``new`` is read twice.  Without rows and without a new
        state no version is made.
        """
        number, manifest = self.versions.latest()
        touched = self._touched(new)
        folders = dict(manifest.get("folders", {}))
        schema = manifest.get("schema", new.schema.json())
        if touched:
            old = self.read(only=touched)
            rows = combine(old if old is not None else new.limit(0), new)
            schema = rows.schema.json()
            name = f"data/{number + 1}-{uuid.uuid4().hex[:8]}"
            placed = rows.withColumn(_BUCKET, self._bucket())
            placed.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.versions.root}/{name}")
            written = {n.split("=")[1]: f"{name}/{n}" for n in self.versions.names(name) if "=" in n}
            folders = {b: f for b, f in folders.items() if int(b) not in touched} | written
        if touched or (state is not None and state != manifest.get("state", {})) or not manifest:
            content = {"buckets": self.buckets, "schema": schema, "folders": folders, "state": manifest.get("state", {}) if state is None else state}
            self.versions.publish(number + 1, content)
        return touched

    def clean(self, keep: int = 2) -> None:
        """Delete files that none of the last ``keep`` versions names, and older manifests."""
        numbers = self.versions.numbers()
        used = {f for n in numbers[-keep:] for f in self.folders(n).values()}
        for n in numbers[:-keep]:
            self.versions.delete("manifest", f"{n}.json")
        for name in self.versions.names("data"):
            for part in self.versions.names("data", name):
                if f"data/{name}/{part}" not in used and "=" in part:
                    self.versions.delete("data", name, part)
            if not any("=" in p for p in self.versions.names("data", name)):
                self.versions.delete("data", name)
