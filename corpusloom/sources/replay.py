"""Cached answers of a service, replayed in the order of their names, as a batch or a stream.

An answer is a file whose name begins with the SHA-1 of its request (``cache_key``).
The source's offset is the last name read, so a replay that stopped goes on with the
next answer.  The cache should be whole when a replay begins: names are hashes, so an
answer that comes later may lie before the offset.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Answers in one task.
TASK = 256


def _at(path: str):
    """(file system, path within it); any store that pyarrow reads."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Answers(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class _Cache:
    def __init__(self, options):
        self.path, self.after, self.until = options["path"].rstrip("/"), options.get("after", ""), options.get("until")

    def names(self, after: str, until: str | None = None) -> list[str]:
        from pyarrow import fs

        store, path = _at(self.path)
        found = (f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_")))
        return sorted(n for n in found if n > after and (until is None or n <= until))

    def cut(self, names: list[str]) -> Sequence[InputPartition]:
        return [Answers(names[i : i + TASK]) for i in range(0, len(names), TASK)] or [Answers([])]

    def read(self, partition: Answers) -> Iterator[tuple]:
        store, path = _at(self.path)
        for name in partition.names:
            with store.open_input_stream(f"{path}/{name}") as f:
                yield name, name.split(".")[0], f.read().decode("utf-8", "replace")


class _Batch(_Cache, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.cut(self.names(self.after, self.until))


class _Stream(_Cache, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": self.after}

    def latestOffset(self) -> dict:
        names = self.names(self.after, self.until)
        return {"last": names[-1] if names else self.after}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.cut(self.names(start["last"], end["last"]))

    def commit(self, end: dict) -> None:
        """The checkpoint has the offset."""


class ReplaySource(DataSource):
    """``spark.read.format("answers").load(folder)``; options ``after`` and ``until`` are names."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return "name string, key string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def answers(spark: SparkSession, folder: str, after: str = "", stream: bool = False, until: str | None = None) -> DataFrame:
    """(name, key, body) of the cached answers behind ``after``, in the order of names within and across partitions."""
    spark.dataSource.register(ReplaySource)
    reader = (spark.readStream if stream else spark.read).format("answers").option("after", after)
    if until is not None:
        reader = reader.option("until", until)
    return reader.load(folder)


def store_answers(rows: DataFrame, folder: str, key: str = "key", body: str = "body", end: str = ".json") -> int:
    """Write each row's body as the answer of its key, beside and then renamed; the number written.

    A key that is there already is written again with the same name.
    """

    def write(batches):
        import pandas as pd

        for batch in batches:
            store, path = _at(folder.rstrip("/"))
            store.create_dir(path, recursive=True)
            for k, text in zip(batch["key"], batch["body"]):
                with store.open_output_stream(f"{path}/.{k}") as f:
                    f.write(text.encode())
                store.move(f"{path}/.{k}", f"{path}/{k}{end}")
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.selectExpr(f"`{key}` AS key", f"`{body}` AS body").mapInPandas(write, "n long").groupBy().sum("n").first()[0] or 0
