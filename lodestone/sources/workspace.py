"""A folder of files as a table: unlike Spark's own readers it sees hidden names and never leaves its root."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PER_TASK = 500


class Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Reader(DataSourceReader):
    def __init__(self, options: dict, with_content: bool):
        self.root = os.path.realpath(options["path"])
        self.most, self.with_content = int(options.get("maxFileSize", 10 << 20)), with_content
        self.errors = options.get("errors", "latin-1")
        if self.errors not in ("latin-1", "ignore", "strict"):
            raise ValueError("errors is latin-1, ignore or strict")

    def partitions(self):
        names = []
        for folder, _, files in os.walk(self.root):
            for f in files:
                full = os.path.join(folder, f)
                if os.path.realpath(full).startswith(self.root + os.sep):
                    names.append(os.path.relpath(full, self.root))
        names.sort()
        return [Part(names[i : i + PER_TASK]) for i in range(0, len(names), PER_TASK)] or [Part([])]

    def read(self, partition: Part):
        for name in partition.names:
            full = os.path.join(self.root, name)
            size = os.path.getsize(full)
            if not self.with_content:
                yield name, size
                continue
            if size > self.most:
                yield name, None, size, None, f"larger than {self.most} bytes"
                continue
            with open(full, "rb") as f:
                data = f.read()
            try:
                yield name, data.decode(), size, "utf-8", None
            except UnicodeDecodeError as e:
                if self.errors == "strict":
                    yield name, None, size, None, str(e)
                elif self.errors == "ignore":
                    yield name, data.decode(errors="ignore"), size, "utf-8", None
                else:
                    yield name, data.decode("latin-1"), size, "latin-1", None


class Workspace(DataSource):
    """spark.read.format("workspace").load(folder): (path, content, size, encoding, error). Files of more than maxFileSize
    bytes have an error and no content. What isn't UTF-8 is read as Latin-1, with errors=ignore without the wrong bytes,
    and with errors=strict not at all, which is an error of that file."""

    @classmethod
    def name(cls):
        return "workspace"

    def schema(self):
        return "path string, content string, size long, encoding string, error string"

    def reader(self, schema):
        return Reader(self.options, True)


class WorkspaceNames(DataSource):
    """The same without contents: (path, size)."""

    @classmethod
    def name(cls):
        return "workspace_names"

    def schema(self):
        return "path string, size long"

    def reader(self, schema):
        return Reader(self.options, False)


def register(spark) -> None:
    spark.dataSource.register(Workspace)
    spark.dataSource.register(WorkspaceNames)
