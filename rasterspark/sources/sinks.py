"""A sink for assets: one file a row, or stored ZIP archives, as a Spark data source.

    spark.dataSource.register(AssetSink)
    assets.write.format("assets").mode("append").save("/shared/folder")              # one file a row
    assets.write.format("assets").option("zip", "assets").mode("append").save(...)   # one archive a partition

Rows are (name string, content binary). The folder must be one that all executors share, mounted as a
path. Tasks write under hidden names and files appear only when the whole job has succeeded, so a
task that is lost and runs again leaves no duplicate. Names have to be unique (unique_names); files of
the same name are replaced.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Members of an archive carry no time, so equal assets give equal archives.
EPOCH = (1980, 1, 1, 0, 0, 0)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # hidden path, final path


class AssetWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.archive = options["path"].removeprefix("file:"), options.get("zip")

    def write(self, batches) -> Written:
        part = TaskContext.get().partitionId()
        os.makedirs(self.folder, exist_ok=True)
        hidden = lambda: os.path.join(self.folder, f".{uuid.uuid4().hex}")
        rows = ((n, c or b"") for b in batches for n, c in zip(b.column("name").to_pylist(), b.column("content").to_pylist()))
        files = []
        if self.archive:
            path, empty = hidden(), True
            with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
                for name, content in rows:
                    archive.writestr(zipfile.ZipInfo(name, EPOCH), content)
                    empty = False
            if empty:
                os.remove(path)
            else:
                files.append((path, os.path.join(self.folder, f"{self.archive}-{part:05d}.zip")))
        else:
            for name, content in rows:
                if name in ("", ".", "..") or "/" in name:
                    raise ValueError(f"not a file name: {name!r}")
                path = hidden()
                with open(path, "wb") as f:
                    f.write(content)
                files.append((path, os.path.join(self.folder, name)))
        return Written(files)

    def commit(self, messages):
        for message in messages:
            for path, final in message.files:
                os.replace(path, final)

    def abort(self, messages):
        for message in messages:
            for path, _ in message.files if message else ():
                if os.path.exists(path):
                    os.remove(path)


class AssetSink(DataSource):
    @classmethod
    def name(cls):
        return "assets"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return AssetWriter(self.options)
