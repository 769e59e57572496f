"""Encoded images as files, committed together: a writer of Spark's Python data source API.

A task writes to a folder of its own under the target's staging folder and reports what it wrote; the driver moves the files of the tasks
that Spark has accepted and clears the staging folder. A task that fails, runs twice or runs in vain leaves nothing, and a failed job leaves
the target as it was. Files go through Arrow's file systems, so the target may be a URI of any store that these reach.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder, and names with their sizes."""

    folder: str
    files: list[tuple[str, int]]


def safe_name(name: str | None, suffix: str = ".png") -> str:
    """``name`` with its suffix; names that are empty or would leave the folder are refused."""
    if not name or posixpath.isabs(name) or "\\" in name or "\0" in name or any(p in ("", ".", "..") for p in name.split("/")) or name.split("/")[0].startswith(STAGING):
        raise ValueError(f"not a name of a file within the folder: {name!r}")
    return name if name.lower().endswith(suffix) else name + suffix


class ImageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix, self.job = path, suffix, uuid.uuid4().hex
        store, _, staging = self._root()
        store.create_dir(staging, recursive=True)

    def _root(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/{STAGING}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staging = self._root()
        folder, files, made = uuid.uuid4().hex, [], set()

        def folder_of(at: str) -> None:
            """Level by level, so that a task that outlives its job finds no staging folder and does not make one."""
            if at not in made and at != staging:
                folder_of(posixpath.dirname(at))
                store.create_dir(at, recursive=False)
                made.add(at)

        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                target = safe_name(name.as_py(), self.suffix)
                data = content.as_py()
                if data is None:
                    raise ValueError(f"no content for {target}")
                folder_of(posixpath.dirname(f"{staging}/{folder}/{target}"))
                with store.open_output_stream(f"{staging}/{folder}/{target}") as out:
                    out.write(data)
                files.append((target, len(data)))
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, staging = self._root()
        found = [(m.folder, name) for m in messages if m for name, _ in m.files]
        twice = {n for _, n in found if [x for _, x in found].count(n) > 1} if len({n for _, n in found}) < len(found) else set()
        if twice:
            raise ValueError(f"more than one file of the name {min(twice)}")
        for folder, name in found:
            store.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            store.move(f"{staging}/{folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _, staging = self._root()
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class ImageFiles(DataSource):
    """Format image_files; options: path, suffix (.png)."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], self.options.get("suffix", ".png"))


def save_images(encoded: DataFrame, folder: str, suffix: str = ".png") -> None:
    """Writes <folder>/<name>.png for the rows (name, content): all of them, or none."""
    encoded.sparkSession.dataSource.register(ImageFiles)
    encoded.select("name", "content").write.format("image_files").option("suffix", suffix).mode("append").save(folder)
