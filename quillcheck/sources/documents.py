"""Tables of texts as documents of their own: one file for each row, written by the executors.

``register`` adds the format ``quillcheck_documents`` for writing rows (name, text). Tasks write into a temporary folder beside the files;
when all have ended, the files are renamed into their places, and if a task fails for good, the folder goes and nothing is left. The
folder may be on any file system that pyarrow knows. Names are quoted, so that each is one file of the folder.
"""

from __future__ import annotations

import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _folder(path: str):
    """File system and path of a folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace = path.rstrip("/"), replace
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, top = _folder(self.path)
        done = _Written(f"{self.job}/{uuid.uuid4().hex}")
        store.create_dir(f"{top}/{done.folder}")
        for row in iterator:
            name = urllib.parse.quote(row["name"] or "", safe=" ()[]")
            if name in ("", ".", ".."):
                raise ValueError(f"no file can have the name {row['name']!r}")
            with store.open_output_stream(f"{top}/{done.folder}/{name}") as out:
                out.write((row["text"] or "").encode())
            done.names.append(name)
        return done

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, top = _folder(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        there = {f.base_name for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True))}
        try:
            if len({*names}) < len(names):
                raise ValueError("several documents have the same name")
            if not self.replace and there & {*names}:
                raise FileExistsError(f"{top} has documents of these names already")
            for m in done:
                for name in m.names:
                    store.move(f"{top}/{m.folder}/{name}", f"{top}/{name}")
        finally:
            self._clean(store, top)

    def abort(self, messages: list) -> None:
        self._clean(*_folder(self.path))

    def _clean(self, store, top: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{self.job}")


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillcheck_documents"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)


def write_documents(rows: DataFrame, path: str, name: str, text: str, replace: bool = True) -> None:
    """Write each row's text as a file of its own."""
    register(rows.sparkSession)
    rows.select(F.col(name).alias("name"), F.col(text).alias("text")).write.format("quillcheck_documents").mode("overwrite" if replace else "append").save(path)
