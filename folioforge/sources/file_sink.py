"""One file per row with a commit: tasks write to a staging folder, the driver moves whole results into place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..storage import resolve


@dataclass
class Staged(WriterCommitMessage):
    """A task attempt's folder and its number of files; names stay in the folder."""

    folder: str
    files: int


class FilePerRow(DataSource):
    """Rows of (name, value) as files below a folder; value is text or bytes."""

    @classmethod
    def name(cls) -> str:
        return "folioforge_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["folder"], self.options["staging"], self.options.get("pretty") == "true")


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, staging: str, pretty: bool):
        self.folder, self.staging, self.pretty = folder, staging, pretty

    def write(self, rows: Iterator) -> Staged:
        """Every attempt has a folder of its own, so a retried or speculative task meets none of another's files."""
        system, base = resolve(self.folder)
        own, count, made = f"{self.staging}/{uuid.uuid4().hex}", 0, set()
        for name, value in rows:
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name below the folder: {name!r}")
            if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                raise FileExistsError(f"{base}/{name}")
            path = f"{own}/{name}"
            if system.get_file_info(path).type != fs.FileType.NotFound:
                raise FileExistsError(f"two rows are named {name}")
            if self.pretty:
                value = json.dumps(json.loads(value), ensure_ascii=False, indent=2)
            folder = path.rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(path, compression=None) as out:
                out.write(value.encode() if isinstance(value, str) else bytes(value or b""))
            count += 1
        return Staged(own, count)

    def commit(self, messages: list[Staged | None]) -> None:
        """Nothing is moved before every name is known to be free and single; files of one attempt move side by side."""
        system, base = resolve(self.folder)
        moves: dict[str, str] = {}
        for message in messages:
            if message is None or not message.files:
                continue
            found = [i.path for i in system.get_file_info(fs.FileSelector(message.folder, recursive=True)) if i.is_file]
            if len(found) != message.files:
                raise OSError(f"{message.folder} has {len(found)} of {message.files} files")
            for path in found:
                name = path[len(message.folder) + 1 :]
                if name in moves or system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{base}/{name}")
                moves[name] = path
        for folder in {f"{base}/{name}".rpartition("/")[0] for name in moves}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: system.move(m[1], f"{base}/{m[0]}"), moves.items()))
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, _ = resolve(self.folder)
        if system.get_file_info(self.staging).type != fs.FileType.NotFound:
            system.delete_dir(self.staging)


def write_files(df: DataFrame, folder: str, name: str, value: str, pretty: bool = False) -> None:
    """One file per row below a folder (a URI or a local path), all or none.

    name is a column of relative paths, value one of text or bytes (null: an empty file), written as it is; pretty indents JSON text by two.
    An existing file, two rows of one name or a name outside the folder are errors and leave the folder as it was. Files of failed attempts
    lie in a hidden staging folder until the job ends. The driver moves files one by one, by name only; so this sink is for the
    side files of documents, and tables are for what is read again.
    """
    system, base = resolve(folder)
    staging = f"{base}/.staging-{uuid.uuid4().hex}"
    df.sparkSession.dataSource.register(FilePerRow)
    rows = df.select(df[name].cast("string").alias("name"), df[value].alias("value"))
    try:
        rows.write.format("folioforge_files").option("folder", folder).option("staging", staging).option("pretty", str(pretty).lower()).mode("append").save()
    finally:
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)
