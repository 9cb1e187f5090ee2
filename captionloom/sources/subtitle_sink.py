"""A Spark sink for subtitle documents: a file a job and language, or many jobs in one archive with an index."""

from __future__ import annotations

import dataclasses
import io
import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of text that an archive holds: what a task of read_caption_archives() takes in at a time.
ARCHIVE_BYTES = 32 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path: a local or mounted one, or any that Arrow has a client for."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _entry(r: Row) -> tuple[str, str]:
    """Folder and file of a document. Names are names: none leads anywhere else."""
    names = (r["job_id"], r["lang"], r["ext"])
    if any(not n or "/" in n or "\\" in n or n.startswith(".") for n in names):
        raise ValueError(f"no file can be named after {names}")
    return names[0], f"{names[1]}.{names[2]}"


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """What a task has staged: names that wait in the run's folder, and how many documents they hold."""

    names: list[str]
    documents: int


class SubtitleWriter(DataSourceWriter):
    """Tasks write into a staging folder of the run; only the commit puts what they wrote in place, and an abort drops it."""

    def __init__(self, path: str, archive: bool, overwrite: bool, most: int):
        self.path, self.archive, self.overwrite, self.most = path.rstrip("/"), archive, overwrite, most
        self.run = uuid.uuid4().hex
        store, at = _open(self.path)
        store.create_dir(self._staging(at), recursive=True)  # only here: a task that outlives an abort can't bring it back

    def _staging(self, at: str) -> str:
        return f"{at}/_staged-{self.run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = _open(self.path)
        task = TaskContext.get()
        own = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        return self._archives(iterator, store, at, own) if self.archive else self._files(iterator, store, at, own)

    def _files(self, rows: Iterable[Row], store: fs.FileSystem, at: str, own: str) -> Written:
        """One staged folder a task, with the tree that the commit merges into the table's."""
        n = 0
        for r in rows:
            job, file = _entry(r)
            if not n:
                store.create_dir(f"{self._staging(at)}/{own}", recursive=False)
            store.create_dir(folder := f"{self._staging(at)}/{own}/{job}", recursive=False)
            with store.open_output_stream(f"{folder}/{file}") as f:
                f.write((r["value"] or "").encode())
            n += 1
        return Written([own] if n else [], n)

    def _archives(self, rows: Iterable[Row], store: fs.FileSystem, at: str, own: str) -> Written:
        names: list[str] = []
        n = size = 0
        held, entries = io.BytesIO(), []
        archive = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)

        def close() -> None:
            nonlocal held, entries, archive, size
            archive.close()
            if entries:
                name = f"{self.run}-{own}-{len(names):04d}"
                for end, data in ((".zip", held.getvalue()), (".index.json", "".join(json.dumps(e | {"archive": f"{name}.zip"}) + "\n" for e in entries).encode())):
                    with store.open_output_stream(f"{self._staging(at)}/{name}{end}") as f:
                        f.write(data)
                names.append(name)
            held, entries, size = io.BytesIO(), [], 0
            archive = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)

        for r in rows:
            data = (r["value"] or "").encode()
            if entries and size + len(data) > self.most:
                close()
            entry = "/".join(_entry(r))
            archive.writestr(zipfile.ZipInfo(entry), data, zipfile.ZIP_DEFLATED)
            entries.append({"job_id": r["job_id"], "lang": r["lang"], "ext": r["ext"], "entry": entry})
            n, size = n + 1, size + len(data)
        close()
        return Written(names, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _open(self.path)
        done = [m for m in messages if m]
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(at)):
                if not info.base_name.startswith("_staged-"):
                    store.delete_dir(info.path) if info.type == fs.FileType.Directory else store.delete_file(info.path)
        there = {info.base_name for info in store.get_file_info(fs.FileSelector(at))}
        for name in (x for m in done for x in m.names):
            if self.archive:
                for end in (".index.json", ".zip"):
                    store.move(f"{self._staging(at)}/{name}{end}", f"{at}/{name}{end}")
                continue
            for job in store.get_file_info(fs.FileSelector(f"{self._staging(at)}/{name}")):
                if isinstance(store, fs.LocalFileSystem) and job.base_name not in there:  # a new job's folder moves as it is
                    store.move(job.path, f"{at}/{job.base_name}")
                    there.add(job.base_name)
                    continue
                store.create_dir(f"{at}/{job.base_name}")
                for file in store.get_file_info(fs.FileSelector(job.path)):
                    store.move(file.path, f"{at}/{job.base_name}/{file.base_name}")
        self.abort(messages)
        with store.open_output_stream(f"{at}/_SUCCESS") as f:
            f.write(json.dumps({"documents": sum(m.documents for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _open(self.path)
        if store.get_file_info(self._staging(at)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(at))


class SubtitleSink(DataSource):
    """format("subtitles"): rows (job_id, lang, ext, value) to `<job>/<lang>.<ext>`, or with layout=archive to archives of
    archive_bytes of text each, every one with an index of JSON lines (job_id, lang, ext, entry, archive)."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return "job_id string, lang string, ext string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> SubtitleWriter:
        layout = self.options.get("layout", "files")
        if layout not in ("files", "archive"):
            raise ValueError("layout must be files or archive")
        return SubtitleWriter(self.options["path"], layout == "archive", overwrite, int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def save_subtitles(documents: DataFrame, path: str, layout: str = "files", lang: str = "en", ext: str = "vtt", mode: str = "overwrite", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write rendered documents (job_id, value[, lang][, ext]) under the names that players look for: `<job>/<lang>.<ext>`.

    Nothing is seen before all tasks are done, and nothing stays of a run that fails. `files` is for few jobs, whose names
    the commit moves one by one; `archive` packs many jobs into few files. path must be one that all executors reach: a
    mounted folder, or a store that Arrow has a client for.
    """
    documents.sparkSession.dataSource.register(SubtitleSink)
    given = {c: F.col(c) if c in documents.columns else F.lit(v) for c, v in (("lang", lang), ("ext", ext))}
    rows = documents.select(F.col("job_id").cast("string").alias("job_id"), *[F.coalesce(c.cast("string"), F.lit(v)).alias(n) for (n, c), v in zip(given.items(), (lang, ext), strict=True)], "value")
    rows.write.format("subtitles").option("layout", layout).option("archive_bytes", archive_bytes).mode(mode).save(path)


def read_caption_archives(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, path, ext, content) of all documents in the archives under path; an entry's path is `<archive>!<entry>`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                    texts = [archive.read(n).decode("utf-8", "ignore").removeprefix("﻿") for n in names]
                yield pd.DataFrame({"job_id": [n.rpartition("/")[0].rpartition("/")[2] for n in names], "path": [f"{at}!{n}" for n in names], "ext": [n.rpartition(".")[2].lower() for n in names], "content": texts})

    return files.mapInPandas(run, "job_id string, path string, ext string, content string")
