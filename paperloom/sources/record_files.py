"""One file for each record: a data source writer with task and job commit, and the move to the final names as a Spark job.

``write_files`` goes through three states that a restart can tell apart.  Tasks write below a staging folder of the job, each
attempt in a folder of its own, and list the names at its end.  When all tasks are done, the job commit writes the list of
their attempts; a job that fails takes its staging folder away, and ``recover`` what a task still at work then wrote there.  What is committed is then moved to its
final names by tasks; moving again what has been moved does nothing, so ``recover`` finishes a move that was cut off.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING, COMMITTED = "_staging", "committed.jsonl"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Spark writes them."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class RecordFiles(DataSource):
    """Format ``record_files``: rows (name, content), each a file ``name`` below the path; option ``job`` names the job."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(self.options["path"], self.options["job"])


class RecordWriter(DataSourceWriter):
    def __init__(self, path: str, job: str) -> None:
        self.path, self.job = path, job

    def _staging(self, root: str) -> str:
        return posixpath.join(root, STAGING, self.job)

    def write(self, iterator: Iterator) -> Attempt:
        system, root = file_system(self.path)
        task = TaskContext.get()
        folder = f"{task.partitionId()}-{task.taskAttemptId()}"
        at, known, names = posixpath.join(self._staging(root), folder), set(), []
        for row in iterator:
            target = posixpath.normpath(posixpath.join(at, "files", row.name))
            if not target.startswith(posixpath.join(at, "files") + "/"):
                raise ValueError(f"a name leads out of the folder: {row.name}")
            parent = posixpath.dirname(target)
            if parent not in known:
                system.create_dir(parent)
                known.add(parent)
            with system.open_output_stream(target) as out:
                out.write(row.content.encode())
            names.append(row.name)
        system.create_dir(at)
        with system.open_output_stream(posixpath.join(at, "names.jsonl")) as out:
            out.write("".join(json.dumps({"folder": folder, "name": n}) + "\n" for n in names).encode())
        return Attempt(folder, len(names))

    def commit(self, messages: list[Attempt]) -> None:
        """One line for each task; only these attempts count."""
        system, root = file_system(self.path)
        system.create_dir(self._staging(root))
        with system.open_output_stream(posixpath.join(self._staging(root), COMMITTED)) as out:
            out.write("".join(json.dumps({"folder": m.folder, "files": m.files}) + "\n" for m in messages if m).encode())

    def abort(self, messages: list[Attempt]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(self._staging(root)).type == pafs.FileType.Directory:
            system.delete_dir(self._staging(root))


def spread_files(rows: DataFrame) -> DataFrame:
    """By name, over a stated number of partitions: adaptive execution would join partitions by their size, but each file costs."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")


def stage_files(rows: DataFrame, out: str, job: str) -> None:
    """Rows (name, content) written below the staging folder and committed there."""
    rows.sparkSession.dataSource.register(RecordFiles)
    rows.select("name", "content").write.format("record_files").mode("append").option("path", out).option("job", job).save()


def committed(out: str, job: str) -> bool:
    system, root = file_system(out)
    return system.get_file_info(posixpath.join(root, STAGING, job, COMMITTED)).type == pafs.FileType.File


def move_files(spark: SparkSession, out: str, job: str) -> None:
    """The committed files of a job moved to their names by tasks, then its staging folder taken away."""
    system, root = file_system(out)
    staging = posixpath.join(root, STAGING, job)
    attempts = spark.read.schema("folder string, files long").json(f"{out}/{STAGING}/{job}/{COMMITTED}").filter("files > 0")
    if not attempts.isEmpty():
        names = spark.read.schema("folder string, name string").json(f"{out}/{STAGING}/{job}/*/names.jsonl").join(F.broadcast(attempts.select("folder")), "folder")

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = file_system(out)
            known = set()
            for b in batches:
                for folder, name in zip(b.column("folder").to_pylist(), b.column("name").to_pylist(), strict=True):
                    source, target = posixpath.join(root, STAGING, job, folder, "files", name), posixpath.normpath(posixpath.join(root, name))
                    parent = posixpath.dirname(target)
                    if parent not in known:
                        system.create_dir(parent)
                        known.add(parent)
                    if system.get_file_info(source).type == pafs.FileType.File:  # else an earlier try has moved it
                        system.move(source, target)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["moved"])

        names.mapInArrow(move, "moved long").agg(F.sum("moved")).collect()

        def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = file_system(out)
            for b in batches:
                for folder in b.column("folder").to_pylist():
                    files = posixpath.join(root, STAGING, job, folder, "files")
                    if system.get_file_info(files).type == pafs.FileType.Directory:
                        system.delete_dir(files)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["cleared"])

        # a folder for each file may have been left, too many for the driver alone
        spread = attempts.select("folder").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")
        spread.mapInArrow(clear, "cleared long").agg(F.sum("cleared")).collect()
    system.delete_dir(staging)


def recover(spark: SparkSession, out: str) -> list[str]:
    """Finishes the moves of committed jobs and takes away what other jobs left; gives the jobs that were finished."""
    system, root = file_system(out)
    top = posixpath.join(root, STAGING)
    if system.get_file_info(top).type != pafs.FileType.Directory:
        return []
    done = []
    for info in system.get_file_info(pafs.FileSelector(top)):
        job = posixpath.basename(info.path)
        if committed(out, job):
            move_files(spark, out, job)
            done.append(job)
        else:
            system.delete_dir(info.path)
    return done


def write_files(rows: DataFrame, out: str, job: str | None = None) -> None:
    """Rows (name, content) as files below ``out``: all of them or, where the job fails, none.

    A name that exists is replaced, and of rows that repeat a name one wins.  A ``job`` that was committed before is not
    written again, only moved to its end.
    """
    job = job or uuid.uuid4().hex
    if not committed(out, job):
        stage_files(rows, out, job)
    move_files(rows.sparkSession, out, job)
