"""Sources and sinks: text trees, CoNLL and CSV files, archives, OCR result trees and request logs."""

from __future__ import annotations

import hashlib
import io
import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import collapse_whitespace, strip_ws
from .record_files import file_system

KINDS = {"pdf": ["pdf"], "docx": ["docx", "doc"], "image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp"], "text": ["txt", "md"]}


#: Rows and bytes of files that a task hands on at once.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 24
LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")), ("is_dir", pa.bool_())])


def decode(content: bytes | None) -> str | None:
    """UTF-8, else CP949, else null."""
    for coding in ("utf-8", "cp949"):
        try:
            return None if content is None else bytes(content).decode(coding)
        except UnicodeDecodeError:
            pass
    return None


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """UTF-8, else CP949, else null."""
    return content.map(decode)


def kept(df: DataFrame) -> DataFrame:
    """The rows written to ``spark.checkpoint.dir`` at once, or to a temporary folder where a local run has none."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def _hidden(name: str) -> bool:
    """What Spark's own sources leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _spread(df: DataFrame) -> DataFrame:
    """By path, over a stated number of partitions: the rows are small, what tasks do for each is not."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _top(root: str) -> str:
    """The folder as Spark names it."""
    return "file:" + posixpath.normpath("/" + root.removeprefix("file:").lstrip("/")) if root.startswith(("/", "file:")) else root.rstrip("/")


def _listed(folders: DataFrame) -> DataFrame:
    """(path, length, modificationTime, is_dir): what lies in each folder (path), found by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column("path").to_pylist():
                system, at = file_system(folder)
                infos = [i for i in system.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if not _hidden(i.base_name)]
                for k in range(0, len(infos), BATCH_ROWS):
                    part = infos[k : k + BATCH_ROWS]
                    own = [[f"{folder}/{i.base_name}" for i in part], [i.size or 0 for i in part], [i.mtime for i in part], [i.type == pafs.FileType.Directory for i in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(own, LISTED, strict=True)], schema=LISTED)

    return folders.select("path").mapInArrow(run, "path string, length long, modificationTime timestamp, is_dir boolean")


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("",)) -> DataFrame:
    """(path, length, modificationTime) of all files below a folder whose names end in one of the suffixes, empty ones too.

    Folders are listed by tasks, level by level, and each level is kept as a table, so the driver holds no names.  A store
    that only Spark reads is listed by Spark, in the driver.
    """
    try:
        system, at = file_system(root)
    except pa.ArrowException:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
        return _with_suffix(files, suffixes)
    if system.get_file_info(at).type != pafs.FileType.Directory:
        raise FileNotFoundError(root)
    level, found = spark.createDataFrame([(_top(root),)], "path string"), None
    while not level.isEmpty():
        entries = kept(_listed(_spread(level)))
        files, level = entries.filter("NOT is_dir").drop("is_dir"), entries.filter("is_dir")
        found = files if found is None else found.unionByName(files)
    return _with_suffix(found, suffixes)


def _with_suffix(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    return files if "" in suffixes else files.filter(reduce(lambda a, b: a | b, [F.col("path").endswith(x) for x in suffixes]))


def read_files(files: DataFrame) -> DataFrame:
    """The rows with the ``content`` of each file (path), read by tasks one after the other, whatever folders they are in."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, contents, held = [], [], 0
            for path in b.column("path").to_pylist():
                system, at = file_system(path)
                with system.open_input_stream(at) as f:
                    contents.append(f.read())
                paths.append(path)
                held += len(contents[-1])
                if held >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                    paths, contents, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)

    return _spread(files.select("path")).mapInArrow(run, "path string, content binary")


def _files(spark: SparkSession, root: str, *suffixes: str) -> DataFrame:
    """(path, content) of the files below a folder; as in Spark's own sources, empty ones have no row."""
    try:
        file_system(root)
    except pa.ArrowException:
        return _with_suffix(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), suffixes).select("path", "content")
    return read_files(list_files(spark, root, suffixes).filter("length > 0"))


def read_text_corpus(spark: SparkSession, root: str, exts: tuple[str, ...] = ("txt", "md"), min_chars: int = 10) -> DataFrame:
    """(path, text) of all text files below a folder; those shorter than ``min_chars`` without outer blanks are dropped."""
    files = _files(spark, root, *[f".{x}" for x in exts])
    return files.select("path", decode_text("content").alias("text")).filter(F.length(strip_ws(F.col("text"))) >= min_chars)


def _parents_without_files(own: DataFrame) -> DataFrame:
    """(parent, folder): the folders above that have no files of their own, by names alone."""
    names = own.select("folder").distinct()
    above = names.select(F.regexp_extract("folder", r"^(.*)/[^/]*\z", 1).alias("parent"), "folder").filter("parent <> ''")
    return above.join(names.withColumnRenamed("folder", "parent"), "parent", "left_anti")


def _with_parents(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(folder, name, text) of all files; a folder without files of its own also has those of its direct subfolders."""
    path = F.col(path_col)
    own = df.select(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1).alias("folder"), path.alias("name"), F.col(text_col).alias("text"))
    # folders by name alone first, so that texts are copied to those parents only that have none of their own
    return own.unionByName(own.join(_parents_without_files(own), "folder").select(F.col("parent").alias("folder"), "name", "text"))


def folder_parts(df: DataFrame, sep: str = "\n", collapse: bool = False, path_col: str = "path", text_col: str = "text", part_chars: int = 1 << 24) -> DataFrame:
    """S3 in parts: (folder, first, text, n_files, with_text): stretches of a folder's files in order of name, joined by ``sep``.

    The parts of a folder in order of ``first``, those with a text joined by ``sep``, are its document.  Files are
    range-partitioned and sorted by folder and name and joined as they stream by, so a folder of any size is many tasks and
    a part has about ``part_chars`` characters or one file.  Null texts count as files and add nothing; with ``collapse`` runs
    of white space become one space and blank texts add nothing either.
    """
    rows = _with_parents(df, path_col, text_col)
    if collapse:
        rows = rows.withColumn("text", F.nullif(collapse_whitespace(F.col("text")), F.lit("")))
    schema = pa.schema([("folder", pa.string()), ("first", pa.string()), ("text", pa.string()), ("n_files", pa.int64()), ("with_text", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = first = None
        texts: list[str] = []
        held = files = 0

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((folder, first, sep.join(texts) if texts else None, files, len(texts)), schema, strict=True)], schema=schema)

        for b in batches:
            for own, name, text in zip(*[b.column(c).to_pylist() for c in ("folder", "name", "text")], strict=True):
                if files and (own != folder or held >= part_chars):
                    yield part()
                    texts, held, files = [], 0, 0
                if not files:
                    folder, first = own, name
                files += 1
                if text is not None:
                    texts.append(text)
                    held += len(text) + len(sep)
        if files:
            yield part()

    ordered = rows.repartitionByRange("folder", "name").sortWithinPartitions("folder", "name", "text")
    return ordered.mapInArrow(join, "folder string, first string, text string, n_files long, with_text long")


def folder_documents(df: DataFrame, sep: str = "\n", collapse: bool = False, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """S3: (folder, text, n_files): the files of a folder joined in order of name, one row each.

    A folder without text files of its own gets those of its direct subfolders, in order of path.  The variant with
    ``sep=" "`` and ``collapse`` joins with spaces and collapses white space.  A folder's document is one string here;
    ``folder_parts`` has folders that are too large for one, ``folder_digests`` their digests.
    """
    parts = folder_parts(df, sep, collapse, path_col, text_col)
    groups = parts.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("first", "text"))).alias("p"), F.sum("n_files").cast("int").alias("n_files"))
    return groups.select("folder", F.array_join(F.filter("p.text", lambda x: x.isNotNull()), sep).alias("text"), "n_files")


def folder_digests(df: DataFrame, sep: str = "\n", collapse: bool = False, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """S3 without the texts: (folder, digest, n_files), the md5 of each folder's document in UTF-8.

    A digest is sequential, so a folder's files pass one task in order of name, but as a stream: sorted by Spark, which
    spills, and added to the digest one by one, so memory does not grow with the folder.  The files of a folder that also count
    for the folder above are sent once and feed both digests.
    """
    path = F.col(path_col)
    text = F.nullif(collapse_whitespace(F.col(text_col)), F.lit("")) if collapse else F.col(text_col)
    own = df.select(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1).alias("folder"), path.alias("name"), text.cast("binary").alias("text"))
    rows = own.join(_parents_without_files(own), "folder", "left").withColumn("group", F.coalesce("parent", "folder"))
    schema = pa.schema([("folder", pa.string()), ("digest", pa.string()), ("n_files", pa.int64())])

    class Digest:
        def __init__(self, folder: str | None) -> None:
            self.folder, self.md5, self.files, self.texts = folder, hashlib.md5(), 0, 0

        def add(self, text: bytes | None) -> None:
            self.files += 1
            if text is not None:
                if self.texts:
                    self.md5.update(sep.encode())
                self.md5.update(text)
                self.texts += 1

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(*done: Digest | None) -> Iterator[pa.RecordBatch]:
            ended = [d for d in done if d is not None]
            if ended:
                yield pa.RecordBatch.from_arrays([pa.array([d.folder for d in ended], pa.string()), pa.array([d.md5.hexdigest() for d in ended], pa.string()), pa.array([d.files for d in ended], pa.int64())], schema=schema)

        at = above = None
        for b in batches:
            for folder, parent, text in zip(*[b.column(c).to_pylist() for c in ("folder", "parent", "text")], strict=True):
                if above is not None and above.folder != parent:
                    yield from out(above)
                    above = None
                if at is None or at.folder != folder:
                    yield from out(at)
                    at = Digest(folder)
                if parent is not None and above is None:
                    above = Digest(parent)
                at.add(text)
                if parent is not None:
                    above.add(text)
        yield from out(at, above)

    # names that share a folder follow one another in order of name, so one digest of a folder and one of its parent are open
    ordered = rows.repartition("group").sortWithinPartitions("group", "name", "text")
    return ordered.select("folder", "parent", "text").mapInArrow(digests, "folder string, digest string, n_files long").withColumn("n_files", F.col("n_files").cast("int"))


def parse_conll(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, sent_id from 0, tokens, labels) of CoNLL texts, one row each.

    Lines are stripped, so a blank token is dropped; a line without exactly two parts is dropped; an empty line ends a
    sentence.  All work stays within the file, so parallelism is that of the files.
    """
    blocks = F.split(F.regexp_replace(F.col(text_col), r"(?m)^[ \t\r]+|[ \t\r]+$", ""), r"\n{2,}")
    lines = F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.split(x, "\t")), lambda p: F.size(p) == 2))
    rows = files.select(F.col(path_col).alias("path"), F.posexplode(F.filter(lines, lambda x: F.size(x) > 0)).alias("sent_id", "p"))
    return rows.select("path", "sent_id", F.transform("p", lambda x: x[0]).alias("tokens"), F.transform("p", lambda x: x[1]).alias("labels"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(path, sent_id from 0, tokens, labels) of CoNLL files, split inside a file.

    Spark's text source reads records that end at an empty line, so a file of any size is many tasks; a record may hold several
    sentences where a line of blanks stands between them.  Sentences are numbered inside the split of a file, then by the
    number of those in the splits before.
    """
    blocks = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", "true").text(path)
    blocks = blocks.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    rows = parse_conll(blocks.select(F.struct("path", "block", "at").alias("key"), "text"), "key").select("path.*", F.col("sent_id").alias("k"), "tokens", "labels")
    own = W.partitionBy("path", "block")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("at", "k")) - 1)
    counts = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("path", "block", F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, ["path", "block"]).select("path", (F.col("before") + F.col("place")).cast("int").alias("sent_id"), "tokens", "labels")


def conll_text(tokens: Column, labels: Column) -> Column:
    """The lines of a sentence and the empty line after it."""
    return F.concat(F.array_join(F.zip_with(tokens, labels, lambda a, b: F.concat(a, F.lit("\t"), b)), "\n"), F.lit("\n"))


def write_conll(df: DataFrame, path: str) -> None:
    df.select(conll_text(F.col("tokens"), F.col("labels")).alias("value")).write.mode("overwrite").text(path)


def read_field_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV files with a header (a byte order mark is dropped), put together; columns that a file lacks are null."""
    out = None
    for p in paths:
        df = spark.read.option("header", "true").option("multiLine", "true").option("escape", "\"").csv(p)  # quotes are doubled
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _members(content: bytes, pdf_only: bool) -> Iterator[tuple[str, bool, bytes | None, str | None]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                pdf = info.filename.lower().endswith(".pdf")
                if not pdf_only:
                    yield info.filename, pdf, None, None
                elif pdf:
                    try:
                        yield info.filename, pdf, z.read(info), None
                    except Exception as e:  # one bad member does not stop the rest
                        yield info.filename, pdf, None, f"{type(e).__name__}: {e}"
    except zipfile.BadZipFile as e:
        yield "", False, None, f"BadZipFile: {e}"


def list_archive_members(spark: SparkSession, root: str) -> DataFrame:
    """(archive, member, is_pdf, error) of all ZIP files; a broken one gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, m, pdf, e) for p, c in zip(b["path"], b["content"], strict=True) for m, pdf, _, e in _members(c, False)]
            yield pd.DataFrame(rows, columns=["archive", "member", "is_pdf", "error"])

    return _files(spark, root, ".zip").select("path", "content").mapInPandas(run, "archive string, member string, is_pdf boolean, error string")


def extract_archive_members(spark: SparkSession, root: str) -> DataFrame:
    """(archive, name, content, error): PDF members under `{archive stem}_{base name}`; one member in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for m, _, data, e in _members(c, True):
                    yield pd.DataFrame({"archive": [p], "name": [f"{stem}_{m.rsplit('/', 1)[-1]}"], "content": [data], "error": [e]})

    return _files(spark, root, ".zip").select("path", "content").mapInPandas(run, "archive string, name string, content binary, error string")


def inventory_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, kind) without reading any content."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    kind = F.lit("unsupported")
    for name, exts in KINDS.items():
        kind = F.when(ext.isin(exts), F.lit(name)).otherwise(kind)
    return list_files(spark, root).select("path", "length", "modificationTime", kind.alias("kind"))


def scan_ocr_results(spark: SparkSession, root: str, providers: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """(provider, category, doc, text) of a tree provider/category/doc/{doc}_extracted_text.txt.

    Only the folders of the providers and categories asked for are listed, by tasks; the names of documents do not pass through
    the driver.
    """

    def level(above: DataFrame, names: list[str] | None) -> DataFrame:
        if names is None:
            return _listed(above).filter("is_dir").select("path")
        return above.select(F.explode(F.array(*[F.concat("path", F.lit(f"/{n}")) for n in dict.fromkeys(names)])).alias("path"))

    docs = _listed(_spread(level(level(spark.createDataFrame([(_top(root),)], "path string"), providers), categories))).filter("is_dir")
    files = read_files(_listed(_spread(docs)).filter(F.col("path").endswith("_extracted_text.txt") & ~F.col("is_dir") & (F.col("length") > 0)))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -4).alias("provider"), F.element_at(parts, -3).alias("category"), F.element_at(parts, -2).alias("doc"), decode_text("content").alias("text"))


def read_request_log(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Request entries, one JSON object per file, or per line where files hold several."""
    return spark.read.schema("timestamp string, log_file string, method string, path string, status int, body string").option("multiLine", str(whole_files).lower()).json(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines of a cluster share; a local run may use a temporary one."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='paperloom-')}/{uuid.uuid4()}"
