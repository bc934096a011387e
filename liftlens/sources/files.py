"""Folders of exact files: a reader of every file by its name, and a writer of crawl folders.

Spark's own file readers hide names that start with ``_`` and hold a file whole. The reader here lists a folder, gives each
task a group of names and reads them in pieces; the writer stores one file for each page and the index that names them.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from liftlens import constants as C
from liftlens.session import materialize, small_batches

#: A task reads about so many bytes or names; a file is hashed or copied in pieces of ``PIECE``, bodies leave in batches of it.
GROUP_BYTES, GROUP_NAMES, PIECE = 64 << 20, 2_000, 4 << 20
INDEX = "index.csv"


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by a path or an address."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


@dataclass
class Names(InputPartition):
    """A group of file names below the folder."""

    names: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, path: str, hashed: bool):
        self.path, self.hashed = path.rstrip("/"), hashed

    def partitions(self) -> list[Names]:
        """Groups of names in order; sizes come from the listing, no file is opened."""
        store, root = storage(self.path)
        groups, held = [Names([])], 0
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File:
                continue
            if groups[-1].names and (held + info.size > GROUP_BYTES or len(groups[-1].names) >= GROUP_NAMES):
                groups.append(Names([]))
                held = 0
            groups[-1].names.append(info.path[len(root):].lstrip("/"))
            held += info.size
        return groups

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        store, root = storage(self.path)
        kind = pa.string() if self.hashed else pa.binary()
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([v for _, v in rows], kind)],
                                              names=["path", "sha256" if self.hashed else "content"])

        for name in partition.names:
            with store.open_input_stream(f"{root}/{name}") as stream:
                if self.hashed:
                    digest = hashlib.sha256()
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                    rows.append((name, digest.hexdigest()))
                else:
                    rows.append((name, stream.read()))
                    held += len(rows[-1][1])
            if held >= PIECE:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class Folder(DataSource):
    """(``path``, ``content``) of every file below a folder, or (``path``, ``sha256``) with the option ``hashed``."""

    @classmethod
    def name(cls) -> str:
        return "exact_folder"

    def schema(self) -> str:
        return "path string, sha256 string" if self.options.get("hashed") == "true" else "path string, content binary"

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("hashed") == "true")


def read_folder(spark: SparkSession, path: str, hashed: bool = False) -> DataFrame:
    """Every file below ``path``, whatever its name; an empty folder gives no rows and an absent one is an error."""
    spark.dataSource.register(Folder)
    return spark.read.format(Folder.name()).option("hashed", str(hashed).lower()).option("path", path).load()


def read_bodies(named: DataFrame, path: str, keep: Sequence[str]) -> DataFrame:
    """``named`` rows (``keep`` columns) with the ``content`` of the ``file`` below ``path`` that each one names, null where there is none.

    The rows are dealt over tasks that open their own files: no folder is listed and no body is shuffled.
    """
    spark = named.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = named.select(*keep, "file").repartition(parts, *keep)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = storage(path.rstrip("/"))

        def content(name: str) -> bytes | None:
            if not name or any(part in ("", ".", "..") for part in name.split("/")):
                return None
            try:
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    return stream.read()
            except OSError:
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    raise
                return None

        def batch(rows: pa.RecordBatch, held: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(held, pa.binary())], names=[*keep, "content"])

        for rows in batches:
            first, held, size = 0, [], 0
            for name in rows.column(rows.num_columns - 1).to_pylist():
                held.append(content(name))
                size += len(held[-1] or b"")
                if size >= PIECE:
                    yield batch(rows.slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield batch(rows.slice(first, len(held)), held)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{ddl}, content binary")


@dataclass
class Pieces(WriterCommitMessage):
    """Parts of the index that a task has written, each with its first page number, and the file that names its bodies."""

    rows: list[tuple[int, str]]
    bodies: str


class CrawlWriter(DataSourceWriter):
    """Bodies get their names from the page numbers, so a repeated task writes the same files; the index comes last.

    Each task keeps its rows of the index, a file for every run of consecutive numbers, and the names of its bodies beside the
    folder. The commit strings the runs together by their numbers and moves the index into place: a folder without an index is no crawl.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.work = f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Pieces:
        store, root = storage(self.path)
        _, work = storage(self.work)
        store.create_dir(root, recursive=True)
        store.create_dir(work, recursive=True)
        made, last, rows = Pieces([], f"{work}/bodies-{uuid.uuid4().hex}"), None, None
        with store.open_output_stream(made.bodies) as bodies:
            for row in iterator:
                if last is None or row.number != last + 1:
                    if rows:
                        rows.close()
                    made.rows.append((row.number, f"{work}/rows-{uuid.uuid4().hex}"))
                    rows = store.open_output_stream(made.rows[-1][1])
                last = row.number
                name = f"page_{row.number:04d}.html" if row.html else ""
                if name:
                    bodies.write(f"{name}\n".encode())
                    with store.open_output_stream(f"{root}/{name}") as body:
                        body.write(row.html.encode())
                line = io.StringIO()
                csv.writer(line, lineterminator="\n").writerow([row.url, name, row.status, row.content_type or ""])
                rows.write(line.getvalue().encode())
        if rows:
            rows.close()
        return made

    def commit(self, messages: list[Pieces | None]) -> None:
        store, root = storage(self.path)
        _, work = storage(self.work)
        store.create_dir(root, recursive=True)
        store.create_dir(work, recursive=True)
        with store.open_output_stream(f"{work}/{INDEX}") as index:
            index.write((",".join(C.CRAWL_INDEX_COLUMNS) + "\n").encode())
            for _, piece in sorted(run for m in messages if m for run in m.rows):
                with store.open_input_stream(piece) as rows:
                    while part := rows.read(PIECE):
                        index.write(part)
        store.move(f"{work}/{INDEX}", f"{root}/{INDEX}")
        store.delete_dir(work)

    def abort(self, messages: list[Pieces | None]) -> None:
        """Bodies of finished tasks go; what a broken task has left is overwritten by the next attempt."""
        store, root = storage(self.path)
        for made in (m for m in messages if m):
            with store.open_input_stream(made.bodies) as bodies:
                for name in io.TextIOWrapper(bodies, encoding="utf-8"):
                    store.delete_file(f"{root}/{name.rstrip()}")
        if messages and any(messages):
            store.delete_dir(storage(self.work)[1])


class CrawlFolder(DataSource):
    """Sink of numbered crawl rows."""

    @classmethod
    def name(cls) -> str:
        return "crawl_folder"

    def writer(self, schema: StructType, overwrite: bool) -> CrawlWriter:
        return CrawlWriter(self.options["path"])


def write_crawl(crawl: DataFrame, path: str) -> None:
    """Store a crawl as one file for each page with a body and an index ordered by url, then ``seq``.

    A stored crawl is never overwritten. Null or empty bodies have no file, but every row has a number and a row in the index.
    Rows are numbered within sorted ranges; only the sizes of the ranges, one for each task, are added up.
    """
    spark = crawl.sparkSession
    store, root = storage(path.rstrip("/"))
    if store.get_file_info(f"{root}/{INDEX}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} exists already and holds a crawl")
    spark.dataSource.register(CrawlFolder)
    small_batches(spark)
    at = F.monotonically_increasing_id()
    ranged = materialize(crawl.select("url", "status", "content_type", "html", "seq").repartitionByRange("url", "seq")
                         .sortWithinPartitions("url", "seq")
                         .select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "crawl_rows")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    # At most one row for each task of the sort above.
    shifts = (sizes.agg(F.array_sort(F.collect_list(F.struct("part", "size"))).alias("sizes"))
              .select(F.posexplode("sizes").alias("place", "own"), "sizes")
              .select(F.col("own.part").alias("part"),
                      F.aggregate(F.slice("sizes", F.lit(1), F.col("place")), F.lit(0).cast("bigint"), lambda a, s: a + s["size"]).alias("shift")))
    numbered = ranged.join(F.broadcast(shifts), "part").select(
        (F.col("shift") + F.col("at") + 1).alias("number"), "url", "status", "content_type", "html")
    numbered.write.format(CrawlFolder.name()).mode("append").option("path", path).save()
