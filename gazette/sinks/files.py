"""Writers: rendered rows to files that all machines share, and tables with partitions replaced or dropped."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gazette.staging import small_batches

#: Names of a job's files before they count, and of its number of files; files that the driver moves at a time.
_PENDING, _COUNT, MOVES = ".pending-", ".count-", 16


def put_in_place(store: pyarrow.fs.FileSystem, own: str, final: str) -> None:
    """Renames a finished file over the one that was there; stores that cannot rename over files lose the old one just before."""
    try:
        store.move(own, final)
    except OSError:
        if store.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
            raise
        store.delete_file(final)
        store.move(own, final)


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: the folder of its attempt, and how many files are in it."""

    folder: str
    files: int


class PagesWriter(DataSourceArrowWriter):
    """Each attempt of a task writes into a folder of its own beside the target; the driver moves the files of those that count into place, or drops all."""

    def __init__(self, options):
        self.target, self.job, self.pieces = options["path"].rstrip("/"), options["job"], options.get("pieces") == "true"

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.target)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = self._store()
        own, n, last, out = f"{base}/{_PENDING}{self.job}/{uuid.uuid4().hex}", 0, None, None
        try:
            for b in iterator:
                for path, content in zip(b.column("path"), b.column("content")):
                    path = path.as_py()
                    if not (self.pieces and path == last and out):
                        if out:
                            out.close()
                        store.create_dir(f"{own}/{path}".rpartition("/")[0])
                        last, out, n = path, store.open_output_stream(f"{own}/{path}", compression=None, buffer_size=1 << 20), n + 1
                    out.write(content.as_py().encode())
        finally:
            if out:
                out.close()
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        done = [m for m in messages if m]

        def move(own: str, file: str) -> None:
            final = base + file.removeprefix(own)
            store.create_dir(final.rpartition("/")[0])
            put_in_place(store, file, final)

        moves = [(m.folder, f.path) for m in done if m.files for f in store.get_file_info(pyarrow.fs.FileSelector(m.folder, recursive=True)) if f.type == pyarrow.fs.FileType.File]
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda x: move(*x), moves))
        self.abort(messages)
        store.create_dir(base)
        with store.open_output_stream(f"{base}/{_COUNT}{self.job}", compression=None) as out:
            out.write(str(sum(m.files for m in done)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of the job stays but what was moved, files of attempts that failed or were not needed included."""
        store, base = self._store()
        if store.get_file_info(f"{base}/{_PENDING}{self.job}").type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(f"{base}/{_PENDING}{self.job}")


class PagesSink(DataSource):
    """df.write.format("gazette_pages").option("job", id).save(folder); columns path and content."""

    @classmethod
    def name(cls):
        return "gazette_pages"

    def writer(self, schema, overwrite):
        return PagesWriter(self.options)


def in_order(pieces: DataFrame, order: list[str]) -> DataFrame:
    """The pieces of each path in one task, in order, as a stream: no file is ever one row. Large ones are sorted on disk."""
    small_batches(pieces.sparkSession)
    return pieces.repartition("path").sortWithinPartitions("path", *order)


def write_pieces(pieces: DataFrame, folder: str, order: list[str]) -> int:
    """write_pages() of files whose content comes in pieces, rows of path, the columns in order, and content."""
    return write_pages(in_order(pieces, order).select("path", "content"), folder, pieces=True)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, digest, chars = None, hashlib.md5(), 0
    one = lambda: pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()]), pa.array([chars], pa.int64())], ["path", "content_md5", "chars"])
    for b in batches:
        for path, inner, content in zip(b.column("path"), b.column("inner"), b.column("content")):
            if path.as_py() != last:
                if last is not None:
                    yield one()
                last, digest, chars = path.as_py(), hashlib.md5(), 0
            text = content.as_py()
            digest.update(text.encode())
            chars += len(text) if inner.as_py() else 0
    if last is not None:
        yield one()


def digests(pieces: DataFrame, order: list[str]) -> DataFrame:
    """path, content_md5, chars (of the pieces that are inner) of the files that write_pieces() would write."""
    return in_order(pieces, order).select("path", "inner", "content").mapInArrow(_digested, "path string, content_md5 string, chars long")


def write_pages(pages: DataFrame, folder: str, pieces: bool = False) -> int:
    """Writes each row's content to its path below folder (a URI), all or nothing: files are moved into place once every task is done. Returns how many.

    A job that fails leaves none; the driver's own moves are the only ones that a crash can interrupt, each of whole files.
    """
    spark, job = pages.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(PagesSink)
    pages.select("path", "content").write.format("gazette_pages").mode("append").option("job", job).option("pieces", str(pieces).lower()).save(folder)
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base.rstrip('/')}/{_COUNT}{job}", compression=None) as f:
        n = int(f.read())
    store.delete_file(f"{base.rstrip('/')}/{_COUNT}{job}")
    return n


def write_if_any(page: DataFrame, folder: str) -> bool:
    """Last known good: without rows the old file stays."""
    return write_pages(page, folder) > 0


def replace_partitions(df: DataFrame, folder: str, by: list[str]) -> None:
    """Overwrites the partitions that df has rows of, and leaves the others. df must not read from them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def drop_files(df: DataFrame, paths: list[str]) -> None:
    """Deletes folders or files through Hadoop's file systems, once what was made of them is written."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
