"""Publication documents as files, and the raw table."""

from __future__ import annotations

import re
import string
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import allow_repeated_keys
from .workspace import by_year, through_table

# Fixed value: a document is stored as <year>/<file id>, with or without suffix.
MEMBER_PATTERN = r"(?:^|/)(\d{4})/(\d+)(?:\.[^/]*)?$"
NAMES_PER_BATCH = 10_000
#: Documents, or bytes of them, that a task hands over at a time.
DOCS_PER_BATCH, BYTES_PER_BATCH = 1_000, 8 << 20
#: Compressed bytes of members that one task reads, if there are enough of them.
BYTES_PER_TASK = 64 << 20
#: Endings, in any case, of files that Spark unpacks while it reads them.
COMPRESSED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")
#: What may stand in the path of a URI besides characters beyond ASCII.
PLAIN = frozenset(string.ascii_letters + string.digits + "_-!.~'()*/:@&=+$,;")
# Fixed values of the archive format.
LOCAL_HEADER, STORED, DEFLATED = 30, 0, 8


def checked_documents(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Files ``(path, value)`` with ``file_id``, ``year``, ``raw_json`` and ``reason``:
    null for a document, ``name`` for a file that is not named like one, ``content`` for
    one that does not parse. Further columns named in ``keep`` stay."""
    allow_repeated_keys(files.sparkSession)
    named = files.select(
        F.regexp_extract("path", MEMBER_PATTERN, 2).try_cast("bigint").alias("file_id"),
        F.regexp_extract("path", MEMBER_PATTERN, 1).try_cast("int").alias("year"),
        F.col("value").alias("raw_json"),
        "path",
        *keep,
    )
    valid = F.is_valid_utf8("raw_json") & F.try_parse_json("raw_json").isNotNull()
    return named.withColumn("reason", F.when(F.col("file_id").isNull(), "name").when(~F.coalesce(valid, F.lit(False)), "content"))


def split_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files as documents, and all others with their path and the reason. Both come
    from one reading of the files if these are a table; see ``checked_documents``."""
    checked = checked_documents(files)
    docs = checked.filter(F.col("reason").isNull()).select("file_id", "year", "raw_json")
    rejected = checked.filter(F.col("reason").isNotNull()).select("file_id", "year", "path", "raw_json", "reason")
    return docs, rejected


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, value)`` of the files below a folder, the text as it is, so that key
    order and non-ASCII characters survive.

    A folder that all machines reach as a local one is listed and read by the tasks, once,
    into a table, which spares the cost of a reader of Spark for each file. Other stores,
    single files, patterns and compressed files go through that reader; the driver lists them.
    """
    root = _local_folder(spark, folder)
    if root is None:
        return _by_spark(spark, folder)
    listed = list_files(spark, root)
    packed = reduce(Column.__or__, [F.lower("place").endswith(suffix) for suffix in COMPRESSED])
    n, size, others = listed.agg(F.count("*"), F.sum("size"), F.count_if(packed)).first()
    tasks = max(spark.sparkContext.defaultParallelism, (size or 0) // BYTES_PER_TASK, n // NAMES_PER_BATCH)
    contents = listed.filter(~packed).repartition(tasks).mapInPandas(_read_files, "path string, content binary")
    # Documents and rejected files then come from one reading of the files.
    files = through_table(contents.select("path", F.col("content").cast("string").alias("value")), "contents")
    if not others:
        return files
    endings = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in COMPRESSED]
    return files.unionByName(_by_spark(spark, folder, "*{" + ",".join(endings) + "}"))


def _by_spark(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    # As an argument: the method overrides an option of the reader.
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def _local_folder(spark: SparkSession, folder: str) -> str | None:
    """Path of an existing folder of the local kind without its scheme, else None."""
    if re.search(r"[{}\[\]*?\\]", folder):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = store.makeQualified(path).toUri()
    if whole.getScheme() != "file" or not store.exists(path) or not store.getFileStatus(path).isDirectory():
        return None
    return whole.getPath()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(place, size)`` of the files below a local folder that Spark would read: not empty,
    not hidden, not in a hidden folder. Folders of one level are listed by the tasks."""
    folders = spark.createDataFrame([(folder,)], "place string")
    levels = []
    while not levels or not folders.isEmpty():
        dealt = folders.repartition(spark.sparkContext.defaultParallelism) if levels else folders
        level = through_table(dealt.mapInPandas(_list_folders, "place string, size bigint, folder boolean"), "files")
        levels.append(level.filter("not folder").select("place", "size"))
        folders = level.filter("folder").select("place")
    return reduce(DataFrame.unionByName, levels)


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["place"]:
            found = []
            for entry in fs.LocalFileSystem().get_file_info(fs.FileSelector(folder)):
                is_folder, name = entry.type == fs.FileType.Directory, entry.base_name
                hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
                if is_folder and name.startswith(("_metadata", "_common_metadata")):
                    hidden = False
                if not hidden and (is_folder or entry.type == fs.FileType.File and entry.size):
                    found.append((entry.path, entry.size or 0, is_folder))
            for start in range(0, len(found), NAMES_PER_BATCH):
                yield pd.DataFrame(found[start : start + NAMES_PER_BATCH], columns=["place", "size", "folder"])


def _as_uri(place: str) -> str:
    """A local path as Spark names it: only what cannot stand in a URI is escaped."""
    plain = lambda c: c in PLAIN or c > "\x7f" and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")
    return "file:" + "".join(c if plain(c) else quote(c, safe="") for c in place)


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    paths, contents, held = [], [], 0
    for batch in batches:
        for place in batch["place"]:
            with _open(place) as stream:
                contents.append(stream.read())
            paths.append(_as_uri(place))
            held += len(contents[-1])
            if len(paths) >= DOCS_PER_BATCH or held >= BYTES_PER_BATCH:
                yield pd.DataFrame({"path": paths, "content": contents})
                paths, contents, held = [], [], 0
    if paths:
        yield pd.DataFrame({"path": paths, "content": contents})


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents below a folder as ``(documents, rejected)``."""
    return split_documents(document_files(spark, folder))


def _open(path: str):
    """A file that can be read from any place, in whatever store the path names. Spark
    gives the path without escapes."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", path))
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@?&=%"))
    return store.open_input_file(inside)


class _Directory:
    """A stream as the reader of directories wants it: a place before the beginning is an
    ``OSError``, as in archives too short to hold a member."""

    def __init__(self, stream):
        self._stream = stream
        self.read, self.tell, self.seekable = stream.read, stream.tell, stream.seekable

    def seek(self, place: int, whence: int = 0) -> int:
        if whence == 2 and -place > self._stream.size():
            raise OSError("a place before the beginning")
        return self._stream.seek(place, whence)


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive in batch["archive"]:
            with _open(archive) as stream, zipfile.ZipFile(_Directory(stream)) as opened:
                infos = [i for i in opened.infolist() if not i.is_dir()]
            for start in range(0, len(infos), NAMES_PER_BATCH):
                chosen = infos[start : start + NAMES_PER_BATCH]
                rows = [
                    (archive, i.filename, i.header_offset, i.compress_size, i.compress_type, i.flag_bits & 1, i.CRC, i.file_size) for i in chosen
                ]
                yield pd.DataFrame(rows, columns=["archive", "path", "place", "size", "method", "locked", "crc", "bytes"])


def _member(stream, place: int, size: int, method: int, locked: int) -> bytes:
    """Content of a member from where the directory says it begins."""
    stream.seek(place)
    header = stream.read(LOCAL_HEADER)
    names = int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")
    stream.seek(place + LOCAL_HEADER + names)
    data = stream.read(size)
    if locked or method not in (STORED, DEFLATED):
        raise ValueError("only stored and deflated members without a password can be read")
    return zlib.decompress(data, -zlib.MAX_WBITS) if method == DEFLATED else data


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, members in batch.sort_values(["archive", "place"]).groupby("archive"):
            with _open(archive) as stream:
                names, contents, held = [], [], 0
                for row in members.itertuples():
                    contents.append(_member(stream, row.place, row.size, row.method, row.locked))
                    names.append(row.path)
                    held += len(contents[-1])
                    if len(names) >= DOCS_PER_BATCH or held >= BYTES_PER_BATCH:
                        yield pd.DataFrame({"archive": archive, "path": names, "content": contents})
                        names, contents, held = [], [], 0
                if names:
                    yield pd.DataFrame({"archive": archive, "path": names, "content": contents})


#: Where a member lies in its archive, and the checksum and length of its content.
MEMBERS = "archive string, path string, place bigint, size bigint, method int, locked int, crc bigint, bytes bigint"


def list_members(spark: SparkSession, archives: str) -> DataFrame:
    """Members of zip archives, from the directory of each archive alone."""
    found = spark.read.format("binaryFile").load(archives).select(F.col("path").alias("archive"))
    return found.mapInPandas(_list_members, MEMBERS)


def read_members(members: DataFrame) -> DataFrame:
    """``(archive, path, value)`` of a stored table of members.

    Members, not archives, are dealt to a number of tasks that follows from their
    bytes and the cores, so one huge archive is read by all of them and no task reads a
    directory again.
    """
    total = members.agg(F.sum("size")).first()[0] or 0
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, total // BYTES_PER_TASK)
    # With a number given, adaptive execution does not merge these few bytes again.
    contents = members.repartition(tasks).mapInPandas(_read_members, "archive string, path string, content binary")
    return contents.select("archive", "path", F.col("content").cast("string").alias("value"))


def archive_files(spark: SparkSession, archives: str) -> DataFrame:
    """``(path, value)`` of the members of zip archives. The first pass writes down where
    every member lies, the second reads them."""
    return read_members(through_table(list_members(spark, archives), "members")).select("path", "value")


def read_archives(spark: SparkSession, archives: str) -> tuple[DataFrame, DataFrame]:
    """Documents inside zip archives as ``(documents, rejected)``."""
    return split_documents(archive_files(spark, archives))


def write_raw(docs: DataFrame, where: str, mode: str = "overwrite", skip_present: bool = False) -> None:
    """Write or append the raw table, one folder per year. Appending the same
    documents twice doubles them unless ``skip_present`` is set."""
    if skip_present and mode == "append":
        present = docs.sparkSession.read.parquet(where).select("file_id").distinct()
        # Ids are compared without their documents; few new ones are then broadcast.
        absent = through_table(docs.select("file_id").distinct().join(present, "file_id", "left_anti"), "absent")
        if absent.isEmpty():
            return
        chosen = absent.withColumnRenamed("file_id", "id")
        docs = docs.join(chosen, F.col("file_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["file_id"])
    by_year(docs).write.mode(mode).partitionBy("year").parquet(where)


def read_raw(spark: SparkSession, where: str, year: int | None = None) -> DataFrame:
    raw = spark.read.parquet(where).select("file_id", "year", "raw_json")
    return raw if year is None else raw.filter(F.col("year") == year)
