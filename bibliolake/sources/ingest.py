"""Archives taken in step by step: a manifest says which members are already there.

A store is a folder with ``documents/batch=<name>/year=<year>`` and
``manifest/batch=<name>``. A batch writes its documents first and its manifest last;
until the manifest is complete nobody sees the documents. So a run that dies leaves
nothing behind that counts, and the next one takes in the same members again. Nothing
is ever rewritten: a changed member comes in with a later batch, which stands for it
from then on. One run at a time may write to a store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import checked_documents, list_members, read_members
from .workspace import by_year, through_table

DOCUMENTS = "file_id bigint, raw_json string, path string, archive string, reason string, batch string, year int"
#: A null checksum says that the member is gone.
MANIFEST = "archive string, path string, place bigint, crc bigint, bytes bigint, batch string"
KEY = ["archive", "path"]


def batches(spark: SparkSession, store: str) -> list[str]:
    """Names of the complete batches, oldest first: one for each run that found
    something. They are folders with a mark of success, so no table is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().getName().removeprefix("batch=") for f in found)


def _read(spark: SparkSession, store: str, kind: str, schema: str) -> DataFrame:
    folders = [f"{store}/{kind}/batch={b}" for b in batches(spark, store)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{store}/{kind}").parquet(*folders)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """The members that the store holds, each as its last batch has it."""
    every = _read(spark, store, "manifest", MANIFEST)
    last = every.groupBy(*KEY).agg(F.max_by(F.struct("place", "crc", "bytes", "batch"), "batch").alias("m"))
    return last.select(*KEY, "m.*").where(F.col("crc").isNotNull())


def ingest(spark: SparkSession, archives: str, store: str, follow_removals: bool = False) -> int:
    """Takes in the members of zip archives that the store does not hold yet, or holds
    with another checksum or length, and returns how many they were.

    The directories of all archives are read, the contents of new and changed members
    only. An archive written anew with the same contents is not read again. A name that
    an archive holds twice stands for its last member. Members that are gone stay in the
    store, unless ``follow_removals`` is set; the archives must then be all that the
    store was made from.
    """
    place = F.max_by(F.struct("place", "size", "method", "locked", "crc", "bytes"), "place")
    listed = list_members(spark, archives).groupBy(*KEY).agg(place.alias("m")).select(*KEY, "m.*")
    held = manifest(spark, store).select(*KEY, F.col("crc").alias("__crc"), F.col("bytes").alias("__bytes"))
    met = listed.join(held, KEY, "full_outer" if follow_removals else "left")
    same = F.col("crc").eqNullSafe(F.col("__crc")) & F.col("bytes").eqNullSafe(F.col("__bytes"))
    fresh = through_table(met.where(~same).drop("__crc", "__bytes"), "fresh")
    found = fresh.agg(F.count("*"), F.count("crc")).first()
    if not found[0]:
        return 0
    known = batches(spark, store)
    number = int(known[-1].split("-")[0]) + 1 if known else 0
    batch = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    if found[1]:
        files = read_members(fresh.where(F.col("crc").isNotNull()))
        by_year(checked_documents(files, keep=["archive"])).write.partitionBy("year").parquet(f"{store}/documents/batch={batch}")
    _commit(fresh.select(*KEY, "place", "crc", "bytes"), f"{store}/manifest/batch={batch}")
    return found[0]


def _commit(members: DataFrame, where: str) -> None:
    """The last step of a batch; its mark of success makes the documents count."""
    members.write.parquet(where)


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """All files that the store holds, ``(file_id, year, raw_json, archive, path, reason,
    batch)``; those with a null ``reason`` are documents, see ``checked_documents``.

    Only complete batches are scanned. The versions that a later batch replaced, or took
    out, are left out by a join with the few members that have more than one; documents are not
    shuffled for it while these are small.
    """
    every = _read(spark, store, "manifest", MANIFEST)
    spans = every.groupBy(*KEY).agg(F.collect_list("batch").alias("all"), F.max("batch").alias("last"))
    old = spans.where(F.size("all") > 1).select(*KEY, F.explode(F.array_remove("all", F.col("last"))).alias("batch"))
    current = _documents(spark, store).join(old, [*KEY, "batch"], "left_anti")
    return current.select("file_id", "year", "raw_json", "archive", "path", "reason", "batch")


def _documents(spark: SparkSession, store: str) -> DataFrame:
    """Files of all complete batches; one that only takes members out has no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    folders = [f"{store}/documents/batch={b}" for b in batches(spark, store)]
    folders = [f for f in folders if path(f).getFileSystem(settings).exists(path(f))]
    if not folders:
        return spark.createDataFrame([], DOCUMENTS)
    return spark.read.schema(DOCUMENTS).option("basePath", f"{store}/documents").parquet(*folders)


def documents(spark: SparkSession, store: str, since: str | None = None) -> DataFrame:
    """``(file_id, year, raw_json)`` of the documents in the store, ready for
    ``build_papers``; with ``since`` only those of later batches than the named one."""
    docs = ingested(spark, store).where(F.col("reason").isNull())
    if since is not None:
        docs = docs.where(F.col("batch") > since)
    return docs.select("file_id", "year", "raw_json")
