"""Documents of the test tables written as files and as archives, to be read back."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import new_path
from .tables import table

#: Every file holds the whole text, as one line. Every 23rd is not named like a document,
#: every 19th ends too early.
NAMED_SQL = r"""
WITH files AS (
  SELECT doc_id, 2000 + doc_id % 20 AS year,
    CAST(2000 + doc_id % 20 AS VARCHAR) || '/' || doc_id || CASE WHEN doc_id % 23 = 0 THEN '-note.txt' ELSE '.json' END AS name,
    '{"id":' || doc_id || ',"lang":"' || lang || '","n":' || n_chars || ',"text":"' || replace(replace(regexp_replace(text, '[\x00-\x1F]', ' ', 'g'), '\', '\\'), '"', '\"') || '"' ||
    CASE WHEN doc_id % 19 = 0 THEN '' ELSE '}' END AS content
  FROM documents
)
SELECT CASE WHEN doc_id % 23 <> 0 THEN doc_id END AS file_id, CAST(CASE WHEN doc_id % 23 <> 0 THEN year END AS INTEGER) AS year, name,
  CASE WHEN doc_id % 23 = 0 THEN 'name' WHEN doc_id % 19 = 0 THEN 'content' END AS reason, md5(content) AS raw_md5
FROM files"""


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.expr("2000 + doc_id % 20").cast("string")
    suffix = F.when(F.col("doc_id") % 23 == 0, "-note.txt").otherwise(".json")
    end = F.when(F.col("doc_id") % 19 == 0, "").otherwise("}")
    line = F.regexp_replace("text", r"[\x00-\x1F]", " ")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"')):
        line = F.replace(line, F.lit(plain), F.lit(escaped))
    parts = [F.lit('{"id":'), "doc_id", F.lit(',"lang":"'), "lang", F.lit('","n":'), "n_chars", F.lit(',"text":"'), line, F.lit('"'), end]
    content = F.concat(*parts)
    return table(spark, sf_dir, "documents").select(F.concat(year, F.lit("/"), "doc_id", suffix).alias("path"), content.alias("content"))


def _store(folder: str):
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder if ":" in folder.split("/")[0] else f"file://{folder}"))


def _files_writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                year = path.split("/")[0]
                if year not in made:
                    store.create_dir(f"{root}/{year}")
                    made.add(year)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return write


def _archive_writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        for batch in batches:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as opened:
                for path, content in zip(batch["path"], batch["content"]):
                    opened.writestr(path, content)
            with store.open_output_stream(f"{root}/{uuid.uuid4().hex}.zip") as out:
                out.write(held.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    return write


def _stored(files: DataFrame, name: str, writer) -> str:
    """Runs the writer in the tasks. A repeated task would write the same files again
    or an archive twice, so this is for tests and checks only."""
    where = new_path(files.sparkSession, name)
    store, root = _store(where)
    store.create_dir(root)
    files.mapInPandas(writer(where), "n bigint").write.format("noop").mode("overwrite").save()
    return where


def store_files(files: DataFrame) -> str:
    return _stored(files, "stored-files", _files_writer)


def store_archives(files: DataFrame) -> str:
    return _stored(files, "stored-archives", _archive_writer)
