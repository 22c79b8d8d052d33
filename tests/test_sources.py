import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from bibliolake.sources import audit, tables
from bibliolake.sources.raw import archive_files, document_files, read_archives, read_documents, read_raw, write_raw
from bibliolake.sources.workspace import shared_folder, through_table


@pytest.fixture()
def files(tmp_path):
    good = {"2018/201800000": '{"a":"ü"}', "2018/201800002.json": '{"b":1,"a":2}', "2019/201900000": '{"a":1,"a":2}'}
    bad = {"2019/201900001": '{"a":', "2019/201900002": '{"a":NaN}'}
    return good, bad, tmp_path


NOT_UTF8 = b'{"a":"\xff\xfe"}'


def check_documents(docs, rejected, good, bad):
    got = {(r.year, r.file_id): r.raw_json for r in docs.collect()}
    assert got == {
        (2018, 201800000): good["2018/201800000"],
        (2018, 201800002): good["2018/201800002.json"],
        (2019, 201900000): good["2019/201900000"],
    }
    texts = {r.file_id: r.raw_json for r in rejected.where("reason = 'content'").select("file_id", F.hex("raw_json").alias("raw_json")).collect()}
    assert {r.file_id for r in rejected.where("reason = 'name'").collect()} <= {None}
    expected = {int(k.split("/")[1]): v.encode().hex().upper() for k, v in bad.items()}
    assert texts == expected | {201900003: NOT_UTF8.hex().upper()}


def test_read_documents(spark, files):
    good, bad, root = files
    for name, text in (good | bad | {"2019/readme.txt": "no document"}).items():
        target = root / name
        target.parent.mkdir(exist_ok=True)
        target.write_text(text, encoding="utf-8")
    (root / "2019/201900003").write_bytes(NOT_UTF8)
    check_documents(*read_documents(spark, str(root)), good, bad)


def test_files_are_listed_and_read_by_the_tasks(spark, tmp_path):
    """The rows of Spark's own reader of whole texts, without a reader for each file."""
    root = tmp_path / "in put%41"
    plain = ["2001/1.json", "2001/a b", "2001/50%25", "2001/x#y?", "2001/é日\u00a0", "2001/+&=;,@$!'()~", "2001/[x]{y}^`|\"<>", "2001/back\\slash", "2001/_a=b", "deep/er/7", "_metadata/3", "top"]
    hidden = ["2001/.hid", "2001/_hid", "2001/_metadata", "2001/c._COPYING_", "_d/1", ".e/1"]
    for name in plain + hidden:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(f'{{"name":\r\n"{len(name)}"}}\n'.encode() + b"\xff")
    (root / "2001/empty").write_bytes(b"")
    found = document_files(spark, str(root))
    assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()
    (root / "2001/2.json.GZ").write_bytes(gzip.compress(b"packed"))
    for chosen, names in ((found, plain), (document_files(spark, str(root)), [*plain, "2001/2.json.GZ"])):
        rows = {(r.path, r.v) for r in chosen.select("path", F.hex("value").alias("v")).collect()}
        assert len(rows) == len(names) == chosen.count()
    by_spark = spark.read.text(str(root), wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.hex("value").alias("v"))
    assert rows == {tuple(r) for r in by_spark.collect()}
    one = document_files(spark, str(root / "2001/1.json")).collect()
    assert len(one) == 1 and one[0].path.endswith("/in%20put%2541/2001/1.json")


def test_read_archives(spark, files):
    good, bad, root = files
    with zipfile.ZipFile(root / "one.zip", "w") as z:
        for name, text in good.items():
            z.writestr(f"data/{name}", text)
    with zipfile.ZipFile(root / "two.zip", "w") as z:
        for name, text in bad.items():
            z.writestr(name, text)
        z.writestr("2019/201900003", NOT_UTF8)
    check_documents(*read_archives(spark, str(root)), good, bad)


def raw(spark, ids):
    rows = [(i, i // 100_000, json.dumps({"n": i})) for i in ids]
    return spark.createDataFrame(rows, "file_id bigint, year int, raw_json string")


def test_raw_table_append(spark, tmp_path):
    where = str(tmp_path / "raw")
    write_raw(raw(spark, [201800000, 201900000]), where)
    write_raw(raw(spark, [201800000]), where, mode="append")
    assert read_raw(spark, where, 2018).count() == 2
    write_raw(raw(spark, [201800000, 201800001]), where, mode="append", skip_present=True)
    assert sorted(r.file_id for r in read_raw(spark, where).collect()) == [
        201800000, 201800000, 201800001, 201900000,
    ]
    write_raw(raw(spark, [201900005]), where)
    assert read_raw(spark, where).count() == 1


def test_append_of_present_documents_reads_ids_only(spark, tmp_path):
    """Documents that are there already are not built again; null ids are kept once, as ever."""
    where = str(tmp_path / "raw")
    write_raw(raw(spark, [201800000, 201900000]), where)
    built = F.udf(lambda i: 1 / 0, "string")("file_id")
    write_raw(raw(spark, [201900000, 201800000]).withColumn("raw_json", built), where, mode="append", skip_present=True)
    assert read_raw(spark, where).count() == 2
    nulls = spark.createDataFrame([(None, 2018, "a"), (None, 2018, "a"), (7, 2018, "b"), (7, 2018, "b")], "file_id bigint, year int, raw_json string")
    write_raw(nulls, where, mode="append", skip_present=True)
    assert sorted(str(r.file_id) for r in read_raw(spark, where).collect()) == ["201800000", "201900000", "7", "None"]


def test_year_filter_prunes_folders(spark, tmp_path):
    where = str(tmp_path / "raw")
    write_raw(raw(spark, [201800000, 201900000]), where)
    plan = read_raw(spark, where, 2018)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_csv_round_trip(spark, make_papers, tmp_path):
    p = make_papers({"citation_title": 'a "q", b\nline', "keywords": ["x", 'y"z'], "year": 2018, "abstracts": "ü"})
    where = str(tmp_path / "csv")
    tables.export_csv(p, where, ["citation_title", "keywords", "year", "creator_degree", "abstracts"])
    back = tables.read_csv(spark, where, "citation_title string, keywords string, year int, abstracts string").first()
    assert back.citation_title == 'a "q", b\nline' and json.loads(back.keywords) == ["x", 'y"z']
    assert back.year == 2018 and back.abstracts == "ü"


def test_preview_order_and_columns(make_papers):
    p = make_papers({"year": None, "file_id": 1}, {"year": 2019, "file_id": 3}, {"year": 2019, "file_id": 2})
    shown = tables.preview(p, ["year", "file_id", "ref_list"], 2)
    assert [tuple(r) for r in shown.collect()] == [(2019, 2), (2019, 3)]


def test_states(spark, make_papers):
    p = make_papers({"year": 2018}, {"year": 2018})
    state = lambda df, n: audit.audit_state(spark, df, n).first()
    assert state(p, 2).state == "processed" and state(p, 2).action == "none"
    assert state(p, 3).state == "processed_incomplete"
    assert state(p.limit(0), 3).state == "processed_empty"
    assert state(raw(spark, [1]), 3).state == "raw" and state(raw(spark, [1]), 3).action == "project"
    missing = state(None, 3)
    assert missing.state == "missing" and missing.n_rows == 0


def test_catalogue_sums_to_the_collection(spark):
    ranges = audit.year_ranges(spark)
    counts = [r.expected for r in audit.expected_rows(ranges).orderBy("year").collect()]
    assert counts == [2762, 3082, 3393, 3815, 4244, 2890] and sum(counts) == 20186


def test_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(audit, "ID_BLOCK", 3)
    ranges = audit.year_ranges(spark, [(2018, 201800000, 201800009), (2019, 201900000, 201900000)])
    loaded = raw(spark, [201800000, 201800001, 201800004, 201800009, 201900000, 201900007])
    gaps = audit.missing_ids(loaded, ranges)
    assert sorted(r.file_id for r in gaps.collect()) == [201800000 + i for i in (2, 3, 5, 6, 7, 8)]
    per_year = {r.year: (r.expected, r.loaded, r.missing) for r in audit.loaded_per_year(loaded, ranges).collect()}
    assert per_year == {2018: (10, 4, 6), 2019: (1, 1, 0)}


def test_missing_profile(make_papers):
    p = make_papers({"year": 2018}, {"year": None}, {"year": None}).select("file_id", "year")
    rows = [tuple(r) for r in audit.missing_profile(p).collect()]
    assert [r[:2] for r in rows] == [("year", 2), ("file_id", 0)] and rows[0][2] == pytest.approx(66.67)


def test_has_fractions(spark):
    df = spark.createDataFrame([(1.0, 1.5), (None, 2.0)], "a double, b double")
    assert not audit.has_fractions(df, "a").first()[0] and audit.has_fractions(df, "b").first()[0]


class FakeSession:
    """Stands for a session with the given setting, master and context folder."""

    def __init__(self, setting, master, context_folder=None):
        self.folder = context_folder
        self.conf = self.sparkContext = self
        self.setting, self.master = setting, master

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_follows_the_setting():
    assert shared_folder(FakeSession("hdfs://shared/x/", "yarn")) == "hdfs://shared/x"
    assert shared_folder(FakeSession(None, "yarn", "s3://bucket/c")) == "s3://bucket/c"
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession(None, "yarn"))
    local = FakeSession(None, "local[2]")
    assert shared_folder(local) == shared_folder(local) == local.folder


def test_through_table(spark):
    back = through_table(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert back.count() == 5 and shared_folder(spark) in back.inputFiles()[0]


def test_describe_and_count(spark, make_papers):
    p = make_papers({"year": 2018})
    shape = tables.describe_shape(p).orderBy("position").collect()
    assert shape[0].column == "file_id" and shape[0].type == "bigint" and shape[0].n_rows == 1
    assert len(shape) == len(p.columns)
    p.createOrReplaceTempView("counted_for_test")
    assert tables.count_tables(spark, ["counted_for_test"]).first().n_rows == 1


def tasks_with_rows(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_one_archive_is_read_by_all_cores(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "all docs.zip", "w", zipfile.ZIP_DEFLATED) as opened:
        for i in range(20_186):
            opened.writestr(f"2018/{i}", f'{{"n":{i}}}', zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
    files = archive_files(spark, str(tmp_path))
    assert tasks_with_rows(files) >= spark.sparkContext.defaultParallelism
    docs, rejected = read_archives(spark, str(tmp_path))
    assert docs.agg(F.count("*"), F.sum(F.get_json_object("raw_json", "$.n").cast("bigint"))).first()[:] == (20_186, 20_186 * 20_185 // 2)
    assert rejected.count() == 0


def test_ids_of_the_catalogue_are_listed_by_all_cores(spark):
    ranges = audit.year_ranges(spark, [(y, y * 10_000_000, y * 10_000_000 + 9_999_999) for y in range(4)])
    ids = audit.expected_ids(ranges)
    per_task = [r["count"] for r in ids.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 40_000_000 and len(per_task) >= spark.sparkContext.defaultParallelism
    assert max(per_task) < 0.2 * sum(per_task)
