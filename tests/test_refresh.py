import json
import os

import pytest

from bibliolake.operators.projection import ROOT
from bibliolake.operators.refresh import collection_state, refresh
from bibliolake.sources.raw import read_documents, write_raw
from bibliolake.sources.workspace import dropped_tables, through_table


def document(title):
    return json.dumps({ROOT: {"item": {"bibrecord": {"head": {"citation-title": title}}}}})


def test_refresh_follows_the_state(spark, tmp_path):
    archive, raw, papers = (str(tmp_path / x) for x in ("archive", "raw", "papers"))
    folder = tmp_path / "archive" / "2018"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"20180000{i}").write_text(document(f"t{i}"))

    def state(expected=3):
        row = collection_state(spark, raw, papers, expected).first()
        return row.state, row.n_rows

    assert state() == ("missing", 0)
    write_raw(read_documents(spark, archive)[0], raw)
    assert state() == ("raw", 3)
    assert refresh(spark, archive, raw, papers, 3).first().state == "raw"
    assert state() == ("processed", 3)
    titles = [r.citation_title for r in spark.read.parquet(papers).orderBy("file_id").collect()]
    assert titles == ["t0", "t1", "t2"]

    (folder / "201800003").write_text(document("t3"))
    assert refresh(spark, archive, raw, papers, 3).first().action == "none"
    assert state() == ("processed", 3)
    assert refresh(spark, archive, raw, papers, 4).first().state == "processed_incomplete"
    assert state(4) == ("processed", 4)


def test_refresh_from_nothing(spark, tmp_path):
    archive, raw, papers = (str(tmp_path / x) for x in ("archive", "raw", "papers"))
    folder = tmp_path / "archive" / "2019"
    folder.mkdir(parents=True)
    (folder / "201900000").write_text(document("a"))
    (folder / "201900001").write_text("{broken")
    (folder / "readme.txt").write_text("a note")
    assert refresh(spark, archive, raw, papers, 1).first().state == "missing"
    assert spark.read.parquet(papers).count() == 1
    others = {(r.path.rsplit("/", 1)[-1], r.file_id, r.reason, r.raw_json) for r in spark.read.parquet(raw + "_rejected").collect()}
    assert others == {("201900001", 201900001, "content", "{broken"), ("readme.txt", None, "name", "a note")}


def test_tables_on_the_way_are_dropped(spark, tmp_path):
    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    kept = through_table(spark.range(5), "kept")
    with dropped_tables(spark):
        gone = [folder(through_table(spark.range(5), "gone"))]
        with dropped_tables(spark):
            inner = through_table(kept.selectExpr("id + 1 AS id"), "inner")
            gone.append(folder(inner))
            inner.write.parquet(str(tmp_path / "result"))
        assert os.path.isdir(gone[0]) and not os.path.isdir(gone[1])
    with pytest.raises(ZeroDivisionError), dropped_tables(spark):
        gone.append(folder(through_table(spark.range(5), "failed")))
        raise ZeroDivisionError
    assert not any(map(os.path.isdir, gone)) and kept.count() == 5
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5
