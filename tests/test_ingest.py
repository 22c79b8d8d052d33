import zipfile

import pytest

from bibliolake.operators.projection import build_papers
from bibliolake.sources import ingest
from bibliolake.sources.raw import read_archives

FIRST = {"2018/201800000": '{"a":1}', "2018/201800001": '{"a":2}', "2019/201900000.json": '{"a":"ü"}'}
SECOND = {"2019/201900001": '{"broken":', "2020/202000000": "{}", "readme.txt": "a note"}


@pytest.fixture()
def archives(tmp_path):
    folder = tmp_path / "archives"
    folder.mkdir()

    def write(name, members, how=zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(folder / name, "w", how) as z:
            for path, text in members.items():
                z.writestr(path, text)

    write.folder, write.store = str(folder), str(tmp_path / "store")
    return write


def content(spark, store):
    return sorted((r.path, r.raw_json, r.reason) for r in ingest.ingested(spark, store).collect())


def reasons(members):
    kind = {"2019/201900001": "content", "readme.txt": "name"}
    return sorted((path, text, kind.get(path)) for path, text in members.items())


def test_in_two_runs_as_in_one(spark, archives):
    archives("a.zip", FIRST)
    assert ingest.ingest(spark, archives.folder, archives.store) == 3
    archives("b.zip", SECOND)
    assert ingest.ingest(spark, archives.folder, archives.store) == 3
    assert content(spark, archives.store) == reasons(FIRST | SECOND)
    docs = sorted(map(tuple, ingest.documents(spark, archives.store).collect()))
    assert docs == sorted(map(tuple, read_archives(spark, archives.folder)[0].collect()))
    first, second = ingest.batches(spark, archives.store)
    assert [r.file_id for r in ingest.documents(spark, archives.store, since=first).collect()] == [202000000]
    assert ingest.documents(spark, archives.store, since=second).count() == 0
    assert build_papers(ingest.documents(spark, archives.store)).count() == 4


def test_nothing_new_reads_directories_only(spark, archives, monkeypatch):
    archives("a.zip", FIRST)
    ingest.ingest(spark, archives.folder, archives.store)
    # Written anew with other offsets, the same contents.
    archives("a.zip", dict(reversed(FIRST.items())), zipfile.ZIP_STORED)
    monkeypatch.setattr(ingest, "read_members", None)
    assert ingest.ingest(spark, archives.folder, archives.store) == 0
    assert len(ingest.batches(spark, archives.store)) == 1


def test_a_killed_run_leaves_nothing(spark, archives, monkeypatch):
    archives("a.zip", FIRST)
    ingest.ingest(spark, archives.folder, archives.store)
    archives("b.zip", SECOND)

    def killed(members, where):
        raise ConnectionError

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "_commit", killed)
        with pytest.raises(ConnectionError):
            ingest.ingest(spark, archives.folder, archives.store)
    assert content(spark, archives.store) == reasons(FIRST)
    assert ingest.ingest(spark, archives.folder, archives.store) == 3
    assert content(spark, archives.store) == reasons(FIRST | SECOND)


def test_changed_and_removed_members(spark, archives):
    archives("a.zip", FIRST)
    archives("b.zip", SECOND)
    ingest.ingest(spark, archives.folder, archives.store)
    changed = FIRST | {"2018/201800001": '{"a":3}'}
    archives("a.zip", changed)
    mended = {"2019/201900001": '{"broken":false}'}
    archives("b.zip", mended)
    assert ingest.ingest(spark, archives.folder, archives.store) == 2
    kept = {p: t for p, t in SECOND.items() if p not in mended}
    both = sorted([*reasons(changed | kept), ("2019/201900001", '{"broken":false}', None)])
    assert content(spark, archives.store) == both
    # Two members of b.zip are gone; they go on demand.
    assert ingest.ingest(spark, archives.folder, archives.store, follow_removals=True) == 2
    left = [r for r in both if r[0] not in kept]
    assert content(spark, archives.store) == left
    assert ingest.ingest(spark, archives.folder, archives.store, follow_removals=True) == 0
    # They come back as they were.
    archives("b.zip", mended | kept)
    assert ingest.ingest(spark, archives.folder, archives.store) == 2
    assert content(spark, archives.store) == both


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_a_name_held_twice_and_an_empty_archive(spark, archives):
    with zipfile.ZipFile(f"{archives.folder}/a.zip", "w") as z:
        z.writestr("2018/201800000", "{}")
        z.writestr("2018/201800000", '{"a":2}')
    archives("b.zip", {})
    assert ingest.ingest(spark, archives.folder, archives.store) == 1
    assert content(spark, archives.store) == [("2018/201800000", '{"a":2}', None)]
    assert ingest.ingest(spark, archives.folder, archives.store) == 0


def test_an_empty_store(spark, archives):
    archives("a.zip", {})
    assert ingest.batches(spark, archives.store) == [] and ingest.ingested(spark, archives.store).count() == 0
    assert ingest.ingest(spark, archives.folder, archives.store) == 0
    assert ingest.manifest(spark, archives.store).count() == 0
