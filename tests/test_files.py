"""Files listed and read in tasks: what Spark's reader finds, and no file's name on the driver."""

import os

import pytest

from docloom import store
from docloom.plans.queries import QUERIES
from docloom.sources import docx, files, packages, sinks
from docloom.sources.picture_files import PictureWriter

NAMES = ("x.docx", "~$x.docx", ".h.docx", "_u.docx", "sub/y.docx", "sub/deep/z z.docx", "_hid/v.docx", "x.txt", "e.docx/in.docx", "100%20 µ.docx")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    at = tmp_path_factory.mktemp("a b%20c")
    for p in NAMES:
        (at / p).parent.mkdir(parents=True, exist_ok=True)
        (at / p).write_bytes(p.encode() * 3)
    (at / "none").mkdir()
    os.symlink(at / "sub/y.docx", at / "link.docx")
    os.symlink(at / "gone", at / "broken.docx")
    return str(at)


def rows(df):
    return sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("below", ["", "/", "/*", "/*.docx", "/{sub/deep,sub}/*", "/?ub/[a-y]*", "/sub/y.docx", "/none", "/_hid", "/x.txt"])
@pytest.mark.parametrize("recursive", [False, True])
def test_files_are_those_of_sparks_reader(spark, tree, below, recursive):
    for pattern in ("*.docx", "*.{docx,txt}"):
        want = rows(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(tree + below))
        assert rows(files.contents(files.listed(spark, tree + below, pattern, recursive))) == sorted(set(want))  # alternatives that overlap give a file twice there


def test_no_path_is_sparks_error(spark, tree):
    for below in ("/absent", "/abs*"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            files.listed(spark, tree + below)


def test_folders_named_key_value_are_entered(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"k={k}").mkdir()
        (tmp_path / f"k={k}" / f"{k}.docx").write_bytes(b"x" * k)
    assert rows(files.contents(files.listed(spark, str(tmp_path)))) == rows(spark.read.format("binaryFile").load(str(tmp_path)))


def test_scanned_files_are_not_on_the_driver(spark, tree, monkeypatch):
    scanned = docx.scan(spark, tree)
    assert not any(f.endswith(".docx") for f in scanned.inputFiles())  # the reader on the driver held them all
    assert {r.file_name for r in scanned.collect()} == {"x.docx", "link.docx", "100%20 µ.docx"}
    monkeypatch.setattr(files, "TASK_FILES", 1)
    monkeypatch.setattr(files, "TASK_FOLDERS", 1)
    found = files.listed(spark, f"{tree}/*", recursive=True)
    assert files.contents(found).rdd.getNumPartitions() == found.count() == 9
    monkeypatch.setattr(files, "TASK_FILES", 100)
    assert files.contents(found).rdd.getNumPartitions() == 4  # shuffle partitions
    monkeypatch.setattr(files, "TASK_BYTES", 1)
    assert files.contents(found).rdd.getNumPartitions() == 9


def test_many_files_of_one_folder_and_empty_ones(spark, tmp_path):
    n = files.BATCH_FILES + files.BATCH_NAMES + 1
    for k in range(n):
        (tmp_path / f"{k}.docx").write_bytes(b"%d" % k * (k % 3))
    got = rows(files.contents(files.listed(spark, str(tmp_path))))
    assert [(p.rpartition("/")[2], size, c) for p, _, size, c in got] == sorted((f"{k}.docx", len(str(k)) * (k % 3), b"%d" % k * (k % 3)) for k in range(n))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "empty.docx").touch()
    with pytest.raises(ValueError, match="every file failed"):  # it was not even seen
        scanned = docx.scan(spark, str(tmp_path / "one"))
        docx.require_any(docx.file_status(docx.decode(scanned), scanned))


def test_image_files_are_not_on_the_driver(spark, monkeypatch):
    made, new_path = [], store.new_path
    monkeypatch.setattr(store, "new_path", lambda s, name: made.append((name, new_path(s, name))) or made[-1][1])
    monkeypatch.setattr(sinks, "FOLDER_FILES", 10)
    found = QUERIES["image_files"](spark, "/root/testdata/sf0.001")
    assert not any(f.endswith(".png") for f in found.inputFiles())
    n, at = found.where("there").count(), dict(made)["pictures"].removeprefix("file:")
    assert n == found.count() == sum(len(names) for _, _, names in os.walk(at)) and n // 10 > 4
    # what one task writes and lists stays the same however many images there are
    assert n // 20 < len(os.listdir(at)) <= n // 10


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path):
    w = PictureWriter(str(tmp_path / "out"))

    def rows():
        yield "a/b", "1.png", b"x"
        w.abort([None])
        yield "c", "2.png", b"y"

    with pytest.raises(FileNotFoundError):
        w.write(rows())
    with pytest.raises(FileNotFoundError):
        w.write(iter([("a", "3.png", b"z")]))
    assert not list(tmp_path.iterdir())


def test_packages_are_made_where_their_folder_is_written(spark, monkeypatch):
    plans, of_documents = [], packages.of_documents
    monkeypatch.setattr(packages, "of_documents", lambda df: plans.append(df._jdf.queryExecution().simpleString()) or of_documents(df))
    made, new_path = [], store.new_path
    monkeypatch.setattr(store, "new_path", lambda s, name: made.append((name, new_path(s, name))) or made[-1][1])
    QUERIES["scanned_files"](spark, "/root/testdata/sf0.001")
    assert "in/f" in plans[0] and "p_partkey#" not in plans[0].split("hashpartitioning(")[1].split("REPARTITION_BY_NUM")[0]  # dealt by folder, not by key and then again
    at = dict(made)["package-files"].removeprefix("file:") + "/in"
    folders = {f: set(os.listdir(f"{at}/{f}")) for f in os.listdir(at)}
    assert sum(map(len, folders.values())) == 3 * 200 and all(len({n.strip("~$").split(".")[0] for n in names}) * 3 == len(names) for names in folders.values())
