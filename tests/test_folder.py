"""The folder listing in tasks (R01), empty input (R05) and the bucketed response store."""

import os

import pytest
from pyspark.sql import functions as F

from docket.config import Config
from docket.operators.infer import RESPONSE_DDL, StubClient
from docket.operators.requests import requests_table
from docket.plans import casework
from docket.plans.casework import answer, compact_store, run_folder
from docket.sources.docx import docx_bytes, quarantine, read_docx_folder, readable
from docket.sources.folder import list_folder, read_docx_files

NAMES = ["plain.docx", "_x.docx", ".x.docx", "~$x.docx", "two words.docx", "ü%20#.docx"]


@pytest.fixture()
def corpus(tmp_dir):
    for name in NAMES:
        with open(os.path.join(tmp_dir, name), "wb") as fh:
            fh.write(docx_bytes(f"text of {name}"))
    for name, data in {"bad.docx": b"no archive", "zero.docx": b"", "B.DOCX": docx_bytes("upper"), "x.txt": b"t",
                       "x.docx.bak": b"b", "docx": b"d"}.items():
        with open(os.path.join(tmp_dir, name), "wb") as fh:
            fh.write(data)
    os.makedirs(os.path.join(tmp_dir, "dir.docx"))
    os.symlink(os.path.join(tmp_dir, "gone"), os.path.join(tmp_dir, "link.docx"))
    os.makedirs(os.path.join(tmp_dir, "nested"))
    with open(os.path.join(tmp_dir, "nested", "n.docx"), "wb") as fh:
        fh.write(docx_bytes("nested"))
    return tmp_dir


def test_every_entry_with_the_suffix_is_tried(spark, corpus):
    ex = read_docx_files(spark, corpus)
    assert {r.filename: r.text for r in readable(ex).collect()} == {n: f"text of {n}" for n in NAMES}
    errors = {r.filename: r.error for r in quarantine(ex).collect()}
    assert set(errors) == {"bad.docx", "zero.docx", "dir.docx", "link.docx"} and errors["dir.docx"].startswith("IsADirectory")


def test_listing_says_what_an_entry_is(spark, corpus):
    got = {r.filename: (r.is_folder, r.length) for r in list_folder(spark, corpus).collect()}
    assert got["dir.docx"] == (True, None) and got["zero.docx"] == (False, 0) and got["link.docx"] == (False, None)
    assert {r.filename for r in list_folder(spark, corpus, "").collect()} >= {"nested", "x.txt", "docx"}


def test_a_folder_is_a_partition(spark, corpus):
    listed = list_folder(spark, [corpus, f"file:{corpus}/nested"])
    assert listed.rdd.getNumPartitions() == 2 and listed.where("filename = 'n.docx'").count() == 1
    assert list_folder(spark, corpus + "/dir.docx").collect() == []
    with pytest.raises(Exception, match="nowhere"):
        list_folder(spark, corpus + "/nowhere").collect()


def test_small_batches_lose_nothing(spark, corpus):
    list_folder(spark, corpus)  # registers the format
    small = spark.read.format("folder").option("batchRows", "2").option("path", corpus).load()
    assert sorted(r.filename for r in small.collect()) == sorted(os.listdir(corpus))


def test_run_folder_takes_either_listing(spark, corpus, tmp_dir):
    import tempfile

    out = tempfile.mkdtemp(prefix="docket-test-")
    assert run_folder(spark, corpus, out + "/a").n_quarantined == 4
    assert run_folder(spark, corpus, out + "/a").n_documents == len(NAMES)
    assert run_folder(spark, corpus, out + "/b", reader=read_docx_folder).n_documents < len(NAMES)
    empty = run_folder(spark, corpus + "/dir.docx", out + "/c")
    assert (empty.n_documents, empty.n_quarantined, empty.summary, empty.reports_path) == (0, 0, None, None)
    assert not os.path.exists(out + "/c/reports") and not os.path.exists(out + "/c/summary")


# -- response store ---------------------------------------------------------------------

CFG = Config(max_retries=0, inference_partitions=4)


def asked(spark, lo, hi):
    docs = spark.range(lo, hi).select(F.format_string("%05d.docx", "id").alias("filename"), F.format_string("text %d", "id").alias("text"))
    return requests_table(docs, CFG)


def test_a_small_run_reads_its_own_buckets(spark, tmp_dir, monkeypatch):
    store = f"{tmp_dir}/store"
    assert answer(asked(spark, 0, 2000), StubClient, CFG, store).count() == 2000
    files = len(casework._read_store(spark, store).inputFiles())
    read, plain = [], casework._read_store

    def watched(*args):
        found = plain(*args)
        read.append(set() if found is None else set(found.inputFiles()))
        return found

    monkeypatch.setattr(casework, "_read_store", watched)
    rows = answer(asked(spark, 0, 3), StubClient, CFG, store).collect()  # all answered before
    assert len(rows) == 3 and all(r.response for r in rows)
    assert len(read) == 1 and files > 200 and len(read[0]) <= 3 * CFG.inference_partitions
    whole = spark.read.schema(RESPONSE_DDL).parquet(store)
    assert whole.count() == 2000  # nothing was asked again


def test_store_without_buckets_and_other_digits(spark, tmp_dir):
    store = f"{tmp_dir}/store"
    first = asked(spark, 0, 30)
    answer(first, StubClient, CFG, f"{tmp_dir}/seed").collect()
    casework._read_store(spark, f"{tmp_dir}/seed").write.parquet(store)  # files without buckets
    calls = answer(asked(spark, 0, 40), StubClient, CFG, store)
    assert calls.count() == 40 and casework._read_store(spark, store).count() == 40
    three = Config(max_retries=0, inference_partitions=4, store_digits=3)  # the store keeps its two digits
    assert answer(asked(spark, 0, 50), StubClient, three, store).count() == 50
    assert {len(f) for f in os.listdir(store) if f.startswith("bucket=")} == {len("bucket=00")}
    one = compact_store(spark, store, f"{tmp_dir}/compact", digits=1)
    assert one.count() == 50 and len([f for f in os.listdir(f"{tmp_dir}/compact") if f.startswith("bucket=")]) <= 16
    again = answer(asked(spark, 0, 50), StubClient, CFG, f"{tmp_dir}/compact")
    assert again.count() == 50 and not os.path.exists(f"{tmp_dir}/compact_waves")


def test_files_of_a_mount_are_listed_and_dealt_out_in_tasks(spark, tmp_path):
    from docket.sources.docx import docx_bytes

    names = ["a.docx", "_b.docx", ".c.docx", "~$d.docx", "_e=f.docx", "g h%20.docx", "i.DOCX", "j.txt"]
    for n in names:
        (tmp_path / n).write_bytes(docx_bytes(n))
    (tmp_path / "k.docx").write_bytes(b"")
    (tmp_path / "l.docx").mkdir()
    files = read_docx_folder(spark, str(tmp_path))
    assert "binaryFile" not in files._jdf.queryExecution().toString()  # whose listing the driver holds
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.filename: r.text for r in files.collect()} == {n: n for n in ("a.docx", "~$d.docx", "_e=f.docx", "g h%20.docx")}
