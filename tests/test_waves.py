"""The work queue in waves (R09) and the times of batches."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from docket.config import Config
from docket.operators.infer import StubClient
from docket.operators.metrics import batch_intervals
from docket.operators.requests import requests_table
from docket.plans.casework import answer

CFG = Config(max_retries=0, requests_per_task=5, tasks_per_wave=8, inference_partitions=4)


def counting(folder):
    """Clients that leave a file per call; while the file ``kill`` is there, none starts after 60 calls."""

    class Counting:  # local, so that it travels to the workers by value
        def __init__(self):
            if os.path.exists(f"{folder}/kill") and len(glob.glob(f"{folder}/call-*")) >= 60:
                raise RuntimeError("killed")

        def complete(self, request):
            open(f"{folder}/call-{request['filename']}-{uuid.uuid4().hex}", "w").close()
            return StubClient().complete(request)

    return Counting


def test_a_killed_run_repeats_at_most_its_wave(spark, tmp_dir):
    docs = spark.range(200).select(F.format_string("%05d.docx", "id").alias("filename"), F.format_string("text %d", "id").alias("text"))
    reqs, store = requests_table(docs, CFG), f"{tmp_dir}/store"
    open(f"{tmp_dir}/kill", "w").close()
    with pytest.raises(Exception, match="killed"):
        answer(reqs, counting(tmp_dir), CFG, store)
    first = glob.glob(f"{tmp_dir}/call-*")
    done = spark.read.parquet(store).count()
    waves = spark.read.parquet(store + "_waves")
    assert waves.agg(F.sum("n_answers")).first()[0] == done and 0 < done < 200  # records of finished waves alone
    os.rename(f"{tmp_dir}/kill", f"{tmp_dir}/killed")
    rows = answer(reqs, counting(tmp_dir), CFG, store).collect()
    calls = glob.glob(f"{tmp_dir}/call-*")
    assert len(rows) == 200 and all(r.error is None and r.response for r in rows)
    assert len(calls) - 200 == len(first) - done  # only what the killed wave had asked is asked again
    waves = spark.read.parquet(store + "_waves")
    assert waves.agg(F.sum("n_answers")).first()[0] == 200 and waves.agg(F.max("n_answers")).first()[0] <= 2 * 40


def test_no_wave_without_requests(spark, tmp_dir):
    docs = spark.createDataFrame([], "filename string, text string")
    assert answer(requests_table(docs, CFG), StubClient, CFG, f"{tmp_dir}/store").collect() == []
    assert not os.path.exists(f"{tmp_dir}/store_waves")


def test_a_store_without_start_stamps_is_read(spark, tmp_dir):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "filename string, text string")
    reqs, store = requests_table(docs, CFG), f"{tmp_dir}/store"
    answer(reqs.where("filename = 'a'"), StubClient, CFG, store).collect()
    spark.read.parquet(store).drop("began_s").write.parquet(f"{tmp_dir}/old")
    rows = {r.filename: r for r in answer(reqs, StubClient, CFG, f"{tmp_dir}/old").collect()}
    assert rows["a"].began_s is None and rows["b"].began_s > 0 and rows["a"].response


def test_intervals(spark):
    rows = [(1, 0.0, 2.0), (1, 1.0, 2.0), (1, 5.0, 1.0), (2, 3.0, 0.0), (3, None, None), (4, 0.0, 9.0), (4, 1.0, 1.0), (4, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "batch_no long, began_s double, latency_s double")
    got = {r.batch_no: tuple(r)[1:] for r in batch_intervals(df).collect()}
    assert got[1] == (3, 2.0, 6.0, 2.0, 1.25) and got[2] == (1, 0.0, 0.0, 0.0, None)
    assert got[3] == (1, None, None, None, None) and got[4] == (3, 9.0, 9.0, 0.0, 11 / 9)
    assert batch_intervals(df.limit(0)).collect() == []
