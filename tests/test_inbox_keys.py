"""The inbox opens only the buckets of its own keys; folding and redelivery change nothing."""

import json

from pyspark.sql import functions as F

from tidemark.sources.readers import read_inbox
from tidemark.streaming import jobs as J


def deliver(spark, folder, names, run, batch_id):
    (folder / f"in{batch_id}").mkdir(exist_ok=True)
    for n in names:
        (folder / f"in{batch_id}" / f"{n}.json").write_text(json.dumps({"task_id": n, "objective": "o"}))
    run(read_inbox(spark, f"{folder}/in{batch_id}"), batch_id)


def test_buckets_of_a_batch(spark, tmp_path):
    spark.createDataFrame([("p", f"old{i}", f"k{i}") for i in range(300)], "plan_id string, task_id string, idempotency_key string").write.parquet(f"{tmp_path}/tasks/seed")
    run = J.inbox_batch(f"{tmp_path}/tasks", f"{tmp_path}/out", 32, 2)
    for i, names in enumerate([["a", "b"], ["b", "c"], ["a", "c", "d"], ["e"]]):
        deliver(spark, tmp_path, names, run, i)
    read = lambda: sorted((r.task_id, r.outcome, r.batch) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [("a", "already_exists", 2), ("a", "inserted", 0), ("b", "already_exists", 1), ("b", "inserted", 0), ("c", "already_exists", 2), ("c", "inserted", 1), ("d", "inserted", 2), ("e", "inserted", 3)]
    assert read() == want
    for i, names in ((3, ["e"]), (1, ["b", "c"])):
        deliver(spark, tmp_path, names, run, i)
    assert [r for r in read() if r[2] in (1, 3)] == [r for r in want if r[2] in (1, 3)]
    keys = J.TaskKeys(spark, f"{tmp_path}/tasks", 32, 2)
    known = keys.known(spark.createDataFrame([("p", "old7", "k7")], "plan_id string, task_id string, idempotency_key string"), 99)
    scanned = {r[0] for r in known.select("_metadata.file_path").distinct().collect()}
    every = {r[0] for r in keys.read().select("_metadata.file_path").distinct().collect()}
    assert 0 < len(scanned) <= 4 and len(every) >= 25 and known.filter("task_id = 'old7'").count() >= 1
    assert "bucket" in known._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
