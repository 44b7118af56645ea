"""Cases that a table-wide comparison does not reach: redelivery, conflicts inside a batch, long and interleaved plans, digits of other scripts, deep graphs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import entities as E
from tidemark.operators import graph as G
from tidemark.operators import observations as O
from tidemark.operators import tasklog as L
from tidemark.operators import validate as V
from tidemark.sources import writers
from tidemark.streaming import jobs as J

TASK = "plan_id string, task_id string, idempotency_key string, pos long"


def outcomes(spark, table, batch):
    got = L.idempotent_insert(spark.createDataFrame(table, "plan_id string, task_id string, idempotency_key string"), spark.createDataFrame(batch, TASK))
    return [r.outcome for r in got.orderBy("pos").collect()]


def test_conflicts_inside_a_batch(spark):
    batch = [("p", "a", "k1", 1), ("p", "a", "k2", 2), ("p", "a", "k1", 3), ("p", "b", "k2", 4), ("p", "c", "k2", 5), ("p", "x", "k9", 6), ("p", "x", "old", 7)]
    # the refused k2 of row 2 stays free, so row 4 gets it and row 5 meets it
    assert outcomes(spark, [("p", "x", "old")], batch) == ["inserted", "conflict", "already_exists", "inserted", "already_exists", "conflict", "already_exists"]


def test_batch_delivered_twice(spark, tmp_path):
    from tidemark.sources.readers import read_inbox
    for n, body in enumerate(['{"task_id":"t1","objective":"o"}', '{"task_id":"t2","objective":"o"}', '{"task_id":"t2","objective":"o","idempotency_key":"other"}']):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text(body)
    spark.createDataFrame([("p", "seed", "s")], "plan_id string, task_id string, idempotency_key string").write.parquet(f"{tmp_path}/tasks/seed")
    run = J.inbox_batch(f"{tmp_path}/tasks", f"{tmp_path}/out")
    read = lambda p: sorted(map(tuple, spark.read.parquet(p).collect()))
    run(read_inbox(spark, f"{tmp_path}/in"), 0)
    tasks, out = read(f"{tmp_path}/tasks/*"), read(f"{tmp_path}/out")
    run(read_inbox(spark, f"{tmp_path}/in"), 0)
    assert (read(f"{tmp_path}/tasks/*"), read(f"{tmp_path}/out")) == (tasks, out)
    assert len(tasks) == 3 and sum("conflict" in map(str, r) for r in out) == 1


def test_one_document_per_plan(spark):
    t = spark.createDataFrame([("p", s, f"t{s}", "DONE", 1) for s in range(99_998, 100_002)] + [("q", 100_000, "x", "DONE", 1)], "plan_id string, seq long, task_id string, status string, priority int")
    docs = writers.plan_documents(t, spark.createDataFrame([("p",), ("q",), ("r",)], "plan_id string")).collect()
    assert {d.plan_id: d.tasks and len(d.tasks) for d in docs} == {"p": 4, "q": 1, "r": None}


def test_handoff_skips_rules_without_id(spark):
    rows = [("p", "t", i, None if i < 401 else f"r{i}", True, "row_count", None) for i in range(450)] + [("p", "u", 1, None, True, "row_count", None)]
    got = {r.task_id: r.handoff for r in L.rule_handoff(spark.createDataFrame(rows, "plan_id string, task_id string, pos long, rule_id string, ok boolean, type string, detail string")).collect()}
    assert got["t"].startswith("r401:ok; r402:ok") and got["t"].endswith("r449:ok") and got["u"] == ""


@pytest.mark.parametrize("text, kinds", [("卡１２３４５６７８９０１２３４５６７Ｘ", []), ("证１２３４５６７８９０１２３４５６７x。", ["id_card", "bank"]), ("call 13８１２３４５６７８ now", ["phone"]), ("token　=　abc", ["api_key"])])
def test_digits_and_spaces_of_other_scripts(spark, text, kinds):
    row = spark.createDataFrame([(text,)], "t string").select(T.pii_flags(F.col("t")).alias("f"), T.redact(F.col("t")).alias("r")).first()
    assert set(row.f) <= {"id_card", "phone", "bank", "api_key", "email"} and set(kinds) - {"bank"} <= set(row.f)
    assert not kinds or "[REDACTED]" in row.r


def test_first_of_equal_rows(spark):
    new = spark.createDataFrame([("s", "p", "2024-01-01", 1.0, 5, "late"), ("s", "p", "2024-01-01", 1.0, 2, "early")], "shop_name string, shop_platform string, obs_date string, low_price double, pos long, note string")
    assert [r.note for r in O.dedupe_rows(new, new.limit(0)).collect()] == ["early"]


def test_every_request_has_an_outcome(spark):
    ents = spark.createDataFrame([(1, "c", "a", "x", True), (2, "c", "b", "x", True)], "entity_id long, category string, series string, spec string, active boolean")
    ask = [(1, "update", 1, "c", "n", "x", ""), (2, "update", 2, "c", "n", "x", ""), (3, "create", None, "c", "m", "x", ""), (4, "create", None, "c", "m", "x", ""), (5, "retire", 2, "c", "b", "x", "")]
    out = E.apply_entity_changes(ents, spark.createDataFrame(ask, "seq long, action string, entity_id long, category string, series string, spec string, brand string"), ["c"], ["z"])
    assert {r.seq: r.outcome for r in out.collect()} == {1: "updated", 2: "superseded", 3: "superseded", 4: "created", 5: "retired"}
    bound = E.rebind_identities(spark.createDataFrame([("c", "a", "x", 9), ("c", "b", "x", 8)], "category string, series string, spec string, listing long"), ents, out)
    assert {r.listing: (r.series, r.rebound) for r in bound.collect()} == {9: ("n", True), 8: ("b", False)}


def test_walk_keeps_one_root(spark):
    tasks = [("p", "a", "CANCELLED", []), ("p", "b", "CANCELLED", []), ("p", "c", "PENDING", ["a", "b"]), ("p", "d", "RUNNING", ["c"]), ("p", "e", "READY", ["c"]), ("p", "f", "READY", ["d"])]
    t = spark.createDataFrame(tasks, "plan_id string, task_id string, status string, depends_on array<string>")
    assert sorted(map(tuple, G.cancel_closure(t, t.filter("status = 'CANCELLED'")).select("task_id", "cascaded_from").collect())) == [("c", "a"), ("e", "a")]


def test_gate_of_paths_and_inputs(spark):
    paths = spark.createDataFrame([("artifacts/2024-01-01/a b.md",), ("artifacts/2024-01-01/$(x).md",), ("artifacts/2024-01-01/ok-1.md",)], "p string")
    assert [r[0] is None for r in paths.select(V.path_reason(F.col("p"))).collect()] == [False, False, True]
    keys = spark.createDataFrame([('{"b": 1, "a": [2]}',), ('{"a":[2],"b":1}',)], "inputs string").select(F.lit("").alias("inputs_hash"), "inputs", F.lit("p").alias("plan_id"), F.lit("t").alias("task_id"), F.lit("").alias("idempotency_key"))
    assert keys.select(V.default_task_key().alias("k")).distinct().count() == 1


def test_contract_from_a_file(spark, tmp_path):
    import json

    from tidemark import fixed
    from tidemark.sources.contracts import contract, read_contract
    (tmp_path / "c.json").write_text(json.dumps(fixed.HARDWARE_CONTRACT, ensure_ascii=False))
    got = read_contract(spark, str(tmp_path / "c.json"))
    assert {k: got[k] for k in fixed.HARDWARE_CONTRACT} == fixed.HARDWARE_CONTRACT
    with pytest.raises(ValueError, match="identity"):
        contract({"domain": "x"})


def test_a_node_of_a_tree_is_worked_out_once(spark):
    from tidemark.operators import rules as D

    def deep(n):
        return {"type": "object", "required": ["a"], "properties": {"a": deep(n - 1)}} if n else {"type": "integer", "minimum": 3}

    size = lambda n: str(D.tree_problems(F.col("v"), deep(n), F.lit("$"))).count("schema_of_variant")
    assert size(5) == 6
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["n"], "properties": {
        "n": {"type": "number", "minimum": 2}}}, "allOf": [{"contains": {"type": "object", "required": ["n"], "properties": {"n": {"const": 5}}}}]}, "b": {"type": "string", "minLength": 2, "enum": ["xx", "y"]}}}
    bodies = ['{"a":[{"n":5},{"n":1},3,{}],"b":"y"}', '{"a":null,"b":7}', '[]', '{"a":{},"b":"zzz"}', '{', None, '{"a":[{"n":"x"}],"b":null}', 'null', '{"a":[{"n":5},{"n":5.5}],"b":"xx"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", F.try_parse_json("body").alias("v"))
    got = {r.i: r.p for r in df.select("i", D.tree_problems(F.col("v"), schema, F.lit("$")).alias("p")).collect()}
    assert got == {0: ["$.a.1.n: minimum", "$.a.2: type object", "$.a.3.n: required", "$.b: minLength"], 1: ["$.a: type array", "$.b: type string", "$.b: enum"], 2: ["$: type object"],
                   3: ["$.a: type array", "$.b: enum"], 4: [], 5: [], 6: ["$.a: minItems", "$.a: contains", "$.a.0.n: type number", "$.b: type string", "$.b: enum"], 7: ["$: type object"], 8: []}
