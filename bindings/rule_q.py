"""Acceptance rules over documents, orders, events and the evidence bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, table
from bindings.evidence_q import BAD, GRADED, claim_sources, claims, graded
from tidemark.operators import rules as D, validate as V

R = Registry()
QUERIES, SQL = R.queries, R.sql
COLS = ["rule_id", "type", "ok", "detail"]


@R.add("rule_row_count", r"""SELECT doc_id, 'row_count' AS rule_id, 'row_count' AS type, n >= 3 AS ok, 'rows=' || n || ' need>=3' AS detail
  FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n FROM documents)""")
def rule_row_count(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    return D.row_count(c, 3, ["doc_id"])


PATH = ("CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'artifacts/2024-01-01/../x' WHEN 3 THEN 'tmp/x' "
        "ELSE 'artifacts/2024-01-01/' || p_partkey || '.md' END")


@R.add("rule_file_exists", f"""WITH p AS (SELECT p_partkey, {PATH} AS path FROM part)
  SELECT p_partkey, 'file_exists' AS rule_id, 'file_exists' AS type, p_partkey % 6 > 3 AND p_partkey % 12 > 3 AND p_partkey % 5 <> 0 AS ok,
    CASE p_partkey % 6 WHEN 0 THEN 'security:empty_path' WHEN 1 THEN 'security:absolute_path_not_allowed:' || path WHEN 2 THEN 'security:path_traversal:' || path
    WHEN 3 THEN 'security:path_outside_daily_dir:' || path ELSE CASE WHEN p_partkey % 5 <> 0 THEN 'ok' ELSE 'missing:' || path END END AS detail FROM p""")
def rule_file_exists(spark, d):
    p = table(spark, d, "part")
    declared = p.select("p_partkey", F.expr(PATH).alias("path"))
    listing = p.filter("p_partkey % 5 <> 0").select(F.concat(F.lit("artifacts/2024-01-01/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return D.file_exists(declared, listing, ["p_partkey"])


CHECKS = [{"path": "$.id", "required": True, "type": "integer"}, {"path": "$.prio", "enum": ["1-URGENT", "2-HIGH", "5-LOW"]},
          {"path": "$.price", "type": "number", "minimum": 1000, "maximum": 400000}, {"path": "$.day", "pattern": r"^199\d-"},
          {"path": "$.tags", "minItems": 2, "containsConst": "F"}]


@R.add("rule_json_schema", """WITH v AS (SELECT o_orderkey, o_orderkey % 50 = 0 AS broken, concat_ws('; ',
    CASE WHEN o_orderkey % 7 = 0 THEN 'id: required' END, CASE WHEN o_orderkey % 7 = 1 THEN 'id: type integer' END,
    CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'prio: enum' END,
    CASE WHEN o_totalprice < 1000 THEN 'price: minimum' END, CASE WHEN o_totalprice > 400000 THEN 'price: maximum' END,
    CASE WHEN o_orderdate >= DATE '2000-01-01' THEN 'day: pattern' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'tags: minItems' END, CASE WHEN o_orderstatus <> 'F' THEN 'tags: contains' END) AS msg FROM orders)
  SELECT o_orderkey, 'json_schema' AS rule_id, 'json_schema' AS type, NOT broken AND msg = '' AS ok,
    CASE WHEN broken THEN 'not_json' ELSE array_to_string(string_split(msg, '; ')[1:5], '; ') END AS detail FROM v""")
def rule_json_schema(spark, d):
    k = F.col("o_orderkey")
    ident = F.when(k % 7 == 0, "").when(k % 7 == 1, '"id":"x",').otherwise(F.concat(F.lit('"id":'), k.cast("string"), F.lit(",")))
    tags = F.concat(F.lit('["'), "o_orderstatus", F.lit('"'), F.when(k % 3 == 0, "").otherwise(',"z"'), F.lit("]"))
    body = F.concat(F.lit("{"), ident, F.lit('"prio":"'), "o_orderpriority", F.lit('","price":'), F.col("o_totalprice").cast("decimal(20,2)").cast("string"),
                    F.lit(',"day":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","tags":'), tags,
                    F.when(k % 50 == 0, "").otherwise("}"))
    return D.json_schema(table(spark, d, "orders").select("o_orderkey", body.alias("body")), CHECKS, ["o_orderkey"])


TREE = {"type": "object", "required": ["as_of", "orders", "note"], "properties": {
    "as_of": {"type": "string", "minLength": 4},
    "orders": {"type": "array", "minItems": 3, "maxItems": 12, "allOf": [{"contains": {"type": "object", "required": ["name"], "properties": {"name": {"const": "O"}}}}],
               "items": {"type": "object", "required": ["name", "lines"], "properties": {
                   "name": {"type": "string", "enum": ["O", "F"]},
                   "lines": {"type": "array", "maxItems": 5, "items": {"type": "object", "required": ["rank", "price"], "properties": {
                       "rank": {"type": "integer", "minimum": 1, "maximum": 4}, "price": {"type": "number", "minimum": 2000}}}}}}}}}


@R.add("rule_json_tree", """WITH l AS (SELECT o_custkey, o_orderkey, any_value(o_orderstatus) AS st, count(*) AS n, count(*) FILTER (l_linenumber > 4) AS far, count(*) FILTER (l_partkey % 10 > 0 AND l_extendedprice < 2000) AS cheap,
      count(*) FILTER (l_partkey % 10 = 0) AS bare FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  c AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (st NOT IN ('O', 'F')) + count(*) FILTER (n > 5) + sum(far) + sum(cheap) + sum(bare) AS inside, count(*) FILTER (st = 'O') AS named FROM l GROUP BY 1)
  SELECT o_custkey AS c_custkey, CAST(inside + CASE WHEN orders < 3 THEN 1 ELSE 0 END + CASE WHEN orders > 12 THEN 1 ELSE 0 END + CASE WHEN named = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_problems FROM c""")
def rule_json_tree(spark, d):
    """Customers' orders with their lines, two arrays deep."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.struct(F.col("l_linenumber").alias("rank"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_extendedprice").cast("double")).alias("price"))
    per = li.groupBy("o_custkey", "o_orderkey", "o_orderstatus").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    doc = per.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("name"), "lines")).alias("orders"))
    k = F.col("o_custkey")
    body = F.to_json(F.struct(F.when(k % 3 == 0, "x").otherwise("2024").alias("as_of"), "orders", F.when(k % 5 != 0, 1).alias("note")))
    docs = doc.select(k.alias("c_custkey"), F.try_parse_json(body).alias("v"))
    return docs.select("c_custkey", F.size(D.tree_problems(F.col("v"), TREE, F.lit("$"))).cast("long").alias("n_problems"))


BUSINESS = [{"field": "rows", "op": ">=", "value": 5}, {"json": "k", "op": ">", "value": 20, "default": 0}, {"json": "mode", "op": "==", "value": "x", "default": "x"},
            {"any": [{"field": "kind", "op": "in", "value": ["view", "click"]}, {"not": {"has": "k"}}, {"json": "k", "op": "<=", "value": {"field": "rows"}, "default": 0}]},
            {"field": "kind", "op": "not in", "value": ["signup"]}, {"field": "kind", "op": "lacks", "value": "err"}, {"any": [{"json": "k", "op": "contains", "value": "5"}, {"field": "rows", "op": "<", "value": 40}]}]


@R.add("rule_business", """WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events)
  SELECT event_id, 'business_rule' AS rule_id, 'business_rule' AS type, value >= 5 AND coalesce(k, 0) > 20 AND (event_type IN ('view', 'click') OR k IS NULL OR coalesce(k, 0) <= value) AND event_type <> 'signup'
    AND NOT contains(event_type, 'err') AND (contains(coalesce(CAST(k AS VARCHAR), ''), '5') OR value < 40) AS ok,
    'rows >= 5 and k > 20 and mode == x and (kind in [''view'', ''click''] or not has k or k <= rows) and kind not in [''signup''] and kind lacks err and (k contains 5 or rows < 40)' AS detail FROM e""")
def rule_business(spark, d):
    s = table(spark, d, "events").select("event_id", F.col("value").alias("rows"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 9 == 0, "{oops").otherwise(F.col("props")).alias("body"))
    return D.business_rule(s, BUSINESS, ["event_id"])


@R.add("rule_data_period", """WITH per AS (SELECT c_custkey, unnest(['1-URGENT', '5-LOW']) AS market, strftime(d, '%Y-%m-%d') AS day FROM customer JOIN (SELECT o_custkey,
      min(o_orderdate) FILTER (o_orderpriority = '1-URGENT') d FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE d IS NOT NULL),
  tr AS (SELECT DISTINCT o_custkey, o_orderpriority AS market, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
  j AS (SELECT p.c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM tr WHERE o_custkey = p.c_custkey AND tr.market = p.market) THEN p.market || ':no_rows'
      WHEN NOT EXISTS (SELECT 1 FROM tr WHERE o_custkey = p.c_custkey AND tr.market = p.market AND tr.day = p.day) THEN p.market || ':' || p.day END AS w FROM per p)
  SELECT c_custkey, 'data_period_match' AS rule_id, 'data_period_match' AS type, count(w) = 0 AS ok,
    CASE WHEN count(w) = 0 THEN 'ok' ELSE 'mismatch:' || string_agg(w, '; ' ORDER BY w) END AS detail FROM j GROUP BY 1""")
def rule_data_period(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("market"),
                                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    first = o.filter("market = '1-URGENT'").groupBy("c_custkey").agg(F.min("day").alias("dd"))
    per = first.select("c_custkey", F.create_map(F.lit("1-URGENT"), "dd", F.lit("5-LOW"), F.concat(F.lit(" "), "dd")).alias("period"))
    return D.data_period_match(per, o, ["c_custkey"])


FENCE = ("CASE doc_id % 5 WHEN 0 THEN '\n```mermaid\nxychart-beta\n  y-axis \"p\" 1 --> 2\n  bar [1, 2]\n```\n' "
         "WHEN 1 THEN '\n```Mermaid\n xychart\n y-axis 1 2\n```\n```mermaid\npie\n \"a\": 1\n```' WHEN 2 THEN '\n```mermaid\nxychart\nbar [1, 2\n```\n' "
         "WHEN 3 THEN '\n```mermaid\nmindmap\n x\n```' ELSE '' END")


@R.add("rule_mermaid", r"""WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS good, CASE doc_id % 5 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS blocks,
    CASE doc_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS bad FROM documents)
  SELECT doc_id, 'mermaid' AS rule_id, 'mermaid' AS type, good >= 1 AS ok, 'mermaid_charts=' || good || ' blocks=' || blocks || ' need>=1' ||
    CASE WHEN bad > 0 THEN ' bad=' || bad ELSE '' END AS detail FROM n""")
def rule_mermaid(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat("text", F.expr(FENCE.replace("\n", "\\n"))).alias("text"))
    return D.mermaid(t, 1, ["doc_id"])


@R.add("rule_freshness", """WITH a AS (SELECT o_custkey % 20 AS task_id, count(*) FILTER (o_orderkey % 13 <> 0) AS dated, count(*) FILTER (o_orderkey % 13 <> 0 AND o_orderdate < DATE '1998-01-01' - 730) AS stale,
    count(*) FILTER (o_orderkey % 13 = 0) AS no_date FROM orders GROUP BY 1)
  SELECT task_id, 'freshness' AS rule_id, 'freshness' AS type, stale / dated <= 0.3 AS ok, 'stale=' || stale || '/' || dated || ' no_date=' || no_date AS detail FROM a""")
def rule_freshness(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("task_id"), F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published_at"))
    return D.freshness(o, F.lit("1998-01-01 00:00:00"), ["task_id"], mode="recent")


@R.add("rule_source_quality", f"""WITH {GRADED}, a AS (SELECT task_id, count(*) FILTER (tier_reason = 'r' AND (source_tier = 'A' OR coalesce(tier, '') = 'A')) AS a,
    count(*) FILTER (tier_reason = 'r') AS c, count(*) AS n FROM g GROUP BY 1)
  SELECT task_id, 'source_quality' AS rule_id, 'source_quality' AS type, c > 0 AND a / nullif(c, 0) >= 0.75 AS ok,
    CASE WHEN c = 0 THEN 'no_tier_reason_entries' ELSE 'A=' || a || '/' || c || ' excluded_no_reason=' || (n - c) END AS detail FROM a""")
def rule_source_quality(spark, d):
    return D.source_quality(graded(spark, d), ["task_id"], bar=0.75)


@R.add("rule_source_traceable", f"""WITH {BAD}, c AS (SELECT task_id, count(*) n, count(*) FILTER (bad) b FROM bad WHERE task_id > 3 GROUP BY 1),
  s AS (SELECT c_custkey % 50 AS task_id, count(*) ns, count(*) FILTER (c_custkey % 400 = 7) bu FROM customer WHERE c_custkey % 50 <> 9 GROUP BY 1)
  SELECT t.task_id, 'source_traceable' AS rule_id, 'source_traceable' AS type, coalesce(n, 0) > 0 AND coalesce(ns, 0) > 0 AND b = 0 AND bu = 0 AS ok,
    CASE WHEN n IS NULL THEN 'no_claims_json' WHEN ns IS NULL THEN 'sources_json_invalid' WHEN b > 0 OR bu > 0 THEN 'hallucination:' || b || ';bad_url:' || bu
    ELSE 'claims=' || n || ' sources=' || ns END AS detail
  FROM (SELECT DISTINCT o_custkey % 50 AS task_id FROM orders) t LEFT JOIN c USING (task_id) LEFT JOIN s USING (task_id)""")
def rule_source_traceable(spark, d):
    c = claims(spark, d)
    tasks = c.select("task_id").distinct().withColumn("issue", F.lit("sources_json_invalid"))
    return D.source_traceable(c.filter("task_id > 3"), claim_sources(spark, d).filter("task_id <> 9"), tasks, ["task_id"])


@R.add("rule_coverage", r"""WITH q AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{3,}') AS w, trim(substring(text, 50, 30)) AS q1 FROM documents),
  q2 AS (SELECT *, 'xylophone ' || w || CASE WHEN doc_id % 2 = 0 THEN ' zebrafish' ELSE '' END AS q3 FROM q),
  m AS (SELECT *, list_filter([CASE WHEN length(text) > 0 AND doc_id % 3 > 0 AND NOT contains(text, 'qqqq') THEN 'qqqq' END,
    CASE WHEN NOT contains(text, q3) AND CASE WHEN w = '' THEN true ELSE doc_id % 2 = 0 END THEN q3 END], lambda x: x IS NOT NULL) AS missing FROM q2)
  SELECT doc_id, 'coverage' AS rule_id, 'coverage' AS type, text <> '' AND len(missing) = 0 AS ok,
    CASE WHEN text = '' THEN 'no_report_md' ELSE 'unanswered=' || array_to_string(missing, '|') END AS detail FROM m""")
def rule_coverage(spark, d):
    w = F.regexp_extract("text", "([A-Za-z]{3,})", 1)
    k = F.col("doc_id")
    q3 = F.concat(F.lit("xylophone "), w, F.when(k % 2 == 0, " zebrafish").otherwise(""))
    r = table(spark, d, "documents").select(
        "doc_id", F.array(F.substring("text", 50, 30), F.lit("qqqq"), F.lit(" "), q3).alias("key_questions"),
        F.when(F.col("text") != "", F.concat("text", F.when(k % 3 == 0, "\n## about qqqq\n").otherwise(""))).otherwise("").alias("report"))
    return D.coverage(r, ["doc_id"])


TYPE = "CASE doc_id % 6 WHEN 0 THEN 'coverage' WHEN 1 THEN 'row_count' WHEN 2 THEN 'json_schema' WHEN 3 THEN 'file_exists' WHEN 4 THEN 'freshness' ELSE 'magic' END"
RAN = f"""ran AS (SELECT source, 'rule_' || doc_id AS rule_id, {TYPE} AS type, doc_id, CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN doc_id % 6 = 5 THEN 'fail'
    WHEN doc_id % 7 = 0 THEN 'deferred' WHEN n_chars > 500 THEN 'ok' ELSE 'fail' END AS status, CASE WHEN doc_id % 10 = 0 THEN 'already_verified'
    WHEN doc_id % 6 = 5 THEN 'unknown_rule_type:magic' WHEN doc_id % 7 = 0 THEN 'not_evaluated' ELSE 'n=' || n_chars END AS detail FROM documents)"""


def ran(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    rid = F.concat(F.lit("rule_"), F.col("doc_id").cast("string")).alias("rule_id")
    rules = t.select("source", F.col("doc_id").alias("pos"), F.lit("").alias("rule_id"), F.expr(TYPE).alias("type"))
    results = t.filter("doc_id % 7 <> 0 AND doc_id % 6 <> 5").select("source", rid, (F.col("n_chars") > 500).alias("ok"), F.concat(F.lit("n="), F.col("n_chars").cast("string")).alias("detail"))
    return D.run_rules(rules, results, t.filter("doc_id % 10 = 0").select("source", rid), ["source"])


@R.add("run_rules", f"""WITH {RAN} SELECT source, rule_id, type, status, detail, CASE type WHEN 'json_schema' THEN 1 WHEN 'freshness' THEN 3 WHEN 'coverage' THEN 5 ELSE 0 END AS place FROM ran""")
def run_rules(spark, d):
    return ran(spark, d).select("source", "rule_id", "type", "status", "detail", F.col("run_order.place").cast("int").alias("place"))


@R.add("rule_outcome", f"""WITH {RAN} SELECT source, CASE WHEN count(*) FILTER (status IN ('fail', 'deferred')) > 0 THEN 'RETRY' ELSE 'DONE' END AS next_state,
    CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'verify_failed' WHEN count(*) FILTER (status = 'deferred') > 0 THEN 'verify_budget' ELSE 'ok' END AS reason,
    count(*) FILTER (status = 'fail') AS n_failed, count(*) FILTER (status = 'deferred') AS n_deferred FROM ran GROUP BY source""")
def rule_outcome(spark, d):
    return D.rule_outcome(ran(spark, d), ["source"])


INBOX = """WITH t AS (SELECT p_partkey, p_partkey % 15 AS m, 'task_' || p_partkey AS tid FROM part)
  SELECT p_partkey, CASE m WHEN 0 THEN 'file_too_large:200000>102400' WHEN 1 THEN 'bad_task_id:Task-' || p_partkey WHEN 2 THEN 'absolute_path_not_allowed:/x' WHEN 3 THEN 'path_traversal:artifacts/2024-01-01/../y'
    WHEN 4 THEN CASE WHEN p_partkey % 2 = 1 THEN 'path_outside_daily_dir:artifacts/2024-01-01/a b.md' ELSE 'path_outside_daily_dir:x/y' END WHEN 5 THEN 'shell_metachar_in_cmd:pytest tests/a; rm' WHEN 6 THEN 'cmd_option_injection' WHEN 7 THEN 'cmd_not_whitelisted:ls x'
    WHEN 8 THEN CASE WHEN p_partkey % 2 = 1 THEN 'bad_expr_node:r1' ELSE 'business_rule_without_expr' END WHEN 9 THEN 'needs_web_requires_freshness' WHEN 10 THEN 'schema_invalid:priority' WHEN 11 THEN 'schema_invalid:privacy' WHEN 12 THEN 'schema_invalid:objective' END AS reason,
    CASE WHEN m = 13 THEN 'given' WHEN m = 14 THEN 'pipeline/' || tid || '/' || sha256('in' || p_partkey) WHEN m = 1 THEN 'pipeline/Task-' || p_partkey ELSE 'pipeline/' || tid END AS idempotency_key FROM t"""


@R.add("validate_tasks", INBOX)
def validate_tasks(spark, d):
    k, m = F.col("p_partkey"), F.col("p_partkey") % 15
    s = F.lit(None).cast("string")

    def rule(path=s, cmd=s, kind=F.lit("file_exists")):
        return F.array(F.struct(s.alias("rule_id"), kind.alias("type"), path.alias("path"), cmd.alias("cmd"), s.alias("schema_ref"), s.alias("expr")))

    def expr(e):
        return F.array(F.struct(F.lit("r1").alias("rule_id"), F.lit("business_rule").alias("type"), s.alias("path"), s.alias("cmd"), s.alias("schema_ref"), F.lit(e).alias("expr")))

    odd = k % 2 == 1
    acc = (F.when((m == 4) & odd, rule(F.lit("artifacts/2024-01-01/a b.md"))).when((m == 8) & odd, expr("open('x') > 1")).when((m == 14) & odd, expr("a > 1 and (b in ['p(q).r'])")).when(m == 2, rule(F.lit("/x"))).when(m == 3, rule(F.lit("artifacts/2024-01-01/../y"))).when(m == 4, rule(F.lit("x/y")))
           .when(m == 5, rule(cmd=F.lit("pytest tests/a; rm"))).when(m == 6, rule(cmd=F.lit(" -c x"))).when(m == 7, rule(cmd=F.lit("ls x")))
           .when(m == 8, rule(kind=F.lit("business_rule"))).otherwise(rule(F.lit("artifacts/2024-01-01/a.md"), F.lit("pytest tests/a"))))
    t = table(spark, d, "part").select(
        "p_partkey", F.when(m == 1, F.concat(F.lit("Task-"), k.cast("string"))).otherwise(F.concat(F.lit("task_"), k.cast("string"))).alias("task_id"),
        s.alias("plan_id"), F.when(m == 12, "").otherwise("do").alias("objective"), F.when(m == 13, "given").alias("idempotency_key"), s.alias("inputs_hash"),
        F.when(m == 14, F.concat(F.lit("in"), k.cast("string"))).alias("inputs"), F.when(m == 10, 11).otherwise(3).alias("priority"), F.lit("daily").alias("source"),
        F.when(m == 11, "open").otherwise("public").alias("privacy"), s.alias("complexity"), (m == 9).alias("needs_web"), s.alias("freshness"),
        acc.alias("acceptance"), F.when(m == 0, 200000).otherwise(500).alias("bytes"))
    return V.validate_tasks(t).select("p_partkey", "reason", "idempotency_key")


@R.add("validate_split", """WITH t AS (SELECT o_custkey AS plan_id, o_orderkey AS pos, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'k' || (o_orderkey % 6) END AS tid, o_orderkey % 7 = 0 AS no_obj,
    o_orderkey % 11 = 0 AS no_rat, o_orderkey % 13 = 0 AS web, o_orderkey % 17 = 0 AS selfdep FROM orders),
  u AS (SELECT *, row_number() OVER (PARTITION BY plan_id, tid ORDER BY pos) > 1 AS dup FROM t),
  p AS (SELECT plan_id, pos, unnest([CASE WHEN tid = '' THEN 'task' || pos || '_no_id' WHEN dup THEN 'duplicate_task_id:' || tid END, CASE WHEN no_obj THEN tid || '_no_objective' END,
    CASE WHEN no_rat THEN tid || '_no_slice_rationale' END, CASE WHEN web THEN tid || '_needs_web_without_freshness' END, CASE WHEN selfdep THEN tid || '_self_dependency' END]) AS w,
    unnest([1, 2, 3, 4, 5]) AS i FROM u),
  a AS (SELECT plan_id, list(w ORDER BY pos, i) AS l FROM p WHERE w IS NOT NULL GROUP BY 1), n AS (SELECT plan_id, count(*) n FROM t GROUP BY 1)
  SELECT c_custkey AS plan_id, CASE WHEN n.n IS NULL THEN 'split_no_tasks' ELSE nullif(array_to_string(list_concat(list_filter([CASE WHEN n.n > 12 THEN 'too_many_tasks:' || n.n END,
    CASE WHEN c_custkey % 4 = 0 THEN 'no_key_questions' END], lambda x: x IS NOT NULL), coalesce(l, []))[1:8], ';'), '') END AS problems
  FROM customer LEFT JOIN n ON n.plan_id = c_custkey LEFT JOIN a ON a.plan_id = c_custkey""")
def validate_split(spark, d):
    k = F.col("o_orderkey")
    tid = F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("k"), (k % 6).cast("string")))
    t = table(spark, d, "orders").select(
        F.col("o_custkey").alias("plan_id"), k.alias("pos"), tid.alias("task_id"), F.when(k % 7 != 0, "o").alias("objective"),
        F.when(k % 11 == 0, "").otherwise("r").alias("slice_rationale"), (k % 13 == 0).alias("needs_web"), F.lit("none").alias("freshness"),
        F.when(k % 17 == 0, F.array(tid)).alias("depends_on"))
    plans = table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"),
                                               F.when(F.col("c_custkey") % 4 != 0, F.array(F.lit("q"))).alias("key_questions"))
    return V.validate_split(t, plans, max_tasks=12)


SUITE = [{"type": "row_count", "min": 3}, {"type": "mermaid", "min": 1, "rule_id": "charts"}, {"type": "coverage"}, {"type": "business_rule", "rule_id": "size", "terms": [{"field": "n_chars", "op": ">", "value": 500}]},
         {"type": "python_test"}, {"type": "magic", "rule_id": "m"}, {"type": "json_schema", "rule_id": "shape", "schema": {"type": "object", "required": ["lang"], "properties": {"lang": {"enum": ["en", "fr"]}}}}]


@R.add("run_suite", f"""WITH r AS (SELECT doc_id, 'rule_0' AS rule_id, 'row_count' AS type, ok, detail FROM ({SQL['rule_row_count']}) UNION ALL SELECT doc_id, 'charts', 'mermaid', ok, detail FROM ({SQL['rule_mermaid']})
    UNION ALL SELECT doc_id, 'rule_2', 'coverage', ok, detail FROM ({SQL['rule_coverage']}) UNION ALL SELECT doc_id, 'size', 'business_rule', n_chars > 500, 'n_chars > 500' FROM documents
    UNION ALL SELECT doc_id, 'shape', 'json_schema', lang IN ('en', 'fr'), CASE WHEN lang IN ('en', 'fr') THEN '' ELSE '$.lang: enum' END FROM documents)
  SELECT doc_id, rule_id, type, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS status, detail FROM r
  UNION ALL SELECT doc_id, 'rule_4', 'python_test', 'deferred', 'not_evaluated' FROM documents UNION ALL SELECT doc_id, 'm', 'magic', 'fail', 'unknown_rule_type:magic' FROM documents""")
def run_suite(spark, d):
    """Real results: the suite's handlers run over the documents."""
    t = table(spark, d, "documents")
    w, k = F.regexp_extract("text", "([A-Za-z]{3,})", 1), F.col("doc_id")
    q3 = F.concat(F.lit("xylophone "), w, F.when(k % 2 == 0, " zebrafish").otherwise(""))
    inputs = {"counts": t.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines")), "texts": t.select("doc_id", F.concat("text", F.expr(FENCE.replace("\n", "\\n"))).alias("text")),
              "stats": t.select("doc_id", "n_chars", F.lit("{}").alias("body")), "bodies": t.select("doc_id", F.to_json(F.struct("lang")).alias("body")),
              "reports": t.select("doc_id", F.array(F.substring("text", 50, 30), F.lit("qqqq"), F.lit(" "), q3).alias("key_questions"),
                                  F.when(F.col("text") != "", F.concat("text", F.when(k % 3 == 0, "\n## about qqqq\n").otherwise(""))).otherwise("").alias("report"))}
    return D.run_suite(t.select("doc_id"), SUITE, inputs, ["doc_id"]).select("doc_id", "rule_id", "type", "status", "detail")
