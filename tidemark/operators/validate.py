"""Row validation: one reason column holding the first failing check, null for good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.text import normalize_name

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NOT_FINITE = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def _quoted(arr: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']"))


def _bad_price(col: Column) -> Column:
    value = F.when(F.rlike(col, F.lit(_NUMBER)), F.trim(col).try_cast("double"))
    return (F.when(F.rlike(col, F.lit(_NOT_FINITE)), "bad_price:out_of_domain")
            .when(value.isNull(), "bad_price:not_a_number").when(value <= 0, "bad_price:out_of_domain"))


def _value_map(contract: dict) -> Column | None:
    """Literal map `key=value` -> canonical value for declared aliases that are not values themselves."""
    pairs = []
    for key, aliases in contract["value_maps"].items():
        allowed = contract["attrs"][key]["values"]
        pairs += [(f"{key}={a}", v) for a, v in aliases.items() if a not in allowed and v in allowed]
    return F.create_map(*[F.lit(x) for p in pairs for x in p]) if pairs else None


def canonical_attrs(attrs: Column, contract: dict) -> Column:
    table = _value_map(contract)
    if table is None:
        return attrs
    return F.transform_values(attrs, lambda k, v: F.coalesce(F.try_element_at(table, F.concat_ws("=", k, v)), v))


def observation_reason(contract: dict, collected_on: Column) -> Column:
    ident, attrs = F.col("identity_hint"), F.coalesce(F.col("attrs_hint"), F.create_map().cast("map<string,string>"))
    missing = F.filter(F.array(*[F.lit(k) for k in contract["identity"]]), lambda k: ~F.map_contains_key(ident, k))
    unknown = F.array_sort(F.array_except(F.map_keys(attrs), F.array(*[F.lit(k) for k in contract["attrs"]])))
    checks = [
        F.when(ident.isNull() | (F.size(ident) == 0), "no_identity_hint"),
        F.when(F.size(missing) > 0, F.concat(F.lit("identity_keys_missing:"), _quoted(missing))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown_attr_key:"), _quoted(unknown))),
    ]
    for key, spec in contract["attrs"].items():
        if spec["required"]:
            blank = F.coalesce(F.try_element_at(attrs, F.lit(key)), F.lit("")) == ""
            checks.append(F.when(blank, f"missing_required_attr:{key}"))
    canon = canonical_attrs(attrs, contract)
    for key, spec in contract["attrs"].items():
        if spec["required"] and spec["values"]:
            value = F.try_element_at(canon, F.lit(key))
            checks.append(F.when(~value.isin(*spec["values"]),
                                 F.concat(F.lit(f"attr_value_not_allowed:{key}="), value)))
    date = F.trim(F.coalesce(F.col("price_date"), F.lit("")))
    shop = F.col("shop")
    metric = F.coalesce(F.when(F.col("metric") != "", F.col("metric")), F.lit("price"))
    checks += [
        _bad_price(F.coalesce(F.col("low_price"), F.lit("None"))),
        F.when(F.col("raw_price").isNotNull(), _bad_price(F.col("raw_price"))),
        F.when(~F.rlike(date, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(F.lit("bad_date:'"), date, F.lit("'"))),
        F.when(date > collected_on, F.concat(F.lit("date_after_collection:"), date, F.lit(">"), collected_on)),
        F.when((F.coalesce(shop["platform"], F.lit("")) == "") | (F.coalesce(shop["name"], F.lit("")) == ""),
               "missing_shop_fields"),
        F.when(~metric.isin(*contract["metrics"]), F.concat(F.lit("unknown_metric:"), metric)),
    ]
    return F.coalesce(*checks)


def tag_observations(raw: DataFrame, contract: dict, collected_on: str = "collected_on") -> DataFrame:
    """Adds `reason`; write the result partitioned by it, or filter it twice, to part good from bad."""
    return raw.withColumn("reason", observation_reason(contract, F.col(collected_on)))


def shape_observations(tagged: DataFrame, contract: dict, normalize: bool = True) -> DataFrame:
    """Good rows of `tag_observations` in table form, with the filter attributes as own columns.

    With normalize=False the identity stays raw; `resolve_entities` normalises each distinct one itself.
    """
    name = normalize_name if normalize else (lambda c: c)
    attrs = canonical_attrs(F.col("attrs_hint"), contract)
    promoted = ("source", "condition", "vendor", "channel", "anchor")
    return (tagged.filter(F.col("reason").isNull()).withColumn("attrs", attrs).select(
        F.struct(*[name(F.col("identity_hint")[k]).alias(k) for k in contract["identity"]]).alias("identity"),
        F.trim("price_date").cast("date").alias("obs_date"), F.col("low_price").cast("double").alias("low_price"),
        F.col("raw_price").cast("double").alias("raw_price"),
        F.coalesce(F.when(F.col("metric") != "", F.col("metric")), F.lit("price")).alias("metric"),
        F.lit(contract["unit"]).alias("price_unit"), "attrs",
        *[F.try_element_at("attrs", F.lit(k)).alias(k) for k in promoted],
        F.col("shop.name").alias("shop_name"), F.col("shop.platform").alias("shop_platform"),
        F.coalesce("shop.url", F.lit("")).alias("shop_url"), F.coalesce("in_stock", F.lit(True)).alias("in_stock"),
        "coupons", F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("source_tier", F.lit("")).alias("source_tier"), "collected_on", "pos"))


def quarantine_rows(tagged: DataFrame) -> DataFrame:
    raw = F.to_json(F.struct(*[c for c in tagged.columns if c not in ("reason", "collected_on", "pos")]))
    return tagged.filter(F.col("reason").isNotNull()).select("collected_on", "pos", "reason", raw.alias("raw_json"))


def registry_reason(contract: dict) -> Column:
    """First problem of a registry row (identity struct, url, channel, source, vendor, anchor)."""
    vals = {k: v["values"] for k, v in contract["attrs"].items()}
    missing = F.filter(F.array(*[F.lit(k) for k in contract["identity"]]),
                       lambda k: ~F.map_contains_key(F.col("identity"), k))

    def optional(name):
        c = F.col(name)
        return F.when((F.coalesce(c, F.lit("")) != "") & ~c.isin(*vals[name]), f"bad_{name}")

    return F.coalesce(
        F.when(F.size(missing) > 0, F.concat(F.lit("identity_missing:"), _quoted(missing))),
        F.when(~F.rlike(F.coalesce("url", F.lit("")), F.lit(fixed.PRODUCT_URL)), "bad_url"),
        F.when(~F.coalesce(F.col("channel").isin(*vals["channel"]), F.lit(False)), "bad_channel"),
        F.when(~F.coalesce("source", F.lit(fixed.SALES_SOURCE)).isin(*vals["source"]), "bad_source"),
        optional("vendor"), optional("anchor"))


def validate_registry(rows: DataFrame, contract: dict) -> DataFrame:
    """Active registry rows with their first problem in `reason`; retired rows are skipped."""
    return rows.filter(~F.coalesce("retired", F.lit(False))).withColumn("reason", registry_reason(contract))


def validate_registry_files(files: DataFrame, rows: DataFrame, contract: dict) -> DataFrame:
    """Whole registry files: `reason` is the first that holds of another domain, a source outside the contract, the first bad listing, no usable listing; null for a good file.

    files: file, domain, source. rows: file, pos and the columns of `validate_registry`.
    """
    judged = validate_registry(rows, contract)
    per = judged.groupBy("file").agg(F.count(F.lit(1)).alias("n_listings"), F.min_by(F.struct("pos", "reason"), F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("_bad"))
    first = F.when(F.col("_bad.reason").isNotNull(), F.concat(F.lit("listing "), F.col("_bad.pos").cast("string"), F.lit(": "), F.col("_bad.reason")))
    reason = F.coalesce(F.when(~F.col("domain").eqNullSafe(F.lit(contract["domain"])), "bad_domain"),
                        F.when(~F.coalesce(F.col("source").isin(*contract["attrs"]["source"]["values"]), F.lit(False)), "bad_source"),
                        first, F.when(F.col("n_listings").isNull(), "no_usable_listing"))
    return files.join(per, "file", "left").select("file", F.coalesce("n_listings", F.lit(0)).cast("long").alias("n_listings"), reason.alias("reason"))


def path_reason(p: Column) -> Column:
    """Why a declared path may not be used: absolute, climbing, or outside the dated folder."""
    s = F.translate(p, "\\", "/")
    return (F.when(F.rlike(s, F.lit("^(/|[A-Za-z]:)")), F.concat(F.lit("absolute_path_not_allowed:"), p))
            .when(F.array_contains(F.split(s, "/"), ".."), F.concat(F.lit("path_traversal:"), p))
            .when(~F.rlike(s, F.lit(fixed.DAILY_PATH)), F.concat(F.lit("path_outside_daily_dir:"), p)))


def _first(arr: Column) -> Column:
    return F.get(F.array_compact(arr), F.lit(0))


def rule_reason(r: Column) -> Column:
    """First problem of one acceptance rule struct."""
    cmd = F.trim(r["cmd"])
    allowed = F.lit(False)
    for prefix in fixed.CMD_PREFIXES:
        allowed = allowed | F.startswith(cmd, F.lit(prefix))
    return F.coalesce(
        path_reason(r["path"]),
        F.when(F.rlike(r["cmd"], F.lit(fixed.SHELL_META)), F.concat(F.lit("shell_metachar_in_cmd:"), F.substring(r["cmd"], 1, 60)))
        .when(F.startswith(cmd, F.lit("-")), "cmd_option_injection")
        .when(~allowed, F.concat(F.lit("cmd_not_whitelisted:"), F.substring(cmd, 1, 60))),
        path_reason(r["schema_ref"]))


def _bare(expr: Column) -> Column:
    """An expression with its quoted texts emptied and the words between operands as commas."""
    return F.regexp_replace(F.regexp_replace(expr, "'[^']*'|\x22[^\x22]*\x22", "''"), r"\b(and|or|not|in|is)\b", ",")


def task_reason() -> Column:
    """First failing gate of an inbound task row (columns of schemas.INBOX_TASK plus `bytes`)."""
    rules = F.coalesce("acceptance", F.array().cast("array<struct<rule_id:string,type:string,path:string,cmd:string,"
                                                    "schema_ref:string,expr:string>>"))
    calc = F.filter(rules, lambda r: (r["type"] == "business_rule") & (F.coalesce(r["expr"], F.lit("")) != ""))
    bad_expr = _first(F.transform(calc, lambda r: F.when(F.rlike(_bare(r["expr"]), F.lit(fixed.EXPR_FORBIDDEN)), F.concat(F.lit("bad_expr_node:"), F.coalesce(r["rule_id"], F.lit("rule"))))))
    no_expr = F.exists(rules, lambda r: (r["type"] == "business_rule") & (F.coalesce(r["expr"], F.lit("")) == ""))
    needs_web = F.coalesce("needs_web", F.lit(False))
    fresh = F.coalesce("freshness", F.lit("none"))

    def enum(name, values):
        return F.when(~F.coalesce(F.col(name), F.lit(values[0])).isin(*values), f"schema_invalid:{name}")

    return F.coalesce(
        F.when(F.col("bytes") > 100 * 1024, F.format_string("file_too_large:%d>102400", "bytes")),
        F.when(~F.rlike(F.coalesce("task_id", F.lit("")), F.lit(fixed.TASK_ID)),
               F.concat(F.lit("bad_task_id:"), F.coalesce("task_id", F.lit("")))),
        _first(F.transform(rules, rule_reason)),
        F.when(no_expr, "business_rule_without_expr"), bad_expr,
        F.when(needs_web & (fresh == "none"), "needs_web_requires_freshness"),
        F.when(F.coalesce("objective", F.lit("")) == "", "schema_invalid:objective"),
        F.when(~F.coalesce("priority", F.lit(10)).between(0, 10), "schema_invalid:priority"),
        enum("source", ("daily", "pipeline")), enum("privacy", ("public", "internal", "secret")),
        enum("complexity", ("simple", "medium", "complex")), enum("freshness", ("none", "recent", "strict")))


def default_task_key() -> Column:
    """Given key, else plan/task[/inputs hash]; inputs that are JSON are hashed with their keys in order."""
    ih = F.coalesce(F.when(F.col("inputs_hash") != "", F.col("inputs_hash")),
                    F.when(F.coalesce("inputs", F.lit("")) != "", F.sha2(F.coalesce(F.to_json(F.try_parse_json("inputs")), "inputs"), 256)))
    made = F.concat_ws("/", F.coalesce("plan_id", F.lit("pipeline")), F.coalesce("task_id", F.lit("")), ih)
    return F.coalesce(F.when(F.col("idempotency_key") != "", F.col("idempotency_key")), made)


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """Adds reason (first failing gate) and fills in plan and idempotency key."""
    return (tasks.withColumn("reason", task_reason()).withColumn("idempotency_key", default_task_key())
            .withColumn("plan_id", F.coalesce("plan_id", F.lit("pipeline"))))


def validate_split(tasks: DataFrame, plans: DataFrame, max_tasks: int = 20) -> DataFrame:
    """Problems of a plan split, at most eight, joined by `;`; null when the split is fine.

    tasks: plan_id, pos, task_id, objective, slice_rationale, needs_web, freshness, depends_on;
    plans: plan_id, key_questions. Each task contributes a bounded list, and only the eight first
    problems of a plan are kept while aggregating.
    """
    from pyspark.sql import Window as W

    tid = F.coalesce("task_id", F.lit(""))
    named = tasks.filter("task_id <> ''").groupBy("plan_id", "task_id").agg(F.min("pos").alias("_at"))

    def blank(c):
        return F.coalesce(F.col(c), F.lit("")) == ""

    selfdep = F.transform(F.filter(F.coalesce("depends_on", F.array().cast("array<string>")), lambda x: x == tid),
                          lambda x: F.concat(tid, F.lit("_self_dependency")))
    per_task = F.concat(F.array_compact(F.array(
        F.when(tid == "", F.concat(F.lit("task"), F.col("pos").cast("string"), F.lit("_no_id")))
        .when(F.col("_dup"), F.concat(F.lit("duplicate_task_id:"), tid)),
        F.when(blank("objective"), F.concat(tid, F.lit("_no_objective"))),
        F.when(blank("slice_rationale"), F.concat(tid, F.lit("_no_slice_rationale"))),
        F.when(F.coalesce("needs_web", F.lit(False)) & (F.coalesce("freshness", F.lit("none")) == "none"),
               F.concat(tid, F.lit("_needs_web_without_freshness"))))), selfdep)
    found = (tasks.join(named, ["plan_id", "task_id"], "left").withColumn("_dup", F.col("pos") > F.col("_at"))
             .select("plan_id", "pos", F.posexplode(per_task).alias("_i", "problem")))
    first8 = F.row_number().over(W.partitionBy("plan_id").orderBy("pos", "_i"))
    found = (found.withColumn("_rn", first8).filter("_rn <= 8").groupBy("plan_id")
             .agg(F.array_sort(F.collect_list(F.struct("_rn", "problem"))).alias("_p")))
    sizes = tasks.groupBy("plan_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    head = F.array_compact(F.array(
        F.when(n > max_tasks, F.format_string("too_many_tasks:%d", n)),
        F.when(F.size(F.coalesce("key_questions", F.array().cast("array<string>"))) == 0, "no_key_questions")))
    all_of = F.slice(F.concat(head, F.coalesce(F.transform("_p", lambda s: s["problem"]),
                                               F.array().cast("array<string>"))), 1, 8)
    text = F.when(n == 0, "split_no_tasks").when(F.size(all_of) > 0, F.array_join(all_of, ";"))
    return plans.join(sizes, "plan_id", "left").join(found, "plan_id", "left").select("plan_id", text.alias("problems"))
