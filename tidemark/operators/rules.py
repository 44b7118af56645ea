"""Acceptance rules. Every rule yields one row per subject: rule_id, type, ok, detail."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.attrs import is_json
from tidemark.functions.dates import parse_any_date
from tidemark.functions.text import question_keywords
from tidemark.operators import evidence as E
from tidemark.operators.validate import path_reason


def _result(df: DataFrame, keys: Sequence[str], rule_id: str, kind: str, ok: Column, detail: Column) -> DataFrame:
    return df.select(*keys, F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("type"),
                     F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))


def row_count(counts: DataFrame, minimum: int, keys: Sequence[str], rule_id: str = "row_count") -> DataFrame:
    """counts: keys + n_lines of a text file; the header line is not a row."""
    rows = F.greatest(F.col("n_lines") - 1, F.lit(0))
    return _result(counts, keys, rule_id, "row_count", rows >= minimum, F.format_string(f"rows=%d need>={minimum}", rows))


def file_exists(declared: DataFrame, listing: DataFrame, keys: Sequence[str], rule_id: str = "file_exists") -> DataFrame:
    """declared: keys + path. Refused paths fail for their reason, others must be in the listing."""
    have = listing.select("path", F.lit(True).alias("_have")).distinct()
    j = declared.withColumn("_why", F.when(F.coalesce("path", F.lit("")) == "", "empty_path").otherwise(
        path_reason(F.col("path")))).join(have, "path", "left")
    detail = F.when(F.col("_why").isNotNull(), F.concat(F.lit("security:"), "_why")).when(
        F.col("_have").isNull(), F.concat(F.lit("missing:"), "path")).otherwise("ok")
    return _result(j, keys, rule_id, "file_exists", F.col("_why").isNull() & F.col("_have").isNotNull(), detail)


_TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "integer": "^BIGINT$",
          "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN$"}


def schema_violations(doc: Column, checks: Sequence[Mapping]) -> Column:
    """Array of `path: message` for a variant column, in check order.

    A check holds path plus any of required, type, enum, pattern, minimum, maximum, minItems, containsConst.
    """
    found = []
    for c in checks:
        path, name = c["path"], c["path"].removeprefix("$").removeprefix(".") or "$"
        node = F.try_variant_get(doc, path, "variant")
        there = F.schema_of_variant(node)
        text, number = F.try_variant_get(doc, path, "string"), F.try_variant_get(doc, path, "double")
        items = F.try_variant_get(doc, path, "array<string>")

        def say(cond, message, name=name):
            found.append(F.when(cond, F.lit(f"{name}: {message}")))

        if c.get("required"):
            say(node.isNull(), "required")
        if "type" in c:
            say(node.isNotNull() & ~F.rlike(there, F.lit(_TYPES[c["type"]])), f"type {c['type']}")
        if "enum" in c:
            say(text.isNotNull() & ~text.isin(*c["enum"]), "enum")
        if "pattern" in c:
            say(text.isNotNull() & ~F.rlike(text, F.lit(c["pattern"])), "pattern")
        if "minimum" in c:
            say(number < c["minimum"], "minimum")
        if "maximum" in c:
            say(number > c["maximum"], "maximum")
        if "minItems" in c:
            say(F.size(items) < c["minItems"], "minItems")
        if "containsConst" in c:
            say(items.isNotNull() & ~F.array_contains(items, c["containsConst"]), "contains")
    return F.array_compact(F.array(*found))


def json_schema(docs: DataFrame, checks: Sequence[Mapping], keys: Sequence[str], rule_id: str = "json_schema") -> DataFrame:
    """docs: keys + body (JSON text). The detail names the first five violations."""
    d = docs.withColumn("_doc", F.when(is_json(F.col("body")), F.try_parse_json("body")))
    v = schema_violations(F.col("_doc"), checks)
    detail = F.when(F.col("_doc").isNull(), "not_json").otherwise(F.array_join(F.slice(v, 1, 5), "; "))
    return _result(d, keys, rule_id, "json_schema", F.col("_doc").isNotNull() & (F.size(v) == 0), detail)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def tree_problems(node: Column, schema: Mapping, path: Column) -> Column:
    """Array of `path: word` for every place where a variant breaks a schema, outer before inner.

    Understands type, required, properties, items, minItems, maxItems, minLength, minimum, maximum, pattern, enum, const, and contains (by itself or in allOf), nested to any
    depth: the schema is laid out as one expression, arrays are walked by higher-order functions. What a node is and holds is worked out once, so the expression grows with the
    schema alone. Arrays and objects are known by a cast that opens their first level only; the schema of a variant, which reads all below it, is asked for single values.
    """
    return _with(node, lambda v: _tree(v, schema, path))


def _tree(v: Column, schema: Mapping, path: Column) -> Column:
    """The problems of a node that is at hand; only what its schema asks for is opened."""
    names = list(dict.fromkeys([*schema.get("required", ()), *schema.get("properties", {})]))
    listed = schema.get("type") == "array" or any(w in schema for w in ("items", "minItems", "maxItems", "contains", "allOf"))
    values = [schema[w] for w in ("const",) if w in schema] + list(schema.get("enum", ()))
    none = F.lit(None)
    items = F.try_variant_get(v, "$", "array<variant>") if listed else none.cast("array<variant>")
    mapped = F.try_variant_get(v, "$", "map<string,variant>").isNotNull() if names or schema.get("type") == "object" else F.lit(False)
    children = [F.try_variant_get(v, f"$['{name}']", "variant").alias(f"child{i}") for i, name in enumerate(names)]
    worded = any(w in schema for w in ("minLength", "pattern")) or any(isinstance(x, str) for x in values)
    counted = any(w in schema for w in ("minimum", "maximum")) or any(not isinstance(x, str) for x in values)

    def seen(o: Column) -> Column:
        kind = F.when(o["items"].isNotNull(), "ARRAY").when(o["object"], "OBJECT").otherwise(F.schema_of_variant(v))
        return _with(kind, lambda k: told(o, k))

    def told(o: Column, kind: Column) -> Column:
        text = F.when(F.rlike(kind, F.lit("^STRING")), F.try_variant_get(v, "$", "string")) if worded else none.cast("string")
        number = F.when(F.rlike(kind, F.lit(_TYPES["number"])), F.try_variant_get(v, "$", "double")) if counted else none.cast("double")
        child = {name: o[f"child{i}"] for i, name in enumerate(names)}
        if not worded and not counted:
            return _problems(kind, text, number, o["items"], child, schema, path)
        return _with(F.struct(text.alias("text"), number.alias("number")), lambda x: _problems(kind, x["text"], x["number"], o["items"], child, schema, path))

    return _with(F.struct(items.alias("items"), mapped.alias("object"), *children), seen)


def _problems(kind: Column, text: Column, number: Column, items: Column, child: Mapping[str, Column], schema: Mapping, path: Column) -> Column:
    """The problems of one node and those below it."""
    own, inner = [], []

    def say(broken: Column, word: str, at: Column = path) -> None:
        own.append(F.when(broken, F.concat(at, F.lit(f": {word}"))))

    def fits(sub: Mapping):
        return lambda x: F.size(_tree(x, sub, F.lit(""))) == 0

    def value(v) -> Column:
        return (text == v) if isinstance(v, str) else (number == float(v))

    if "type" in schema:
        say(~F.rlike(kind, F.lit(_TYPES[schema["type"]])), f"type {schema['type']}")
    for name in schema.get("required", ()):
        say(F.rlike(kind, F.lit("^OBJECT")) & child[name].isNull(), "required", F.concat(path, F.lit(f".{name}")))
    for word, measure, wrong in (("minLength", F.length(text), "lt"), ("minimum", number, "lt"), ("maximum", number, "gt"), ("minItems", F.size(items), "lt"), ("maxItems", F.size(items), "gt")):
        if word in schema:
            seen = measure.isNotNull() & (items.isNotNull() if word.endswith("Items") else F.lit(True))
            say(seen & (measure < schema[word] if wrong == "lt" else measure > schema[word]), word)
    if "pattern" in schema:
        say(~F.rlike(text, F.lit(schema["pattern"])), "pattern")
    if "const" in schema:
        say(~F.coalesce(value(schema["const"]), F.lit(False)), "const")
    if "enum" in schema:
        among = F.lit(False)
        for v in schema["enum"]:
            among |= F.coalesce(value(v), F.lit(False))
        say(~among, "enum")
    for part in (*([schema] if "contains" in schema else []), *schema.get("allOf", ())):
        if "contains" in part:
            say(~F.exists(items, fits(part["contains"])), "contains")
    for name, sub in schema.get("properties", {}).items():
        inner.append(F.when(child[name].isNotNull(), _tree(child[name], sub, F.concat(path, F.lit(f".{name}")))))
    if "items" in schema:
        inner.append(F.flatten(F.transform(items, lambda x, i: _tree(x, schema["items"], F.concat(path, F.lit("."), i.cast("string"))))))
    none = F.array().cast("array<string>")
    return F.concat(F.array_compact(F.array(*own)) if own else none, *[F.coalesce(x, none) for x in inner])


def json_tree(docs: DataFrame, schema: Mapping, keys: Sequence[str], rule_id: str = "json_schema") -> DataFrame:
    """docs: keys + body (JSON text), held against a nested schema. The detail names the first five problems."""
    d = docs.withColumn("_doc", F.when(is_json(F.col("body")), F.try_parse_json("body"))).withColumn("_v", tree_problems(F.col("_doc"), schema, F.lit("$")))
    detail = F.when(F.col("_doc").isNull(), "not_json").otherwise(F.array_join(F.slice("_v", 1, 5), "; "))
    return _result(d, keys, rule_id, "json_schema", F.col("_doc").isNotNull() & (F.size("_v") == 0), detail)


_OPS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b,
        "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _operand(t: Mapping, like=None) -> Column:
    """A column of the statistics, or a nested JSON value (dotted path) with its default; a number where it meets one."""
    if "json" not in t:
        return F.col(t["field"])
    raw = F.get_json_object("body", f"$.{t['json']}")
    if isinstance(like, (int, float)) or isinstance(t.get("default"), (int, float)):
        return F.coalesce(raw.try_cast("double"), F.lit(float(t.get("default", 0))))
    return F.coalesce(raw, F.lit(t.get("default", "")))


def holds(t: Mapping) -> Column:
    """A term as a condition.

    {all: [..]}, {any: [..]}, {not: ..}; {has: dotted path} for a key of the body; else a left operand (field or json) with op and value. ops: comparisons, `in` and `not in`
    a list, `contains` and `lacks` a text. The value may be another operand: {field: ..} or {json: ..}.
    """
    if "all" in t or "any" in t:
        parts = [holds(x) for x in t.get("all", t.get("any"))]
        out = F.lit("all" in t)
        for p in parts:
            out = out & p if "all" in t else out | p
        return out
    if "not" in t:
        return ~F.coalesce(holds(t["not"]), F.lit(False))
    if "has" in t:
        return F.get_json_object("body", f"$.{t['has']}").isNotNull()
    op, value = t["op"], t["value"]
    if op in ("in", "not in"):
        among = _operand(t, value[0] if value else None).isin(*value)
        return among if op == "in" else ~among
    right = _operand(value) if isinstance(value, Mapping) else F.lit(value)
    left = _operand(t, None if isinstance(value, Mapping) else value)
    if op in ("contains", "lacks"):
        inside = F.contains(left.cast("string"), right.cast("string"))
        return inside if op == "contains" else ~inside
    return _OPS[op](left, right)


def words_of(t: Mapping) -> str:
    if "all" in t or "any" in t:
        return "(" + (" and " if "all" in t else " or ").join(words_of(x) for x in t.get("all", t.get("any"))) + ")"
    if "not" in t:
        return f"not {words_of(t['not'])}"
    if "has" in t:
        return f"has {t['has']}"
    value = t["value"]
    return f"{t.get('json') or t.get('field')} {t['op']} {value.get('json') or value.get('field') if isinstance(value, Mapping) else value}"


def business_rule(stats: DataFrame, terms: Sequence[Mapping], keys: Sequence[str], rule_id: str = "business_rule") -> DataFrame:
    """All terms must hold (see `holds`); malformed JSON counts as an empty object."""
    return _result(stats, keys, rule_id, "business_rule", holds({"all": list(terms)}), F.lit(" and ".join(words_of(t) for t in terms)))


def data_period_match(periods: DataFrame, trades: DataFrame, keys: Sequence[str], rule_id: str = "data_period_match") -> DataFrame:
    """periods: keys + period map market -> date; trades: keys + market, day. Each date must be a trade day of its market."""
    days = trades.select(*keys, "market", "day", F.lit(True).alias("_hit")).distinct()
    markets = trades.select(*keys, "market", F.lit(True).alias("_rows")).distinct()
    p = periods.select(*keys, F.explode_outer("period").alias("market", "day")).withColumn("day", F.trim("day"))
    j = p.join(days, [*keys, "market", "day"], "left").join(markets, [*keys, "market"], "left")
    word = F.when(F.col("_rows").isNull(), F.concat("market", F.lit(":no_rows"))).when(
        F.col("_hit").isNull(), F.concat("market", F.lit(":"), "day"))
    a = j.groupBy(*keys).agg(F.count("market").alias("_n"), F.array_sort(F.collect_list(word)).alias("_bad"))
    detail = F.when(F.col("_n") == 0, "no_data_period_object").when(
        F.size("_bad") > 0, F.concat(F.lit("mismatch:"), F.array_join("_bad", "; "))).otherwise("ok")
    return _result(a, keys, rule_id, "data_period_match", (F.col("_n") > 0) & (F.size("_bad") == 0), detail)


def chart_blocks(text: Column) -> Column:
    """struct(blocks, charts, bad): chart fences of a document and how many would not render."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)```mermaid\s*\n(.*?)```"), 1)
    charts = F.filter(blocks, lambda b: F.rlike(b, F.lit(r"(?im)^\s*(xychart|pie|gantt)")))

    def broken(b):
        opened = F.length(b) - F.length(F.replace(b, F.lit("["), F.lit("")))
        closed = F.length(b) - F.length(F.replace(b, F.lit("]"), F.lit("")))
        xy = F.rlike(b, F.lit(r"(?i)^\s*xychart"))
        arrowless = F.exists(F.split(b, "\n"), lambda ln: F.rlike(ln, F.lit(r"(?i)^\s*y-axis\b")) & ~F.contains(ln, F.lit("-->")))
        return (F.trim(b) == "") | (xy & (opened != closed)) | arrowless

    return F.struct(F.size(blocks).alias("blocks"), F.size(charts).alias("charts"), F.size(F.filter(charts, broken)).alias("bad"))


def mermaid(docs: DataFrame, minimum: int, keys: Sequence[str], rule_id: str = "mermaid") -> DataFrame:
    d = docs.withColumn("_c", chart_blocks(F.col("text")))
    good = F.col("_c.charts") - F.col("_c.bad")
    detail = F.concat(F.format_string(f"mermaid_charts=%d blocks=%d need>={minimum}", good, F.col("_c.blocks")),
                      F.when(F.col("_c.bad") > 0, F.format_string(" bad=%d", F.col("_c.bad"))).otherwise(""))
    return _result(d, keys, rule_id, "mermaid", good >= minimum, detail)


def freshness(sources: DataFrame, now: Column, keys: Sequence[str], days: int | None = None, mode: str = "none",
              rule_id: str = "freshness") -> DataFrame:
    """At most 30 % of the dated sources may be stale; none dated fails."""
    limit = days or fixed.FRESHNESS_DAYS.get(mode, 730)
    at = parse_any_date(F.col("published_at"))
    old = at < now.cast("timestamp") - F.expr(f"INTERVAL {limit} DAYS")
    a = sources.groupBy(*keys).agg(F.count_if(at.isNotNull()).alias("dated"), F.count_if(old).alias("stale"),
                                   F.count_if(at.isNull()).alias("no_date"))
    ratio = F.try_divide(F.col("stale"), F.col("dated"))
    detail = F.when(F.col("dated") == 0, F.format_string("no_dated_sources:%d", "no_date")).otherwise(
        F.format_string("stale=%d/%d no_date=%d", "stale", "dated", "no_date"))
    return _result(a, keys, rule_id, "freshness", (F.col("dated") > 0) & (ratio <= fixed.STALE_LIMIT), detail)


def source_quality(sources: DataFrame, keys: Sequence[str], bar: float = fixed.A_TIER_BAR, rule_id: str = "source_quality") -> DataFrame:
    """A share among the sources with a reason must reach the bar (inclusive)."""
    a = E.research_ratio(sources, keys)
    detail = F.when(F.col("n_counted") == 0, "no_tier_reason_entries").otherwise(F.format_string(
        "A=%d/%d excluded_no_reason=%d", "n_a", "n_counted", F.col("n_sources") - F.col("n_counted")))
    return _result(a, keys, rule_id, "source_quality", (F.col("n_counted") > 0) & (F.col("ratio") >= bar), detail)


def source_traceable(claims: DataFrame, sources: DataFrame, tasks: DataFrame, keys: Sequence[str],
                     rule_id: str = "source_traceable") -> DataFrame:
    """Precedence of the detail: no claims, then the issue of an unreadable source list (tasks.issue), then bad claims or urls."""
    keys = list(keys)
    c = E.traceability(claims, sources, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if("bad").alias("_bad"))
    s = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ns"),
                                   F.count_if(~F.rlike(F.coalesce("url", F.lit("")), F.lit("^https?://"))).alias("_bu"))
    j = tasks.select(*keys, "issue").join(c, keys, "left").join(s, keys, "left").fillna(0, ["_n", "_bad", "_ns", "_bu"])
    detail = (F.when(F.col("_n") == 0, "no_claims_json")
              .when(F.col("_ns") == 0, F.coalesce("issue", F.lit("no_sources_json")))
              .when((F.col("_bad") > 0) | (F.col("_bu") > 0), F.format_string("hallucination:%d;bad_url:%d", "_bad", "_bu"))
              .otherwise(F.format_string("claims=%d sources=%d", "_n", "_ns")))
    ok = (F.col("_n") > 0) & (F.col("_ns") > 0) & (F.col("_bad") == 0) & (F.col("_bu") == 0)
    return _result(j, keys, rule_id, "source_traceable", ok, detail)


def unanswered(questions: Column, report: Column) -> Column:
    """Questions (array) a report does not cover: neither verbatim, nor in a heading, nor by half of their keywords."""
    headings = F.filter(F.split(F.regexp_replace(report, r"(?m)^(#{1,6})\s+", "$1 "), "\n"), lambda ln: F.startswith(ln, F.lit("#")))

    def in_heading(words):
        return F.exists(headings, lambda h: F.contains(h, words))

    def missing(q):
        head = F.trim(q)
        keys = question_keywords(head)
        hits = F.size(F.filter(keys, lambda k: F.contains(report, k)))
        long_ok = in_heading(F.substring(head, 1, 12)) | (F.size(keys) == 0) | (hits * 2 >= F.size(keys))
        ok = F.contains(report, head) | F.when(F.length(head) <= 6, in_heading(head)).otherwise(long_ok)
        return (head != "") & ~ok

    return F.filter(questions, missing)


def coverage(reports: DataFrame, keys: Sequence[str], rule_id: str = "coverage") -> DataFrame:
    """reports: keys + key_questions array + report text."""
    d = reports.withColumn("_m", unanswered(F.col("key_questions"), F.coalesce("report", F.lit(""))))
    detail = (F.when(F.size("key_questions") <= 0, "no_key_questions").when(F.coalesce("report", F.lit("")) == "", "no_report_md")
              .otherwise(F.concat(F.lit("unanswered="), F.array_join(F.slice("_m", 1, 5), "|"))))
    ok = (F.size("key_questions") > 0) & (F.coalesce("report", F.lit("")) != "") & (F.size("_m") == 0)
    return _result(d, keys, rule_id, "coverage", ok, detail)


def rule_ids(rules: DataFrame) -> DataFrame:
    """Adds rule_id (own or by original position) and the running order: evidence rules first, in fixed order."""
    place = F.array_position(F.array(*[F.lit(t) for t in fixed.EVIDENCE_RULE_ORDER]), F.col("type"))
    return (rules.withColumn("rule_id", F.coalesce(F.when(F.col("rule_id") != "", F.col("rule_id")),
                                                   F.concat(F.lit("rule_"), F.col("pos").cast("string"))))
            .withColumn("run_order", F.struct(F.when(place > 0, 0).otherwise(1).alias("late"), place.alias("place"),
                                              F.col("pos").alias("pos"))))


def run_rules(rules: DataFrame, results: DataFrame, verified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rules of every subject with their outcome, none short-circuited.

    rules: keys, pos, rule_id, type; results: keys, rule_id, ok, detail; verified: keys, rule_id already passed.
    A rule without a result is deferred; an unknown type fails.
    """
    keys = list(keys)
    r = rule_ids(rules)
    j = (r.join(verified.select(*keys, "rule_id", F.lit(True).alias("_done")).distinct(), [*keys, "rule_id"], "left")
         .join(results.select(*keys, "rule_id", "ok", "detail"), [*keys, "rule_id"], "left"))
    unknown = ~F.col("type").isin(*fixed.RULE_TYPES)
    status = (F.when(F.col("_done"), "skipped").when(unknown, "fail").when(F.col("ok").isNull(), "deferred")
              .when(F.col("ok"), "ok").otherwise("fail"))
    detail = (F.when(F.col("_done"), "already_verified").when(unknown, F.concat(F.lit("unknown_rule_type:"), "type"))
              .when(F.col("ok").isNull(), "not_evaluated").otherwise(F.col("detail")))
    return j.select(*keys, "rule_id", "type", "run_order", status.alias("status"), detail.alias("detail"))


#: How a declared rule finds its inputs: type -> (parameters, inputs, keys, rule id) to results.
HANDLERS = {
    "row_count": lambda p, i, k, r: row_count(i["counts"], p["min"], k, r),
    "file_exists": lambda p, i, k, r: file_exists(i["declared"], i["listing"], k, r),
    "json_schema": lambda p, i, k, r: json_tree(i["bodies"], p["schema"], k, r),
    "business_rule": lambda p, i, k, r: business_rule(i["stats"], p["terms"], k, r),
    "data_period_match": lambda p, i, k, r: data_period_match(i["periods"], i["trades"], k, r),
    "mermaid": lambda p, i, k, r: mermaid(i["texts"], p.get("min", 1), k, r),
    "freshness": lambda p, i, k, r: freshness(i["sources"], F.lit(p["now"]), k, p.get("days"), p.get("mode", "none"), r),
    "source_quality": lambda p, i, k, r: source_quality(i["graded"], k, p.get("bar", fixed.A_TIER_BAR), r),
    "source_traceable": lambda p, i, k, r: source_traceable(i["claims"], i["sources"], i["tasks"], k, r),
    "coverage": lambda p, i, k, r: coverage(i["reports"], k, r),
}


def run_suite(subjects: DataFrame, suite: Sequence[Mapping], inputs: Mapping[str, DataFrame], keys: Sequence[str], verified: DataFrame | None = None) -> DataFrame:
    """Run a declared suite on every subject: the handler of each rule's type over its input frames, then `run_rules`.

    suite: mappings with type, and optionally rule_id and the type's parameters. Types without a handler here (python_test) stay deferred, unknown ones fail.
    """
    keys = list(keys)
    rules, results = [], None
    for pos, rule in enumerate(suite):
        rid = rule.get("rule_id") or f"rule_{pos}"
        rules.append(F.struct(F.lit(pos).alias("pos"), F.lit(rid).alias("rule_id"), F.lit(rule["type"]).alias("type")))
        if rule["type"] in HANDLERS:
            got = HANDLERS[rule["type"]](rule, inputs, keys, rid)
            results = got if results is None else results.unionByName(got)
    declared = subjects.select(*keys, F.inline(F.array(*rules)))
    if results is None:
        results = declared.select(*keys, "rule_id", F.lit(None).cast("boolean").alias("ok"), F.lit("").alias("detail")).limit(0)
    return run_rules(declared, results, declared.limit(0) if verified is None else verified, keys)


def rule_outcome(ran: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DONE when everything passed, RETRY on any failure, RETRY for budget when only deferred rules are left."""
    fail, wait = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "deferred")
    return ran.groupBy(*keys).agg(
        F.when(fail > 0, "RETRY").when(wait > 0, "RETRY").otherwise("DONE").alias("next_state"),
        F.when(fail > 0, "verify_failed").when(wait > 0, "verify_budget").otherwise("ok").alias("reason"),
        fail.alias("n_failed"), wait.alias("n_deferred"))
