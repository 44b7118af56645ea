"""Contracts of a domain, read from a file: the same structure as `fixed.HARDWARE_CONTRACT`."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def metric_rules(declared) -> dict:
    """Per kind of value its unit, the periods each metric needs, and the sources each metric may use (null: every one)."""
    if not isinstance(declared, dict):
        declared = {name: {} for name in declared or ("price",)}
    out = {}
    for name, rule in declared.items():
        rule = rule or {}
        if not isinstance(rule, dict):
            raise ValueError(f"contract metric {name} is no mapping")
        sources = {m: None if s is None else tuple(s) for m, s in (rule.get("allowed_sources") or {}).items()}
        out[name] = {"unit": rule.get("unit"), "sufficiency": {m.lower(): int(n) for m, n in (rule.get("sufficiency") or {}).items()}, "allowed_sources": sources}
    return out


def contract(data: dict) -> dict:
    """A contract from plain mappings; lists become tuples, what is left out takes its default. An error names the first thing that is missing or of the wrong kind."""
    for name in ("domain", "identity"):
        if not data.get(name):
            raise ValueError(f"contract without {name}")
    attrs = {}
    for name, rule in (data.get("attrs") or {}).items():
        if not isinstance(rule, dict):
            raise ValueError(f"contract attribute {name} is no mapping")
        attrs[name] = {"values": tuple(rule.get("values") or ()), "required": bool(rule.get("required", False))}
    rules, scope = metric_rules(data.get("metrics")), data.get("aggregate_scope") or {}
    listed = lambda v: tuple(v) if isinstance(v, (list, tuple)) else v
    return {"domain": data["domain"], "identity": tuple(data["identity"]), "attrs": attrs,
            "value_maps": {k: dict(v) for k, v in (data.get("value_maps") or data.get("attr_value_maps") or {}).items()},
            "metrics": tuple(rules), "unit": data.get("unit") or next((r["unit"] for r in rules.values() if r["unit"]), "CNY"), "metric_rules": rules,
            "aggregate_scope": {"group_by": tuple(scope.get("group_by") or ()), "default_filter": {k: listed(v) for k, v in (scope.get("default_filter") or {}).items()}},
            "change_threshold": dict((data.get("report") or {}).get("change_threshold") or {}), "propose_threshold": float(data.get("propose_threshold", 0.8))}


def read_contract(spark: SparkSession, path: str) -> dict:
    """One contract file, JSON, or YAML where PyYAML is installed, from any store Spark reads."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if text.lstrip().startswith("{"):
        return contract(json.loads(text))
    try:
        import yaml
    except ModuleNotFoundError as err:
        raise ValueError(f"{path} is not JSON, and PyYAML is not installed") from err
    return contract(yaml.safe_load(text))
