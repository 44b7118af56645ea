import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text as T, web
from tidemark.operators import listings as G, observations as O, rules as D, validate as V
from tidemark.sources import readers as R
from tidemark.streaming.folds import AlertFold


def val(spark, col, **kw):
    row = spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} string" for k in kw)) if kw else spark.range(1)
    return row.select(col.alias("v")).first().v


@pytest.mark.parametrize("raw,want", [("RTX 5060ti 8G(京东全新)", "RTX 5060 Ti 8GB"), ("GeForce RTX 5090（美行新卡）", "GeForce RTX 5090"),
                                      ("5060TI 8g", "5060 Ti 8GB"), ("ＲＴＸ　５０９０", "RTX 5090"), ("a (b)(c) ", "a")])
def test_normalize_name(spark, raw, want):
    assert val(spark, T.normalize_name(F.col("s")), s=raw) == want


def test_private_data(spark):
    text = "电话13812345678号 证11010519491231002X， 卡6222020200112233445 token=abc 邮箱张@例子.cn"
    flags = val(spark, T.pii_flags(F.col("s")), s=text)
    assert flags == ["id_card", "phone", "bank", "api_key", "email"]
    clean = val(spark, T.redact(F.col("s")), s=text)
    assert "13812345678" not in clean and "[REDACTED]" in clean and "6222" not in clean
    assert val(spark, T.pii_flags(F.col("s")), s="138123456789") == []


def test_tokens_and_zero_width(spark):
    assert val(spark, T.estimate_tokens(F.col("s")), s="数据abcde") == 4
    assert val(spark, T.clean_zero_width(F.col("s")), s="a​b﻿c⁠") == "abc"


def test_dates_and_urls(spark):
    assert str(val(spark, dates.parse_any_date(F.col("s")), s="2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert str(val(spark, dates.parse_any_date(F.col("s")), s="2024/01/02")) == "2024-01-02 00:00:00"
    assert val(spark, dates.parse_any_date(F.col("s")), s="2024") is None
    assert val(spark, web.domain_of(F.col("s")), s="https://www.A.gov.cn/x") == "a.gov.cn"
    assert val(spark, web.domain_of(F.col("s")), s="not a url") == ""


def test_date_price_forms(spark):
    p = val(spark, O.parse_date_price(F.col("s")), s='[1730000000000, 3599.0, "x"],[1730100000000, 3499.0]')
    assert [(x.ts_ms, x.price, x.remark) for x in p] == [(1730000000000, 3599.0, "x"), (1730100000000, 3499.0, "")]
    assert len(val(spark, O.parse_date_price(F.col("s")), s='[[1730000000000, 1.5], "junk", [5]]')) == 1
    for bad in ("", "[1,2,", "17"):
        assert val(spark, O.parse_date_price(F.col("s")), s=bad) == []


def test_same_day_keeps_the_remark_of_the_low(spark):
    pts = spark.createDataFrame([(1, 1730000000000, 3347.0, "a", 0), (1, 1730000001000, 2879.1, "b", 1), (1, 1730000002000, 2879.1, "c", 2)],
                                "k int, ts_ms long, price double, remark string, pos int")
    row = O.collapse_daily(pts, ["k"]).first()
    assert (row.price, row.remark) == (2879.1, "b")


@pytest.mark.parametrize("title,series,spec,want", [
    ("七彩虹 RTX 5060 8G 战斧", "RTX 5060", "8GB", True), ("RTX5060Ti 8G", "RTX 5060", "8GB", False), ("RTX 5060 Ti 8G", "RTX 5060 Ti", "8GB", True),
    ("RX 9070 XT 16G", "RX 9070 XT", "16GB", True), ("RX 9070 XT 16G", "RX 9070", "16GB", False), ("RTX4060/4070/4080 8G", "RTX 4060", "8GB", False),
    ("金百达 DDR5 16G*2", "DDR5", "16G×2", True)])
def test_match_spec(spark, title, series, spec, want):
    assert val(spark, G.match_spec(F.col("a"), F.col("b"), F.col("c")), a=title, b=series, c=spec) is want


def test_alert_fold_cap():
    fold, state, got = AlertFold(1_000_000, 3), [], []
    for i in range(6):
        state, o = fold.step(state, {"ts_us": i * 5_000_000})
        got.append(o[1])
    assert got == ["ok"] * 3 + ["hourly_cap"] * 3


def test_chart_fences(spark):
    good = "```mermaid\nxychart-beta\n y-axis 1 --> 2\n bar [1]\n```"
    for text, want in ((good, (1, 1, 0)), (good.replace("-->", ""), (1, 1, 1)), (good.replace("]", ""), (1, 1, 1)), ("none", (0, 0, 0))):
        assert tuple(val(spark, D.chart_blocks(F.col("s")), s=text)) == want


def test_coverage_short_and_long(spark):
    df = spark.createDataFrame([(1, ["要点1", "要点2", "截至今日，南京房价表现如何？"], "# 报告\n## 要点1\n南京房价表现平稳")], "id int, key_questions array<string>, report string")
    row = D.coverage(df, ["id"]).first()
    assert row.detail == "unanswered=要点2"


def test_observation_files(spark, tmp_path):
    d = tmp_path / "artifacts" / "2026-10-10"
    d.mkdir(parents=True)
    base = {"identity_hint": {"category": "显卡", "series": "RTX 5060ti", "spec": "8G"},
            "attrs_hint": {"condition": "全新", "channel": "京东自营", "source": "自采"}, "low_price": 3599.0, "price_date": "2026-10-10",
            "shop": {"name": "n", "platform": "京东"}}
    rows = [base, {**base, "low_price": -5}, {**base, "price_date": "2026-10-11"}, {**base, "attrs_hint": {"condition": "全新"}},
            {**base, "attrs_hint": {**base["attrs_hint"], "color": "x"}}, {**base, "low_price": "inf"}, {**base, "low_price": "12d"}]
    (d / "t1_sku_observations.json").write_text(json.dumps(rows, ensure_ascii=False))
    from tidemark import fixed
    raw = R.read_observations(spark, str(tmp_path / "artifacts" / "*"))
    tagged = V.tag_observations(raw, fixed.HARDWARE_CONTRACT).orderBy("pos").collect()
    assert [r.collected_on for r in tagged] == ["2026-10-10"] * 7
    assert [(r.reason or "").split(":")[0] for r in tagged] == ["", "bad_price", "date_after_collection", "missing_required_attr", "unknown_attr_key",
                                                               "bad_price", "bad_price"]
    assert tagged[6].reason == "bad_price:not_a_number"
    good = V.shape_observations(V.tag_observations(raw, fixed.HARDWARE_CONTRACT), fixed.HARDWARE_CONTRACT).first()
    assert good.identity.series == "RTX 5060 Ti" and good.identity.spec == "8GB" and good.channel == "自营"


def test_trend_dump_and_segments(spark, tmp_path):
    d = tmp_path / "2026-10-11"
    d.mkdir()
    dump = {"fetched_at": "x", "listings": [{"url": "u", "sp_name": "s", "trend": {"datePrice": [[1730000000000, 5, "r"], [1]]}}]}
    (d / "raw.json").write_text(json.dumps(dump))
    row = R.read_trend_dump(spark, str(d)).first()
    assert row.date == "2026-10-11" and len(row.points) == 1 and row.points[0].remark == "r"
    seg = {"url": "u", "current": 499900, "min": 391410, "max": "509900",
           "series": [{"name": "90", "data": [{"x": 1, "y": 2}]}, {"name": "360", "data": [{"x": 1760457600, "y": 434900}, {"x": 2, "y": 3}, {"x": 4, "y": 5}]}]}
    (tmp_path / "seg.json").write_text(json.dumps(seg))
    s = R.read_segment_trends(spark, str(tmp_path / "seg.json")).first()
    assert len(s.points) == 3 and s.points[0].ts_ms == 1760457600000 and s.points[0].price == 4349.0
    assert (s.current_price, s.min_price, s.max_price) == (4999.0, 3914.1, 5099.0)


def test_source_files(spark, tmp_path):
    (tmp_path / "t1.sources.json").write_text('{"sources":[{"id":"a","url":"https://x"},{"source_id":"b","tier_reason":"r"},7]}')
    (tmp_path / "t2.sources.json").write_text('[{"title":"A"B""}]')
    (tmp_path / "t3.sources.json").write_text('{"x":1}')
    rows, issues = R.read_sources_claims(spark, str(tmp_path / "*.sources.json"), "sources")
    got = rows.orderBy("pos").collect()
    assert [(r.task_id, r.source_id, r.tier_reason) for r in got] == [("t1", "a", None), ("t1", "b", "r")]
    assert {r.task_id: r.issue for r in issues.collect()} == {"t2": "sources_json_invalid", "t3": "sources_json_bad_shape"}


def test_screens_and_words(spark, tmp_path):
    xml = ('<h><node index="0" text="​¥" class="x" content-desc="" bounds="[1,2][3,4]"/>'
           '<node text="" content-desc="12" b="" bounds="[5,6][7,8]"/><node text="" content-desc="" bounds="[5,6][7,8]"/></h>')
    (tmp_path / "kw_s1.xml").write_text(xml)
    got = R.read_screen_nodes(spark, str(tmp_path / "*.xml")).orderBy("pos").collect()
    assert [(r.screen_id, r.y1, r.y2, r.x1, r.val) for r in got] == [("kw_s1", 2, 4, 1, "¥"), ("kw_s1", 6, 8, 5, "12")]
    ocr = [{"Words": [{"Text": " a ", "BoundingRect": {"Top": 5, "Left": 9}}, {"Text": ""}]}]
    (tmp_path / "p.json").write_text(json.dumps(ocr))
    w = R.read_ocr_words(spark, str(tmp_path / "p.json")).collect()
    assert [(r.page_id, r.y, r.x, r.text) for r in w] == [("p.json", 5, 9, "a")]


def test_manifest(spark, tmp_path):
    import hashlib
    body = "h\n" + "".join(f"row{i},{'x' * 600}\n" for i in range(7))
    (tmp_path / "a.csv").write_text(body)
    m = R.artifact_manifest(spark, str(tmp_path / "a.csv")).first()
    assert m.sha256 == hashlib.sha256(body.encode()).hexdigest() and m.rows == 7 and m.bytes == len(body)
    assert len(m.preview) == 5 and m.preview[0] == "h" and len(m.preview[1]) == 500


def test_a_folder_per_key_is_written_by_all_tasks(spark, tmp_path):
    from bindings.base import folders
    rows = spark.range(0, 40, 1, 1).selectExpr("concat('x', id) AS value", "concat('t', id, '.sources.json') AS f")
    folders(rows, "f").text(str(tmp_path / "in"))
    files = [p for p in (tmp_path / "in").glob("f=*/part-*")]
    assert sorted(p.read_text() for p in files) == sorted(f"x{i}\n" for i in range(40))
    assert len({p.name.split("-")[1] for p in files}) > 1
