"""Declared schemas of the file inputs and of the tables the operators work on."""

RAW_OBSERVATION = """
  identity_hint map<string,string>, attrs_hint map<string,string>, low_price string, raw_price string,
  price_date string, metric string, shop struct<name:string,platform:string,url:string>,
  coupons array<struct<name:string,amount:double,threshold:double,expire:string>>,
  in_stock boolean, source_url string, source_tier string, img_url string"""

TREND_DUMP = """
  fetched_at string, listings array<struct<identity:struct<category:string,series:string,spec:string>,
  url:string,sp_name:string,channel:string,vendor:string,source:string,pic:string,
  trend:struct<datePrice:string,spName:string,currentPrice:double>>>"""

SEGMENT_TREND = """
  url string, current string, min string, max string,
  series array<struct<name:string,data:array<struct<x:string,y:string>>>>"""

EVENT = """
  seq long, ts timestamp, plan_id string, task_id string, from_s string, to_s string, run_id string,
  agent string, payload string"""

TASK = """
  plan_id string, task_id string, status string, attempts int, max_attempts int, session_switch_total int,
  priority int, source string, seq long, enqueued_at timestamp, updated_at timestamp, lease_until timestamp,
  owner string, idempotency_key string, inputs_hash string, last_success_hash string,
  shard struct<objective:string,depends_on:array<string>,outputs:array<string>,needs_web:boolean,
  acceptance:array<struct<rule_id:string,type:string,path:string>>>"""

INBOX_TASK = """
  task_id string, plan_id string, status string, objective string, idempotency_key string, inputs_hash string,
  inputs string, priority int, attempts int, source string, privacy string, complexity string, needs_web boolean,
  freshness string, depends_on array<string>, outputs array<string>,
  acceptance array<struct<rule_id:string,type:string,path:string,cmd:string,schema_ref:string,expr:string>>"""

SOURCE_FILE = """source_id string, id string, url string, title string, snippet string, published_at string,
  source_tier string, tier string, tier_reason string"""
CLAIM_FILE = "claim_id string, id string, text string, source_ids array<string>"

OCR_PAGE = "Words array<struct<Text:string,BoundingRect:struct<Top:int,Left:int>>>"
