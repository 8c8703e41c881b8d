"""A2: typed parsing, coercion and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import coerce as c

from .base import pick, query

_WORDS = ["true", "True", "TRUE", "1", "yes", " Async ", "accepted", "no", "0", "f", "maybe", "", None, "Y"]
_BOOLS = f"SELECT event_id AS id, {pick('event_id', _WORDS)} AS v, {pick('CAST(floor(event_id / 14) AS BIGINT)', [None, 'yes', 'no'])} AS header, {pick('CAST(floor(event_id / 42) AS BIGINT)', ['1', 'async', 'sync', None])} AS proto FROM {{events}}"


@query("a2_01_05_booleans", _BOOLS, """
SELECT id, coalesce(v IN ('true','True'), false) AS request, coalesce(lower(trim(v)) IN ('1','true','yes','async','accepted'), false) AS protocol,
  CASE WHEN lower(v) IN ('yes','true','t','1','y') THEN true WHEN lower(v) IN ('no','false','f','0','n') THEN false END AS cli,
  coalesce(v IN ('true','1','True','TRUE'), false) AS client,
  CASE WHEN coalesce(header = 'yes', false) THEN true WHEN v IS NOT NULL THEN lower(trim(v)) IN ('1','true','yes','async','accepted') ELSE coalesce(proto IN ('1','async'), false) END AS wants_async FROM src""")
def booleans(df: DataFrame) -> DataFrame:
    v = F.col("v")
    return df.select("id", c.request_bool(v).alias("request"), c.protocol_bool(v).alias("protocol"), c.cli_bool(v).alias("cli"), c.client_bool(v).alias("client"), c.wants_async(F.col("header"), v, F.col("proto")).alias("wants_async"))


_NUMS = f"SELECT event_id AS id, {pick('event_id', ['5', ' 4 ', '4.0', '4_0', '', None, '-3', '0', '5000', 'x', '99999999999'])} AS t, {pick('event_id', ['bing', 'ab', '', None, 'google'])} AS service, {pick('CAST(floor(event_id / 5) AS BIGINT)', ['', None, 'x', 'deepseek'])} AS second, {pick('event_id', ['zh', 'e', None])} AS lang, {pick('event_id', ['engine-1', 'engine-2', 'other', None])} AS engine, CAST(value AS STRING) AS num FROM {{events}}"
_N = "CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]+(_[0-9]+)*$') THEN TRY_CAST(replace(trim(t), '_', '') AS INT) END"


@query("a2_06_08_25_numbers_and_defaults", _NUMS, f"""
+ n AS (SELECT *, {_N} AS n FROM src)
SELECT id, greatest(coalesce(n, 0), 0) AS skip, CASE WHEN coalesce(n, 8) < 1 THEN 8 ELSE coalesce(n, 8) END AS threads, CASE WHEN coalesce(n, 4) < 1 THEN 4 ELSE coalesce(n, 4) END AS qps, least(greatest(coalesce(n, 0), 0), 1000) AS pool,
  CAST(num AS DOUBLE) AS strict_num, CASE WHEN coalesce(engine, '') <> 'engine-2' THEN CASE WHEN length(coalesce(service, '')) >= 3 THEN service ELSE 'bing' END WHEN length(coalesce(nullif(second, ''), service, '')) >= 3 THEN coalesce(nullif(second, ''), service) ELSE 'siliconflowfree' END AS service, CASE WHEN length(coalesce(lang, '')) >= 2 THEN lang ELSE 'en' END AS lang,
  CASE WHEN engine IN ('engine-1','engine-2') THEN engine ELSE 'engine-1' END AS engine, coalesce(nullif(service, ''), 'bing') AS legacy_service, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN TRY_CAST(t AS INT) ELSE 0 END AS legacy_skip FROM n""")
def numbers(df: DataFrame) -> DataFrame:
    t = F.col("t")
    return df.select(
        "id", c.skip_pages(t).alias("skip"), c.at_least_one(t, 8).alias("threads"), c.at_least_one(t, 4).alias("qps"), c.pool_size(t).alias("pool"), c.strict_number(F.col("num")).alias("strict_num"),
        c.engine_service(F.col("engine"), F.col("service"), F.col("second")).alias("service"), c.text_or(F.col("lang"), 2, "en").alias("lang"), c.engine_or(F.col("engine"), ("engine-1", "engine-2")).alias("engine"),
        c.legacy_text(F.col("service"), "bing").alias("legacy_service"), c.legacy_pages(t).alias("legacy_skip"),
    )


_EXTRA = f"SELECT event_id AS id, {pick('event_id', ['openai_enable_json_mode', 'x_send_temperature', 'num_predict', 'other', 'a_enable_thinking'])} AS k, {pick('CAST(floor(event_id / 5) AS BIGINT)', ['true', ' OFF ', '1', '12', 'abc', '-7', 'No', ''])} AS v, {pick('event_id', ['null', '[]', '{ }', '0', 'false', chr(34) * 2, '[1]', None])} AS js FROM {{events}}"


@query("a2_09_10_extra_values", _EXTRA, """
+ f AS (SELECT *, regexp_matches(k, '(_enable_json_mode|_send_temprature|_send_temperature|_send_reasoning_effort|_enable_thinking|_send_enable_thinking_param)$') AS f, lower(trim(v)) AS w FROM src),
 g AS (SELECT *, CASE WHEN f AND w IN ('true','1','yes','on') THEN true WHEN f AND w IN ('false','0','no','off') THEN false END AS b, CASE WHEN k = 'num_predict' AND regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(v) AS INT) END AS i FROM f)
SELECT id, CASE WHEN b IS NOT NULL THEN 'bool' WHEN i IS NOT NULL THEN 'int' ELSE 'text' END AS kind, b, i, CASE WHEN b IS NULL AND i IS NULL THEN v END AS s, coalesce(regexp_replace(js, '\\s', '', 'g') IN ('null', '[]', '{}', chr(34) || chr(34)), true) AS is_empty FROM g""")
def extra_values(df: DataFrame) -> DataFrame:
    return df.select("id", c.extra_value(F.col("k"), F.col("v")).alias("x"), c.empty_value(F.col("js")).alias("is_empty")).select("id", "x.*", "is_empty")


_BYTES = f"SELECT page_id AS id, html, {pick('page_id', ['text/html; charset=utf-8', 'application/pdf', None])} AS kind, {pick('page_id', ['%PDF-1.7 body %%EOF', 'junk %PDF- x %%EOF tail', '%PDF-1.4 no end', '<html>x</html>', ''])} AS raw, {pick('page_id', ['PK' + chr(3) + chr(4) + ' body PK' + chr(5) + chr(6) + ' end', 'PK no end', 'no PK' + chr(5) + chr(6), ''])} AS packed, {pick('page_id', ['aGVsbG8=', 'data:application/pdf;base64,aGVsbG8=', 'aGVsbG8', 'aGV*sbG8='])} AS b64 FROM {{pages}}"


@query("a2_11_13_bytes", _BYTES, """
SELECT id, contains(raw, '%PDF-') AND contains(raw, '%%EOF') AS is_pdf, starts_with(packed, 'PK') AND contains(packed, 'PK' || chr(5) || chr(6)) AS is_zip, coalesce(contains(lower(kind), 'text/html'), false) OR starts_with(lower(ltrim(left(html, 200))), '<!doctype html') OR starts_with(lower(ltrim(left(html, 200))), '<html') AS is_html,
  CASE WHEN b64 = 'aGVsbG8' THEN NULL ELSE 'hello' END AS decoded FROM src""")
def byte_rules(df: DataFrame) -> DataFrame:
    return df.select("id", c.is_pdf(F.col("raw").cast("binary")).alias("is_pdf"), c.is_zip(F.col("packed").cast("binary")).alias("is_zip"), c.is_html(F.col("kind"), F.col("html")).alias("is_html"), c.decoded_upload(F.col("b64")).cast("string").alias("decoded"))


_THINK = f"SELECT event_id AS id, {pick('event_id', ['deepseek-v4-pro', ' deepseek-v4-x', 'deepseek-chat', '', None])} AS model, {pick('CAST(floor(event_id / 5) AS BIGINT)', ['enabled', 'Disabled ', '', None, 'null', 'often'])} AS mode, {pick('CAST(floor(event_id / 30) AS BIGINT)', ['high', 'MAX', '', 'low'])} AS effort, {pick('CAST(floor(event_id / 7) AS BIGINT)', ['deepseek-v4-pro ', None, 'x'])} AS configured, event_id % 2 = 0 AS supported, {pick('event_id', ['a||b', '', 'x'])} AS items, {pick('event_id', ['t1', None, ' '])} AS camel, {pick('event_id', [' t2 ', 't3'])} AS snake FROM {{events}}"
_M = "CASE WHEN lower(trim(coalesce(nullif(mode, ''), 'disabled'))) IN ('', 'null', 'none') THEN 'disabled' WHEN lower(trim(coalesce(nullif(mode, ''), 'disabled'))) IN ('enabled','disabled') THEN lower(trim(coalesce(nullif(mode, ''), 'disabled'))) ELSE 'error' END"


@query("a2_14_19_model_controls", _THINK, f"""
+ m AS (SELECT *, {_M} AS m, trim(coalesce(nullif(model, ''), configured, '')) AS used, starts_with(trim(coalesce(nullif(model, ''), configured, '')), 'deepseek-v4-') AS ctl, lower(trim(coalesce(nullif(effort, ''), 'high'))) AS e FROM src)
SELECT id, list_filter(string_split(items, '|'), lambda x: x <> '') AS kept, nullif(trim(coalesce(camel, snake)), '') AS task, used, ctl, m AS mode,
  CASE WHEN m = 'error' THEN 'error' WHEN supported THEN 'pass-flags' WHEN m = 'enabled' THEN 'block' ELSE 'strip-and-allow' END AS policy,
  CASE WHEN ctl AND m = 'error' OR ctl AND m = 'enabled' AND e NOT IN ('high','max') THEN NULL ELSE 'keep=1' || CASE WHEN ctl THEN CASE WHEN m = 'enabled' THEN ';deepseek_reasoning_effort=' || e ELSE '' END || ';deepseek_thinking_mode=' || m ELSE '' END END AS extra,
  CASE WHEN trim(model) = 'deepseek-chat' THEN 'deepseek-v4-pro' ELSE model END AS migrated FROM m""")
def model_controls(df: DataFrame) -> DataFrame:
    extra = F.create_map(F.lit("keep"), F.lit("1"), F.lit(c.THINKING), F.col("mode"), F.lit(c.EFFORT), F.col("effort"))
    used = c.effective_model(F.col("model"), F.col("configured"))
    controlled = c.controlled_extra(extra, used)
    in_order = F.sort_array(F.transform(F.map_entries(controlled), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    keep_first = F.concat(F.lit("keep=1"), F.array_join(F.transform(F.filter(in_order, lambda x: x != "keep=1"), lambda x: F.concat(F.lit(";"), x)), ""))
    return df.select(
        "id", c.kept_strings(F.split("items", r"\|")).alias("kept"), c.task_id(F.col("camel"), F.col("snake")).alias("task"), used.alias("used"), c.controlled_model(used).alias("ctl"), c.thinking_mode(F.col("mode")).alias("mode"),
        c.thinking_policy(F.col("mode"), F.col("supported")).alias("policy"), F.when(controlled.isNotNull(), keep_first).alias("extra"), c.migrated_model(F.col("model"), {"deepseek-chat": "deepseek-v4-pro"}).alias("migrated"),
    )


_FORMS = f"SELECT event_id AS id, {pick('event_id', ['/progress', '/progress/1', '/progressing', '/health'])} AS path, event_id % 2 = 0 AS has_new, {pick('event_id', ['boolean', 'enum', 'text'])} AS kind, {pick('CAST(floor(event_id / 3) AS BIGINT)', ['TRUE', 'high', 'odd', '', None])} AS v, {pick('event_id', ['bad-payload', 'http', None])} AS code, CAST(CASE event_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 500 WHEN 2 THEN 0 END AS INT) AS status, {pick('event_id', ['Request timed out', 'connection refused', 'odd', None])} AS message, event_id % 3 > 0 AS mirrors, {pick('event_id', ['', 'https://own/', None])} AS custom, {pick('event_id', ['https://m/', ''])} AS mirror FROM {{events}}"


@query("a2_20_24_26_forms_and_connections", _FORMS, """
SELECT id, path = '/progress' OR starts_with(path, '/progress/') AS quiet,
  CASE WHEN has_new THEN 'openai_send_temprature=new;other=1' ELSE 'openai_send_temprature=' || coalesce(v, '?') || ';other=1' END AS renamed,
  CASE kind WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true','false') THEN lower(v) ELSE '' END WHEN 'enum' THEN CASE WHEN v IN ('high','max') THEN v ELSE '' END ELSE coalesce(v, '') END AS widget,
  CASE WHEN coalesce(v, '') = '' THEN 'a=1' ELSE 'a=1;deepseek_reasoning_effort=' || CASE WHEN v IN ('high','max') THEN v ELSE 'high' END || ';deepseek_thinking_mode=disabled' END AS saved,
  CASE WHEN message = 'Request timed out' THEN 'timeout' WHEN coalesce(status IN (401, 403, 404), false) OR coalesce(code = 'bad-payload', false) THEN 'wrong-service' WHEN coalesce(status, 0) > 0 THEN 'status' WHEN message = 'connection refused' THEN 'unreachable' ELSE 'other' END AS failure,
  CASE WHEN NOT mirrors THEN 'https://default/' WHEN coalesce(custom, '') <> '' THEN custom WHEN mirror <> '' THEN mirror END AS index_url FROM src""")
def forms(df: DataFrame) -> DataFrame:
    v = F.col("v")
    aliased = F.create_map(F.lit("other"), F.lit("1"), F.lit("openai_send_temperature"), F.coalesce(v, F.lit("?")))
    aliased = F.when(F.col("has_new"), F.map_concat(aliased, F.create_map(F.lit("openai_send_temprature"), F.lit("new")))).otherwise(aliased)
    text = lambda m: F.array_join(F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    form = F.create_map(F.lit("a"), F.lit("1"), F.lit(" "), F.lit("x"), F.lit("__custom__"), F.lit("y"), F.lit(c.THINKING), v, F.lit(c.EFFORT), v)
    return df.select(
        "id", c.quiet_path(F.col("path"), F.array(F.lit("/progress"))).alias("quiet"), text(c.renamed_key(aliased, "openai_send_temperature", "openai_send_temprature")).alias("renamed"),
        c.widget_value(F.col("kind"), v, F.array(F.lit("high"), F.lit("max"))).alias("widget"), text(c.saved_extra(form)).alias("saved"),
        c.connection_failure(F.col("code"), F.col("status"), F.col("message")).alias("failure"), c.preferred_index(F.col("mirrors"), F.col("custom"), F.col("mirror"), "https://default/").alias("index_url"),
    )
