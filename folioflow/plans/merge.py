"""A6 and A7: layered configuration and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import keyed, merge

from .base import pick, query

_DEF = "SELECT CAST(c_custkey AS STRING) AS section, 'k' || CAST(c_custkey % 2 AS STRING) AS item, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS value FROM {customer}"
_USER = "SELECT CAST(o_custkey AS STRING) AS section, 'k' || CAST(o_orderkey % 4 AS STRING) AS item, min(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END) AS value FROM {orders} GROUP BY ALL"


@query("a6_01_merge_defaults", _DEF, "SELECT coalesce(u.section, d.section) AS section, coalesce(u.item, d.item) AS item, CASE WHEN u.section IS NOT NULL THEN u.value ELSE d.value END AS value FROM src d FULL JOIN own u ON d.section = u.section AND d.item = u.item", own=_USER)
def merge_defaults(df: DataFrame, own: DataFrame) -> DataFrame:
    return merge.merged_defaults(df, own, ["section", "item"])


# Some suppliers' numbers are beyond all parts' numbers, and most parts are no supplier's.
_LIST = "SELECT {k} % 25 AS grp, 'x' || CAST({k} AS STRING) AS name, {k} AS ordinal, {v} AS value FROM {{{t}}}"
_DLIST = _LIST.format(k="s_suppkey * 30", v="s_nationkey", t="supplier")
_ULIST = _LIST.format(k="p_partkey", v="CAST(p_size AS BIGINT)", t="part")


@query("a6_02_merge_named_list", _DLIST, """
SELECT coalesce(u.grp, d.grp) AS grp, coalesce(u.name, d.name) AS name, row_number() OVER (PARTITION BY coalesce(u.grp, d.grp) ORDER BY u.ordinal NULLS LAST, d.ordinal) - 1 AS position, coalesce(u.value, d.value) AS value FROM src d FULL JOIN own u ON d.grp = u.grp AND d.name = u.name""", own=_ULIST)
def merge_named_list(df: DataFrame, own: DataFrame) -> DataFrame:
    return merge.merged_list(df, own, "grp")


_DREQ = f"SELECT DISTINCT p_brand AS grp, {pick('p_size', ['Num_Py', 'torch', 'a.b'])} || '==' || CAST(p_size % 2 AS STRING) AS requirement FROM {{part}}"
_UREQ = f"SELECT DISTINCT p_brand AS grp, {pick('p_size', ['num-py', 'own', 'A_B', 'extra'])} || '>=' || CAST(p_size % 3 AS STRING) AS requirement FROM {{part}}"


@query("a6_03_managed_requirements", _DREQ, """
+ k AS (SELECT *, lower(regexp_replace(regexp_extract(requirement, '^([^=<>]*)', 1), '[-_.]+', '-', 'g')) AS p FROM src), u AS (SELECT *, lower(regexp_replace(regexp_extract(requirement, '^([^=<>]*)', 1), '[-_.]+', '-', 'g')) AS p FROM own)
SELECT grp, requirement FROM k UNION ALL SELECT grp, requirement FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.grp = u.grp AND k.p = u.p)""", own=_UREQ)
def managed_requirements(df: DataFrame, own: DataFrame) -> DataFrame:
    return merge.merged_requirements(df, own, "grp")


@query("a6_04_changed", _DEF, "SELECT DISTINCT section FROM ((SELECT * FROM src EXCEPT ALL SELECT * FROM own) UNION ALL (SELECT * FROM own EXCEPT ALL SELECT * FROM src))", own=_USER)
def changed(df: DataFrame, own: DataFrame) -> DataFrame:
    return merge.changed(df, own, "section")


_STORED = f"SELECT s_suppkey * 20 AS svc, {pick('n', ['API_KEY', 'API_URL', 'MODEL', 'listed_1', 'extra_x', 'support_llm'])} AS key, 'old' || CAST(n AS STRING) AS value, n = 3 AS listed FROM (SELECT s_suppkey, r_regionkey AS n FROM {{supplier}} CROSS JOIN {{region}} UNION ALL SELECT s_suppkey, 5 FROM {{supplier}}) AS x"
_SENT = f"SELECT c_custkey AS svc, {pick('n', ['API_KEY', 'API_URL', 'MODEL', 'extra_x', 'extra_y'])} AS key, CASE (c_custkey + n) % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'new' || CAST(n AS STRING) END AS value, n < 3 AS base FROM (SELECT c_custkey, r_regionkey AS n FROM {{customer}} CROSS JOIN {{region}}) AS x"
_UPDATE = """
+ f AS (SELECT svc, key, value FROM sent WHERE coalesce(value, '') <> ''), o AS (SELECT svc, key, value FROM src s WHERE listed OR {keep} EXISTS (SELECT 1 FROM f WHERE f.svc = s.svc AND f.key = s.key))
SELECT coalesce(f.svc, o.svc) AS svc, coalesce(f.key, o.key) AS key, coalesce(f.value, o.value) AS value FROM o FULL JOIN f ON o.svc = f.svc AND o.key = f.key"""


_SENT_2 = f"SELECT c_custkey AS svc, {pick('n', ['API_KEY', 'API_URL', 'num_predict', 'extra_send_temprature', 'x_enable_json_mode'])} AS key, {pick('c_custkey * 5 + n', ['', None, ' OFF ', 'Yes', '007', 'often', '0', '-12 ', 'true', ' 1', 'no'])} AS value, n < 2 AS base FROM (SELECT c_custkey, r_regionkey AS n FROM {{customer}} CROSS JOIN {{region}}) AS x"
_TYPED = """typed AS (SELECT svc, key, CASE WHEN base THEN value
  WHEN regexp_matches(key, '(_send_temprature|_enable_json_mode)$') AND lower(trim(value)) IN ('true','1','yes','on') THEN 'true' WHEN regexp_matches(key, '(_send_temprature|_enable_json_mode)$') AND lower(trim(value)) IN ('false','0','no','off') THEN 'false'
  WHEN key = 'num_predict' AND regexp_matches(trim(value), '^[+-]?[0-9]+$') THEN CAST(CAST(trim(value) AS INT) AS STRING) ELSE value END AS value FROM sent)"""


@query("a6_05_update_engine_1", _STORED, _UPDATE.format(keep=""), sent=_SENT)
def update_engine_1(df: DataFrame, sent: DataFrame) -> DataFrame:
    return merge.updated_provider(df, sent, "svc", keep_blank=False)


@query("a6_06_update_engine_2", _STORED, _UPDATE.replace("FROM sent WHERE coalesce", "FROM typed WHERE coalesce").replace("+ f AS", "+ " + _TYPED + ", f AS").format(keep="key IN ('translate_engine_type','support_llm') OR EXISTS (SELECT 1 FROM sent b WHERE b.svc = s.svc AND b.key = s.key AND b.base) OR "), sent=_SENT_2)
def update_engine_2(df: DataFrame, sent: DataFrame) -> DataFrame:
    return merge.updated_provider(df, sent, "svc", keep_blank=True, typed=True)


_MISC = f"SELECT event_id AS id, CAST(event_id % 5 AS INT) AS pool, {pick('event_id', ['ModelScope', 'silicon', 'openai', 'qwen-mt'])} AS service, {pick('event_id', ['a|b', 'c', 'b|old'])} AS fresh, {pick('CAST(floor(event_id / 3) AS BIGINT)', ['b|x', 'old|y', 'c'])} AS saved, {pick('event_id', ['PythonPath', 'PATH', 'virtual_env'])} AS name, {pick('event_id', ['engine-1', 'engine-2', 'engine-3'])} AS engine, CAST(event_id % 6 AS STRING) AS version FROM {{events}}"
_ANSWERS = "SELECT '1' AS version, 'accepted' AS status UNION ALL SELECT '2', 'declined' UNION ALL SELECT '3', 'later'"


@query("a6_07_13_settings", _MISC, """
+ l AS (SELECT *, list_reverse(string_split(fresh, '|')) || string_split(saved, '|') AS l FROM src)
SELECT id, CASE WHEN pool > 0 THEN CAST(pool AS STRING) ELSE 'null' END AS pool, CASE service WHEN 'ModelScope' THEN 'modelscope' WHEN 'silicon' THEN 'siliconflow' WHEN 'qwen-mt' THEN 'qwenmt' ELSE service END AS service,
  list_filter(l, lambda x, i: list_position(l, x) = i AND x <> 'old') AS history, CASE name WHEN 'PATH' THEN ['HOME','PATH','PYTHONNOUSERSITE'] ELSE ['HOME','PYTHONNOUSERSITE'] END AS variables,
  CASE engine WHEN 'engine-1' THEN ['p==1'] WHEN 'engine-2' THEN ['q','r'] ELSE ['fallback'] END AS requirements FROM l WHERE version NOT IN ('1', '2')""", answers=_ANSWERS)
def settings(df: DataFrame, answers: DataFrame) -> DataFrame:
    env = F.create_map(F.col("name"), F.lit("x"), F.lit("HOME"), F.lit("/h"))
    spec = F.create_map(F.lit("engine-1"), F.create_map(F.lit("pip"), F.array(F.lit("p==1"))), F.lit("engine-2"), F.create_map(F.lit("pip"), F.array(F.lit("q"), F.lit("r"))))
    history = merge.without_retired(merge.history_with(F.split("fresh", r"\|"), F.split("saved", r"\|")), ["old"])
    return merge.unanswered(df, answers).select(
        "id", merge.pool_setting(F.col("pool")).alias("pool"), merge.resolved(F.col("service")).alias("service"), history.alias("history"), F.array_sort(F.map_keys(merge.isolated_environment(env))).alias("variables"),
        merge.requirements_for(spec, F.col("engine"), F.lit("pip"), F.array(F.lit("fallback"))).alias("requirements"),
    )


_LOG = f"SELECT event_id % 997 AS key, {pick('event_id % 997 + CAST(floor(event_id / 4000) AS BIGINT)', [f's{k}' for k in range(40)])} AS service, event_id AS seq, CASE event_type WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'activate' WHEN 'signup' THEN 'deactivate' WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id % 3 = 0 AS active FROM {{events}}"
_STATE = """
+ i AS (SELECT *, coalesce(sum((op = 'delete')::INT) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM src),
 u AS (SELECT *, max(CASE WHEN op = 'upsert' THEN seq END) OVER (PARTITION BY key, life ORDER BY seq) AS put FROM i),
 o AS (SELECT u.key, u.life, u.seq, u.op, p.service, CASE WHEN u.op = 'activate' OR u.op = 'upsert' AND u.active THEN true WHEN u.op IN ('deactivate','upsert') THEN false END AS sw FROM u JOIN src p ON p.key = u.key AND p.seq = u.put),
 k AS (SELECT key, life, arg_max(service, seq) AS service, min(seq) AS first_seq, bool_or(op = 'delete') AS gone, arg_max(sw, seq) FILTER (WHERE sw IS NOT NULL) AS sw, max(seq) FILTER (WHERE sw IS NOT NULL) AS sw_seq FROM o GROUP BY key, life),
 a AS (SELECT service, max(seq) AS last_on FROM o WHERE sw GROUP BY service), s AS (SELECT k.key, k.service, k.first_seq, coalesce(sw AND sw_seq = last_on, false) AS active FROM k LEFT JOIN a ON k.service = a.service WHERE NOT gone)
"""


@query("a7_01_02_entries", _LOG, _STATE + "SELECT * FROM s")
def entries(df: DataFrame) -> DataFrame:
    return keyed.entries(df)


@query("a7_03_first_active", _LOG, _STATE + "SELECT service, arg_min(key, first_seq) AS key FROM s WHERE active GROUP BY service")
def first_active(df: DataFrame) -> DataFrame:
    return keyed.first_active(keyed.entries(df))


_PREFS = f"SELECT event_id AS id, {pick('event_id', ['[{\"key\":\"k1\",\"service\":\"s\",\"model\":\"m\",\"activate\":true,\"extraData\":{\"a\":\"1\"}},{\"key\":\"\",\"service\":\"s\"}]', '[{\"key\":\"k2\",\"service\":\"t\"}]', '[]', '[{\"key\":\"k3\"}]'])} AS prefs FROM {{events}}"


@query("a7_04_load_entries", _PREFS, "SELECT id, CASE id % 4 WHEN 0 THEN 'k1' ELSE 'k2' END AS key, CASE id % 4 WHEN 0 THEN 's' ELSE 't' END AS service, CASE id % 4 WHEN 0 THEN 'm' END AS model, id % 4 = 0 AS activate, CASE id % 4 WHEN 0 THEN 1 ELSE 0 END AS extras FROM src WHERE id % 4 < 2")
def load_entries(df: DataFrame) -> DataFrame:
    rows = df.select("id", F.explode(keyed.loaded(F.col("prefs"))).alias("e"))
    return rows.select("id", "e.key", "e.service", "e.model", "e.activate", F.size("e.extraData").alias("extras"))
