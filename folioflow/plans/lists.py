"""A3: listing, filtering, ranking and comparing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import lists as o

from .base import pick, query

_V = "list_transform(regexp_extract_all({c}, '[0-9]+')[1:4], lambda x: x::INT)"


def vkey(c: str) -> str:
    """SQL of a version's key."""
    v = _V.format(c=c)
    return f"CASE WHEN len(coalesce({v}, [])) > 0 THEN {v} ELSE [0] END"


_FILES = f"SELECT o_orderkey AS id, {pick('o_orderkey', ['paper', 'paperback', 'note'])} || {pick('CAST(floor(o_orderkey / 3) AS BIGINT)', ['-a.pdf', '.x.PDF', '_b.pdf', 'c.pdf', '.txt'])} AS name, o_custkey % 50 AS mtime, 'out/' || CAST(o_orderkey % 400 AS STRING) AS path FROM {{orders}}"
_EXPECTED = "SELECT CAST(l_linenumber AS INT) AS n, l_partkey AS part, 'out/' || CAST(l_orderkey % 700 AS STRING) AS path FROM {lineitem}"


@query("a3_01_listing", _FILES, "SELECT id, name, mtime FROM src WHERE ends_with(lower(name), '.pdf') AND starts_with(name, 'paper') AND substr(name, 6, 1) IN ('-','.','_')")
def listing(df: DataFrame) -> DataFrame:
    return o.listing(df, "paper").select("id", "name", "mtime")


@query("a3_02_03_present_and_missing", _EXPECTED, """
SELECT path, count(*) AS n, path IN (SELECT path FROM files) AS found FROM src GROUP BY path""", files=_FILES)
def present_and_missing(df: DataFrame, files: DataFrame) -> DataFrame:
    count = lambda rows, found: rows.groupBy("path").agg(F.count("*").alias("n")).withColumn("found", F.lit(found))
    return count(o.present(df, files), True).unionByName(count(o.missing(df, files), False))


_VERSIONS = f"SELECT DISTINCT {pick('p_partkey', ['v', '', ' '])} || CAST(p_size % 5 AS STRING) || {pick('CAST(floor(p_partkey / 3) AS BIGINT)', ['', '.1', '.0.10', '.2.3.4.5', '-beta2', 'x'])} AS version FROM {{part}}"
_NOTICES = f"SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS enabled, {pick('s_suppkey', ['', '*', 'v1.1', '2|3.0.10', 'all|9', ' '])} AS affects, {pick('s_suppkey', ['', '1', None, '2.0'])} AS min_version, {pick('s_suppkey', ['', None, '3.1', '2.2.3.4', '4'])} AS max_version FROM {{supplier}}"


@query("a3_04_notices", _NOTICES, f"""
+ n AS (SELECT *, list_filter(list_transform(string_split(affects, '|'), lambda x: regexp_replace(trim(x), '^v+', '')), lambda x: x <> '') AS a FROM src), v AS (SELECT version, regexp_replace(trim(version), '^v+', '') AS bare FROM versions)
SELECT id, version FROM v, n WHERE coalesce(enabled, true) AND (len(a) = 0 OR list_has_any(a, ['*','all']) OR list_contains(a, bare))
  AND (coalesce(min_version, '') = '' OR {vkey('bare')} >= {vkey('min_version')}) AND (coalesce(max_version, '') = '' OR {vkey('bare')} <= {vkey('max_version')})""", versions=_VERSIONS)
def notices(df: DataFrame, versions: DataFrame) -> DataFrame:
    return o.applicable(df.withColumn("affects", F.split("affects", r"\|")), versions, limited=False)


_RELEASES = f"SELECT p_partkey AS ordinal, p_brand AS source, {pick('p_partkey', ['v', ''])} || CAST(p_size % 7 AS STRING) || '.' || CAST(p_partkey % 12 AS STRING) || {pick('p_partkey', ['', '.1', '-rc'])} AS version FROM {{part}}"


@query("a3_05_07_newest_version", _RELEASES, f"""
+ k AS (SELECT *, {vkey('version')} AS k FROM src), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC, ordinal) AS n FROM k)
SELECT source, version, k AS version_key, k >= [5, 2] AS new_enough FROM r WHERE n = 1""")
def newest_version(df: DataFrame) -> DataFrame:
    v = F.col("version")
    return o.newest_version(df, "source").select("source", "version", o.version_key(v).alias("version_key"), o.meets_minimum(v, "5.2").alias("new_enough"))


_ORDINALS = f"SELECT o_orderkey AS ordinal, o_orderstatus AS grp, {pick('o_custkey', ['a', 'b', 'c', 'd', 'e', 'f', 'g'])} AS name, o_custkey % 90 AS x FROM {{orders}}"


@query("a3_08_24_distinct_in_order", _ORDINALS, """
SELECT grp, list(name ORDER BY ordinal) AS names, list(name ORDER BY ordinal)[1:1] AS first_name FROM (SELECT grp, name, min(ordinal) AS ordinal FROM src GROUP BY grp, name) GROUP BY grp""")
def distinct_in_order(df: DataFrame) -> DataFrame:
    # The distinct names of a group are few, whatever the number of rows.
    kept = df.groupBy("grp", "name").agg(F.min("ordinal").alias("ordinal"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"])
    return kept.groupBy("grp").agg(names.alias("names")).withColumn("first_name", F.slice("names", 1, 1))


_PROBES = f"SELECT s_suppkey AS ordinal, {pick('s_suppkey', ['Custom', 'Main', 'Mirror', 'Far'])} AS name, s_suppkey % 3 > 0 AS reachable, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey * 37 % 100 AS INT) END AS connect_ms, CASE WHEN s_suppkey % 7 > 0 THEN CAST(s_suppkey * 53 % 90 AS INT) END AS read_ms, {pick('s_suppkey', ['Gitee', 'github', None])} AS preferred FROM {{supplier}}"


@query("a3_09_11_usable_sources", _PROBES, """
SELECT ordinal, coalesce(connect_ms, 0) + coalesce(read_ms, 0) AS total_ms, row_number() OVER (ORDER BY name = 'Custom' DESC, CASE WHEN name = 'Custom' THEN 0 ELSE coalesce(connect_ms, 0) + coalesce(read_ms, 0) END, ordinal) AS place,
  CASE WHEN lower(coalesce(preferred, '')) = 'gitee' THEN ['gitee', 'github'] ELSE ['github', 'gitee'] END AS sources FROM src WHERE reachable""")
def usable_sources(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    custom = F.col("name") == "Custom"
    place = F.row_number().over(Window.orderBy(F.desc(custom), F.when(custom, 0).otherwise(F.col("total_ms")), "ordinal"))
    return o.usable_sources(df).select("ordinal", "total_ms", place.alias("place"), o.source_order(F.col("preferred"), ("github", "gitee")).alias("sources"))


_ATTEMPTS = f"SELECT l_orderkey AS job, min(l_partkey) AS ordinal, min(l_partkey) % 3 = 0 AS ok, 'src' || CAST(min(l_partkey) AS STRING) AS source FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber, l_partkey"


@query("a3_12_first_success", _ATTEMPTS, "SELECT job, min_by(source, ordinal) FILTER (WHERE ok) AS source, coalesce(min(ordinal) FILTER (WHERE ok), count(*)) AS tried FROM src GROUP BY job")
def first_success(df: DataFrame) -> DataFrame:
    return o.first_success(df, "job")


_TREE = "SELECT {p} || CAST({k} AS STRING) || '.py' AS path, min(CAST({h} % 3 AS STRING)) AS hash FROM {{{t}}} GROUP BY ALL"
_DIR = "CASE WHEN {k} % 20 = 0 THEN 'cache/x' WHEN {k} % 2 = 0 THEN 'a/b' ELSE 'c' END"
_SRC = _TREE.format(p=_DIR.format(k="o_orderkey"), k="o_orderkey", h="o_custkey", t="orders")
_TGT = _TREE.format(p=_DIR.format(k="event_id"), k="event_id", h="user_id", t="events")


@query("a3_13_directory_diff", _SRC, """
+ s AS (SELECT * FROM src WHERE NOT list_contains(string_split(path, '/'), 'cache')), t AS (SELECT * FROM target WHERE NOT list_contains(string_split(path, '/'), 'cache'))
SELECT coalesce(s.path, t.path) AS path, CASE WHEN t.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'preserved' WHEN s.hash = t.hash THEN 'unchanged' ELSE 'updated' END AS status FROM s FULL JOIN t ON s.path = t.path""", target=_TGT)
def directory_diff(df: DataFrame, target: DataFrame) -> DataFrame:
    return o.directory_diff(df, target, ("cache",))


_PATHS = f"SELECT p_brand AS grp, {pick('p_partkey', ['a/b/c', 'z', 'a/b', 'q/r', ''])} || '/n' || CAST(p_size AS STRING) AS path FROM {{part}}"


@query("a3_14_shallowest", _PATHS, "SELECT grp, path FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY len(string_split(path, '/')), path) AS n FROM src) WHERE n = 1")
def shallowest(df: DataFrame) -> DataFrame:
    return o.shallowest(df, "grp")


_GROUPS = f"SELECT n_nationkey AS ordinal, n_name AS name, CAST(n_nationkey * 1000 AS STRING) AS id, {pick('n_nationkey', ['full', 'open', None])} AS status FROM {{nation}}"


@query("a3_15_open_groups", _GROUPS, "SELECT ordinal, name || ' ' || id AS label FROM src WHERE coalesce(status, '') <> 'full'")
def open_groups(df: DataFrame) -> DataFrame:
    return o.open_groups(df)


_ACTIVE = "SELECT o_custkey AS task, o_orderkey AS ordinal, o_orderstatus AS status FROM {orders}"
_HISTORY = "SELECT user_id AS task, event_id AS ordinal, event_type AS status FROM {events}"


@query("a3_16_record_lookup", _ACTIVE, """
SELECT task, ordinal, status, p = 0 AS is_active FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY p, ordinal) AS n FROM (SELECT *, 0 AS p FROM src UNION ALL SELECT *, 1 FROM history)) WHERE n = 1""", history=_HISTORY)
def record_lookup(df: DataFrame, history: DataFrame) -> DataFrame:
    return o.record_of(df, history, "task")


_RESULTS = "SELECT o_custkey AS item, o_orderkey AS ordinal, CASE WHEN o_orderkey % 9 = 0 THEN 'failed ' || CAST(o_orderkey AS STRING) END AS error, o_orderstatus AS kind, o_orderkey % 4 AS leaf FROM {orders}"


@query("a3_17_19_batch_counts", _RESULTS, """
+ k AS (SELECT item, count(DISTINCT kind || '::' || leaf) AS distinct_files FROM src GROUP BY item)
SELECT s.item, count(*) FILTER (WHERE error IS NULL) AS attached, count(*) AS total, coalesce(string_agg(error, '; ' ORDER BY ordinal), '') AS errors, count(error) > 0 AS failed, any_value(distinct_files) AS distinct_files FROM src s JOIN k ON s.item = k.item GROUP BY s.item""")
def batch_counts(df: DataFrame) -> DataFrame:
    key = o.attachment_key(F.col("item").cast("string"), F.lit("svc"), F.col("kind"), F.col("leaf").cast("string"))
    files = df.withColumn("key", key).dropDuplicates(["key"]).groupBy("item").agg(F.count("*").alias("distinct_files"))
    return o.batch_counts(df, "item").join(files, "item")


_BOUNDS = ["==1.2.0", ">=1.0", "<2", "~=1.1", "", "!=1.2", ">1.3", ">=1.0,<1.3", ">=1.1, !=1.2.*, <3", "==1.*", "[gpu]>=2 ; python_version > '3'", "<=1.3.1,>1.2"]
_REQS = f"SELECT p_partkey AS id, {pick('p_partkey', ['Torch_Vision', 'numpy', 'a.b', 'none'])} || {pick('CAST(floor(p_partkey / 4) AS BIGINT)', _BOUNDS)} AS requirement FROM {{part}}"
_HAVE = "SELECT 'torch-vision' AS package, '1.2' AS version UNION ALL SELECT 'NumPy', 'v1.3.1' UNION ALL SELECT 'A_B', '2.0'"


@query("a3_20_21_requirements", _REQS, """
+ b AS (SELECT *, lower(regexp_replace(regexp_extract(requirement, '^([^=<>!~[]*)', 1), '[-_.]+', '-', 'g')) AS p, regexp_extract(requirement, '^[^=<>!~[]*(.*)$', 1) AS spec FROM src),
 h AS (SELECT 'torch-vision' AS p, 10200 AS v UNION ALL SELECT 'numpy', 10301 UNION ALL SELECT 'a-b', 20000)
SELECT id, requirement, h.v IS NOT NULL AND CASE spec WHEN '' THEN true WHEN '==1.2.0' THEN v = 10200 WHEN '>=1.0' THEN v >= 10000 WHEN '<2' THEN v < 20000 WHEN '~=1.1' THEN v >= 10100 AND v < 20000 WHEN '!=1.2' THEN v <> 10200 WHEN '>1.3' THEN v > 10300
  WHEN '>=1.0,<1.3' THEN v >= 10000 AND v < 10300 WHEN '>=1.1, !=1.2.*, <3' THEN v >= 10100 AND v // 100 <> 102 AND v < 30000 WHEN '==1.*' THEN v // 10000 = 1 WHEN '<=1.3.1,>1.2' THEN v <= 10301 AND v > 10200 ELSE v >= 20000 END AS met FROM b LEFT JOIN h ON b.p = h.p""", installed=_HAVE)
def requirements(df: DataFrame, installed: DataFrame) -> DataFrame:
    return o.satisfied(df, installed)


_JSON = [
    '["m1","models/m2","m1",""]', '{"data":[{"id":"a"},{"name":"models/b"},{"id":""}]}', '{"models":[{"model":"x"},"y"]}', '{"result":{"data":[{"model_name":"r"}]}}', '{"result":["z","z"]}', '{"other":1}',
]
_IDS = f"SELECT event_id AS id, CAST(event_id % 6 AS INT) AS k, {pick('event_id', _JSON)} AS payload FROM {{events}}"


@query("a3_22_model_ids", _IDS, "SELECT id, CASE k WHEN 0 THEN ['m1','m2'] WHEN 1 THEN ['a','b'] WHEN 2 THEN ['x','y'] WHEN 3 THEN ['r'] WHEN 4 THEN ['z'] ELSE [] END AS models FROM src")
def model_ids(df: DataFrame) -> DataFrame:
    return df.select("id", o.model_ids(F.col("payload")).alias("models"))


_OPTS = f"SELECT event_id AS id, {pick('event_id', ['b|a', 'c', 'a|d|a'])} AS saved, {pick('CAST(floor(event_id / 3) AS BIGINT)', ['z|y|a', 'old|m', ''])} AS fetched FROM {{events}}"


@query("a3_23_25_options", _OPTS, """
+ l AS (SELECT id, ['d1','a'] || string_split(saved, '|') || list_sort(string_split(fetched, '|')) AS l, string_split(saved, '|') AS s FROM src)
SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i AND x <> 'old') AS offered, list_filter(['a','b','c'], lambda x: NOT list_contains(s, x)) AS unused FROM l""")
def options(df: DataFrame) -> DataFrame:
    lit = lambda *xs: F.array(*map(F.lit, xs))
    saved = F.split("saved", r"\|")
    return df.select("id", o.offered_models(lit("d1", "a"), saved, F.split("fetched", r"\|"), lit("old")).alias("offered"), F.array_except(lit("a", "b", "c"), saved).alias("unused"))


_ENVS = f"SELECT s_suppkey AS ordinal, {pick('s_suppkey', ['env-a', 'env-b', 'env-c'])} AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'listed' ELSE 'directory' END AS kind, CASE WHEN s_suppkey % 6 = 4 THEN '/opt/x/env-b' ELSE '/envs' || CAST(s_suppkey AS STRING) END AS path, s_suppkey % 5 > 0 AS found, s_suppkey % 13 = 0 AS cached, s_suppkey % 7 = 0 AS healthy FROM {{supplier}}"


@query("a3_26_29_environments", _ENVS, """
+ n AS (SELECT name, min_by(path, r * 100000 + ordinal) AS path FROM (SELECT name, ordinal, CASE WHEN kind = 'listed' AND regexp_extract(path, '[^/]*$') = name THEN 0 WHEN kind = 'directory' THEN 1 END AS r, CASE WHEN kind = 'directory' THEN path || '/' || name ELSE path END AS path FROM src) WHERE r IS NOT NULL GROUP BY name),
 c AS (SELECT name, min_by(ordinal, r * 100000 + ordinal) AS chosen, min(r) AS r FROM (SELECT name, ordinal, CASE WHEN cached THEN 0 WHEN healthy THEN 1 WHEN found THEN 2 END AS r FROM src) WHERE r IS NOT NULL GROUP BY name)
SELECT s.name, n.path, CAST(c.chosen AS STRING) AS tool, coalesce(CASE c.r WHEN 0 THEN 'cached' WHEN 1 THEN 'use' WHEN 2 THEN 'repair' END, 'fresh') AS action FROM (SELECT DISTINCT name FROM src) s LEFT JOIN n ON s.name = n.name LEFT JOIN c ON s.name = c.name""")
def environments(df: DataFrame) -> DataFrame:
    chosen = o.chosen_environment(df.select(F.col("name").alias("engine"), F.col("ordinal").alias("preference"), F.col("ordinal").cast("string").alias("tool"), "cached", "healthy", "found"))
    return o.named_environment(df).join(chosen, F.col("name") == F.col("engine")).select("name", "path", "tool", "action")


_ENTRIES = f"SELECT s_suppkey AS ordinal, {pick('s_suppkey', ['/a/b/', '/a//b', '/c', '/', '/d/e'])} AS path, s_suppkey % 4 > 0 AS found, {pick('s_suppkey', ['all', 'engine-1', 'engine-2'])} AS choice FROM {{supplier}}"


@query("a3_27_29_paths_and_engines", _ENTRIES, """
+ p AS (SELECT ordinal, choice, CASE path WHEN '/a/b/' THEN '/a/b' WHEN '/a//b' THEN '/a/b' ELSE path END AS path FROM src WHERE found)
SELECT ordinal, path, unnest(CASE choice WHEN 'all' THEN ['engine-1','engine-2'] ELSE [choice] END) AS engine FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS n FROM p) WHERE n = 1""")
def paths_and_engines(df: DataFrame) -> DataFrame:
    return o.path_entries(df).select("ordinal", "path", F.explode(o.engines_of(F.col("choice"))).alias("engine"))
