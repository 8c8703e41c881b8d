"""A1: names, paths, URLs and display text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import names as n

from .base import pick, query

_SUFFIXES = [
    ".pdf", "-mono.pdf", "-dual.pdf", ".mono.pdf", ".zh.dual.pdf", "-mono-cut.pdf", ".dual-cut.pdf", "-cut.pdf", "-compare.pdf",
    ".crop-compare.pdf", ".LR_dual.pdf", ".TB_dual.pdf", "-dual.pdf.compare.pdf", "-mono.pdf-cut.pdf", ".PDF", "",
]
_NAMES = f"SELECT doc_id AS id, {pick('doc_id', ['', 'in/', 'a.b/c/'])} || 'paper' || CAST(doc_id AS STRING) || {pick('doc_id', _SUFFIXES)} AS name, {pick('doc_id', ['LR', 'tb', None, '', 'x'])} AS fallback, CAST(1 + doc_id % 2 AS INT) AS engine, {pick('doc_id', ['mono', 'dual-cut', 'origin-cut', 'crop-compare', 'compare', 'mono-cut', 'dual'])} AS out_type FROM {{documents}}"
_TYPE = "CASE WHEN contains(b,'crop-compare.pdf') THEN 'crop-compare' WHEN contains(b,'dual-cut.pdf') THEN 'dual-cut' WHEN contains(b,'mono-cut.pdf') THEN 'mono-cut' WHEN contains(b,'compare.pdf') THEN 'compare' WHEN contains(b,'dual.pdf') THEN 'dual' WHEN contains(b,'mono.pdf') THEN 'mono' WHEN contains(b,'cut.pdf') THEN 'origin-cut' ELSE 'origin' END"
_CLIENT = "CASE WHEN contains(name,'mono.pdf') THEN 'mono' WHEN contains(name,'dual.pdf') THEN 'dual' WHEN contains(name,'mono-cut.pdf') THEN 'mono-cut' WHEN contains(name,'dual-cut.pdf') THEN 'dual-cut' WHEN contains(name,'crop-compare.pdf') THEN 'crop-compare' WHEN contains(name,'compare.pdf') THEN 'compare' WHEN contains(name,'cut.pdf') THEN 'origin-cut' ELSE 'origin' END"
_TYPED = f"+ b AS (SELECT *, regexp_extract(name, '[^/]*$') AS b FROM src), t AS (SELECT *, {_TYPE} AS kind FROM b)"


@query("a1_01_04_file_types", _NAMES, _TYPED + """
SELECT id, kind AS server_type,
  CASE WHEN contains(name,'mono.pdf') THEN 'mono' WHEN contains(name,'dual.pdf') THEN 'dual' WHEN contains(name,'mono-cut.pdf') THEN 'mono-cut' WHEN contains(name,'dual-cut.pdf') THEN 'dual-cut' WHEN contains(name,'crop-compare.pdf') THEN 'crop-compare' WHEN contains(name,'compare.pdf') THEN 'compare' WHEN contains(name,'cut.pdf') THEN 'origin-cut' ELSE 'origin' END AS client_type,
  CASE kind WHEN 'origin' THEN 'origin-cut' WHEN 'mono' THEN 'mono-cut' WHEN 'dual' THEN 'dual-cut' ELSE 'unknown' END AS after_crop,
  CASE WHEN kind IN ('origin','dual','dual-cut') THEN 'crop-compare' ELSE 'unknown' END AS after_crop_compare,
  CASE WHEN kind IN ('origin','dual') THEN 'compare' ELSE 'unknown' END AS after_compare FROM t""")
def file_types(df: DataFrame) -> DataFrame:
    name = F.col("name")
    return df.select("id", n.server_type(name).alias("server_type"), n.client_type(name).alias("client_type"), n.after(name, n.AFTER_CROP).alias("after_crop"), n.after(name, n.AFTER_CROP_COMPARE).alias("after_crop_compare"), n.after(name, n.AFTER_COMPARE).alias("after_compare"))


@query("a1_02_type_divergence", _NAMES, _TYPED + f""", c AS (SELECT kind AS server_type, {_CLIENT} AS client_type FROM t)
SELECT server_type, client_type, count(*) AS n FROM c WHERE server_type <> client_type GROUP BY ALL""")
def type_divergence(df: DataFrame) -> DataFrame:
    both = df.select(n.server_type(F.col("name")).alias("server_type"), n.client_type(F.col("name")).alias("client_type"))
    return both.where("server_type <> client_type").groupBy("server_type", "client_type").agg(F.count("*").alias("n"))


_OPS = f"SELECT event_id AS id, {pick('event_id', ['translate', 'crop', 'compare', 'crop-compare', 'other'])} AS op, {pick('CAST(floor(event_id / 5) AS BIGINT)', ['origin', 'mono', 'dual', 'mono-cut', 'dual-cut', 'origin-cut', 'compare', 'crop-compare', 'unknown'])} AS kind FROM {{events}}"


@query("a1_05_06_operation_rules", _OPS, """
SELECT id, CASE WHEN op = 'crop-compare' AND kind = 'crop-compare' OR op = 'compare' AND kind = 'compare' THEN 'operation-error-' || op || '-terminal'
  WHEN op = 'other' OR op = 'translate' AND kind = 'origin' OR op = 'crop' AND kind IN ('origin','mono','dual') OR op = 'compare' AND kind IN ('origin','dual') OR op = 'crop-compare' AND kind IN ('origin','dual','dual-cut') THEN NULL ELSE 'operation-error-' || op END AS error,
  CASE WHEN op IN ('crop-compare','compare') AND kind = op THEN 409 WHEN op = 'compare' AND kind IN ('origin','dual') OR op = 'crop-compare' AND kind IN ('origin','dual','dual-cut') THEN 200 ELSE 400 END AS status FROM src""")
def operation_rules(df: DataFrame) -> DataFrame:
    return df.select("id", n.operation_error(F.col("op"), F.col("kind")).alias("error"), n.operation_status(F.col("op"), F.col("kind")).alias("status"))


@query("a1_07_08_24_25_derived_names", _NAMES, _TYPED + """
, e AS (SELECT *, CASE WHEN engine = 2 THEN '.' ELSE '-' END AS j, ends_with(name,'.LR_dual.pdf') OR ends_with(name,'.TB_dual.pdf') AS lay FROM t)
SELECT id,
  CASE WHEN kind = 'dual' AND lay THEN left(name, length(name) - 12) || j || out_type || '.pdf'
    WHEN kind = 'origin' THEN replace(name, '.pdf', j || CASE WHEN out_type = 'origin-cut' THEN 'cut.pdf' ELSE out_type || '.pdf' END)
    ELSE replace(name, kind || '.pdf', out_type || '.pdf') END AS product,
  CASE WHEN ends_with(b,'.LR_dual.pdf') THEN 'LR' WHEN ends_with(b,'.TB_dual.pdf') THEN 'TB' WHEN upper(fallback) IN ('LR','TB') THEN upper(fallback) ELSE 'TB' END AS layout,
  CASE WHEN lay OR ends_with(name,'.dual.pdf') THEN regexp_replace(name, '\\.(LR_dual|TB_dual|dual)\\.pdf$', '') ELSE regexp_replace(name, '([^/.])\\.[^./]*$', '\\1') END || '.LR_dual.pdf' AS lr_name,
  CASE WHEN lay THEN left(name, length(name) - 12) WHEN ends_with(name,'.dual.pdf') THEN left(name, length(name) - 9) WHEN ends_with(name,'.pdf') THEN left(name, length(name) - 4) ELSE name END
    || CASE WHEN upper(fallback) = 'LR' THEN '.LR_dual.pdf' ELSE '.TB_dual.pdf' END AS canonical FROM e""")
def derived_names(df: DataFrame) -> DataFrame:
    name, mode = F.col("name"), F.col("fallback")
    return df.select("id", n.derived_name(name, F.col("out_type"), F.col("engine")).alias("product"), n.layout_mode(name, mode).alias("layout"), n.layout_variants(name)["lr"].alias("lr_name"), n.canonical_dual(name, mode).alias("canonical"))


_LOGS = ["Traceback (most recent call last):\n  File x\nKeyError: 1  \nFile y\n\n", "File a\nTraceback b", "plain\r\n    indented \t\nTraceback", "Traceback: a\n  at b\nValueError: first\nValueError: second part\n   goes on\n\tand on\nend", "Error: x\nno", "  \n", "just one line", "ValueError: alone", "TypeError: y\nException: z\n"]
_TEXT = f"SELECT doc_id AS id, coalesce(text, '') AS text, CAST(n_chars % 101 AS INT) AS percent, CAST(n_chars AS DOUBLE) / 7 AS seconds, {pick('doc_id', _LOGS)} AS log FROM {{documents}}"


@query("a1_09_26_30_33_36_text", _TEXT, """
+ c AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, CAST(floor(percent / 100 * 10) AS INT) AS f, CAST(floor(seconds) AS BIGINT) AS w,
  regexp_extract_all(log, '(?m)^ValueError:[ \\t]*(.*(?:\\n(?:[ \\t]|\\^).*)*)', 1) AS v FROM src)
SELECT id, CASE WHEN length(t) <= 80 THEN t ELSE left(t, 77) || '...' END AS short, '[' || repeat('█', f) || repeat('░', 10 - f) || ']' AS bar,
  CASE WHEN seconds >= 60 THEN CAST(w // 60 AS STRING) || '分' || CAST(w % 60 AS STRING) || '秒' ELSE CAST(w AS STRING) || '秒' END AS took,
  list_filter(string_split(log, chr(10)), lambda x: regexp_matches(x, '错误|Error|Exception'))[1] AS error_line,
  CASE WHEN len(v) > 0 THEN array_to_string(list_filter(list_transform(string_split(v[-1], chr(10)), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> ''), ' ') END AS value_error,
  coalesce(CASE WHEN len(v) > 0 THEN array_to_string(list_filter(list_transform(string_split(v[-1], chr(10)), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> ''), ' ') END,
    list_filter(list_transform(string_split(replace(log, chr(13), ''), chr(10)), lambda x: rtrim(x, chr(32) || chr(9))), lambda x: x <> '' AND NOT starts_with(x, 'Traceback') AND NOT starts_with(x, 'File '))[-1], 'RuntimeError') AS summary FROM c""")
def text_rules(df: DataFrame) -> DataFrame:
    log = F.col("log")
    return df.select("id", n.short_error(F.col("text")).alias("short"), n.progress_bar(F.col("percent")).alias("bar"), n.duration_text(F.col("seconds")).alias("took"), n.first_error_line(log).alias("error_line"), n.value_error(log).alias("value_error"), n.error_summary(log, F.lit("RuntimeError")).alias("summary"))


_ARGS = [f"--service|openai|--api-key|s{k}cret|--qps|{k}|--token=abc|-o|out" if k % 2 else f"--qps|--qps|{k}|--lang=zh|--lang|--lang|x|--verbose" for k in range(6)]
_PAIRS = f"SELECT event_id AS id, {pick('event_id', ['apiKey', 'model', 'TOKEN', ' ', 'my_password', 'author', 'temp'])} AS k, {pick('event_id', ['', 'abcd', 'abcdefgh', 'a longer value here', None])} AS v, {pick('event_id', _ARGS)} AS args, value, event_type FROM {{events}}"


@query("a1_10_12_29_masking_and_options", _PAIRS, """
+ a AS (SELECT *, string_split(args, '|') AS x FROM src), i AS (SELECT *, [['model', event_type], ['a', coalesce(v, '')], [' ', 'x'], ['value', CAST(CAST(floor(value) AS INT) AS STRING) || '0123456789'], ['zzzz', 'tail of it']] AS m FROM a),
 s AS (SELECT *, array_to_string(list_transform(list_filter(list_sort(m), lambda e: trim(e[1]) <> ''), lambda e: e[1] || '=' || CASE WHEN length(e[2]) > 10 THEN left(e[2], 10) || '...' ELSE e[2] END), ', ') AS p FROM i)
SELECT id, CASE WHEN regexp_matches(k, '(?i)key|token|secret|password|auth') THEN CASE WHEN length(v) > 4 THEN '********' || right(v, 4) ELSE repeat('*', length(v)) END ELSE v END AS hidden,
  list_transform(x, lambda e, j: CASE WHEN j > 1 AND regexp_matches(x[j-1], '(?i)key|token|secret|password') THEN '***' ELSE e END) AS safe_args,
  list_filter(list_transform(x, lambda e, j: CASE WHEN e = '--qps' AND j < len(x) THEN x[j+1] WHEN starts_with(e, '--qps=') THEN substr(e, 7) END), lambda e: e IS NOT NULL)[1] AS qps,
  list_transform(list_filter(range(1, len(x) + 1), lambda j: NOT coalesce(CASE WHEN x[1] = '--qps' THEN j < 3 OR x[3] = '--qps' AND j IN (3, 4) ELSE x[j] = '--qps' OR starts_with(x[j], '--qps=') OR j > 1 AND x[j-1] = '--qps' END, false)), lambda j: x[j]) AS rest,
  CASE WHEN length(p) > 50 THEN left(p, 47) || '...' ELSE p END AS shown FROM s""")
def masking(df: DataFrame) -> DataFrame:
    args = F.split("args", r"\|")
    m = F.create_map(F.lit("model"), F.col("event_type"), F.lit("a"), F.coalesce("v", F.lit("")), F.lit(" "), F.lit("x"), F.lit("value"), F.concat(F.floor("value").cast("int").cast("string"), F.lit("0123456789")), F.lit("zzzz"), F.lit("tail of it"))
    return df.select("id", n.masked(F.col("k"), F.col("v")).alias("hidden"), n.masked_arguments(args).alias("safe_args"), n.option_value(args, "--qps").alias("qps"), n.without_option(args, "--qps").alias("rest"), n.shown_map(m).alias("shown"))


_UPLOADS = ["a.pdf", " b.PDF ", "", None, "..", "x/y.pdf", "x\\y.pdf", "doc.txt", "C:\\dir\\ z.pdf", "dir/", "q.pdf.pdf", "/srv/out/../x.pdf", "/srv/out/r.pdf", "/srv/outer/r.pdf", ".pdf"]
_UP = f"SELECT doc_id AS id, {pick('doc_id', _UPLOADS)} AS name FROM {{documents}}"


@query("a1_13_16_upload_names", _UP, r"""
+ t AS (SELECT *, trim(coalesce(name, '')) AS n, coalesce(nullif(trim(regexp_replace(name, '^.*[/\\]', '')), ''), 'translated.pdf') AS leaf FROM src)
SELECT id, CASE WHEN n = '' THEN 'empty' WHEN n IN ('.', '..') THEN 'dots' WHEN contains(n, '/') OR contains(n, chr(92)) THEN 'separator' WHEN NOT ends_with(lower(n), '.pdf') THEN 'extension' END AS refused,
  leaf, coalesce(nullif(regexp_replace(leaf, '(?i)\.pdf$', ''), ''), leaf) AS base,
  starts_with(coalesce(name, ''), '/srv/out/') AND NOT regexp_matches(coalesce(name, ''), '(^|/)\.\.(/|$)') AS inside FROM t""")
def upload_names(df: DataFrame) -> DataFrame:
    name = F.col("name")
    return df.select("id", n.upload_error(name).alias("refused"), n.leaf(name).alias("leaf"), n.base_name(name).alias("base"), n.inside(F.lit("/srv/out/"), F.coalesce(name, F.lit(""))).alias("inside"))


_URLS = f"SELECT page_id AS id, ' ' || url || {pick('page_id', ['', '/', '//', '!~*()x', '+a b', '%2F'])} AS url, {pick('page_id', ['Torch_Vision==1.2', 'a.-_b[extra]>=2', ' numpy ', 'X~=1', 'p @ file'])} AS req, {pick('page_id', ['http://u:p@Host.io:80/x', 'socks5://h', 'nothing', 'https://me@h.com/?q', ''])} AS proxy FROM {{pages}}"


@query("a1_18_23_urls_and_packages", _URLS, r"""
SELECT id, regexp_replace(trim(url), '/+$', '') AS trimmed,
  replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')') AS encoded,
  url_decode(url_encode(url)) AS round_trip,
  lower(regexp_replace(regexp_extract(trim(req), '^([^\s<>=!~\[@]*)', 1), '[-_.]+', '-', 'g')) AS package, lower(translate(split_part(req, '=', 1), '_.', '--')) AS package_compat,
  CASE proxy WHEN 'http://u:p@Host.io:80/x' THEN 'http://host.io:80' WHEN 'socks5://h' THEN 'socks5://h' WHEN 'https://me@h.com/?q' THEN 'https://h.com' ELSE '<configured>' END AS proxy FROM src""")
def urls(df: DataFrame) -> DataFrame:
    url, req = F.col("url"), F.col("req")
    encoded = n.percent_encoded(url)
    return df.select("id", n.trimmed_url(url).alias("trimmed"), encoded.alias("encoded"), n.percent_decoded(encoded).alias("round_trip"), n.package_name(req).alias("package"), n.package_name_compat(req).alias("package_compat"), n.shown_proxy(F.col("proxy")).alias("proxy"))


_JOBS = f"SELECT o_orderkey AS id, 'in/p' || CAST(o_orderkey AS STRING) || '.pdf' AS name, CAST(1 + o_orderkey % 2 AS INT) AS engine, o_orderkey % 3 = 0 AS a, o_orderkey % 5 = 0 AS b, o_orderkey % 7 = 0 AS c, CAST(o_orderkey % 11 AS INT) AS qps, CAST(o_orderkey % 4 AS INT) AS skip, {pick('o_orderkey', ['zh', 'en', 'de-DE'])} AS lang, {pick('o_orderkey', ['bing', 'google', 'siliconflowfree', 'openai'])} AS service, {pick('CAST(floor(o_orderkey / 4) AS BIGINT)', ['', None, 'm-1'])} AS model, {pick('o_orderkey', ['Short', '', None])} AS short FROM {{orders}}"


@query("a1_27_28_31_34_35_jobs", _JOBS, """
SELECT id, CASE WHEN engine = 1 THEN CASE WHEN a THEN ['p'||id||'.'||lang||'.mono.pdf', 'p'||id||'.'||lang||'.dual.pdf'] ELSE ['p'||id||'-mono.pdf', 'p'||id||'-dual.pdf'] END
  ELSE list_filter([CASE WHEN NOT b THEN 'p'||id||CASE WHEN a THEN '.no_watermark.' ELSE '.' END||lang||'.mono.pdf' END, CASE WHEN NOT c THEN 'p'||id||CASE WHEN a THEN '.no_watermark.' ELSE '.' END||lang||'.dual.pdf' END], lambda x: x IS NOT NULL) END AS outputs,
  ['engine', name, '--' || service, '--qps', CAST(qps AS STRING), '--lang-out', lang] || ['--watermark-output-mode', CASE WHEN a THEN 'no_watermark' ELSE 'watermarked' END] || CASE WHEN skip > 0 THEN ['--pages', '1-' || CAST(20 - skip AS STRING)] ELSE [] END || CASE WHEN c THEN ['--no-dual'] ELSE [] END || CASE WHEN b THEN ['--no-mono'] ELSE [] END AS args,
  concat_ws('-', nullif(short, ''), service, 'mono') AS title,
  coalesce(nullif(model, ''), CASE service WHEN 'bing' THEN 'Bing' WHEN 'google' THEN 'Google' WHEN 'siliconflowfree' THEN 'siliconflowfree (free)' END, service || ' (default)') AS label,
  list_filter([CASE WHEN a THEN 'mono' END, CASE WHEN b THEN 'dual' END, CASE WHEN c THEN 'compare' END], lambda x: x IS NOT NULL) AS output_types FROM src""")
def jobs(df: DataFrame) -> DataFrame:
    c = {k: F.col(k) for k in df.columns}
    fixed = [F.lit("engine"), c["name"], F.concat(F.lit("--"), c["service"]), F.lit("--qps"), c["qps"].cast("string"), F.lit("--lang-out"), c["lang"], F.lit("--watermark-output-mode"), F.when(c["a"], "no_watermark").otherwise("watermarked")]
    options = [(c["skip"] > 0, [F.lit("--pages"), F.concat(F.lit("1-"), (20 - c["skip"]).cast("string"))]), (c["c"], [F.lit("--no-dual")]), (c["b"], [F.lit("--no-mono")])]
    return df.select("id", n.expected_outputs(c["name"], c["lang"], c["engine"], c["a"], c["b"], c["c"]).alias("outputs"), n.arguments(fixed, options).alias("args"), n.attachment_title(c["short"], c["service"], F.lit("mono"), c["name"]).alias("title"), n.model_label(c["model"], c["service"]).alias("label"), n.chosen_outputs({"mono": c["a"], "dual": c["b"], "compare": c["c"]}).alias("output_types"))


_SERVICES = f"SELECT s_suppkey AS id, {pick('s_suppkey', ['deepseek', 'openai', 'gemini', 'ollama', 'other', 'custom', 'silicon', 'zhipu', 'openailiked', 'xinference', 'tencent'])} AS service, {pick('CAST(floor(s_suppkey / 6) AS BIGINT)', ['https://x.io/v1/', '', None, 'https://y/models'])} AS base, {pick('CAST(floor(s_suppkey / 2) AS BIGINT)', ['k 1', '', 'abc'])} AS api_key, {pick('s_suppkey', ['GitHub', 'Bilibili fan', 'Sponsor'])} AS msg, s_name FROM {{supplier}}"


@query("a1_32_37_38_services", _SERVICES, f"""
+ u AS (SELECT *, nullif(regexp_replace(trim(coalesce(nullif(base, ''), CASE service WHEN 'silicon' THEN 'https://api.siliconflow.cn/v1' WHEN 'zhipu' THEN 'https://api.zhipu.com/v1' WHEN 'openailiked' THEN 'https://ark.cn-beijing.volces.com/api/v3' WHEN 'xinference' THEN 'http://127.0.0.1:9997' WHEN 'tencent' THEN 'https://tencent.com' END)), '/+$', ''), '') AS u, coalesce(api_key, '') <> '' AS k FROM src),
 t AS (SELECT *, CASE WHEN service IN ('deepseek','openai','gemini') AND NOT k THEN NULL WHEN service = 'deepseek' THEN 'https://api.deepseek.com/models' WHEN service = 'openai' THEN coalesce(u, 'https://api.openai.com/v1') || '/models'
  WHEN service = 'gemini' THEN coalesce(u, 'https://generativelanguage.googleapis.com/v1beta') || '/models?key=' || url_encode(api_key) WHEN service = 'ollama' THEN coalesce(u, 'http://localhost:11434') || '/api/tags' WHEN ends_with(u, '/models') THEN u ELSE u || '/models' END AS url FROM u)
SELECT id, url, CASE WHEN url IS NOT NULL THEN CASE WHEN service IN ('gemini','ollama') OR NOT k THEN 'none' ELSE 'bearer' END END AS auth,
  'https://img.shields.io/static/v1?label=' || url_encode(s_name) || '&message=' || url_encode(msg) || '&color=' || CASE WHEN contains(msg, 'GitHub') THEN '2d5a27&logo=github' WHEN contains(msg, 'Bilibili') THEN 'fb7299&logo=bilibili' ELSE '4c1' END AS badge,
  CASE service WHEN 'openai' THEN 'Open AI' ELSE service END AS text FROM t""")
def services(df: DataFrame) -> DataFrame:
    request = n.model_list_request(F.col("service"), F.col("base"), F.col("api_key"))
    texts = F.create_map(F.lit("app-openai"), F.lit("Open AI"))
    return df.select("id", request["url"].alias("url"), request["auth"].alias("auth"), n.badge_url(F.col("s_name"), F.col("msg")).alias("badge"), n.localised(texts, "app-", F.col("service")).alias("text"))

