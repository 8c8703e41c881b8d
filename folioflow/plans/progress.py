"""A4: progress logs, job state, polling and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import progress as p

from .base import pick, query

_MOD = [
    "\x1b[32mtranslate ━━━ ", "Translate Paragraphs (1/1) ━ ", "Parse PDF(1/1) xx ", "  10%|# | 1/9 [00:01] |", "Running page ", "nothing here", "translate ",
    "  20%|## | ", "Save PDF (2/4) . ", "parse ",
]
_TAIL = ["", "", "", " [00:02<", "", "", "", " [x", "", ""]
_LINES = f"SELECT user_id AS job, event_id AS seq, event_type, ts, value, {pick('event_id', _MOD)} || CASE WHEN event_id % 10 = 5 THEN '' ELSE CAST(event_id % 30 AS STRING) || '/' || CAST(event_id % 4 * 25 AS STRING) END || {pick('event_id', _TAIL)} AS line FROM {{events}}"
_PCT = "CASE WHEN {t} > 0 THEN CAST(trunc(CAST({c} AS DOUBLE) / {t} * 100) AS INT) END"
_N = lambda e, k: f"TRY_CAST(nullif(regexp_extract({e}, {k}), '') AS INT)"
_PARSED = r"""
+ a AS (SELECT *, regexp_replace(line, '(?:\x1B[@-_]|[\x{80}-\x{9F}])[0-?]*[ -/]*[@-~]', '', 'g') AS c FROM src),
 r AS (SELECT *, regexp_matches(c, '(?i)\btranslate\s+[^a-z()\r\n]*?([0-9]+)/([0-9]+)\b') AS is_main, regexp_matches(c, '(.+?)\([0-9]+/[0-9]+\)\s+.*?([0-9]+)/([0-9]+)') AS is_step,
   regexp_extract_all(c, '\|\s*([0-9]+)/([0-9]+)\s+\[', 0) AS bars, regexp_matches(c, '(?i)(?:translate|Running|Parse).*?([0-9]+)/([0-9]+)') AS is_old,
   TRY_CAST(regexp_extract(c, '(?i)\btranslate\s+[^a-z()\r\n]*?([0-9]+)/([0-9]+)\b', 1) AS INT) AS m, TRY_CAST(regexp_extract(c, '(?i)\btranslate\s+[^a-z()\r\n]*?([0-9]+)/([0-9]+)\b', 2) AS INT) AS mt,
   trim(regexp_extract(c, '(.+?)\([0-9]+/[0-9]+\)\s+.*?([0-9]+)/([0-9]+)', 1)) AS step,
   TRY_CAST(regexp_extract(c, '(?i)(?:translate|Running|Parse).*?([0-9]+)/([0-9]+)', 1) AS INT) AS o, TRY_CAST(regexp_extract(c, '(?i)(?:translate|Running|Parse).*?([0-9]+)/([0-9]+)', 2) AS INT) AS ot FROM a),
 b AS (SELECT *, TRY_CAST(regexp_extract(bars[-1], '\|\s*([0-9]+)/([0-9]+)\s+\[', 1) AS INT) AS b, TRY_CAST(regexp_extract(bars[-1], '\|\s*([0-9]+)/([0-9]+)\s+\[', 2) AS INT) AS bt FROM r),
 parsed AS (SELECT *, CASE WHEN is_main THEN 'main' WHEN is_step THEN 'step' WHEN len(bars) > 0 AND is_old THEN 'bar+legacy' WHEN len(bars) > 0 THEN 'bar' WHEN is_old THEN 'legacy' END AS rule,
   CASE WHEN is_main THEN MPCT WHEN is_step THEN NULL ELSE coalesce(CASE WHEN is_old THEN OPCT END, CASE WHEN len(bars) > 0 THEN BPCT END) END AS progress,
   CASE WHEN is_main THEN CASE WHEN mt > 0 THEN 'translate ' || m || '/' || mt END WHEN is_step THEN step WHEN len(bars) > 0 THEN CASE WHEN bt > 0 THEN 'translate ' || b || '/' || bt END END AS message FROM b)
""".replace("MPCT", _PCT.format(c="m", t="mt")).replace("OPCT", _PCT.format(c="o", t="ot")).replace("BPCT", _PCT.format(c="b", t="bt"))


@query("a4_01_05_parse_lines", _LINES, _PARSED + "SELECT seq, rule, progress, message FROM parsed")
def parse_lines(df: DataFrame) -> DataFrame:
    return df.select("seq", p.parsed_line(F.col("line")).alias("x")).select("seq", "x.*")


def updates(df: DataFrame) -> DataFrame:
    """Job updates: a view adds a job, a purchase completes it, an error fails it, other rows are log lines."""
    x = p.parsed_line(F.col("line"))
    ok = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return df.select("job", "seq", "ts", (F.col("event_type") == "view").alias("added"), ok.alias("ok"), x["progress"].alias("progress"), x["message"].alias("message"))


_FOLD = _PARSED + """
, u AS (SELECT job, seq, ts, event_type = 'view' AS added, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS ok, progress, message FROM parsed),
 k AS (SELECT *, max(added::INT) OVER (PARTITION BY job ORDER BY seq) AS known, max(added::INT) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known_before FROM u),
 o AS (SELECT *, max(ok::INT) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM k WHERE known_before = 1 AND ok IS NOT NULL),
 l AS (SELECT job, arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress, arg_max(message, seq) FILTER (WHERE message IS NOT NULL) AS message, max(seq) AS seq FROM k WHERE known = 1 GROUP BY job),
 c AS (SELECT job, seq, ts, ok FROM o WHERE coalesce(done, 0) = 0)
"""


def _jobs(df: DataFrame) -> DataFrame:
    u = updates(df)
    last = p.completions(u).groupBy("job").agg(F.max_by("ok", "seq").alias("ok"), F.max("ts").alias("ended"))
    jobs = p.latest(u, ["progress", "message"]).join(last, "job", "left")
    status = F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").otherwise("running")
    return jobs.select("job", F.when(F.col("ok"), 100).otherwise(F.coalesce("progress", F.lit(0))).alias("progress"), "message", status.alias("status"), "ended", "seq")


@query("a4_08_10_latest_jobs", _LINES, _FOLD + """
SELECT l.job, CASE WHEN d.ok THEN 100 ELSE coalesce(l.progress, 0) END AS progress, l.message, CASE WHEN d.ok THEN 'done' WHEN NOT d.ok THEN 'failed' ELSE 'running' END AS status, d.ended, l.seq
FROM l LEFT JOIN (SELECT job, arg_max(ok, seq) AS ok, max(ts) AS ended FROM c GROUP BY job) d ON l.job = d.job ORDER BY l.seq DESC LIMIT 200""")
def latest_jobs(df: DataFrame) -> DataFrame:
    return p.newest(_jobs(df), "seq")


@query("a4_09_10_12_history", _LINES, _FOLD + "SELECT job, seq, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status FROM c ORDER BY seq DESC LIMIT 200")
def history(df: DataFrame) -> DataFrame:
    done = p.completions(updates(df))
    return p.newest(done.select("job", "seq", F.when(F.col("ok"), "success").otherwise("failed").alias("status")), "seq")


@query("a4_11_listed_jobs", _LINES, _FOLD + """
SELECT l.job FROM l LEFT JOIN (SELECT job, max(ts) AS ended FROM c GROUP BY job) d ON l.job = d.job WHERE ended IS NULL OR ended > (SELECT min(e) + (max(e) - min(e)) / 2 FROM (SELECT max(ts) AS e FROM c GROUP BY job)) - INTERVAL 30 SECOND""")
def listed_jobs(df: DataFrame) -> DataFrame:
    jobs = _jobs(df)
    clock = jobs.agg((F.min("ended") + (F.max("ended") - F.min("ended")) / 2).alias("_now"))  # one row: half of the way
    return p.still_listed(jobs.crossJoin(F.broadcast(clock)), F.col("_now")).select("job")


_POLLS = f"SELECT user_id AS job, event_id AS seq, event_id % 240 AS ts, event_id % 7 <> 0 AS right_id, event_id % 3 = 0 AS finished, {pick('CAST(floor(event_id / 200) AS BIGINT)', ['done', '', 'failed', 'success', 'running', '完成', '失败'])} AS status, {pick('event_id', [None, None, 'success', None, 'error'])} AS nested, CAST(event_id % 4 AS INT) AS files FROM {{events}}"
_VERDICT = """w AS (SELECT *, coalesce(nullif(status, ''), nested, '') AS w FROM src), v AS (SELECT *, CASE WHEN NOT right_id THEN 'pending' WHEN w IN ('failed','失败') OR coalesce(nested = 'error', false) OR finished AND w NOT IN ('done','success','完成') THEN 'error'
  WHEN (finished OR w IN ('done','success','完成') OR coalesce(nested = 'success', false)) THEN CASE WHEN files > 0 THEN 'success' ELSE 'no-files' END ELSE 'pending' END AS verdict FROM w)"""


def _verdicts(df: DataFrame) -> DataFrame:
    task = F.when(F.col("right_id"), "t")
    return df.withColumn("verdict", p.poll_verdict(F.lit("t"), task, F.col("finished"), F.col("status"), F.col("nested"), F.col("files")))


@query("a4_14_15_poll_verdicts", _POLLS, f"+ {_VERDICT} SELECT seq, verdict FROM v")
def poll_verdicts(df: DataFrame) -> DataFrame:
    return _verdicts(df).select("seq", "verdict")


_WAITS = "SELECT user_id AS job, event_id AS ts, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'no-files' ELSE 'pending' END AS verdict FROM {events}"


@query("a4_16_grace", _WAITS, """
+ r AS (SELECT *, sum((verdict <> 'no-files')::INT) OVER (PARTITION BY job ORDER BY ts) AS run FROM src), h AS (SELECT *, min(ts) OVER (PARTITION BY job, run) AS since FROM r WHERE verdict = 'no-files')
SELECT job, min(ts) AS gave_up FROM h WHERE ts - since >= 20 GROUP BY job""")
def grace(df: DataFrame) -> DataFrame:
    return p.grace_over(df)


_BATCH = f"SELECT user_id AS batch, event_id AS seq, CAST(event_id % 5 + 1 AS INT) AS file, CAST(5 AS INT) AS total, {pick('CAST(floor(event_id / 3) AS BIGINT)', ['submitting', 'accepted', 'running', 'importing', 'file-done', 'file-failed', 'running'])} AS phase, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value - 100 END AS percent FROM {{events}}"
_FRACTION = "CASE phase WHEN 'submitting' THEN 0.05::DOUBLE WHEN 'accepted' THEN 0.12::DOUBLE WHEN 'running' THEN 0.12::DOUBLE + least(greatest(coalesce(percent, 0), 0), 100) / 100.0::DOUBLE * 0.73::DOUBLE WHEN 'importing' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END"


@query("a4_17_19_batches", _BATCH, f"""
+ f AS (SELECT *, {_FRACTION} AS f, phase IN ('file-done','file-failed') AS o FROM src),
 e AS (SELECT *, sum(o::INT) OVER (PARTITION BY batch, file ORDER BY seq) AS ended FROM f), d AS (SELECT *, sum((o AND ended = 1)::INT) OVER (PARTITION BY batch ORDER BY seq) AS done FROM e)
SELECT batch, seq, CAST(floor((file - 1 + f) / total * 100 + 0.5::DOUBLE) AS INT) AS percent_done,
  least(99, CAST(floor((least(done, total) + CASE WHEN ended > 0 THEN 0.0::DOUBLE ELSE CAST(floor(f / 1 * 100 + 0.5::DOUBLE) AS INT) / 100.0::DOUBLE END) / total * 100 + 0.5::DOUBLE) AS INT)) AS overall,
  CASE WHEN seq % 3 = 0 THEN 'success' WHEN seq % 6 >= 5 THEN 'failed' ELSE 'mixed' END AS verdict FROM d""")
def batches(df: DataFrame) -> DataFrame:
    failed = F.when(F.col("seq") % 3 == 0, 0).otherwise((F.col("seq") % 6).cast("int"))
    rows = p.batch_percent(df)
    return rows.select("batch", "seq", p.phase_percent(F.col("phase"), F.col("percent"), F.col("file"), F.col("total")).alias("percent_done"), "overall", p.batch_verdict(failed, F.col("total")).alias("verdict"))


_MILES = "SELECT user_id AS job, event_id AS seq, value / 2 - 20 AS progress FROM {events}"


@query("a4_20_milestones", _MILES, """
+ a AS (SELECT *, least(progress, 95) AS p FROM src), b AS (SELECT *, min(CASE WHEN p >= 25 THEN seq END) OVER (PARTITION BY job) AS t1 FROM a), c AS (SELECT *, min(CASE WHEN p >= 50 AND seq > t1 THEN seq END) OVER (PARTITION BY job) AS t2 FROM b),
 d AS (SELECT *, min(CASE WHEN p >= 75 AND seq > t2 THEN seq END) OVER (PARTITION BY job) AS t3 FROM c), e AS (SELECT *, min(CASE WHEN p >= 90 AND seq > t3 THEN seq END) OVER (PARTITION BY job) AS t4 FROM d)
SELECT job, seq, CASE seq WHEN t1 THEN 25 WHEN t2 THEN 50 WHEN t3 THEN 75 ELSE 90 END AS milestone FROM e WHERE seq IN (t1, t2, t3, t4)""")
def milestones(df: DataFrame) -> DataFrame:
    return p.milestones(df)


_HELPER = f"SELECT user_id AS job, event_id AS seq, event_id % 3 * 5 AS pages, CASE WHEN event_id % 9 = 0 THEN 'Page ' || CAST(event_id % 7 AS STRING) || ' of 9' WHEN event_id % 9 = 1 THEN 'at ' || CAST(event_id % 101 AS STRING) || '.5 % now' WHEN event_id % 9 = 2 THEN 'page: ' || CAST(event_id % 60 AS STRING) WHEN event_id % 9 < 6 THEN 'Translating on' WHEN event_id % 9 = 6 THEN 'now 处理 it' ELSE 'silent' END AS line FROM {{events}}"


@query("a4_21_helper_progress", _HELPER, """
+ x AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)page') THEN CASE WHEN pages > 0 THEN CAST(regexp_extract(line, '(?i)page:? ([0-9]+)', 1) AS DOUBLE) / pages * 100 ELSE least(CAST(regexp_extract(line, '(?i)page:? ([0-9]+)', 1) AS DOUBLE) * 2, 90) END
  WHEN contains(line, '%') THEN CAST(regexp_extract(line, '([0-9.]+) %', 1) AS DOUBLE) END AS said, (line = 'Translating on' OR contains(line, '处理'))::INT AS creeps FROM src),
 r AS (SELECT *, count(said) OVER (PARTITION BY job ORDER BY seq) AS run FROM x),
 n AS (SELECT *, coalesce(first_value(said) OVER w, 0) AS base, sum(CASE WHEN said IS NULL THEN creeps ELSE 0 END) OVER w AS crept FROM r WINDOW w AS (PARTITION BY job, run ORDER BY seq))
SELECT job, seq, said, base + least(crept, greatest(ceil((80 - base) / 0.5::DOUBLE), 0)) * 0.5::DOUBLE AS progress FROM n""")
def helper(df: DataFrame) -> DataFrame:
    said, creeps = p.helper_progress(F.col("line"), F.col("pages"))
    return p.creeping(df.select("job", "seq", said.alias("said"), creeps.alias("creeps"))).select("job", "seq", "said", "progress")


_CONSOLE = "SELECT job, tick, tick * 7 % 50 AS cursor, row, max(curr) AS curr, max(total) AS total FROM (SELECT user_id % 40 AS job, CAST(floor(event_id / 600) AS BIGINT) AS tick, event_id % 37 AS row, event_id % 23 AS curr, CASE WHEN event_id % 6 = 0 THEN 9 WHEN event_id % 11 = 0 THEN 0 ELSE 20 END AS total FROM {events}) AS e GROUP BY job, tick, row"


@query("a4_07_console", _CONSOLE, """
+ s AS (SELECT * FROM src WHERE total > 0), f AS (SELECT job, arg_min(total, tick * 1000 - total) AS locked FROM s GROUP BY job),
 k AS (SELECT job, tick, dense_rank() OVER (PARTITION BY job ORDER BY tick) AS n, cursor, row, curr, total FROM s JOIN f USING (job) WHERE total = locked),
 w AS (WITH RECURSIVE st AS (
   SELECT job, n, tick, row AS place, curr AS most, curr, true AS told, total FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY abs(row - cursor), -row, -curr) AS o FROM k WHERE n = 1) AS x WHERE o = 1
   UNION ALL
   SELECT job, n, tick, CASE WHEN curr >= most THEN row ELSE place END, greatest(curr, most), curr, curr > most, total FROM (
     SELECT k.job, k.n, k.tick, k.row, k.curr, k.total, st.place, st.most, row_number() OVER (PARTITION BY k.job ORDER BY abs(k.row - st.place), abs(k.row - k.cursor), -k.row) AS o FROM st JOIN k ON k.job = st.job AND k.n = st.n + 1) AS y WHERE o = 1)
  SELECT * FROM st)
SELECT job, tick, curr, CASE WHEN curr >= total THEN 99 ELSE CAST(trunc(curr::DOUBLE / total * 100) AS INT) END AS percent FROM w WHERE told""")
def console(df: DataFrame) -> DataFrame:
    return p.console_progress(df)
