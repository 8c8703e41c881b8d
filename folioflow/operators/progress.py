"""Progress logs to per-job state, as batch relations over (job, seq, ...) rows.

Folds over a job's rows are aggregates with a sequence number as order, or
running windows per job, so they have partial aggregation or one shuffle by job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What progress lines look like, in order of precedence.
ANSI = r"(?:\x1B[@-_]|[\x80-\x9F])[0-?]*[ -/]*[@-~]"
MAIN = r"(?i)\btranslate\s+[^a-z()\r\n]*?([0-9]+)/([0-9]+)\b"
STEP = r"(.+?)\([0-9]+/[0-9]+\)\s+.*?([0-9]+)/([0-9]+)"
BAR = r"\|\s*([0-9]+)/([0-9]+)\s+\["
LEGACY = r"(?i)(?:translate|Running|Parse).*?([0-9]+)/([0-9]+)"
PAGE = r"(?i)(?:page|页面)\s*[:：]?\s*([0-9]+)"
WORK_WORDS = ("translating", "翻译", "processing", "处理")
#: Status words of records; ours are English.
DONE_WORDS, FAILED_WORDS = ("完成", "success", "done"), ("失败", "failed")
HISTORY_ROWS, KEEP_SECONDS, GRACE_SECONDS, MILESTONES, MOST_SHOWN = 200, 30, 20, (25, 50, 75, 90), 95


def percent_of(curr: Column, total: Column) -> Column:
    """Whole percent, cut off in floating point as curr / total * 100 gives it."""
    return F.when(total > 0, (curr.cast("double") / total * 100).cast("int"))


def _pair(text: Column, pattern: str, first: int = 1) -> tuple[Column, Column]:
    return F.regexp_extract(text, pattern, first).try_cast("int"), F.regexp_extract(text, pattern, first + 1).try_cast("int")


def parsed_line(line: Column) -> Column:
    """(rule, progress, message) that a line sets; null where it leaves a value as it was."""
    clean = F.regexp_replace(line, ANSI, "")
    m, mt = _pair(clean, MAIN)
    step = F.trim(F.regexp_extract(clean, STEP, 1))
    bars = F.regexp_extract_all(clean, F.lit(BAR), 0)
    b, bt = _pair(F.element_at(bars, -1), BAR)
    old, ot = _pair(clean, LEGACY)
    is_main, is_step, is_bar, is_old = clean.rlike(MAIN), clean.rlike(STEP), F.size(bars) > 0, clean.rlike(LEGACY)
    said = lambda x, t: F.when(t > 0, F.concat(F.lit("translate "), x.cast("string"), F.lit("/"), t.cast("string")))
    rule = F.when(is_main, "main").when(is_step, "step").when(is_bar & is_old, "bar+legacy").when(is_bar, "bar").when(is_old, "legacy")
    progress = F.when(is_main, percent_of(m, mt)).when(is_step, F.lit(None).cast("int")).otherwise(F.coalesce(F.when(is_old, percent_of(old, ot)), F.when(is_bar, percent_of(b, bt))))
    message = F.when(is_main, said(m, mt)).when(is_step, step).when(is_bar, said(b, bt))
    return F.struct(rule.alias("rule"), progress.alias("progress"), message.alias("message"))


def latest(updates: DataFrame, columns: list[str]) -> DataFrame:
    """One row per job: the last non-null value of each column, and the last sequence number.

    Rows before a job's ``added`` row are updates of an unknown job and don't count.
    """
    began = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    known = updates.withColumn("_known", F.max(F.col("added").cast("int")).over(began)).where("_known = 1")
    return known.groupBy("job").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns), F.max("seq").alias("seq"))


def completions(events: DataFrame) -> DataFrame:
    """Completion rows that count: (job, seq, ok), of known jobs and not after a success."""
    before = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = events.withColumn("_known", F.max(F.col("added").cast("int")).over(before)).where((F.col("_known") == 1) & F.col("ok").isNotNull())
    seen = known.withColumn("_done", F.max(F.col("ok").cast("int")).over(before))
    return seen.where(F.coalesce("_done", F.lit(0)) == 0).drop("_known", "_done")


def newest(rows: DataFrame, order: str, most: int = HISTORY_ROWS) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(most)


def still_listed(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that run, or ended less than KEEP_SECONDS before ``as_of``."""
    return jobs.where(F.col("ended").isNull() | (F.col("ended") > as_of - F.expr(f"INTERVAL {KEEP_SECONDS} SECONDS")))


def poll_verdict(wanted: Column, task: Column, finished: Column, status: Column, nested: Column, files: Column, good: tuple[str, ...] = DONE_WORDS, bad: tuple[str, ...] = FAILED_WORDS) -> Column:
    """pending, error, success or no-files for a polled record; ``nested``: a result's status, ``files``: how many.

    ``good`` and ``bad``: status words of records that mean done and failed.
    """
    word = F.coalesce(F.nullif(status, F.lit("")), nested, F.lit(""))
    done = word.isin(*good)
    failed = word.isin(*bad) | F.coalesce(nested == "error", F.lit(False)) | (finished & ~done)
    over = finished | done | F.coalesce(nested == "success", F.lit(False))
    return F.when(F.coalesce(task != wanted, F.lit(True)), "pending").when(failed, "error").when(over & (files > 0), "success").when(over, "no-files").otherwise("pending")


def grace_over(polls: DataFrame, seconds: int = GRACE_SECONDS) -> DataFrame:
    """First poll per job at which ``no-files`` has held without a break for ``seconds`` (ts in seconds)."""
    by_job = Window.partitionBy("job").orderBy("ts")
    runs = polls.withColumn("_run", F.sum((F.col("verdict") != "no-files").cast("int")).over(by_job))
    held = runs.where("verdict = 'no-files'").withColumn("_since", F.min("ts").over(Window.partitionBy("job", "_run")))
    return held.where(F.col("ts") - F.col("_since") >= seconds).groupBy("job").agg(F.min("ts").alias("gave_up"))


def phase_fraction(phase: Column, percent: Column) -> Column:
    raw = F.least(F.greatest(F.coalesce(percent, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    return F.when(phase == "submitting", 0.05).when(phase == "accepted", 0.12).when(phase == "running", 0.12 + raw / 100 * 0.73).when(phase == "importing", 0.9).otherwise(1.0)


def phase_percent(phase: Column, percent: Column, current: Column, total: Column) -> Column:
    return F.floor((current - 1 + phase_fraction(phase, percent)) / total * 100 + 0.5).cast("int")


def batch_percent(updates: DataFrame) -> DataFrame:
    """Add ``overall``: files done and the current one's share, below 100. Rows: batch, seq, file, total, phase, percent."""
    over = F.col("phase").isin("file-done", "file-failed")
    first = Window.partitionBy("batch", "file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = updates.withColumn("_ended", F.sum(over.cast("int")).over(first))
    rows = rows.withColumn("_done", F.sum((over & (F.col("_ended") == 1)).cast("int")).over(run))
    own = F.when(F.col("_ended") > 0, F.lit(0.0)).otherwise(phase_percent(F.col("phase"), F.col("percent"), F.lit(1), F.lit(1)) / 100)
    return rows.withColumn("overall", F.least(F.lit(99), F.floor((F.least("_done", "total") + own) / F.col("total") * 100 + 0.5).cast("int"))).drop("_ended", "_done")


def batch_verdict(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "success").when(failed >= total, "failed").otherwise("mixed")


def milestones(looks: DataFrame) -> DataFrame:
    """job, seq, milestone: which milestone is told at which look (job, seq, progress).

    A look tells one milestone at most: the first above the last one told that
    progress, capped at MOST_SHOWN, has reached. So the next is told at the
    first later look that has reached it, and falling back tells nothing.
    """
    job = Window.partitionBy("job")
    shown, rows, last, told = F.least("progress", F.lit(MOST_SHOWN)), looks, F.lit(None).cast("long"), F.lit(None).cast("int")
    for k, m in enumerate(MILESTONES):
        hit = (shown >= m) if k == 0 else (shown >= m) & (F.col("seq") > last)
        rows = rows.withColumn(f"_at{m}", F.min(F.when(hit, F.col("seq"))).over(job))
        last = F.col(f"_at{m}")
        told = F.when(F.col("seq") == last, m).otherwise(told)
    return rows.where(F.coalesce(*(F.when(F.col("seq") == F.col(f"_at{m}"), True) for m in MILESTONES), F.lit(False))).select("job", "seq", told.alias("milestone"))


def console_progress(rows: DataFrame) -> DataFrame:
    """What a console monitor reports: (job, tick, curr, percent).

    ``rows``: job, tick, cursor, row, curr, total. The first tick with a
    candidate locks its largest total; ties go to the row nearest the cursor,
    then the lower one on screen, then the larger count. A later tick takes the
    row with that total nearest to the last one taken, then to the cursor. A
    count below the last one is passed over. Reports rise and stay below 100.

    Each tick depends on the one before, so a job's rows are folded in one
    task; a job has as many as its console was looked at.
    """
    rows = rows.where("total > 0")
    first = rows.groupBy("job").agg(F.min_by("total", F.struct("tick", -F.col("total"))).alias("locked"))
    rows = rows.join(first, "job").where("total = locked").select("job", "tick", "cursor", "row", "curr", "total")
    key = rows.schema["job"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tick", "ascending"), ("row", "ascending")])
        told: list[tuple[int, int]] = []
        place = count = tick = None
        seen: list[tuple[int, int, int]] = []

        def look() -> None:
            nonlocal place, count
            if place is None:
                row, curr = min((abs(r - c), -r, -n, r, n) for r, n, c in seen)[3:]
            else:
                row, curr = min((abs(r - place), abs(r - c), -r, k, r, n) for k, (r, n, c) in enumerate(seen))[4:]
            if count is None or curr >= count:
                if curr != count:
                    told.append((tick, curr))
                place, count = row, curr

        for t, cursor, row, curr in zip(*(table.column(c).to_pylist() for c in ("tick", "cursor", "row", "curr")), strict=True):
            if seen and t != tick:
                look()
                seen = []
            tick = t
            seen.append((row, curr, cursor))
        if seen:
            look()
        job, total = table.column("job")[0], table.column("total")[0].as_py()
        return pa.table([pa.array([job.as_py()] * len(told), job.type), pa.array([t for t, _ in told], pa.int64()), pa.array([c for _, c in told], pa.int64()), pa.array([total] * len(told), pa.int64())], ["job", "tick", "curr", "total"])

    told = rows.withColumns({c: F.col(c).cast("long") for c in ("tick", "cursor", "row", "curr", "total")}).groupBy("job").applyInArrow(run, f"job {key}, tick long, curr long, total long")
    return told.select("job", "tick", "curr", F.when(F.col("curr") >= F.col("total"), 99).otherwise(percent_of(F.col("curr"), F.col("total"))).alias("percent"))


def helper_progress(line: Column, pages: Column) -> tuple[Column, Column]:
    """Percent that a helper's line tells (null if none), and whether a line without one makes progress creep.

    A page number counts against the job's pages; without pages it counts two
    percent a page, 90 at most. Else a number before a percent sign counts, and
    else a word of work.
    """
    page = F.regexp_extract(line, PAGE, 1).try_cast("double")
    share = F.when(pages > 0, page / pages * 100).when(page.isNotNull(), F.least(page * 2, F.lit(90.0)))
    said = F.coalesce(share, F.regexp_extract(line, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double"))
    return said, said.isNull() & F.lower(line).rlike("|".join(WORK_WORDS))


def creeping(rows: DataFrame) -> DataFrame:
    """Add ``progress`` to rows (job, seq, said, creeps): a said percent counts, up or down; each creeping line adds 0.5 while below 80."""
    so_far = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_run", F.count("said").over(so_far))
    run = Window.partitionBy("job", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.coalesce(F.first("said").over(run), F.lit(0.0))
    crept = F.sum((F.col("creeps") & F.col("said").isNull()).cast("int")).over(run)
    most = F.greatest(F.ceil((F.lit(80) - base) / 0.5), F.lit(0))
    return rows.withColumn("progress", base + F.least(crept, most) * 0.5).drop("_run")
