"""Listing, filtering, ranking and comparing of versioned and timed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most notices for all versions that ``applicable`` takes unless told to take all.
MOST_GENERAL = 20_000


def version_key(text: Column) -> Column:
    """The first four numbers of a version as an array; ``[0]`` if there is none."""
    found = F.transform(F.slice(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), 1, 4), lambda x: x.cast("int"))
    return F.when(F.size(F.coalesce(found, F.array().cast("array<int>"))) > 0, found).otherwise(F.array(F.lit(0)))


def meets_minimum(text: Column, least: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike("[0-9]"), version_key(text) >= version_key(F.lit(least))).otherwise(False)


def listing(files: DataFrame, stem: str | None = None) -> DataFrame:
    """PDF files, newest first; with a stem, those that go on with ``-``, ``.`` or ``_`` after it."""
    kept = files.where(F.lower("name").endswith(".pdf"))
    if stem is not None:
        kept = kept.where(F.col("name").startswith(stem) & F.substring("name", len(stem) + 1, 1).isin("-", ".", "_"))
    return kept.orderBy(F.desc("mtime"), "name")


def present(expected: DataFrame, files: DataFrame) -> DataFrame:
    return expected.join(files.select("path"), "path", "left_semi")


def missing(expected: DataFrame, files: DataFrame) -> DataFrame:
    return expected.join(files.select("path"), "path", "left_anti")


def applicable(notices: DataFrame, versions: DataFrame, limited: bool = True) -> DataFrame:
    """(id, version) of enabled notices that name the version, or all, and hold it within their bounds.

    Notices that name versions meet them in an equi-join. Those for all
    versions are held against every version; Spark sends the smaller side to
    the other, or pairs their partitions where neither is small. ``limited``
    counts these first and raises an error above MOST_GENERAL.
    """
    bare = lambda c: F.regexp_replace(F.trim(c), "^v+", "")
    affects = F.filter(F.transform(F.coalesce("affects", F.array().cast("array<string>")), bare), lambda x: x != "")
    n = notices.where(F.coalesce("enabled", F.lit(True))).withColumn("_affects", affects)
    n = n.select("id", "_affects", F.when(F.coalesce("min_version", F.lit("")) != "", version_key(F.col("min_version"))).alias("_min"), F.when(F.coalesce("max_version", F.lit("")) != "", version_key(F.col("max_version"))).alias("_max"))
    v = versions.select("version", bare(F.col("version")).alias("_v")).withColumn("_key", version_key(F.col("_v")))
    general = (F.size("_affects") == 0) | F.arrays_overlap("_affects", F.array(F.lit("*"), F.lit("all")))
    within = (F.col("_min").isNull() | (F.col("_key") >= F.col("_min"))) & (F.col("_max").isNull() | (F.col("_key") <= F.col("_max")))
    named = n.where(~general).withColumn("_v", F.explode(F.array_distinct("_affects"))).join(v, "_v").where(within)
    every = n.where(general)
    if limited and every.count() > MOST_GENERAL:
        raise ValueError(f"more than {MOST_GENERAL} notices for all versions: one for each version would be too many rows")
    return named.select("id", "version").unionByName(v.join(every, within).select("id", "version"))


def newest_version(rows: DataFrame, group: str) -> DataFrame:
    """Per group the highest version; equal ones by source order."""
    return rows.groupBy(group).agg(F.max_by("version", F.struct(version_key(F.col("version")).alias("v"), (-F.col("ordinal")).alias("o"))).alias("version"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in stable order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def usable_sources(probes: DataFrame) -> DataFrame:
    """Reachable sources: custom ones in given order, then by total latency; unknown latency counts as none."""
    total = F.coalesce("connect_ms", F.lit(0)) + F.coalesce("read_ms", F.lit(0))
    custom = F.col("name") == "Custom"
    kept = probes.where("reachable").withColumn("total_ms", total)
    return kept.orderBy(F.desc(custom), F.when(custom, 0).otherwise(F.col("total_ms")), "ordinal")


def source_order(preferred: Column, names: tuple[str, str]) -> Column:
    a, b = names
    return F.when(F.lower(F.coalesce(preferred, F.lit(""))) == b, F.array(F.lit(b), F.lit(a))).otherwise(F.array(F.lit(a), F.lit(b)))


def first_success(attempts: DataFrame, group: str) -> DataFrame:
    """Per group the first attempt that worked, null if none did, and how many were made before."""
    ok = F.when(F.col("ok"), F.struct("ordinal", "source"))
    return attempts.groupBy(group).agg(F.min(ok).getField("source").alias("source"), F.coalesce(F.min(ok).getField("ordinal"), F.count("*")).alias("tried"))


def directory_diff(source: DataFrame, target: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, status: new, updated, unchanged, or preserved where only the target has it. Rows: path, hash."""
    skip = F.exists(F.split("path", "/"), lambda part: part.isin(*excluded)) if excluded else F.lit(False)
    s = source.where(~skip).select("path", F.col("hash").alias("_s"))
    t = target.where(~skip).select("path", F.col("hash").alias("_t"))
    status = F.when(F.col("_t").isNull(), "new").when(F.col("_s").isNull(), "preserved").when(F.col("_s") == F.col("_t"), "unchanged").otherwise("updated")
    return s.join(t, "path", "full_outer").select("path", status.alias("status"))


def shallowest(paths: DataFrame, group: str) -> DataFrame:
    return paths.groupBy(group).agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("path"))


def open_groups(groups: DataFrame) -> DataFrame:
    return groups.where(F.coalesce("status", F.lit("")) != "full").select("ordinal", F.concat_ws(" ", "name", "id").alias("label"))


def record_of(active: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Each key's record: an active one first, then the first in history."""
    both = active.withColumn("_p", F.lit(0)).unionByName(history.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_p", "ordinal")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*active.columns, (F.col("_p") == 0).alias("is_active"))


def batch_counts(results: DataFrame, group: str) -> DataFrame:
    """Per group: attached, total, and the errors in order; any error fails the group."""
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ordinal", "error")))), lambda x: x["error"]), "; ")
    rows = results.groupBy(group).agg(F.count_if(F.col("error").isNull()).alias("attached"), F.count("*").alias("total"), errors.alias("errors"))
    return rows.withColumn("failed", F.col("errors") != "")


def attachment_key(parent: Column, service: Column, kind: Column, leaf: Column) -> Column:
    return F.concat_ws("::", parent, service, kind, leaf)


def satisfied(requirements: DataFrame, installed: DataFrame) -> DataFrame:
    """requirement, met: a left join on package names and a check of all version bounds.

    Bounds (==, !=, >=, <=, >, <, ~=) are separated by commas, and all must
    hold; ``.*`` behind == and != compares the numbers before it. Extras in
    brackets and what follows a semicolon don't count.
    """
    from folioflow.functions.names import package_name

    bare = F.regexp_replace(F.regexp_replace("requirement", ";.*$", ""), r"\[[^\]]*\]", "")
    bound = r"(==|>=|<=|!=|~=|>|<)\s*v?([0-9][0-9.]*\*?)"
    r = requirements.withColumn("_bare", bare)
    r = r.withColumns({"_p": package_name(F.col("_bare")), "_ops": F.regexp_extract_all("_bare", F.lit(bound), 1), "_vs": F.regexp_extract_all("_bare", F.lit(bound), 2)})
    i = installed.select(package_name(F.col("package")).alias("_p"), F.col("version").alias("_have"))
    pad = lambda c: F.slice(F.concat(version_key(c), F.array_repeat(F.lit(0), 4)), 1, 4)
    have = pad(F.col("_have"))

    def holds(x: Column) -> Column:
        op, v = x["_ops"], x["_vs"]
        want, numbers = pad(v), F.size(F.filter(F.split(v, r"\."), lambda n: (n != "*") & (n != "")))
        alike = lambda n: F.slice(have, F.lit(1), n) == F.slice(want, F.lit(1), n)
        same = F.when(v.endswith("*"), alike(numbers)).otherwise(have == want)
        return (
            F.when(op == "==", same).when(op == "!=", ~same).when(op == ">=", have >= want).when(op == "<=", have <= want).when(op == ">", have > want).when(op == "<", have < want)
            .otherwise((have >= want) & alike(F.greatest(numbers - 1, F.lit(1))))
        )

    return r.join(i, "_p", "left").select("id", "requirement", (F.col("_have").isNotNull() & F.forall(F.arrays_zip("_ops", "_vs"), holds)).alias("met"))


def model_ids(payload: Column) -> Column:
    """Ids in a JSON list of models, whatever it is wrapped in: distinct, in order, without their prefix."""
    body = F.coalesce(*(F.nullif(x, F.lit("")) for x in (F.when(F.ltrim(payload).startswith("["), payload), *(_list_at(payload, p) for p in ("$.data", "$.models", "$.result.data", "$.result")))))
    items = F.from_json(F.regexp_replace(body, r"\s+", " "), "array<string>")
    name = lambda x: F.when(x.startswith("{"), F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("id", "name", "model", "model_name")), F.lit(""))).otherwise(x)
    bare = F.transform(items, lambda x: F.regexp_replace(name(x), "^models/", ""))
    return F.coalesce(F.array_distinct(F.filter(bare, lambda x: x != "")), F.array().cast("array<string>"))


def _list_at(payload: Column, path: str) -> Column:
    got = F.get_json_object(payload, path)
    return F.when(got.startswith("["), got)


def offered_models(defaults: Column, saved: Column, fetched: Column, retired: Column) -> Column:
    """Defaults, then saved ones, then fetched ones sorted; each once, without retired ones."""
    return F.array_except(F.array_union(F.array_union(defaults, saved), F.array_sort(fetched)), retired)


def named_environment(found: DataFrame) -> DataFrame:
    """Per name a listed path whose leaf is the name, else the first directory that holds it."""
    leaf = F.regexp_extract("path", "([^/]*)$", 1)
    listed = F.when((F.col("kind") == "listed") & (leaf == F.col("name")), F.struct(F.lit(0).alias("p"), "ordinal", "path"))
    held = F.when(F.col("kind") == "directory", F.struct(F.lit(1).alias("p"), "ordinal", F.concat_ws("/", "path", "name").alias("path")))
    return found.groupBy("name").agg(F.min(F.coalesce(listed, held)).getField("path").alias("path"))


def path_entries(entries: DataFrame) -> DataFrame:
    """Existing entries, each normalised path once, in order."""
    norm = F.regexp_replace(F.regexp_replace("path", "/+", "/"), "(?<=.)/$", "")
    return first_of_each(entries.where("found").withColumn("path", norm), "path", "ordinal").orderBy("ordinal")


def chosen_environment(candidates: DataFrame) -> DataFrame:
    """Per engine: a cached one, else the first healthy, else the first to repair, else a fresh one."""
    rank = F.when(F.col("cached"), 0).when(F.col("healthy"), 1).when(F.col("found"), 2)
    action = F.when(F.col("cached"), "cached").when(F.col("healthy"), "use").otherwise("repair")
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "preference", "tool", action.alias("action"))))
    return candidates.groupBy("engine").agg(best.alias("b")).select("engine", F.col("b.tool").alias("tool"), F.coalesce("b.action", F.lit("fresh")).alias("action"))


def engines_of(choice: Column) -> Column:
    return F.when(choice == "all", F.array(F.lit("engine-1"), F.lit("engine-2"))).otherwise(F.array(choice))
