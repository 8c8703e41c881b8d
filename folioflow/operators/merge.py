"""Merging of layered configuration, as joins on paths and keys.

Presence and null differ: a present key with a null value wins over a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.names import package_name

#: Other names of services, keys that an update always keeps, blocked variables.
ALIASES = {
    "ModelScope": "modelscope", "openailiked": "openaicompatible", "tencent": "tencentmechinetranslation", "silicon": "siliconflow",
    "qwen-mt": "qwenmt", "AliyunDashScope": "aliyundashscope", "azure-openai": "azureopenai",
}
KEPT_KEYS = ("translate_engine_type", "support_llm")
BLOCKED = ("PYTHONPATH", "PYTHONHOME", "VIRTUAL_ENV")


def merged_defaults(defaults: DataFrame, user: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: the user's where present, else the default; rows only one side has stay."""
    d = defaults.select(*keys, F.struct("value").alias("_d"))
    u = user.select(*keys, F.struct("value").alias("_u"))
    return d.join(u, keys, "full_outer").select(*keys, F.coalesce("_u", "_d").getField("value").alias("value"))


def merged_list(defaults: DataFrame, user: DataFrame, group: str) -> DataFrame:
    """Named items per group: the user's in order, then new defaults in theirs. Rows: group, name, ordinal, value."""
    d = defaults.select(group, "name", F.col("ordinal").alias("_do"), F.struct("value").alias("_d"))
    u = user.select(group, "name", F.col("ordinal").alias("_uo"), F.struct("value").alias("_u"))
    rows = d.join(u, [group, "name"], "full_outer")
    order = Window.partitionBy(group).orderBy(F.col("_uo").asc_nulls_last(), "_do")
    return rows.select(group, "name", (F.row_number().over(order) - 1).alias("position"), F.coalesce("_u", "_d").getField("value").alias("value"))


def merged_requirements(defaults: DataFrame, user: DataFrame, group: str) -> DataFrame:
    """All defaults, and the user's requirements of packages that no default manages."""
    d = defaults.select(group, "requirement", package_name(F.col("requirement")).alias("_p"))
    u = user.select(group, "requirement", package_name(F.col("requirement")).alias("_p"))
    return d.unionByName(u.join(d.select(group, "_p"), [group, "_p"], "left_anti")).drop("_p")


def changed(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups whose rows differ between two tables."""
    return old.exceptAll(new).select(group).union(new.exceptAll(old).select(group)).distinct()


def typed_text(key: Column, value: Column) -> Column:
    """An extra value as it is written: true or false for flags, digits for whole numbers, else the text."""
    from folioflow.functions.coerce import extra_value

    x = extra_value(key, value)
    return F.when(x["kind"] == "bool", x["b"].cast("string")).when(x["kind"] == "int", x["i"].cast("string")).otherwise(value)


def updated_provider(stored: DataFrame, sent: DataFrame, group: str, keep_blank: bool, typed: bool = False) -> DataFrame:
    """group, key, value after an update.

    ``stored``: group, key, value, listed (in the service's whitelist).
    ``sent``: group, key, value, base (one of the three base keys). Blank values
    aren't written. A stored key stays if it is listed, sent with a value, or,
    with ``keep_blank``, a fixed key or a base key that was sent blank. With
    ``typed`` extra values are coerced before they are written.
    """
    if typed:
        sent = sent.withColumn("value", F.when(F.col("base"), F.col("value")).otherwise(typed_text(F.col("key"), F.col("value"))))
    filled = sent.where(F.coalesce("value", F.lit("")) != "").select(group, "key", F.struct("value").alias("_new"))
    kept = stored.where("listed").select(group, "key")
    if keep_blank:
        blank = sent.where(F.col("base") & (F.coalesce("value", F.lit("")) == "")).select(group, "key")
        kept = kept.unionByName(blank).unionByName(stored.where(F.col("key").isin(*KEPT_KEYS)).select(group, "key"))
    old = stored.join(kept.distinct(), [group, "key"], "left_semi").select(group, "key", F.struct("value").alias("_old"))
    return old.join(filled, [group, "key"], "full_outer").select(group, "key", F.coalesce("_new", "_old").getField("value").alias("value"))


def pool_setting(size: Column) -> Column:
    return F.when(size > 0, size.cast("string")).otherwise("null")


def resolved(service: Column, aliases: dict[str, str] = ALIASES) -> Column:
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), service), service)


def history_with(new: Column, old: Column) -> Column:
    """Newest first, each once: new entries in reverse, then old ones."""
    return F.array_union(F.reverse(new), old)


def without_retired(history: Column, retired: list[str]) -> Column:
    return F.array_except(history, F.array(*map(F.lit, retired)))


def isolated_environment(env: Column) -> Column:
    """Variables without the blocked ones, whatever their case, and with user packages off."""
    bare = F.map_filter(env, lambda k, v: ~F.upper(k).isin(*BLOCKED, "PYTHONNOUSERSITE"))
    return F.map_concat(bare, F.create_map(F.lit("PYTHONNOUSERSITE"), F.lit("1")))


def requirements_for(spec: Column, engine: Column, tool: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.try_element_at(spec, engine), tool), default)


def unanswered(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts for versions that no stored answer names."""
    return prompts.join(answers.where("status IN ('accepted', 'declined')").select("version"), "version", "left_anti")
