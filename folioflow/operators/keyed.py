"""Keyed state with invariants: provider entries, of which one per service may be active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective(events: DataFrame) -> DataFrame:
    """The rows of a log that find their key there, with its life, its service at that time and whether they switch it.

    A key lives from an upsert to its deletion; what comes outside a life does
    nothing. Runs over one key's rows alone.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_life", F.coalesce(F.sum((F.col("op") == "delete").cast("int")).over(before), F.lit(0)))
    so_far = Window.partitionBy("key", "_life").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = F.col("op") == "upsert"
    rows = rows.withColumn("_service", F.last(F.when(put, F.col("service")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("_born", F.min(F.when(put, F.col("seq"))).over(so_far)).where("_born IS NOT NULL")
    switch = F.when(F.col("op") == "activate", True).when(put, F.coalesce("active", F.lit(False))).when(F.col("op") == "deactivate", False)
    return rows.select("key", "_life", F.col("_service").alias("service"), "seq", "op", switch.alias("on"))


def entries(events: DataFrame) -> DataFrame:
    """State after a log of (key, service, seq, op: upsert, activate, deactivate, delete; active).

    Activating an entry deactivates all others of its service, so an entry is
    active if its own last switch was on and is the last activation of its
    service. A key deleted and put again starts anew, at the end of the order
    of insertion (first_seq).
    """
    rows = effective(events)
    lives = rows.groupBy("key", "_life").agg(
        F.max_by("service", "seq").alias("service"), F.min("seq").alias("first_seq"), F.bool_or(F.col("op") == "delete").alias("gone"),
        F.max_by(F.struct("on", "seq"), F.when(F.col("on").isNotNull(), F.col("seq"))).alias("switch"),
    )
    activations = rows.where("on").groupBy("service").agg(F.max("seq").alias("_last_on"))
    alive = lives.where("NOT gone").join(activations, "service", "left")
    on = F.coalesce(F.col("switch.on") & (F.col("switch.seq") == F.col("_last_on")), F.lit(False))
    return alive.select("key", "service", "first_seq", on.alias("active"))


def first_active(state: DataFrame) -> DataFrame:
    """Per service the first active entry in order of insertion."""
    return state.where("active").groupBy("service").agg(F.min_by("key", "first_seq").alias("key"))


def loaded(preferences: Column) -> Column:
    """Entries of a stored JSON list: those with key and service; activate false and no extra values by default."""
    shape = "array<struct<key:string,service:string,model:string,activate:boolean,extraData:map<string,string>>>"
    items = F.filter(F.from_json(preferences, shape), lambda e: (F.coalesce(e["key"], F.lit("")) != "") & (F.coalesce(e["service"], F.lit("")) != ""))
    return F.transform(items, lambda e: F.struct(e["key"].alias("key"), e["service"].alias("service"), e["model"].alias("model"), F.coalesce(e["activate"], F.lit(False)).alias("activate"), F.coalesce(e["extraData"], F.create_map().cast("map<string,string>")).alias("extraData")))
