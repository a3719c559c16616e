"""Settings documents as queries: each user's events as hooks of their own, with managed ones merged in and taken out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import settings

#: Kinds of events that get managed hooks, one for each matcher that they name.
MANAGED = ("error", "purchase")


def settings_of(events: DataFrame) -> DataFrame:
    """Per user: the settings with a hook group for each of their events, and the managed hooks to install."""
    key = F.get_json_object("props", "$.k")
    handler = F.struct(F.lit("command").alias("type"), F.concat(F.lit("run --value "), F.col("value").cast("string")).alias("command"))
    group = F.struct(key.alias("matcher"), F.array(handler).alias("hooks"))
    lists = events.groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", group.alias("group")))), lambda x: x["group"]).alias("groups"))
    document = lists.groupBy("user_id").agg(F.to_json(F.struct(F.col("user_id").alias("user"), F.map_from_entries(F.collect_list(F.struct("event_type", "groups"))).alias("hooks"))).alias("text"))
    hook = F.struct(F.col("event_type").alias("event"), key.alias("matcher"), F.concat(F.lit(settings.COMMAND + " --target "), "event_type").alias("command"))
    wanted = events.filter(F.col("event_type").isin(*MANAGED)).groupBy("user_id").agg(F.array_sort(F.collect_set(hook)).alias("hooks"))
    none = F.array().cast("array<struct<event:string,matcher:string,command:string>>")
    return document.join(wanted, "user_id", "left").withColumn("hooks", F.coalesce("hooks", none))


def hook_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settings_of(spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = rows.withColumn("one", settings.install(F.col("text"), F.col("hooks")))
    rows = rows.withColumns({"two": settings.install(F.col("one"), F.col("hooks")), "removed": settings.removed_handlers(F.col("one"))}).withColumn("back", settings.uninstall(F.col("two")))
    lists = F.from_json(F.get_json_object("one", "$.hooks"), "map<string,array<string>>")
    count = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda n, v: n + F.size(v)).cast("long")
    same = F.to_json(F.parse_json("text")) == F.col("back")
    return rows.select("user_id", F.array_join(F.array_sort(F.map_keys(lists)), ",").alias("events"), count(lists).alias("groups"), "removed", (F.col("one") == F.col("two")).alias("same_again"), same.alias("restored"))


QUERIES = {"hook_documents": hook_documents}

ORACLE = {
    "hook_documents": f"""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS events,
  count(*) + count(DISTINCT CASE WHEN event_type IN {MANAGED} THEN concat(event_type, ' ', json_extract_string(props, '$.k')) END) AS groups,
  count(DISTINCT CASE WHEN event_type IN {MANAGED} THEN concat(event_type, ' ', json_extract_string(props, '$.k')) END) AS removed, TRUE AS same_again, TRUE AS restored FROM events GROUP BY user_id""",
}
