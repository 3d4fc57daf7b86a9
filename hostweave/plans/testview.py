"""The driver's tables read as provenance data.

``events`` becomes the event log, ``lineitem`` the flow records, and the
dimension tables the entities that event objects refer to. Users and objects
share one id space, so a node can be subject and object, also of one event.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# How the carrier's event types are read.
TYPE_NAMES = {
    "click": "EVENT_READ", "view": "EVENT_WRITE", "purchase": "EVENT_SENDTO",
    "signup": "EVENT_EXECUTE", "error": "EVENT_CLOSE",
}
HOUR, DAY = 3600, 86_400
ATTACKS = [(datetime(2024, 1, 10, 0, 0, 0), datetime(2024, 1, 11, 23, 59, 59))]
# Burst threshold in proportion to day windows.
BURST_RUN, BURST_WITHIN_US = 3, 4 * 3600 * 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _node(number: Column) -> Column:
    return F.concat(F.lit("n"), number.cast("string"))


def as_events(raw: DataFrame) -> DataFrame:
    kind = None
    for name, event_type in TYPE_NAMES.items():
        match = F.col("event_type") == name
        kind = F.when(match, event_type) if kind is None else kind.when(match, event_type)
    k = F.regexp_extract("props", r"(\d+)", 1)
    return raw.select(
        F.col("event_id").alias("ordinal"), "ts", kind.alias("type"),
        _node(F.col("user_id")).alias("subject"),
        F.when(F.col("event_id") % 17 != 0, _node(k)).alias("object"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return as_events(table(spark, folder, "events"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same event log as a stream over the file."""
    schema = table(spark, folder, "events").schema
    return as_events(
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder))


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """One process per acting user; process i was started by process i div 2."""
    user = F.col("user_id")
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").alias("start_timestamp")).select(
        _node(user).alias("uuid"),
        F.when(user % 3 == 0, "SUBJECT_PROCESS").otherwise("SUBJECT_THREAD").alias("type"),
        (user + 1000).cast("int").alias("cid"),
        F.when(user > 0, _node(F.floor(user / 2))).alias("parent_subject"),
        "start_timestamp")


def network(spark: SparkSession, folder: str) -> DataFrame:
    """One flow per order line; the last line numbers have no remote end."""
    known = F.col("l_linenumber") < 6
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.lit("f"), F.col("l_orderkey"), F.col("l_linenumber")).alias("uuid"),
        F.concat(F.lit("10.1.0."), F.col("l_linenumber")).alias("local_address"),
        (F.col("l_linenumber") + 49_000).cast("int").alias("local_port"),
        F.when(known, F.concat(F.lit("10.2.0."), F.col("l_suppkey"))).alias("remote_address"),
        F.when(known, F.col("l_partkey") % 1000).cast("int").alias("remote_port"))


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flow objects that events refer to by id."""
    return table(spark, folder, "supplier").select(
        _node(F.col("s_suppkey")).alias("uuid"),
        F.concat(F.lit("10.3.0."), F.col("s_nationkey")).alias("remote_address"),
        (F.col("s_nationkey") + 430).cast("int").alias("remote_port"))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Registry keys that events refer to by id; small parts sit below a run key."""
    run = r"\REGISTRY\MACHINE\Software\Microsoft\Windows\CurrentVersion\Run" + "\\"
    other = r"\REGISTRY\MACHINE\Software\Microsoft\Windows\CurrentVersion\Explorer" + "\\"
    return table(spark, folder, "part").select(
        _node(F.col("p_partkey")).alias("uuid"),
        F.concat(F.when(F.col("p_size") < 10, F.lit(run)).otherwise(F.lit(other)),
                 F.col("p_brand")).alias("key"))
