"""Attack-interval queries, process lineage, connections and reachability."""

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hostweave.functions.durable import durable, new_path
from hostweave.functions.hubs import dealt, hub_parts, repeated
from hostweave.functions.ordered import latest_before
from hostweave.functions.timefn import to_micros
from hostweave.operators.reports import first_per_id

RUN_KEY = r"(?i)\\CurrentVersion\\Run(Once)?(\\|$)"


def events_between(events: DataFrame, start, end) -> DataFrame:
    """Events in an interval, both ends included."""
    return events.filter(F.col("ts").between(F.lit(start), F.lit(end)))


def trigger_events(
    events: DataFrame, subjects: DataFrame, types: Sequence[str] = ("EVENT_EXECUTE",)
) -> DataFrame:
    """Starting events with what is known of their subject."""
    known = first_per_id(subjects).select(
        F.col("uuid").alias("subject"), "cid", F.col("type").alias("subject_type"), "parent_subject")
    return events.filter(F.col("type").isin(list(types))).join(known, "subject", "left")


def subject_actions(events: DataFrame, subject: str | None = None) -> DataFrame:
    """Events per type of one subject, or of each."""
    chosen = events if subject is None else events.filter(F.col("subject") == subject)
    return chosen.groupBy("subject", "type").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"))


class _Jumps:
    """Parents of processes as jumps of 1, 2, 4, ... generations.

    Each table has a row per process that has such an ancestor, so the number of
    tables is the logarithm of the longest chain. Records of one process that name
    several parents count by the smallest. Parents that lead back to a process form
    a cycle; its members are left out of the jumps and listed in ``around`` (uuid,
    ancestor, depth) with all other members, nearest first.
    """

    def __init__(self, subjects: DataFrame):
        parent = durable(subjects.filter("uuid <> parent_subject").groupBy("uuid").agg(
            F.min("parent_subject").alias("ancestor")))
        n = parent.count()
        self.tables = self._doubled(parent, n)
        rest = self.tables[-1]
        self.around = parent.limit(0).withColumn("depth", F.lit(0).cast("bigint"))
        if 2 ** (len(self.tables) - 1) >= n and not rest.isEmpty():
            # as many generations as processes: only cycles go on, and all of their members are reached
            members = durable(rest.select(F.col("ancestor").alias("uuid")).distinct())
            self.around = self._cycles(parent.join(members, "uuid", "left_semi"))
            self.tables = self._doubled(durable(parent.join(members, "uuid", "left_anti")), n)

    @staticmethod
    def _doubled(parent: DataFrame, n: int) -> list[DataFrame]:
        tables = [parent]
        while 2 ** (len(tables) - 1) < n and not tables[-1].isEmpty():
            last = tables[-1]
            tables.append(durable(last.withColumnRenamed("ancestor", "__mid").join(
                last.select(F.col("uuid").alias("__mid"), "ancestor"), "__mid").select("uuid", "ancestor")))
        return tables

    @staticmethod
    def _cycles(parent: DataFrame) -> DataFrame:
        """Every member with every other one; cycles are told apart by their smallest member."""
        least = durable(parent.withColumn("least", F.least("uuid", "ancestor")))
        while True:
            ahead = least.select(F.col("uuid").alias("ancestor"), F.col("ancestor").alias("__far"), F.col("least").alias("__least"))
            step = durable(least.join(ahead, "ancestor").select(
                "uuid", F.col("__far").alias("ancestor"), F.least("least", "__least").alias("least"),
                (F.col("__least") < F.col("least")).alias("__new")))
            least = step.drop("__new")
            if step.filter("__new").isEmpty():
                break
        size = least.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
        sized = least.join(size, "least").select("uuid", "size")
        rows = durable(sized.select("uuid", F.col("uuid").alias("ancestor"), "size", F.lit(0).cast("bigint").alias("depth")))
        jump, reach = durable(parent), 1
        while True:
            further = durable(rows.withColumnRenamed("ancestor", "__mid").join(
                jump.select(F.col("uuid").alias("__mid"), "ancestor"), "__mid")
                .withColumn("depth", F.col("depth") + reach).filter("depth < size").select(*rows.columns))
            if further.isEmpty():
                return rows.filter("depth > 0").drop("size")
            rows = rows.unionByName(further)
            jump, reach = durable(jump.withColumnRenamed("ancestor", "__mid").join(
                jump.select(F.col("uuid").alias("__mid"), "ancestor"), "__mid").select("uuid", "ancestor")), reach * 2

    def walked(self, starts: DataFrame, on: str, to: str) -> DataFrame:
        """``starts`` (with ``node`` and ``depth``) and all that lies further along, by doubling what is known."""
        rows = durable(starts)
        for k, jump in enumerate(self.tables):
            further = durable(rows.join(jump.select(F.col(on).alias("node"), F.col(to).alias("__to")), "node").select(
                *[c for c in rows.columns if c not in ("node", "depth")], F.col("__to").alias("node"),
                (F.col("depth") + 2 ** k).alias("depth")))
            rows = rows.unionByName(further)
        return rows


def ancestry(subjects: DataFrame, starting: DataFrame | None = None) -> DataFrame:
    """(uuid, ancestor, depth) along ``parent_subject``.

    ``starting`` (a ``uuid`` column) limits the descendants. A chain ends at a
    process without parent or before it would repeat itself. Rounds grow with the
    logarithm of the longest chain.
    """
    jumps = _Jumps(subjects)
    chosen = subjects.select("uuid").distinct() if starting is None else subjects.select("uuid").distinct().join(
        starting.select("uuid"), "uuid", "left_semi")
    up = jumps.walked(chosen.select(
        "uuid", F.col("uuid").alias("node"), F.lit(0).cast("bigint").alias("depth")), "uuid", "ancestor")
    round_trip = up.join(
        jumps.around.select(F.col("uuid").alias("node"), "ancestor", F.col("depth").alias("__more")), "node")
    return up.filter("depth > 0").select("uuid", F.col("node").alias("ancestor"), "depth").unionByName(
        round_trip.select("uuid", "ancestor", (F.col("depth") + F.col("__more")).alias("depth"))).withColumn(
        "depth", F.col("depth").cast("int"))


def descent(subjects: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, uuid, depth) of everything started below ``roots`` (a ``uuid`` column); rounds as in ``ancestry``."""
    jumps = _Jumps(subjects)
    first = roots.select(F.col("uuid").alias("root"), F.col("uuid").alias("node"), F.lit(0).cast("bigint").alias("depth")).distinct()
    members = jumps.around.select(F.col("ancestor").alias("root"), F.col("uuid").alias("node"), "depth").join(
        first.select("root"), "root", "left_semi")
    down = jumps.walked(first.unionByName(members), "ancestor", "uuid")
    return down.filter("depth > 0").select("root", F.col("node").alias("uuid"), F.col("depth").cast("int").alias("depth"))


def connections(events: DataFrame, flows: DataFrame) -> DataFrame:
    """Which subject used which flow, and how often."""
    return (
        events.filter("object IS NOT NULL").groupBy("subject", "object").agg(
            F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"))
        .join(flows.withColumnRenamed("uuid", "object"), "object")
        .select("subject", F.col("object").alias("flow"), "remote_address", "remote_port",
                "n_events", "first_ts"))


def read_then_send(
    events: DataFrame, within_us: int,
    read: Sequence[str] = ("EVENT_READ",),
    send: Sequence[str] = ("EVENT_SENDTO", "EVENT_SENDMSG"),
) -> DataFrame:
    """Sends preceded by a read of the same subject at most ``within_us`` earlier.

    Each send is paired with its nearest earlier read only, so a busy subject
    gives as many rows as it has sends. Same-instant rows follow input order.
    """
    reads, sends = F.col("type").isin(list(read)), F.col("type").isin(list(send))
    rows = events.filter(reads | sends).select(
        "subject", "type", "object", "ts", "ordinal", to_micros("ts").alias("us"))
    marked = latest_before(
        rows, ["subject"], "us", F.when(reads, F.col("us")), "read_us",
        width=1_000_000, ties=["ordinal"])
    lag = F.col("us") - F.col("read_us")
    return marked.filter(sends & (lag <= within_us)).select(
        "subject", "ordinal", "object", F.col("ts").alias("send_ts"),
        (lag / 1_000_000.0).alias("lag_s"))


class _SlicedLinks:
    """Links in slices of time, each bucketed and sorted by node, so joins by node move no link.

    A hub's links are dealt over parts. The slices are cut at quantiles of the time,
    about ``rows`` links each.
    """

    def __init__(self, events: DataFrame, rows: int, hub_rows: int):
        spark = events.sparkSession
        links = events.filter("object IS NOT NULL AND subject <> object").select(
            F.col("subject").alias("node"), F.col("object").alias("next"), to_micros("ts").alias("us"))
        n = links.count()
        count = max(1, min(self.MOST, -(-n // rows)))
        cuts = links.select(F.percentile_approx(
            "us", [i / count for i in range(1, count)], 100 * count)).first()[0] if count > 1 else []
        cuts = sorted(set(cuts or []))
        self.hubs = durable(hub_parts(links, ["node"], hub_rows))
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.name, self.slices = spark, f"links_{uuid.uuid4().hex}", range(len(cuts) + 1)
        number = functools.reduce(
            lambda a, b: a + b, [(F.col("us") >= cut).cast("int") for cut in cuts], F.lit(0))
        dealt(links, self.hubs, ["node"], F.col("next")).withColumn("slice", number).repartition(
            self.buckets, "node", "__part").write.partitionBy("slice").bucketBy(
            self.buckets, "node", "__part").sortBy("node", "__part").option(
            "path", new_path(spark, "links")).saveAsTable(self.name)

    MOST = 1_000

    def arrivals(self, front: DataFrame, number: int) -> DataFrame:
        """(node, label): the earliest that the nodes of ``front`` pass on to others within a slice."""
        here = repeated(front, self.hubs, ["node"])
        return (
            self.spark.table(self.name).filter(F.col("slice") == number).join(here, ["node", "__part"])
            .filter("us >= label.us").groupBy(F.col("next").alias("node")).agg(
                F.min(F.struct("us", (F.col("label.hops") + 1).alias("hops"))).alias("label")))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def forward_reach(
    events: DataFrame, start: str, slice_rows: int = 50_000_000, hub_rows: int = 1_000_000,
) -> DataFrame:
    """(node, reached_us, hops): everything that information from ``start`` can have reached.

    An event passes it from subject to object if the subject had it by then.
    ``reached_us`` is the earliest time, ``hops`` the events of a way that arrives
    then, not always the shortest such way. Slices of time are done one after the
    other, each until nothing in it changes; what a slice reached is final, so none
    is read again later.
    """
    links = _SlicedLinks(events, slice_rows, hub_rows)
    spark = events.sparkSession
    known = durable(spark.range(1).select(F.lit(start).alias("node"), F.struct(
        F.lit(-(2 ** 62)).cast("bigint").alias("us"), F.lit(0).alias("hops")).alias("label")))
    for number in links.slices:
        front, found = known, [known]
        while True:
            best = functools.reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("label").alias("old"))
            front = durable(
                links.arrivals(front, number).join(best, "node", "left")
                .filter("old IS NULL OR label < old").select("node", "label"))
            if front.isEmpty():
                break
            found.append(front)
        if len(found) > 1:
            known = durable(functools.reduce(DataFrame.unionByName, found).groupBy("node").agg(
                F.min("label").alias("label")))
    links.close()
    return known.filter(F.col("node") != start).select(
        "node", F.col("label.us").alias("reached_us"), F.col("label.hops").alias("hops"))


def run_key_writes(
    events: DataFrame, registry: DataFrame, types: Sequence[str] = ("EVENT_WRITE",)
) -> DataFrame:
    """Writes to registry keys that start programs at logon."""
    keys = registry.filter(F.col("key").rlike(RUN_KEY)).select(F.col("uuid").alias("object"), "key")
    return events.filter(F.col("type").isin(list(types))).join(keys, "object").select(
        "ordinal", "ts", "subject", "object", "key")
