"""Registered queries: every operator over the driver's tables, whole."""

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostweave import schemas
from hostweave.functions import ids, text, timefn
from hostweave.functions.durable import durable, new_path
from hostweave.operators import (
    clean, graph, lineage, propagation, reports, scoring, sequences, story, temporal, windows)
from hostweave.operators.centrality import MEASURES, centrality, wide_clustering
from hostweave.operators.features import node_features
from hostweave.plans import dataset, testview as view
from hostweave.plans.explain import Explanation
from hostweave.schemas import NODE_FEATURES
from hostweave.sources import cdm, explanations, graph_docs, tables
from hostweave.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Weights of the linear score that the attention and explanation queries use.
WEIGHTS = {
    "node_type_flag": 0.4, "in_degree": 0.7, "out_degree": -0.2, "event_type_count": 0.3}
BIAS, CUTOFF = 0.1, 0.75
# Coefficients of a scorer of whole sequences: later steps count more.
STEP_WEIGHTS = {
    f"{name}_t{step}": round(weight * share, 4)
    for step, share in enumerate((0.2, 0.3, 0.5)) for name, weight in WEIGHTS.items()}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _round(column: str | Column, digits: int = 6) -> Column:
    # Adding 0.0 turns a negative zero into zero.
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _real(name: str) -> Column:
    """A nullable whole number, in the type that holds its nulls everywhere."""
    return F.col(name).cast("double").alias(name)


def _graph_events(spark: SparkSession, folder: str) -> DataFrame:
    return clean.graph_events(view.events(spark, folder))


def _pairs(spark: SparkSession, folder: str, seconds: int = view.DAY) -> DataFrame:
    return dataset.window_pairs(view.events(spark, folder), seconds)


def _nodes(spark: SparkSession, folder: str, seconds: int = view.DAY) -> DataFrame:
    return graph.basic_features(graph.nodes(_pairs(spark, folder, seconds)))


def _labels(spark: SparkSession, folder: str, seconds: int = view.HOUR) -> DataFrame:
    return dataset.labelled_windows(_nodes(spark, folder, seconds), seconds, view.ATTACKS)


# --- sources and sinks ------------------------------------------------------


def _literal_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the CSV files hold them: bytes-literal ids."""
    return view.events(spark, folder).select(
        "ordinal", F.col("ts").alias("timestamp"), "type",
        ids.bytes_literal(F.md5("subject")).alias("subject"),
        ids.bytes_literal(F.md5("object")).alias("predicate_object"))


@query
def event_csv(spark, folder):
    path = new_path(spark, "events-csv")
    tables.write_csv(_literal_events(spark, folder), path)
    return clean.clean_identifiers(tables.read_events(spark, path)).select(
        "ordinal", "ts", "type", "subject", "object")


def _named_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events under the column names of a file."""
    return view.events(spark, folder).withColumnsRenamed(
        {"ts": "timestamp", "object": "predicate_object"})


@query
def event_csv_without_ordinal(spark, folder):
    """Files without order numbers: the order of files and lines decides the last event."""
    path = new_path(spark, "plain-csv")
    tables.write_csv(
        _named_events(spark, folder).repartitionByRange(5, "ordinal").sortWithinPartitions("ordinal")
        .drop("ordinal"), path)
    pairs = dataset.window_pairs(tables.read_events(spark, path), view.DAY)
    return graph.nodes(pairs).select("window_start", "node_id", "node_type", "in_degree", "out_degree")


@query
def event_csv_mixed_headers(spark, folder):
    """Two sets of files with their columns in different order."""
    path, events = new_path(spark, "mixed-csv"), _named_events(spark, folder)
    even = F.col("ordinal") % 2 == 0
    tables.write_csv(events.filter(even), f"{path}/a")
    tables.write_csv(events.filter(~even).select(*reversed(events.columns)), f"{path}/b")
    return tables.read_events(spark, f"{path}/*")


def _spoiled_csv(spark: SparkSession, folder: str) -> str:
    """Event files in which every fiftieth time is written in another form."""
    path = new_path(spark, "spoiled-csv")
    other = F.date_format("timestamp", "dd/MM/yyyy HH:mm")
    form = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    tables.write_csv(_named_events(spark, folder).withColumn(
        "timestamp", F.when(F.col("ordinal") % 50 == 0, other).otherwise(form)), path)
    return path


@query
def rejected_rows(spark, folder):
    return tables.rejected_events(spark, _spoiled_csv(spark, folder)).select(
        F.col("ordinal").cast("bigint").alias("ordinal"), F.col("ts").alias("time_text"), "type", "subject")


@query
def readable_rows(spark, folder):
    return tables.read_events(spark, _spoiled_csv(spark, folder), reject=True)


def _with_all_columns(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a file that the carrier tables do not have, empty."""
    for part in schema.split(","):
        df = clean.with_optional_column(df, part.split()[0])
    return df


@query
def network_csv(spark, folder):
    path = new_path(spark, "network-csv")
    flows = view.network(spark, folder).withColumn("remote_port", F.col("remote_port").cast("double"))
    tables.write_csv(_with_all_columns(flows, schemas.NETWORK), path)
    return tables.read_network(spark, path).select(
        "uuid", "local_address", "local_port", "remote_address", _real("remote_port"))


@query
def subject_csv(spark, folder):
    path = new_path(spark, "subjects-csv")
    tables.write_csv(_with_all_columns(view.subjects(spark, folder), schemas.SUBJECTS), path)
    return tables.read_subjects(spark, path).select(
        "uuid", "type", "cid", "parent_subject", "start_timestamp")


@query
def null_tokens(spark, folder):
    token = F.element_at(
        F.array(F.lit("None"), F.lit("NaN"), F.lit(""), F.col("event_type")),
        (F.col("event_id") % 4 + 1).cast("int"))
    marked = view.table(spark, folder, "events").select(
        "event_id", "event_type", token.alias("token"))
    return clean.normalise_nulls(marked, ["token"]).groupBy("event_type").agg(
        F.count("token").alias("n_known"), F.count(F.lit(1)).alias("n_rows"))


def _envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a CDM envelope, and every subject as one too."""
    nanos = (timefn.to_micros("ts") * 1000).alias("timestampNanos")
    def none(name: str, kind: str) -> Column:
        return F.lit(None).cast(kind).alias(name)
    events = view.events(spark, folder).select(
        F.struct(
            F.concat(F.lit("e"), F.col("ordinal")).alias("uuid"), F.col("ordinal").alias("sequence"),
            "type", F.col("subject"), F.col("object").alias("predicateObject"), nanos,
            none("cid", "int"), none("parentSubject", "string")).alias("datum"),
        F.lit("RECORD_EVENT").alias("type"))
    subjects = view.subjects(spark, folder).select(
        F.struct(
            "uuid", none("sequence", "bigint"), "type", none("subject", "string"),
            none("predicateObject", "string"), none("timestampNanos", "bigint"), "cid",
            F.col("parent_subject").alias("parentSubject")).alias("datum"),
        F.lit("RECORD_SUBJECT").alias("type"))
    return events.unionByName(subjects).withColumns(
        {"hostId": F.lit("h1"), "source": F.lit("SOURCE_TEST")})


@query
def record_tables(spark, folder):
    path = new_path(spark, "records-json")
    _envelopes(spark, folder).write.json(path)
    records = cdm.read_records(spark, path)
    return cdm.record_table(records, "events").select(
        "uuid", "sequence", "ts", "type", "subject", "object", "host_id")


@query
def record_subjects(spark, folder):
    return cdm.record_table(_envelopes(spark, folder), "subjects").select(
        "uuid", "type", "cid", "parent_subject")


def _written_records(rows: list[DataFrame]) -> DataFrame:
    """(type, datum as JSON) of several kinds, written as records of one session and read back."""
    spark = rows[0].sparkSession
    path = new_path(spark, "records-json")
    functools.reduce(DataFrame.unionByName, rows).select(F.concat(
        F.lit('{"type":"'), "type", F.lit('","hostId":"h1","sessionNumber":4,"source":"S","datum":'), "datum",
        F.lit("}"))).write.text(path)
    return cdm.read_records(spark, path)


def _record(rows: DataFrame, kind: str, **fields: Column) -> DataFrame:
    """Rows as records of one type; nulls are written, as in recorded data."""
    return rows.select(
        F.lit(f"RECORD_{kind}").alias("type"), F.to_json(F.struct(
            *[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("datum"))


def _number(column: str) -> Column:
    return F.concat(F.lit("n"), F.col(column).cast("string"))


def _base(epoch: str) -> Column:
    """The part that all object records share."""
    return F.struct(
        F.concat(F.lit("b'\\x01"), F.col(epoch) % 8, F.lit("'")).alias("permission"),
        F.col(epoch).cast("int").alias("epoch"), F.create_map(F.lit("size"), F.col(epoch).cast("string")).alias("properties"))


def _value(name: Column, components: Column | None = None, **more: Column) -> Column:
    return F.struct(
        F.lit(-1).alias("size"), F.lit("VALUE_TYPE_SRC").alias("type"), F.lit("VALUE_DATA_TYPE_CHAR").alias("valueDataType"),
        F.lit(False).alias("isNull"), name.alias("name"), *[c.alias(n) for n, c in more.items()],
        (F.lit(None).cast("string") if components is None else components).alias("components"))


def _part_value() -> Column:
    """A value in three levels: the part, then brand and type, then the brand's maker; small parts have no components."""
    maker = F.array(_value(F.concat(F.lit("m"), F.col("p_size")), valueBytes=F.lit("b'\\x00A'")))
    return _value(
        F.col("p_name"), F.when(F.col("p_size") >= 5, F.array(
            _value(F.col("p_brand"), maker), _value(F.col("p_type"), F.when(F.lit(False), maker)))),
        provenance=F.when(F.col("p_size") < 9, F.array(F.struct(
            _number("p_size").alias("asserter"), F.array(_number("p_partkey"), F.lit("b'A'")).alias("sources"),
            F.array(F.struct(F.lit("n0").alias("asserter"))).alias("provenance")))))


def _object_records(spark: SparkSession, folder: str) -> DataFrame:
    """Flows, files, registry keys, memory, principals and time markers, nested as recorded."""
    part, supplier = view.table(spark, folder, "part"), view.table(spark, folder, "supplier")
    return _written_records([
        _record(supplier, "NET_FLOW_OBJECT", uuid=_number("s_suppkey"), baseObject=_base("s_nationkey"), localAddress=F.lit("::"),
                remoteAddress=F.concat(F.lit("10.3.0."), F.col("s_nationkey")), remotePort=F.col("s_nationkey").cast("int"),
                initTcpSeqNum=F.col("s_suppkey").cast("int")),
        _record(part, "FILE_OBJECT", uuid=_number("p_partkey"), baseObject=_base("p_size"), type=F.col("p_brand"),
                size=F.col("p_size").cast("bigint"), hashes=F.when(F.col("p_size") > 10, F.array(F.struct(
                    F.lit("MD5").alias("type"), F.md5("p_name").alias("hash")), F.struct(
                    F.lit("SHA256").alias("type"), F.sha2("p_name", 256).alias("hash"))))),
        _record(part, "REGISTRY_KEY_OBJECT", uuid=_number("p_partkey"), baseObject=_base("p_size"), key=F.col("p_name")),
        _record(part, "MEMORY_OBJECT", uuid=_number("p_partkey"), baseObject=_base("p_size"),
                memoryAddress=F.col("p_partkey"), size=F.col("p_size").cast("bigint")),
        _record(view.table(spark, folder, "customer"), "PRINCIPAL", uuid=_number("c_custkey"),
                userId=F.col("c_name"), groupIds=F.array(F.col("c_mktsegment"))),
        _record(view.events(spark, folder), "TIME_MARKER", tsNanos=timefn.to_micros("ts") * 1000)])


@query
def object_records(spark, folder):
    """Every object table, written from one reading of the records, as (table, id, value)."""
    path = new_path(spark, "record-tables")
    cdm.write_record_tables(_object_records(spark, folder), path)
    base = ("permission", "epoch", F.element_at("properties", "size"))
    values = {
        "network": ("uuid", F.concat_ws(" ", "remote_address", "remote_port", "initial_sequence", *base)),
        "files": ("uuid", F.concat_ws(" ", "file_type", "size", F.col("hashes")[0]["type"], F.col("hashes")[1]["hash"], *base)),
        "registry": ("uuid", F.concat_ws(" ", "key", *base)),
        "memory": ("uuid", F.concat_ws(" ", "memory_address", "size", *base)),
        "principals": ("uuid", F.concat_ws(" ", "user_id", F.element_at("group_ids", 1))),
        "time_markers": ("timestamp_nanos", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))}
    return functools.reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{path}/{name}").select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"), value.alias("value"),
            "session_number") for name, (key, value) in values.items()])


def _registry_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = _record(
        view.table(spark, folder, "part"), "REGISTRY_KEY_OBJECT", uuid=_number("p_partkey"), baseObject=_base("p_size"),
        key=F.col("p_name"), value=_part_value())
    return cdm.record_table(_written_records([rows]), "registry")


@query
def value_components(spark, folder):
    """The recursive values of registry keys, a row for every component at any depth."""
    return cdm.value_components(_registry_records(spark, folder), ["uuid"], "value").select(
        "uuid", "path", "depth", "value_name", "value_bytes", "n_components")


@query
def value_assertions(spark, folder):
    """Who asserts the provenance of values, and who asserts that, as (uuid, path, asserter, sources)."""
    return cdm.value_assertions(_registry_records(spark, folder), ["uuid"], "value").select(
        "uuid", "path", "assertion", "depth", "asserter", F.concat_ws(",", "sources").alias("sources"))


def _session_records(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts, tags, sockets, units and the end of a session."""
    nation, part = view.table(spark, folder, "nation"), view.table(spark, folder, "part")
    supplier, customer = view.table(spark, folder, "supplier"), view.table(spark, folder, "customer")
    return _written_records([
        _record(nation, "HOST", uuid=_number("n_nationkey"), hostName=F.col("n_name"), ta1Version=F.lit("v"), hostType=F.lit("HOST_DESKTOP"),
                hostIdentifiers=F.array(F.struct(F.lit("serial").alias("idType"), _number("n_regionkey").alias("idValue"))),
                interfaces=F.array(F.struct(F.lit("eth0").alias("name"), F.lit("0:1").alias("macAddress"), F.array(
                    F.lit("::"), F.concat(F.lit("10.0.0."), F.col("n_nationkey"))).alias("ipAddresses")))),
        _record(part, "PROVENANCE_TAG_NODE", tagId=_number("p_partkey"), subject=_number("p_size"), prevTagId=_number("p_size"),
                opcode=F.lit("TAG_OP_UNION"), tagIds=F.array(_number("p_size"), F.lit("b'A'")), itag=F.col("p_brand")),
        _record(supplier, "UNKNOWN_PROVENANCE_NODE", upnTagId=_number("s_suppkey"), subject=_number("s_nationkey"),
                properties=F.create_map(F.lit("name"), F.col("s_name"))),
        _record(supplier, "IPC_OBJECT", uuid=_number("s_suppkey"), baseObject=_base("s_nationkey"), type=F.lit("IPC_OBJECT_PIPE_UNNAMED"),
                uuid1=_number("s_nationkey"), fd1=F.lit(3), fd2=F.col("s_nationkey").cast("int")),
        _record(supplier, "PACKET_SOCKET_OBJECT", uuid=_number("s_suppkey"), baseObject=_base("s_nationkey"), proto=F.lit("b'\\x08\\x00'"),
                ifIndex=F.col("s_nationkey").cast("int"), haType=F.lit("b'\\x00\\x01'"), pktType=F.lit("b'\\x04'"), addr=F.lit("b'AB'")),
        _record(customer, "SRC_SINK_OBJECT", uuid=_number("c_custkey"), baseObject=_base("c_nationkey"), type=F.col("c_mktsegment"),
                fileDescriptor=F.col("c_nationkey").cast("int")),
        _record(customer, "UNIT_DEPENDENCY", unit=_number("c_custkey"), dependentUnit=_number("c_nationkey")),
        _record(nation, "END_MARKER", sessionNumber=F.col("n_nationkey").cast("int"), recordCounts=F.create_map(
            F.col("n_name"), F.col("n_regionkey").cast("string")))])


@query
def session_records(spark, folder):
    """The record types that describe hosts, tags, sockets and sessions, as (table, id, value)."""
    path = new_path(spark, "record-tables")
    cdm.write_record_tables(_session_records(spark, folder), path)
    base = ("permission", "epoch", F.element_at("properties", "size"))
    host = F.col("interfaces")[0]
    values = {
        "hosts": ("uuid", F.concat_ws(" ", "host_name", "host_type", F.col("host_identifiers")[0]["idValue"], host["name"],
                                      host["ipAddresses"][1])),
        "tag_nodes": ("tag_id", F.concat_ws(" ", "subject", "prev_tag_id", "opcode", F.concat_ws(",", "tag_ids"), "itag")),
        "unknown_nodes": ("tag_id", F.concat_ws(" ", "subject", F.element_at("properties", "name"))),
        "ipc": ("uuid", F.concat_ws(" ", "type", "uuid1", "uuid2", "fd1", "fd2", *base)),
        "packet_sockets": ("uuid", F.concat_ws(" ", "proto", "if_index", "ha_type", "pkt_type", "addr", *base)),
        "sources_and_sinks": ("uuid", F.concat_ws(" ", "type", "file_descriptor", *base)),
        "unit_dependencies": ("unit", F.col("dependent_unit")),
        "end_markers": ("end_of_session", F.concat_ws(" ", F.map_keys("record_counts")[0], F.map_values("record_counts")[0]))}
    return functools.reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{path}/{name}").select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"), value.alias("value"))
        for name, (key, value) in values.items()])


@query
def record_presence(spark, folder):
    """The profile of records as they were written: a field counts where a record names it."""
    return cdm.record_profile(_session_records(spark, folder))


@query
def member_records(spark, folder):
    """Records whose union came as one struct per member, with ids as bytes."""
    event = F.struct(
        F.unhex(F.md5("subject")).alias("subject"), F.unhex(F.md5(F.col("ordinal").cast("string"))).alias("uuid"),
        "type", F.unhex(F.md5("object")).alias("predicateObject"), (timefn.to_micros("ts") * 1000).alias("timestampNanos"))
    records = view.events(spark, folder).select(
        F.struct(event.alias("member12")).alias("datum"), F.lit("RECORD_EVENT").alias("type"),
        F.lit("h1").alias("hostId"), F.lit(1).alias("sessionNumber"), F.lit("S").alias("source"))
    return cdm.record_table(records, "events").select("uuid", "subject", "object", "type", "ts")


@query
def nanos_to_local(spark, folder):
    nanos = timefn.to_micros("ts") * 1000
    return view.table(spark, folder, "events").select(
        "event_id", timefn.nanos_to_local(nanos).alias("local_ts"))


@query
def record_profile(spark, folder):
    return cdm.record_profile(_envelopes(spark, folder))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = _indexed(spark, folder)
    return graph_docs.graph_documents(nodes, edges)


@query
def graph_documents(spark, folder):
    edge = lambda e: F.concat_ws(" ", e["source"], e["event"], e["target"])
    node = lambda n: F.concat_ws(":", n["id"], n["node_type"])
    return _documents(spark, folder).select(
        "window_start", "part", F.array_join(F.transform("nodes", node), ",").alias("nodes_text"),
        F.array_join(F.transform("edges", edge), ",").alias("edges_text"))


@query
def graph_document_nodes(spark, folder):
    path = new_path(spark, "graphs-json")
    graph_docs.write_graph_documents(_documents(spark, folder), path)
    return graph_docs.document_nodes(graph_docs.read_graph_documents(spark, path)).select(
        "window_start", _big("node_idx"), "node_id", "node_type", "in_degree", "out_degree")


@query
def graph_document_edges(spark, folder):
    path = new_path(spark, "graphs-json")
    graph_docs.write_graph_documents(_documents(spark, folder), path)
    return graph_docs.document_edges(graph_docs.read_graph_documents(spark, path))


@query
def label_table(spark, folder):
    path = new_path(spark, "labels")
    tables.write_table(_labels(spark, folder), path)
    return tables.read_table(spark, path)


@query
def labels_with_graphs(spark, folder):
    all_events = windows.with_tumbling_window(view.events(spark, folder), view.HOUR)
    every = windows.label_windows(
        all_events.select("window_start", "window_end").distinct(), view.ATTACKS)
    with_edges = graph.edges(_pairs(spark, folder, view.HOUR)).select("window_start").distinct()
    return tables.labels_with_graphs(every, with_edges)


@query
def summary_report(spark, folder):
    return reports.global_summary(
        view.events(spark, folder), view.subjects(spark, folder), view.network(spark, folder)
    ).withColumn("time_span_s", _round("time_span_s"))


@query
def findings_report(spark, folder):
    rare = reports.count_by(view.events(spark, folder), "type").select(F.avg("n_events")).scalar()
    return reports.findings(
        view.events(spark, folder), view.subjects(spark, folder), seconds=view.HOUR,
        rare_below=rare).withColumn("rank", _big("rank"))


# --- filters, projections, scalar functions ---------------------------------


@query
def allowed_events(spark, folder):
    return clean.keep_event_types(view.events(spark, folder))


@query
def decoded_ids(spark, folder):
    return _literal_events(spark, folder).select("ordinal", ids.clean_id("subject").alias("node_id"))


@query
def object_ids(spark, folder):
    raw = view.events(spark, folder).select(
        "ordinal", F.when(F.col("ordinal") % 5 == 0, F.lit("")).otherwise(F.col("object")).alias("object"))
    return raw.select("ordinal", ids.clean_object_id("object").alias("object"))


@query
def optional_object(spark, folder):
    bare = view.events(spark, folder).drop("object")
    return clean.with_optional_column(bare, "object").groupBy("type").agg(
        F.count("object").alias("n_objects"), F.count(F.lit(1)).alias("n_rows"))


@query
def half_open_range(spark, folder):
    return view.events(spark, folder).filter(
        windows.in_range("ts", datetime(2024, 1, 10), datetime(2024, 1, 20, 12)))


@query
def unusual_flows(spark, folder):
    return reports.unusual_port_flows(view.network(spark, folder)).select(
        "uuid", "remote_address", _real("remote_port"))


@query
def known_parents(spark, folder):
    return view.subjects(spark, folder).filter(F.col("parent_subject").isNotNull()).select(
        "uuid", "parent_subject")


@query
def floored_times(spark, folder):
    return view.events(spark, folder).select(
        "ordinal", timefn.floor_to("ts", 60).alias("minute"), timefn.floor_to("ts", 1).alias("second"))


@query
def type_shares(spark, folder):
    counts = reports.count_by(view.events(spark, folder), "type")
    return counts.withColumn("share", reports.share_of_total(counts, "n_events", 2))


@query
def event_classes(spark, folder):
    return view.events(spark, folder).groupBy(text.event_class("type").alias("event_class")).agg(
        F.count(F.lit(1)).alias("n_events"))


@query
def verdicts(spark, folder):
    return view.table(spark, folder, "labels").select(
        "doc_id", text.verdict("toxic").alias("verdict"))


@query
def short_ids(spark, folder):
    return view.table(spark, folder, "pages").select(
        "page_id", ids.short_id(F.md5("url")).alias("short_id"))


@query
def display_texts(spark, folder):
    row = view.table(spark, folder, "lineitem")
    return row.select(
        "l_orderkey", "l_linenumber", text.percent("l_discount").alias("discount_text"),
        text.clock("l_shipdate").alias("clock_text"))


@query
def one_hot_events(spark, folder):
    encoded = graph.one_hot(graph.edges(_pairs(spark, folder)))
    return encoded.select("window_start", "source", "target", F.array_join(
        F.transform("event_vector", lambda v: v.cast("int").cast("string")), "").alias("event_bits"))


# --- windows and labels -----------------------------------------------------


@query
def tumbling_windows(spark, folder):
    return windows.tumbling_windows(_graph_events(spark, folder), view.HOUR)


@query
def overlapping_windows(spark, folder):
    return windows.overlapping_statistics(_graph_events(spark, folder), 3 * view.HOUR, view.HOUR)


@query
def overlapping_event_windows(spark, folder):
    """Every event with each window that it falls into."""
    return windows.with_overlapping_windows(
        _graph_events(spark, folder), 90 * 60, view.HOUR).select("window_start", "window_end", "ordinal")


@query
def long_overlapping_windows(spark, folder):
    """Windows of two days from every non-empty minute: 2,880 panes each."""
    return windows.overlapping_statistics(_graph_events(spark, folder), 2 * view.DAY, 60)


@query
def anchored_windows(spark, folder):
    return windows.with_anchored_window(_graph_events(spark, folder), view.HOUR).groupBy(
        "window_id", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n_events"))


@query
def numbered_windows(spark, folder):
    starts = durable(windows.window_starts(_graph_events(spark, folder), view.HOUR))
    return windows.number_windows(starts, view.HOUR)


@query
def graph_windows(spark, folder):
    """Windows of all events against those that keep a graph after the allow-list."""
    every = windows.tumbling_windows(view.events(spark, folder), 600)
    kept = windows.tumbling_windows(_graph_events(spark, folder), 600)
    return every.join(
        kept.select("window_start", F.col("n_events").alias("n_graph_events")), "window_start")


@query
def window_labels(spark, folder):
    spans = windows.with_tumbling_window(_graph_events(spark, folder), view.HOUR).select(
        "window_start", "window_end").distinct()
    return windows.label_windows(spans, view.ATTACKS)


@query
def window_labels_by_table(spark, folder):
    """Attack intervals as a table: ninety minutes from every large value in the log."""
    attacks = view.table(spark, folder, "events").filter("value > 250").select(
        F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 90 minutes")).alias("end"))
    spans = windows.with_tumbling_window(_graph_events(spark, folder), view.HOUR).select(
        "window_start", "window_end").distinct()
    return windows.label_windows(spans, attacks)


@query
def window_statistics(spark, folder):
    nodes = durable(_nodes(spark, folder, view.HOUR))
    return windows.window_statistics(nodes, nodes.select("window_start").distinct())


# --- graphs -----------------------------------------------------------------


@query
def graph_nodes(spark, folder):
    return _nodes(spark, folder).select("window_start", "node_id", "node_type", "first_pos")


@query
def graph_edges(spark, folder):
    return graph.edges(_pairs(spark, folder)).select(
        "window_start", "source", "target", "event", "ts", "n_events", "first_ts", "last_ts")


@query
def overlapping_graph_edges(spark, folder):
    panes = _pairs(spark, folder, view.HOUR)
    return graph.edges(graph.overlapping_interactions(panes, 3 * view.HOUR, view.HOUR)).select(
        "window_start", "source", "target", "event", "ts", "n_events")


@query
def all_types_graph(spark, folder):
    """Without an allow-list every event type makes edges."""
    pairs = dataset.window_pairs(view.events(spark, folder), view.DAY, allowed=None)
    return graph.edges(pairs).select("window_start", "source", "target", "event", "ts", "n_events")


@query
def nan_subject_graph(spark, folder):
    """Events without a subject under a node of their own."""
    events = view.events(spark, folder).withColumn(
        "subject", F.when(F.col("ordinal") % 23 != 0, F.col("subject")))
    pairs = dataset.window_pairs(events, view.DAY, null_subject="nan")
    return graph.edges(pairs).select("window_start", "source", "target", "event", "ts", "n_events")


@query
def isolated_nodes(spark, folder):
    return _nodes(spark, folder).filter("degree = 0").select("window_start", "node_id", "node_type")


@query
def node_index(spark, folder):
    return graph.with_node_index(durable(_nodes(spark, folder))).select(
        "window_start", "node_id", "node_idx")


def _indexed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pairs = durable(_pairs(spark, folder))
    return graph.edges(pairs), durable(graph.with_node_index(durable(graph.nodes(pairs))))


@query
def edge_index(spark, folder):
    return graph.edge_index(*_indexed(spark, folder)).select(
        "window_start", "source_idx", "target_idx", "event")


@query
def edge_index_placeholder(spark, folder):
    pairs = durable(_pairs(spark, folder, 600))
    edges = graph.edges(pairs)
    nodes = durable(graph.with_node_index(durable(graph.nodes(pairs))))
    starts = pairs.select("window_start").distinct()
    return graph.edge_index_or_placeholder(graph.edge_index(edges, nodes), starts)


@query
def undirected_pairs(spark, folder):
    return graph.undirected(graph.edges(_pairs(spark, folder)))


# --- node features ----------------------------------------------------------


@query
def basic_node_features(spark, folder):
    return _nodes(spark, folder).select(
        "window_start", "node_id", "node_type_flag", "degree", "in_degree", "out_degree",
        "event_count", "event_type_count", _round("ts_var", 2).alias("ts_var"), "activity_rate")


@query
def time_node_features(spark, folder):
    return _nodes(spark, folder).select(
        "window_start", "node_id", *[
            _round(c, 9 if c == "avg_ts_gap" else 6).alias(c)
            for c in ("avg_ts_gap", "last_seen_delta", "time_sin", "time_cos")])


@query
def burst_flags(spark, folder):
    ticks = temporal.out_ticks(graph.edges(_pairs(spark, folder)))
    return temporal.bursts(ticks, view.BURST_RUN, view.BURST_WITHIN_US)


@query
def temporal_entropy(spark, folder):
    ticks = temporal.out_ticks(graph.edges(durable(_pairs(spark, folder))))
    return temporal.gap_entropy(ticks).withColumn("temporal_entropy", _round("temporal_entropy"))


def _measure(name: str) -> Query:
    def run(spark, folder):
        return centrality(durable(_pairs(spark, folder)), measures=[name]).select(
            "window_start", "node_id", _round(name, 9).alias(name))
    run.__name__ = name
    return query(run)


closeness, betweenness, pagerank, cluster_coeff = map(
    _measure, ["closeness", "betweenness", "pagerank", "cluster_coeff"])


@query
def centrality_by_joins(spark, folder):
    """The way for windows beyond a task, taken by every window."""
    return centrality(durable(_pairs(spark, folder)), task_pairs=0).select(
        "window_start", "node_id", *[_round(m, 9).alias(m) for m in MEASURES])


@query
def cluster_coeff_by_joins(spark, folder):
    return wide_clustering(graph.edges(durable(_pairs(spark, folder)))).withColumn(
        "cluster_coeff", _round("cluster_coeff", 9))


@query
def all_node_features(spark, folder):
    # Ratios of small numbers get many digits, so that none lies on a rounding edge.
    digits = {"ts_var": 2, "time_sin": 6, "time_cos": 6, "temporal_entropy": 6}
    features = node_features(_pairs(spark, folder), view.BURST_RUN, view.BURST_WITHIN_US)
    return features.select(
        "window_start", "node_id", *[
            _round(F.col(c).cast("double"), digits.get(c, 9)).alias(c) for c in NODE_FEATURES])


# --- sequences --------------------------------------------------------------


def _scored(spark: SparkSession, folder: str) -> Explanation:
    nodes = durable(_nodes(spark, folder, view.HOUR))
    labels = durable(dataset.labelled_windows(nodes, view.HOUR, view.ATTACKS))
    return Explanation(nodes, labels, WEIGHTS, BIAS, CUTOFF)


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.sequence_steps(durable(_labels(spark, folder)))


@query
def sequence_windows(spark, folder):
    return sequences.sequences(_steps(spark, folder)).select(
        "sequence_id", F.array_join("window_ids", ",").alias("window_ids"))


@query
def sequence_labels(spark, folder):
    return sequences.sequences(_steps(spark, folder)).select("sequence_id", "label")


@query
def sequence_members(spark, folder):
    scored = _scored(spark, folder)
    nodes = scored.nodes.select("window_start", "node_id", "degree")
    return sequences.sequence_members(scored.steps, nodes).groupBy(
        "sequence_id", "step").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("degree"))


@query
def centre_windows(spark, folder):
    return sequences.centre_windows(_steps(spark, folder))


# --- exploration and patterns -----------------------------------------------


@query
def type_distribution(spark, folder):
    return reports.type_distribution(view.events(spark, folder), 10)


@query
def time_range(spark, folder):
    return reports.time_range(view.events(spark, folder)).withColumn(
        "duration_s", _round("duration_s"))


@query
def events_per_minute(spark, folder):
    return reports.events_per_minute(view.events(spark, folder))


@query
def most_active_subjects(spark, folder):
    return reports.most_active_subjects(view.events(spark, folder), 10)


@query
def described_subjects(spark, folder):
    return reports.described_subjects(
        reports.most_active_subjects(view.events(spark, folder), 10), view.subjects(spark, folder))


@query
def top_types_over_time(spark, folder):
    return reports.top_types_over_time(view.events(spark, folder), 3)


@query
def address_counts(spark, folder):
    return reports.address_counts(view.network(spark, folder))


def _beside(exact: DataFrame, estimated: DataFrame, columns: list[str]) -> DataFrame:
    """(slices, name, n_exact, within_bound) of two tables of counts with one row per set of slices."""
    def long(counts: DataFrame, value: str) -> DataFrame:
        return counts.unpivot(["slices"], columns, "name", value)
    bound = 4 * reports.sketch_error() * F.col("n_exact")
    return long(exact, "n_exact").join(long(estimated.select("slices", *columns), "n_sketched"), ["slices", "name"]).select(
        "slices", "name", "n_exact", (F.abs(F.col("n_sketched") - F.col("n_exact")) <= bound).alias("within_bound"))


@query
def sketched_activity(spark, folder):
    """Distinct subjects, objects and types by day, from stored sketches of minutes."""
    columns = ["subject", "object", "type"]
    events = view.events(spark, folder)
    path = new_path(spark, "sketches")
    reports.distinct_sketches(events, columns, F.window("ts", "60 seconds")["start"]).write.parquet(path)
    day = F.date_format("slice", "yyyy-MM-dd").alias("slices")
    stored = spark.read.parquet(path).withColumn("slices", day)
    exact = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("slices")).agg(
        *[F.count_distinct(c).alias(c) for c in columns])
    return _beside(exact, reports.sketched_counts(stored, columns, ["slices"]), columns)


@query
def sketched_addresses(spark, folder):
    """Distinct addresses over all flows and over those of known remote ports, from sketches by port."""
    columns = ["local_address", "remote_address"]
    flows = view.network(spark, folder)
    path = new_path(spark, "sketches")
    reports.distinct_sketches(flows, columns, F.col("remote_port")).write.parquet(path)
    stored = spark.read.parquet(path)
    ranges = {"all": F.lit(True), "known": F.col("port").isNotNull(), "low": F.col("port") < 500}

    def over(rows: DataFrame, port: str, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [
            count(rows.withColumn("port", F.col(port)).filter(inside)).withColumn("slices", F.lit(name))
            for name, inside in ranges.items()])

    return _beside(
        over(flows, "remote_port", lambda rows: rows.agg(*[F.count_distinct(c).alias(c) for c in columns])),
        over(stored, "slice", lambda rows: reports.sketched_counts(rows, columns)), columns)


@query
def top_remote_addresses(spark, folder):
    return reports.top_remotes(view.network(spark, folder), "remote_address", 10)


@query
def top_remote_ports(spark, folder):
    return reports.top_remotes(view.network(spark, folder), "remote_port", 10)


@query
def burst_minutes(spark, folder):
    return reports.burst_minutes(view.events(spark, folder), seconds=60).withColumn(
        "ratio", _round("ratio"))


@query
def rare_types(spark, folder):
    """Rare against the mean count, so that the cut falls inside the carrier's types."""
    events = view.events(spark, folder)
    mean = reports.count_by(events, "type").select(F.avg("n_events")).scalar()
    return reports.rare_types(events, mean)


@query
def parent_coverage(spark, folder):
    return reports.parent_coverage(view.subjects(spark, folder))


@query
def top_parents(spark, folder):
    return reports.top_parents(view.subjects(spark, folder), 5)


@query
def repeated_remotes(spark, folder):
    return reports.top_remotes(view.network(spark, folder), "remote_address", 10, at_least=2)


@query
def unusual_ports(spark, folder):
    return reports.unusual_ports(view.network(spark, folder))


@query
def long_gaps(spark, folder):
    return reports.long_gaps(view.events(spark, folder), 600, 5).withColumn("gap_s", _round("gap_s"))


@query
def all_long_gaps(spark, folder):
    return reports.long_gaps(view.events(spark, folder), 60, None).withColumn(
        "gap_s", _round("gap_s"))


@query
def investigation_targets(spark, folder):
    events = view.events(spark, folder)
    mean = reports.count_by(events, "type").select(F.avg("n_events")).scalar()
    return reports.investigation_targets(events, view.subjects(spark, folder), view.HOUR, mean)


# --- propagation and scoring ------------------------------------------------


@query
def edge_type_counts(spark, folder):
    return propagation.edge_type_counts(graph.edges(_pairs(spark, folder)))


@query
def neighbour_means(spark, folder):
    pairs = durable(_pairs(spark, folder))
    nodes = graph.basic_features(graph.nodes(pairs))
    out = propagation.neighbour_means(
        nodes, graph.edges(pairs), ["in_degree", "event_type_count"], hops=2)
    return out.select("window_start", "node_id", *[
        _round(c, 9).alias(c) for c in out.columns if c.endswith(("_h1", "_h2"))])


@query
def graph_embedding(spark, folder):
    nodes = _nodes(spark, folder, view.HOUR)
    return propagation.graph_embedding(nodes, list(WEIGHTS)).select(
        "window_start", "n_nodes", *[_round(c).alias(c) for c in WEIGHTS])


@query
def temporal_attention(spark, folder):
    return _scored(spark, folder).attention().select(
        "sequence_id", "step", _round("score").alias("score"), _round("weight").alias("weight"))


@query
def attended_embedding(spark, folder):
    return propagation.attended_embedding(_scored(spark, folder).attention(), list(WEIGHTS)).select(
        "sequence_id", "label", *[_round(c).alias(c) for c in WEIGHTS])


@query
def sequence_classifier(spark, folder):
    """Train on the training split, then score every sequence."""
    rows = durable(propagation.step_matrix(_scored(spark, folder).members(), list(WEIGHTS)))
    parts = durable(scoring.boundary_split(rows))
    features = [c for c in rows.columns if c not in ("sequence_id", "label")]
    model = scoring.train_classifier(parts.filter("split = 'train'"), features)
    return scoring.score_sequences(model, rows)


@query
def sequence_scores(spark, folder):
    """Every sequence scored by given coefficients over its three steps."""
    rows = propagation.step_matrix(_scored(spark, folder).members(), list(WEIGHTS))
    return scoring.score_linear(rows, STEP_WEIGHTS, BIAS, 0.673).select(
        "sequence_id", "label", _round("score").alias("score"), "prediction")


@query
def separable_classifier(spark, folder):
    """Learn from earlier sequences which later ones have a busier mean step than the earlier ones had."""
    rows = durable(propagation.step_matrix(_scored(spark, folder).members(), list(WEIGHTS)))
    features = [c for c in rows.columns if c not in ("sequence_id", "label")]
    parts = durable(scoring.boundary_split(rows))
    load = sum((F.col(f"{c}_t{step}") for step in range(3) for c in ("in_degree", "event_type_count")), F.lit(0.0))
    usual = parts.filter("split = 'train'").select(F.avg(load)).scalar()
    marked = durable(parts.withColumn("label", (load > usual).cast("int")))
    model = scoring.train_classifier(marked.filter("split = 'train'"), features)
    test = scoring.score_sequences(model, marked.filter("split = 'test'"))
    return test.agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("label").alias("n_busy"),
        (F.avg((F.col("prediction") == F.col("label")).cast("double")) >= 0.9).alias("accurate"))


@query
def stratified_split(spark, folder):
    return scoring.stratified_split(
        view.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "quality", seed=7)


@query
def ordered_split(spark, folder):
    return scoring.stratified_split(
        view.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "quality",
        time_order=True)


@query
def boundary_split(spark, folder):
    rows = sequences.sequences(_steps(spark, folder)).select("sequence_id", "label")
    return scoring.boundary_split(rows)


@query
def class_weights(spark, folder):
    labels = view.table(spark, folder, "labels")
    return scoring.with_class_weight(labels, "toxic").select("doc_id", "class_weight")


@query
def evaluation(spark, folder):
    scored = _scored(spark, folder)
    return scoring.evaluation(scored.predictions(scored.attention())).select(
        "n_rows", *[_round(c).alias(c) for c in ("accuracy", "precision", "recall")])


@query
def node_importance(spark, folder):
    return _scored(spark, folder).window_importance()


# --- stories ----------------------------------------------------------------


@query
def severities(spark, folder):
    scored = _scored(spark, folder)
    attention = durable(scored.rounded_attention())
    weights = story.step_weights(attention)
    return scored.predictions(attention).join(weights, "sequence_id").select(
        "sequence_id", "prediction",
        story.severity(F.col("weights"), F.col("prediction")).alias("severity"))


@query
def flagged_steps(spark, folder):
    return story.flagged_steps(_scored(spark, folder).largest()).withColumn("step", _big("step"))


@query
def event_techniques(spark, folder):
    return story.event_techniques(
        windows.with_tumbling_window(view.events(spark, folder), view.HOUR))


@query
def stories(spark, folder):
    return _scored(spark, folder).stories().select("sequence_id", "severity", F.size("techniques").cast("bigint").alias("n_techniques"), "story")


@query
def top_nodes(spark, folder):
    scored = _scored(spark, folder)
    return story.top_nodes(scored.foremost(5), scored.nodes, 5).select(
        "sequence_id", _big("rank"), _big("step"), "node_id", "node_type", "importance",
        "score_text")


@query
def edge_timeline(spark, folder):
    return story.timeline(graph.edges(_pairs(spark, folder)))


@query
def step_weight_texts(spark, folder):
    weights = story.step_weights(durable(_scored(spark, folder).rounded_attention()))
    return weights.select("sequence_id", text.step_weights_text("weights").alias("weights_text"))


@query
def hot_nodes(spark, folder):
    scores = durable(_scored(spark, folder).window_importance())
    return story.hot_nodes(scores).withColumn("heat", _round("heat"))


@query
def subject_nodes(spark, folder):
    return story.by_role(_nodes(spark, folder), "subject").select("window_start", "node_id", "degree")


@query
def object_nodes(spark, folder):
    return story.by_role(_nodes(spark, folder), "object").select("window_start", "node_id", "degree")


@query
def resolved_edges(spark, folder):
    pairs = durable(_pairs(spark, folder))
    nodes = graph.basic_features(graph.nodes(pairs)).select(
        "window_start", "node_id", "node_type", "degree")
    return graph.resolved_edges(graph.edges(pairs), nodes).select(
        "window_start", "source", "target", "event",
        F.col("source_node.node_type").alias("source_type"),
        F.col("target_node.node_type").alias("target_type"),
        F.col("source_node.degree").alias("source_degree"),
        F.col("target_node.degree").alias("target_degree"))


def _explanations(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder)
    attention = durable(scored.rounded_attention())
    index = graph.with_node_index(scored.nodes).select("window_start", "node_id", "node_idx")
    indexed = scored.importance().join(index, ["window_start", "node_id"])
    return explanations.explanation_documents(
        scored.predictions(attention), attention, indexed)


@query
def explanation_documents(spark, folder):
    path = new_path(spark, "explanations")
    explanations.write_explanations(_explanations(spark, folder), path)
    return explanations.importance_rows(explanations.read_explanations(spark, path)).withColumns(
        {"step": _big("step"), "node_idx": _big("node_idx")})


@query
def window_lookup(spark, folder):
    """One day's edges from the partitioned edge table."""
    pairs = durable(_pairs(spark, folder))
    path = new_path(spark, "graph")
    graph_docs.write_graph_tables(graph.nodes(pairs), graph.edges(pairs), path)
    _, edges = graph_docs.read_graph_tables(spark, path)
    day = datetime(2024, 1, 15).date()
    return story.lookup(edges, "day", day).select("window_start", "source", "target", "event", "ts")


def _stored_by_sequence(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    path = new_path(spark, name)
    story.write_by_sequence(table, path)
    return spark.read.parquet(path)


@query
def story_lookup(spark, folder):
    told = _scored(spark, folder).stories().select("sequence_id", "severity", "story")
    return story.lookup_sequence(_stored_by_sequence(spark, told, "stories"), 5)


@query
def explanation_lookup(spark, folder):
    documents = _stored_by_sequence(spark, _explanations(spark, folder), "explanations")
    return explanations.importance_rows(story.lookup_sequence(documents, 5)).withColumns(
        {"step": _big("step"), "node_idx": _big("node_idx")})


@query
def graph_lookup(spark, folder):
    """The graph of a sequence's centre window, from the edge table of that day."""
    pairs = durable(_pairs(spark, folder, view.HOUR))
    path = new_path(spark, "graph")
    graph_docs.write_graph_tables(graph.nodes(pairs), graph.edges(pairs), path)
    _, edges = graph_docs.read_graph_tables(spark, path)
    steps = _stored_by_sequence(spark, _steps(spark, folder), "steps")
    centre = story.lookup_sequence(steps, 5).filter("step = 1").select("window_start").scalar()
    return edges.filter((F.col("day") == centre.cast("date")) & (F.col("window_start") == centre)).select(
        "window_start", "source", "target", "event", "ts")


# --- investigations ---------------------------------------------------------


@query
def events_in_attack(spark, folder):
    return lineage.events_between(view.events(spark, folder), *view.ATTACKS[0])


@query
def trigger_events(spark, folder):
    return lineage.trigger_events(view.events(spark, folder), view.subjects(spark, folder)).select(
        "ordinal", "ts", "subject", _real("cid"), "subject_type", "parent_subject")


@query
def subject_actions(spark, folder):
    return lineage.subject_actions(view.events(spark, folder))


@query
def process_ancestry(spark, folder):
    return lineage.ancestry(view.subjects(spark, folder))


@query
def process_descent(spark, folder):
    roots = spark.range(1).select(F.lit("n1").alias("uuid"))
    return lineage.descent(view.subjects(spark, folder), roots)


@query
def subject_connections(spark, folder):
    return lineage.connections(view.events(spark, folder), view.flows(spark, folder))


@query
def read_then_send(spark, folder):
    return lineage.read_then_send(view.events(spark, folder), view.DAY * 1_000_000).withColumn(
        "lag_s", _round("lag_s"))


@query
def forward_reach(spark, folder):
    return lineage.forward_reach(view.events(spark, folder), "n7").select(
        "node", timefn.from_micros("reached_us").alias("reached_at"))


@query
def run_key_writes(spark, folder):
    return lineage.run_key_writes(view.events(spark, folder), view.registry(spark, folder))


@query
def deduplicated_records(spark, folder):
    feed = view.events(spark, folder).withColumn("uuid", F.concat(F.lit("e"), F.col("ordinal")))
    again = feed.filter("type = 'EVENT_WRITE'")
    return clean.drop_duplicate_records(feed.unionByName(again))


@query
def record_count_check(spark, folder):
    """The end marker tells the count of all events; the allow-list removes one type."""
    events = view.events(spark, folder)
    per_type = reports.count_by(events, "type")
    marker = per_type.agg(F.map_from_entries(F.collect_list(
        F.struct("type", F.col("n_events").cast("string")))).alias("record_counts"))
    return cdm.count_differences(marker, clean.keep_event_types(events))


# --- streams ----------------------------------------------------------------


@query
def live_window_counts(spark, folder):
    return live.run_to_end(live.live_window_counts(
        view.event_stream(spark, folder), view.HOUR, "2 hours"), "window-counts")


@query
def live_burst_flags(spark, folder):
    baseline = live.burst_baseline(view.events(spark, folder), view.HOUR)
    counts = live.live_window_counts(view.event_stream(spark, folder), view.HOUR, "2 hours")
    return live.run_to_end(live.live_burst_flags(counts, baseline, 1.5), "burst-flags")


@query
def live_node_features(spark, folder):
    out = new_path(spark, "live-features")
    pairs = live.closed_interactions(
        clean.graph_events(view.event_stream(spark, folder)), view.DAY, "2 hours")
    live.run_to_end(pairs, "live-features-run", live.feature_writer(
        out, burst_run=view.BURST_RUN, burst_within_us=view.BURST_WITHIN_US))
    return spark.read.parquet(out).select(
        "window_start", "node_id", "in_degree", "out_degree", "event_type_count",
        _round("pagerank", 9).alias("pagerank"), _round("closeness", 9).alias("closeness"))


@query
def live_sequences(spark, folder):
    host = F.concat(F.lit("h"), F.pmod(F.substring("subject", 2, 20).cast("bigint"), F.lit(8)))
    closed = live.live_window_counts(
        view.event_stream(spark, folder).withColumn("host_id", host), view.HOUR, "2 hours", ["host_id"])
    windows_table = live.run_to_end(closed, "closed-windows")
    labelled = windows.label_windows(windows_table, view.ATTACKS).select(
        "host_id", "window_start", "label")
    path = new_path(spark, "closed-windows-labelled")
    labelled.write.parquet(path)
    stream = spark.readStream.schema(labelled.schema).parquet(path)
    return live.run_to_end(live.live_sequences(stream), "live-sequences").select(
        "host_id", timefn.from_micros("first_us").alias("first_start"),
        timefn.from_micros("last_us").alias("last_start"), "label")


def _out_of_order(table: DataFrame, start: str, name: str, files: int = 4) -> DataFrame:
    """A table as a stream of batches in rough order: every row up to two days early or late.

    A last row of another key, long after the others, lets the watermark pass them all.
    """
    spark = table.sparkSession
    path = new_path(spark, name)
    jitter = F.pmod(F.xxhash64(*table.columns), F.lit(4 * view.DAY)) - 2 * view.DAY
    placed = durable(table.withColumn("__at", timefn.to_micros(start) + jitter * 1_000_000))
    cuts = placed.select(F.percentile("__at", [i / files for i in range(1, files)])).first()[0] or []
    number = functools.reduce(lambda a, b: a + b, [(F.col("__at") > cut).cast("int") for cut in cuts], F.lit(0))
    for i in range(files):
        placed.filter(number == i).drop("__at").coalesce(1).write.parquet(f"{path}/b{i}")
    times = [c for c, kind in table.dtypes if kind == "timestamp_ntz"]
    last = [F.expr("timestamp_ntz'2100-01-01 00:00:00'").alias(c) if c in times else F.lit(None).cast(kind).alias(c)
            for c, kind in table.dtypes]
    spark.range(1).select(*last).fillna("end", ["host_id"]).fillna(0).write.parquet(f"{path}/b{files}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(path)


def _host_stream(spark: SparkSession, folder: str) -> DataFrame:
    host = F.concat(F.lit("h"), F.pmod(F.substring("subject", 2, 20).cast("bigint"), F.lit(8)))
    return view.event_stream(spark, folder).withColumn("host_id", host)


@query
def live_ordered_sequences(spark, folder):
    """Sequences of windows that arrive out of order."""
    closed = live.run_to_end(live.live_window_counts(
        _host_stream(spark, folder), view.HOUR, "2 hours", ["host_id"]), "closed-windows")
    spans = windows.label_windows(closed, view.ATTACKS).select(
        "host_id", F.col("window_start").alias("start"), F.col("window_start").alias("end"), "label")
    with live.rocksdb_state(spark):
        return live.run_to_end(live.ordered_runs(
            _out_of_order(spans, "start", "shuffled-windows"), "host_id", "5 days"), "ordered-sequences").select(
            F.col("key").alias("host_id"), timefn.from_micros("first_us").alias("first_start"),
            timefn.from_micros("last_us").alias("last_start"), "label")


@query
def live_gaps(spark, folder):
    """Silences of each host, from activity sessions that arrive out of order."""
    sessions = live.run_to_end(live.live_sessions(
        _host_stream(spark, folder), "20 minutes", "2 hours", "host_id"), "sessions")
    with live.rocksdb_state(spark):
        return live.run_to_end(live.live_gaps(
            _out_of_order(sessions, "start", "shuffled-sessions"), "host_id", "5 days"), "gaps").select(
            F.col("key").alias("host_id"), "gap_start", "gap_end", _round("gap_s").alias("gap_s"))


def _marked_records(spark: SparkSession, folder: str, steps: int = 4) -> DataFrame:
    """The log as a stream of records of two hosts, in ``steps`` spans of time.

    After each span but the last, host h0 tells how far it is; h1 does so once, ends
    its session after the second span and is not heard of again.
    """
    host = F.concat(F.lit("h"), F.substring("subject", 2, 20).cast("bigint") % 2)
    log = view.events(spark, folder).select(host.alias("host"), "ordinal", "type", timefn.to_micros("ts").alias("us"))
    first, last = log.select(F.min("us"), F.max("us")).first()
    first, last = first or 0, last or 0
    cuts = [first + (last - first) * i // steps for i in range(steps)] + [last + 1]
    path = new_path(spark, "marked-records")

    def write(name: str, host: Column, kind: str, rows: DataFrame, datum: Column) -> None:
        rows.select(F.to_json(F.struct(
            F.lit(kind).alias("type"), host.alias("hostId"), F.lit(1).alias("sessionNumber"), datum.alias("datum")
        )).alias("value")).write.text(f"{path}/{name}")

    one = spark.range(1)
    for i in range(steps):
        span = log.filter((F.col("us") >= cuts[i]) & (F.col("us") < cuts[i + 1]) & ((F.col("host") == "h0") | F.lit(i < 2)))
        write(f"events{i}", F.col("host"), "RECORD_EVENT", span, F.struct(
            F.concat(F.lit("e"), "ordinal").alias("uuid"), "type", (F.col("us") * 1000).alias("timestampNanos")))
        passed = F.struct(F.lit(cuts[i + 1] * 1000).alias("tsNanos"))
        if i < steps - 1:
            write(f"marker{i}", F.lit("h0"), "RECORD_TIME_MARKER", one, passed)
        if i == 0:
            write("other", F.lit("h1"), "RECORD_TIME_MARKER", one, passed)
        if i == 1:
            write("end", F.lit("h1"), "RECORD_END_MARKER", one, F.struct(F.lit(1).alias("sessionNumber")))
    return spark.readStream.schema(cdm.ENVELOPE).option("maxFilesPerTrigger", 16).option(
        "recursiveFileLookup", "true").json(path)


@query
def live_marker_windows(spark, folder):
    """Windows that close by each host's markers, whatever the other host does."""
    with live.rocksdb_state(spark):
        counts = live.run_to_end(live.windows_by_markers(
            _marked_records(spark, folder), view.HOUR, "UTC", parts=4), "marker-windows")
    return counts.groupBy("host_id", "window_start", "window_end", "late").agg(F.sum("n_events").alias("n_events"))


@query
def live_deduplicated(spark, folder):
    feed = view.event_stream(spark, folder).withColumn("uuid", F.concat(F.lit("e"), F.col("ordinal")))
    feed = feed.unionByName(feed.filter("type = 'EVENT_WRITE'"))  # copies, as a feed may send
    return live.run_to_end(live.deduplicated(feed, "2 hours"), "live-dedup")
