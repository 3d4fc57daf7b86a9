import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hostweave.functions.durable import durable
from hostweave.operators import graph, windows
from hostweave.plans import dataset
from hostweave.sources import cdm, graph_docs, tables
from tests.conftest import T0, rows


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_event_csv(spark, tmp_path):
    path = write(tmp_path, "events.csv", (
        "ordinal,timestamp,type,subject,predicate_object,size\n"
        "0,2019-05-07 11:10:41.912,EVENT_READ,b'\\xf0\\n\\\\',\"b\"\"it's,\\t\"\"\",36\n"
        "1,2019-05-07 11:10:42,EVENT_OPEN,None,,\n"
        "2,not a time,EVENT_OPEN,plain,None,\n"))
    with pytest.raises(Exception, match="ts is not a TIMESTAMP_NTZ: not a time"):
        tables.read_events(spark, path).collect()
    got = tables.read_events(spark, path, reject=True).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [
        (0, datetime(2019, 5, 7, 11, 10, 41, 912000), "EVENT_READ", r"b'\xf0\n\\'", "b\"it's,\\t\""),
        (1, datetime(2019, 5, 7, 11, 10, 42), "EVENT_OPEN", None, None)]
    assert rows(tables.rejected_events(spark, path), "ordinal", "ts") == [("2", "not a time")]


def test_missing_columns_are_errors(spark, tmp_path):
    path = write(tmp_path, "e.csv", "ordinal,when,type,subject\n0,2019-05-07 11:10:42,EVENT_OPEN,a\n")
    with pytest.raises(ValueError, match="missing columns: ts"):
        tables.read_events(spark, path)
    path = write(tmp_path, "s.csv", "type,cid\nSUBJECT_PROCESS,1\n")
    with pytest.raises(ValueError, match="missing columns: uuid"):
        tables.read_subjects(spark, path)


def test_header_order_of_each_file(spark, tmp_path):
    write(tmp_path, "a.csv", "ordinal,timestamp,type,subject,predicate_object\n0,2019-05-07 11:10:42,EVENT_OPEN,a,b\n")
    write(tmp_path, "b.csv", "predicate_object,subject,type,timestamp,ordinal\nd,c,EVENT_READ,2019-05-07 11:10:43,1\n")
    assert rows(tables.read_events(spark, str(tmp_path)), "ordinal", "type", "subject", "object") == [
        (0, "EVENT_OPEN", "a", "b"), (1, "EVENT_READ", "c", "d")]


def test_order_of_files_and_lines(spark, tmp_path):
    """Without order numbers rows are numbered by file name and line, over all blocks."""
    lines = [f"2019-05-07 11:10:42,EVENT_OPEN,s{i},o{i}" for i in range(3000)]
    for n, part in enumerate((lines[:10], lines[10:2500], lines[2500:])):
        write(tmp_path, f"part-{n}.csv", "\n".join(["timestamp,type,subject,predicate_object", *part]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = rows(tables.read_events(spark, str(tmp_path)), "ordinal", "subject")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f"s{i}") for i in range(3000)]


def test_missing_object_column(spark, tmp_path):
    path = write(tmp_path, "e.csv", "ordinal,timestamp,type,subject\n0,2019-05-07 11:10:42,EVENT_OPEN,a\n")
    assert rows(tables.read_events(spark, path), "subject", "object") == [("a", None)]


def test_subject_and_network_csv(spark, tmp_path):
    path = write(tmp_path, "s.csv", (
        "uuid,type,cid,parent_subject,local_principal,start_timestamp,cmd_line,privilege_level,source\n"
        "b'a',SUBJECT_PROCESS,5504,None,None,2019-05-07 11:10:41.912,\"run, \"\"now\"\"\",,S\n"))
    row = tables.read_subjects(spark, path).first()
    assert (row.cid, row.parent_subject, row.cmd_line, row.privilege_level) == (5504, None, 'run, "now"', None)
    path = write(tmp_path, "n.csv", (
        "uuid,local_address,local_port,remote_address,remote_port,ip_protocol,file_descriptor,source\n"
        "f1,::,53522,,,17,,S\nf2,::,1,10.0.0.1,53.0,17,,S\n"))
    assert [tuple(r) for r in tables.read_network(spark, path).orderBy("uuid").collect()] == [
        ("f1", "::", 53522, None, None, 17, None, "S"), ("f2", "::", 1, "10.0.0.1", 53, 17, None, "S")]


@pytest.mark.parametrize("port", ["53.7", "3e9", "Infinity", "x"])
def test_whole_numbers_only(spark, tmp_path, port):
    path = write(tmp_path, "n.csv", (
        "uuid,local_address,local_port,remote_address,remote_port,ip_protocol,file_descriptor,source\n"
        f"f1,::,53522,10.0.0.1,{port},17,,S\n"))
    with pytest.raises(Exception, match="remote_port is not a INT"):
        tables.read_network(spark, path).collect()


def test_registry_values(spark):
    text = ("{'size': -1, 'type': 'VALUE_TYPE_SRC', 'valueDataType': 'VALUE_DATA_TYPE_INT', 'isNull': False,"
            " 'name': '673', 'runtimeDataType': None, 'valueBytes': b'\\x00', 'provenance': None}")
    df = spark.createDataFrame([("r1", "k", text, "S")], "uuid string, key string, value_name string, source string")
    assert rows(tables.registry_values(df)) == [
        ("r1", "k", -1, "VALUE_TYPE_SRC", "VALUE_DATA_TYPE_INT", False, "673", "\\x00")]
    text = "{'size': 3, 'isNull': True, 'name': \"it's, x\", 'valueBytes': None}"
    df = spark.createDataFrame([("r2", "k", text, "S")], "uuid string, key string, value_name string, source string")
    assert tables.registry_values(df).first()[2:] == (3, None, None, True, "it's, x", None)


def record(kind, **datum):
    return json.dumps({"datum": datum, "CDMVersion": "20", "type": f"RECORD_{kind}", "hostId": "h",
                       "sessionNumber": 1, "source": "S"})


def records(spark, tmp_path):
    path = write(tmp_path, "r.json", "\n".join([
        record("EVENT", uuid="b'e1'", type="EVENT_SENDTO", subject="b's'", predicateObject="b\"o'\"",
               timestampNanos=1557241844683000000, properties={"end": "1"}),
        record("EVENT", uuid="b'e2'", type="EVENT_OPEN", subject="b's'", timestampNanos=1557241844683000000),
        record("SUBJECT", uuid="b's'", type="SUBJECT_THREAD", cid=6616, startTimestampNanos=1557241841912000000),
        record("NET_FLOW_OBJECT", uuid="b'f'", localAddress="::", localPort=5),
        record("MEMORY_OBJECT", uuid="b'm'", memoryAddress=77, size=8),
        record("END_MARKER", sessionNumber=1, recordCounts={"EVENT_SENDTO": "1", "EVENT_OPEN": "3"})]))
    return cdm.read_records(spark, path)


def test_records_split_by_type(spark, tmp_path):
    recs = records(spark, tmp_path)
    events = cdm.record_table(recs, "events")
    assert rows(events, "uuid", "ts", "type", "subject", "object", "host_id")[0] == (
        "6531", datetime(2019, 5, 7, 11, 10, 44, 683000), "EVENT_SENDTO", "73", "6f27", "h")
    assert rows(cdm.record_table(recs, "subjects"), "cid", "start_timestamp") == [
        (6616, datetime(2019, 5, 7, 11, 10, 41, 912000))]
    assert rows(cdm.record_table(recs, "memory"), "memory_address", "size") == [(77, 8)]
    cdm.write_record_tables(recs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/network")).first().local_port == 5


def test_record_profile_and_counts(spark, tmp_path):
    recs = records(spark, tmp_path)
    profile = {r["item"]: (r.n_records, r.share) for r in cdm.record_profile(recs).collect()}
    assert profile["record.type=RECORD_EVENT"] == (2, 33.3)
    assert profile["uuid"] == (5, 83.3) and "key" not in profile
    check = cdm.count_differences(cdm.record_table(recs, "end_markers"), cdm.record_table(recs, "events"))
    assert rows(check) == [("EVENT_OPEN", 3, 1, 2), ("EVENT_SENDTO", 1, 1, 0)]


def test_graph_documents_round_trip_in_parts(spark, log, tmp_path):
    events = log((0.1, "READ", "a", "b"), (0.2, "OPEN", "c", "a"), (0.3, "READ", "c", "b"), (1.5, "READ", "z", None))
    pairs = durable(graph.interactions(windows.with_tumbling_window(events)))
    nodes, edges = graph.with_node_index(graph.nodes(pairs)), graph.edges(pairs)
    for size in (100_000, 2):
        docs = graph_docs.graph_documents(nodes, edges, size)
        path = str(tmp_path / f"g{size}")
        graph_docs.write_graph_documents(docs, path)
        back = graph_docs.read_graph_documents(spark, path)
        assert rows(graph_docs.document_edges(back)) == rows(
            edges, "window_start", "source", "target", "event", "ts")
        assert rows(graph_docs.document_nodes(back, size), "window_start", "node_idx", "node_id") == rows(
            nodes, "window_start", "node_idx", "node_id")
        assert docs.groupBy("window_start").count().agg(F.max("count")).first()[0] == (1 if size > 2 else 2)


def test_build_writes_all_tables(spark, log, tmp_path):
    events = log(*[(s, "READ", f"n{s % 3}", f"n{s % 2}") for s in range(6)])
    folder = str(tmp_path / "model")
    dataset.build(events, folder, attacks=[(T0, T0)])
    labels = tables.read_table(spark, f"{folder}/labels")
    assert [r.label for r in labels.orderBy("window_id").collect()] == [1, 0, 0, 0, 0, 0]
    assert tables.read_table(spark, f"{folder}/sequences").select("sequence_id").distinct().count() == 4
    assert tables.read_table(spark, f"{folder}/nodes").count() == labels.selectExpr("sum(num_nodes)").first()[0]
    assert tables.read_table(spark, f"{folder}/edges").count() == labels.selectExpr("sum(num_edges)").first()[0]
    assert tables.labels_with_graphs(labels, tables.read_table(spark, f"{folder}/nodes")).count() == 6


def test_csv_round_trip(spark, log, tmp_path):
    df = log((0.123456, "READ", "a", None)).withColumnsRenamed({"ts": "timestamp", "object": "predicate_object"})
    path = str(tmp_path / "out")
    tables.write_csv(df, path)
    assert rows(tables.read_events(spark, path)) == rows(df)


def test_record_shapes(spark):
    """An unknown shape is an error, a missing optional field is null."""
    odd = spark.createDataFrame([(("x",), "RECORD_EVENT", "h", "S")], "datum struct<other: string>, type string, hostId string, source string")
    with pytest.raises(ValueError, match="no field uuid"):
        cdm.record_table(odd, "events")
    plain = spark.createDataFrame([("x", "RECORD_EVENT", "h", "S")], "datum string, type string, hostId string, source string")
    with pytest.raises(ValueError, match="not a struct"):
        cdm.record_table(plain, "events")
    bare = spark.createDataFrame([(("u",), "RECORD_IPC_OBJECT", "h", "S")], "datum struct<uuid: string>, type string, hostId string, source string")
    assert cdm.record_table(bare, "ipc").first().fd1 is None
