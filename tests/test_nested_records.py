"""Records in their recorded shape: nested base objects and members that hold members."""

import json

import pytest
from pyspark.sql import functions as F

from hostweave.sources import cdm
from tests.conftest import rows
from tests.test_sources import record, write


def value(name, *components, **more):
    return {"size": -1, "type": "VALUE_TYPE_SRC", "valueDataType": "VALUE_DATA_TYPE_CHAR", "isNull": False,
            "name": name, "components": list(components) or None, **more}


def flattened(values, path=""):
    """Every value with its path, by plain recursion."""
    for i, v in enumerate(values or []):
        here = f"{path}.{i}" if path else str(i)
        yield here, v["name"], len(v.get("components") or [])
        yield from flattened(v.get("components"), here)


@pytest.fixture
def table(spark, tmp_path):
    def build(name, *lines):
        path = write(tmp_path, "n.json", "\n".join(lines))
        return cdm.record_table(cdm.read_records(spark, path), name)
    return build


def test_base_object_and_optional_fields(table):
    row = table("files", record(
        "FILE_OBJECT", uuid="b'f'", type="FILE_OBJECT_FILE", size=9, fileDescriptor=None, peInfo="pe",
        baseObject={"permission": "b'\\x01\\xff'", "epoch": 3, "properties": {"a": "b"}},
        hashes=[{"type": "MD5", "hash": "x="}]), record("FILE_OBJECT", uuid="b'g'", baseObject=None)).orderBy("uuid").collect()
    assert (row[0].permission, row[0].epoch, row[0].properties, row[0].size, row[0].pe_info) == ("01ff", 3, {"a": "b"}, 9, "pe")
    assert [tuple(h) for h in row[0].hashes] == [("MD5", "x=")]
    assert (row[1].permission, row[1].epoch, row[1].properties, row[1].hashes) == (None, None, None, None)


def test_subject_and_flow_fields(table):
    row = table("subjects", record(
        "SUBJECT", uuid="b's'", cid=1, unitId=2, iteration=3, count=4, importedLibraries=["a.dll"], properties={"k": "v"})).first()
    assert (row.unit_id, row.iteration, row["count"], row.imported_libraries, row.exported_libraries, row.properties) == (
        2, 3, 4, ["a.dll"], None, {"k": "v"})
    assert table("network", record("NET_FLOW_OBJECT", uuid="b'f'", initTcpSeqNum=77)).first().initial_sequence == 77


def test_values_of_any_depth(table):
    deep = value("leaf")
    for i in range(25):
        deep = value(f"d{i}", deep)
    lists = {"r1": [value("a", value("b"), value("c", value("d"), value("e"))), value("f")], "r2": [deep], "r3": [],
             "r4": None, "r5": [value("alone", components=[])]}
    events = table("events", *[
        record("EVENT", uuid=k, timestampNanos=1, parameters=v) for k, v in lists.items()])
    got = cdm.value_components(events, ["uuid"], "parameters")
    assert rows(got, "uuid", "path", "value_name", "n_components") == sorted(
        (k, *x) for k, v in lists.items() for x in flattened(v))
    assert all(r.depth == r.path.count(".") for r in got.collect())


def test_value_of_a_key_is_one_value(table):
    keys = table("registry", record("REGISTRY_KEY_OBJECT", uuid="k1", key="K", value=value("v", value("w"))),
                 record("REGISTRY_KEY_OBJECT", uuid="k2", key="K", value=None), record("REGISTRY_KEY_OBJECT", uuid="k3", key="K"))
    assert rows(cdm.value_components(keys, ["uuid"], "value"), "uuid", "path", "value_name") == [
        ("k1", "0", "v"), ("k1", "0.0", "w")]
    assert rows(keys, "uuid", "value_name") == [("k1", "v"), ("k2", None), ("k3", None)]


def test_tags_and_assertions(table):
    tags = [{"numValueElements": 2, "tagId": "b't'"}, {"numValueElements": 3, "tagId": "b'u'"}]
    told = [{"asserter": "x", "sources": ["b's'", "y"], "provenance": [
        {"asserter": "z", "sources": None, "provenance": [{"asserter": "w", "sources": []}]}]}]
    keys = table("registry", record("REGISTRY_KEY_OBJECT", uuid="k", key="K", value=value("v", value("w", tag=tags), provenance=told)))
    assert rows(cdm.value_tags(keys, ["uuid"], "value")) == [("k", "0.0", 0, "74", 0, 2), ("k", "0.0", 1, "75", 2, 3)]
    assert rows(cdm.value_assertions(keys, ["uuid"], "value"), "assertion", "depth", "asserter", "sources") == [
        ("0", 0, "x", ["73", "y"]), ("0.0", 1, "z", None), ("0.0.0", 2, "w", [])]


def test_struct_shapes_become_variants(spark):
    shape = ("datum struct<uuid: binary, baseObject: struct<permission: binary, epoch: int>, key: string,"
             " value: struct<name: string, components: array<struct<name: string>>>>, type string, hostId string, source string")
    df = spark.createDataFrame([((b"k", (b"\x01\xff", 4), "K", ("v", [("w",)])), "RECORD_REGISTRY_KEY_OBJECT", "h", "S")], shape)
    keys = cdm.record_table(df, "registry")
    assert rows(keys, "uuid", "permission", "epoch", "value_name", "size") == [("6b", "01ff", 4, "v", None)]
    assert rows(cdm.value_components(keys, ["uuid"], "value"), "path", "value_name") == [("0", "v"), ("0.0", "w")]
    text = spark.createDataFrame([(("k", "K", json.dumps(value("v"))), "RECORD_REGISTRY_KEY_OBJECT", "h", "S")],
                                 "datum struct<uuid: string, key: string, value: string>, type string, hostId string, source string")
    assert rows(cdm.value_components(cdm.record_table(text, "registry"), ["uuid"], "value"), "value_name") == [("v",)]


def test_wrong_records_are_errors(table):
    with pytest.raises(Exception, match="no field uuid"):
        table("ipc", record("IPC_OBJECT", fd1=1)).collect()
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        table("subjects", record("SUBJECT", uuid="s", cid="many")).collect()


def test_profile_counts_named_fields(spark, tmp_path):
    path = write(tmp_path, "p.json", "\n".join([
        record("EVENT", uuid="a", sequence=None, names=[]), record("EVENT", uuid="b"), record("END_MARKER", sessionNumber=1)]))
    profile = {r["item"]: (r.n_records, r.share) for r in cdm.record_profile(cdm.read_records(spark, path)).collect()}
    assert profile == {"record.type=RECORD_EVENT": (2, 66.7), "record.type=RECORD_END_MARKER": (1, 33.3), "uuid": (2, 66.7),
                       "sequence": (1, 33.3), "names": (1, 33.3), "sessionNumber": (1, 33.3)}


def test_no_rows(table, spark):
    none = table("registry", record("EVENT", uuid="a", timestampNanos=1))
    assert cdm.value_components(none, ["uuid"], "value").collect() == []
    assert none.select(F.col("value")).schema[0].dataType.simpleString() == "variant"
