"""CDM records: one envelope per record, split into a flat table per record type.

Envelopes are read from JSON or Parquet, or with the Avro data source where its
package is installed. From JSON, ``datum`` is a VARIANT: each record keeps the
shape it came in, nested and recursive members included, and every table takes its
fields by path. A struct with the union of the members' fields, or with one struct
per member, is taken as well.
"""

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from hostweave.functions.durable import durable
from hostweave.functions.ids import clean_id
from hostweave.functions.timefn import nanos_to_local

# Record type by table, in the order of the members of a record's union.
RECORD_TYPES = {
    "hosts": "RECORD_HOST", "principals": "RECORD_PRINCIPAL",
    "tag_nodes": "RECORD_PROVENANCE_TAG_NODE", "unknown_nodes": "RECORD_UNKNOWN_PROVENANCE_NODE",
    "subjects": "RECORD_SUBJECT", "files": "RECORD_FILE_OBJECT", "ipc": "RECORD_IPC_OBJECT",
    "registry": "RECORD_REGISTRY_KEY_OBJECT", "packet_sockets": "RECORD_PACKET_SOCKET_OBJECT",
    "network": "RECORD_NET_FLOW_OBJECT", "memory": "RECORD_MEMORY_OBJECT",
    "sources_and_sinks": "RECORD_SRC_SINK_OBJECT", "events": "RECORD_EVENT",
    "unit_dependencies": "RECORD_UNIT_DEPENDENCY", "time_markers": "RECORD_TIME_MARKER",
    "end_markers": "RECORD_END_MARKER",
}

ENVELOPE = "datum VARIANT, CDMVersion STRING, type STRING, hostId STRING, sessionNumber INT, source STRING"

_ID, _IDS, _TIME, _VARIANT = "id", "ids", "time", "variant"
_TEXTS, _MAP = "array<string>", "map<string,string>"
#: What the object records have in common.
_BASE = {
    "permission": ("baseObject.permission", _ID), "epoch": ("baseObject.epoch", "int"),
    "properties": ("baseObject.properties", _MAP)}
# Output column: (path of the member field, its kind).
COLUMNS = {
    "events": {
        "uuid": ("uuid", _ID), "sequence": ("sequence", "bigint"),
        "ts": ("timestampNanos", _TIME), "timestamp_nanos": ("timestampNanos", "bigint"),
        "type": ("type", "string"), "subject": ("subject", _ID),
        "object": ("predicateObject", _ID), "object2": ("predicateObject2", _ID),
        "object_path": ("predicateObjectPath", "string"), "object2_path": ("predicateObject2Path", "string"),
        "thread_id": ("threadId", "int"), "names": ("names", _TEXTS), "parameters": ("parameters", _VARIANT),
        "location": ("location", "bigint"), "program_point": ("programPoint", "string"),
        "size": ("size", "bigint"), "properties": ("properties", _MAP)},
    "subjects": {
        "uuid": ("uuid", _ID), "type": ("type", "string"), "cid": ("cid", "int"),
        "parent_subject": ("parentSubject", _ID), "local_principal": ("localPrincipal", _ID),
        "start_timestamp": ("startTimestampNanos", _TIME), "unit_id": ("unitId", "int"),
        "iteration": ("iteration", "int"), "count": ("count", "int"), "cmd_line": ("cmdLine", "string"),
        "privilege_level": ("privilegeLevel", "string"), "imported_libraries": ("importedLibraries", _TEXTS),
        "exported_libraries": ("exportedLibraries", _TEXTS), "properties": ("properties", _MAP)},
    "network": {
        "uuid": ("uuid", _ID), "local_address": ("localAddress", "string"),
        "local_port": ("localPort", "int"), "remote_address": ("remoteAddress", "string"),
        "remote_port": ("remotePort", "int"), "ip_protocol": ("ipProtocol", "int"),
        "initial_sequence": ("initTcpSeqNum", "int"), "file_descriptor": ("fileDescriptor", "int"), **_BASE},
    "files": {
        "uuid": ("uuid", _ID), "file_type": ("type", "string"), "file_descriptor": ("fileDescriptor", "int"),
        "local_principal": ("localPrincipal", _ID), "size": ("size", "bigint"), "pe_info": ("peInfo", "string"),
        "hashes": ("hashes", "array<struct<type:string,hash:string>>"), **_BASE},
    "memory": {
        "uuid": ("uuid", _ID), "memory_address": ("memoryAddress", "bigint"),
        "page_number": ("pageNumber", "bigint"), "page_offset": ("pageOffset", "bigint"),
        "size": ("size", "bigint"), **_BASE},
    "registry": {
        "uuid": ("uuid", _ID), "key": ("key", "string"), "value_name": ("value.name", "string"),
        "value": ("value", _VARIANT), "size": ("size", "bigint"), **_BASE},
    "hosts": {
        "uuid": ("uuid", _ID), "host_name": ("hostName", "string"), "ta1_version": ("ta1Version", "string"),
        "host_identifiers": ("hostIdentifiers", "array<struct<idType:string,idValue:string>>"),
        "os_details": ("osDetails", "string"), "host_type": ("hostType", "string"),
        "interfaces": ("interfaces", "array<struct<name:string,macAddress:string,ipAddresses:array<string>>>")},
    "principals": {
        "uuid": ("uuid", _ID), "type": ("type", "string"), "user_id": ("userId", "string"),
        "username": ("username", "string"), "group_ids": ("groupIds", _TEXTS), "properties": ("properties", _MAP)},
    "tag_nodes": {
        "tag_id": ("tagId", _ID), "flow_object": ("flowObject", _ID), "subject": ("subject", _ID),
        "system_call": ("systemCall", "string"), "program_point": ("programPoint", "string"),
        "prev_tag_id": ("prevTagId", _ID), "opcode": ("opcode", "string"), "tag_ids": ("tagIds", _IDS),
        "itag": ("itag", "string"), "ctag": ("ctag", "string"), "properties": ("properties", _MAP)},
    "unknown_nodes": {
        "tag_id": ("upnTagId", _ID), "subject": ("subject", _ID), "program_point": ("programPoint", "string"),
        "properties": ("properties", _MAP)},
    "ipc": {
        "uuid": ("uuid", _ID), "type": ("type", "string"), "uuid1": ("uuid1", _ID), "uuid2": ("uuid2", _ID),
        "fd1": ("fd1", "int"), "fd2": ("fd2", "int"), **_BASE},
    "packet_sockets": {
        "uuid": ("uuid", _ID), "proto": ("proto", _ID), "if_index": ("ifIndex", "int"),
        "ha_type": ("haType", _ID), "pkt_type": ("pktType", _ID), "addr": ("addr", _ID), **_BASE},
    "sources_and_sinks": {
        "uuid": ("uuid", _ID), "type": ("type", "string"), "file_descriptor": ("fileDescriptor", "int"), **_BASE},
    "unit_dependencies": {"unit": ("unit", _ID), "dependent_unit": ("dependentUnit", _ID)},
    "time_markers": {"ts": ("tsNanos", _TIME), "timestamp_nanos": ("tsNanos", "bigint")},
    "end_markers": {
        "end_of_session": ("sessionNumber", "int"), "record_counts": ("recordCounts", _MAP)},
}


def read_records(spark: SparkSession, path: str, source_format: str = "json") -> DataFrame:
    reader = spark.read.format(source_format)
    return (reader if source_format == "avro" else reader.schema(ENVELOPE)).load(path)


def _member(records: DataFrame, table: str) -> tuple[str, T.DataType]:
    """Where the fields of a record type are: in ``datum`` itself, or in its member of a union."""
    datum = records.schema["datum"].dataType
    if isinstance(datum, T.VariantType):
        return "datum", datum
    if not isinstance(datum, T.StructType):
        raise ValueError(f"datum is a {datum.simpleString()}, not a struct or variant")
    name = f"member{list(RECORD_TYPES).index(table)}"
    if name in datum.names:
        return f"datum.{name}", datum[name].dataType
    return "datum", datum


def _id_text(value: Column, kind: T.DataType) -> Column:
    """An id as text: bytes in hexadecimal, a bytes literal decoded."""
    return F.lower(F.hex(value)) if isinstance(kind, T.BinaryType) else clean_id(value.cast("string"))


def _in_struct(shape: T.StructType, path: str) -> T.DataType | None:
    """The type of a nested field, or none if the shape lacks it."""
    kind: T.DataType = shape
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def _from_variant(value: Column, path: str, kind: str, zone: str) -> Column:
    taken = {_ID: "string", _IDS: _TEXTS, _TIME: "bigint"}.get(kind, kind)
    value = F.variant_get(value, f"$.{path}", taken)
    if kind == _ID:
        return clean_id(value)
    if kind == _IDS:
        return F.transform(value, lambda v: clean_id(v))
    return nanos_to_local(value, zone) if kind == _TIME else value


def _as_variant(value: Column, shape: T.DataType) -> Column:
    if isinstance(shape, T.VariantType):
        return value
    return F.parse_json(value) if isinstance(shape, T.StringType) else F.to_variant_object(value)


def record_table(records: DataFrame, table: str, zone: str = "America/New_York") -> DataFrame:
    """One record type as a flat table with the host, session and source it came from.

    ``datum`` is a VARIANT, a struct with the fields of all types, or a struct with
    one struct per member of the union (``member0``, ...), as data sources without
    unions give it. Ids may be bytes. A field that a record or the shape lacks is
    null, but the first one, the key, must be there. A value of another type than
    the field's is an error.
    """
    place, shape = _member(records, table)
    variant = isinstance(shape, T.VariantType)
    first, (key, _) = next(iter(COLUMNS[table].items()))
    if not variant and _in_struct(shape, key) is None:
        raise ValueError(f"no field {key} in {place} for {table}")

    def column(name: str, path: str, kind: str) -> Column:
        if variant:
            value = _from_variant(F.col(place), path, kind, zone)
            if name == first:
                value = F.when(value.isNotNull(), value).otherwise(
                    F.raise_error(F.lit(f"no field {key} in a record of {table}")))
            return value.alias(name)
        own = _in_struct(shape, path)
        if own is None:
            return F.lit(None).cast({_TIME: "timestamp_ntz", _IDS: _TEXTS, _ID: "string"}.get(kind, kind)).alias(name)
        value = F.col(f"{place}.{path}")
        if kind == _ID:
            value = _id_text(value, own)
        elif kind == _IDS:
            value = F.transform(value, lambda v: _id_text(v, own.elementType))
        elif kind == _TIME:
            value = nanos_to_local(value.cast("bigint"), zone)
        elif kind == _VARIANT:
            value = _as_variant(value, own)
        return value.alias(name)

    session = F.col("sessionNumber") if "sessionNumber" in records.columns else F.lit(None).cast("int")
    host = _id_text(F.col("hostId"), records.schema["hostId"].dataType)
    return records.filter(F.col("type") == RECORD_TYPES[table]).select(
        *[column(name, *spec) for name, spec in COLUMNS[table].items()],
        host.alias("host_id"), session.alias("session_number"), "source")


def nested_members(rows: DataFrame, keys: Sequence[str], root: str, child: str) -> DataFrame:
    """(keys, path, depth, member): a VARIANT member and all that it holds below ``child``, to any depth.

    ``root`` is a VARIANT, or a VARIANT list of them. ``path`` is the place of a
    member among its siblings, from the outermost one inwards ("0", "0.2", ...).
    Every round opens one more level of those members that have children, so a
    deep value costs rounds over few rows, not a bound on the depth.
    """
    whole = F.variant_get(F.col(root), "$", "variant")
    listed = F.when(
        F.startswith(F.schema_of_variant(whole), F.lit("ARRAY")), F.variant_get(whole, "$", "array<variant>")
    ).otherwise(F.array(whole))
    level = durable(rows.filter(F.col(root).isNotNull() & ~F.is_variant_null(F.col(root))).select(
        *keys, F.posexplode(listed).alias("__at", "member")
    ).select(*keys, F.col("__at").cast("string").alias("path"), F.lit(0).alias("depth"), "member"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        below = F.variant_get("member", f"$.{child}", "array<variant>")
        level = durable(level.filter(below.isNotNull()).select(
            *keys, "path", "depth", F.posexplode(below).alias("__at", "member")
        ).select(*keys, F.concat_ws(".", "path", "__at").alias("path"), (F.col("depth") + 1).alias("depth"), "member"))
    return functools.reduce(DataFrame.unionByName, levels or [level])


def value_components(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A row for every value and component of a value (``value`` of a registry key, ``parameters`` of an event)."""
    def field(name: str, kind: str) -> Column:
        return F.variant_get("member", f"$.{name}", kind)

    return nested_members(rows, keys, value, "components").select(
        *keys, "path", "depth", field("name", "string").alias("value_name"), field("type", "string").alias("value_type"),
        field("valueDataType", "string").alias("value_data_type"),
        field("runtimeDataType", "string").alias("runtime_data_type"), field("size", "int").alias("value_size"),
        field("isNull", "boolean").alias("value_is_null"), clean_id(field("valueBytes", "string")).alias("value_bytes"),
        F.coalesce(F.size(field("components", "array<variant>")), F.lit(0)).alias("n_components"))


def value_tags(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Tag runs of all values and components: (keys, path, run, tag_id, first_element, n_elements)."""
    runs = nested_members(rows, keys, value, "components").select(*keys, "path", F.posexplode(
        F.variant_get("member", "$.tag", "array<struct<numValueElements:int,tagId:string>>")).alias("run", "__run"))
    size = F.col("__run.numValueElements").cast("bigint")
    before = Window.partitionBy(*keys, "path").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        *keys, "path", "run", clean_id(F.col("__run.tagId")).alias("tag_id"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("first_element"), size.alias("n_elements"))


def value_assertions(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Provenance assertions of all values and components, and the assertions about those, to any depth.

    (keys, path, assertion, depth, asserter, sources): ``path`` is the value's,
    ``assertion`` the place of the assertion below it.
    """
    held = nested_members(rows, keys, value, "components").select(
        *keys, F.col("path").alias("__value"), F.variant_get("member", "$.provenance", "variant").alias("__held"))
    return nested_members(held, [*keys, "__value"], "__held", "provenance").select(
        *keys, F.col("__value").alias("path"), F.col("path").alias("assertion"), "depth",
        clean_id(F.variant_get("member", "$.asserter", "string")).alias("asserter"),
        F.transform(F.variant_get("member", "$.sources", _TEXTS), lambda v: clean_id(v)).alias("sources"))


def write_record_tables(records: DataFrame, folder: str, zone: str = "America/New_York") -> None:
    """Every record type to its own Parquet table below ``folder``.

    The source is parsed once, into ``folder/records`` partitioned by record
    type; each table then reads its own partition only.
    """
    staged = f"{folder}/records"
    records.write.partitionBy("type").parquet(staged)
    parts = records.sparkSession.read.parquet(staged)
    for table in RECORD_TYPES:
        record_table(parts, table, zone).write.parquet(f"{folder}/{table}")


def record_profile(records: DataFrame) -> DataFrame:
    """(item, n_records, share) for record types and for the presence of every field.

    The records are read once, into counts per record type and field. In a VARIANT
    a field is present where the record names it, null or not; a struct has all its
    fields, so there only those count that are not null.
    """
    kind = F.col("type").alias("__type")
    if isinstance(records.schema["datum"].dataType, T.VariantType):
        keys = F.explode_outer(F.concat(F.array(F.lit("")), F.map_keys(F.variant_get("datum", "$", "map<string,variant>"))))
        counts = durable(records.select(kind, keys.alias("__key")).groupBy("__type", "__key").agg(
            F.count(F.lit(1)).alias("n_records")))
        types = counts.filter("__key = ''").select(
            F.concat(F.lit("record.type="), "__type").alias("item"), "n_records")
        long = counts.filter("__key <> ''").groupBy(F.col("__key").alias("item")).agg(F.sum("n_records").alias("n_records"))
    else:
        fields = records.select("datum.*").columns
        counts = durable(records.groupBy(kind).agg(
            F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"datum.{f}")).alias(f) for f in fields]))
        types = counts.select(
            F.concat(F.lit("record.type="), "__type").alias("item"), F.col("__n").alias("n_records"))
        present = counts.agg(*[F.sum(f).alias(f) for f in fields])
        long = present.unpivot([], list(fields), "item", "n_records").filter("n_records > 0")
    total = types.select(F.sum("n_records")).scalar()
    return types.unionByName(long).withColumn(
        "share", F.round(F.col("n_records") * 100.0 / total, 1))


def count_differences(published: DataFrame, received: DataFrame, key: str = "type") -> DataFrame:
    """Published counts (maps of name to number) against the rows that arrived."""
    told = published.select(F.explode("record_counts").alias(key, "n")).groupBy(key).agg(
        F.sum(F.col("n").cast("bigint")).alias("n_published"))
    arrived = received.groupBy(key).agg(F.count(F.lit(1)).alias("n_received"))
    return told.join(arrived, key, "full_outer").fillna(0, ["n_published", "n_received"]).withColumn(
        "n_missing", F.col("n_published") - F.col("n_received"))
