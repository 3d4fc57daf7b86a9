"""Table schemas and the fixed vocabularies of the event model."""

# The event types a window graph is built from, in the order of
# the one-hot edge vector.
GRAPH_EVENT_TYPES = [
    "EVENT_EXECUTE", "EVENT_FORK", "EVENT_SIGNAL", "EVENT_READ", "EVENT_WRITE",
    "EVENT_OPEN", "EVENT_CREATE", "EVENT_RECVMSG", "EVENT_RECVFROM",
    "EVENT_RENAME", "EVENT_CLONE", "EVENT_UNIT", "EVENT_MODIFY_PROCESS",
    "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_SHM", "EVENT_TEE", "EVENT_SPLICE",
    "EVENT_VMSPLICE", "EVENT_INIT_MODULE", "EVENT_FINIT_MODULE",
    "EVENT_SERVICEINSTALL",
]

# Node features, in vector order.
NODE_FEATURES = [
    "node_type_flag", "degree", "in_degree", "out_degree", "event_count",
    "event_type_count", "ts_var", "closeness", "betweenness", "pagerank",
    "cluster_coeff", "avg_ts_gap", "last_seen_delta", "burst_flag",
    "activity_rate", "temporal_entropy", "time_sin", "time_cos",
]

# Ports regarded as common services.
COMMON_PORTS = [80, 443, 53, 22, 21, 25, 110, 143, 3389]

# Technique names by event verb.
TECHNIQUES = {
    "EXECUTE": "T1059 Command Execution",
    "WRITE": "T1105 Exfiltration",
    "READ": "T1087 Discovery",
    "SENDTO": "T1041 Exfiltration Over Network",
}

# Texts that stand for a missing value in the CSV tables (the
# ones pandas reads as missing).
NULL_TOKENS = [
    "", "None", "NaN", "nan", "NULL", "null", "N/A", "n/a", "NA", "<NA>",
    "#N/A", "#N/A N/A", "#NA", "-NaN", "-nan", "-1.#IND", "1.#IND",
    "-1.#QNAN", "1.#QNAN",
]


# How times are written in CSV and JSON files.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Table schemas, as DDL texts.

EVENTS = (
    "ordinal BIGINT, ts TIMESTAMP_NTZ, type STRING, subject STRING, object STRING")

SUBJECTS = (
    "uuid STRING, type STRING, cid INT, parent_subject STRING,"
    " local_principal STRING, start_timestamp TIMESTAMP_NTZ, cmd_line STRING,"
    " privilege_level STRING, source STRING")

NETWORK = (
    "uuid STRING, local_address STRING, local_port INT, remote_address STRING,"
    " remote_port INT, ip_protocol INT, file_descriptor INT, source STRING")

FILES = (
    "uuid STRING, file_type STRING, permission STRING, epoch INT, source STRING")

REGISTRY = ("uuid STRING, key STRING, value_name STRING, source STRING")

LABELS = (
    "window_id BIGINT, start TIMESTAMP_NTZ, end TIMESTAMP_NTZ, label INT,"
    " num_nodes BIGINT, num_edges BIGINT")

EXPLANATIONS = (
    "sequence_id BIGINT, part BIGINT, prediction INT, temporal_attention ARRAY<DOUBLE>,"
    " node_importance ARRAY<ARRAY<DOUBLE>>, edge_importance ARRAY<ARRAY<DOUBLE>>")

GRAPH_DOCUMENT = (
    "window_start TIMESTAMP_NTZ, part BIGINT, directed BOOLEAN, multigraph BOOLEAN,"
    " nodes ARRAY<STRUCT<id: STRING, node_type: STRING, in_degree: BIGINT, out_degree: BIGINT>>,"
    " edges ARRAY<STRUCT<source: STRING, target: STRING, event: STRING, ts: TIMESTAMP_NTZ>>")
