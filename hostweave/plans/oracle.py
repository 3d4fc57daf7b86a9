"""The registered queries as plain SQL over the same tables.

Written independently of the operators: common pieces are CTEs, and each query
pulls in the ones it names.
"""

import re

from hostweave.plans.catalog import BIAS, CUTOFF, STEP_WEIGHTS, WEIGHTS
from hostweave.schemas import COMMON_PORTS, GRAPH_EVENT_TYPES

_ALLOWED = ", ".join(f"'{t}'" for t in GRAPH_EVENT_TYPES)
_PORTS = ", ".join(map(str, COMMON_PORTS))
_SCORE = " + ".join([str(BIAS)] + [f"({w}) * {n}" for n, w in WEIGHTS.items()])
_STEP_SCORE = "CASE step " + " ".join(
    f"WHEN {step} THEN " + " + ".join(f"({STEP_WEIGHTS[f'{n}_t{step}']}) * {n}" for n in WEIGHTS)
    for step in range(3)) + " END"
_MOVED = " + ".join(f"({w}) * (x.{n} - g.{n})" for n, w in WEIGHTS.items())
_ATTACK = ("window_start <= TIMESTAMP '2024-01-11 23:59:59'"
           " AND window_end >= TIMESTAMP '2024-01-10 00:00:00'")


def _graph_ctes(unit: str, seconds: int) -> dict[str, str]:
    start = f"to_timestamp(epoch_us(ts) // {seconds * 1_000_000} * {seconds})::TIMESTAMP"
    if unit in ("day", "hour"):
        start = f"date_trunc('{unit}', ts)"
    return {
        f"{unit}_ev": f"SELECT {start} AS window_start, * FROM ev",
        f"{unit}_edges": f"""
            SELECT window_start, subject AS source, object AS target,
                   arg_max(type, ordinal) AS event, arg_max(ts, ordinal) AS ts,
                   count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts,
                   min(ordinal) AS first_ordinal
            FROM {unit}_ev WHERE object IS NOT NULL GROUP BY 1, 2, 3""",
        f"{unit}_mentions": f"""
            SELECT window_start, subject AS node_id, 2 * ordinal AS pos, 'subject' AS role
            FROM {unit}_ev
            UNION ALL
            SELECT window_start, object, 2 * ordinal + 1, 'object'
            FROM {unit}_ev WHERE object IS NOT NULL""",
        f"{unit}_roles": f"""
            SELECT window_start, node_id, arg_max(role, pos) AS node_type, min(pos) AS first_pos
            FROM {unit}_mentions GROUP BY 1, 2""",
        f"{unit}_out": f"""
            SELECT window_start, source AS node_id, count(*) AS out_degree,
                   count(DISTINCT event) AS event_type_count,
                   var_pop(epoch_us(ts - window_start) / 1e6) AS ts_var,
                   min(ts) AS first_out, max(ts) AS last_out
            FROM {unit}_edges GROUP BY 1, 2""",
        f"{unit}_in": f"""
            SELECT window_start, target AS node_id, count(*) AS in_degree
            FROM {unit}_edges GROUP BY 1, 2""",
        f"{unit}_nodes": f"""
            SELECT r.window_start, r.node_id, r.node_type, r.first_pos,
                   CASE WHEN r.node_type = 'subject' THEN 1 ELSE 0 END AS node_type_flag,
                   coalesce(i.in_degree, 0) AS in_degree, coalesce(o.out_degree, 0) AS out_degree,
                   coalesce(i.in_degree, 0) + coalesce(o.out_degree, 0) AS degree,
                   coalesce(o.event_type_count, 0) AS event_type_count,
                   CASE WHEN o.out_degree > 1 THEN o.ts_var ELSE 0 END AS ts_var,
                   o.first_out, o.last_out
            FROM {unit}_roles r
            LEFT JOIN {unit}_in i USING (window_start, node_id)
            LEFT JOIN {unit}_out o USING (window_start, node_id)""",
        f"{unit}_index": f"""
            SELECT window_start, node_id,
                   row_number() OVER (PARTITION BY window_start ORDER BY first_pos) - 1 AS node_idx
            FROM {unit}_roles""",
    }


CTES = {
    "prov": """
        SELECT event_id AS ordinal, ts,
               CASE event_type WHEN 'click' THEN 'EVENT_READ' WHEN 'view' THEN 'EVENT_WRITE'
                    WHEN 'purchase' THEN 'EVENT_SENDTO' WHEN 'signup' THEN 'EVENT_EXECUTE'
                    WHEN 'error' THEN 'EVENT_CLOSE' END AS type,
               'n' || user_id AS subject,
               CASE WHEN event_id % 17 <> 0 THEN 'n' || regexp_extract(props, '\\d+') END AS object
        FROM events""",
    "ev": f"SELECT * FROM prov WHERE type IN ({_ALLOWED})",
    "subj": """
        SELECT 'n' || user_id AS uuid,
               CASE WHEN user_id % 3 = 0 THEN 'SUBJECT_PROCESS' ELSE 'SUBJECT_THREAD' END AS type,
               CAST(user_id + 1000 AS INTEGER) AS cid,
               CASE WHEN user_id > 0 THEN 'n' || (user_id // 2) END AS parent_subject,
               min(ts) AS start_timestamp
        FROM events GROUP BY user_id""",
    "net": """
        SELECT concat_ws('-', 'f', l_orderkey, l_linenumber) AS uuid,
               '10.1.0.' || l_linenumber AS local_address,
               CAST(l_linenumber + 49000 AS INTEGER) AS local_port,
               CASE WHEN l_linenumber < 6 THEN '10.2.0.' || l_suppkey END AS remote_address,
               CASE WHEN l_linenumber < 6 THEN CAST(l_partkey % 1000 AS INTEGER) END AS remote_port
        FROM lineitem""",
    "flow": """
        SELECT 'n' || s_suppkey AS uuid, '10.3.0.' || s_nationkey AS remote_address,
               CAST(s_nationkey + 430 AS INTEGER) AS remote_port
        FROM supplier""",
    "reg": r"""
        SELECT 'n' || p_partkey AS uuid,
               CASE WHEN p_size < 10
                    THEN '\REGISTRY\MACHINE\Software\Microsoft\Windows\CurrentVersion\Run\'
                    ELSE '\REGISTRY\MACHINE\Software\Microsoft\Windows\CurrentVersion\Explorer\'
               END || p_brand AS key, p_size
        FROM part""",
    **_graph_ctes("day", 86_400),
    **_graph_ctes("hour", 3600),
    **_graph_ctes("tenmin", 600),
    "labelled": f"""
        SELECT row_number() OVER (ORDER BY window_start) - 1 AS window_id, window_start, window_end,
               CASE WHEN {_ATTACK} THEN 1 ELSE 0 END AS label, num_nodes, num_edges
        FROM (SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end,
                     count(*) AS num_nodes, CAST(sum(out_degree) AS BIGINT) AS num_edges
              FROM hour_nodes GROUP BY 1, 2)""",
    "steps": """
        SELECT l.window_id - k.step AS sequence_id, CAST(k.step AS INTEGER) AS step, l.window_id,
               l.window_start, l.label
        FROM labelled l, (VALUES (0), (1), (2)) k(step)
        WHERE l.window_id - k.step >= 0
          AND l.window_id - k.step + 2 <= (SELECT max(window_id) FROM labelled)""",
    "embed": """
        SELECT window_start, count(*) AS n_nodes, avg(node_type_flag) AS node_type_flag,
               avg(in_degree) AS in_degree, avg(out_degree) AS out_degree,
               avg(event_type_count) AS event_type_count
        FROM hour_nodes GROUP BY 1""",
    "scored": f"""
        SELECT s.sequence_id, s.step, s.label, node_type_flag, in_degree, out_degree,
               event_type_count, {_SCORE} AS score
        FROM steps s JOIN embed USING (window_start)""",
    "attention": """
        SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY sequence_id) AS weight
        FROM scored""",
    "attended": """
        SELECT sequence_id, max(label) AS label, sum(node_type_flag * weight) AS node_type_flag,
               sum(in_degree * weight) AS in_degree, sum(out_degree * weight) AS out_degree,
               sum(event_type_count * weight) AS event_type_count
        FROM attention GROUP BY 1""",
    "attended6": """
        SELECT sequence_id, max(label) AS label,
               sum(node_type_flag * round(weight, 6)) AS node_type_flag,
               sum(in_degree * round(weight, 6)) AS in_degree,
               sum(out_degree * round(weight, 6)) AS out_degree,
               sum(event_type_count * round(weight, 6)) AS event_type_count
        FROM attention GROUP BY 1""",
    "predicted": f"""
        SELECT sequence_id, label,
               CASE WHEN round({_SCORE}, 6) > {CUTOFF} THEN 1 ELSE 0 END AS prediction
        FROM attended""",
    "predicted6": f"""
        SELECT sequence_id, label,
               CASE WHEN round({_SCORE}, 6) > {CUTOFF} THEN 1 ELSE 0 END AS prediction
        FROM attended6""",
    "winimp": f"""
        SELECT x.window_start, x.node_id,
               CASE WHEN g.n_nodes > 1
                    THEN round(abs({_MOVED}) / (g.n_nodes - 1), 6) ELSE 0 END AS importance
        FROM hour_nodes x JOIN embed g USING (window_start)""",
    "seqimp": """
        SELECT s.sequence_id, s.step, s.window_start, i.node_id, i.importance
        FROM steps s JOIN winimp i USING (window_start)""",
    "seqweights": """
        SELECT sequence_id, max(CASE WHEN step = 0 THEN round(weight, 6) END) AS w0,
               max(CASE WHEN step = 1 THEN round(weight, 6) END) AS w1,
               max(CASE WHEN step = 2 THEN round(weight, 6) END) AS w2
        FROM attention GROUP BY 1""",
    "flagged": """
        SELECT sequence_id, step, max(importance) AS top_score
        FROM seqimp GROUP BY 1, 2 HAVING max(importance) > 0.05""",
    "severe": """
        SELECT sequence_id, prediction, w0, w1, w2,
               round_even(w2 * CASE WHEN prediction = 1 THEN 1.0 ELSE 0.3 END, 2) AS severity
        FROM predicted6 JOIN seqweights USING (sequence_id)""",
    "hourcount": """
        SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_events
        FROM prov GROUP BY 1""",
    "closedhour": """
        SELECT * FROM hourcount
        WHERE window_start + INTERVAL 1 HOUR
              <= date_trunc('milliseconds', (SELECT max(ts) FROM prov)) - INTERVAL 2 HOUR""",
    "reach": """
        SELECT window_start, node_id AS s, node_id AS v, 0 AS d, 1.0::DOUBLE AS paths
        FROM day_nodes
        UNION
        SELECT f.window_start, f.s, e.target, f.d + 1, sum(f.paths)
        FROM reach f JOIN day_edges e ON e.window_start = f.window_start AND e.source = f.v
        WHERE NOT EXISTS (SELECT 1 FROM recurring.reach r
                          WHERE r.window_start = f.window_start AND r.s = f.s AND r.v = e.target)
        GROUP BY f.window_start, f.s, e.target, f.d""",
    "daysize": "SELECT window_start, count(*) AS n FROM day_nodes GROUP BY 1",
    "close": """
        SELECT window_start, node_id,
               coalesce(r.k / r.far * r.k / (n - 1), 0) AS closeness
        FROM day_nodes JOIN daysize USING (window_start)
        LEFT JOIN (SELECT window_start, v AS node_id, count(*)::DOUBLE AS k, sum(d)::DOUBLE AS far
                   FROM reach WHERE d > 0 GROUP BY 1, 2) r USING (window_start, node_id)""",
    "between": """
        SELECT window_start, node_id,
               CASE WHEN n > 2 THEN coalesce(b.through, 0) / ((n - 1) * (n - 2)) ELSE 0 END
                   AS betweenness
        FROM day_nodes JOIN daysize USING (window_start)
        LEFT JOIN (
            SELECT a.window_start, a.v AS node_id, sum(a.paths * b.paths / p.paths) AS through
            FROM reach a
            JOIN reach b ON b.window_start = a.window_start AND b.s = a.v AND b.d > 0
            JOIN reach p ON p.window_start = a.window_start AND p.s = a.s AND p.v = b.v
                        AND p.d = a.d + b.d
            WHERE a.d > 0 GROUP BY 1, 2) b USING (window_start, node_id)""",
    "rankstart": """
        SELECT x.window_start, x.node_id, z.n, x.out_degree, 1.0::DOUBLE / z.n AS r
        FROM day_nodes x JOIN daysize z USING (window_start)""",
    "ranked": """
        SELECT 0 AS turn, window_start, node_id, n, out_degree, r, true AS active FROM rankstart
        UNION ALL
        SELECT turn + 1, window_start, node_id, n, out_degree, fresh,
               sum(abs(fresh - r)) OVER (PARTITION BY window_start) >= n * 1e-6
        FROM (
            SELECT a.turn, a.window_start, a.node_id, a.n, a.out_degree, a.r,
                   0.85 * (coalesce(i.share, 0) + coalesce(l.loose, 0) / a.n) + 0.15 / a.n AS fresh
            FROM ranked a
            LEFT JOIN (SELECT e.window_start, e.target AS node_id, sum(b.r / b.out_degree) AS share
                       FROM ranked b JOIN day_edges e
                         ON e.window_start = b.window_start AND e.source = b.node_id
                       GROUP BY 1, 2) i
              ON i.window_start = a.window_start AND i.node_id = a.node_id
            LEFT JOIN (SELECT window_start, sum(r) AS loose FROM ranked
                       WHERE out_degree = 0 GROUP BY 1) l
              ON l.window_start = a.window_start
            WHERE a.active AND a.turn < 100)""",
    "pr": """
        SELECT window_start, node_id, arg_max(r, turn) AS pagerank FROM ranked GROUP BY 1, 2""",
    "pair": """
        SELECT DISTINCT window_start, least(source, target) AS a, greatest(source, target) AS b
        FROM day_edges WHERE source <> target""",
    "adj": """
        SELECT window_start, a AS x, b AS y FROM pair
        UNION ALL SELECT window_start, b, a FROM pair""",
    "nbrs": "SELECT window_start, x AS node_id, count(*) AS k FROM adj GROUP BY 1, 2",
    "tri": """
        SELECT p.window_start, p.x AS node_id, count(*) AS t
        FROM adj p JOIN adj q ON q.window_start = p.window_start AND q.x = p.x AND p.y < q.y
        JOIN pair c ON c.window_start = p.window_start AND c.a = p.y AND c.b = q.y
        GROUP BY 1, 2""",
    "clus": """
        SELECT window_start, node_id,
               CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS cluster_coeff
        FROM nbrs LEFT JOIN tri USING (window_start, node_id)""",
    "gaps": """
        SELECT window_start, source, epoch_us(ts - lag(ts) OVER w) AS gap,
               epoch_us(max(ts) OVER (PARTITION BY window_start, source)
                        - min(ts) OVER (PARTITION BY window_start, source)) AS span
        FROM day_edges WINDOW w AS (PARTITION BY window_start, source ORDER BY ts)""",
    "entropy": """
        SELECT window_start, source, -sum(gap / span * ln(gap / span + 1e-9)) AS temporal_entropy
        FROM gaps WHERE span > 0 AND gap IS NOT NULL GROUP BY 1, 2""",
    "bursty": """
        SELECT DISTINCT window_start, source FROM (
            SELECT window_start, source,
                   epoch_us(lead(ts, 2) OVER (PARTITION BY window_start, source ORDER BY ts) - ts) AS reach_us
            FROM day_edges) WHERE reach_us < 14400000000""",
}
_KEYS = {"reach": "(window_start, s, v, d, paths) USING KEY (window_start, s, v)"}


def _sql(body: str) -> str:
    """``body`` with the CTEs it names, directly or through others, in front."""
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in needed and re.search(rf"(?<![.\w]){name}(?!\w)", text):
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(
        f"{n}{_KEYS.get(n, '')} AS ({CTES[n]})" for n in needed) + "\n" + body


_TOP_BURST = """
    SELECT window_start, n_events FROM hourcount
    WHERE n_events > 2.0 * (SELECT avg(n_events) FROM hourcount)"""
_RARE = """
    SELECT type, count(*) AS n_events FROM prov GROUP BY 1
    HAVING count(*) < (SELECT avg(c) FROM (SELECT count(*) AS c FROM prov GROUP BY type))"""
_TARGETS = f"""
    SELECT 'burst' AS target, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS value
    FROM (SELECT * FROM ({_TOP_BURST}) ORDER BY n_events DESC, window_start LIMIT 1)
    UNION ALL
    SELECT 'rare_type', type FROM (SELECT * FROM ({_RARE}) ORDER BY n_events DESC, type LIMIT 1)
    UNION ALL
    SELECT 'active_subject', 'PID ' || s.cid
    FROM (SELECT subject, count(*) AS c FROM prov GROUP BY 1 ORDER BY c DESC, subject LIMIT 1) a
    JOIN subj s ON s.uuid = a.subject"""
_SEQ_TEXT = """
    'Sequence ' || sequence_id || ' is classified as '
    || CASE WHEN prediction = 1 THEN 'MALICIOUS' ELSE 'BENIGN' END
    || '.' || chr(10) || 'Highest importance occurred at timestep with weight '
    || printf('%.3f', greatest(w0, w1, w2)) || '.' || chr(10) || 'Severity Score: '
    || severity::DOUBLE || '.' || chr(10) || 'Possible MITRE Techniques: '
    || CASE WHEN coalesce(k, 0) = 0 THEN 'None detected'
            ELSE 'T1059 Command Execution' || repeat(', T1059 Command Execution', CAST(k - 1 AS INTEGER)) END
    || '.'"""
_TYPE_COLUMNS = ", ".join(
    f"count(*) FILTER (event = '{t}') AS {t.removeprefix('EVENT_').lower()}" for t in GRAPH_EVENT_TYPES)
_BITS = " || ".join(f"CASE WHEN event = '{t}' THEN '1' ELSE '0' END" for t in GRAPH_EVENT_TYPES)
_FIELDS = {
    "uuid": "1", "type": "1", "sequence": "CASE WHEN e THEN 1 END", "subject": "CASE WHEN e THEN 1 END",
    "predicateObject": "object", "timestampNanos": "CASE WHEN e THEN 1 END",
    "cid": "CASE WHEN NOT e THEN 1 END", "parentSubject": "parent_subject"}
_PROFILE = """
    SELECT true AS e, object, NULL AS parent_subject, 'RECORD_EVENT' AS kind FROM prov
    UNION ALL SELECT false, NULL, parent_subject, 'RECORD_SUBJECT' FROM subj"""
_SPLIT = """
    SELECT doc_id, quality, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n,
                 row_number() OVER (PARTITION BY quality ORDER BY {order}) - 1 AS r FROM labels)"""



def _base(epoch: str) -> str:
    """What an object's base adds to its value: permission in hexadecimal, epoch, the one property."""
    return f"(' 013' || {epoch} % 8 || ' ' || {epoch} || ' ' || {epoch})"


def _presence() -> str:
    """Records and named fields of each kind, from the sizes of the tables."""
    kinds = {
        "HOST": ("nation", "uuid hostName ta1Version hostType hostIdentifiers interfaces"),
        "PROVENANCE_TAG_NODE": ("part", "tagId subject prevTagId opcode tagIds itag"),
        "UNKNOWN_PROVENANCE_NODE": ("supplier", "upnTagId subject properties"),
        "IPC_OBJECT": ("supplier", "uuid baseObject type uuid1 fd1 fd2"),
        "PACKET_SOCKET_OBJECT": ("supplier", "uuid baseObject proto ifIndex haType pktType addr"),
        "SRC_SINK_OBJECT": ("customer", "uuid baseObject type fileDescriptor"),
        "UNIT_DEPENDENCY": ("customer", "unit dependentUnit"),
        "END_MARKER": ("nation", "sessionNumber recordCounts")}
    rows = [f"SELECT '{item}' AS item, count(*) AS n FROM {table}" for kind, (table, fields) in kinds.items()
            for item in (f"record.type=RECORD_{kind}", *fields.split())]
    items = f"SELECT item, sum(n)::BIGINT AS n_records FROM ({' UNION ALL '.join(rows)}) GROUP BY item"
    return (f"WITH items AS ({items}) SELECT item, n_records, round(n_records * 100.0 / (SELECT sum(n_records) "
            "FROM items WHERE item LIKE 'record.type=%'), 1) AS share FROM items")


_BODIES = {
    # sources and sinks
    "event_csv": "SELECT ordinal, ts, type, md5(subject) AS subject, md5(object) AS object FROM prov",
    "event_csv_without_ordinal": """
        SELECT window_start, node_id, node_type, in_degree, out_degree FROM day_nodes""",
    "event_csv_mixed_headers": "SELECT ordinal, ts, type, subject, object FROM prov",
    "rejected_rows": """
        SELECT ordinal, strftime(ts, '%d/%m/%Y %H:%M') AS time_text, type, subject
        FROM prov WHERE ordinal % 50 = 0""",
    "readable_rows": "SELECT ordinal, ts, type, subject, object FROM prov WHERE ordinal % 50 <> 0",
    "network_csv": "SELECT * REPLACE (remote_port::DOUBLE AS remote_port) FROM net",
    "subject_csv": "SELECT * FROM subj",
    "null_tokens": """
        SELECT event_type, count(*) FILTER (event_id % 4 = 3) AS n_known, count(*) AS n_rows
        FROM events GROUP BY 1""",
    "record_tables": """
        SELECT 'e' || ordinal AS uuid, ordinal AS sequence, ts - INTERVAL 5 HOUR AS ts, type,
               subject, object, 'h1' AS host_id FROM prov""",
    "record_subjects": "SELECT uuid, type, cid, parent_subject FROM subj",
    "object_records": f"""
        SELECT *, CAST(4 AS INTEGER) AS session_number FROM (
        SELECT 'network' AS table_name, 'n' || s_suppkey AS id,
               '10.3.0.' || s_nationkey || ' ' || s_nationkey || ' ' || s_suppkey || {_base('s_nationkey')} AS value FROM supplier
        UNION ALL SELECT 'files', 'n' || p_partkey, p_brand || ' ' || p_size
            || CASE WHEN p_size > 10 THEN ' MD5 ' || sha256(p_name) ELSE '' END || {_base('p_size')} FROM part
        UNION ALL SELECT 'registry', 'n' || p_partkey, p_name || {_base('p_size')} FROM part
        UNION ALL SELECT 'memory', 'n' || p_partkey, p_partkey || ' ' || p_size || {_base('p_size')} FROM part
        UNION ALL SELECT 'principals', 'n' || c_custkey, c_name || ' ' || c_mktsegment FROM customer
        UNION ALL SELECT 'time_markers', (epoch_us(ts) * 1000)::VARCHAR,
                         strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') FROM prov)""",
    "value_components": """
        SELECT uuid, path, CAST(depth AS INTEGER) AS depth, value_name, value_bytes, CAST(n AS INTEGER) AS n_components FROM (
        SELECT 'n' || p_partkey AS uuid, '0' AS path, 0 AS depth, p_name AS value_name, NULL AS value_bytes,
               CASE WHEN p_size >= 5 THEN 2 ELSE 0 END AS n FROM part
        UNION ALL SELECT 'n' || p_partkey, '0.0', 1, p_brand, NULL, 1 FROM part WHERE p_size >= 5
        UNION ALL SELECT 'n' || p_partkey, '0.1', 1, p_type, NULL, 0 FROM part WHERE p_size >= 5
        UNION ALL SELECT 'n' || p_partkey, '0.0.0', 2, 'm' || p_size, '0041', 0 FROM part WHERE p_size >= 5)""",
    "value_assertions": """
        SELECT uuid, '0' AS path, assertion, CAST(depth AS INTEGER) AS depth, asserter, sources FROM (
        SELECT 'n' || p_partkey AS uuid, '0' AS assertion, 0 AS depth, 'n' || p_size AS asserter,
               'n' || p_partkey || ',41' AS sources FROM part WHERE p_size < 9
        UNION ALL SELECT 'n' || p_partkey, '0.0', 1, 'n0', '' FROM part WHERE p_size < 9)""",
    "session_records": f"""
        SELECT 'hosts' AS table_name, 'n' || n_nationkey AS id,
               n_name || ' HOST_DESKTOP n' || n_regionkey || ' eth0 10.0.0.' || n_nationkey AS value FROM nation
        UNION ALL SELECT 'tag_nodes', 'n' || p_partkey,
               'n' || p_size || ' n' || p_size || ' TAG_OP_UNION n' || p_size || ',41 ' || p_brand FROM part
        UNION ALL SELECT 'unknown_nodes', 'n' || s_suppkey, 'n' || s_nationkey || ' ' || s_name FROM supplier
        UNION ALL SELECT 'ipc', 'n' || s_suppkey, 'IPC_OBJECT_PIPE_UNNAMED n' || s_nationkey || ' 3 ' || s_nationkey
               || {_base('s_nationkey')} FROM supplier
        UNION ALL SELECT 'packet_sockets', 'n' || s_suppkey, '0800 ' || s_nationkey || ' 0001 04 4142'
               || {_base('s_nationkey')} FROM supplier
        UNION ALL SELECT 'sources_and_sinks', 'n' || c_custkey, c_mktsegment || ' ' || c_nationkey
               || {_base('c_nationkey')} FROM customer
        UNION ALL SELECT 'unit_dependencies', 'n' || c_custkey, 'n' || c_nationkey FROM customer
        UNION ALL SELECT 'end_markers', n_nationkey::VARCHAR, n_name || ' ' || n_regionkey FROM nation""",
    "record_presence": _presence(),
    "member_records": """
        SELECT md5(ordinal::VARCHAR) AS uuid, md5(subject) AS subject, md5(object) AS object, type,
               ts - INTERVAL 5 HOUR AS ts FROM prov""",
    "nanos_to_local": "SELECT event_id, ts - INTERVAL 5 HOUR AS local_ts FROM events",
    "record_profile": "SELECT item, n_records, round(n_records * 100.0 / (SELECT count(*) FROM ("
        + _PROFILE + ")), 1) AS share FROM (SELECT 'record.type=' || kind AS item, count(*) AS n_records FROM ("
        + _PROFILE + ") GROUP BY 1 UNION ALL "
        + " UNION ALL ".join(f"SELECT '{f}', count({x}) FROM ({_PROFILE})" for f, x in _FIELDS.items())
        + ")",
    "all_types_graph": """
        SELECT date_trunc('day', ts) AS window_start, subject AS source, object AS target,
               arg_max(type, ordinal) AS event, arg_max(ts, ordinal) AS ts, count(*) AS n_events
        FROM prov WHERE object IS NOT NULL GROUP BY 1, 2, 3""",
    "nan_subject_graph": """
        SELECT date_trunc('day', ts) AS window_start,
               CASE WHEN ordinal % 23 = 0 THEN 'nan' ELSE subject END AS source, object AS target,
               arg_max(type, ordinal) AS event, arg_max(ts, ordinal) AS ts, count(*) AS n_events
        FROM ev WHERE object IS NOT NULL GROUP BY 1, 2, 3""",
    "graph_documents": """
        SELECT window_start, CAST(0 AS BIGINT) AS part, nodes_text, coalesce(edges_text, '') AS edges_text
        FROM (SELECT window_start, string_agg(node_id || ':' || node_type, ',' ORDER BY first_pos) AS nodes_text
              FROM day_roles GROUP BY 1)
        LEFT JOIN (SELECT window_start, string_agg(source || ' ' || event || ' ' || target, ','
                          ORDER BY first_ordinal, target) AS edges_text
                   FROM day_edges GROUP BY 1) USING (window_start)""",
    "graph_document_nodes": """
        SELECT window_start, node_idx, node_id, node_type, in_degree, out_degree
        FROM day_nodes JOIN day_index USING (window_start, node_id)""",
    "graph_document_edges": "SELECT window_start, source, target, event, ts FROM day_edges",
    "label_table": "SELECT * FROM labelled",
    "labels_with_graphs": f"""
        SELECT DISTINCT window_start, window_end, CAST(CASE WHEN {_ATTACK} THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM (SELECT date_trunc('hour', ts) AS window_start,
                     date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end FROM prov)
        WHERE window_start IN (SELECT window_start FROM hour_edges)""",
    "summary_report": """
        SELECT count(*) AS total_events, count(DISTINCT type) AS event_types,
               (SELECT count(*) FROM subj) AS total_processes,
               count(DISTINCT subject) AS subjects_in_events, count(DISTINCT object) AS objects_in_events,
               (SELECT count(*) FROM net) AS network_connections,
               round(epoch_us(max(ts) - min(ts)) / 1e6, 6) AS time_span_s FROM prov""",
    "findings_report": f"""
        SELECT 'activity_bursts' AS section, row_number() OVER (ORDER BY n_events DESC, window_start) AS rank,
               strftime(window_start, '%Y-%m-%d %H:%M:%S') AS key, n_events::VARCHAR AS value
        FROM (SELECT * FROM ({_TOP_BURST}) ORDER BY n_events DESC, window_start LIMIT 5)
        UNION ALL
        SELECT 'rare_events', row_number() OVER (ORDER BY n_events DESC, type), type, n_events::VARCHAR
        FROM ({_RARE})
        UNION ALL
        SELECT 'targets', row_number() OVER (ORDER BY CASE target WHEN 'burst' THEN 1
               WHEN 'rare_type' THEN 2 ELSE 3 END), target, value FROM ({_TARGETS})""",
    # filters, projections, scalar functions
    "allowed_events": "SELECT * FROM ev",
    "decoded_ids": "SELECT ordinal, md5(subject) AS node_id FROM prov",
    "object_ids": "SELECT ordinal, CASE WHEN ordinal % 5 <> 0 THEN object END AS object FROM prov",
    "optional_object": """
        SELECT type, CAST(0 AS BIGINT) AS n_objects, count(*) AS n_rows FROM prov GROUP BY 1""",
    "half_open_range": """
        SELECT * FROM prov WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20 12:00:00'""",
    "unusual_flows": f"""
        SELECT uuid, remote_address, remote_port::DOUBLE AS remote_port FROM net
        WHERE remote_port IS NULL OR remote_port NOT IN ({_PORTS})""",
    "known_parents": "SELECT uuid, parent_subject FROM subj WHERE parent_subject IS NOT NULL",
    "floored_times": """
        SELECT ordinal, date_trunc('minute', ts) AS minute, date_trunc('second', ts) AS second FROM prov""",
    "type_shares": """
        SELECT type, count(*) AS n_events,
               round(count(*) * 100.0 / (SELECT count(*) FROM prov), 2) AS share FROM prov GROUP BY 1""",
    "event_classes": """
        SELECT CASE WHEN contains(type, 'EXEC') THEN 'EXEC' WHEN contains(type, 'WRITE') THEN 'WRITE'
                    WHEN contains(type, 'READ') THEN 'READ' WHEN contains(type, 'SEND') THEN 'SEND'
                    ELSE 'OTHER' END AS event_class, count(*) AS n_events FROM prov GROUP BY 1""",
    "verdicts": """
        SELECT doc_id, CASE WHEN toxic = 1 THEN 'MALICIOUS' ELSE 'BENIGN' END AS verdict FROM labels""",
    "short_ids": "SELECT page_id, substr(md5(url), 1, 20) || '...' AS short_id FROM pages",
    "display_texts": """
        SELECT l_orderkey, l_linenumber, printf('%.1f%%', l_discount * 100) AS discount_text,
               strftime(l_shipdate, '%H:%M:%S') AS clock_text FROM lineitem""",
    "one_hot_events": f"SELECT window_start, source, target, {_BITS} AS event_bits FROM day_edges",
    # windows and labels
    "tumbling_windows": """
        SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n_events
        FROM hour_ev GROUP BY 1, 2""",
    "overlapping_windows": """
        SELECT s.window_start, s.window_start + INTERVAL 3 HOUR AS window_end, count(*) AS n_events,
               min(e.ordinal) AS first_ordinal, max(e.ordinal) AS last_ordinal
        FROM (SELECT DISTINCT window_start FROM hour_ev) s
        JOIN ev e ON e.ts >= s.window_start AND e.ts < s.window_start + INTERVAL 3 HOUR GROUP BY 1, 2""",
    "overlapping_event_windows": """
        SELECT s.window_start, s.window_start + INTERVAL 90 MINUTE AS window_end, e.ordinal
        FROM (SELECT DISTINCT window_start FROM hour_ev) s
        JOIN ev e ON e.ts >= s.window_start AND e.ts < s.window_start + INTERVAL 90 MINUTE""",
    "long_overlapping_windows": """
        SELECT m AS window_start, m + INTERVAL 2 DAY AS window_end, CAST(sum(n) OVER w AS BIGINT) AS n_events,
               min(a) OVER w AS first_ordinal, max(b) OVER w AS last_ordinal
        FROM (SELECT date_trunc('minute', ts) AS m, count(*) AS n, min(ordinal) AS a, max(ordinal) AS b
              FROM ev GROUP BY 1)
        WINDOW w AS (ORDER BY m RANGE BETWEEN CURRENT ROW AND INTERVAL '2879' MINUTE FOLLOWING)""",
    "anchored_windows": """
        SELECT window_id, lo + to_hours(CAST(window_id AS INTEGER)) AS window_start,
               lo + to_hours(CAST(window_id + 1 AS INTEGER)) AS window_end, count(*) AS n_events
        FROM (SELECT epoch_us(ts - lo) // 3600000000 AS window_id, lo, hi
              FROM ev, (SELECT min(ts) AS lo, max(ts) AS hi FROM ev))
        WHERE window_id * 3600000000 < epoch_us(hi - lo) GROUP BY 1, 2, 3""",
    "numbered_windows": """
        SELECT window_start, row_number() OVER (ORDER BY window_start) - 1 AS window_id
        FROM (SELECT DISTINCT window_start FROM hour_ev)""",
    "graph_windows": """
        SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start,
               time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end,
               count(*) AS n_events, (count(*) FILTER (type <> 'EVENT_CLOSE')) AS n_graph_events
        FROM prov GROUP BY 1, 2 HAVING count(*) FILTER (type <> 'EVENT_CLOSE') > 0""",
    "window_labels": f"""
        SELECT window_start, window_end, CAST(CASE WHEN {_ATTACK} THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM (SELECT DISTINCT window_start, window_start + INTERVAL 1 HOUR AS window_end FROM hour_ev)""",
    "window_labels_by_table": """
        SELECT window_start, window_end, CAST(max(CASE WHEN a.ts IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS label
        FROM (SELECT DISTINCT window_start, window_start + INTERVAL 1 HOUR AS window_end FROM hour_ev)
        LEFT JOIN events a ON a.value > 250 AND window_start <= a.ts + INTERVAL 90 MINUTE
             AND window_end >= a.ts GROUP BY 1, 2""",
    "window_statistics": "SELECT window_start, num_nodes, num_edges FROM labelled",
    # graphs
    "graph_nodes": "SELECT window_start, node_id, node_type, first_pos FROM day_roles",
    "graph_edges": """
        SELECT window_start, source, target, event, ts, n_events, first_ts, last_ts FROM day_edges""",
    "overlapping_graph_edges": """
        SELECT s.window_start, e.subject AS source, e.object AS target, arg_max(e.type, e.ordinal) AS event,
               arg_max(e.ts, e.ordinal) AS ts, count(*) AS n_events
        FROM (SELECT DISTINCT window_start FROM hour_ev) s
        JOIN ev e ON e.ts >= s.window_start AND e.ts < s.window_start + INTERVAL 3 HOUR
        WHERE e.object IS NOT NULL GROUP BY 1, 2, 3""",
    "isolated_nodes": "SELECT window_start, node_id, node_type FROM day_nodes WHERE degree = 0",
    "node_index": "SELECT * FROM day_index",
    "edge_index": """
        SELECT e.window_start, s.node_idx AS source_idx, t.node_idx AS target_idx, e.event
        FROM day_edges e
        JOIN day_index s ON s.window_start = e.window_start AND s.node_id = e.source
        JOIN day_index t ON t.window_start = e.window_start AND t.node_id = e.target""",
    "edge_index_placeholder": """
        SELECT w.window_start, coalesce(s.node_idx, 0) AS source_idx, coalesce(t.node_idx, 0) AS target_idx,
               e.event
        FROM (SELECT DISTINCT window_start FROM tenmin_ev) w
        LEFT JOIN tenmin_edges e ON e.window_start = w.window_start
        LEFT JOIN tenmin_index s ON s.window_start = e.window_start AND s.node_id = e.source
        LEFT JOIN tenmin_index t ON t.window_start = e.window_start AND t.node_id = e.target""",
    "undirected_pairs": """
        SELECT DISTINCT window_start, least(source, target) AS a, greatest(source, target) AS b FROM day_edges""",
    # node features
    "basic_node_features": """
        SELECT window_start, node_id, node_type_flag, degree, in_degree, out_degree, degree AS event_count,
               event_type_count, round(ts_var, 2) AS ts_var, degree AS activity_rate FROM day_nodes""",
    "time_node_features": """
        SELECT window_start, node_id,
               CASE WHEN out_degree > 1 THEN round(span / (out_degree - 1), 9) ELSE 0 END AS avg_ts_gap,
               round(coalesce(span, 0), 6) AS last_seen_delta,
               round(coalesce(sin(2 * pi() * tod / 86400), 0), 6) + 0.0 AS time_sin,
               round(coalesce(cos(2 * pi() * tod / 86400), 0), 6) + 0.0 AS time_cos
        FROM (SELECT *, epoch_us(last_out - first_out) / 1e6 AS span,
                     hour(first_out) * 3600 + minute(first_out) * 60 + second(first_out) AS tod
              FROM day_nodes)""",
    "burst_flags": "SELECT window_start, source, CAST(1 AS INTEGER) AS burst_flag FROM bursty",
    "temporal_entropy": """
        SELECT window_start, source, round(temporal_entropy, 6) + 0.0 AS temporal_entropy FROM entropy""",
    "closeness": "SELECT window_start, node_id, round(closeness, 9) AS closeness FROM close",
    "betweenness": "SELECT window_start, node_id, round(betweenness, 9) AS betweenness FROM between",
    "pagerank": "SELECT window_start, node_id, round(pagerank, 9) AS pagerank FROM pr",
    "centrality_by_joins": """
        SELECT window_start, node_id, round(closeness, 9) AS closeness, round(betweenness, 9) AS betweenness,
               round(pagerank, 9) AS pagerank, round(coalesce(cluster_coeff, 0), 9) AS cluster_coeff
        FROM close JOIN between USING (window_start, node_id) JOIN pr USING (window_start, node_id)
        LEFT JOIN clus USING (window_start, node_id)""",
    "cluster_coeff": """
        SELECT window_start, node_id, round(coalesce(cluster_coeff, 0), 9) AS cluster_coeff
        FROM day_nodes LEFT JOIN clus USING (window_start, node_id)""",
    "cluster_coeff_by_joins": """
        SELECT window_start, node_id, round(cluster_coeff, 9) AS cluster_coeff FROM clus""",
    "all_node_features": """
        SELECT x.window_start, x.node_id, node_type_flag::DOUBLE AS node_type_flag, degree::DOUBLE AS degree,
               in_degree::DOUBLE AS in_degree, out_degree::DOUBLE AS out_degree,
               degree::DOUBLE AS event_count, event_type_count::DOUBLE AS event_type_count,
               round(ts_var, 2) AS ts_var, round(closeness, 9) AS closeness,
               round(betweenness, 9) AS betweenness, round(pagerank, 9) AS pagerank,
               round(coalesce(cluster_coeff, 0), 9) AS cluster_coeff,
               CASE WHEN out_degree > 1 THEN round(span / (out_degree - 1), 9) ELSE 0 END AS avg_ts_gap,
               round(coalesce(span, 0), 9) AS last_seen_delta,
               CASE WHEN b.source IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS burst_flag,
               degree::DOUBLE AS activity_rate,
               round(coalesce(temporal_entropy, 0), 6) + 0.0 AS temporal_entropy,
               round(coalesce(sin(2 * pi() * tod / 86400), 0), 6) + 0.0 AS time_sin,
               round(coalesce(cos(2 * pi() * tod / 86400), 0), 6) + 0.0 AS time_cos
        FROM (SELECT *, epoch_us(last_out - first_out) / 1e6 AS span,
                     hour(first_out) * 3600 + minute(first_out) * 60 + second(first_out) AS tod
              FROM day_nodes) x
        JOIN close USING (window_start, node_id) JOIN between USING (window_start, node_id)
        JOIN pr USING (window_start, node_id) LEFT JOIN clus USING (window_start, node_id)
        LEFT JOIN bursty b ON b.window_start = x.window_start AND b.source = x.node_id
        LEFT JOIN entropy t ON t.window_start = x.window_start AND t.source = x.node_id""",
    # sequences
    "sequence_windows": """
        SELECT sequence_id, string_agg(window_id::VARCHAR, ',' ORDER BY window_id) AS window_ids
        FROM steps GROUP BY 1""",
    "sequence_labels": "SELECT sequence_id, CAST(max(label) AS INTEGER) AS label FROM steps GROUP BY 1",
    "sequence_members": """
        SELECT sequence_id, step, count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS degree
        FROM steps JOIN hour_nodes USING (window_start) GROUP BY 1, 2""",
    "centre_windows": "SELECT sequence_id, window_id FROM steps WHERE step = 1",
    # exploration and patterns
    "type_distribution": """
        SELECT type, count(*) AS n_events, round(count(*) * 100.0 / (SELECT count(*) FROM prov), 1) AS share
        FROM prov GROUP BY 1 ORDER BY n_events DESC, type LIMIT 10""",
    "time_range": """
        SELECT min(ts) AS first_ts, max(ts) AS last_ts,
               round(epoch_us(max(ts) - min(ts)) / 1e6, 6) AS duration_s FROM prov""",
    "events_per_minute": "SELECT date_trunc('minute', ts) AS minute, count(*) AS n_events FROM prov GROUP BY 1",
    "most_active_subjects": """
        SELECT subject, count(*) AS n_events FROM prov GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "described_subjects": """
        SELECT a.subject, a.n_events,
               coalesce('PID ' || s.cid || ' (' || s.type || ')', substr(a.subject, 1, 20) || '...') AS description
        FROM (SELECT subject, count(*) AS n_events FROM prov GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) a
        LEFT JOIN subj s ON s.uuid = a.subject""",
    "top_types_over_time": """
        SELECT date_trunc('minute', ts) AS minute, type, count(*) AS n_events FROM prov
        WHERE type IN (SELECT type FROM prov GROUP BY 1 ORDER BY count(*) DESC, type LIMIT 3) GROUP BY 1, 2""",
    "address_counts": """
        SELECT count(DISTINCT local_address) AS local_addresses,
               count(DISTINCT remote_address) AS remote_addresses FROM net""",
    "sketched_activity": """
        SELECT strftime(ts, '%Y-%m-%d') AS slices, name, count(DISTINCT v) AS n_exact, TRUE AS within_bound
        FROM (SELECT ts, 'subject' AS name, subject AS v FROM prov
              UNION ALL SELECT ts, 'object', object FROM prov UNION ALL SELECT ts, 'type', type FROM prov)
        GROUP BY 1, 2""",
    "sketched_addresses": """
        SELECT slices, name, count(DISTINCT v) AS n_exact, TRUE AS within_bound
        FROM (SELECT remote_port, 'local_address' AS name, local_address AS v FROM net
              UNION ALL SELECT remote_port, 'remote_address', remote_address FROM net),
             (SELECT unnest(['all', 'known', 'low']) AS slices)
        WHERE slices = 'all' OR remote_port < CASE slices WHEN 'low' THEN 500 ELSE 100000 END GROUP BY 1, 2""",
    "top_remote_addresses": """
        SELECT remote_address, count(*) AS n_flows FROM net WHERE remote_address IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "top_remote_ports": """
        SELECT remote_port, count(*) AS n_flows FROM net WHERE remote_port IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "burst_minutes": """
        SELECT minute, n_events, round(n_events / mean, 6) AS ratio
        FROM (SELECT date_trunc('minute', ts) AS minute, count(*) AS n_events,
                     avg(count(*)) OVER () AS mean FROM prov GROUP BY 1)
        WHERE n_events > 2 * mean""",
    "rare_types": f"""
        SELECT type, n_events, first_ts FROM ({_RARE})
        JOIN (SELECT type, min(ts) AS first_ts FROM prov GROUP BY 1) USING (type)""",
    "parent_coverage": "SELECT count(parent_subject) AS with_parent, count(*) AS total FROM subj",
    "top_parents": """
        SELECT p.parent_subject AS parent, s.cid, n_children
        FROM (SELECT parent_subject, count(*) AS n_children FROM subj WHERE parent_subject IS NOT NULL
              GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) p JOIN subj s ON s.uuid = p.parent_subject""",
    "repeated_remotes": """
        SELECT remote_address, count(*) AS n_flows FROM net WHERE remote_address IS NOT NULL
        GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "unusual_ports": f"""
        SELECT remote_port, count(*) AS n_flows FROM net WHERE remote_port NOT IN ({_PORTS})
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "long_gaps": """
        SELECT gap_start, gap_end, round(epoch_us(gap_end - gap_start) / 1e6, 6) AS gap_s
        FROM (SELECT lag(ts) OVER (ORDER BY ts) AS gap_start, ts AS gap_end FROM prov)
        WHERE gap_end - gap_start > INTERVAL 10 MINUTE ORDER BY gap_s DESC, gap_start LIMIT 5""",
    "all_long_gaps": """
        SELECT gap_start, gap_end, round(epoch_us(gap_end - gap_start) / 1e6, 6) AS gap_s
        FROM (SELECT lag(ts) OVER (ORDER BY ts) AS gap_start, ts AS gap_end FROM prov)
        WHERE gap_end - gap_start > INTERVAL 1 MINUTE""",
    "investigation_targets": _TARGETS,
    # propagation and scoring
    "edge_type_counts": f"SELECT window_start, source AS node_id, {_TYPE_COLUMNS} FROM day_edges GROUP BY 1, 2",
    "neighbour_means": """
        SELECT x.window_start, x.node_id, round(coalesce(i1, 0), 9) AS in_degree_h1,
               round(coalesce(t1, 0), 9) AS event_type_count_h1, round(coalesce(i2, 0), 9) AS in_degree_h2,
               round(coalesce(t2, 0), 9) AS event_type_count_h2
        FROM day_nodes x LEFT JOIN hop1 USING (window_start, node_id)
        LEFT JOIN hop2 USING (window_start, node_id)""",
    "graph_embedding": """
        SELECT window_start, n_nodes, round(node_type_flag, 6) AS node_type_flag,
               round(in_degree, 6) AS in_degree, round(out_degree, 6) AS out_degree,
               round(event_type_count, 6) AS event_type_count FROM embed""",
    "temporal_attention": """
        SELECT sequence_id, step, round(score, 6) AS score, round(weight, 6) AS weight FROM attention""",
    "attended_embedding": """
        SELECT sequence_id, CAST(label AS INTEGER) AS label, round(node_type_flag, 6) AS node_type_flag,
               round(in_degree, 6) AS in_degree, round(out_degree, 6) AS out_degree,
               round(event_type_count, 6) AS event_type_count FROM attended""",
    "stratified_split": _SPLIT.format(order="substr(md5(doc_id || '#7'), 1, 12), doc_id"),
    "ordered_split": _SPLIT.format(order="doc_id"),
    "class_weights": "SELECT doc_id, CASE WHEN toxic = 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS class_weight FROM labels",
    "evaluation": """
        SELECT count(*) AS n_rows, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
               round(count(*) FILTER (prediction = 1 AND label = 1) / count(*) FILTER (prediction = 1), 6) AS precision,
               round(count(*) FILTER (prediction = 1 AND label = 1) / count(*) FILTER (label = 1), 6) AS recall
        FROM predicted""",
    "node_importance": "SELECT * FROM winimp",
    # stories
    "severities": "SELECT sequence_id, CAST(prediction AS INTEGER) AS prediction, severity FROM severe",
    "flagged_steps": """
        SELECT sequence_id, CAST(step AS BIGINT) AS step, top_score, 'T1059 Command Execution' AS technique
        FROM flagged""",
    "event_techniques": """
        SELECT DISTINCT date_trunc('hour', ts) AS window_start,
               CASE type WHEN 'EVENT_EXECUTE' THEN 'T1059 Command Execution'
                    WHEN 'EVENT_WRITE' THEN 'T1105 Exfiltration' WHEN 'EVENT_READ' THEN 'T1087 Discovery'
                    WHEN 'EVENT_SENDTO' THEN 'T1041 Exfiltration Over Network' END AS technique
        FROM prov WHERE type <> 'EVENT_CLOSE'""",
    "stories": f"""
        SELECT sequence_id, severity, coalesce(k, 0) AS n_techniques, {_SEQ_TEXT} AS story
        FROM severe LEFT JOIN (SELECT sequence_id, count(*) AS k FROM flagged GROUP BY 1) USING (sequence_id)""",
    "top_nodes": """
        SELECT sequence_id, rank, CAST(step AS BIGINT) AS step, node_id, node_type, importance,
               printf('%.2f%%', importance * 100) AS score_text
        FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id
                     ORDER BY importance DESC, step, node_id) AS rank FROM seqimp)
        JOIN hour_roles USING (window_start, node_id) WHERE rank <= 5""",
    "edge_timeline": """
        SELECT window_start, row_number() OVER (PARTITION BY window_start ORDER BY ts, first_ordinal, target) - 1
               AS position, ts, strftime(ts, '%H:%M:%S') || ' → ' || source || ' ' || event || ' ' || target AS line
        FROM day_edges""",
    "step_weight_texts": """
        SELECT sequence_id, printf('T1: %.1f%% | T2: %.1f%% | T3: %.1f%%', w0 * 100, w1 * 100, w2 * 100)
               AS weights_text FROM seqweights""",
    "hot_nodes": """
        SELECT window_start, node_id, importance, round(heat, 6) AS heat
        FROM (SELECT *, importance / greatest(max(importance) OVER (PARTITION BY window_start), 1e-5) AS heat
              FROM winimp) WHERE heat > 0.6""",
    "subject_nodes": "SELECT window_start, node_id, degree FROM day_nodes WHERE node_type = 'subject'",
    "object_nodes": "SELECT window_start, node_id, degree FROM day_nodes WHERE node_type = 'object'",
    "resolved_edges": """
        SELECT e.window_start, e.source, e.target, e.event, s.node_type AS source_type,
               t.node_type AS target_type, s.degree AS source_degree, t.degree AS target_degree
        FROM day_edges e
        JOIN day_nodes s ON s.window_start = e.window_start AND s.node_id = e.source
        JOIN day_nodes t ON t.window_start = e.window_start AND t.node_id = e.target""",
    "explanation_documents": """
        SELECT sequence_id, CAST(step AS BIGINT) AS step, node_idx, importance
        FROM seqimp JOIN hour_index USING (window_start, node_id)""",
    "window_lookup": """
        SELECT window_start, source, target, event, ts FROM day_edges
        WHERE window_start = TIMESTAMP '2024-01-15'""",
    "sequence_scores": f"""
        SELECT sequence_id, CAST(label AS INTEGER) AS label, round(score, 6) AS score,
               CAST(score > 0.673 AS INTEGER) AS prediction
        FROM (SELECT sequence_id, max(label) AS label,
                     1 / (1 + exp(-({BIAS} + sum({_STEP_SCORE})))) AS score
              FROM steps JOIN embed USING (window_start) GROUP BY sequence_id)""",
    "separable_classifier": """
        SELECT count(*) AS n_test, CAST(sum(CAST(load > mean AS INTEGER)) AS BIGINT) AS n_busy, true AS accurate
        FROM (SELECT *, avg(load) FILTER (sequence_id < floor(n * 0.8)) OVER () AS mean
              FROM (SELECT sequence_id, sum(in_degree + event_type_count) AS load, count(*) OVER () AS n
                    FROM steps JOIN embed USING (window_start) GROUP BY sequence_id)) marked
        WHERE sequence_id >= floor(n * 0.8) + 2""",
    "boundary_split": """
        SELECT sequence_id, CAST(max(label) AS INTEGER) AS label,
               CASE WHEN sequence_id < floor(n * 0.8) THEN 'train'
                    WHEN sequence_id < floor(n * 0.8) + 2 THEN 'gap' ELSE 'test' END AS split
        FROM steps, (SELECT count(DISTINCT sequence_id) AS n FROM steps) GROUP BY sequence_id, n""",
    "story_lookup": f"""
        SELECT sequence_id, severity, {_SEQ_TEXT} AS story
        FROM severe LEFT JOIN (SELECT sequence_id, count(*) AS k FROM flagged GROUP BY 1) USING (sequence_id)
        WHERE sequence_id = 5""",
    "explanation_lookup": """
        SELECT sequence_id, CAST(step AS BIGINT) AS step, node_idx, importance
        FROM seqimp JOIN hour_index USING (window_start, node_id) WHERE sequence_id = 5""",
    "graph_lookup": """
        SELECT window_start, source, target, event, ts FROM hour_edges
        WHERE window_start = (SELECT window_start FROM steps WHERE sequence_id = 5 AND step = 1)""",
    # investigations
    "events_in_attack": """
        SELECT * FROM prov WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11 23:59:59'""",
    "trigger_events": """
        SELECT p.ordinal, p.ts, p.subject, s.cid::DOUBLE AS cid, s.type AS subject_type, s.parent_subject
        FROM prov p LEFT JOIN subj s ON s.uuid = p.subject
        WHERE p.type = 'EVENT_EXECUTE'""",
    "subject_actions": """
        SELECT subject, type, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts
        FROM prov GROUP BY 1, 2""",
    "process_ancestry": "SELECT uuid, ancestor, depth FROM lineage",
    "process_descent": "SELECT 'n1' AS root, uuid, depth FROM lineage WHERE ancestor = 'n1'",
    "subject_connections": """
        SELECT p.subject, p.object AS flow, f.remote_address, f.remote_port, count(*) AS n_events,
               min(p.ts) AS first_ts FROM prov p JOIN flow f ON f.uuid = p.object GROUP BY 1, 2, 3, 4""",
    "read_then_send": """
        SELECT s.subject, s.ordinal, s.object, s.ts AS send_ts,
               round(epoch_us(s.ts - max(r.ts)) / 1e6, 6) AS lag_s
        FROM prov s JOIN prov r ON r.subject = s.subject AND r.type = 'EVENT_READ' AND r.ts <= s.ts
             AND r.ts >= s.ts - INTERVAL 1 DAY
        WHERE s.type = 'EVENT_SENDTO' GROUP BY 1, 2, 3, 4""",
    "forward_reach": """
        SELECT node, min(moment) AS reached_at FROM passed WHERE node <> 'n7' GROUP BY 1""",
    "run_key_writes": """
        SELECT p.ordinal, p.ts, p.subject, p.object, r.key FROM prov p JOIN reg r ON r.uuid = p.object
        WHERE p.type = 'EVENT_WRITE' AND r.p_size < 10""",
    "deduplicated_records": "SELECT *, 'e' || ordinal AS uuid FROM prov",
    "record_count_check": """
        SELECT type, count(*) AS n_published, count(*) FILTER (type <> 'EVENT_CLOSE') AS n_received,
               count(*) FILTER (type = 'EVENT_CLOSE') AS n_missing FROM prov GROUP BY 1""",
    # streams
    "live_window_counts": """
        SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n_events FROM closedhour""",
    "live_burst_flags": """
        SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n_events,
               CAST(CASE WHEN n_events > 1.5 * (SELECT avg(n_events) FROM hourcount) THEN 1 ELSE 0 END AS INTEGER)
               AS burst FROM closedhour""",
    "live_node_features": """
        SELECT window_start, node_id, in_degree, out_degree, event_type_count,
               round(pagerank, 9) AS pagerank, round(closeness, 9) AS closeness
        FROM day_nodes JOIN pr USING (window_start, node_id) JOIN close USING (window_start, node_id)
        WHERE window_start + INTERVAL 1 DAY
              <= date_trunc('milliseconds', (SELECT max(ts) FROM ev)) - INTERVAL 2 HOUR""",
    "live_sequences": f"""
        SELECT host_id, first_start, last_start, label FROM (
            SELECT host_id, window_start AS first_start,
                   lead(window_start, 2) OVER w AS last_start,
                   CAST(greatest(l, lead(l) OVER w, lead(l, 2) OVER w) AS INTEGER) AS label
            FROM (SELECT host_id, window_start, CASE WHEN {_ATTACK} THEN 1 ELSE 0 END AS l
                  FROM (SELECT DISTINCT 'h' || CAST(substr(subject, 2) AS BIGINT) % 8 AS host_id,
                               c.window_start, c.window_start + INTERVAL 1 HOUR AS window_end
                        FROM closedhour c JOIN prov ON date_trunc('hour', ts) = c.window_start))
            WINDOW w AS (PARTITION BY host_id ORDER BY window_start))
        WHERE last_start IS NOT NULL""",
    "live_ordered_sequences": f"""
        SELECT host_id, first_start, last_start, label FROM (
            SELECT host_id, window_start AS first_start,
                   lead(window_start, 2) OVER w AS last_start,
                   CAST(greatest(l, lead(l) OVER w, lead(l, 2) OVER w) AS INTEGER) AS label
            FROM (SELECT host_id, window_start, CASE WHEN {_ATTACK} THEN 1 ELSE 0 END AS l
                  FROM (SELECT DISTINCT 'h' || CAST(substr(subject, 2) AS BIGINT) % 8 AS host_id,
                               c.window_start, c.window_start + INTERVAL 1 HOUR AS window_end
                        FROM closedhour c JOIN prov ON date_trunc('hour', ts) = c.window_start))
            WINDOW w AS (PARTITION BY host_id ORDER BY window_start))
        WHERE last_start IS NOT NULL""",
    "live_gaps": """
        SELECT host_id, gap_start, gap_end, round(epoch_us(gap_end - gap_start) / 1e6, 6) AS gap_s FROM (
            SELECT host_id, lag(b) OVER w AS gap_start, a AS gap_end FROM (
                SELECT host_id, min(ts) AS a, max(ts) AS b FROM (
                    SELECT host_id, ts, sum(fresh) OVER (PARTITION BY host_id ORDER BY ts, ordinal) AS s FROM (
                        SELECT 'h' || CAST(substr(subject, 2) AS BIGINT) % 8 AS host_id, ts, ordinal,
                               CASE WHEN ts - lag(ts) OVER (PARTITION BY CAST(substr(subject, 2) AS BIGINT) % 8
                                    ORDER BY ts, ordinal) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM prov))
                GROUP BY host_id, s)
            WHERE b + INTERVAL 20 MINUTE <= date_trunc('milliseconds', (SELECT max(ts) FROM prov)) - INTERVAL 2 HOUR
            WINDOW w AS (PARTITION BY host_id ORDER BY a))
        WHERE gap_start IS NOT NULL""",
    "live_marker_windows": """
        SELECT host_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, FALSE AS late, count(*) AS n_events
        FROM (SELECT 'h' || CAST(substr(subject, 2) AS BIGINT) % 2 AS host_id, date_trunc('hour', ts) AS window_start,
                     epoch_us(ts) AS us FROM prov),
             (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) - epoch_us(min(ts)) AS d FROM prov)
        WHERE CASE WHEN host_id = 'h0' THEN epoch_us(window_start) + 3600000000 <= a + (d * 3) // 4
                   ELSE us < a + (d * 2) // 4 END
        GROUP BY 1, 2""",
    "live_deduplicated": "SELECT *, 'e' || ordinal AS uuid FROM prov",
}

CTES["hop1"] = """
    SELECT e.window_start, e.target AS node_id, avg(s.in_degree) AS i1, avg(s.event_type_count) AS t1
    FROM day_edges e JOIN day_nodes s ON s.window_start = e.window_start AND s.node_id = e.source
    GROUP BY 1, 2"""
CTES["hop2"] = """
    SELECT e.window_start, e.target AS node_id, avg(coalesce(h.i1, 0)) AS i2, avg(coalesce(h.t1, 0)) AS t2
    FROM day_edges e LEFT JOIN hop1 h ON h.window_start = e.window_start AND h.node_id = e.source
    GROUP BY 1, 2"""
CTES["lineage"] = """
    SELECT uuid, parent_subject AS ancestor, CAST(1 AS INTEGER) AS depth FROM subj
    WHERE parent_subject IS NOT NULL AND parent_subject <> uuid
    UNION ALL
    SELECT l.uuid, s.parent_subject, l.depth + 1 FROM lineage l JOIN subj s ON s.uuid = l.ancestor
    WHERE s.parent_subject IS NOT NULL AND s.parent_subject <> s.uuid"""
CTES["passed"] = """
    SELECT 'n7' AS node, TIMESTAMP '1970-01-01' AS moment
    UNION
    SELECT p.object, p.ts FROM passed r JOIN prov p ON p.subject = r.node AND p.ts >= r.moment
    WHERE p.object IS NOT NULL AND p.object <> p.subject"""


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in _BODIES.items()}
