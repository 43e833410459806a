"""DuckDB SQL twins of the registered queries (same column names and types).

Used only as the correctness oracle; the library itself never runs SQL text
other than DDL. Parameters come from ``evlog.plans.queries``.
"""

from __future__ import annotations

from evlog.plans import queries as Q

ENV = f"""env AS (
  SELECT '{Q.HUB}' AS hub,
         CAST(user_id % {Q.PARTITIONS} AS INTEGER) AS partition_id,
         CAST(json_object('event_type', event_type, 'value', value, 'props', props) AS VARCHAR) AS body_text,
         event_id * 64 AS "offset",
         event_id AS seqNumber,
         epoch_us(ts) // 1000000 AS enqueuedTime,
         CAST(user_id AS VARCHAR) AS publisher,
         event_type AS partitionKey,
         props
  FROM events)"""

def _cells(batch_seconds: int, uids: str = f"('{Q.UID}')", second: str | None = None, where: str = "true") -> str:
    batch = f"enqueuedTime // {batch_seconds}"
    return f"""cells AS (
  SELECT uid, CASE uid WHEN '{Q.UID2}' THEN {second or batch} ELSE {batch} END AS batch_ts, hub, partition_id,
         arg_max("offset", seqNumber) AS end_offset, max(seqNumber) AS end_seq, count(*) AS n
  FROM env, (VALUES {uids}) AS readers(uid) WHERE {where} GROUP BY ALL)"""


BOTH = f"('{Q.UID}'), ('{Q.UID2}')"
CELLS = _cells(Q.LEDGER_BATCH_SECONDS, BOTH, f"enqueuedTime // {Q.LEDGER_BATCH_SECONDS} // {Q.UID2_STEP} * {Q.UID2_STEP} + {Q.UID2_PHASE}")

LEDGER = f"""parts AS (SELECT DISTINCT uid, hub, partition_id FROM cells),
rng AS (SELECT uid, min(batch_ts) AS lo, max(batch_ts) AS hi FROM cells GROUP BY uid),
grid AS (SELECT uid, hub, partition_id, unnest(generate_series(lo, hi, CASE uid WHEN '{Q.UID2}' THEN {{step}} ELSE 1 END)) AS batch_ts
         FROM parts JOIN rng USING (uid)),
ledger AS (
  SELECT g.batch_ts, g.uid, g.hub, g.partition_id,
         coalesce(last_value(c.end_offset IGNORE NULLS) OVER w, -1) AS end_offset,
         coalesce(last_value(c.end_seq IGNORE NULLS) OVER w, -1) AS end_seq,
         coalesce(c.n, 0) AS n
  FROM grid g LEFT JOIN cells c
    ON c.uid = g.uid AND c.hub = g.hub AND c.partition_id = g.partition_id AND c.batch_ts = g.batch_ts
  WINDOW w AS (PARTITION BY g.uid, g.hub, g.partition_id ORDER BY g.batch_ts
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
DAILY_LEDGER = LEDGER.format(step=1)
LEDGER = LEDGER.format(step=Q.UID2_STEP)

RAW_LEDGER = f"""raw_ledger AS (
  SELECT batch_ts, uid, hub, partition_id, end_offset, end_seq, n FROM cells WHERE uid = '{Q.UID}')"""

EXPECTED = f"""expected AS (SELECT DISTINCT '{Q.UID}' AS uid, hub, partition_id FROM env)"""
EXPECTED_BOTH = f"""expected AS (SELECT DISTINCT uid, hub, partition_id FROM env, (VALUES {BOTH}) AS readers(uid))"""

def _as_of(uid: str, name: str) -> str:
    return f"""{name} AS (
  SELECT '{uid}' AS uid, p.hub, p.partition_id,
         coalesce(f.batch_ts, -1) AS batch_ts, coalesce(f.end_offset, -1) AS end_offset,
         coalesce(f.end_seq, -1) AS end_seq
  FROM (SELECT DISTINCT hub, partition_id FROM ledger WHERE uid = '{uid}') p
  LEFT JOIN (SELECT * FROM ledger WHERE uid = '{uid}'
             AND batch_ts = (SELECT max(batch_ts) FROM ledger WHERE uid = '{uid}' AND batch_ts <= {Q.AS_OF_BATCH})) f
    ON f.hub = p.hub AND f.partition_id = p.partition_id)"""


AS_OF = _as_of(Q.UID, "as_of")
AS_OF_2 = _as_of(Q.UID2, "as_of_2")

LAG = """top AS (SELECT hub, partition_id, max(seqNumber) AS latest_seq FROM env GROUP BY ALL),
lag AS (
  SELECT t.hub, t.partition_id, coalesce(a.end_seq, -1) AS current_seq, t.latest_seq,
         greatest(t.latest_seq - coalesce(a.end_seq, -1), 0) AS lag,
         coalesce(a.end_seq, -1) >= t.latest_seq AS caught_up
  FROM top t LEFT JOIN as_of a ON a.hub = t.hub AND a.partition_id = t.partition_id)"""

LEDGER_TEXT = """ledger_text AS (
  SELECT CAST(batch_ts AS VARCHAR) || ' ' || uid || ' ' || hub || ' ' || CAST(partition_id AS VARCHAR) || ' '
         || CAST(end_offset AS VARCHAR) || CASE WHEN end_seq % 7 = 0 THEN '' ELSE ' ' || CAST(end_seq AS VARCHAR) END AS value,
         CASE WHEN batch_ts % 5 = 0 THEN batch_ts - 1 ELSE batch_ts END AS file_ts FROM {src})"""

PARSE = """parsed AS (
  SELECT file_ts, string_split(rtrim(value, ' '), ' ') AS p FROM ledger_text),
typed AS (
  SELECT file_ts, p,
         CASE WHEN regexp_full_match(p[1], '[+-]?[0-9]+') THEN TRY_CAST(p[1] AS BIGINT) END AS f0,
         p[2] AS f1, p[3] AS f2,
         CASE WHEN regexp_full_match(p[4], '[+-]?[0-9]+') THEN TRY_CAST(p[4] AS INTEGER) END AS f3,
         CASE WHEN regexp_full_match(p[5], '[+-]?[0-9]+') THEN TRY_CAST(p[5] AS BIGINT) END AS f4,
         CASE WHEN regexp_full_match(p[6], '[+-]?[0-9]+') THEN TRY_CAST(p[6] AS BIGINT) END AS f5
  FROM parsed),
records AS (
  SELECT *, coalesce(len(p) = 6 AND f0 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL AND f5 IS NOT NULL,
                     false) AS is_valid FROM typed)"""

PARSED_COLUMNS = """CASE WHEN is_valid THEN f0 END AS batch_ts, CASE WHEN is_valid THEN f1 END AS uid,
       CASE WHEN is_valid THEN f2 END AS hub, CASE WHEN is_valid THEN f3 END AS partition_id,
       CASE WHEN is_valid THEN f4 END AS end_offset, CASE WHEN is_valid THEN f5 END AS end_seq, is_valid"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _ledger(*more: str) -> str:
    return _with(ENV, CELLS, LEDGER, *more)


# The report of a CTE named ledger.
REPORT = """, r AS (
        SELECT uid, batch_ts, hub, partition_id,
               end_seq - coalesce(lag(end_seq) OVER w, -1) AS size,
               'eventhub: ' || hub || '-partition-' || CAST(partition_id AS VARCHAR) || chr(9)
                 || 'starting offsets: ' || CAST(coalesce(lag(end_offset) OVER w, -1) AS VARCHAR)
                 || 'sequenceNumbers: ' || CAST(coalesce(lag(end_seq) OVER w, -1) AS VARCHAR)
                 || ' to ' || CAST(end_seq AS VARCHAR) AS line
        FROM ledger WINDOW w AS (PARTITION BY uid, hub, partition_id ORDER BY batch_ts))
        SELECT uid, batch_ts, CAST(sum(size) AS BIGINT) AS input_size, sum(size) >= 0 AS valid,
               string_agg(line, chr(10) ORDER BY hub, partition_id) AS description
        FROM r GROUP BY uid, batch_ts"""

SQL: dict[str, str] = {
    "envelope": _with(ENV) + """SELECT hub, partition_id, body_text, "offset", seqNumber, enqueuedTime,
        publisher, partitionKey FROM env""",
    "properties": _with(ENV) + """SELECT seqNumber, CAST(len(json_keys(props)) AS INTEGER) AS n_props,
        json_extract_string(props, '$.k') AS prop_k FROM env""",
    "property_keys": _with(ENV) + """SELECT seqNumber, coalesce(json_extract_string(props, '$.k'), '') AS k,
        coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM env""",
    "payload_text": _with(ENV) + "SELECT body_text AS EventDetails FROM env",
    "payload_json": _with(ENV) + "SELECT to_json({'EventDetails': body_text})::VARCHAR AS value FROM env",
    "one_partition": _with(ENV) + """SELECT partition_id, seqNumber, "offset", enqueuedTime FROM env
        WHERE partition_id = 2""",
    "union_partitions": _with(ENV) + """SELECT hub, partition_id, seqNumber, "offset" FROM env""",
    "union_hubs": f"""SELECT event_type AS hub,
        CAST(user_id % (CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in Q.HUB_PARTITIONS.items())} END)
             AS INTEGER) AS partition_id,
        event_id AS seqNumber, event_type AS partitionKey FROM events
        WHERE event_type IN ({', '.join(f"'{k}'" for k in Q.HUB_PARTITIONS)})""",
    "start_from_checkpoint": _ledger(AS_OF) + """SELECT e.hub, e.partition_id, e.seqNumber, e."offset" FROM env e
        LEFT JOIN as_of a ON a.hub = e.hub AND a.partition_id = e.partition_id
        WHERE CASE WHEN a.end_offset IS NOT NULL AND a.end_offset <> -1 THEN e."offset" > a.end_offset
              ELSE true END""",
    "start_from_offset": _with(ENV) + f"""SELECT hub, partition_id, seqNumber, "offset" FROM env
        WHERE "offset" > {Q.START_OFFSET}""",
    "start_from_time": _with(ENV) + f"""SELECT hub, partition_id, seqNumber, enqueuedTime FROM env
        WHERE enqueuedTime > {Q.START_TIME}""",
    "slice_ranges": _with(ENV) + f""", b AS (
        SELECT hub, partition_id, CAST(CASE partition_id WHEN 3 THEN -1 ELSE partition_id * {Q.RANGE_FROM_STRIDE} END AS BIGINT) AS from_seq,
               least(max(seqNumber), CASE partition_id WHEN 3 THEN -1 ELSE partition_id * {Q.RANGE_FROM_STRIDE} END + {Q.RANGE_MAX_RATE}) AS until_seq
        FROM env GROUP BY hub, partition_id)
        SELECT e.hub, e.partition_id, e.seqNumber, e."offset", b.from_seq, b.until_seq
        FROM env e JOIN b ON b.hub = e.hub AND b.partition_id = e.partition_id
        WHERE e.seqNumber > b.from_seq AND e.seqNumber <= b.until_seq""",
    "partition_lag": _ledger(AS_OF, LAG) + "SELECT * FROM lag",
    "total_lag": _ledger(AS_OF, LAG) + """SELECT CAST(sum(lag) AS BIGINT) AS total_lag,
        count(*) FILTER (WHERE caught_up) AS caught_up_partitions, count(*) AS partitions FROM lag""",
    "slice_ranges_per_hub": f"""WITH e AS (
          SELECT event_type AS hub,
                 CAST(user_id % (CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in Q.HUB_PARTITIONS.items())}
                      END) AS INTEGER) AS partition_id,
                 event_id AS seqNumber FROM events),
        b AS (SELECT hub, partition_id, CAST(partition_id * {Q.RANGE_FROM_STRIDE} AS BIGINT) AS from_seq,
                     least(max(seqNumber), partition_id * {Q.RANGE_FROM_STRIDE} + CASE hub
                       {' '.join(f"WHEN '{k}' THEN {v}" for k, v in Q.HUB_MAX_RATE.items())} ELSE 10000 END)
                       AS until_seq
              FROM e GROUP BY hub, partition_id)
        SELECT e.hub, e.partition_id, e.seqNumber, b.from_seq, b.until_seq
        FROM e JOIN b ON b.hub = e.hub AND b.partition_id = e.partition_id
        WHERE e.seqNumber > b.from_seq AND e.seqNumber <= b.until_seq""",
    "non_empty": _with(ENV) + """SELECT hub, partition_id, count(*) AS n_events,
        count(*) FILTER (WHERE seqNumber % 10 > 1) AS n_non_empty, count(*) FILTER (WHERE seqNumber % 10 > 1) AS n_kept FROM env GROUP BY ALL""",
    "window_counts": _with(ENV) + f""", w AS (SELECT enqueuedTime - enqueuedTime % {Q.WINDOW_SECONDS} AS ws FROM env),
        s AS (SELECT unnest(generate_series(min(ws), max(ws), {Q.WINDOW_SECONDS})) AS window_start FROM w)
        SELECT s.window_start, count(w.ws) AS n FROM s LEFT JOIN w ON w.ws = s.window_start GROUP BY 1""",
    "running_total": _with(ENV) + f""", w AS (SELECT enqueuedTime - enqueuedTime % {Q.WINDOW_SECONDS} AS ws FROM env),
        s AS (SELECT unnest(generate_series(min(ws), max(ws), {Q.WINDOW_SECONDS})) AS window_start FROM w),
        c AS (SELECT s.window_start, count(w.ws) AS n FROM s LEFT JOIN w ON w.ws = s.window_start GROUP BY 1)
        SELECT window_start, n, CAST(sum(n) OVER (ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING
               AND CURRENT ROW) AS BIGINT) AS total FROM c""",
    "sequence_gaps": _with(ENV) + f""", g AS (
        SELECT hub, partition_id, enqueuedTime // {Q.LEDGER_BATCH_SECONDS} AS batch_ts,
               count(*) FILTER (WHERE length(body_text) > 0) AS n, min(seqNumber) AS min_seq,
               max(seqNumber) AS max_seq
        FROM env GROUP BY ALL)
        SELECT hub, partition_id, batch_ts, n, min_seq, max_seq, max_seq - min_seq - n + 1 AS missing,
               min_seq - (coalesce(lag(max_seq) OVER (PARTITION BY hub, partition_id ORDER BY batch_ts), 0) + 1)
                 AS discontinuity
        FROM g""",
    "end_positions": _with(ENV) + """SELECT hub, partition_id, arg_max("offset", seqNumber) AS end_offset,
        max(seqNumber) AS end_seq, count(*) AS n FROM env GROUP BY ALL""",
    "ledger_rows": _ledger() + "SELECT batch_ts, uid, hub, partition_id, end_offset, end_seq, n FROM ledger",
    "parse_ledger": _ledger(LEDGER_TEXT.format(src="ledger"), PARSE) + f"SELECT {PARSED_COLUMNS} FROM records",
    "ledger_as_of": _ledger(AS_OF, AS_OF_2) + "SELECT * FROM as_of UNION ALL SELECT * FROM as_of_2",
    "ledger_as_of_exact": _with(ENV, CELLS, RAW_LEDGER, EXPECTED) + f"""
        SELECT '{Q.UID}' AS uid, x.hub, x.partition_id, coalesce(r.batch_ts, -1) AS batch_ts,
               coalesce(r.end_offset, -1) AS end_offset, coalesce(r.end_seq, -1) AS end_seq
        FROM expected x LEFT JOIN raw_ledger r ON r.uid = x.uid AND r.hub = x.hub
             AND r.partition_id = x.partition_id AND r.batch_ts = {Q.AS_OF_BATCH}""",
    "ledger_merge": _ledger(AS_OF) + f""", upd AS (
        SELECT '{Q.UID}' AS uid, hub, partition_id, CAST({Q.AS_OF_BATCH + 1} AS BIGINT) AS batch_ts,
               arg_max("offset", seqNumber) AS end_offset, max(seqNumber) AS end_seq
        FROM env WHERE enqueuedTime > (SELECT max(enqueuedTime) FROM env) - {Q.LAST_BATCH_SECONDS}
        GROUP BY ALL)
        SELECT coalesce(u.uid, a.uid) AS uid, coalesce(u.hub, a.hub) AS hub,
               coalesce(u.partition_id, a.partition_id) AS partition_id,
               CASE WHEN u.uid IS NOT NULL THEN u.batch_ts ELSE a.batch_ts END AS batch_ts,
               CASE WHEN u.uid IS NOT NULL THEN u.end_offset ELSE a.end_offset END AS end_offset,
               CASE WHEN u.uid IS NOT NULL THEN u.end_seq ELSE a.end_seq END AS end_seq
        FROM as_of a FULL OUTER JOIN upd u
          ON u.uid = a.uid AND u.hub = a.hub AND u.partition_id = a.partition_id""",
    "ledger_audit": _with(ENV, CELLS, RAW_LEDGER, EXPECTED, LEDGER_TEXT.format(src="raw_ledger"), PARSE) + f""",
        rec AS (SELECT file_ts, {PARSED_COLUMNS} FROM records),
        marked AS (SELECT rec.*, x.uid IS NOT NULL AS in_expected FROM rec LEFT JOIN expected x
                   ON x.uid = rec.uid AND x.hub = rec.hub AND x.partition_id = rec.partition_id),
        per AS (SELECT file_ts, count(*) AS n_records, count(*) FILTER (WHERE NOT is_valid) AS n_malformed,
                       count(DISTINCT CASE WHEN is_valid THEN batch_ts END) AS n_timestamps,
                       count(DISTINCT CASE WHEN is_valid AND in_expected THEN (uid, hub, partition_id) END)
                         AS present
                FROM marked GROUP BY file_ts)
        SELECT file_ts, n_records, n_malformed, n_timestamps,
               (SELECT count(*) FROM expected) - present AS n_missing,
               n_malformed = 0 AND n_timestamps = 1 AND present = (SELECT count(*) FROM expected) AS valid
        FROM per""",
    "lost_partitions": _with(ENV, _cells(Q.LOST_BATCH_SECONDS, BOTH, f"enqueuedTime // {Q.LEDGER_BATCH_SECONDS} // 5 * 5 + 4"), EXPECTED_BOTH) + f"""
        SELECT x.uid, x.hub, x.partition_id FROM expected x
        WHERE x.uid = '{Q.UID}' AND NOT EXISTS (SELECT 1 FROM cells r WHERE r.uid = x.uid AND r.hub = x.hub
              AND r.partition_id = x.partition_id AND r.batch_ts = (SELECT max(batch_ts) FROM cells WHERE uid = '{Q.UID}'))""",
    "ledger_batch": _ledger() + f"""SELECT uid, hub, partition_id, end_offset, end_seq FROM ledger
        WHERE batch_ts = {Q.BOTH_BATCH}""",
    "ledger_stored_batch": _with(ENV, _cells(Q.STORED_BATCH_SECONDS, BOTH, where=f"uid = '{Q.UID}' OR partition_id <> 0"), DAILY_LEDGER) + f"""SELECT uid, hub, partition_id,
        end_offset, end_seq FROM ledger WHERE batch_ts = {Q.STORED_AS_OF_BATCH}""",
    "ledger_retain": _ledger() + f"""SELECT * FROM ledger l WHERE batch_ts > {Q.AS_OF_BATCH}
        OR batch_ts = (SELECT max(batch_ts) FROM ledger m WHERE m.uid = l.uid AND batch_ts <= {Q.AS_OF_BATCH})""",
    "batch_report": _ledger() + REPORT,
}
SQL["slice_ranges_indexed"] = SQL["slice_ranges"]
_DAILY = _with(ENV, _cells(Q.STORED_BATCH_SECONDS, BOTH, where=f"uid = '{Q.UID}' OR partition_id <> 0"), DAILY_LEDGER)
SQL["ledger_cleaned"] = _DAILY + f"""SELECT * FROM ledger l WHERE batch_ts > {Q.STORED_AS_OF_BATCH}
    OR batch_ts = (SELECT max(batch_ts) FROM ledger m WHERE m.uid = l.uid AND batch_ts <= {Q.STORED_AS_OF_BATCH})"""
SQL["ledger_audit_files"] = SQL["ledger_audit"]
SQL["ledger_as_of_many"] = _ledger() + f""", asked AS (
    SELECT uid, unnest(range((SELECT min(batch_ts) - 10 FROM ledger), (SELECT max(batch_ts) + 11 FROM ledger), {Q.MANY_STEP})) AS ts
    FROM (VALUES {BOTH}) AS readers(uid)),
    batches AS (SELECT DISTINCT uid, batch_ts FROM ledger),
    newest AS (SELECT a.uid, a.ts, b.batch_ts AS newest FROM asked a ASOF LEFT JOIN batches b ON a.uid = b.uid AND a.ts >= b.batch_ts)
    SELECT r.uid, r.ts, p.hub, p.partition_id, coalesce(l.batch_ts, -1) AS batch_ts, coalesce(l.end_offset, -1) AS end_offset,
           coalesce(l.end_seq, -1) AS end_seq
    FROM newest r JOIN (SELECT DISTINCT uid, hub, partition_id FROM ledger) p ON p.uid = r.uid
    LEFT JOIN ledger l ON l.uid = r.uid AND l.batch_ts = r.newest AND l.hub = p.hub AND l.partition_id = p.partition_id"""
SQL["ledger_audit_readers"] = _with(ENV, CELLS) + f""", l AS (SELECT * FROM cells WHERE uid = '{Q.UID}' OR partition_id <> 0),
    x AS (SELECT uid, count(DISTINCT (hub, partition_id)) AS n FROM l GROUP BY uid)
    SELECT l.uid, batch_ts, count(*) AS n_records, CAST(0 AS BIGINT) AS n_malformed, count(DISTINCT batch_ts) AS n_timestamps,
           any_value(x.n) - count(*) AS n_missing, any_value(x.n) = count(*) AS valid
    FROM l JOIN x ON x.uid = l.uid GROUP BY l.uid, batch_ts"""
