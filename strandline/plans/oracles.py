"""The registered queries in standard SQL, to compare results with."""

from __future__ import annotations

AS_OF = "DATE '2030-01-01'"

DAILY_ORDERS = """SELECT o_custkey, CAST(o_orderdate AS DATE) AS dt, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
FROM orders GROUP BY 1, 2"""

BAND = "CASE WHEN {v} <= 20 THEN CAST(floor({v} / 10) AS BIGINT) END"

DAILY_EVENTS = f"""SELECT user_id, dt, event_type, {BAND.format(v='value')} AS vb
FROM (SELECT *, CAST(ts AS DATE) AS dt,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn
      FROM events) WHERE rn = 1"""

REFERENCE = ("({c} <> {f}({c}) OVER w OR {f}({c}) OVER w IS NULL)",) * 2
DISTINCT = (
    "({c} IS DISTINCT FROM lag({c}) OVER w OR row_number() OVER w = 1)",
    "({c} IS DISTINCT FROM lead({c}) OVER w OR row_number() OVER w = count(*) OVER k)",
)


def history(
    base: str,
    key: str,
    compared: list[str],
    kept: list[str],
    time: str = "dt",
    order: str | None = None,
    as_of: str = AS_OF,
    flags: tuple[str, str] = REFERENCE,
) -> str:
    """Three levels: flags; start-or-end rows with the next time; start rows with the next time."""
    order = order or time
    start = " OR ".join(flags[0].format(c=c, f="lag") for c in compared)
    end = " OR ".join(flags[1].format(c=c, f="lead") for c in compared)
    window = f"WINDOW w AS (PARTITION BY {key} ORDER BY {order} NULLS FIRST)"
    columns = ", ".join([key, *kept])
    return f"""WITH base AS ({base}),
flagged AS (SELECT *, {start} AS s, {end} AS e FROM base {window}, k AS (PARTITION BY {key})),
changed AS (SELECT *, CASE WHEN e THEN {time} ELSE lead({time}) OVER w END AS until
            FROM flagged WHERE s OR e {window}),
starts AS (SELECT *, lead({time}) OVER w AS following FROM changed WHERE s {window})
SELECT {columns}, {time} AS valid_from,
       CASE WHEN following IS NULL THEN {as_of} ELSE until END AS valid_to FROM starts"""


EVENTS_HISTORY = history(DAILY_EVENTS, "user_id", ["event_type", "vb"], ["event_type", "vb"])
VB_HISTORY = history(DAILY_EVENTS, "user_id", ["vb"], ["event_type", "vb"])

DAILY_FAILED = f"SELECT *, event_type = 'error' AS failed FROM ({DAILY_EVENTS})"


def attribute_history(attribute: str, base: str = DAILY_FAILED) -> str:
    return history(base, "user_id", [attribute], [attribute])


DAILY_NULLABLE = f"SELECT * REPLACE (nullif(event_type, 'click') AS event_type) FROM ({DAILY_FAILED})"


def overlap(left: str, right: str, ours: list[str], theirs: list[str], key: str = "user_id") -> str:
    columns = ", ".join([*(f"a.{c}" for c in ours), *(f"b.{c}" for c in theirs)])
    return f"""SELECT a.{key}, {columns}, greatest(a.valid_from, b.valid_from) AS valid_from,
       least(a.valid_to, b.valid_to) AS valid_to
FROM ({left}) a JOIN ({right}) b
  ON a.{key} = b.{key} AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to"""


def hot_history(attribute: str) -> str:
    return history(
        f"SELECT *, {BAND.format(v='value')} AS vb, CAST(floor(user_id / 50) AS BIGINT) AS ub FROM events",
        "event_type",
        [attribute],
        ["event_id", attribute],
        time="ts",
        order="ts, event_id",
        as_of="TIMESTAMP '2030-01-01'",
    )


MONTHLY = "CAST(strftime(o_orderdate, '%Y%m01') AS INTEGER)"
USER_DAYS = "SELECT CAST(user_id AS VARCHAR) AS asset, CAST(ts AS DATE) AS partition, event_type FROM events"
FRONTIER = f"""SELECT asset, partition FROM (
    SELECT *, row_number() OVER (PARTITION BY asset ORDER BY partition) AS rn
    FROM (SELECT DISTINCT asset, partition FROM ({USER_DAYS}) WHERE partition >= DATE '2024-01-01'))
WHERE partition - DATE '2024-01-01' = rn - 1"""
PRIORITY_READY = """SELECT partition,
       n = 3 AND coalesce(newest = partition, false) AS ready_exact,
       n = 3 AND coalesce(newest >= partition, false) AS ready_at_least
FROM (SELECT CAST(o_orderdate AS DATE) AS partition,
             count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                                 THEN o_orderpriority END) AS n FROM orders GROUP BY 1),
     (SELECT arg_max(CAST(o_orderdate AS DATE), o_orderkey) AS newest FROM orders WHERE o_orderpriority = '5-LOW')"""
EVENTS_WITH_DAY = """SELECT event_id, ts, user_id, event_type, value, props,
       strftime(ts, '%Y-%m-%d') AS event_dt"""

THREE_ATTRIBUTES = overlap(
    overlap(attribute_history("event_type"), attribute_history("vb"), ["event_type"], ["vb"]),
    attribute_history("failed"),
    ["event_type", "vb"],
    ["failed"],
)


ORACLES: dict[str, str] = {
    "scd2_orders": history(DAILY_ORDERS, "o_custkey", ["o_orderstatus"], ["o_orderstatus"]),
    "scd2_events": EVENTS_HISTORY,
    "scd2_events_one_col": VB_HISTORY,
    "scd2_events_distinct": history(
        DAILY_EVENTS, "user_id", ["event_type", "vb"], ["event_type", "vb"], flags=DISTINCT
    ),
    "scd2_hot_keys": hot_history("vb"),
    "scd2_incremental": EVENTS_HISTORY,
    "scd2_append": EVENTS_HISTORY,
    "scd2_late_days": EVENTS_HISTORY,
    "change_flags": f"""SELECT user_id, dt, event_type, vb,
       vb <> lag(vb) OVER w OR lag(vb) OVER w IS NULL AS is_start,
       vb <> lead(vb) OVER w OR lead(vb) OVER w IS NULL AS is_end
FROM ({DAILY_EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY dt)""",
    "change_flags_hot_keys": f"""SELECT event_type, ts, event_id, vb,
       vb <> lag(vb) OVER w OR lag(vb) OVER w IS NULL AS is_start,
       vb <> lead(vb) OVER w OR lead(vb) OVER w IS NULL AS is_end
FROM (SELECT *, {BAND.format(v='value')} AS vb FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
    "history_order_ties": """SELECT l_orderkey, l_linenumber, count(*) AS rows
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "combine_overlap": overlap(EVENTS_HISTORY, VB_HISTORY, ["event_type"], ["vb"]),
    "combine_three": THREE_ATTRIBUTES,
    "combine_three_nullable": overlap(
        overlap(
            attribute_history("event_type", DAILY_NULLABLE), attribute_history("vb", DAILY_NULLABLE), ["event_type"], ["vb"]
        ),
        attribute_history("failed", DAILY_NULLABLE),
        ["event_type", "vb"],
        ["failed"],
    ),
    "combine_hot_keys": overlap(
        f"SELECT * RENAME (event_id AS vb_event) FROM ({hot_history('vb')})",
        f"SELECT * RENAME (event_id AS ub_event) FROM ({hot_history('ub')})",
        ["vb_event", "vb"],
        ["ub_event", "ub"],
        key="event_type",
    ),
    "arrivals": "SELECT DISTINCT 'events_asset' AS asset, CAST(ts AS DATE) AS partition FROM events",
    "landing_lineage": f"{EVENTS_WITH_DAY}, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS dt FROM events",
    "rejected_values": """SELECT 'events_asset' AS asset, CAST(ts AS DATE) AS partition, count(*) AS row_count,
        count(*) FILTER (user_id > 127) AS rejected FROM events GROUP BY 2""",
    "partition_roundtrip": f"SELECT *, {MONTHLY} AS dt FROM orders",
    "partition_pruned": f"SELECT *, {MONTHLY} AS dt FROM orders WHERE {MONTHLY} = 19960301",
    "partition_decode": """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       strftime(o_orderdate, '%Y-%m-01') AS partition_key,
       strftime(o_orderdate, '%Y%m%d000000_') || strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d000000') AS window,
       CAST(o_orderdate AS DATE) + 1 AS next_day
FROM orders""",
    "partition_row_counts": f"SELECT {MONTHLY} AS dt, count(*) AS row_count FROM orders GROUP BY 1",
    "written_row_count": "SELECT count(*) AS observed, count(*) AS found FROM lineitem",
    "zone_view": "SELECT * FROM customer",
    "csv_roundtrip": "SELECT * FROM orders",
    "decimal_to_double": """SELECT l_orderkey, l_linenumber, CAST(p AS DOUBLE) AS price, CAST(t AS DOUBLE) AS tax,
       CAST(p AS DOUBLE) AS first_price, CAST(p AS DOUBLE) AS flag_price
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(15, 2)) AS p, CAST(l_tax AS DECIMAL(4, 2)) AS t FROM lineitem)""",
    "ledger_latest": """SELECT event_type AS asset, CAST(arg_max(ts, event_id) AS DATE) AS latest_partition,
       CAST(arg_max(user_id, event_id) AS VARCHAR) AS run_key, max(event_id) AS seq,
       CAST(regexp_extract(arg_max(props, event_id), '([0-9]+)', 1) AS BIGINT) AS k
FROM events GROUP BY 1""",
    "ledger_exists": """SELECT CAST(user_id AS VARCHAR) AS run_key, count(*) AS records FROM events
WHERE event_type = 'signup' AND CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 1""",
    "ledger_counts": """SELECT event_type AS asset, CAST(ts AS DATE) AS partition, count(*) AS records,
       CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS rows_written,
       CAST(floor(arg_max(value, event_id)) AS BIGINT) AS row_count
FROM events GROUP BY 1, 2""",
    "ledger_runs": "SELECT count(DISTINCT user_id) AS runs FROM events",
    "ledger_latest_partition": "SELECT max(CAST(o_orderdate AS DATE)) AS latest_partition FROM orders",
    "arrival_frontier": FRONTIER,
    "next_due": """SELECT CAST(c_custkey AS VARCHAR) AS asset,
       coalesce(max(CAST(o_orderdate AS DATE)) + 1, DATE '1995-01-01') AS next_date
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "due_requests": f"""WITH due AS (
    SELECT u.asset, coalesce(max(f.partition) + 1, DATE '2024-01-01') AS next_date
    FROM (SELECT DISTINCT asset FROM ({USER_DAYS})) u LEFT JOIN ({FRONTIER}) f ON u.asset = f.asset GROUP BY 1),
wanted AS (SELECT *, 'upload/' || strftime(next_date, '%Y-%m-%d') || '/' || asset || '.csv' AS path,
       EXISTS (SELECT 1 FROM ({USER_DAYS}) d WHERE d.asset = due.asset AND d.partition = due.next_date) AS requested
    FROM due)
SELECT *, CASE WHEN NOT requested THEN 'Did not find file ' || path END AS skip_reason FROM wanted""",
    "unprocessed_arrivals": f"""SELECT DISTINCT asset, partition FROM ({USER_DAYS}) a WHERE NOT EXISTS (
    SELECT 1 FROM ({USER_DAYS}) p
    WHERE p.asset = a.asset AND p.partition = a.partition AND p.event_type IN ('click', 'view'))""",
    "pending_backlog": f"""SELECT asset, partition
FROM (SELECT DISTINCT asset FROM ({USER_DAYS})),
     (SELECT CAST(d AS DATE) AS partition
      FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(d))
EXCEPT SELECT asset, partition FROM ({USER_DAYS})""",
    "readiness": PRIORITY_READY,
    "next_ready": f"""SELECT partition FROM ({PRIORITY_READY}) WHERE ready_at_least AND partition =
    (SELECT coalesce(arg_max(CAST(o_orderdate AS DATE), o_orderkey) + 1, DATE '1995-01-01')
     FROM orders WHERE o_orderpriority = '3-MEDIUM')""",
    "model_first": "SELECT *, 1 AS id FROM customer",
    "model_second": "SELECT *, 1 AS id FROM customer",
    "model_checks": """SELECT t AS "table", 'id' AS "column", c AS "check", CASE WHEN c = 'unique' THEN n ELSE 0 END AS failures
FROM (VALUES ('model_first'), ('model_second')) a(t), (VALUES ('unique'), ('not_null')) b(c),
     (SELECT CAST(count(*) > 1 AS BIGINT) AS n FROM customer)""",
    "dq_unique": "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1",
    "dq_not_null": f"SELECT * FROM ({DAILY_EVENTS}) WHERE vb IS NULL",
    "stream_ingest": f"{EVENTS_WITH_DAY}, CAST(ts AS DATE) AS dt FROM events",
    "stream_history": history(
        f"SELECT *, strftime(dt, '%Y-%m-%d') AS event_dt FROM ({DAILY_EVENTS})",
        "user_id",
        ["event_type", "vb"],
        ["event_type", "vb", "event_dt"],
    ),
    "chain_models": f"""SELECT CAST(user_id AS VARCHAR) AS key, event_type AS daily_event_type, vb AS daily_vb,
       valid_from, valid_to, 1 AS id FROM ({EVENTS_HISTORY})""",
    "chain_gate": f"""SELECT CAST(user_id AS VARCHAR) AS key, event_type AS kind_event_type, vb AS band_vb, failed AS failing_failed,
       valid_from, valid_to, 1 AS id FROM ({THREE_ATTRIBUTES})""",
    "stream_ledger": """SELECT 'events_asset' AS asset, CAST(ts AS DATE) AS partition, count(*) AS row_count
FROM events GROUP BY 2""",
}
