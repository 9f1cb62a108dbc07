"""Every registered query over the stream-graph operators, with the SQL it is checked against where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata, tensors
from ..functions.ordering import DAY_US, day, micros
from ..functions.rotations import about_z, euler, flat, from_euler, from_flat, pose, power, yaw
from ..operators import conditions, images, inference, poses, queues, routing, tracking
from ..sources import generators, recording
from .process import process

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: us (microseconds), day (a coarse order for windows)."""
    return _table(spark, sf_dir, "events").withColumn("us", micros("ts")).withColumn("day", day("ts"))


EVENTS = "e AS (SELECT *, epoch_us(ts)::bigint AS us FROM events)"


def _day() -> Column:
    return F.floor(F.col("us") / F.lit(DAY_US)).cast("long")


# -- observability

_LATENCY = """
WITH e AS (
  SELECT event_type AS path, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS z FROM events WHERE value >= {t}
), k AS (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY a) AS no FROM e WHERE a > 10 AND z > 10
), g AS (SELECT path, count(*)::bigint AS n, max(v) AS max_ms, min(v) AS min_ms, round(avg(v), 6) AS avg_ms FROM k GROUP BY path)
SELECT path, n, max_ms, (SELECT max(no) FROM k WHERE k.path = g.path AND k.v = g.max_ms)::bigint AS max_no, min_ms,
  (SELECT max(no) FROM k WHERE k.path = g.path AND k.v = g.min_ms)::bigint AS min_no, avg_ms FROM g
"""


@query(_LATENCY.format(t="0"))
def path_latency_metrics(spark, sf_dir):
    return tracking.latency_report(_events(spark, sf_dir), "event_type", "value", ["us", "event_id"]).withColumn("avg_ms", F.round("avg_ms", 6))


@query(_LATENCY.format(t="50"))
def path_latency_threshold(spark, sf_dir):
    return tracking.latency_report(_events(spark, sf_dir), "event_type", "value", ["us", "event_id"], threshold=50).withColumn("avg_ms", F.round("avg_ms", 6))


@query("SELECT event_type || '->' || user_id AS source, count(*)::bigint AS n FROM events GROUP BY event_type, user_id")
def source_message_counts(spark, sf_dir):
    return tracking.source_counts(_events(spark, sf_dir), "event_type", "user_id")


@query("""
SELECT event_type, count(*)::bigint AS n, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS most
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY event_type
""")
def job_stats_last100(spark, sf_dir):
    return tracking.job_statistics(_events(spark, sf_dir), ["event_type"], ["us", "event_id"], "value").withColumn("median", F.round("median", 6))


def _hops(first: Column, second: Column) -> Column:
    """Two hops: received when the message is sent, published a thousand microseconds later, twice."""
    hop = lambda op, a: F.struct(op.alias("op"), (F.col("us") + a).alias("rec_us"), (F.col("us") + a + 1000).alias("pub_us"))
    return F.array(hop(first, 0), hop(second, 1500))


@query(f"""WITH {EVENTS} SELECT event_id, event_type || ',sink' AS path, 2.5::double AS latency_ms,
'(' || event_type || ',' || us || ',' || (us + 1000) || ') -> (sink,' || (us + 1500) || ',' || (us + 2500) || ')' AS line FROM e""")
def flow_log_text(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("hops", _hops(F.col("event_type"), F.lit("sink")))
    return e.select("event_id", tracking.path_name(F.col("hops")).alias("path"), tracking.path_latency_ms(F.col("hops")).alias("latency_ms"), tracking.log_line(F.col("hops")).alias("line"))


@query(f"""WITH {EVENTS} SELECT event_id, event_type || ',' || event_type AS path, 1.5::double AS latency_ms FROM e""")
def cyclic_path_latency(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("hops", tracking.ends_only(tracking.closed_cycle(_hops(F.col("event_type"), F.col("event_type")))))
    return e.select("event_id", tracking.path_name(F.col("hops")).alias("path"), tracking.path_latency_ms(F.col("hops")).alias("latency_ms"))


@query("""SELECT event_id, event_type || '.' || user_id AS name FROM events
WHERE NOT regexp_matches(event_type || '.' || user_id, 'error') AND (regexp_matches(event_type || '.' || user_id, '^click') OR regexp_matches(event_type || '.' || user_id, '[02468]$'))""")
def logger_filter(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.concat_ws(".", "event_type", "user_id").alias("name"))
    return e.where(tracking.log_filter(F.col("name"), allow=["^click", "[02468]$"], deny=["error"]))


@query("""SELECT vec_id, array_to_string(list_transform(embedding[1:5], lambda x: floor(x::double * 100)::integer::varchar), ', ') || ', ...' AS line FROM embeddings""")
def serialized_tensors(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", tensors.printed(v, most=5).alias("line"))


@query("SELECT (range + 1)::bigint AS value FROM range(1000)")
def counting_source(spark, sf_dir):
    return generators.counter(spark, 1000)


@query("SELECT (range + 1)::bigint AS msg_id, [2, 3] AS shape, 'float' AS dtype, 6::integer AS elements, 15.0::double AS total FROM range(100)")
def tensor_source(spark, sf_dir):
    t = generators.tensors(spark, 100, [2, 3], "float", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    return generators.described(t).join(t.select("msg_id", F.aggregate("tensor.data", F.lit(0.0), lambda a, x: a + x).alias("total")), "msg_id")


# -- queues and latest values


@query("""
WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
j AS (SELECT c.event_id, c.user_id, c.ts, (SELECT max_by(p.event_id, (epoch_us(p.ts), p.event_id)) FROM p WHERE p.user_id = c.user_id AND p.ts <= c.ts) AS pid FROM c)
SELECT j.event_id, p.value AS latest, coalesce(j.pid = lag(j.pid) OVER (PARTITION BY j.user_id ORDER BY j.ts, j.event_id), false) AS is_old
FROM j LEFT JOIN p ON p.event_id = j.pid
""")
def async_buffer_latest(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = queues.latest_value(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], ["us", "event_id"], _day(), "value")
    return out.select("event_id", "latest", "is_old")


def _per_day(policy: str):
    def run(spark, sf_dir):
        out = queues.bounded(_events(spark, sf_dir), ["user_id", "day"], ["us", "event_id"], 2, policy)
        return out.select("event_id", "user_id", "day", *["overflow"] * (policy == "fault"))

    return run


_QUEUE = """SELECT event_id, user_id, day{more} FROM (
  SELECT event_id, user_id, (epoch_us(ts) // 86400000000)::bigint AS day, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts {way}, event_id {way}) AS r,
    greatest(0, count(*) OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000) - 2)::bigint AS overflow FROM events) WHERE r <= 2"""
for _name, _way, _more in (("pop", "DESC", ""), ("reject", "ASC", ""), ("fault", "ASC", ", overflow")):
    QUERIES[f"queue_{_name}"] = _per_day(_name)
    ORACLES[f"queue_{_name}"] = _QUEUE.format(way=_way, more=_more)


# -- readiness


@query("""WITH n AS (SELECT event_id, event_type, (row_number() OVER w - 1) // 7 AS batch, count(*) OVER (PARTITION BY event_type) // 7 AS full_n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, event_type, batch::bigint AS batch FROM n WHERE batch < full_n""")
def count_batches(spark, sf_dir):
    return conditions.count_batches(_events(spark, sf_dir), ["event_type"], ["us", "event_id"], _day(), 7).select("event_id", "event_type", "batch")


@query("""WITH n AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 16 AS batch, count(*) OVER () // 16 AS full_n FROM events WHERE event_type IN ('click', 'view'))
SELECT event_id, batch::bigint AS batch FROM n WHERE batch < full_n""")
def multi_sum(spark, sf_dir):
    return conditions.count_batches(_events(spark, sf_dir).where("event_type IN ('click', 'view')"), [], ["us", "event_id"], _day(), 16).select("event_id", "batch")


@query("""WITH n AS (SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // CASE event_type WHEN 'click' THEN 3 ELSE 2 END AS batch FROM events WHERE event_type IN ('click', 'view')),
f AS (SELECT min(c // CASE event_type WHEN 'click' THEN 3 ELSE 2 END) AS full_n FROM (SELECT event_type, count(*) AS c FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type))
SELECT event_id, event_type, batch::bigint AS batch FROM n, f WHERE batch < full_n""")
def multi_per_receiver(spark, sf_dir):
    return conditions.per_port_batches(_events(spark, sf_dir), "event_type", ["us", "event_id"], _day(), {"click": 3, "view": 2}).select("event_id", "event_type", "batch")


_NULLABLE = "n AS (SELECT *, nullif(event_type, 'error') AS k FROM events)"


@query(f"""WITH {_NULLABLE}, b AS (SELECT event_id, k, (row_number() OVER w - 1) // 7 AS batch, count(*) OVER (PARTITION BY k) // 7 AS full_n FROM n WINDOW w AS (PARTITION BY k ORDER BY ts, event_id))
SELECT event_id, k, batch::bigint AS batch FROM b WHERE batch < full_n""")
def count_batches_null_key(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.nullif("event_type", F.lit("error")))
    return conditions.count_batches(e, ["k"], ["us", "event_id"], _day(), 7).select("event_id", "k", "batch")


@query(f"""WITH {_NULLABLE}, q AS (SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS r, greatest(0, count(*) OVER (PARTITION BY k) - 50)::bigint AS overflow FROM n)
SELECT event_id, k, overflow FROM q WHERE r <= 50""")
def queue_fault_null_key(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.nullif("event_type", F.lit("error")))
    return queues.bounded(e, ["k"], ["us", "event_id"], 50, "fault").select("event_id", "k", "overflow")


@query(f"""WITH {_NULLABLE} SELECT event_id, k FROM (SELECT event_id, k, ts, max(ts) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM n) WHERE m IS NULL OR ts > m""")
def pose_ordered_updates_null_key(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.nullif("event_type", F.lit("error")))
    return poses.accepted(e, ["k"], "us", ["event_id"], F.floor(F.col("event_id") / 4096)).select("event_id", "k")


def _recursive(start: str, step: str, out: str = "SELECT event_id, user_id, batch FROM r") -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts)::bigint AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, us, i, {start} FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.us, e.i, {step} FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) {out}"""


@query(_recursive("0::bigint AS batch, us AS first_us, 1::bigint AS n", """CASE WHEN r.n >= 4 OR e.us - r.first_us > 172800000000 THEN r.batch + 1 ELSE r.batch END,
CASE WHEN r.n >= 4 OR e.us - r.first_us > 172800000000 THEN e.us ELSE r.first_us END, CASE WHEN r.n >= 4 OR e.us - r.first_us > 172800000000 THEN 1 ELSE r.n + 1 END"""))
def expiring_batches(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us")
    return conditions.expiring_batches(e, ["user_id"], "us", ["us", "event_id"], _day(), 4, 2 * DAY_US).select("event_id", "user_id", "batch")


#: State after a row: its batch, when the last batch ended, rows in the open batch.
@query(_recursive("0::bigint AS batch, us AS last_us, 1::bigint AS n", """
CASE WHEN r.n >= 4 OR (r.n > 0 AND e.us - r.last_us > 172800000000) THEN r.batch + 1 ELSE r.batch END,
CASE WHEN (CASE WHEN r.n >= 4 THEN 0 WHEN e.us - r.last_us > 172800000000 THEN 0 ELSE r.n END) + 1 >= 4 THEN e.us
  WHEN r.n < 4 AND e.us - r.last_us > 172800000000 THEN r.last_us + 172800000000 ELSE r.last_us END,
CASE WHEN r.n >= 4 THEN 1 WHEN e.us - r.last_us > 172800000000 THEN 1 ELSE r.n + 1 END"""))
def timeout_batches(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us")
    return conditions.timeout_batches(e, ["user_id"], "us", ["us", "event_id"], 4, 2 * DAY_US).select("event_id", "user_id", "batch")


_TICKED = "SELECT event_id, user_id FROM r WHERE ran"
_P = str(12 * 3600 * 10**6)


@query(_recursive("true AS ran, us + " + _P + " AS due", f"e.us >= r.due, CASE WHEN e.us >= r.due THEN r.due + {_P} ELSE r.due END", _TICKED))
def periodic_catchup(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us")
    return conditions.catch_up_ticks(e, ["user_id"], "us", ["us", "event_id"], DAY_US // 2, _day()).select("event_id", "user_id")


@query(_recursive("true AS ran, us + " + _P + " AS due", f"e.us >= r.due, CASE WHEN e.us >= r.due THEN e.us + {_P} ELSE r.due END", _TICKED))
def periodic_mintime(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us")
    return conditions.min_gap_ticks(e, ["user_id"], "us", ["us", "event_id"], _day(), DAY_US // 2).select("event_id", "user_id")


@query(f"""WITH {EVENTS}, b AS (SELECT user_id, min(us) AS b FROM e GROUP BY user_id)
SELECT event_id, user_id FROM (SELECT e.event_id, e.user_id, row_number() OVER (PARTITION BY e.user_id, (e.us - b.b) // {_P} ORDER BY e.us, e.event_id) AS k FROM e JOIN b USING (user_id)) WHERE k = 1""")
def periodic_nocatchup(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us")
    return conditions.grid_ticks(e, ["user_id"], "us", ["us", "event_id"], DAY_US // 2).select("event_id", "user_id")


@query("SELECT event_id, event_type, value FROM events ORDER BY ts, event_id LIMIT 250")
def count_limit(spark, sf_dir):
    return conditions.first_rows(_events(spark, sf_dir), ["us", "event_id"], 250).select("event_id", "event_type", "value")


#: A condition for each event; the state stands for its type, but small errors only wait.
_STATE = {"error": "NEVER", "click": "READY", "view": "WAIT_TIME", "signup": "WAIT_EVENT", "purchase": "WAIT"}
_STATES = f"""s AS (SELECT user_id, (epoch_us(ts) // 86400000000)::bigint AS day, epoch_us(ts)::bigint AS us,
CASE WHEN event_type = 'error' AND value < 100 THEN 'WAIT' ELSE CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATE.items())} END END AS state FROM events),
g AS (SELECT user_id, day, bool_or(state = 'NEVER') AS nv, bool_or(state = 'READY') AS rd, bool_or(state = 'WAIT_EVENT') AS we, bool_or(state = 'WAIT_TIME') AS wt, bool_or(state = 'WAIT') AS w,
max(CASE WHEN state = 'READY' THEN us END) AS ra, max(CASE WHEN state = 'WAIT_TIME' THEN us END) AS wa FROM s GROUP BY user_id, day)"""


def _conditions(spark, sf_dir) -> DataFrame:
    states = F.create_map(*[F.lit(x) for kv in _STATE.items() for x in kv])
    state = F.when((F.col("event_type") == "error") & (F.col("value") < 100), "WAIT").otherwise(states[F.col("event_type")])
    return _events(spark, sf_dir).select("user_id", "day", state.alias("state"), F.col("us").alias("at"))


@query(f"""WITH {_STATES}, o AS (SELECT *, CASE WHEN nv THEN 'NEVER' WHEN we THEN 'WAIT_EVENT' WHEN w THEN 'WAIT' WHEN wt THEN 'WAIT_TIME' ELSE 'READY' END AS state FROM g)
SELECT user_id, day, state, (CASE state WHEN 'WAIT_TIME' THEN wa WHEN 'READY' THEN ra ELSE 0 END)::bigint AS at FROM o""")
def condition_and(spark, sf_dir):
    return conditions.all_of(_conditions(spark, sf_dir), ["user_id", "day"], "state", "at")


@query(f"""WITH {_STATES}, o AS (SELECT *, CASE WHEN nv THEN 'NEVER' WHEN rd THEN 'READY' WHEN we THEN 'WAIT_EVENT' WHEN wt THEN 'WAIT_TIME' ELSE 'WAIT' END AS state FROM g)
SELECT user_id, day, state, (CASE state WHEN 'WAIT_TIME' THEN wa WHEN 'READY' THEN ra ELSE 0 END)::bigint AS at FROM o""")
def condition_or(spark, sf_dir):
    return conditions.any_of(_conditions(spark, sf_dir), ["user_id", "day"], "state", "at")


# -- routing

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINES = f"(row_number() OVER (ORDER BY {', '.join(_LINE)}) - 1)"


def _dealt(spark, sf_dir) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(*_LINE, "l_quantity")
    return routing.round_robin(lines, _LINE, F.floor(F.col("l_orderkey") / 4096), 4)


@query(f"SELECT l_orderkey, l_linenumber, ({_LINES} // 4)::bigint AS round, ({_LINES} % 4)::integer AS port FROM lineitem")
def round_robin(spark, sf_dir):
    return _dealt(spark, sf_dir).select("l_orderkey", "l_linenumber", "round", "port")


@query(f"SELECT {_LINES} + 1 AS n, l_orderkey, l_linenumber, l_quantity * (1 + {_LINES} % 4) AS work FROM lineitem")
def gather(spark, sf_dir):
    dealt = _dealt(spark, sf_dir)
    parts = [dealt.where(F.col("port") == p).withColumn("work", F.col("l_quantity") * (p + 1)) for p in range(4)]
    return routing.gathered(parts, 4).select("n", "l_orderkey", "l_linenumber", "work")


@query("""SELECT 'by_type' AS branch, event_type AS name, count(*)::bigint AS n FROM events GROUP BY event_type UNION ALL
SELECT 'by_size', CASE WHEN value >= 50 THEN 'large' ELSE 'small' END, count(*)::bigint FROM events GROUP BY 2""")
def broadcast_fanout(spark, sf_dir):
    e = _events(spark, sf_dir)
    branches = F.array(F.struct(F.lit("by_type").alias("branch"), F.col("event_type").alias("name")), F.struct(F.lit("by_size").alias("branch"), F.when(F.col("value") >= 50, "large").otherwise("small").alias("name")))
    return e.select(F.explode(branches).alias("b")).groupBy("b.branch", "b.name").agg(F.count(F.lit(1)).alias("n"))  # one scan feeds both


@query("""WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
SELECT c.n, c.event_id AS click, v.event_id AS view_, p.event_id AS purchase FROM n c JOIN n v ON v.n = c.n AND v.event_type = 'view' JOIN n p ON p.n = c.n AND p.event_type = 'purchase' WHERE c.event_type = 'click'""")
def multi_receiver_zip(spark, sf_dir):
    z = routing.zipped(_events(spark, sf_dir), "event_type", ["click", "view", "purchase"], ["us", "event_id"], _day(), "event_id")
    return z.select("n", *[F.col("values")[i].alias(c) for i, c in enumerate(("click", "view_", "purchase"))])


@query("""WITH b(branch, width) AS (VALUES ('fast', 21600000000), ('slow', 86400000000)), w AS (SELECT branch, user_id, event_id, value, (epoch_us(ts) // width)::bigint AS tick, row_number() OVER (PARTITION BY branch, user_id, epoch_us(ts) // width ORDER BY ts DESC, event_id DESC) AS r FROM events, b)
SELECT branch, user_id, tick, event_id, value FROM w WHERE r = 1""")
def multi_rate_branches(spark, sf_dir):
    """Every branch takes the newest message once in its period; what came before it in its queue of one is dropped."""
    e = _events(spark, sf_dir)
    rates = F.array(*[F.struct(F.lit(n).alias("branch"), F.floor(F.col("us") / F.lit(w)).cast("long").alias("tick")) for n, w in (("fast", DAY_US // 4), ("slow", DAY_US))])
    branches = e.select("user_id", "us", "event_id", "value", F.explode(rates).alias("b")).select("b.*", "user_id", "us", "event_id", "value")
    return queues.bounded(branches, ["branch", "user_id", "tick"], ["us", "event_id"], 1, "pop").drop("us")


@query("""SELECT o_orderkey, 'open' AS edge FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice >= 200000 UNION ALL
SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority LIKE '1%'""")
def dynamic_route(spark, sf_dir):
    edges = {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") >= 200000, "urgent": F.col("o_orderpriority").startswith("1")}
    return routing.routed(_table(spark, sf_dir, "orders"), edges).select("o_orderkey", "edge")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS frame FROM events")
def frame_numbers(spark, sf_dir):
    return routing.frame_numbers(_events(spark, sf_dir), "event_type", ["us", "event_id"], _day()).select("event_id", "event_type", "frame")


@query("""WITH d AS (SELECT r_name AS s, n_name AS t FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'WORLD', r_name FROM region),
n AS (SELECT s AS node, 0 AS i, 1 AS o FROM d UNION ALL SELECT t, 1, 0 FROM d)
SELECT node, sum(i)::bigint AS n_in, sum(o)::bigint AS n_out, sum(i) = 0 AS is_root, sum(o) = 0 AS is_leaf FROM n GROUP BY node""")
def graph_roots_leaves(spark, sf_dir):
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    edges = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    return routing.degrees(edges.unionAll(region.select(F.lit("WORLD"), "r_name")))


# -- metadata


def _merged(policy: str):
    def run(spark, sf_dir):
        e = _events(spark, sf_dir).withColumn("meta", F.from_json("props", "map<string,string>"))
        more = F.create_map(F.lit("type"), F.col("event_type"), F.lit("other" if policy == "raise" else "k"), F.col("user_id").cast("string"))
        out = metadata.merge(F.col("meta"), more, policy)
        return e.select("event_id", *[metadata.get(out, k).alias(f"{k}_") for k in ("k", "type", "other")], F.size(out).alias("n"))

    return run


_K = "json_extract_string(props, '$.k')"
for _policy, _k in (("update", "user_id::varchar"), ("reject", f"coalesce({_K}, user_id::varchar)"), ("raise", _K)):
    QUERIES[f"metadata_{_policy}"] = _merged(_policy)
    ORACLES[f"metadata_{_policy}"] = f"""SELECT event_id, {_k} AS k_, event_type AS type_, {"user_id::varchar" if _policy == "raise" else "NULL::varchar"} AS other_,
(len(list_distinct(list_concat(json_keys(props), ['type', '{"other" if _policy == "raise" else "k"}']))))::integer AS n FROM events"""


@query(f"""SELECT event_id, {_K} IS NOT NULL AS has_k, coalesce({_K}, 'none') AS k_, 0::integer AS cleared, (CASE WHEN {_K} IS NULL THEN 0 ELSE 1 END + 1)::integer AS with_type,
(CASE WHEN {_K} IS NULL THEN 1 ELSE 0 END)::integer AS without_k, coalesce({_K}, event_type) AS kept, event_type AS put, {_K} AS other FROM events""")
def metadata_map(spark, sf_dir):
    """Each operation on one map: has, get, clear, insert, erase, put, swap."""
    m = F.col("meta")
    e = _events(spark, sf_dir).withColumn("meta", F.from_json("props", "map<string,string>")).withColumn("other", F.create_map(F.lit("k"), F.col("event_type")))
    first, second = metadata.swapped(m, F.col("other"))
    return e.select(
        "event_id", metadata.has_key(m, "k").alias("has_k"), metadata.get(m, "k", F.lit("none")).alias("k_"), F.size(metadata.cleared(m)).alias("cleared"), F.size(metadata.put(m, "type", F.lit(1))).alias("with_type"),
        F.size(metadata.put(metadata.erase(m, "k"), "k", F.lit(1))).cast("int").alias("put_back"), metadata.get(metadata.inserted(m, F.col("other")), "k").alias("kept"), metadata.get(first, "k").alias("put"), metadata.get(second, "k").alias("other"),
    ).withColumn("without_k", F.when(F.col("has_k"), 0).otherwise(1)).drop("put_back")


# -- kernels

_D = "list_transform(embedding, lambda x: x::double)"


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _exploded(df: DataFrame, values: Column, index: str, name: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(values).alias(index, name))


@query(f"""WITH p AS (SELECT vec_id, unnest(range(16)) AS pixel, {_D} AS v FROM embeddings), q AS (SELECT vec_id, pixel, v[pixel * 4 + 1 : pixel * 4 + 4] AS c FROM p)
SELECT vec_id, pixel::integer AS pixel, (CASE WHEN list_max(c) > 0 THEN list_position(c, list_max(c)) - 1 ELSE 0 END)::integer AS class FROM q""")
def seg_argmax(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), tensors.argmax_classes(F.col("v"), 16, 4), "pixel", "class")


@query(f"""WITH p AS (SELECT vec_id, unnest(range(64)) AS pixel, {_D} AS v FROM embeddings) SELECT vec_id, pixel::integer AS pixel, (v[pixel + 1] >= 0.1)::integer AS class FROM p""")
def seg_sigmoid(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), tensors.sigmoid_classes(F.col("v"), 64, 1, 0.1), "pixel", "class")


def _max_positions(skip: bool):
    def run(spark, sf_dir):
        at = tensors.max_positions(F.col("v"), 4, 4, 4, skip)
        return _vectors(spark, sf_dir).select("vec_id", F.explode(at).alias("m")).select("vec_id", F.col("m.channel").cast("int").alias("channel"), F.col("m.row").cast("double").alias("row_"), F.col("m.col").cast("double").alias("col_"))

    return run


for _name, _skip in (("max_per_channel", False), ("max_per_channel_cpu", True)):
    QUERIES[_name] = _max_positions(_skip)
    ORACLES[_name] = f"""WITH c AS (SELECT vec_id, unnest(range(4)) AS channel, {_D} AS v FROM embeddings),
    o AS (SELECT vec_id, channel, list_transform(range(16), lambda p: v[p * 4 + channel + 1]) AS w FROM c), a AS (SELECT vec_id, channel, CASE WHEN channel < {int(_skip)} THEN 0 ELSE list_position(w, list_max(w)) - 1 END AS pos FROM o)
    SELECT vec_id, channel::integer AS channel, ((pos // 4) / 4.0)::double AS row_, ((pos % 4) / 4.0)::double AS col_ FROM a"""


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT floor(255 * (value - lo) / (hi - lo))::integer AS bin, count(*)::bigint AS n FROM events, s GROUP BY 1),
c AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS cdf FROM b), m AS (SELECT min(cdf) AS low, max(cdf) AS total FROM c)
SELECT bin, n, floor(255 * (cdf - low) / (total - low))::integer AS level FROM c, m""")
def hist_equalize(spark, sf_dir):
    return images.equalized_bins(_events(spark, sf_dir), [], "value")


@query(f"""WITH x AS (SELECT vec_id, unnest({_D}) AS value FROM embeddings), s AS (SELECT vec_id, min(value) AS lo, max(value) AS hi FROM x GROUP BY vec_id),
b AS (SELECT x.vec_id, (CASE WHEN hi > lo THEN floor(255 * (value - lo) / (hi - lo)) ELSE 0 END)::integer AS bin, count(*)::bigint AS n FROM x JOIN s USING (vec_id) GROUP BY 1, 2),
c AS (SELECT vec_id, bin, n, sum(n) OVER (PARTITION BY vec_id ORDER BY bin) AS cdf FROM b), m AS (SELECT vec_id, min(cdf) AS low, max(cdf) AS total FROM c GROUP BY vec_id)
SELECT vec_id, bin, n, (CASE WHEN total > low THEN floor(255 * (cdf - low) / (total - low)) ELSE 0 END)::integer AS level FROM c JOIN m USING (vec_id)""")
def hist_equalize_tensors(spark, sf_dir):
    return images.equalized_bins(_vectors(spark, sf_dir).select("vec_id", F.explode("v").alias("value")), ["vec_id"], "value")


@query("""SELECT vec_id, CASE WHEN embedding[1]::double > embedding[2]::double THEN 'yes' ELSE 'no' END AS label,
round(greatest(1 / (1 + exp(-embedding[1]::double)), 1 / (1 + exp(-embedding[2]::double))), 6) AS confidence FROM embeddings""")
def binary_classification(spark, sf_dir):
    c = tensors.binary_class(F.slice("v", 1, 2), "yes", "no")
    return _vectors(spark, sf_dir).select("vec_id", c["label"].alias("label"), F.round(c["confidence"], 6).alias("confidence"))


@query("""WITH s AS (SELECT vec_id, embedding[1]::double AS a, embedding[2]::double AS b FROM embeddings)
SELECT vec_id, (a > b)::integer::varchar AS yes, (NOT a > b)::integer::varchar AS no, round(greatest(1 / (1 + exp(-a)), 1 / (1 + exp(-b))), 6) AS confidence FROM s""")
def binary_class_csv(spark, sf_dir):
    """The rows that are written as CSV."""
    c = tensors.binary_class_row(F.slice("v", 1, 2), ["yes", "no", "confidence"])
    return _vectors(spark, sf_dir).select("vec_id", c.alias("c")).select("vec_id", "c.yes", "c.no", F.round(F.col("c.confidence").cast("double"), 6).alias("confidence"))


@query("""SELECT vec_id, CASE WHEN label % 4 = 1 THEN 'color_lut' WHEN label % 4 = 2 THEN 'crosses' WHEN label % 2 = 1 THEN 'color' END AS kind FROM embeddings""")
def primitive_kinds(spark, sf_dir):
    n = F.col("label") % 4
    return _table(spark, sf_dir, "embeddings").select("vec_id", tensors.primitive_kind(n, n == 1, F.lit(True), n == 3).alias("kind"))


_NAMES, _OBJECTS = ["cat", "dog", "bird"], {"cat": 2, "dog": 1, "object": 3}


def _found() -> Column:
    boxes = F.transform(F.slice("v", 1, 32), lambda x: x * 1000)
    scores = F.transform(F.slice("v", 33, 8), lambda x: x + 0.5)
    return images.detections(boxes, scores, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i % 4))


@query(f"""WITH d AS (SELECT vec_id, unnest(range(8)) AS i, {_D} AS v FROM embeddings), l AS (SELECT *, CASE i % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' ELSE 'object' END AS label FROM d WHERE v[33 + i] + 0.5 > 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY i) - 1 AS slot FROM l),
g AS (SELECT vec_id, o.label, unnest(range(k)) AS slot FROM embeddings, (VALUES ('cat', 2), ('dog', 1), ('object', 3)) o(label, k))
SELECT g.vec_id, g.label, g.slot::integer AS slot, round(coalesce(v[i * 4 + 1] * 1000 / 1920, 0), 9) AS x1, round(coalesce(v[i * 4 + 2] * 1000 / 1080, 0), 9) AS y1,
  round(coalesce(v[i * 4 + 3] * 1000 / 1920, 0), 9) AS x2, round(coalesce(v[i * 4 + 4] * 1000 / 1080, 0), 9) AS y2,
  round(coalesce(v[i * 4 + 3] * 1000 / 1920, 1.1), 9) AS text_x, round(coalesce(v[i * 4 + 2] * 1000 / 1080, 1.1), 9) AS text_y, r.i IS NOT NULL AS used
FROM g LEFT JOIN r ON r.vec_id = g.vec_id AND r.label = g.label AND r.slot = g.slot""")
def first_k_boxes(spark, sf_dir):
    out = images.first_boxes(_vectors(spark, sf_dir), "vec_id", _found(), _NAMES, _OBJECTS, 0.5)
    return out.select("vec_id", "label", F.col("slot").cast("int").alias("slot"), *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2", "text_x", "text_y")], "used")


@query(f"""WITH d AS (SELECT vec_id, unnest(range(64)) AS i, {_D} AS v FROM embeddings)
SELECT vec_id, (i % 16)::integer AS pixel, max(i // 16)::integer AS color FROM d WHERE v[i + 1] > 0.05 GROUP BY 1, 2""")
def mask_paint(spark, sf_dir):
    m = _exploded(_vectors(spark, sf_dir), F.col("v"), "i", "mask")
    m = m.select("vec_id", (F.col("i") % 16).alias("pixel"), F.floor(F.col("i") / 16).cast("int").alias("idx"), "mask").withColumn("color", F.col("idx"))
    return images.painted(m, ["vec_id"], "pixel", "idx", "mask", "color", 0.05)


def _u8() -> Column:
    return tensors.rescale_down(F.col("v"), -0.5, 0.5)


_U8 = f"list_transform({_D}, lambda x: least(255, greatest(0, floor((x + 0.5) * 255.0::double + 0.5)))::integer)"


@query(f"WITH u AS (SELECT vec_id, unnest(range(64)) AS i, {_U8} AS u FROM embeddings) SELECT vec_id, i::integer AS i, u[i + 1] AS u8, round(-1 + u[i + 1] * (2 / 255.0::double), 9) AS f32 FROM u")
def rescale_u8_f32(spark, sf_dir):
    z = F.arrays_zip(_u8().alias("u8"), tensors.rescale_up(_u8(), -1.0, 1.0).alias("f32"))
    return _exploded(_vectors(spark, sf_dir), z, "i", "z").select("vec_id", "i", F.col("z")["u8"].alias("u8"), F.round(F.col("z")["f32"], 9).alias("f32"))


@query(f"WITH u AS (SELECT vec_id, unnest(range(64)) AS i, {_U8} AS u FROM embeddings) SELECT vec_id, i::integer AS i, u[(i // 4) * 4 + [3, 2, 1, 4][i % 4 + 1]] AS x FROM u")
def swap_channels(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), tensors.reorder_channels(_u8(), 4, [2, 1, 0, 3]), "i", "x")


@query(f"WITH u AS (SELECT vec_id, unnest(range(84)) AS i, {_U8} AS u FROM embeddings) SELECT vec_id, i::integer AS i, CASE WHEN i % 4 = 3 THEN 255 ELSE u[(i // 4) * 3 + i % 4 + 1] END::integer AS x FROM u")
def add_alpha(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), tensors.add_alpha(F.slice(_u8(), 1, 63)), "i", "x")


@query(f"WITH u AS (SELECT vec_id, unnest(range(48)) AS i, {_U8} AS u FROM embeddings) SELECT vec_id, i::integer AS i, u[(i // 3) * 4 + i % 3 + 1] AS x FROM u")
def drop_alpha(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), tensors.drop_alpha(_u8()), "i", "x")


@query(f"WITH u AS (SELECT vec_id, unnest(range(64)) AS i, {_U8} AS u FROM embeddings) SELECT vec_id, i::integer AS i, u[i + 1] AS x FROM u")
def narrow_u16(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), tensors.narrow(F.transform(_u8(), lambda x: x * 256 + 17)), "i", "x")


@query(f"""WITH u AS (SELECT vec_id, unnest(range(64)) AS i, {_U8} AS u FROM embeddings), t AS (SELECT vec_id, i, u[i + 1] AS y, u[(i + 1) % 64 + 1] AS cu, u[(i + 2) % 64 + 1] AS cv FROM u)
SELECT vec_id, i::integer AS i, least(255, greatest(0, floor(y + 1.402::double * (cv - 128) + 0.5)))::integer AS r,
  least(255, greatest(0, floor(y - 0.344136::double * (cu - 128) - 0.714136::double * (cv - 128) + 0.5)))::integer AS g,
  least(255, greatest(0, floor(y + 1.772::double * (cu - 128) + 0.5)))::integer AS b FROM t""")
def yuv_to_rgb(spark, sf_dir):
    """A pixel a value: its luma is the value, its chroma the next two."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: tensors.yuv_to_rgb(*[F.get("u", ((i + k) % 64).cast("int")) for k in range(3)]))
    return _exploded(_vectors(spark, sf_dir).select("vec_id", _u8().alias("u")), pixels, "i", "c").select("vec_id", "i", "c.*")


@query(f"WITH u AS (SELECT vec_id, unnest(range(16)) AS i, {_U8} AS u FROM embeddings) SELECT vec_id, i::integer AS i, u[((i // 4) * 2) * 8 + (i % 4) * 2 + 1] AS x FROM u")
def resize(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), images.resize_nearest(_u8(), 8, 8, 1, 4, 4), "i", "x")


_TAPS = "unnest(range(floor(({0} + 0.5) * 0.5 - 0.5)::integer - 1, floor(({0} + 0.5) * 0.5 - 0.5)::integer + 3))"
_WEIGHT = "CASE WHEN abs({0}) <= 1 THEN 1.5 * abs({0}) ** 3 - 2.5 * {0} ** 2 + 1 ELSE -0.5 * abs({0}) ** 3 + 2.5 * {0} ** 2 - 4 * abs({0}) + 2 END"


@query(f"""WITH n AS (SELECT o, {_TAPS.format("o")} AS k FROM range(16) r(o)), w AS (SELECT o, least(7, greatest(0, k)) AS k, (o + 0.5::double) * 0.5 - 0.5 - k AS d FROM n),
c AS (SELECT o, k, {_WEIGHT.format("d")} AS w FROM w), t AS (SELECT y.o * 16 + x.o AS i, y.k * 8 + x.k + 1 AS j, y.w * x.w AS w FROM c y, c x), u AS (SELECT vec_id, {_U8} AS u FROM embeddings)
SELECT vec_id, i::integer AS i, least(255, greatest(0, floor(sum(w * u[j]) + 0.5)))::integer AS x FROM u, t GROUP BY vec_id, i""")
def resize_cubic(spark, sf_dir):
    """To twice the size, where all weights are exact in binary."""
    u = _vectors(spark, sf_dir).select("vec_id", _u8().alias("u"))
    return _exploded(u, images.resize_cubic(F.col("u"), 8, 8, 1, 16, 16), "i", "x")


def _luma_sql(luma: str, full: bool) -> dict[str, str]:
    (kr, kb), (black, y_range, c_range) = images.LUMA[luma], images._ranges(full)
    number = lambda x: f"{x!r}::double"
    return {
        "y": f"((y - {number(black)}) * {number(255 / y_range)})", "u": f"((cu - 128) * {number(255 / c_range)})", "v": f"((cv - 128) * {number(255 / c_range)})",
        "r": number(2 * (1 - kr)), "b": number(2 * (1 - kb)), "gu": number(2 * kb * (1 - kb) / (1 - kr - kb)), "gv": number(2 * kr * (1 - kr) / (1 - kr - kb)),
    }


def _planes_sql(height: int, width: int, more: str, y: str, cu: str, cv: str, luma: str, full: bool) -> str:
    c = _luma_sql(luma, full)
    return f"""WITH u AS (SELECT vec_id, {_U8} AS u FROM embeddings), d AS (SELECT vec_id, {more} AS d, unnest(range({height * width})) AS p FROM u), t AS (SELECT *, p // {width} AS py, p % {width} AS px FROM d),
    s AS (SELECT vec_id, p, d[{y} + 1] AS y, d[{cu} + 1] AS cu, d[{cv} + 1] AS cv FROM t), f AS (SELECT vec_id, p, {c["y"]} AS y, {c["u"]} AS cu, {c["v"]} AS cv FROM s)
    SELECT vec_id, p::integer AS pixel, least(255, greatest(0, floor(y + {c["r"]} * cv + 0.5)))::integer AS r, least(255, greatest(0, floor(y - {c["gu"]} * cu - {c["gv"]} * cv + 0.5)))::integer AS g,
      least(255, greatest(0, floor(y + {c["b"]} * cu + 0.5)))::integer AS b FROM f"""


def _from_planes(layout: str, height: int, width: int, luma: str, full: bool):
    def run(spark, sf_dir):
        u = _vectors(spark, sf_dir).select("vec_id", _u8().alias("u"))
        data = F.col("u") if layout == "yuyv" else F.concat("u", F.slice("u", 1, 32))
        rgb = u.select("vec_id", images.planes_to_rgb(data, height, width, layout, luma, full).alias("x"))
        pixels = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda p: F.struct(*[F.get("x", p * 3 + k).alias(n) for k, n in enumerate("rgb")]))
        return _exploded(rgb, pixels, "pixel", "c").select("vec_id", "pixel", "c.*")

    return run


_QUARTER = "(64 + (py // 2) * 4 + px // 2)"
for _name, _layout, _h, _w, _more, _at, _luma, _full in (
    ("yuv420_to_rgb", "yuv420", 8, 8, "list_concat(u, u[1:32])", ("p", _QUARTER, f"({_QUARTER} + 16)"), "601", True),
    ("nv12_to_rgb", "nv12", 8, 8, "list_concat(u, u[1:32])", ("p", "(64 + ((py // 2) * 4 + px // 2) * 2)", "(65 + ((py // 2) * 4 + px // 2) * 2)"), "709", False),
    ("yuyv_to_rgb", "yuyv", 4, 8, "u", ("(p * 2)", "((p // 2) * 4 + 1)", "((p // 2) * 4 + 3)"), "601", False),
):
    QUERIES[_name] = _from_planes(_layout, _h, _w, _luma, _full)
    ORACLES[_name] = _planes_sql(_h, _w, _more, *_at, _luma, _full)


def _to_planes(layout: str, luma: str, full: bool):
    def run(spark, sf_dir):
        u = _vectors(spark, sf_dir).select("vec_id", F.concat(*[_u8()] * 3).alias("u"))
        return _exploded(u, images.rgb_to_planes(F.col("u"), 8, 8, layout, luma, full), "i", "x")

    return run


def _to_planes_sql(luma: str, full: bool, place: str) -> str:
    (kr, kb), (black, y_range, c_range) = images.LUMA[luma], images._ranges(full)
    number = lambda x: f"{x!r}::double"
    return f"""WITH u AS (SELECT vec_id, {_U8} AS u, unnest(range(64)) AS p FROM embeddings), c AS (SELECT vec_id, p, u[(p * 3) % 64 + 1] AS r, u[(p * 3 + 1) % 64 + 1] AS g, u[(p * 3 + 2) % 64 + 1] AS b FROM u),
    y AS (SELECT vec_id, p, r, b, {number(kr)} * r + {number(1 - kr - kb)} * g + {number(kb)} * b AS y FROM c),
    q AS (SELECT vec_id, (p // 16) * 4 + (p % 8) // 2 AS q, avg((b - y) / {number(2 * (1 - kb))}) * {number(c_range / 255)} + 128 AS cu, avg((r - y) / {number(2 * (1 - kr))}) * {number(c_range / 255)} + 128 AS cv FROM y GROUP BY 1, 2),
    a AS (SELECT vec_id, p AS i, y * {number(y_range / 255)} + {number(black)} AS x FROM y UNION ALL SELECT vec_id, {place.format(0)}, cu FROM q UNION ALL SELECT vec_id, {place.format(1)}, cv FROM q)
    SELECT vec_id, i::integer AS i, least(255, greatest(0, floor(x + 0.5)))::integer AS x FROM a"""


for _name, _layout, _luma, _full, _place in (("rgb_to_yuv420", "yuv420", "601", True, "64 + {0} * 16 + q"), ("rgb_to_nv12", "nv12", "709", False, "64 + q * 2 + {0}")):
    QUERIES[_name] = _to_planes(_layout, _luma, _full)
    ORACLES[_name] = _to_planes_sql(_luma, _full, _place)


@query()
def bayer_demosaic(spark, sf_dir):
    u = _vectors(spark, sf_dir).select("vec_id", _u8().alias("u"))
    return _exploded(u, images.demosaic(F.col("u"), 8, 8), "i", "x")


#: A mosaic in plain SQL: green where row and column are both even or both odd, then blue, red.
ORACLES["bayer_demosaic"] = f"""WITH u AS (SELECT vec_id, {_U8} AS u FROM embeddings), p AS (SELECT vec_id, u, unnest(range(192)) AS i FROM u),
q AS (SELECT vec_id, i, u, (i // 3) // 8 AS y, (i // 3) % 8 AS x, i % 3 AS c FROM p),
n AS (SELECT q.vec_id, q.i, q.c, q.y, q.x, q.u, dy.v AS dy, dx.v AS dx FROM q, (VALUES (-1), (0), (1)) dy(v), (VALUES (-1), (0), (1)) dx(v)
  WHERE q.y + dy.v BETWEEN 0 AND 7 AND q.x + dx.v BETWEEN 0 AND 7),
s AS (SELECT vec_id, i, c, y, x, dy, dx, u[(y + dy) * 8 + x + dx + 1] AS w, CASE WHEN (y + dy) % 2 = (x + dx) % 2 THEN 1 WHEN (y + dy) % 2 = 0 THEN 2 ELSE 0 END AS color FROM n)
SELECT vec_id, i::integer AS i, coalesce(max(CASE WHEN dy = 0 AND dx = 0 AND color = c THEN w END), sum(CASE WHEN color = c THEN w END) // count(CASE WHEN color = c THEN 1 END))::integer AS x FROM s GROUP BY vec_id, i"""


def _shapes(kind: str):
    size, step = tensors.PRIMITIVES[kind]

    def run(spark, sf_dir):
        out = _exploded(_vectors(spark, sf_dir), tensors.primitives(F.col("v"), kind), "i", "p")
        return out.select("vec_id", "i", *[F.col("p")[k].alias(f"c{k}") for k in range(size)])

    return run


for _kind in tensors.PRIMITIVES:
    _size, _step = tensors.PRIMITIVES[_kind]
    QUERIES[f"primitives_{_kind}"] = _shapes(_kind)
    ORACLES[f"primitives_{_kind}"] = f"""WITH p AS (SELECT vec_id, unnest(range({(64 - _size) // _step + 1})) AS i, {_D} AS v FROM embeddings)
    SELECT vec_id, i::integer AS i, {', '.join(f'v[i * {_step} + {k + 1}] AS c{k}' for k in range(_size))} FROM p"""


@query(f"WITH p AS (SELECT vec_id, unnest(range(64)) AS i, {_D} AS v FROM embeddings) SELECT vec_id, (i % 8)::integer AS x, (i // 8)::integer AS y, v[i + 1] AS z FROM p")
def depth_map(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.explode(tensors.depth_points(F.col("v"), 8)).alias("p")).select("vec_id", F.col("p.x").cast("int").alias("x"), "p.y", "p.z")


@query("SELECT vec_id, ([1.0, 0.0, 0.5]::double[])[label + 1] AS r, ([0.0, 1.0, 0.5]::double[])[label + 1] AS g FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE label >= 3")
def lut_lookup(spark, sf_dir):
    c = tensors.looked_up(F.col("label"), [[1, 0, 0, 1], [0, 1, 0, 1], [0.5, 0.5, 0, 1]])
    return _vectors(spark, sf_dir).select("vec_id", c[0].alias("r"), c[1].alias("g"))


# -- inference


@query("""WITH n AS (SELECT event_id, event_type, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, event_type, last_value(CASE WHEN n % 3 = 0 THEN value * 2 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS output FROM n""")
def temporal_inference(spark, sf_dir):
    return inference.decimated(_events(spark, sf_dir), ["event_type"], ["us", "event_id"], _day(), F.col("value") * 2, 3, "output").select("event_id", "event_type", "output")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN value + 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS output FROM events""")
def activation_inference(spark, sf_dir):
    flag = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return inference.activated(_events(spark, sf_dir), ["user_id"], ["us", "event_id"], _day(), F.col("value") + 1, flag, "output").select("event_id", "user_id", "output")


# -- record and replay


@query("""SELECT doc_id, n_chars::bigint AS data_size, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS data_offset FROM documents""")
def recorder_index(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return recording.index_of(d, ["doc_id"], F.floor(F.col("doc_id") / 1024), F.col("n_chars"), F.col("doc_id")).select("doc_id", "data_size", "data_offset")


@query(f"""WITH {EVENTS}, s AS (SELECT min(us) AS a, max(us) AS z, count(*) AS c FROM e)
SELECT event_id, l.l::integer AS loop, (us - a + l.l * (z - a + CASE WHEN c > 1 THEN (z - a) // (c - 1) ELSE 0 END))::bigint AS due_us FROM e, s, (VALUES (0), (1)) l(l) WHERE event_id % 100 <> 7""")
def replay_schedule(spark, sf_dir):
    e = _events(spark, sf_dir)
    return recording.schedule(e, "event_id", F.col("us"), repeat=2, corrupt=F.col("event_id") % 100 == 7).select("event_id", "loop", "due_us")


@query("SELECT event_id, floor(event_id * (1000000 / 60.0::double))::bigint AS due_us FROM events WHERE event_id < 500")
def replay_at_rate(spark, sf_dir):
    return recording.schedule(_events(spark, sf_dir), "event_id", F.col("us"), frame_rate=60, count=500).select("event_id", "due_us")


def _days(us: Column) -> Column:
    return F.floor(us / F.lit(DAY_US)).cast("long")


# -- poses: purchases are the samples of each user's edge, views ask


def _reads(mode: str, versions: bool = False):
    def run(spark, sf_dir):
        e = _events(spark, sf_dir)
        history = e.where("event_type = 'purchase'").select("user_id", "us", "value", F.col("us").alias("version"), (F.col("event_id") % 11 != 0).alias("valid"))
        see = F.col("us") - 5 * DAY_US if versions else F.lit((1 << 62))
        asked = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), "us", see.cast("long").alias("version"))
        return poses.reads(asked, history, ["user_id"], "us", "value", _days, _days, mode).select("user_id", "id", F.round("value", 6).alias("value"))

    return run


_AFTER = {"extrapolate": "CASE WHEN q.t = p.us THEN p.value WHEN b.us IS NOT NULL AND b.valid THEN b.value + (p.value - b.value) * ((q.t - b.us)::double / (p.us - b.us)) END"}
_VALUE = {"previous": "p.value", "nearest": "CASE WHEN n.us - q.t < q.t - p.us THEN n.value ELSE p.value END"}


def _reads_sql(mode: str, versions: bool = False) -> str:
    line = f"CASE WHEN n.us IS NOT NULL THEN p.value + (n.value - p.value) * ((q.t - p.us)::double / (n.us - p.us)) ELSE {_AFTER.get(mode, 'p.value')} END"
    return f"""WITH h AS (SELECT user_id, epoch_us(ts)::bigint AS us, value, event_id % 11 <> 0 AS valid, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'purchase'),
q AS (SELECT user_id, event_id AS id, epoch_us(ts)::bigint AS t, {"epoch_us(ts)::bigint - 432000000000" if versions else "(1::bigint << 62)"} AS v FROM events WHERE event_type = 'view'),
m AS (SELECT q.*, (SELECT max(i) FROM h WHERE h.user_id = q.user_id AND h.us <= q.t AND h.us <= q.v) AS i FROM q)
SELECT q.user_id, q.id, round(CASE WHEN p.valid THEN {_VALUE.get(mode, line)} END, 6) AS value FROM m q
LEFT JOIN h p ON p.user_id = q.user_id AND p.i = q.i LEFT JOIN h b ON b.user_id = q.user_id AND b.i = q.i - 1
LEFT JOIN h n ON n.user_id = q.user_id AND n.i = q.i + 1 AND n.valid AND n.us <= q.v"""


for _mode in (m for m in poses.MODES if "slerp" not in m):
    QUERIES[f"pose_{_mode}"] = _reads(_mode)
    ORACLES[f"pose_{_mode}"] = _reads_sql(_mode)
QUERIES["pose_versioned"] = _reads("linear", True)
ORACLES["pose_versioned"] = _reads_sql("linear", True)


def _rigid_reads(mode: str):
    def run(spark, sf_dir):
        """Each purchase turns the user's frame about z by its value, in hundredths, and moves it."""
        e = _events(spark, sf_dir)
        history = e.where("event_type = 'purchase'").select("user_id", "us", about_z(F.col("value") / 200, F.col("value"), (F.col("event_id") % 7).cast("double"), F.lit(1.0)).alias("value"), F.col("us").alias("version"), F.lit(True).alias("valid"))
        asked = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), "us", F.lit(1 << 62).alias("version"))
        out = poses.reads(asked, history, ["user_id"], "us", "value", _days, _days, mode)
        return out.select("user_id", "id", (F.round(yaw(F.col("value")), 6) + 0.0).alias("angle"), *[(F.round(f"value.{c}", 6) + 0.0).alias(c) for c in ("tx", "ty", "tz")])

    return run


def _rigid_sql(mode: str) -> str:
    """Turns about z, so angles add up; ``d`` is the turn from a to b on the shorter way, ``e`` how far to go."""
    arc = "CASE WHEN abs(d) < 1e-12 THEN e ELSE sin(e * d / 2) / sin(d / 2) END"
    # the step from a to b in the frame of a, turned half way back, stretched, and turned into the root again
    turn = "aa + d * (e - 1) / 2"
    step = {"tx": "(cos(-aa) * (bx - ax) - sin(-aa) * (b_y - ay))", "ty": "(sin(-aa) * (bx - ax) + cos(-aa) * (b_y - ay))"}
    screw = {"tx": f"ax + ({arc}) * (cos({turn}) * {step['tx']} - sin({turn}) * {step['ty']})", "ty": f"ay + ({arc}) * (sin({turn}) * {step['tx']} + cos({turn}) * {step['ty']})"}
    line = {"tx": "ax + e * (bx - ax)", "ty": "ay + e * (b_y - ay)"}
    move = screw if "slerp" in mode else line
    out = f"""WITH h AS (SELECT user_id, epoch_us(ts)::bigint AS us, value / 200 AS a, value AS x, (event_id % 7)::double AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'purchase'),
q AS (SELECT user_id, event_id AS id, epoch_us(ts)::bigint AS t FROM events WHERE event_type = 'view'), m AS (SELECT q.*, (SELECT max(i) FROM h WHERE h.user_id = q.user_id AND h.us <= q.t) AS i FROM q),
j AS (SELECT q.user_id, q.id, q.t, p.us AS p_us, p.a AS pa, p.x AS px, p.y AS py, n.us AS n_us, n.a AS na, n.x AS nx, n.y AS ny, b.us AS b_us, b.a AS ba, b.x AS bbx, b.y AS bby FROM m q
LEFT JOIN h p ON p.user_id = q.user_id AND p.i = q.i LEFT JOIN h n ON n.user_id = q.user_id AND n.i = q.i + 1 LEFT JOIN h b ON b.user_id = q.user_id AND b.i = q.i - 1),"""
    if mode.startswith("extrapolate"):
        after = "WHEN t = p_us THEN {p} WHEN b_us IS NOT NULL THEN {b}"
    else:
        after = "WHEN p_us IS NOT NULL THEN {p}"
    pick = lambda n, p, b: f"CASE WHEN n_us IS NOT NULL AND p_us IS NOT NULL THEN {n} " + after.format(p=p, b=b) + " END"
    out += f"""k AS (SELECT user_id, id, {pick("pa", "pa", "ba")} AS aa, {pick("px", "px", "bbx")} AS ax, {pick("py", "py", "bby")} AS ay, {pick("na", "pa", "pa")} AS a2, {pick("nx", "px", "px")} AS bx, {pick("ny", "py", "py")} AS b_y,
{pick("(t - p_us)::double / (n_us - p_us)", "0", "(t - b_us)::double / (p_us - b_us)")} AS e FROM j),
d AS (SELECT *, a2 - aa - 2 * pi() * round((a2 - aa) / (2 * pi())) AS d FROM k), f AS (SELECT user_id, id, aa + e * d AS a, {move["tx"]} AS tx, {move["ty"]} AS ty FROM d)
SELECT user_id, id, round(atan2(sin(a), cos(a)), 6) + 0.0 AS angle, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty, CASE WHEN a IS NOT NULL THEN 1.0::double END AS tz FROM f"""
    return out


for _mode in ("linear", "slerp", "extrapolate", "extrapolate_slerp"):
    QUERIES[f"pose_rigid_{_mode}"] = _rigid_reads(_mode)
    ORACLES[f"pose_rigid_{_mode}"] = _rigid_sql(_mode)


@query("""WITH h AS (SELECT user_id, epoch_us(ts)::bigint AS us, value, event_type = 'purchase' AS valid, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type IN ('purchase', 'error')),
q AS (SELECT user_id, event_id AS id, epoch_us(ts)::bigint AS t FROM events WHERE event_type = 'view'), m AS (SELECT q.*, (SELECT max(i) FROM h WHERE h.user_id = q.user_id AND h.us <= q.t) AS i FROM q)
SELECT m.user_id, m.id, CASE WHEN h.valid THEN h.value END AS value FROM m LEFT JOIN h ON h.user_id = m.user_id AND h.i = m.i""")
def pose_disconnect(spark, sf_dir):
    """An error disconnects its user's edge until the next purchase."""
    e = _events(spark, sf_dir)
    history = e.where("event_type = 'purchase'").select("user_id", "us", "value", F.col("us").alias("version"), F.lit(True).alias("valid"))
    cuts = e.where("event_type = 'error'").select("user_id", "us", F.col("us").alias("version"))
    asked = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), "us", F.lit(1 << 62).alias("version"))
    return poses.reads(asked, poses.disconnected(history, cuts, ["user_id"], "us", "value"), ["user_id"], "us", "value", _days, _days, "previous").select("user_id", "id", "value")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS k, s_nationkey AS a, 25 + s_suppkey % 5 AS b FROM supplier), p AS (SELECT a, b, min(k) AS k FROM e GROUP BY a, b), o AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM p),
r AS (SELECT 0::bigint AS i, -1::bigint AS a, -1::bigint AS b, true AS fresh, range(30) AS label UNION ALL
  SELECT o.i, o.a, o.b, r.label[o.a + 1] <> r.label[o.b + 1], list_transform(r.label, lambda x: CASE WHEN x = r.label[o.b + 1] THEN r.label[o.a + 1] ELSE x END) FROM r JOIN o ON o.i = r.i + 1)
SELECT e.k AS s_suppkey, 'f' || e.a AS lhs, 'f' || e.b AS rhs, r.fresh AS accepted FROM e JOIN r ON r.a = e.a AND r.b = e.b""")
def pose_tree_edges(spark, sf_dir):
    """Each supplier links its nation's frame with one of five others; an edge that closes a cycle is refused."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("f"), "s_nationkey").alias("lhs"), F.concat(F.lit("f"), 25 + F.col("s_suppkey") % 5).alias("rhs"))
    return poses.tree_edges(s, "s_suppkey")


@query(f"""WITH v AS (SELECT vec_id, v[1] * 2 AS r, v[2] * 2 AS p, v[3] * 2 AS y, v[4] AS tx, v[5] AS ty FROM (SELECT vec_id, {_D} AS v FROM embeddings))
SELECT vec_id, round(r, 6) AS roll, round(p, 6) AS pitch, round(y, 6) AS yaw, round(y, 6) AS angle, round(tx, 6) AS x, round(ty, 6) AS y, round(y * 0.5, 6) AS half_angle FROM v""")
def pose_maths(spark, sf_dir):
    """Angles to a rotation and back, a turn in the plane, and half of it."""
    v = _vectors(spark, sf_dir).select("vec_id", "v")
    p = v.select("vec_id", from_euler(F.col("v")[0] * 2, F.col("v")[1] * 2, F.col("v")[2] * 2).alias("p"), about_z(F.col("v")[2] * 2, F.col("v")[3], F.col("v")[4]).alias("z"))
    e, f = euler(F.col("p")), flat(F.col("z"))
    return p.select("vec_id", *[F.round(e[c], 6).alias(c) for c in ("roll", "pitch", "yaw")], *[F.round(f[c], 6).alias(c) for c in ("angle", "x", "y")], F.round(yaw(power(from_flat(f), 0.5)), 6).alias("half_angle"))


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR ts > m""")
def pose_ordered_updates(spark, sf_dir):
    return poses.accepted(_events(spark, sf_dir), ["user_id"], "us", ["event_id"], F.floor(F.col("event_id") / 4096)).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 8")
def pose_history(spark, sf_dir):
    return poses.recent(_events(spark, sf_dir), ["user_id"], "us", 8).select("event_id", "user_id")


@query("SELECT user_id, max(epoch_us(ts))::bigint AS us, max_by(value, ts) AS value, max_by(event_id % 11 <> 0, ts) AS valid FROM events GROUP BY user_id")
def pose_latest(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("valid", F.col("event_id") % 11 != 0)
    return poses.newest(e, ["user_id"], "us", "value", "valid")


def _frames(spark, sf_dir) -> DataFrame:
    """World, regions, nations, customers: each turns a quarter of its parent's axes and moves along its own x by its key."""
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("frame"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_nationkey").alias("key"))
    region = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("frame"), F.lit("world").alias("parent"), F.col("r_regionkey").alias("key"))
    customer = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("frame"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.col("c_custkey").alias("key"))
    moved = nation.unionAll(region).unionAll(customer).select("frame", "parent", about_z(math.pi / 2, F.col("key").cast("double")).alias("pose"))
    root = spark.range(1).select(F.lit("world").alias("frame"), F.lit(None).cast("string").alias("parent"), pose(1, 0, 0, 0, 0, 0, 0).alias("pose"))
    return moved.unionAll(root)


@query("""SELECT 'c' || c_custkey AS frame, 3 AS depth, r_regionkey::double - c_custkey AS tx, n_nationkey::double AS ty FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'n' || n_nationkey, 2, r_regionkey, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, 1, r_regionkey, 0 FROM region UNION ALL SELECT 'world', 0, 0, 0""")
def pose_compose(spark, sf_dir):
    out = poses.to_root(_frames(spark, sf_dir))
    return out.select("frame", "depth", *[(F.round(f"pose.{c}", 6) + 0.0).alias(c) for c in ("tx", "ty")])


@query("""SELECT 'n' || n_nationkey AS lhs, 'r' || r_regionkey AS rhs, 0.0::double AS tx, n_nationkey::double AS ty FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'r' || r_regionkey, 'world', 0.0, r_regionkey FROM region UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0.0, c_custkey FROM customer""")
def pose_canonical(spark, sf_dir):
    """Edges from child to parent are in order already, so each parent's edge to its child is turned round."""
    edges = _frames(spark, sf_dir).where("parent is not null").select(F.col("parent").alias("lhs"), F.col("frame").alias("rhs"), "pose")
    out = poses.canonical(edges).where(poses.is_rigid(F.col("pose")))
    return out.select("lhs", "rhs", *[(F.round(f"pose.{c}", 6) + 0.0).alias(c) for c in ("tx", "ty")])


@query("""WITH RECURSIVE f AS (SELECT CASE WHEN event_type = 'error' THEN '_' || event_id WHEN event_id % 50 = 0 THEN '' ELSE 'f' || (event_id % 5000) END AS frame, 'f' || (event_id % 7000) AS parent FROM events),
c AS (SELECT frame, count(*) AS n, max(parent) AS parent FROM f GROUP BY frame),
w(frame, up) AS (SELECT frame, parent FROM c UNION SELECT w.frame, c.parent FROM w JOIN c ON c.frame = w.up WHERE w.up <> w.frame)
SELECT frame, 'no name' AS problem FROM c WHERE frame = '' UNION ALL SELECT frame, 'reserved name' FROM c WHERE starts_with(frame, '_') UNION ALL SELECT frame, 'repeated name' FROM c WHERE n > 1
UNION ALL SELECT frame, 'no such parent' FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.frame = c.parent) UNION ALL SELECT frame, 'cycle' FROM w WHERE frame = up""")
def frame_problems(spark, sf_dir):
    e = _events(spark, sf_dir)
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("_"), "event_id")).when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("f"), F.col("event_id") % 5000))
    return poses.frame_problems(e.select(name.alias("frame"), F.concat(F.lit("f"), F.col("event_id") % 7000).alias("parent")))


@query(f"""WITH u AS (SELECT vec_id, {_U8} AS u FROM embeddings) SELECT vec_id, array_to_string(list_transform(u[1:3], lambda x: x::varchar), ', ') || ', ...' AS line, u[3] AS blue FROM u""")
def process_chain(spark, sf_dir):
    steps = {"line": ("v", [("rescale_down", {"lo": -0.5, "hi": 0.5}), ("printed", {"most": 3})]), "bgra": ("v", [("rescale_down", {"lo": -0.5, "hi": 0.5}), ("reorder_channels", {"channels": 4, "order": [2, 1, 0, 3]})])}
    return process(_vectors(spark, sf_dir), steps).select("vec_id", "line", F.col("bgra")[0].alias("blue"))
