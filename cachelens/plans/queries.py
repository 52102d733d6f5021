"""The queries of the engine: name, DataFrame, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import fnv1a, ring_hash
from ..operators import faults, health, metrics, replication, ring, signals, simulate, sketch, state
from ..operators.order import numbered
from ..session import scratch_path, stored
from ..sources import log as src
from ..sources import snapshots, workloads
from ..streaming import twins
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark, d):
    return src.access_log(spark, d)


def _replay(spark, d):
    return state.replay(_log(spark, d))


def _keys(spark, d):
    return _log(spark, d).select("key").distinct()


def _ring(spark, n=3):
    nodes = spark.range(1, n + 1).select(F.concat(F.lit("node-"), "id").alias("node_id"), F.lit(1.0).alias("weight"))
    return ring.points(nodes)


def _placed(spark, d, df):
    """df with node, the owner of each row's key: keys are placed once, then joined."""
    return df.join(ring.owners(df.select("key").distinct(), _ring(spark), "node"), "key")


# -- state -----------------------------------------------------------------
COUNTS = "count(*) FILTER (hit) AS hits, count(*) FILTER (miss) AS misses, count(*) FILTER (expired) AS expirations, count(*) FILTER (deleted) AS deletes, count(*) FILTER (op = 'PUT') AS writes, round(coalesce(count(*) FILTER (hit) / nullif(count(*) FILTER (hit OR miss), 0), 0), 6) AS hit_ratio"


@query(f"WITH {S.REPLAY} SELECT key, {COUNTS} FROM replayed GROUP BY key")
def hit_ratio_by_key(spark, d):
    return state.counters(_replay(spark, d), "key")


@query(f"WITH {S.REPLAY} SELECT {COUNTS} FROM replayed")
def cluster_hit_ratio(spark, d):
    return state.counters(_replay(spark, d))


STATE_COLS = "key, value, version::BIGINT AS version, created_at, updated_at, last_accessed_at, frequency::BIGINT AS frequency, expires_at, size_bytes"


@query(f"WITH {S.STATE} SELECT {STATE_COLS} FROM state")
def entry_state_final(spark, d):
    return state.final_state(_log(spark, d))


@query(f"WITH {S.STATE} SELECT {STATE_COLS} FROM state WHERE expires_at IS NULL OR expires_at > (SELECT max(ts) FROM log)")
def live_entries_at(spark, d):
    log = _log(spark, d)
    now = log.agg(F.max("ts").alias("now"))  # one row
    return state.live_at(state.final_state(log).crossJoin(F.broadcast(now)), F.col("now")).drop("now")


@query(f"WITH {S.STATE}, n AS (SELECT max(ts) AS t FROM log), asked AS (SELECT DISTINCT key FROM log UNION SELECT 'user:none') SELECT a.key, s.key IS NOT NULL AND (expires_at IS NULL OR expires_at > t) AS present, coalesce(expires_at <= t, false) AS removed FROM asked a CROSS JOIN n LEFT JOIN state s USING (key)")
def has_keys(spark, d):
    """Whether each key that ever came, and one that never did, has a live entry at the end."""
    log = _log(spark, d)
    asked = log.select("key").unionByName(spark.range(1).select(F.lit("user:none").alias("key")))
    return state.has(asked, state.final_state(log), F.lit(log.agg(F.max("ts")).first()[0]).cast("long"))


@query(f"WITH {S.STATE} SELECT key, version::BIGINT AS version, created_at, updated_at, last_accessed_at, frequency::BIGINT AS frequency, expires_at, size_bytes FROM state WHERE expires_at IS NULL OR expires_at > (SELECT max(ts) FROM log)")
def entry_metadata(spark, d):
    log = _log(spark, d)
    return state.metadata(state.final_state(log), F.lit(log.agg(F.max("ts")).first()[0]).cast("long"))


CLEARED_AT = 5_000


@query(f"WITH {S.REPLAY.replace(chr(39) + 'user:' + chr(39) + ' || user_id AS key', chr(39) + 'user:' + chr(39) + f' || user_id || (event_id < {CLEARED_AT}) AS key')} SELECT {COUNTS} FROM replayed")
def cleared_counters(spark, d):
    """Counters over a log in whose middle the store is cleared."""
    before, after = state.cleared(_log(spark, d), CLEARED_AT)
    return state.counters(before.unionByName(after))


@query(f"WITH {S.REPLAY} SELECT key, event_id, ts, m.exp AS expired_at FROM replayed WHERE expired")
def ttl_expirations(spark, d):
    return _replay(spark, d).where("expired").select("key", "event_id", "ts", F.col("m.exp").alias("expired_at"))


@query(f"WITH {S.STATE} SELECT expires_at // {S.DAY} + 1 AS tick, count(*) AS swept, sum(size_bytes)::BIGINT AS bytes FROM state WHERE expires_at IS NOT NULL GROUP BY 1")
def sweep_ticks(spark, d):
    """What the first sweep of a day after the log finds expired, by that day."""
    s = state.final_state(_log(spark, d)).where("expires_at is not null")
    return s.groupBy((F.floor(F.col("expires_at") / S.DAY) + 1).alias("tick")).agg(F.count("*").alias("swept"), F.sum("size_bytes").alias("bytes"))


@query(f"WITH {S.STATE} SELECT count(*) AS entry_count, coalesce(sum(size_bytes), 0)::BIGINT AS total_size_bytes, max(frequency)::BIGINT AS top_frequency, max(version)::BIGINT AS top_version FROM state")
def storage_stats(spark, d):
    return state.final_state(_log(spark, d)).agg(F.count("*").alias("entry_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"), F.max("frequency").alias("top_frequency"), F.max("version").alias("top_version"))


@query(f"WITH {S.STATE} SELECT key, min_by(key, last_accessed_at) OVER () IS NOT NULL AS tracked, row_number() OVER (ORDER BY last_accessed_at, key) AS lru_rank, row_number() OVER (ORDER BY frequency, created_at, key) AS lfu_rank, row_number() OVER (ORDER BY created_at, key) AS fifo_rank FROM state ORDER BY lru_rank LIMIT 5")
def eviction_candidates(spark, d):
    """The five entries that the recency policy gives up first, with their rank under each policy."""
    s = stored(state.final_state(_log(spark, d)).select("key", "last_accessed_at", "frequency", "created_at"), "entries")
    orders = {"lru": ("last_accessed_at", "key"), "lfu": ("frequency", "created_at", "key"), "fifo": ("created_at", "key")}
    first = s.orderBy(*orders["lru"]).limit(5).collect()  # five rows
    if not first:
        return s.select("key", F.lit(True).alias("tracked"), *(F.lit(0).alias(f"{n}_rank") for n in orders))

    def rank(row, cols):
        """One more than the entries that come before a row."""
        return (F.count_if(F.struct(*cols) < F.struct(*(F.lit(row[c]).cast(s.schema[c].dataType).alias(c) for c in cols))) + 1).cast("int")

    ranks = [F.struct(F.lit(r["key"]).alias("key"), F.lit(True).alias("tracked"), *(rank(r, c).alias(f"{n}_rank") for n, c in orders.items())) for r in first]
    return s.agg(F.array(*ranks).alias("r")).select(F.inline("r"))


# -- metrics ---------------------------------------------------------------
P = "quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, max(latency_ms) AS max"
PLACED = f"{S.ring('ring', S.NODES3)}, {S.KEYS}, {S.owner('own', 'ring')}"


@query(f"WITH {S.LOG}, {PLACED} SELECT owner AS node, {P} FROM log JOIN own USING (key) GROUP BY owner")
def latency_percentiles_by_node(spark, d):
    return metrics.percentiles_by(_placed(spark, d, _log(spark, d)), "node", "latency_ms")


@query(f"WITH {S.LOG} SELECT {P} FROM (SELECT * FROM log ORDER BY event_id DESC LIMIT 5000)")
def latency_last_5000(spark, d):
    return metrics.last_n(_log(spark, d), "event_id", 5_000).agg(*metrics.percentiles("latency_ms"))


@query(f"WITH {S.LOG} SELECT event_id, round(count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) / 86400.0, 6) AS rate FROM log")
def trailing_request_rate(spark, d):
    return metrics.trailing_rate(_log(spark, d).select("event_id", "key", "ts"), "key", "ts", S.DAY).select("event_id", "rate")


@query(f"WITH {S.LOG}, {PLACED} SELECT event_id, owner AS node, round(count(*) OVER (PARTITION BY owner ORDER BY ts RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) / 1.0, 6) AS rate FROM log JOIN own USING (key)")
def node_request_rate(spark, d):
    """Requests of a node in the second up to each of its operations."""
    return metrics.trailing_rate(_node_log(spark, d).select("event_id", "node", "ts"), "node", "ts", 1_000, 3_600).select("event_id", "node", "rate")


SNAP = f"{S.REPLAY}, {PLACED}, snaps AS (SELECT owner AS node, count(*) FILTER (hit) AS hits, count(*) FILTER (miss) AS misses, sum(size_bytes) AS memory, round(count(*) / 2592000.0, 6) AS rps, quantile_disc(latency_ms, 0.99) AS p99 FROM replayed JOIN own USING (key) GROUP BY owner)"


def _snapshots(spark, d):
    return metrics.node_snapshots(_placed(spark, d, _replay(spark, d)), 2_592_000.0)


@query(f"WITH {SNAP} SELECT count(*) AS nodes, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, sum(memory)::BIGINT AS memory, round(sum(rps), 4) AS rps, round(sum(hits) / (sum(hits) + sum(misses)), 6) AS hit_ratio, max(p99) AS worst_p99 FROM snaps")
def cluster_summary(spark, d):
    return metrics.cluster_summary(_snapshots(spark, d))


@query("SELECT count(*) FILTER (user_id % 3 = 0) AS lru, count(*) FILTER (user_id % 3 = 1) AS lfu, count(*) FILTER (user_id % 3 = 2) AS tiny_lfu FROM (SELECT DISTINCT user_id FROM events)")
def policy_distribution(spark, d):
    users = src.table(spark, d, "events").select("user_id").distinct()
    p = F.element_at(F.array(*map(F.lit, metrics.POLICIES)), (F.col("user_id") % 3 + 1).cast("int"))
    return metrics.distribution(users.select(p.alias("policy")), "policy", metrics.POLICIES)


@query(f"WITH {S.LOG} SELECT op, count(*) AS n, round(count(*) / greatest(1, (SELECT max(ts) - min(ts) FROM log)) * 1000, 9) AS throughput FROM log GROUP BY op")
def run_throughput(spark, d):
    log = _log(spark, d)
    span = log.agg(F.greatest(F.lit(1), F.max("ts") - F.min("ts")).alias("span"))  # one row
    return log.groupBy("op").agg(F.count("*").alias("n")).crossJoin(F.broadcast(span)).select("op", "n", F.round(F.col("n") / F.col("span") * 1000, 9).alias("throughput"))


@query(f"WITH {SNAP} SELECT arg_max(node, hits / (hits + misses)) AS best_hit_ratio, arg_min(node, p99) AS best_p99, arg_max(node, rps) AS best_throughput FROM snaps")
def best_policy_argmax(spark, d):
    return _snapshots(spark, d).agg(F.max_by("node", F.col("hits") / (F.col("hits") + F.col("misses"))).alias("best_hit_ratio"), F.min_by("node", "p99").alias("best_p99"), F.max_by("node", "rps").alias("best_throughput"))


@query(f"WITH {S.LOG} SELECT ts // {S.DAY} AS tick, count(*) AS n FROM log GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def history_last_30(spark, d):
    return _log(spark, d).groupBy(F.floor(F.col("ts") / S.DAY).alias("tick")).agg(F.count("*").alias("n")).orderBy(F.desc("tick")).limit(30)


# -- functions -------------------------------------------------------------
@query(f"WITH {S.KEYS} SELECT key, h AS hash, ({S.fnv('key')})::BIGINT AS fnv FROM k")
def ring_hash_of_keys(spark, d):
    return _keys(spark, d).select("key", ring_hash(F.col("key")).alias("hash"), fnv1a(F.col("key")).alias("fnv"))


@query("WITH k AS (SELECT DISTINCT 'user:' || user_id AS key FROM events) SELECT key, " + ", ".join(f"(({S.fnv('key', r)}) % 2048)::INTEGER AS c{r}" for r in range(4)) + " FROM k")
def cms_cells(spark, d):
    c = sketch.cells(F.col("key"))
    return _keys(spark, d).select("key", *(c[r].alias(f"c{r}") for r in range(4)))


@query(f"WITH {S.LOG} SELECT size_bytes, count(*) AS n FROM log GROUP BY size_bytes")
def value_sizes(spark, d):
    return _log(spark, d).groupBy("size_bytes").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_orderkey) AS BIGINT) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS label FROM s""")
def format_bytes(spark, d):
    b = F.floor(F.col("o_totalprice") * F.col("o_orderkey"))
    return src.table(spark, d, "orders").select("o_orderkey", text.format_bytes(b).alias("label"))


@query("""SELECT CASE WHEN key = '' OR (op = 'PUT' AND value IS NULL) OR ttl <= 0 THEN 'VALIDATION_ERROR' END AS code, CASE WHEN key = '' OR (op = 'PUT' AND value IS NULL) OR ttl <= 0 THEN 400 END AS status, count(*) AS n
FROM (SELECT CASE WHEN event_id % 11 = 0 THEN '' ELSE 'user:' || user_id END AS key, CASE WHEN event_type IN ('signup','purchase') THEN 'PUT' ELSE 'GET' END AS op, CASE WHEN event_id % 7 <> 0 THEN props END AS value, event_id % 5 AS ttl FROM events) GROUP BY ALL""")
def validate_ops(spark, d):
    e = src.table(spark, d, "events")
    ops = e.select(F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("user:"), "user_id")).alias("key"), F.when(F.col("event_type").isin("signup", "purchase"), "PUT").otherwise("GET").alias("op"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("value"), (F.col("event_id") % 5).alias("ttl"))
    code = src.validate(F.col("op"), F.col("key"), F.col("value"), F.col("ttl"))
    return ops.groupBy(code.alias("code")).agg(F.count("*").alias("n")).select("code", F.when(F.col("code").isNotNull(), src.status_of(F.col("code"))).alias("status"), "n")


@query("SELECT * FROM (VALUES ('node-1', 'cache-1', 7001, 1.0::DOUBLE, 'HEALTHY'), ('node-2', 'cache-2', 7002, 1.0, 'HEALTHY'), ('node-3', 'cache-3', 7003, 1.0, 'HEALTHY')) t(node_id, host, port, weight, status)")
def parse_static_nodes(spark, d):
    return src.nodes(spark)


@query("SELECT doc_id, url_encode(source || ' ' || lang || '/+%') AS encoded, source || ' ' || lang || '/+%' AS decoded FROM documents")
def url_codec(spark, d):
    raw = F.concat_ws("", F.concat_ws(" ", "source", "lang"), F.lit("/+%"))
    return src.table(spark, d, "documents").select("doc_id", text.encode_component(raw).alias("encoded"), text.decode_component(text.encode_component(raw)).alias("decoded"))


# -- ring ------------------------------------------------------------------
RING = S.ring("ring", S.NODES3)


@query(f"WITH {RING} SELECT node_id, idx::INTEGER AS idx, h AS hash FROM ring")
def ring_points(spark, d):
    return _ring(spark)


@query(f"WITH {PLACED} SELECT key, owner FROM own")
def key_owner(spark, d):
    return ring.owners(_keys(spark, d), _ring(spark))


@query(f"WITH {RING}, {S.KEYS}, {S.replicas(2)} SELECT key, nodes[1] AS first, nodes[2] AS second FROM reps")
def key_replicas(spark, d):
    return ring.replicas(_keys(spark, d), _ring(spark), 2).select("key", F.col("nodes")[0].alias("first"), F.col("nodes")[1].alias("second"))


@query(f"WITH {PLACED}, v AS (SELECT node_id AS node, count(*) AS points FROM ring GROUP BY 1) SELECT node, points, count(key) AS keys FROM v LEFT JOIN own ON owner = node GROUP BY node, points")
def ring_balance(spark, d):
    keys = ring.owners(_keys(spark, d), _ring(spark), "node").groupBy("node").agg(F.count("*").alias("k"))
    return _ring(spark).groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("points")).join(keys, "node", "left").select("node", "points", F.coalesce("k", F.lit(0)).alias("keys"))


@query(f"WITH {PLACED}, {S.ring('ring4', S.NODES4)}, {S.owner('own4', 'ring4')} SELECT count(*) AS total, count(*) FILTER (a.owner <> b.owner) AS moved, round(count(*) FILTER (a.owner <> b.owner) / count(*), 6) AS ratio, 0.25 AS expected FROM own a JOIN own4 b USING (key)".replace("0.25 AS", "0.25::DOUBLE AS"))
def rebalance_movement(spark, d):
    return ring.movement(_keys(spark, d), _ring(spark), _ring(spark, 4))


@query(f"WITH {S.ring('ring', 'SELECT * FROM (VALUES (' + chr(39) + 'node-1' + chr(39) + ', 128), (' + chr(39) + 'node-2' + chr(39) + ', 384), (' + chr(39) + 'node-3' + chr(39) + ', 64)) t(node_id, n)')}, {S.KEYS}, {S.owner('own', 'ring')} SELECT owner AS node, count(*) AS keys FROM own GROUP BY owner")
def weighted_ring(spark, d):
    nodes = src.nodes(spark, "node-1:a:1:1,node-2:b:2:3,node-3:c:3:0.5")
    return ring.owners(_keys(spark, d), ring.points(nodes), "node").groupBy("node").agg(F.count("*").alias("keys"))


@query(f"WITH {RING}, {S.KEYS}, {S.replicas(3)} SELECT key, list_filter(nodes, lambda x: x <> 'node-2')[1] AS target, nodes[1] = 'node-2' AS failed_over FROM reps")
def failover_route(spark, d):
    return ring.route(ring.replicas(_keys(spark, d), _ring(spark), 3), ["node-2"])


@query(f"WITH {RING}, {S.KEYS}, {S.replicas(3)}, known AS (SELECT * FROM (VALUES ('node-1', 'cache-1', 7001, 'HEALTHY'), ('node-2', 'cache-2', 7002, 'DEAD')) t(node_id, host, port, status)) SELECT key, place::INTEGER AS place, node_id, host, port, status FROM (SELECT key, unnest(nodes) AS node_id, unnest(range(len(nodes))) AS place FROM reps) JOIN known USING (node_id) WHERE status <> 'DEAD'")
def candidate_nodes(spark, d):
    """The nodes that a request for each key may go to, node-2 being dead and node-3 unknown."""
    known = src.nodes(spark).where("node_id <> 'node-3'").select("node_id", "host", "port", F.when(F.col("node_id") == "node-2", "DEAD").otherwise(F.col("status")).alias("status"))
    return ring.candidates(ring.replicas(_keys(spark, d), _ring(spark), 3), known)


@query(f"WITH {RING} SELECT node_id, idx::INTEGER AS idx, round(cos(h / 4294967295.0 * 2 * pi()), 6) AS x, round(sin(h / 4294967295.0 * 2 * pi()), 6) AS y FROM ring")
def ring_angles(spark, d):
    a = F.col("hash") / 4294967295.0 * 2 * F.pi()
    return _ring(spark).select("node_id", "idx", F.round(F.cos(a), 6).alias("x"), F.round(F.sin(a), 6).alias("y"))


# -- signals ---------------------------------------------------------------
@query(f"WITH {S.SAMPLES} SELECT tick, key, n FROM hist")
def window_key_frequency(spark, d):
    return signals.history(signals.samples(_replay(spark, d)))


SIG = f"WITH {S.SIGNALS} "


def _signals(spark, d):
    return signals.by_tick(_replay(spark, d))


@query(SIG + "SELECT tick, skew FROM signals")
def frequency_skew(spark, d):
    return _signals(spark, d).select("tick", "skew")


@query(SIG + "SELECT tick, working_set FROM signals")
def working_set_ratio(spark, d):
    return _signals(spark, d).select("tick", "working_set")


@query(SIG + "SELECT tick, sequential FROM signals")
def sequential_score(spark, d):
    return _signals(spark, d).select("tick", "sequential")


@query(SIG + "SELECT * FROM signals")
def signals_by_tick(spark, d):
    return _signals(spark, d)


DECIDED = "SELECT tick, samples, CASE WHEN sequential >= 0.5 THEN 'LRU' WHEN 1 - write_ratio_ema >= 0.7 AND skew >= 0.4 THEN 'LFU' WHEN write_ratio_ema >= 0.6 THEN 'LRU' ELSE 'TINY_LFU' END AS policy, CASE WHEN sequential >= 0.5 THEN 2 WHEN 1 - write_ratio_ema >= 0.7 AND skew >= 0.4 THEN 3 WHEN write_ratio_ema >= 0.6 THEN 4 ELSE 5 END AS rule FROM signals"


def _decisions(spark, d):
    policy, rule = signals.decide(F.lit(0.0), F.col("sequential"), 1 - F.col("write_ratio_ema"), F.col("skew"), F.col("write_ratio_ema"))
    return _signals(spark, d).select("tick", "samples", policy.alias("policy"), rule.alias("rule"))


@query(SIG + DECIDED)
def policy_decisions(spark, d):
    return _decisions(spark, d)


@query(SIG + f", dec AS ({DECIDED}), act AS (SELECT *, coalesce(lag(policy) OVER (ORDER BY tick), 'LRU') AS \"from\" FROM dec WHERE samples >= 200) SELECT tick, \"from\", policy AS \"to\", rule FROM act WHERE policy <> \"from\"")
def policy_switches(spark, d):
    return signals.switches(_decisions(spark, d))


# -- sketch ----------------------------------------------------------------
CMS = S.LOG + ", ks AS (SELECT key, count(*) AS n FROM log GROUP BY key), cs AS (" + " UNION ALL ".join(f"SELECT key, n, {r} AS row, (({S.fnv('key', r)}) % 2048)::INTEGER AS cell FROM ks" for r in range(4)) + "), sk AS (SELECT row, cell, least(sum(n), 65535) AS c FROM cs GROUP BY ALL), est AS (SELECT key, n, min(c)::BIGINT AS estimate FROM cs JOIN sk USING (row, cell) GROUP BY key, n)"


def _counts(spark, d):
    return _log(spark, d).groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {CMS} SELECT key, estimate FROM est")
def cms_estimates(spark, d):
    k = _counts(spark, d)
    return sketch.estimates(k, sketch.sketch(k))


@query(f"WITH {CMS} SELECT count(*) AS keys, sum(estimate - n)::BIGINT AS overcount, max(estimate - n) AS worst FROM est")
def cms_overcount(spark, d):
    k = _counts(spark, d)
    e = sketch.estimates(k, sketch.sketch(k)).join(k, "key")
    return e.agg(F.count("*").alias("keys"), F.sum(F.col("estimate") - F.col("n")).alias("overcount"), F.max(F.col("estimate") - F.col("n")).alias("worst"))


AGED = S.LOG + ", hs AS (SELECT key, row_number() OVER (ORDER BY event_id) AS seq FROM log), cl AS (SELECT max(seq) // 3000 AS closed FROM hs), ks AS (SELECT key, (seq - 1) // 3000 AS epoch, count(*) AS n FROM hs GROUP BY ALL), cs AS (" + " UNION ALL ".join(f"SELECT epoch, n, {r} AS row, (({S.fnv('key', r)}) % 2048)::INTEGER AS cell FROM ks" for r in range(4)) + "), per AS (SELECT row, cell, epoch, sum(n) AS n FROM cs GROUP BY ALL), grid AS (SELECT row, cell, e AS epoch FROM (SELECT DISTINCT row, cell FROM per), range(0, (SELECT closed + 1 FROM cl)) t(e)), seqd AS (SELECT row, cell, list(coalesce(n, 0)::BIGINT ORDER BY epoch) AS ns FROM grid LEFT JOIN per USING (row, cell, epoch) GROUP BY ALL), folded AS (SELECT row, cell, list_reduce(list_prepend(0::BIGINT, ns[:-2]), lambda v, x: least(65535, v + x) // 2) AS v, ns[-1] AS last FROM seqd)"


@query(f"WITH {AGED} SELECT row, cell, least(65535, v + last)::BIGINT AS count FROM folded WHERE v + last > 0")
def cms_aged(spark, d):
    return sketch.aged(numbered(_log(spark, d)).select("key", "seq"), 3_000)


# -- simulator -------------------------------------------------------------
SIM = f"WITH RECURSIVE {S.LOG}, {PLACED}, "


def _node_log(spark, d):
    return _placed(spark, d, _log(spark, d))


@query(f"""WITH {S.LOG}, {PLACED}, a AS (SELECT owner AS node, key, row_number() OVER (PARTITION BY owner ORDER BY event_id) AS seq FROM log JOIN own USING (key)), b AS (SELECT *, lag(seq) OVER (PARTITION BY node, key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY node, key ORDER BY seq) AS nxt FROM a),
dist AS (SELECT x.node, x.seq, count(*) AS between_keys FROM b x JOIN b y ON y.node = x.node AND y.seq > x.prev AND y.seq < x.seq AND (y.nxt IS NULL OR y.nxt > x.seq) GROUP BY ALL)
SELECT b.node, count(*) AS accesses, count(*) FILTER (b.prev IS NOT NULL AND coalesce(between_keys, 0) < 20) AS hits FROM b LEFT JOIN dist USING (node, seq) GROUP BY b.node""")
def lru_read_through_hits(spark, d):
    return simulate.lru_read_through(_node_log(spark, d), 20)


@query(SIM + S.simulated("'FIFO'", 20) + " SELECT * FROM simulated")
def simulate_fifo(spark, d):
    return simulate.simulate(_node_log(spark, d), ["FIFO"], max_entries=20)


@query(SIM + S.simulated("'LRU'", 20) + " SELECT * FROM simulated")
def simulate_lru(spark, d):
    return simulate.simulate(_node_log(spark, d), ["LRU"], max_entries=20)


@query(SIM + S.simulated("'LFU'", 20) + " SELECT * FROM simulated")
def simulate_lfu(spark, d):
    return simulate.simulate(_node_log(spark, d), ["LFU"], max_entries=20)


@query(SIM + S.simulated("'TINY_LFU'", 20) + " SELECT * FROM simulated")
def simulate_tinylfu(spark, d):
    return simulate.simulate(_node_log(spark, d), ["TINY_LFU"], max_entries=20)


@query(SIM + S.simulated("'LRU'", max_bytes=160) + " SELECT * FROM simulated")
def simulate_bytes_cap(spark, d):
    return simulate.simulate(_node_log(spark, d), ["LRU"], max_bytes=160)


@query(f"WITH {S.REPLAY}, {PLACED} SELECT owner AS node, 'LRU' AS policy, count(*) FILTER (hit) AS hits, count(*) FILTER (miss) AS misses, count(*) FILTER (expired) AS expirations, count(*) FILTER (deleted) AS deletes, count(*) FILTER (op = 'PUT') AS writes, 0::BIGINT AS evictions FROM replayed JOIN own USING (key) GROUP BY owner")
def simulate_unbounded(spark, d):
    """Without a cap the simulator must agree with the windows."""
    return simulate.simulate(_node_log(spark, d), ["LRU"]).select("node", "policy", "hits", "misses", "expirations", "deletes", "writes", "evictions")


@query()
def simulate_adaptive(spark, d):
    # signals are those of a tick's end
    at = [((r["tick"] + 1) * S.DAY, r["to"]) for r in signals.switches(_decisions(spark, d)).collect()]  # a row for each switch
    return simulate.simulate(_node_log(spark, d), ["LRU"], max_entries=20, switch_at=sorted(at))


COMPARED = SIM + S.simulated("'FIFO', 'LRU', 'LFU', 'TINY_LFU'", 20) + ", per AS (SELECT policy, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, sum(evictions)::BIGINT AS evictions, round(sum(hits) / (sum(hits) + sum(misses)), 6) AS hit_ratio FROM simulated GROUP BY policy)"


@query(COMPARED + " SELECT *, rank() OVER (ORDER BY hit_ratio DESC) = 1 AS best FROM per")
def policy_comparison(spark, d):
    got = simulate.simulate(_node_log(spark, d), list(simulate.POLICIES), max_entries=20)
    per = got.groupBy("policy").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("evictions").alias("evictions"))
    per = per.withColumn("hit_ratio", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))
    return per.withColumn("best", F.rank().over(W.orderBy(F.desc("hit_ratio"))) == 1)  # four rows


# -- replication -----------------------------------------------------------
REPL = f"{S.REPLAY}, {RING}, {S.KEYS}, {S.replicas(2)}, {S.owner('own', 'ring')}, ev AS (SELECT event_id, owner AS source, key, op, value, version::BIGINT AS version, ts FROM replayed JOIN own USING (key) WHERE op = 'PUT' OR deleted)"
SENT = REPL + ", sent AS (SELECT event_id, source, key, op, value, version, ts, unnest(list_filter(nodes, lambda x: x <> source)) AS target FROM ev JOIN reps USING (key))"
ARRIVED = SENT + ", " + S.hashed("hs", "SELECT *, event_id || '@' || target AS x FROM sent") + ", arrived AS (SELECT event_id, key, op, value, version, ts, target, ts + 2000 + (event_id % 4) * 1500 AS applied_at FROM hs WHERE h % 100 >= 10)"


def _events(spark, d):
    return replication.events(_placed(spark, d, _replay(spark, d)))


def _sent(spark, d):
    e = _events(spark, d)
    return replication.targets(e, ring.replicas(_keys(spark, d), _ring(spark), 2))


def _delay():
    return F.lit(2_000) + F.col("event_id") % 4 * 1_500


def _arrived(spark, d):
    return replication.faulted(_sent(spark, d), 10, _delay())


def _delivered(spark, d):
    return replication.delivered(_sent(spark, d), 10, _delay())


@query(f"WITH {REPL} SELECT event_id, source, key, op, version FROM ev")
def replication_events(spark, d):
    return _events(spark, d).select("event_id", "source", "key", "op", "version")


@query(f"WITH {SENT} SELECT event_id, source, target FROM sent")
def replication_targets(spark, d):
    return _sent(spark, d).select("event_id", "source", "target")


@query(f"WITH {SENT} SELECT event_id, source, key, version FROM sent WHERE target = 'node-2'")
def addressed_events(spark, d):
    """What node-2 takes from the topic that all nodes read."""
    return replication.addressed_to(_events(spark, d), ring.replicas(_keys(spark, d), _ring(spark), 2), "node-2").select("event_id", "source", "key", "version")


@query(f"WITH {ARRIVED} SELECT event_id, target, applied_at FROM arrived")
def faulted_replication(spark, d):
    return _arrived(spark, d).select("event_id", "target", "applied_at")


@query(f"WITH {ARRIVED} SELECT target, key, op, value, version, event_id FROM arrived QUALIFY row_number() OVER (PARTITION BY target, key ORDER BY version DESC, event_id) = 1")
def lww_merge(spark, d):
    return replication.merge(_arrived(spark, d), "target")


@query(f"WITH {ARRIVED}, w AS (SELECT event_id, ts, count(*) AS wanted FROM sent GROUP BY ALL) SELECT w.event_id, wanted, count(a.target) FILTER (a.applied_at - w.ts <= 5000) AS acked, count(a.target) FILTER (a.applied_at - w.ts <= 5000) = wanted AS complete FROM w LEFT JOIN arrived a USING (event_id) GROUP BY w.event_id, wanted")
def ack_completeness(spark, d):
    return replication.acks(_delivered(spark, d))


PENDING_AT = 1_704_900_000_000


@query(f"WITH {ARRIVED}, w AS (SELECT event_id, count(*) AS wanted FROM sent WHERE ts <= {PENDING_AT} AND ts + 600000 > {PENDING_AT} GROUP BY 1), g AS (SELECT event_id, count(*) AS n FROM arrived WHERE applied_at <= {PENDING_AT} GROUP BY 1) SELECT count(*) FILTER (coalesce(n, 0) < wanted) AS pending FROM w LEFT JOIN g USING (event_id)")
def pending_acks(spark, d):
    return replication.pending_at(_delivered(spark, d), None, F.lit(PENDING_AT).cast("long"), 600_000)


# -- health ----------------------------------------------------------------
POLLS = f"{S.LOG}, {PLACED}, polls AS (SELECT owner AS node, ts // 3600000 AS poll, bool_or(op = 'PUT') AS ok FROM log JOIN own USING (key) GROUP BY ALL)"


@query(f"WITH {POLLS}, g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY poll) AS g FROM polls), r AS (SELECT node, poll, ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY node, g ORDER BY poll) AS BIGINT) AS misses FROM g) SELECT node, poll AS \"at\", ok, misses, CASE WHEN misses >= 5 THEN 'DEAD' WHEN misses >= 2 THEN 'SUSPECT' ELSE 'HEALTHY' END AS status FROM r")
def health_status_timeline(spark, d):
    return health.timeline(health.polls_of(_node_log(spark, d), F.col("node"), F.col("op") == "PUT", 3_600_000))


OUTAGE = "(VALUES ('node-1', 1704500000000, 1704700000000), ('node-3', 1705500000000, 1705900000000)) o(node, s, e)"


@query(f"WITH {S.LOG}, {PLACED} SELECT owner AS node, count(*) FILTER (EXISTS (SELECT 1 FROM {OUTAGE} WHERE o.node = owner AND ts >= s AND ts < e)) AS refused, count(*) AS total FROM log JOIN own USING (key) GROUP BY owner")
def outage_gated_ops(spark, d):
    o = spark.sql("SELECT * FROM VALUES ('node-1', 1704500000000L, 1704700000000L), ('node-3', 1705500000000L, 1705900000000L) AS o(node, start, end)")
    return health.gated(_node_log(spark, d), o).groupBy("node").agg(F.count_if("down").alias("refused"), F.count("*").alias("total"))


# -- snapshots -------------------------------------------------------------
@query(f"WITH {S.STATE} SELECT {STATE_COLS} FROM state")
def snapshot_roundtrip(spark, d):
    """The state through a compressed snapshot and its checksum."""
    root = scratch_path(spark, "snapshots")
    snapshots.take(state.final_state(_log(spark, d)), root, "s1", "node-1", 1)
    return snapshots.restore(spark, root)


@query("SELECT 's' || o_orderkey AS snapshot_id, 'node-' || (o_custkey % 20) AS node FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, 's' || o_orderkey DESC) > 5")
def snapshot_retention(spark, d):
    m = src.table(spark, d, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("snapshot_id"), F.concat(F.lit("node-"), F.col("o_custkey") % 20).alias("node"), F.col("o_orderdate").alias("created_at"))
    return snapshots.expired_ids(m).select("snapshot_id", "node")


@query(f"WITH {S.STATE}, n AS (SELECT max(ts) AS t FROM log) SELECT count(*) AS entries_restored, count(*) FILTER (expires_at <= t) AS expired_on_arrival, coalesce(sum(size_bytes), 0)::BIGINT AS bytes_restored, 0::BIGINT AS operations_replayed FROM state, n")
def recovery_report(spark, d):
    log = _log(spark, d)
    return snapshots.report(state.final_state(log), log.agg(F.max("ts")).first()[0])


@query(f"WITH {S.STATE}, n AS (SELECT max(ts) AS t FROM log) SELECT key, value, 1::BIGINT AS version, t AS created_at, t AS updated_at, t AS last_accessed_at, 0::BIGINT AS frequency, t + greatest(expires_at - t, 0 * expires_at) AS expires_at, size_bytes FROM state, n")
def recovered_entries(spark, d):
    log = _log(spark, d)
    return snapshots.recovered(state.final_state(log), log.agg(F.max("ts")).first()[0])


@query(f"WITH {S.STATE} SELECT 'node-1' AS node, 's2' AS snapshot_restored, count(*) AS entries_restored, 0::BIGINT AS operations_replayed, true AS integrity_verified, 0 AS errors, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM state")
def recovery_chain(spark, d):
    """Two snapshots, the newer one restored into an empty store, and its report."""
    root, s = scratch_path(spark, "recovery"), state.final_state(_log(spark, d))
    snapshots.take(s.limit(0), root, "s1", "node-1", 1)
    snapshots.take(s, root, "s2", "node-1", 2)
    entries, report = snapshots.recover(spark, root, "node-1", PENDING_AT)
    snapshots.assert_healthy(report)
    held = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return report.crossJoin(held).select("node", "snapshot_restored", "entries_restored", "operations_replayed", "integrity_verified", F.size("errors").alias("errors"), "bytes")  # one row each


# -- faults, commands, sweeps --------------------------------------------------
CMD = f"""{S.LOG}, cmd AS (SELECT 'node-' || (1 + event_id % 3) AS node, event_id AS at, ['KILL', 'RESTART', 'DELAY_REPLICATION', 'DROP_MESSAGES', 'REBOOT'][1 + (event_id // 3) % 5] AS type,
CASE WHEN event_id % 2 = 0 THEN event_id % 5000 END AS duration_ms, CASE WHEN event_id % 7 > 0 THEN (event_id % 30) / 20.0 END AS drop_rate FROM log WHERE event_id % 50 < 6)"""
FAULTS = f"""{CMD}, st AS (SELECT node, "at", type, coalesce(last_value(CASE WHEN type IN ('KILL', 'RESTART') THEN type = 'KILL' END IGNORE NULLS) OVER w, false) AS killed, coalesce(last_value(CASE WHEN type = 'DELAY_REPLICATION' THEN coalesce(duration_ms, 2000) END IGNORE NULLS) OVER w, 0)::BIGINT AS delay_ms,
coalesce(last_value(CASE WHEN type = 'DROP_MESSAGES' THEN least(1, greatest(0, coalesce(drop_rate, 0.5))) END IGNORE NULLS) OVER w, 0)::DOUBLE AS "drop" FROM cmd WHERE type <> 'REBOOT' WINDOW w AS (PARTITION BY node ORDER BY "at" ROWS UNBOUNDED PRECEDING))"""


def _commands(spark, d):
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, (*faults.COMMANDS, "REBOOT"))), (1 + F.floor(e / 3) % 5).cast("int"))
    return _log(spark, d).where(e % 50 < 6).select(F.concat(F.lit("node-"), 1 + e % 3).alias("node"), e.alias("at"), kind.alias("type"), F.when(e % 2 == 0, e % 5_000).alias("duration_ms"), F.when(e % 7 > 0, (e % 30) / 20).alias("drop_rate"))


@query(f"WITH {FAULTS} SELECT * FROM st")
def fault_states(spark, d):
    """The state that each fault command leaves its node in."""
    return faults.states(_commands(spark, d))


@query(f"WITH {FAULTS}, k AS (SELECT node, \"at\", killed, lag(killed, 1, false) OVER (PARTITION BY node ORDER BY \"at\") AS was FROM st WHERE type IN ('KILL', 'RESTART')), t AS (SELECT node, \"at\", killed, lead(\"at\") OVER (PARTITION BY node ORDER BY \"at\") AS e FROM k WHERE killed <> was) SELECT node, \"at\" AS start, e AS \"end\" FROM t WHERE killed")
def fault_outages(spark, d):
    return faults.outages(_commands(spark, d))


@query(f"WITH {CMD} SELECT type, CASE WHEN type = 'REBOOT' THEN 'VALIDATION_ERROR' END AS code, count(*) AS n FROM cmd GROUP BY type")
def command_validation(spark, d):
    return _commands(spark, d).groupBy("type", faults.command_error(F.col("type")).alias("code")).agg(F.count("*").alias("n"))


ORDERS = ((19_727, "pin", "LRU"), (19_735, "resume", None), (19_740, "force", "LFU"))


@query(SIG + f", dec AS ({DECIDED}) SELECT tick, CASE WHEN tick BETWEEN {ORDERS[0][0]} AND {ORDERS[1][0] - 1} THEN 'LRU' WHEN tick = {ORDERS[2][0]} THEN 'LFU' ELSE policy END AS policy, NOT tick BETWEEN {ORDERS[0][0]} AND {ORDERS[1][0] - 1} AS auto FROM dec")
def pinned_policy(spark, d):
    """The decisions under a pin of eight days and, later, a forced switch."""
    orders = spark.createDataFrame([(t * S.DAY, k, p) for t, k, p in ORDERS], "at long, kind string, policy string")
    return faults.pinned(_decisions(spark, d).select("tick", "policy"), orders, S.DAY)


@query(f"WITH {S.REPLAY}, {PLACED} SELECT owner AS node, count(*) FILTER (hit) AS hits, count(*) FILTER (miss) AS misses, count(*) FILTER (op = 'PUT') AS writes FROM replayed JOIN own USING (key) GROUP BY owner")
def swept_counters(spark, d):
    """Counters of nodes that sweep expired entries every hour: a sweep changes neither hits nor misses nor writes."""
    return simulate.simulate(_node_log(spark, d), ["LRU"], sweep_ms=3_600_000).select("node", "hits", "misses", "writes")


@query(f"WITH {S.REPLAY}, arr AS (SELECT key, max(version)::BIGINT AS version FROM replayed WHERE op = 'PUT' GROUP BY key), ends AS (SELECT * FROM replayed QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1), n AS (SELECT max(ts) AS t FROM log), loc AS (SELECT key, version::BIGINT AS version FROM ends, n WHERE op <> 'DELETE' AND NOT expired AND version > 0 AND (p.exp IS NULL OR p.exp > t)) SELECT a.key, a.version, CASE WHEN l.key IS NULL THEN 'absent' WHEN a.version > l.version THEN 'newer' ELSE 'stale' END AS reason, l.key IS NULL OR a.version > l.version AS applies FROM arr a LEFT JOIN loc l USING (key)")
def replica_resolution(spark, d):
    """What a replica with the final entries does with the highest version that ever came for each key."""
    log = _log(spark, d)
    now = log.agg(F.max("ts")).first()[0]
    incoming = state.replay(log).where("op = 'PUT'").groupBy("key").agg(F.max("version").alias("version"))
    return replication.resolved(state.final_state(log).select("key", "version", "expires_at"), incoming, F.lit(now).cast("long"))


# -- streams ---------------------------------------------------------------
@query(f"WITH {S.LOG} SELECT op, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM log GROUP BY op")
def stream_stats(spark, d):
    return twins.drained(twins.stats(twins.events_stream(spark, d)), "op")


@query(f"WITH {S.LOG} SELECT ts // {S.DAY} * {S.DAY} AS tick, count(*) AS n, count(*) FILTER (op = 'GET') AS reads FROM log GROUP BY 1")
def stream_ticks(spark, d):
    return twins.drained(twins.ticks(twins.events_stream(spark, d)), "tick")


@query(f"WITH {S.LOG} SELECT key, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM log WHERE op = 'PUT' GROUP BY key")
def stream_lww(spark, d):
    return twins.drained(twins.last_writes(twins.events_stream(spark, d)), "key")


@query(f"WITH {S.LOG} SELECT event_id, key, op FROM log")
def stream_dedup(spark, d):
    s = twins.events_stream(spark, d)
    return twins.drained(twins.deduplicated(s.unionByName(s)).select("event_id", "key", "op"))


# -- workloads and reports -------------------------------------------------
@query("SELECT i AS seq, 'key:' || (i % 97) AS key, 'GET' AS op FROM range(1000) t(i)")
def workload_scan(spark, d):
    return workloads.scan(spark, 1_000, 97)


@query()
def workload_uniform(spark, d):
    return workloads.uniform(spark, 5_000, 100)


@query()
def workload_zipf(spark, d):
    return workloads.zipf(spark, 5_000, 1_000)


@query()
def workload_mixed(spark, d):
    return workloads.mixed(spark, 5_000, 100)


@query("WITH w AS (SELECT i AS rank, pow(i, -1.07) AS w FROM range(1, 101) t(i)) SELECT rank, round(sum(w) OVER (ORDER BY rank) / sum(w) OVER (), 6) AS cdf FROM w")
def zipf_cdf(spark, d):
    return workloads.zipf_cdf(spark, 100).select("rank", F.round("cdf", 6).alias("cdf"))


@query(COMPARED + " SELECT policy, '| ' || policy || ' | ' || hits || ' | ' || evictions || ' | ' || printf('%.1f', hit_ratio * 100) || '% |' AS line FROM per")
def benchmark_report(spark, d):
    """A Markdown line for each policy."""
    r = policy_comparison(spark, d)
    line = F.format_string("| %s | %d | %d | %s |", "policy", "hits", "evictions", F.concat(F.format_string("%.1f", F.col("hit_ratio") * 100), F.lit("%")))
    return r.select("policy", line.alias("line"))


# -- topology views and reports ----------------------------------------------
@query(f"WITH {RING}, st AS (SELECT 'node-' || i AS node_id, ['HEALTHY', 'SUSPECT', 'DEAD', 'HEALTHY'][i] AS status FROM range(1, 5) t(i)) SELECT count(*) AS nodes, count(*) FILTER (status <> 'DEAD') AS routable, count(*) FILTER (status = 'HEALTHY') AS healthy, (SELECT CAST(round(count(*) / count(DISTINCT node_id)) AS BIGINT) FROM ring) AS virtual_nodes FROM st")
def cluster_view(spark, d):
    st = spark.range(1, 5).select(F.concat(F.lit("node-"), "id").alias("node_id"), F.element_at(F.array(*map(F.lit, ("HEALTHY", "SUSPECT", "DEAD", "HEALTHY"))), F.col("id").cast("int")).alias("status"))
    v = _ring(spark).agg(F.round(F.count("*") / F.countDistinct("node_id")).cast("long").alias("virtual_nodes"))
    counts = st.agg(F.count("*").alias("nodes"), F.count_if(F.col("status") != "DEAD").alias("routable"), F.count_if(F.col("status") == "HEALTHY").alias("healthy"))
    return counts.crossJoin(v)  # one row each


@query(f"WITH {SNAP}, n AS (SELECT 'node-' || i AS node FROM range(1, 5) t(i)) SELECT node, hits, misses, p99 FROM n LEFT JOIN snaps USING (node)")
def node_metrics(spark, d):
    """Every node with its snapshot, null where it didn't report."""
    n = spark.range(1, 5).select(F.concat(F.lit("node-"), "id").alias("node"))
    return n.join(_snapshots(spark, d).select("node", "hits", "misses", "p99"), "node", "left")


@query("SELECT code, status FROM (VALUES ('KEY_NOT_FOUND', 404), ('VALIDATION_ERROR', 400), ('NODE_UNAVAILABLE', 503), ('NO_HEALTHY_NODES', 503), ('CAPACITY_EXCEEDED', 507), ('OTHER', 500)) t(code, status)")
def error_status(spark, d):
    codes = ["KEY_NOT_FOUND", "VALIDATION_ERROR", "NODE_UNAVAILABLE", "NO_HEALTHY_NODES", "CAPACITY_EXCEEDED", "OTHER"]
    return spark.range(1).select(F.explode(F.array(*map(F.lit, codes))).alias("code")).select("code", src.status_of(F.col("code")).alias("status"))


@query(f"WITH {S.STATE} SELECT {STATE_COLS} FROM state")
def export_entries(spark, d):
    """The entries as JSON lines in a folder, and what an import reads from there."""
    folder, entries = scratch_path(spark, "export"), state.final_state(_log(spark, d))
    entries.write.option("compression", "gzip").json(folder)
    return spark.read.schema(entries.schema).json(folder)


@query(f"WITH {S.LOG} SELECT event_id, key, op FROM log WHERE event_id % 100 >= 10")
def imported_ops(spark, d):
    """JSON lines, of which a tenth is malformed, read permissively; the malformed ones go."""
    log = _log(spark, d)
    raw = log.select(F.when(F.col("event_id") % 100 < 10, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "key", "op"))).alias("line"))
    got = raw.select(F.from_json("line", "event_id long, key string, op string", {"mode": "PERMISSIVE"}).alias("r")).where("r.event_id is not null")
    return got.select("r.*")


@query(f"WITH {SIG.removeprefix('WITH ')}, dec AS ({DECIDED}), act AS (SELECT *, coalesce(lag(policy) OVER (ORDER BY tick), 'LRU') AS f FROM dec WHERE samples >= 200) SELECT tick, policy AS \"to\" FROM act WHERE policy <> f ORDER BY tick DESC LIMIT 200")
def switch_history(spark, d):
    """The newest 200 switches."""
    return metrics.last_n(signals.switches(_decisions(spark, d)), "tick", 200).select("tick", "to")


@query(f"WITH {SIG.removeprefix('WITH ')}, dec AS ({DECIDED}), act AS (SELECT *, coalesce(lag(policy) OVER (ORDER BY tick), 'LRU') AS f FROM dec WHERE samples >= 200), sw AS (SELECT tick, f, policy FROM act WHERE policy <> f) SELECT coalesce((SELECT arg_max(policy, tick) FROM sw), 'LRU') AS current_policy, true AS auto_switch, signals.*, (SELECT count(*) FROM sw) AS switches, (SELECT '[' || coalesce(string_agg('{{\"tick\":' || tick || ',\"from\":\"' || f || '\",\"to\":\"' || policy || '\"}}', ',' ORDER BY tick), '') || ']' FROM sw) AS history FROM signals ORDER BY tick DESC LIMIT 1")
def eviction_detail(spark, d):
    """The policy in force, the last signals and the newest 200 switches, in one row."""
    return signals.detail(_signals(spark, d), signals.switches(_decisions(spark, d)))


@query(f"WITH {S.REPLAY}, {RING}, {S.KEYS}, {S.replicas(2)}, alive AS (SELECT r.key, op, hit, CASE WHEN nodes[1] = 'node-2' THEN nodes[2] ELSE nodes[1] END AS target, nodes[1] = 'node-2' AS moved FROM replayed r JOIN reps USING (key)) SELECT target, count(*) AS ops, count(*) FILTER (moved) AS failed_over, count(*) FILTER (hit) AS hits FROM alive GROUP BY target")
def routed_ops(spark, d):
    """Operations by the node that takes them while node-2 is dead."""
    to = ring.route(ring.replicas(_keys(spark, d), _ring(spark), 2), ["node-2"])
    return _replay(spark, d).join(to, "key").groupBy("target").agg(F.count("*").alias("ops"), F.count_if("failed_over").alias("failed_over"), F.count_if("hit").alias("hits"))


@query(f"WITH {S.LOG} SELECT key, count(*) FILTER (op = 'GET') AS reads, count(*) FILTER (op = 'PUT') AS writes FROM log GROUP BY key")
def stream_key_counters(spark, d):
    return twins.drained(twins.key_counters(twins.events_stream(spark, d)), "key")


@query(f"WITH {S.REPLAY} SELECT key, count(*) FILTER (hit) AS hits, count(*) FILTER (miss) AS misses, count(*) FILTER (expired) AS expirations FROM replayed GROUP BY key")
def stream_cache_reads(spark, d):
    """The stateful stream's counts, summed over its micro-batches."""
    got = twins.drained(twins.cache_reads(twins.events_stream(spark, d)))
    return got.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("hits", "misses", "expirations")))


@query(f"WITH {S.LOG}, p AS (SELECT event_id, ts FROM log WHERE op = 'PUT') SELECT event_id FROM p WHERE event_id % 3 <> 0 AND ts <= (SELECT max(ts) FROM p)")
def stream_ack_join(spark, d):
    """Writes whose acknowledgement came within the timeout; a third never gets one."""
    s = twins.events_stream(spark, d).where("op = 'PUT'").select("event_id", "at")
    a = twins.events_stream(spark, d).where("op = 'PUT' and event_id % 3 <> 0").select(F.col("event_id").alias("ack_id"), (F.col("at") + F.expr("INTERVAL 1 SECOND")).alias("ack_at"))
    return twins.drained(twins.acknowledged(s, a)).where("ack_id is not null").select("event_id")


@query(f"WITH {SNAP} SELECT count(*) AS nodes, '[' || string_agg('{{\"node\":\"' || node || '\",\"hits\":' || hits || '}}', ',' ORDER BY node) || ']' AS report FROM snaps")
def json_report(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("node", "hits")))  # a row a node
    return _snapshots(spark, d).agg(F.count("*").alias("nodes"), F.to_json(rows).alias("report"))


@query("SELECT item_id AS seed, 'payload-' || item_id AS payload FROM benchmark")
def synthetic_values(spark, d):
    """Values of a seed, as structs that serialise the same way each time."""
    v = F.struct(F.col("item_id").alias("seed"), F.concat(F.lit("payload-"), "item_id").alias("payload"))
    return src.table(spark, d, "benchmark").select(v.alias("v")).select("v.*")
