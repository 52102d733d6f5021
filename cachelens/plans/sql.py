"""SQL of the queries, for an engine that runs the same tables: common table expressions that queries share."""

from __future__ import annotations

DAY = 86_400_000

LOG = """log AS (SELECT event_id, epoch_us(ts) // 1000 AS ts, 'user:' || user_id AS key,
 CASE WHEN event_type IN ('view','click') THEN 'GET' WHEN event_type IN ('signup','purchase') THEN 'PUT' ELSE 'DELETE' END AS op,
 CASE WHEN event_type = 'purchase' THEN 86400000 END AS ttl, strlen(props) AS size_bytes, value AS latency_ms, props AS value FROM events)"""

REPLAY = (
    LOG
    + """, r0 AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN {'id': event_id, 'op': op, 'exp': ts + ttl} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM log),
r1 AS (SELECT *, coalesce(op = 'GET' AND m.op = 'PUT' AND (m.exp IS NULL OR m.exp > ts), false) AS hit, coalesce(op = 'GET' AND m.op = 'PUT' AND m.exp <= ts, false) AS late FROM r0),
r2 AS (SELECT *, late AND row_number() OVER (PARTITION BY key, m.id, late ORDER BY event_id) = 1 AS expired FROM r1),
r3 AS (SELECT *, coalesce(sum(CASE WHEN op = 'DELETE' OR expired THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM r2),
r4 AS (SELECT *, sum(CASE WHEN op = 'PUT' THEN 1 ELSE 0 END) OVER s AS version, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER s AS frequency, min(CASE WHEN op = 'PUT' THEN ts END) OVER s AS created_at, max(CASE WHEN hit THEN ts END) OVER s AS accessed_at,
 last_value(CASE WHEN op = 'PUT' THEN {'at': ts, 'exp': ts + ttl, 'value': value, 'size': size_bytes} END IGNORE NULLS) OVER s AS p
 FROM r3 WINDOW s AS (PARTITION BY key, seg ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
replayed AS (SELECT *, op = 'GET' AND NOT hit AS miss, op = 'DELETE' AND version > 0 AS deleted FROM r4)"""
)

# the last row of a key decides, whatever it is
STATE = (
    REPLAY
    + """, ends AS (SELECT * FROM replayed QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1),
state AS (SELECT key, p.value AS value, version, created_at, p.at AS updated_at, coalesce(accessed_at, created_at) AS last_accessed_at, frequency, p.exp AS expires_at, p.size AS size_bytes FROM ends WHERE op <> 'DELETE' AND NOT expired AND version > 0)"""
)


def fnv(x: str, seed: int = 0) -> str:
    return f"list_reduce(list_prepend({2166136261 ^ seed}::HUGEINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


def hashed(name: str, source: str) -> str:
    """CTEs that add h, the ring hash of column x, to a source."""
    djb = "list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(x, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 33 + c) % 4294967296)"
    return f"""{name}_0 AS (SELECT *, xor({fnv('x')}, ({djb} * 2654435761) % 4294967296) AS h0 FROM ({source})),
{name}_1 AS (SELECT *, (xor(h0, h0 // 32768) * 2246822507) % 4294967296 AS h1 FROM {name}_0),
{name} AS (SELECT * EXCLUDE (h0, h1), xor(h1, h1 // 8192)::BIGINT AS h FROM {name}_1)"""


def ring(name: str, nodes: str) -> str:
    """CTE of the points (node_id, idx, h) of nodes: node_id, n."""
    return hashed(name, f"SELECT node_id, i AS idx, node_id || '#' || i AS x FROM (SELECT node_id, unnest(range(n)) AS i FROM ({nodes}))")


NODES3 = "SELECT 'node-' || i AS node_id, 128 AS n FROM range(1, 4) t(i)"
NODES4 = "SELECT 'node-' || i AS node_id, 128 AS n FROM range(1, 5) t(i)"
KEYS = hashed("k", "SELECT DISTINCT 'user:' || user_id AS key, 'user:' || user_id AS x FROM events")


def owner(name: str, ring_name: str, keys: str = "k") -> str:
    return f"{name} AS (SELECT key, k.h AS kh, coalesce(p.node_id, (SELECT node_id FROM {ring_name} ORDER BY h, node_id LIMIT 1)) AS owner FROM {keys} k ASOF LEFT JOIN {ring_name} p ON k.h <= p.h)"


def replicas(n: int, ring_name: str = "ring") -> str:
    return f"""near AS (SELECT k.key, p.node_id, min((p.h - k.h + 4294967296) % 4294967296) AS d FROM k CROSS JOIN {ring_name} p GROUP BY ALL),
reps AS (SELECT key, list(node_id ORDER BY d, node_id)[1:{n}] AS nodes FROM near GROUP BY key)"""


SAMPLES = (
    REPLAY
    + """, samples AS (SELECT *, ts // 86400000 AS tick, row_number() OVER (ORDER BY event_id) AS seq FROM replayed WHERE op <> 'DELETE'),
ends_t AS (SELECT tick, max(seq) AS e FROM samples GROUP BY tick),
hist AS (SELECT e.tick, s.key, count(*) AS n FROM samples s JOIN ends_t e ON s.seq <= e.e AND s.seq > e.e - 2000 GROUP BY ALL)"""
)
SIGNALS = (
    SAMPLES
    + """, ranked AS (SELECT tick, n, row_number() OVER (PARTITION BY tick ORDER BY n) AS i, count(*) OVER (PARTITION BY tick) AS c FROM hist),
skews AS (SELECT tick, greatest(0, least(1, 2 * sum(i * n) / (max(c) * sum(n)) - (max(c) + 1) / max(c))) AS skew, max(c) / sum(n) AS working_set FROM ranked GROUP BY tick),
nums AS (SELECT tick, seq, abs(num - lag(num) OVER (ORDER BY seq)) AS step FROM (SELECT tick, seq, CAST(regexp_extract(key, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS num FROM samples)),
seqs AS (SELECT tick, count(*) FILTER (step = 1) / count(*) AS sequential FROM nums GROUP BY tick),
base AS (SELECT tick, max(seq) AS samples, count(*) FILTER (op = 'GET') AS reads, coalesce(count(*) FILTER (hit) / nullif(count(*) FILTER (op = 'GET'), 0), 0) AS hit_rate, count(*) FILTER (op = 'PUT') / count(*) AS write_ratio FROM samples GROUP BY tick),
turns AS (SELECT *, row_number() OVER (ORDER BY tick) AS i, CASE WHEN reads > 0 OR row_number() OVER (ORDER BY tick) = 1 THEN hit_rate END AS fed FROM base),
fedn AS (SELECT *, count(fed) OVER (ORDER BY tick) AS j FROM turns),
emah AS (SELECT a.tick, sum(b.fed * CASE WHEN b.j = 1 THEN pow(0.75, a.j - 1) ELSE 0.25 * pow(0.75, a.j - b.j) END) AS hit_rate_ema FROM fedn a JOIN fedn b ON b.fed IS NOT NULL AND b.j <= a.j GROUP BY a.tick),
emaw AS (SELECT a.tick, sum(b.write_ratio * CASE WHEN b.i = 1 THEN pow(0.75, a.i - 1) ELSE 0.25 * pow(0.75, a.i - b.i) END) AS write_ratio_ema FROM turns a JOIN turns b ON b.i <= a.i GROUP BY a.tick),
emas AS (SELECT * FROM emah JOIN emaw USING (tick)),
signals AS (SELECT tick, samples, round(hit_rate, 6) AS hit_rate, round(write_ratio, 6) AS write_ratio, round(hit_rate_ema, 6) AS hit_rate_ema, round(write_ratio_ema, 6) AS write_ratio_ema, round(skew, 6) AS skew, round(working_set, 6) AS working_set, round(coalesce(sequential, 0), 6) AS sequential
 FROM base JOIN emas USING (tick) JOIN skews USING (tick) LEFT JOIN seqs USING (tick))"""
)


def simulated(policies: str, max_entries: int = 1 << 62, max_bytes: int = 1 << 62) -> str:
    """CTEs up to `simulated`: counters of capped stores by node and policy, by a step for each operation.

    A store is a list of entries; since is the step that set an entry's place among equals. uses counts every
    touch of a key that ever came: what the sketch says, unless keys meet in all of its rows. No single
    value is taken to be larger than max_bytes.
    """
    entry = "{'k': key, 'exp': %s, 'size': %s, 'used': coalesce(e.used, 0) + 1, 'since': CASE WHEN policy = 'FIFO' THEN coalesce(e.since, i) ELSE i END}"
    return f"""ops AS MATERIALIZED (SELECT owner AS node, row_number() OVER (PARTITION BY owner ORDER BY event_id) AS i, key, op, ts, ttl, size_bytes::BIGINT AS size FROM log JOIN own USING (key)),
run(node, policy, i, es, uses, hits, misses, expirations, evictions, writes, deletes, peak) AS (
 SELECT node, policy, 0::BIGINT, []::STRUCT(k VARCHAR, exp BIGINT, size BIGINT, used BIGINT, since BIGINT)[], []::STRUCT(k VARCHAR, c BIGINT)[], 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT node FROM ops), unnest([{policies}]) t(policy)
 UNION ALL
 SELECT node, policy, i, list_filter(es1, lambda x: NOT list_contains(gone, x.k)), uses1, hits + hit::INT, misses + (op = 'GET' AND NOT hit)::INT, expirations + dead::INT, evictions + len(gone), writes + (op = 'PUT')::INT, deletes + (op = 'DELETE' AND e IS NOT NULL)::INT, greatest(peak, len(es1) - len(gone))
 FROM (SELECT *, list_transform(line[1:least(need, (len(es1) + 2) // 2)], lambda x: x.k) AS gone
  FROM (SELECT *, CASE WHEN op <> 'PUT' THEN 0 ELSE greatest(len(es1) - {max_entries}, len(list_filter(range(len(line) + 1), lambda m: list_sum(list_transform(es1, lambda x: x.size)) - coalesce(list_sum(list_transform(line[1:m], lambda x: x.size)), 0) > {max_bytes})), 0) END AS need
   FROM (SELECT *, list_transform(list_sort(list_transform(low, lambda x: {{'a': CASE policy WHEN 'LFU' THEN x.used WHEN 'TINY_LFU' THEN list_filter(uses1, lambda u: u.k = x.k)[1].c ELSE 0 END, 'b': x.since, 'x': x}})), lambda s: s.x) AS line
    FROM (SELECT *, CASE WHEN policy = 'TINY_LFU' THEN list_transform(list_sort(list_transform(list_filter(es1, lambda x: x.k <> key), lambda x: {{'b': x.since, 'x': x}}))[1:5], lambda s: s.x) ELSE list_filter(es1, lambda x: x.k <> key) END AS low
      FROM (SELECT *, CASE WHEN op = 'PUT' OR hit THEN list_append(list_filter(es, lambda x: x.k <> key), CASE WHEN hit THEN {entry % ("e.exp", "e.size")} ELSE {entry % ("ts + ttl", "size")} END) WHEN op = 'DELETE' OR dead THEN list_filter(es, lambda x: x.k <> key) ELSE es END AS es1,
        CASE WHEN policy = 'TINY_LFU' AND (op = 'PUT' OR hit) THEN list_append(list_filter(uses, lambda u: u.k <> key), {{'k': key, 'c': coalesce(list_filter(uses, lambda u: u.k = key)[1].c, 0) + 1}}) ELSE uses END AS uses1
       FROM (SELECT *, op = 'GET' AND e IS NOT NULL AND NOT dead AS hit FROM (SELECT *, op = 'GET' AND coalesce(e.exp <= ts, false) AS dead
        FROM (SELECT r.* EXCLUDE (i), o.* EXCLUDE (node), list_filter(es, lambda x: x.k = o.key)[1] AS e FROM run r JOIN ops o ON o.node = r.node AND o.i = r.i + 1))))))))),
simulated AS (SELECT node, policy, hits, misses, expirations, evictions, writes, deletes, len(es)::BIGINT AS entries, coalesce(list_sum(list_transform(es, lambda x: x.size)), 0)::BIGINT AS bytes, round(coalesce(hits / nullif(hits + misses, 0), 0), 6) AS hit_ratio, peak AS peak_entries FROM run QUALIFY row_number() OVER (PARTITION BY node, policy ORDER BY i DESC) = 1)"""
