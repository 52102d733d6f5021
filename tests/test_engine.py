"""Assertions on small literal inputs, and agreement between independent ways to one result."""

import random

import pytest
from pyspark.sql import functions as F

from cachelens.functions import text
from cachelens.functions.hashing import fnv1a, ring_hash
from cachelens.operators import health, metrics, replication, ring, signals, simulate, sketch, state
from cachelens.sources import log as src
from cachelens.sources import snapshots, workloads
from cachelens.streaming import twins

LOG = "event_id long, ts long, key string, op string, ttl long, size_bytes long, latency_ms double, value string"


def log_of(spark, rows):
    return spark.createDataFrame([(i, ts, k, op, ttl, 10, 1.0, f"v{i}") for i, (ts, k, op, ttl) in enumerate(rows)], LOG)


def random_rows(n=600, keys=12, seed=3):
    r = random.Random(seed)
    return [(i * 10, f"key:{r.randrange(keys)}", r.choice(("GET", "GET", "PUT", "DELETE")), r.choice((None, None, 50, 200))) for i in range(n)]


# -- state -----------------------------------------------------------------
def test_expiry_boundary_is_inclusive(spark):
    rows = [(0, "a", "PUT", 100), (99, "a", "GET", None), (100, "a", "GET", None), (150, "a", "GET", None), (160, "a", "PUT", None), (999_999, "a", "GET", None)]
    got = state.replay(log_of(spark, rows)).orderBy("event_id").collect()
    assert [r["hit"] for r in got] == [False, True, False, False, False, True]
    assert [r["expired"] for r in got] == [False, False, True, False, False, False]
    assert got[4]["version"] == 1 and got[5]["frequency"] == 1


def test_overwrite_bumps_the_version_and_keeps_creation(spark):
    rows = [(0, "a", "PUT", None), (5, "a", "GET", None), (10, "a", "PUT", None)]
    s = state.final_state(log_of(spark, rows)).first()
    assert (s["version"], s["created_at"], s["updated_at"], s["last_accessed_at"], s["frequency"], s["value"]) == (2, 0, 10, 5, 1, "v2")


def test_delete_of_nothing_is_not_a_delete(spark):
    rows = [(0, "a", "DELETE", None), (1, "a", "PUT", None), (2, "a", "DELETE", None), (3, "a", "DELETE", None)]
    assert [r["deleted"] for r in state.replay(log_of(spark, rows)).orderBy("event_id").collect()] == [False, False, True, False]


def test_windows_agree_with_the_simulator(spark):
    for seed in (1, 2):
        rows = random_rows(seed=seed)
        c = state.counters(state.replay(log_of(spark, rows))).first()
        s = simulate.Store(simulate.Lru())
        simulate.run(s, [(ts, k, op, ttl, 10) for ts, k, op, ttl in rows])
        assert (c["hits"], c["misses"], c["expirations"], c["deletes"], c["writes"]) == (s.hits, s.misses, s.expirations, s.deletes, s.writes)
        end = {r["key"]: r["expires_at"] for r in state.final_state(log_of(spark, rows)).collect()}
        assert end == {k: e[0] for k, e in s.data.items()}


def test_empty_log(spark):
    e = log_of(spark, [(0, "a", "GET", None)]).limit(0)
    assert state.final_state(e).count() == 0 and state.counters(state.replay(e)).first()["hit_ratio"] == 0


# -- policies --------------------------------------------------------------
def fill(policy, ops, cap):
    s = simulate.Store(policy, max_entries=cap)
    for i, (op, k) in enumerate(ops):
        s.put(k, i, None, 10) if op == "W" else s.get(k, i)
    return set(s.data)


def test_lru_victim():
    assert fill(simulate.Lru(), [("W", "a"), ("W", "b"), ("W", "c"), ("R", "a"), ("W", "d")], 3) == {"a", "c", "d"}


def test_lfu_victim_and_tie():
    p = simulate.Lfu()
    for k in "abc":
        p.wrote(k)
    for k in "aac":
        p.read(k)
    assert p.victim(None) == "b"
    q = simulate.Lfu()
    for k in "xy":
        q.wrote(k)
    q.read("y"), q.read("x")
    assert q.victim(None) == "y"


def test_tinylfu_resists_a_scan():
    p = simulate.TinyLfu()
    for _ in range(21):
        p.wrote("hot")
    for i in range(4):
        p.wrote(f"once{i}")
    assert p.victim(None) != "hot"
    t = simulate.TinyLfu(aging=10)
    for _ in range(10):
        t.wrote("k")
    assert t.estimate("k") == 5


def test_fifo_and_single_entry():
    assert fill(simulate.Fifo(), [("W", "a"), ("W", "b"), ("W", "a"), ("W", "c")], 2) == {"b", "c"}
    s = simulate.Store(simulate.Lru(), max_bytes=100)
    for i in range(9):
        s.put(f"k{i}", i, None, 10)
    s.put("big", 10, None, 1000)
    assert "big" in s.data and s.evictions == 6  # of 10 entries: each removal also lowers the bound of the loop
    t = simulate.Store(simulate.Lru(), max_bytes=10)
    t.put("big", 0, None, 1000)
    assert not t.data


def test_caps_hold_under_stress():
    for name, p in simulate.POLICIES.items():
        s, r = simulate.Store(p(), max_entries=50, max_bytes=2_000), random.Random(1)
        for i in range(3_000):
            s.put(f"k{r.randrange(400)}", i, r.choice((None, 5)), r.randrange(1, 60))
            s.get(f"k{r.randrange(400)}", i)
            if i % 200 == 0:
                s.switch(simulate.POLICIES[r.choice(list(simulate.POLICIES))]())
            assert len(s.data) <= 50 and s.bytes <= 2_000, name
            assert s.bytes == sum(e[1] for e in s.data.values())


def test_read_through_lru_equals_a_dictionary(spark):
    from collections import OrderedDict

    rows = random_rows(400, 15)
    log = log_of(spark, rows).withColumn("node", F.lit("n"))
    cache, hits = OrderedDict(), 0
    for _, k, _, _ in rows:
        if k in cache:
            hits += 1
            cache.move_to_end(k)
        else:
            cache[k] = 1
            if len(cache) > 5:
                cache.popitem(last=False)
    assert simulate.lru_read_through(log, 5).first()["hits"] == hits


def test_simulate_by_node_and_policy(spark):
    log = log_of(spark, random_rows()).withColumn("node", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    got = simulate.simulate(log, list(simulate.POLICIES), max_entries=4).collect()
    assert len(got) == 8 and all(r["peak_entries"] <= 4 and r["evictions"] > 0 for r in got)


# -- hashing and ring ------------------------------------------------------
GOLDEN = {"key:0": (3699267901, [1558, 241, 1204, 399]), "user:123": (3743158375, [472, 89, 878, 1815]), "node-1#0": (2947474702, [880, 1929, 190, 703]), "node-3#127": (2191505207, [1406, 1167, 920, 1481])}


def test_golden_hashes(spark):
    df = spark.createDataFrame([(k,) for k in [*GOLDEN, ""]], "k string")
    got = {r["k"]: r for r in df.select("k", ring_hash(F.col("k")).alias("h"), sketch.cells(F.col("k")).alias("c"), fnv1a(F.col("k")).alias("f")).collect()}
    assert all((got[k]["h"], got[k]["c"]) == v for k, v in GOLDEN.items())
    assert got[""]["f"] == 2166136261


def ring3(spark, raw=src.STATIC_NODES):
    return ring.points(src.nodes(spark, raw))


def test_owner_is_the_next_point(spark):
    keys = spark.range(500).select(F.concat(F.lit("key:"), "id").alias("key"))
    pts = sorted((r["hash"], r["node_id"]) for r in ring3(spark).collect())
    h = {r["key"]: r["h"] for r in keys.withColumn("h", ring_hash(F.col("key"))).collect()}
    for r in ring.owners(keys, ring3(spark)).collect():
        assert r["owner"] == next((n for x, n in pts if x >= h[r["key"]]), pts[0][1])
    for r in ring.replicas(keys, ring3(spark), 2).collect():
        after = [n for x, n in pts if x >= h[r["key"]]] + [n for _, n in pts]
        assert r["nodes"] == list(dict.fromkeys(after))[:2]


def test_rebalance_and_weights(spark):
    keys = spark.range(5_000).select(F.concat(F.lit("key:"), "id").alias("key"))
    four = ring3(spark, src.STATIC_NODES + ",node-4:cache-4:7004:1")
    m = ring.movement(keys, ring3(spark), four).first()
    assert 0 < m["ratio"] < 0.5 and m["expected"] == 0.25
    moved = ring.owners(ring.owners(keys, ring3(spark), "a"), four, "b").where("a <> b and b <> 'node-4'").count()
    assert moved == 0
    heavy = {r["owner"]: r["count"] for r in ring.owners(keys, ring3(spark, "a:h:1:1,b:h:2:3")).groupBy("owner").count().collect()}
    assert heavy["b"] > 2 * heavy["a"]


def test_failover_skips_the_dead(spark):
    keys = spark.range(50).select(F.concat(F.lit("key:"), "id").alias("key"))
    r3 = ring.replicas(keys, ring3(spark), 3)
    assert ring.route(r3, ["node-1", "node-2"]).where("target <> 'node-3'").count() == 0
    assert ring.route(r3, ["node-1", "node-2", "node-3"]).where("target is not null").count() == 0


# -- metrics and signals ---------------------------------------------------
def test_nearest_rank_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    assert tuple(df.agg(*metrics.percentiles("x")).first()) == (50, 95, 99, 100)
    assert tuple(df.limit(0).agg(*metrics.percentiles("x")).first()) == (0, 0, 0, 0)


def test_cluster_ratio_is_of_sums(spark):
    df = spark.createDataFrame([("a", 90, 10, 1, 1.0, 5.0), ("b", 10, 90, 1, 1.0, 40.0)], "node string, hits long, misses long, memory long, rps double, p99 double")
    r = metrics.cluster_summary(df).first()
    assert r["hit_ratio"] == 0.5 and r["worst_p99"] == 40
    assert metrics.cluster_summary(df.limit(0)).first()["nodes"] == 0


def test_gini_and_ema(spark):
    r = spark.range(1).select(signals.gini(F.lit([1, 2, 3, 4])).alias("g"), signals.gini(F.lit([5, 5])).alias("e"), signals.gini(F.expr("cast(array() as array<int>)")).alias("n"), signals.ema(F.lit([0.8, 0.4, 0.6])).alias("m")).first()
    assert abs(r["g"] - 0.25) < 1e-9 and r["e"] == 0 and r["n"] == 0 and abs(r["m"] - 0.675) < 1e-9


@pytest.mark.parametrize(("s", "want"), [((0.9, 0.9, 0.9, 0.9, 0.9), ("TINY_LFU", 1)), ((0.5, 0.6, 0.9, 0.9, 0), ("LRU", 2)), ((0, 0, 0.7, 0.4, 0), ("LFU", 3)), ((0, 0, 0.2, 0.9, 0.6), ("LRU", 4)), ((0, 0, 0.5, 0.2, 0.5), ("TINY_LFU", 5))])
def test_decision_table(spark, s, want):
    mem, seq, reads, skew, writes = (F.lit(float(x)) for x in s)
    assert tuple(spark.range(1).select(*signals.decide(mem, seq, reads, skew, writes)).first()) == want


def test_switch_guards(spark):
    d = spark.createDataFrame([(1, 100, "LFU", 3), (2, 300, "LFU", 3), (3, 400, "LFU", 3), (4, 500, "LRU", 2)], "tick long, samples long, policy string, rule int")
    assert [(r["tick"], r["from"], r["to"]) for r in signals.switches(d, 10_000).collect()] == [(2, "LRU", "LFU"), (4, "LFU", "LRU")]
    assert [r["tick"] for r in signals.switches(d, 5_000).collect()] == [2]


def test_sketch_never_undercounts_and_ages(spark):
    keys = spark.createDataFrame([(f"key:{i}", i % 7 + 1) for i in range(300)], "key string, n long")
    e = sketch.estimates(keys, sketch.sketch(keys)).join(keys, "key")
    assert e.where("estimate < n").count() == 0
    hits = spark.range(1, 11).select(F.lit("k").alias("key"), F.col("id").alias("seq"))
    assert {r["count"] for r in sketch.aged(hits, 10).collect()} == {5}


# -- replication and health ------------------------------------------------
def test_merge_prefers_the_version(spark):
    rows = [(1, "n1", "a", "PUT", "old", 1), (2, "n1", "a", "PUT", "new", 3), (3, "n1", "a", "PUT", "late", 2), (4, "n1", "a", "PUT", "tie", 3)]
    df = spark.createDataFrame(rows, "event_id long, target string, key string, op string, value string, version long")
    assert replication.merge(df, "target").first()["value"] == "new"


def test_acks_time_out(spark):
    sent = spark.createDataFrame([(1, 0, "b"), (1, 0, "c"), (2, 0, "b")], "event_id long, ts long, target string")
    arrived = spark.createDataFrame([(1, "b", 10), (1, "c", 6_000), (2, "b", 5_000)], "event_id long, target string, applied_at long")
    got = {r["event_id"]: (r["wanted"], r["acked"], r["complete"]) for r in replication.acks(sent, arrived).collect()}
    assert got == {1: (2, 1, False), 2: (1, 1, True)}
    assert replication.pending_at(sent, arrived, F.lit(100).cast("long")).first()["pending"] == 2


def test_health_hysteresis(spark):
    ok = [True, False, False, False, False, False, True]
    df = spark.createDataFrame([("n", i, o) for i, o in enumerate(ok)], "node string, at long, ok boolean")
    assert [r["status"] for r in health.timeline(df).orderBy("at").collect()] == ["HEALTHY", "HEALTHY", "SUSPECT", "SUSPECT", "SUSPECT", "DEAD", "HEALTHY"]


# -- sources and sinks -----------------------------------------------------
def test_snapshots(spark, tmp_path):
    root = "file://" + str(tmp_path)
    s = state.final_state(log_of(spark, [(0, "a", "PUT", None), (1, "b", "PUT", 50)]))
    for i in range(3):
        snapshots.take(s, root, f"s{i}", "n1", i)
    assert [r["snapshot_id"] for r in snapshots.catalog(spark, root).collect()] == ["s2", "s1", "s0"]
    assert sorted(snapshots.restore(spark, root).collect()) == sorted(s.selectExpr(*snapshots.restore(spark, root).columns).collect())
    assert snapshots.prune(spark, root, 2) == ["s0"] and snapshots.catalog(spark, root).count() == 2
    part = next((tmp_path / "s2" / "entries").glob("part-*"))
    part.unlink()
    with pytest.raises(snapshots.SnapshotError):
        snapshots.restore(spark, root)
    for bad in ("../x", "", "a/b"):
        with pytest.raises(snapshots.SnapshotError):
            snapshots.check_id(bad)
    back = {r["key"]: r for r in snapshots.recovered(s, 1_000).collect()}
    assert back["a"]["expires_at"] is None and back["b"]["expires_at"] == 1_000 and back["b"]["version"] == 1


def test_text_forms(spark):
    df = spark.createDataFrame([(0.0,), (1023.0,), (1024.0,), (1536.0 * 1024,), (5e9,), (-1.0,), (float("inf"),)], "b double")
    assert [r[0] for r in df.select(text.format_bytes(F.col("b"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 MB", "4.7 GB", "∞", "∞"]
    r = spark.range(1).select(text.encode_component(F.lit("a b+c/é")), text.decode_component(F.lit("a%20b+c")), text.decode_component(F.lit("%zz"))).first()
    assert tuple(r) == ("a%20b%2Bc%2F%C3%A9", "a b+c", None)


def test_workloads(spark):
    z = {r["key"]: r["count"] for r in workloads.zipf(spark, 20_000, 1_000, skew=1.5).groupBy("key").count().collect()}
    assert sum(z.values()) == 20_000 and sum(z.get(f"key:{i}", 0) for i in range(10)) > 0.2 * 20_000
    assert [r["key"] for r in workloads.scan(spark, 7, 5).orderBy("seq").collect()] == [f"key:{i % 5}" for i in range(7)]
    u = workloads.uniform(spark, 10_000, 100).groupBy("op").count().collect()
    assert abs({r["op"]: r["count"] for r in u}["GET"] - 8_000) < 300
    assert workloads.mixed(spark, 2_000, 50).count() == 2_000
    with pytest.raises(ValueError):
        workloads.mixed(spark, 1, 1, ())
    c = [r["cdf"] for r in workloads.zipf_cdf(spark, 100).orderBy("rank").collect()]
    assert abs(c[0] - 0.221115) < 1e-6 and c[-1] == 1.0


def test_parse_and_validate(spark):
    got = spark.range(1).select(F.inline(src.parse_static_nodes(F.lit(" n1:h:7001:2 , n2:h:7002,")))).collect()
    assert [(r["node_id"], r["port"], r["weight"]) for r in got] == [("n1", 7001, 2.0), ("n2", 7002, 1.0)]


# -- streams ---------------------------------------------------------------
def test_stream_stream_join_times_out(spark, tmp_path):
    base = spark.range(6).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1_000).alias("at"))
    base.write.parquet(str(tmp_path / "sent"))
    base.where("event_id % 2 = 0").select(F.col("event_id").alias("ack_id"), (F.col("at") + F.expr("INTERVAL 1 SECOND")).alias("ack_at")).write.parquet(str(tmp_path / "acks"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    got = twins.drained(twins.acknowledged(read("sent"), read("acks")))
    rows = {r["event_id"]: r["ack_id"] for r in got.collect()}
    assert all(rows[k] == k for k in (0, 2, 4)) and all(v is None for k, v in rows.items() if k % 2)


# -- faults, bus, recovery, seeds ----------------------------------------------
def test_bus_keeps_order_and_drops_what_is_malformed(spark, tmp_path):
    from cachelens.sources import bus

    folder, state = str(tmp_path / "bus"), str(tmp_path / "state")
    df = spark.createDataFrame([(i, f"k{i % 3}", None if i % 2 else i) for i in range(12)], "event_id long, key string, v long")
    bus.publish(bus.message(df, "cache-events", "key", F.timestamp_millis(F.col("event_id"))), path=folder)
    bus.publish(spark.createDataFrame([("k1", "{broken", "cache-events"), ("k1", None, "cache-events"), ("k1", "[1]", "cache-events"), ("k1", '{"event_id": 99}', "other")], "key string, value string, topic string").withColumn("timestamp", F.current_timestamp()), path=folder)
    seen = []
    first = lambda b, n: seen.append(("first", sorted(r["event_id"] for r in bus.parsed(b, "event_id long, key string, v long").collect())))
    second = lambda b, n: seen.append(("second", b.count()))
    s = bus.subscribed(spark, ["cache-events"], path=folder)
    q = bus.handled(s, {"cache-events": [first, second]}, state).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [("first", list(range(12))), ("second", 15)]
    got = spark.read.schema(bus.ROW).json(folder).where("value like '%event_id%'")
    by = {}
    for r in bus.parsed(got.where("topic = 'cache-events'").withColumn("value", F.col("value")), "event_id long, key string").collect():
        by.setdefault(r["key"], []).append(r["event_id"])
    assert all(v == sorted(v) for v in by.values()) and len(by) == 3


def test_recovery_starts_empty_and_refuses_what_differs(spark, tmp_path):
    from cachelens.sources import snapshots

    root = str(tmp_path / "s")
    entries, report = snapshots.recover(spark, root, "n", 50)
    assert entries.count() == 0 and report.first()["integrity_verified"] and report.first()["snapshot_restored"] is None
    rows = [("a", "1", 3, 1, 1, 1, 5, None, 10), ("b", "2", 1, 1, 1, 1, 0, 40, 10)]
    df = spark.createDataFrame(rows, snapshots.ENTRY)
    snapshots.take(df, root, "s1", "n", 1)
    entries, report = snapshots.recover(spark, root, "n", 50)
    got = {r["key"]: (r["version"], r["frequency"], r["expires_at"]) for r in entries.collect()}
    assert got == {"a": (1, 0, None), "b": (1, 0, 50)} and report.first()["entries_restored"] == 2
    snapshots.assert_healthy(report)
    df.limit(1).coalesce(1).write.mode("overwrite").json(f"{root}/s1/entries")
    entries, report = snapshots.recover(spark, root, "n", 50)
    assert entries.count() == 0 and not report.first()["integrity_verified"] and len(report.first()["errors"]) == 1
    with pytest.raises(snapshots.SnapshotError):
        snapshots.assert_healthy(report)


def test_seeds_of_policies():
    from cachelens.operators import simulate

    entries = [("a", 50, 300), ("b", 1, 100), ("c", 40, 200)]
    seeded = {}
    for name, cls in simulate.POLICIES.items():
        seeded[name] = cls()
        seeded[name].seed(entries)
    assert [seeded[n].victim(None) for n in ("FIFO", "LRU", "LFU", "TINY_LFU")] == ["a", "b", "b", "b"]
    assert seeded["LFU"].uses == {"a": 50, "b": 1, "c": 40} and seeded["TINY_LFU"].estimate("a") == 32
    assert list(seeded["TINY_LFU"].order) == ["b", "c", "a"]


def test_sweeps_count_as_expirations_or_deletes():
    from cachelens.operators import simulate

    rows = [(0, "a", "PUT", 10, 1), (1, "b", "PUT", None, 1), (35, "c", "PUT", None, 1)]
    for name, want in (("expirations", (1, 0)), ("deletes", (0, 1))):
        got = dict(zip((c.split()[0] for c in simulate.COUNTS.split(", ")), simulate.run(simulate.Store(simulate.Lru()), rows, None, 30, name)))
        assert (got["expirations"], got["deletes"], got["entries"]) == (*want, 2)


def test_numbers_and_signals_do_not_depend_on_the_bucket(spark, small):
    from cachelens.operators import order, signals, state
    from cachelens.sources import log as src

    log = src.access_log(spark, small)
    got = order.numbered(log, bucket=64).select("event_id", "seq").collect()
    assert [r["seq"] for r in sorted(got)] == list(range(1, len(got) + 1))
    r = state.replay(log)
    assert sorted(signals.by_tick(r, bucket=50).collect()) == sorted(signals.by_tick(r).collect())


def test_means_feed_again_without_reads(spark):
    from cachelens.operators import signals

    df = spark.createDataFrame([([0.8, None, 0.4, 0.6],), ([None, 0.5],)], "x array<double>")
    assert [r[0] for r in df.select(F.round(signals.ema(F.col("x")), 6)).collect()] == [0.675, 0.125]
    write_only = spark.createDataFrame([(1, 0, "k1", "PUT", False), (2, 0, "k1", "GET", True), (3, 10, "k2", "PUT", False), (4, 20, "k3", "GET", True)], "event_id long, ts long, key string, op string, hit boolean")
    got = signals.by_tick(write_only, 10).orderBy("tick").collect()
    assert [r["hit_rate_ema"] for r in got] == [1.0, 1.0, 1.0] and got[1]["write_ratio_ema"] == 0.625


def test_nearest_ranks(spark):
    import math
    import random

    from cachelens.operators import order

    r = random.Random(1)
    rows = [("a", float(r.choice((1, 2, 3, 1000)))) for _ in range(501)] + [("b", r.lognormvariate(0, 5)) for _ in range(777)] + [("c", 4.0)] + [("d", None)]
    got = {x["g"]: x for x in order.nearest_ranks(spark.createDataFrame(rows, "g string, x double"), "g", "x", {"p50": 0.5, "p99": 0.99}, 16).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        assert [got[g][n] for n in ("p50", "p99", "max")] == [v[math.ceil(p * len(v)) - 1] for p in (0.5, 0.99)] + [v[-1]]
    assert set(got) == set("abc")


def test_ring_lists_equal_brute_force(spark):
    from cachelens.operators import ring

    nodes = spark.createDataFrame([(f"n{i}", 1.0 if i else 40.0) for i in range(5)], "node_id string, weight double")
    points = ring.points(nodes, 4)
    pts = sorted((r["hash"], r["node_id"]) for r in points.collect())
    keys = spark.range(200).select(F.concat(F.lit("key:"), "id").alias("key"))
    from cachelens.functions.hashing import ring_hash

    hashes = {r["key"]: r["h"] for r in keys.select("key", ring_hash(F.col("key")).alias("h")).collect()}
    for r in ring.replicas(keys, points, 3).collect():
        around = [n for h, n in pts if h >= hashes[r["key"]]] + [n for h, n in pts]
        assert r["nodes"] == list(dict.fromkeys(around))[:3]


def test_late_rows_leave_the_ticks(spark, tmp_path):
    import time as clock

    from cachelens.streaming import twins

    folder = str(tmp_path / "in")
    hour = 3_600_000
    for i, part in enumerate(([(0, "GET"), (30 * hour, "GET")], [(31 * hour, "PUT")], [(1, "GET"), (32 * hour, "PUT")])):  # the last batch's first row is a day late
        spark.createDataFrame(part, "ts long, op string").coalesce(1).write.mode("append").parquet(folder)
        clock.sleep(1.1)
    s = spark.readStream.schema("ts long, op string").option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", F.timestamp_millis("ts"))
    got = {r["tick"]: (r["n"], r["reads"]) for r in twins.drained(twins.ticks(s), "tick").collect()}
    assert got == {0: (1, 1), 24 * hour: (3, 1)}
