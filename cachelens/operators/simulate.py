"""Capacity-bounded cache simulation with exchangeable eviction policies.

Which entry falls out depends on all operations before, so a node's log is replayed
in order within one group; nodes, policies and capacities run side by side.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable

BOTTOM, SEED_CAP = 5, 32


class Fifo:
    """The oldest inserted entry goes; overwriting keeps its place."""

    name = "FIFO"

    def __init__(self):
        self.order: OrderedDict[str, None] = OrderedDict()

    def wrote(self, key):
        self.order.setdefault(key)

    def read(self, key):
        pass

    def removed(self, key):
        self.order.pop(key, None)

    def victim(self, spared):
        return next((k for k in self.order if k != spared), None)

    def seed(self, entries):
        """Takes over entries (key, uses, last access) in the order of the store."""
        for k, _, _ in entries:
            self.wrote(k)


class Lru(Fifo):
    """The longest untouched entry goes."""

    name = "LRU"

    def wrote(self, key):
        self.order[key] = None
        self.order.move_to_end(key)

    read = wrote

    def seed(self, entries):
        for k, _, _ in sorted(entries, key=lambda e: e[2]):
            Lru.wrote(self, k)


class Lfu:
    """The least used entry goes; among equals the one that reached its count first."""

    name = "LFU"

    def __init__(self):
        self.uses: dict[str, int] = {}
        self.levels: dict[int, OrderedDict[str, None]] = {}

    def wrote(self, key):
        n = self.uses.get(key, 0)
        self._leave(key, n)
        self.uses[key] = n + 1
        self.levels.setdefault(n + 1, OrderedDict())[key] = None

    read = wrote

    def seed(self, entries):
        for k, uses, _ in entries:  # the whole count, in the order of the store
            self.uses[k] = max(1, uses)
            self.levels.setdefault(self.uses[k], OrderedDict())[k] = None

    def _leave(self, key, n):
        if n and key in self.levels.get(n, ()):
            del self.levels[n][key]
            if not self.levels[n]:
                del self.levels[n]

    def removed(self, key):
        self._leave(key, self.uses.pop(key, 0))

    def victim(self, spared):
        for n in sorted(self.levels):
            for k in self.levels[n]:
                if k != spared:
                    return k
        return None


class TinyLfu(Lru):
    """Of the few longest untouched entries the one with the least sketched use goes."""

    name = "TINY_LFU"

    def __init__(self, width=2_048, depth=4, aging=50_000):
        super().__init__()
        self.width, self.depth, self.aging, self.added = width, depth, aging, 0
        self.table = [[0] * width for _ in range(depth)]
        self.places: dict[str, list[int]] = {}

    def _cells(self, key):
        got = self.places.get(key)
        if got is None:
            got = []
            for row in range(self.depth):
                h = 2166136261 ^ row
                for c in key:
                    h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
                got.append(h % self.width)
            self.places[key] = got
        return got

    def wrote(self, key):
        super().wrote(key)
        self._count(key)

    def _count(self, key):
        for row, c in zip(self.table, self._cells(key), strict=True):
            row[c] = min(65_535, row[c] + 1)
        self.added += 1
        if self.added >= self.aging:
            self.table, self.added = [[v >> 1 for v in row] for row in self.table], 0

    read = wrote

    def seed(self, entries):
        super().seed(entries)
        for k, uses, _ in entries:
            for _ in range(min(max(1, uses), SEED_CAP)):
                self._count(k)

    def estimate(self, key):
        return min(row[c] for row, c in zip(self.table, self._cells(key), strict=True))

    def victim(self, spared):
        low = []
        for k in self.order:
            if k != spared:
                low.append(k)
                if len(low) == BOTTOM:
                    break
        return min(low, key=self.estimate, default=None)


POLICIES = {p.name: p for p in (Fifo, Lru, Lfu, TinyLfu)}


class Store:
    """A node's entries under an entry and a byte cap; every counter of the node."""

    def __init__(self, policy, max_entries=None, max_bytes=None):
        self.policy, self.max_entries, self.max_bytes = policy, max_entries or float("inf"), max_bytes or float("inf")
        self.data: dict[str, list] = {}
        self.bytes = self.hits = self.misses = self.expirations = self.evictions = self.writes = self.deletes = 0

    def _drop(self, key):
        self.bytes -= self.data.pop(key)[1]
        self.policy.removed(key)

    def get(self, key, now):
        e = self.data.get(key)
        if e is not None and e[0] is not None and e[0] <= now:
            self._drop(key)
            self.expirations += 1
            e = None
        if e is None:
            self.misses += 1
            return False
        e[2], e[3] = e[2] + 1, now
        self.hits += 1
        self.policy.read(key)
        return True

    def put(self, key, now, ttl, size):
        old = self.data.get(key)
        self.bytes += size - (old[1] if old else 0)
        self.data[key] = [None if ttl is None else now + ttl, size, old[2] if old else 0, old[3] if old else now]
        self.writes += 1
        self.policy.wrote(key)
        guard = 0
        # the bound shrinks with the store: one write removes about half of the entries at most
        while (len(self.data) > self.max_entries or self.bytes > self.max_bytes) and guard < len(self.data) + 1:
            guard += 1
            gone = self.policy.victim(key if len(self.data) > 1 else None)
            if gone is None or gone not in self.data:
                break
            self._drop(gone)
            self.evictions += 1

    def delete(self, key):
        if key not in self.data:
            return False
        self._drop(key)
        self.deletes += 1
        return True

    def sweep(self, now, counted="expirations"):
        """Drops what has expired and gives how many went."""
        gone = [k for k, e in self.data.items() if e[0] is not None and e[0] <= now]
        for k in gone:
            self._drop(k)
        setattr(self, counted, getattr(self, counted) + len(gone))
        return len(gone)

    def switch(self, policy):
        """A new policy, seeded with the entries that are there."""
        policy.seed([(k, e[2], e[3]) for k, e in self.data.items()])
        self.policy = policy


COUNTS = "hits long, misses long, expirations long, evictions long, writes long, deletes long, entries long, bytes long, hit_ratio double, peak_entries long"


class Run:
    """A replay of rows (ts, key, op, ttl, size) through a store. switch_at: (ts, policy) pairs in order.

    With sweep_ms, expired entries go at every multiple of it that the rows pass, counted as
    expirations or, as an offloaded sweep does, as deletes.
    """

    def __init__(self, store: Store, switch_at=None, sweep_ms: int | None = None, swept_as: str = "expirations"):
        self.store, self.turns, self.sweep_ms, self.swept_as = store, list(switch_at or ()), sweep_ms, swept_as
        self.peak, self.swept = 0, None

    def step(self, ts, key, op, ttl, size):
        store = self.store
        if self.sweep_ms and self.swept != ts // self.sweep_ms:
            self.swept = ts // self.sweep_ms
            store.sweep(self.swept * self.sweep_ms, self.swept_as)
        while self.turns and self.turns[0][0] <= ts:
            store.switch(POLICIES[self.turns.pop(0)[1]]())
        if op == "GET":
            store.get(key, ts)
        elif op == "PUT":
            store.put(key, ts, ttl, size)
        else:
            store.delete(key)
        self.peak = max(self.peak, len(store.data))

    def counts(self) -> tuple:
        """The values of COUNTS."""
        s = self.store
        reads = s.hits + s.misses
        return (s.hits, s.misses, s.expirations, s.evictions, s.writes, s.deletes, len(s.data), s.bytes, round(s.hits / reads, 6) if reads else 0.0, self.peak)


def run(store: Store, rows, switch_at=None, sweep_ms: int | None = None, swept_as: str = "expirations") -> tuple:
    """Replays rows and returns COUNTS."""
    r = Run(store, switch_at, sweep_ms, swept_as)
    for row in rows:
        r.step(*row)
    return r.counts()


def simulate(log: DataFrame, policies: list[str], max_entries: int | None = None, max_bytes: int | None = None, switch_at: list | None = None, sweep_ms: int | None = None, swept_as: str = "expirations") -> DataFrame:
    """Counters by node and policy. log: node, event_id, ts, key, op, ttl, size_bytes.

    A partition holds whole nodes, sorted by event; it streams through in batches, every policy's store takes
    each row, and only the entries of the node at hand are in memory.
    """
    importable(log.sparkSession)
    rows = log.select("node", "event_id", "ts", "key", "op", "ttl", "size_bytes").repartition("node").sortWithinPartitions("node", "event_id")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lines():
            for pdf in batches:
                ttl = [None if pd.isna(t) else int(t) for t in pdf["ttl"]]
                yield from zip(pdf["node"], pdf["ts"].tolist(), pdf["key"], pdf["op"], ttl, pdf["size_bytes"].tolist(), strict=True)

        for node, part in groupby(lines(), key=lambda r: r[0]):
            runs = [Run(Store(POLICIES[p](), max_entries, max_bytes), switch_at, sweep_ms, swept_as) for p in policies]
            for _, *row in part:
                for r in runs:
                    r.step(*row)
            yield pd.DataFrame([(node, p, *r.counts()) for p, r in zip(policies, runs, strict=True)], columns=["node", "policy", *(c.split()[0] for c in COUNTS.split(", "))])

    return rows.mapInPandas(replay, f"node string, policy string, {COUNTS}")


def lru_read_through(log: DataFrame, capacity: int) -> DataFrame:
    """Hits of a read-through LRU cache, without a simulator: a read hits if fewer than `capacity` distinct keys came since its key's last access.

    The distance of an access is the count of keys whose latest access falls in between; a Fenwick tree
    over a node's accesses counts them.
    """
    from pyspark.sql import Window as W

    importable(log.sparkSession)
    a = log.select("node", "key", F.row_number().over(W.partitionBy("node").orderBy("event_id")).alias("seq"))
    a = a.withColumn("prev", F.lag("seq").over(W.partitionBy("node", "key").orderBy("seq")))

    def distances(key: tuple, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(it)).sort_values("seq")
        n, hits = int(pdf["seq"].max()), 0
        tree = [0] * (n + 1)

        def add(i, v):
            while i <= n:
                tree[i] += v
                i += i & -i

        def total(i):
            s = 0
            while i > 0:
                s += tree[i]
                i -= i & -i
            return s

        for seq, prev in zip(pdf["seq"].tolist(), pdf["prev"].tolist(), strict=True):
            if prev == prev and prev is not None:
                hits += total(seq - 1) - total(int(prev)) < capacity
                add(int(prev), -1)
            add(seq, 1)
        yield pd.DataFrame([(key[0], n, hits)], columns=["node", "accesses", "hits"])

    return a.groupBy("node").applyInPandas(lambda k, p: next(distances(k, iter([p]))), "node string, accesses long, hits long")
