"""Near-duplicate classes by BagMinHash signatures of word shingles.

A document is the bag of its runs of five words. For a shingle of multiplicity w
every unit of weight up to w carries a Poisson process; the processes of the
dyadic weight intervals (0,1], (1,2], (2,4], ... are generated as one each, in
order of their points, and points above w are thinned out. Each point falls into one
of M slots, a slot keeps its earliest point, and a process stops once its points
lie beyond all slots. Two slots agree with the probability of the weighted
Jaccard similarity.

Bands of slots give buckets. Rounds link without pairing a whole bucket:
documents of equal words are one from the start; every bucket then compares its
members with its centre; what is still outside of a bucket's largest class meets
members of that class; what then is of several classes in a bucket is
compared across classes, where a bound on the overlap allows a link. All comparisons count the multiset overlap of
the documents' units (a shingle and its occurrence), as codes of 32 bits, distinct in a document: for
two of n units n * n / 2**32 of them are expected to agree by chance (0.02 at 10,000 words); connected links are a class.

What a bucket is compared with (its centre, its largest class) is a table of a row a bucket,
written before the join, so that both sides of the join are plain shuffles and a hot
bucket's partition is split by adaptive execution; of a bucket only links are emitted.

Defined results: runs shorter than five words count as one shingle; texts that
are null or without words are alone in their class; repeated rows are rows each, in one
class; the smallest key of a class names it, null keys last; of equal keys the first row stays; texts of
any length are read whole, in batches of bounded bytes; an empty table gives an empty result; other columns stay untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_workers, stored

WORDS, LEAST = 5, 0.8
SLOTS, BANDS = 128, 32
CENTRES = 4
#: Turns in which what is left of a bucket meets a member of the bucket's largest class.
TURNS = 2
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(words: np.ndarray, lens: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents' indices, of word hashes laid end to end."""
    docs = np.repeat(np.arange(len(lens)), lens)
    if not len(words):
        return words, docs
    starts = np.cumsum(lens) - lens
    pos = np.arange(len(words)) - starts[docs]
    left = lens[docs] - pos
    take = (left >= k) | ((pos == 0) & (lens[docs] < k))
    at = np.flatnonzero(take)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        j = np.minimum(at + i, len(words) - 1)
        h += np.where(left[at] > i, mix(words[j] + _MUL[i % 5]) * _MUL[(i + 1) % 5], np.uint64(0)) * np.uint64(2 * i + 1)
    return mix(h), docs[at]


def bags(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with multiplicities, sorted."""
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    if not len(h):
        return h, docs, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])]))
    return h[first], docs[first], np.diff(np.append(first, len(h)))


def bag_min_hash(h: np.ndarray, docs: np.ndarray, weight: np.ndarray, n_docs: int, m: int = SLOTS) -> np.ndarray:
    """n_docs x m earliest points; inf where a document has no shingle."""
    best = np.full((n_docs, m), np.inf)
    flat = best.reshape(-1)
    parts, top, level = [], int(weight.max()) if len(weight) else 0, 0
    while level == 0 or 1 << (level - 1) < top:
        lo = 0 if level == 0 else 1 << (level - 1)
        i = np.flatnonzero(weight > lo)
        if not len(i):
            break
        rate = float(max(1, lo))
        parts.append((mix(h[i] + _MUL[1] * np.arange(level, level + 1, dtype=np.uint64) + _MUL[3]), docs[i], np.full(len(i), rate), (weight[i] - lo) / rate))
        level += 1
    if not parts:
        return best
    state, doc, rate, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    x = np.zeros(len(state))
    scale = 1.0 / (1 << 53)
    while len(state):
        state = state + _MUL[0]
        r1 = mix(state)
        r2 = mix(state ^ _MUL[2])
        x = x - np.log(((r1 >> np.uint64(11)).astype(np.float64) + 0.5) * scale) / rate
        ok = (r2 >> np.uint64(32)).astype(np.float64) * (1.0 / (1 << 32)) < share
        slot = (r2 & np.uint64(0xFFFFFFFF)).astype(np.int64) * m >> 32
        np.minimum.at(flat, (doc * m + slot)[ok], x[ok])
        live = x < best.max(1)[doc]
        state, doc, rate, share, x = state[live], doc[live], rate[live], share[live], x[live]
    return best


def band_hashes(best: np.ndarray, bands: int = BANDS) -> np.ndarray:
    v = best.view(np.uint64)
    rows = v.shape[1] // bands
    out = np.zeros((len(v), bands), np.uint64)
    for r in range(rows):
        out = mix(out * _MUL[0] + v[:, r::rows][:, :bands] + _MUL[r % 5])
    return out.view(np.int64)


def units(h: np.ndarray, docs: np.ndarray, n: int) -> list[np.ndarray]:
    """For each document the sorted distinct codes of its units (shingle, occurrence): multisets as sets."""
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(h) else at
    code = (mix(h + nth.astype(np.uint64) * _MUL[4]) >> np.uint64(32)).astype(np.uint32)
    ends = np.searchsorted(docs, np.arange(n), "right")
    return [np.unique(c) for c in np.split(code, ends[:-1])]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard similarity of two sorted code arrays."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


# -- Spark side ------------------------------------------------------------
def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(col.offsets.to_numpy()).astype(np.int64)


def signed(df: DataFrame, name: str = "signed", slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """df's columns within `doc`, with rid, fp1, fp2 (of the words; null without any) and bands, as a stored table."""
    for_workers(df.sparkSession)
    src = df.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), word_hashes(F.col("text")).alias("w"))
    has = F.size("w") > 0
    src = src.select("rid", "doc", F.when(has, F.xxhash64("w")).alias("fp1"), F.when(has, F.xxhash64(F.lit(1), "w")).alias("fp2"), "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, lens = _words(b.column(4))
            best = bag_min_hash(*bags(*shingles(words, lens)), len(lens), slots)
            hashes = band_hashes(best, bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lens) + 1) * bands, pa.int32()), pa.array(hashes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), lists], ["rid", "doc", "fp1", "fp2", "bands"])

    schema = f"rid long, doc {src.schema['doc'].dataType.simpleString()}, fp1 long, fp2 long, bands array<long>"
    return stored(src.mapInArrow(run, schema), name)


def linked(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of rows whose multiset overlap is at least least."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    docs = held.select("rid", F.col("doc.text").alias("t")).join(ids.hint("shuffle_hash"), "rid", "left_semi").select("rid", word_hashes(F.col("t")).alias("w"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, lens = _words(b.column(1))
            rows = units(*shingles(words, lens), len(lens)) if len(lens) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["rid", "u"])

    bag = stored(docs.mapInArrow(codes, "rid long, u binary"), "bags")
    both = pairs.join(bag.select(F.col("rid").alias("a"), F.col("u").alias("ua")), "a").join(bag.select(F.col("rid").alias("b"), F.col("u").alias("ub")), "b").select("a", "b", "ua", "ub")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [overlap(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id of its component, by alternating large and small stars until nothing changes."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def mark(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).groupBy("id").agg(F.min("label").alias("label"))


def _merged(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The classes ca, cb of those pairs a, b that are linked, as class -> smallest class."""
    pairs = stored(pairs, "across")
    more = linked(pairs.select("a", "b"), held, least).join(pairs, ["a", "b"])
    return stored(components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "links")


def _across(left: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Links a, b between classes, of rows outside of their bucket's largest class mc with its other rows.

    support is the number of a row's units that any other row of `left` has; an
    overlap is at most the smaller support of the two, which bounds their
    similarity. Rows whose own words are too many meet nobody this way. The overlap
    itself is counted within the join, so that it gives links and not pairs.
    """
    ids = left.select("rid").distinct()
    docs = held.select("rid", F.col("doc.text").alias("t")).join(ids.hint("shuffle_hash"), "rid", "left_semi").select("rid", word_hashes(F.col("t")).alias("w"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, lens = _words(b.column(1))
            rows = units(*shingles(words, lens), len(lens)) if len(lens) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.view(np.int32) for r in rows], pa.list_(pa.int32()))], ["rid", "u"])

    bag = stored(docs.mapInArrow(codes, "rid long, u array<int>"), "units")
    each = bag.select("rid", F.explode("u").alias("u"))
    common = each.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    support = each.join(common, "u").groupBy("rid").agg(F.count("*").alias("s"))
    able = support.join(bag.select("rid", F.size("u").alias("n")), "rid").where(F.col("s") >= least * F.col("n"))
    able = stored(left.join(able, "rid"), "able")
    # only buckets where both sides are left carry units along
    both = able.groupBy("band", "h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("band", "h")
    full = able.join(both, ["band", "h"], "left_semi").join(bag, "rid")
    x, y = full.alias("x"), full.where("c <> mc").alias("y")
    most, sizes = F.least("x.s", "y.s"), F.col("x.n") + F.col("y.n")
    same = F.size(F.array_intersect("x.u", "y.u"))
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & ((F.col("x.c") == F.col("x.mc")) | (F.col("x.c") < F.col("y.c")))
    meet &= (most >= least * (sizes - most)) & (same >= least * (sizes - same))
    return x.join(y, meet).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def classes(df: DataFrame, key: str = "doc_id", least: float = LEAST, held: DataFrame | None = None) -> DataFrame:
    """rid, key, class_id (smallest key), class_size and first: whether the row is the one that stays."""
    held = signed(df) if held is None else held
    one = held.where("fp1 is not null").groupBy("fp1", "fp2").agg(F.min("rid").alias("rid"))
    one = stored(one, "ones")
    buckets = held.select("rid", "bands").join(one.select("rid").hint("shuffle_hash"), "rid", "left_semi").select("rid", F.posexplode("bands").alias("band", "h"))
    buckets = stored(buckets, "buckets")
    centre = buckets.groupBy("band", "h").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rid", F.col("band") % CENTRES), F.col("rid").alias("rid")))["rid"].alias("b")).where("n > 1").drop("n")
    centre = stored(centre, "centres")
    shared = stored(buckets.join(centre, ["band", "h"]), "shared")
    pairs = shared.where("rid <> b").select(F.greatest("rid", "b").alias("a"), F.least("rid", "b").alias("b")).distinct()
    maps = [stored(components(linked(pairs, held, least)), "links")]

    def relabel(x: DataFrame, col: str, m: DataFrame) -> DataFrame:
        return x.join(m.select(F.col("id").alias(col), F.col("label").alias("__l")), col, "left").withColumn(col, F.coalesce("__l", col)).drop("__l")

    # what is left: buckets of more than one class
    of = relabel(shared.select("band", "h", "rid", F.col("rid").alias("c")), "c", maps[0])
    for turn in range(TURNS):
        per = of.groupBy("band", "h", "c").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rid", "band", F.lit(turn)), F.col("rid").alias("rid")))["rid"].alias("b"))
        main = per.groupBy("band", "h").agg(F.count("*").alias("k"), F.max(F.struct("n", "c", "b")).alias("m")).where("k > 1").select("band", "h", F.col("m.c").alias("mc"), F.col("m.b").alias("b"))
        of, main = stored(of, "turn"), stored(main, "main")
        of = stored(of.join(main, ["band", "h"]), "mixed")
        pairs = of.where("c <> mc").select(F.greatest("rid", "b").alias("a"), F.least("rid", "b").alias("b"), F.greatest("c", "mc").alias("ca"), F.least("c", "mc").alias("cb")).distinct()
        maps.append(_merged(pairs.dropDuplicates(["a", "b"]), held, least))
        of = relabel(of.drop("mc", "b"), "c", maps[-1])
    per = of.groupBy("band", "h", "c").agg(F.count("*").alias("n"))
    main = per.groupBy("band", "h").agg(F.count("*").alias("k"), F.max(F.struct("n", "c"))["c"].alias("mc")).where("k > 1").drop("k")
    of, main = stored(of, "turn"), stored(main, "main")
    left = stored(of.join(main, ["band", "h"]), "left")
    maps.append(stored(components(_across(left, held, least)), "links"))

    label = one.select("fp1", "fp2", F.col("rid").alias("label"))
    for m in maps:
        label = relabel(label, "label", m)
    rows = held.select("rid", F.col(f"doc.`{key}`").alias("k"), "fp1", "fp2")
    worded = rows.where("fp1 is not null").join(label, ["fp1", "fp2"]).select("rid", "k", "label")
    worded = stored(worded, "labels")
    best = worded.groupBy("label").agg(F.min(F.struct(F.col("k").isNull(), "k", "rid")).alias("b"), F.count("*").alias("class_size"))
    best = stored(best, "classes")  # a plain side of the join: a large class is split by adaptive execution
    out = worded.join(best, "label").select("rid", F.col("k").alias(key), F.col("b.k").alias("class_id"), "class_size", (F.col("rid") == F.col("b.rid")).alias("first"))
    alone = rows.where("fp1 is null").select("rid", F.col("k").alias(key), F.col("k").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def keep_one(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with one row of each class."""
    held = signed(df)
    gone = classes(df, key, held=held).where(~F.col("first")).select("rid")
    return held.select("rid", "doc").join(gone.hint("shuffle_hash"), "rid", "left_anti").select("doc.*")
