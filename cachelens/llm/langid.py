"""Language identification by a byte convolutional network, trained in numpy.

Bytes map to classes (A-Z fold into a-z, digits into one, control into space)
and to embeddings; filters of widths 2, 3 and 4 slide over windows of 128 bytes, each
filter keeps its maximum, a softmax follows. A text's probabilities are the
means over its windows, and all of its bytes lie in some window.

All labelled rows that are not held out train the network, by all windows of their texts: rows are dealt by
hash into shards of about SHARD rows, each shard goes over its rows once (over less than SHARD / 2 rows in up to TURNS turns), STEP rows a step and each row with the same
weight, however long its text, and the network is the mean of the shards' results, weighted by rows. Shards and their
order depend on the rows alone; the mean is summed in fixed point, so that the order of tasks doesn't matter.
All shards start from the same values, which a short training sets: at most SAMPLE rows of each language, those of the keys with the lowest hash
of key and language, a row of each key before a second one of any, and at most WINDOWS windows of each, spread evenly over the
whole text. Prediction folds embedding and filters into one table for each offset.

With noise, one more output stands for what is no language: windows of the rows in training whose
symbols are shuffled, uniform symbols, bytes and signs, and random letters of other scripts. All labelled rows that are
held out and have a letter calibrate it: `cut` is such that HELD_SHARE of them have less
noise, and never below SURE. A text's noise is the mean of its n windows to the power of
1/n (AGREE at most), as a clean text of one window looks more like noise than a long one.

Defined results: a null text or one without a letter is `und` with score 0;
equal texts and repeated rows get equal predictions; of equally likely languages the first by
name is predicted; texts of any length are read whole, in batches of bounded bytes; with no
labelled row all are `und`; an empty table gives an empty result; columns beside those named are
not read, whatever their names; a labelled row without a key or without a byte of text doesn't train; rows equal in key, language and text are in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import for_workers, stored

SAMPLE, WINDOWS = 400, 6
#: Rows of a shard and of a step, the steps' rate, turns over a table of less than a shard at most, the windows taken at once, and the units of the fixed point in which shards are summed.
SHARD, STEP, RATE, TURNS, CHUNK, UNITS = 4096, 64, 0.01, 6, 128, 1 << 24
LENGTH, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 12
UND = "und"
#: Symbols that a window must have to be made noise of, and the share of held-out rows that the calibrated noise stays below.
NOISE_LEAST, HELD_SHARE, SURE, AGREE = 24, 0.998, 0.97, 16


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 space and control, 1 digit, 2-27 letters, then punctuation in four, then each byte from 128 up."""
    out = np.zeros(256, np.int32)
    for b in range(33, 127):
        out[b] = 28 + b % 4
    for b in range(48, 58):
        out[b] = 1
    for b in range(26):
        out[65 + b] = out[97 + b] = 2 + b
    out[128:] = 32 + np.arange(128)
    return out


CLASSES = byte_classes()
N_CLASSES = 160


def windows_of(data: bytes) -> np.ndarray:
    """Class windows of fixed length over all bytes; the last one reaches back, a short text is padded with spaces."""
    c = CLASSES[np.frombuffer(data, np.uint8)]
    n = len(c)
    if n <= LENGTH:
        return np.pad(c, (0, LENGTH - n))[None]
    k = -(-n // LENGTH)
    at = np.minimum(np.arange(k) * LENGTH, n - LENGTH)
    return c[at[:, None] + np.arange(LENGTH)]


def noise_rows(x: np.ndarray) -> np.ndarray:
    """Those windows that noise is made of: every second one of those that hold enough symbols."""
    return np.flatnonzero((x != 0).sum(1) >= NOISE_LEAST)[::2]


def noise_of(x: np.ndarray, seed: int = 29) -> np.ndarray:
    """Windows without a language, of the form of those in x that noise is made of."""
    r = np.random.default_rng(seed)
    out = x[noise_rows(x)]
    for i, row in enumerate(out):
        body = np.flatnonzero(row)
        if i % 5 == 0:
            row[body] = row[r.permutation(body)]
        elif i % 5 == 1:
            row[:] = r.integers(1, 32, LENGTH)
        elif i % 5 == 2:
            row[body] = r.integers(32, N_CLASSES, len(body))
        elif i % 5 == 3:
            row[:] = r.choice((0, 1, 28, 29, 30, 31), LENGTH)
        else:
            start = int(r.integers(0x370, 0xD700))
            letters = "".join(chr(start + int(k)) if k < 64 else " " for k in r.integers(0, 75, LENGTH))
            row[:] = CLASSES[np.frombuffer(letters.encode(), np.uint8)[:LENGTH]]
    return out


class Adam:
    """Steps of a network's parameters against their gradients."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for name, grad in g.items():
            self.m[name] = 0.9 * self.m[name] + 0.1 * grad
            self.v[name] = 0.999 * self.v[name] + 0.001 * grad**2
            self.p[name] -= self.rate * (self.m[name] / (1 - 0.9**self.t)) / (np.sqrt(self.v[name] / (1 - 0.999**self.t)) + 1e-8)


class ByteCnn:
    def __init__(self, labels: list[str], seed: int = 7, noise: bool = False):
        r = np.random.default_rng(seed)
        self.labels, self.noise = labels, noise
        self.p = {"emb": r.normal(0, 0.3, (N_CLASSES, EMBED))}
        for w in WIDTHS:
            self.p[f"f{w}"] = r.normal(0, (1 / (w * EMBED)) ** 0.5 * 2, (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels) + noise))
        self.p["bias"] = np.zeros(len(labels) + noise)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of one batch of windows."""
        p, n = self.p, len(x)
        e = p["emb"][x]
        feats, kept = [], []
        for w in WIDTHS:
            m = LENGTH - w + 1
            z = sum(e[:, o : o + m] @ p[f"f{w}"][o] for o in range(w)) + p[f"b{w}"]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            feats.append(np.maximum(top, 0))
            kept.append((at, top > 0))
        h = np.concatenate(feats, 1)
        s = h @ p["out"] + p["bias"]
        s -= s.max(1, keepdims=True)
        q = np.exp(s)
        q /= q.sum(1, keepdims=True)
        d = q.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = d @ p["out"].T
        for k, w in enumerate(WIDTHS):
            at, on = kept[k]
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"b{w}"] = dz.sum(0)
            gf = np.zeros_like(p[f"f{w}"])
            rows = np.arange(n)[:, None]
            for o in range(w):
                c = x[rows, at + o]  # n x filters
                gf[o] = np.einsum("nfe,nf->ef", p["emb"][c], dz)
                np.add.at(g["emb"], c, dz[:, :, None] * p[f"f{w}"][o].T[None])
            g[f"f{w}"] = gf
        return float(-np.log(q[np.arange(n), y] + 1e-12).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteCnn:
        r = np.random.default_rng(seed)
        adam = Adam(self.p, rate)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(x), batch):
                i = order[k : k + batch]
                adam.step(self.step(x[i], y[i])[1])
        return self

    def slopes(self, model: Predictor, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the windows' losses, each times its share; model: the predictor of the present parameters, whose tables take a fraction of step()'s time."""
        p, n, f = self.p, len(x), np.arange(FILTERS)
        kept, tops = [], []
        for z in model.responses(x):
            at = z.argmax(1)
            kept.append(at)
            tops.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        top = np.concatenate(tops, 1).astype(np.float64)
        h = np.maximum(top, 0)
        s = h @ p["out"] + p["bias"]
        d = np.exp(s - s.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d *= share[:, None]
        g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = d @ p["out"].T * (top > 0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"], g[f"f{w}"] = dz.sum(0), np.zeros_like(p[f"f{w}"])
            for o in range(w):
                of = np.bincount((x[rows, kept[k] + o] * FILTERS + f).ravel(), dz.ravel(), N_CLASSES * FILTERS).reshape(N_CLASSES, FILTERS)  # of each class and filter
                g[f"f{w}"][o] = p["emb"].T @ of
                g["emb"] += of @ p[f"f{w}"][o].T
        return g

    def lesson(self, texts: list[tuple[int, bytes]], seed: int = 0) -> dict[str, np.ndarray]:
        """Gradients of labelled texts, each with the same weight, its windows and the noise made of them included."""
        windows = [windows_of(b) for _, b in texts]
        lens = [len(w) for w in windows]
        x, y = np.concatenate(windows), np.repeat([c for c, _ in texts], lens)
        share = np.repeat([1 / (n * len(texts)) for n in lens], lens)
        model, g = Predictor(self), {k: np.zeros_like(v) for k, v in self.p.items()}
        for k in range(0, len(x), CHUNK):
            part, of, by = x[k : k + CHUNK], y[k : k + CHUNK], share[k : k + CHUNK]
            if self.noise:
                made = noise_of(part, seed + k)
                of, by = np.concatenate([of, np.full(len(made), len(self.labels))]), np.concatenate([by, by[noise_rows(part)]])
                part = np.concatenate([part, made])
            for name, grad in self.slopes(model, part, of, by).items():
                g[name] += grad
        return g

    def read(self, texts: Iterator[tuple[int, bytes]], rate: float = RATE) -> int:
        """Goes over labelled texts once; returns their number."""
        adam, n = Adam(self.p, rate), 0
        while part := list(islice(texts, STEP)):
            adam.step(self.lesson(part, n))
            n += len(part)
        return n

    def flat(self) -> np.ndarray:
        """All parameters end to end."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def put(self, flat: np.ndarray) -> ByteCnn:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).copy()
            at += n
        return self

    def tables(self) -> dict:
        """For each width and offset, the response of each class: classes x filters."""
        return {w: [(self.p["emb"] @ self.p[f"f{w}"][o]).astype(np.float32) for o in range(w)] for w in WIDTHS}


class Predictor:
    """Pairs of classes index joint tables, so that a width costs at most two look-ups a byte."""

    def __init__(self, net: ByteCnn):
        self.cut = SURE
        self.labels, self.out, self.bias = net.labels, net.p["out"].astype(np.float32), net.p["bias"].astype(np.float32)
        t = net.tables()

        def pair(a, b):
            return (a[:, None] + b[None]).reshape(N_CLASSES * N_CLASSES, FILTERS)

        self.two = pair(*t[2]) + net.p["b2"].astype(np.float32)
        self.three = (pair(t[3][0], t[3][1]) + net.p["b3"].astype(np.float32), t[3][2])
        self.four = (pair(t[4][0], t[4][1]) + net.p["b4"].astype(np.float32), pair(t[4][2], t[4][3]))

    def responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each width the filters' responses: windows x places x filters."""

        def at(table: np.ndarray, i: np.ndarray) -> np.ndarray:
            return np.take(table, np.ascontiguousarray(i, np.intp).ravel(), 0, mode="clip").reshape(*i.shape, FILTERS)

        bi = x[:, :-1].astype(np.intp) * N_CLASSES + x[:, 1:]
        yield at(self.two, bi)
        z = at(self.three[0], bi[:, :-1])
        z += at(self.three[1], x[:, 2:])
        yield z
        z = at(self.four[0], bi[:, :-2])
        z += at(self.four[1], bi[:, 2:])
        yield z

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(x), 64):  # 64 windows keep the temporaries in cache-sized blocks
            h = [z.max(1) for z in self.responses(x[k : k + 64])]
            s = np.maximum(np.concatenate(h, 1), 0) @ self.out + self.bias
            s = np.exp(s - s.max(1, keepdims=True))
            out.append(s / s.sum(1, keepdims=True))
        return np.concatenate(out)

    def means(self, windows: list[np.ndarray]) -> np.ndarray:
        """Mean probabilities of each text, given as its windows."""
        p = self.probabilities(np.concatenate(windows))
        lens = np.array([len(w) for w in windows])
        return np.stack([part.mean(0) for part in np.split(p, np.cumsum(lens)[:-1])])

    def noise(self, windows: list[np.ndarray], means: np.ndarray) -> np.ndarray:
        """Noise of each text; 0 without that output."""
        if means.shape[1] == len(self.labels):
            return np.zeros(len(means))
        return np.minimum(1.0, means[:, -1].astype(np.float64)) ** (1 / np.minimum([len(w) for w in windows], AGREE))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and noise (0 without that output) of each text."""
        langs, scores, noise = [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        group: list[tuple[int, np.ndarray]] = []
        n = len(self.labels)

        def flush():
            windows = [w for _, w in group]
            means = self.means(windows)
            for (i, _), mean, no in zip(group, means, self.noise(windows, means), strict=True):
                best = int(mean[:n].argmax())
                langs[i], scores[i], noise[i] = self.labels[best], float(min(1.0, mean[best])), float(no)
            group.clear()

        held = 0
        for i, t in enumerate(texts):
            if t is None or not self.labels or not any(map(str.isalpha, t)):
                continue
            group.append((i, windows_of(t.encode())))
            held += len(group[-1][1])
            if held >= 2048:
                flush()
                held = 0
        if group:
            flush()
        return langs, scores, noise


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(df: DataFrame, held: bool, key: str, text: str, lang: str) -> DataFrame:
    """k, lang and t (the text) of the labelled rows with text that are, or are not, held out."""
    side = held_out(F.col("k")) if held else ~held_out(F.col("k"))
    rows = df.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("t"))
    return rows.where(F.col("lang").isNotNull() & F.col("k").isNotNull() & side & (F.octet_length("t") > 0))


def sampled(rows: DataFrame, keys_of: dict[str, int], sample: int) -> DataFrame:
    """lang, a hash h and the bytes b of some windows of a bounded sample of labelled rows, for the values that training starts from; keys_of: about how many keys a language has."""
    light = rows.select("k", "lang")
    # a threshold on the hash lets about four times the sample of a language pass, so that its ranking stays small
    place = F.pmod(F.xxhash64("k", "lang"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    share = F.create_map(*(F.lit(x) for c, n in sorted(keys_of.items()) for x in (c, min(1.0, 4.0 * sample / max(1, n)))))
    few = light.withColumn("u", place).where(F.col("u") < share[F.col("lang")]).distinct()
    order = W.partitionBy("lang").orderBy("u", "k")
    keys = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("k", "lang")
    # at most sample keys for each language go to the scan; the texts of other rows aren't moved
    body = F.encode("t", "utf-8")
    free = F.octet_length("t") - LENGTH * WINDOWS  # bytes that no window takes lie between the windows
    spread = F.concat(*(F.substring(body, F.lit(1 + LENGTH * i) + F.floor(free * i / (WINDOWS - 1)).cast("int"), F.lit(LENGTH)) for i in range(WINDOWS)))
    part = F.when(free > 0, spread).otherwise(body)
    # a key with many rows has its turns after the first rows of all others
    cut = rows.join(F.broadcast(keys), ["k", "lang"], "left_semi").select("k", "lang", part.alias("b")).withColumn("h", F.xxhash64("k", "b"))
    cut = cut.withColumn("turn", F.row_number().over(W.partitionBy("lang", "k").orderBy("h", "b"))).where(F.col("turn") <= sample)
    cut = cut.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("turn", "h", "k"))).where(F.col("r") <= sample)
    return cut.select("lang", "h", "b")


def started(few: DataFrame, net: ByteCnn) -> ByteCnn:
    """net with the values that all shards start from; fitted in a task, which keeps it out of the driver's memory."""
    for_workers(few.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["lang"], r["h"], r["b"]) for b in batches for r in b.to_pylist())
        windows = [windows_of(b) for _, _, b in got]
        x, y = np.concatenate(windows), np.repeat([net.labels.index(c) for c, _, _ in got], [len(w) for w in windows])
        extra = noise_of(x) if net.noise else x[:0]
        net.fit(np.concatenate([x, extra]), np.concatenate([y, np.full(len(extra), len(net.labels))]))
        yield pa.RecordBatch.from_arrays([pa.array([net.flat().tobytes()], pa.binary())], ["p"])

    return net.put(np.frombuffer(few.repartition(1).mapInArrow(run, "p binary").first()["p"]))


def taught(rows: DataFrame, net: ByteCnn, n: int) -> ByteCnn:
    """The mean of what the shards of all n labelled rows make of net."""
    spark = rows.sparkSession
    for_workers(spark)
    shards, turns = -(-n // SHARD), max(1, min(TURNS, SHARD // n))
    shared = spark.sparkContext.broadcast(net)
    dealt = rows.select(F.xxhash64("k", "lang", "t").alias("h"), "lang", "t").repartitionById(shards, F.pmod("h", F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("turn", F.explode(F.array(*map(F.lit, range(turns))))) if turns > 1 else dealt.withColumn("turn", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        own = ByteCnn(first.labels, noise=first.noise).put(first.flat())
        number = {c: i for i, c in enumerate(own.labels)}
        texts = ((number[c], t.encode()) for b in batches for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if seen := own.read(texts):
            moved = np.rint((own.flat() - first.flat()) * UNITS).astype(np.int64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(moved)), pa.int32()), pa.array(np.concatenate([[seen], moved]), pa.int64())], ["i", "v"])

    moved = dealt.sortWithinPartitions("turn", "h").select("lang", "t").mapInArrow(run, "i int, v long")
    got = dict(moved.groupBy("i").agg(F.sum("v")).collect())  # a number for each parameter
    start = net.flat()
    return net.put(start + np.array([got[i] for i in range(len(start))]) / (got[-1] * UNITS))


def least_cut(noise: DataFrame) -> float:
    """The noise that HELD_SHARE of all rows stay below, as np.quantile has it, but SURE at least; counts of ranges narrow down to the values beside it."""
    n, over, top = noise.agg(F.count("*"), F.count_if(F.col("noise") > SURE), F.max("noise")).first()
    at = (n - 1) * HELD_SHARE
    if int(at) + 1 < n - over or not over:  # both values beside it are less
        return SURE

    def nth(k: int) -> float:
        lo, hi, before = 0.0, top, 0
        while lo < hi:
            place = F.least(F.floor((F.col("noise") - lo) / ((hi - lo) / 1024)), F.lit(1023))
            ranges = noise.where(F.col("noise").between(lo, hi)).groupBy(place.alias("r")).agg(F.count("*").alias("n"), F.min("noise").alias("lo"), F.max("noise").alias("hi"))
            for r in sorted(ranges.collect()):
                if k < before + r["n"]:
                    lo, hi = r["lo"], r["hi"]
                    break
                before += r["n"]
        return lo

    a, b = nth(int(at)), nth(min(int(at) + 1, n - 1))
    return max(SURE, a + (b - a) * (at - int(at)))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, noise: bool = False) -> Predictor:
    """Fits on all labelled rows that are not held out; sample bounds the rows of a language that set the values to start from."""
    rows = labelled(df, False, key, text, lang)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("k").alias("keys")).collect()
    if not counts:
        return Predictor(ByteCnn([]))
    net = started(sampled(rows, {r["lang"]: r["keys"] for r in counts}, sample), ByteCnn(sorted(r["lang"] for r in counts), noise=noise))
    model = Predictor(taught(rows, net, sum(r["n"] for r in counts)))
    if noise:
        held = predict_column(labelled(df, True, key, text, lang), model, [F.col("k")], "t")
        model.cut = least_cut(stored(held.where(F.col("lang_pred") != UND).select("noise"), "noise"))
    return model


def predict_column(df: DataFrame, model: Predictor, keep: list[Column], text: str = "text") -> DataFrame:
    """keep, lang_pred, score and noise of each row, in one pass without a shuffle."""
    spark = df.sparkSession
    for_workers(spark)
    shared = spark.sparkContext.broadcast(model)  # a few MB of tables, whatever the input
    src = df.select(*keep, df[text].cast("string").alias("__t"))
    names = src.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", lang_pred string, score double, noise double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, noise = m.predict(b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(noise, pa.float64())], [*names, "lang_pred", "score", "noise"])

    return src.mapInArrow(run, schema)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    model = train(df, key, text, lang)
    return predict_column(df, model, [F.col(key), held_out(F.col(key)).alias("held_out")], text).select(key, "held_out", "lang_pred", "score")
