"""Secret scan with a random forest that removes false positives, in DataFrame functions only.

Candidates are runs of 16 or more key characters, and values assigned to a name, both to
their end however long. Each gets features: length, transitions between classes of
characters, shares of digits, of capitals and of hexadecimal digits, distinct characters,
coverage by dictionary words and frequent pairs of letters, signs of a path or address, and the neighbouring
words. A forest trained on labelled findings scores them; its trees are one SQL expression.

Training collects the features of the labelled findings (at most FINDINGS) to the
driver; scanning never does.

Every occurrence of a candidate is scored among its own neighbours. A value is a secret of
its text if any of its occurrences is; start and score are those of the first such one.
A secret's places in its text are all candidates and all words (runs without spaces,
quotes and angle brackets) that equal it; within a longer run it is part of another value.

A text is cut into candidates and what lies between them once, and values are looked up by
their hashes, so that time and memory grow with the text's length, whatever it holds.

Defined results: null and empty texts have no finding; a secret repeated in a text is one
finding with the count of its places, all of which redact() marks; equal texts and repeated rows
have equal findings, each row its own; of equal scores the first place counts; texts of any length
are read whole; an empty table gives an empty result; the other columns pass through
redact() untouched, and scan() does not read them.
"""

from __future__ import annotations

import json
import random
import string
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the labelled findings that training takes.
FINDINGS = 2_000
TREES, DEPTH, LEAF = 15, 6, 4
CHARS = r"A-Za-z0-9_+/=\-"
CANDIDATE = rf"(?<![{CHARS}])[{CHARS}]{{16,}}+"
#: A value in quotes or after = or : behind a name that tells.
ASSIGNED = r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|auth)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?([^\s\"'<>]{8,}+)"
#: A whole word, where a known secret may stand as well.
WORD = r"[^\s\"'<>]{8,}+"
MARK = "[SECRET]"
BEFORE, AFTER = 48, 24
BLOCK = 512
#: Words that belong to prose and names rather than to random strings.
WORDS = (
    "the and for that with this from have not are was you all can her has one our out day get him his how man new now old see two way who boy did its let put say she too use "
    "test sample example demo data file path image photo user name home page index main module class method value table column version release build debug config default local "
    "server client public private static assets content images scripts style report document library package source target token secret password admin http https www com org net"
).split()
GOOD = r"(?i)(token|secret|passw(or)?d|pwd|api[_ -]?key|access[_ -]?key|credential|bearer|auth(orization)?|private[_ -]?key|signing[_ -]?key)\W{0,6}$"
BAD = r"(?i)(sha\d*|md5|checksum|digest|commit|revision|uuid|guid|hash|etag|card|phone|invoice|order|isbn|id|version|integrity|build)\W{0,6}$"

FEATURES = ("length", "moves", "digits", "capitals", "hex", "distinct", "known", "slashes", "path", "assigned", "quoted", "good", "bad", "only_digits", "uuid", "longest_word", "pairs")
#: Frequent pairs of letters in English, German, French and Spanish: words consist of them, random letters don't.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke "
    "ei sc ht au eu ck qu ue ui ez je jo ga gu go do du da ag eg ug ap ep up sp fr br gr cr dr cl gl fl tz pf zu ze rd rm rn lt lt nk ft hr ht ib ob ub by my ys if ef af rg rk rl lb lm"
).split()


def features(c: Column, before: Column, after: Column) -> list[Column]:
    """The values of FEATURES, as doubles, of a candidate between its neighbours."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")

    def count(pattern: str) -> Column:
        return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    runs = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    known = F.aggregate(runs, F.lit(0), lambda a, w: a + F.when(w.isin(WORDS), F.length(w)).otherwise(0))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    out = [
        n,
        F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[0-9a-fA-F]") / n,
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        known / n,
        count("/"),
        F.when(before.rlike(r"(://|[/\\.@])[^\s]*$") | after.rlike(r"^(\.[a-z]{2,4}\b|@)"), 1).otherwise(0),
        F.when(before.rlike(r"[=:][ \t]*[\"']?$"), 1).otherwise(0),
        F.when(before.rlike(r"[\"']$") & after.rlike(r"^[\"']"), 1).otherwise(0),
        F.when(before.rlike(GOOD), 1).otherwise(0),
        F.when(before.rlike(BAD), 1).otherwise(0),
        F.when(c.rlike("^[0-9-]+$"), 1).otherwise(0),
        F.when(c.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), 1).otherwise(0),
        longest / n,
        F.regexp_count(c, F.lit(f"(?i)(?=({'|'.join(PAIRS)}))")) / F.greatest(F.regexp_count(c, F.lit("(?i)(?=[a-z]{2})")), F.lit(1)),
    ]
    return [x.cast("double") for x in out]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def starts(sizes: Column) -> Column:
    """For each of some sizes, the sum of those before it: by blocks, so that long texts stay cheap."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, n: a + n)

    def block(i: Column) -> Column:
        return F.floor(i / BLOCK).cast("int")

    sums = F.transform(F.sequence(F.lit(0), block(F.size(sizes))), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    ups = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
    return let(ups, lambda u: F.transform(sizes, lambda _, i: F.get(u, block(i)) + total(F.slice(sizes, block(i) * BLOCK + 1, i % BLOCK))))


def matches(t: Column, pattern: str, group: int) -> Column:
    """leads, values and tail of a text, which is leads[0] values[0] leads[1] values[1] ... tail; the pattern ends with its group."""
    whole, values = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    between = F.split(t, pattern, -1)  # one more than there are matches
    names = F.zip_with(whole, values, lambda w, v: F.left(w, F.length(w) - F.length(v)))
    cut = F.struct(between.alias("between"), values.alias("values"), names.alias("names"))
    return let(cut, lambda x: F.struct(F.zip_with(F.slice(x["between"], F.lit(1), F.size(x["values"])), x["names"], lambda b, n: F.concat(b, n)).alias("leads"), x["values"].alias("values"), F.element_at(x["between"], -1).alias("tail")))


def occurrences(t: Column, pattern: str, group: int) -> Column:
    """Array of secret, start (0-based) and f, the features, for each match of a pattern."""

    def judged(m: Column) -> Column:
        leads, values = m["leads"], m["values"]

        def piece(i: Column) -> Column:
            return F.coalesce(F.concat(F.get(leads, i), F.get(values, i)), F.lit(""))

        def more(c: Column, i: Column, at: Column) -> Column:
            # values have 8 characters or more: six hold BEFORE, three AFTER
            before = F.right(F.concat(*(piece(i - k) for k in range(6, 0, -1)), F.get(leads, i)), F.lit(BEFORE))
            after = F.left(F.concat(*(piece(i + k) for k in range(1, 4)), F.when(i + 3 >= F.size(values), m["tail"]).otherwise("")), F.lit(AFTER))
            near = F.struct(before.alias("before"), after.alias("after"))
            return F.struct(c.alias("secret"), (at + F.length(F.get(leads, i))).alias("start"), let(near, lambda n: F.array(*features(c, n["before"], n["after"]))).alias("f"))

        sizes = F.zip_with(leads, values, lambda a, b: F.length(a) + F.length(b))
        return let(let(sizes, starts), lambda at: F.transform(values, lambda c, i: more(c, i, F.get(at, i))))

    none = F.array().cast("array<struct<secret:string,start:int,f:array<double>>>")
    return F.when(t.rlike(pattern), let(matches(t, pattern, group), judged)).otherwise(none)


def candidates(text: Column) -> Column:
    """Array of the candidates of a text, one for each occurrence: secret, start (0-based) and f, the features."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(occurrences(t, CANDIDATE, 0), occurrences(t, ASSIGNED, 1))


# -- the forest ------------------------------------------------------------
def grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int = DEPTH) -> tuple | float:
    """A Gini tree: (feature, threshold, left, right) or the share of positives."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None)
    for f in r.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        cut = (v[1:] > v[:-1]) & (k >= LEAF) & (len(y) - k >= LEAF)
        if cut.any():
            a, b = pos[:-1], pos[-1] - pos[:-1]
            cost = np.where(cut, a * (1 - a / k) + b * (1 - b / (len(y) - k)), np.inf)
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (float(cost[i]), (int(f), round(float((v[i] + v[i + 1]) / 2), 6)))
    if best[1] is None:
        return share
    f, at = best[1]
    low = x[:, f] <= at
    if low.all() or not low.any():
        return share
    return (f, at, grow(x[low], y[low], r, depth - 1), grow(x[~low], y[~low], r, depth - 1))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 17) -> list:
    r, out = np.random.default_rng(seed), []
    for _ in range(trees):
        i = r.integers(0, len(y), len(y))
        out.append(grow(x[i], y[i], r))
    return out


def vote(tree: tuple | float, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def forest_sql(trees: list, f: str = "x.f") -> str:
    """The mean vote of the trees as one SQL expression over an array f of features."""

    def node(t) -> str:
        if not isinstance(t, tuple):
            return f"{t:.6f}D"
        return f"IF({f}[{t[0]}] <= {t[1]!r}D, {node(t[2])}, {node(t[3])})"

    return f"(({' + '.join(node(t) for t in trees)}) / {len(trees)}D)"


# -- labelled findings -----------------------------------------------------
def labelled_findings(n: int = 1_200, seed: int = 23) -> list[dict]:
    """Findings as reviewers label them: text around a candidate, and whether it is a secret."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(("the", "er", "on", "an", "re", "st", "en", "ie", "ch", "que", "os", "ado", "ment", "le")) for _ in range(r.randint(1, 4)))

    def some(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    hexa, b64 = "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    alnum = string.ascii_letters + string.digits
    out = []
    for i in range(n):
        pre, post = " ".join(word() for _ in range(r.randint(0, 6))), " ".join(word() for _ in range(r.randint(0, 4)))
        if i % 2:
            name = r.choice(("token", "api_key", "API_KEY", "secret", "client_secret", "password", "auth_token", "access key", "Authorization: Bearer", "private_key", "AWS_SECRET_ACCESS_KEY"))
            value = r.choice((some(hexa, r.choice((32, 40, 64))), some(hexa, 40).upper(), some(b64, r.choice((24, 32, 40))), "AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36), "sk-" + some(alnum, 40), some(alnum, r.randint(16, 28)) + "1", "AKIA" + some(string.ascii_uppercase, 16), some(string.ascii_letters, r.randint(16, 40)), some(string.ascii_lowercase, r.randint(20, 40)), ".".join(some(alnum + "-_", k) for k in (36, r.randint(60, 400), 43))))
            q = r.choice(('"', '"', "'", ""))
            sep = r.choice((" = ", " = ", "=", ": ", " "))
            if value[:4] in ("AKIA", "ghp_") or value[:3] == "sk-":
                name = r.choice((name, word(), "use"))
            if r.random() < 0.15:
                pre, name, value = pre.upper(), name.upper(), value.upper()
            before, after = f"{pre} {name}{sep}{q}", q + " " + post
        else:
            kind = r.randrange(14)
            if kind == 0:
                before, value, after = f"{pre} {r.choice(('', 'card ', 'id ', 'order ', 'account '))}", some(string.digits, 16), f" {post}"
            elif kind == 1:
                before, value, after = f"{pre} {r.choice(('sha256: ', 'commit ', 'checksum = ', 'md5 = ', 'digest: ', 'revision ', 'etag = '))}", some(hexa, r.choice((32, 40, 64))), f" {post}"
            elif kind == 2:
                before, value, after = f"{pre} {r.choice(('', 'uuid = ', 'guid: ', 'id = '))}", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), f" {post}"
            elif kind == 3:
                before, value, after = f"{pre} https://www.example.org", "/" + "/".join(word() for _ in range(3)) + "/" + some(string.digits, 4), f".html {post}"
            elif kind == 4:
                before, value, after = f"{pre} /home/", "/".join(word() for _ in range(4)) + some(string.digits, 2), f".txt {post}"
            elif kind == 5:
                before, value, after = pre + " ", "".join(word() for _ in range(4)) + r.choice("0123456789"), f" {post}"
            elif kind == 6:
                before, value, after = f"{pre} {word()} = ", "_".join(word() for _ in range(4)) + "_2", f" {post}"
            elif kind == 7:
                before, value, after = f"{pre} version ", "-".join(("release", some(string.digits, 4), some(string.digits, 2), some(string.digits, 2), word())), f" {post}"
            elif kind == 8:
                before, value, after = f"{pre} {r.choice(('password', 'token', 'secret'))} = ", r.choice(("example_password_1", "your-token-here-123", "test_token_sample_1", "changeme_default_1", "path/to/secret/file1", "<see document 1 example>".replace(" ", "_"))), f" {post}"
            elif kind == 9:  # words without a digit
                long = "".join(word() for _ in range(r.randint(5, 9)))
                before, value, after = pre + " ", r.choice((long, long.capitalize(), long.upper())), f"{r.choice(('', ',', '.'))} {post}"
            elif kind == 10:
                before, value, after = pre + r.choice((" ", " = ", " import ")), r.choice(("_", "-", "/")).join(word() for _ in range(r.randint(4, 6))) + "ment", f" {post}"
            elif kind == 11:
                before, value, after = pre + r.choice((" ", " new ", " class ")), "".join(word().capitalize() for _ in range(r.randint(4, 7))) + "Element", f" {post}"
            elif kind == 12:
                before, value, after = pre + r.choice((" ", "")), r.choice("=-_/+") * r.randint(16, 80), f" {post}"
            else:
                before, value, after = pre + " ", "=" * r.randint(16, 30) + "1" + "-" * r.randint(0, 9), f" {post}"
        out.append({"text": before + value + after, "secret": value, "ok": i % 2 == 1})
    return out


def train(spark: SparkSession, findings: list[dict] | None = None) -> list:
    """Trees fitted on labelled findings, by the features that the scan computes."""
    rows = (findings if findings is not None else labelled_findings())[:FINDINGS]
    df = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,secret:string,ok:boolean>>")).alias("r")).select("r.*")
    at = F.instr("text", F.col("secret"))
    before = F.substr("text", F.greatest(at - BEFORE, F.lit(1)), F.least(F.lit(BEFORE), at - 1))
    after = F.substr("text", at + F.length("secret"), F.lit(AFTER))
    got = df.where(at > 0).select(F.array(*features(F.col("secret"), before, after)).alias("f"), "ok", "secret", "text").collect()
    got.sort(key=lambda r: (r["text"], r["secret"]))
    if not got:
        return [1.0]
    return fit(np.array([r["f"] for r in got]), np.array([int(r["ok"]) for r in got]))


def scored(text: Column, trees: list, name: str = "found") -> tuple[Column, Column]:
    """Two columns to add in turn: the candidates, and struct secret, start, score of every occurrence that counts as a secret."""
    judged = F.expr(f"filter(transform({name}_c, x -> named_struct('secret', x.secret, 'start', x.start, 'score', round({forest_sql(trees)}, 6))), x -> x.score >= 0.5D)")
    return candidates(text).alias(f"{name}_c"), judged.alias(name)


def hashed(names: Column) -> Column:
    """Distinct strings in about the square root of their count of buckets, by hash."""
    n = F.ceil(F.sqrt(F.size(names))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.filter(names, lambda x: F.pmod(F.xxhash64(x), F.greatest(n, F.lit(1))) == b))


def within(buckets: Column, x: Column) -> Column:
    return F.array_contains(F.get(buckets, F.pmod(F.xxhash64(x), F.size(buckets)).cast("int")), x)


def firsts(rows: Column) -> Column:
    """Of structs sorted by secret, the first of each, with its place i in the array."""
    numbered = F.transform(rows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.filter(numbered, lambda x, i: (i == 0) | (x["x"]["secret"] != F.get(rows, i - 1)["secret"]))


def places(t: Column, buckets: Column) -> Column:
    """Sorted distinct structs secret, start of all places of the secrets in hashed buckets."""

    def of(pattern: str, group: int) -> Column:
        def at(m: Column) -> Column:
            sizes = F.zip_with(m["leads"], m["values"], lambda a, b: F.length(a) + F.length(b))
            return let(let(sizes, starts), lambda s: F.transform(m["values"], lambda v, i: F.struct(v.alias("secret"), (F.get(s, i) + F.length(F.get(m["leads"], i))).alias("start"))))

        return F.filter(let(matches(t, pattern, group), at), lambda x: within(buckets, x["secret"]))

    # array_distinct compares all pairs of structs
    return let(F.sort_array(F.concat(of(CANDIDATE, 0), of(ASSIGNED, 1), of(WORD, 0))), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def findings(t: Column, found: Column) -> Column:
    """Array of secret, start, score and count, one for each secret of a text."""

    def counted(p: Column) -> Column:
        def ends(f: Column) -> Column:
            return F.transform(f, lambda x, i: F.coalesce(F.get(f, i + 1)["i"], F.size(p)) - x["i"])

        # both are sorted by secret and hold the same ones
        first = let(F.sort_array(found), firsts)
        return F.zip_with(first, let(firsts(p), ends), lambda x, n: F.struct(x["x"]["secret"].alias("secret"), x["x"]["start"].alias("start"), x["x"]["score"].alias("score"), n.alias("count")))

    names = F.array_distinct(F.transform(found, lambda x: x["secret"]))
    none = F.array().cast("array<struct<secret:string,start:int,score:double,count:int>>")
    return F.when(F.size(found) > 0, let(let(let(names, hashed), lambda b: places(t, b)), counted)).otherwise(none)


def marked(t: Column, found: Column) -> Column:
    """The text with a mark at every place of its secrets: assigned values first, then whole words, then runs."""

    def without(text: Column, buckets: Column, pattern: str, group: int) -> Column:
        def join(m: Column) -> Column:
            return F.concat(F.array_join(F.zip_with(m["leads"], m["values"], lambda a, v: F.concat(a, F.when(within(buckets, v), F.lit(MARK)).otherwise(v))), ""), m["tail"])

        return let(matches(text, pattern, group), join)

    def all_of(b: Column) -> Column:
        return let(let(without(t, b, ASSIGNED, 1), lambda x: without(x, b, WORD, 0)), lambda x: without(x, b, CANDIDATE, 0))

    names = F.array_distinct(F.transform(found, lambda x: x["secret"]))
    return F.when(F.size(found) > 0, let(let(names, hashed), all_of)).otherwise(t)


def _with_found(df: DataFrame, text: str, trees: list, keep: list[Column]) -> DataFrame:
    c, s = scored(F.col("__t"), trees, "__found")
    return df.select(*keep, F.col(text).cast("string").alias("__t")).select("*", c).select("*", s).drop("__found_c")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", trees: list | None = None) -> DataFrame:
    """key, start, length, count, secret_sha256 and score of each secret."""
    trees = train(df.sparkSession) if trees is None else trees
    found = _with_found(df, text, trees, [F.col(key).alias("__k")])
    # a filter before the explode would be pushed to the scan and judge every text twice
    got = found.select("__k", F.explode_outer(findings(F.col("__t"), F.col("__found"))).alias("s")).where(F.col("s").isNotNull())
    return got.select(F.col("__k").alias(key), F.col("s.start").cast("long").alias("start"), F.length("s.secret").cast("long").alias("length"), F.col("s.count").cast("long").alias("count"), F.sha2("s.secret", 256).alias("secret_sha256"), F.col("s.score").alias("score"))


def redact(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", trees: list | None = None) -> DataFrame:
    """df with a mark at every place of a secret; all rows and columns stay."""
    trees = train(df.sparkSession) if trees is None else trees
    names = df.columns
    got = _with_found(df, text, trees, [F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")])
    got = got.select("__row", F.size("__found").alias("__n"), marked(F.col("__t"), F.col("__found")).alias("__clean"))

    def out(c: str) -> Column:
        was = F.col(f"__row.`{c}`")
        if c == text:
            return F.col("__clean").alias(c)
        if c == n_chars:
            return F.when(F.col("__n") > 0, F.length("__clean").cast(df.schema[c].dataType)).otherwise(was).alias(c)
        return was.alias(c)

    return got.select(*(out(c) for c in names))
