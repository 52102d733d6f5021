"""URL filter by a character language-model ratio, in DataFrame functions only.

Two variable-order Markov models, of accepted and of rejected URLs, give
log P(next symbol | context) with Witten-Bell interpolation: a context that was
not seen hands over to the one shorter by a symbol. The mean difference of the
logarithms over a URL's symbols is calibrated on labelled URLs and filtered.

Characters map to 32 symbols, so that the two models fit a table of 32**3
cells, whose size does not depend on the data. Counting collapses to these
cells before the shuffle.

Defined results: a null URL or one without :// has empty host and path; no
labelled URL of a class means ratio 0 and threshold 0, that is, everything is
allowed; a score that equals the threshold is allowed; equal URLs get equal verdicts, each row its
own; URLs of any length are scored whole; of rules of equal length that fit, the later in the
list counts; columns beside url and those in keep are not read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols: a-z are 0 to 25, digits 26, then . / - = and all others.
BASE, ORDER = 32, 3
DEFAULT_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what lies after the first :// up to / ? # and from there up to ? #."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def codes(url: Column) -> Column:
    """Array of the 3-symbol codes that end at each character of the URL."""
    low = lower_ascii(F.coalesce(url.cast("string"), F.lit("")))
    low = F.regexp_replace(low, r"^[a-z0-9+.-]*://", "")
    mapped = F.translate(F.regexp_replace(F.regexp_replace(low, "[0-9]", "0"), "[^a-z0./=-]", "~"), "0./=-~", "ABCDEF")
    # a..z, A..F are 97..122 and 65..70: symbol = code - 97, or code - 65 + 26
    sym = F.transform(F.split(F.concat(F.lit("FF"), mapped), ""), lambda c: F.when(F.ascii(c) >= 97, F.ascii(c) - 97).otherwise(F.ascii(c) - 39))
    at = F.when(F.length(mapped) > 0, F.sequence(F.lit(1), F.length(mapped))).otherwise(F.array().cast("array<int>"))

    return _let(sym, lambda s: F.transform(at, lambda i: (s[i - 1] * BASE + s[i]) * BASE + s[i + 1]))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dense(n: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def _total(n: int, f) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda a, i: a + f(i))


def _log_p(counts: Column) -> Column:
    """log P of each code, from the counts of all 32**3 codes, by interpolation from the shortest context up."""

    def level(k: int, by_order: dict[int, Column], p: Column) -> Column:
        if k > ORDER:
            return F.transform(p, F.ln)
        c, size = by_order[k], BASE ** (k - 1)

        def mix(s: Column, t: Column) -> Column:
            def one(g: Column) -> Column:
                x, low = F.floor(g / BASE).cast("int"), p[F.pmod(g, F.lit(size))]
                return F.when(s[x] > 0, (c[g] + t[x] * low) / (s[x] + t[x])).otherwise(low)

            return _let(_dense(BASE**k, one), lambda q: level(k + 1, by_order, q))

        seen = _dense(size, lambda x: _total(BASE, lambda i: c[x * BASE + i]))
        kinds = _dense(size, lambda x: _total(BASE, lambda i: F.when(c[x * BASE + i] > 0, 1).otherwise(0)))
        return _let(seen, lambda s: _let(kinds, lambda t: mix(s, t)))

    def shorter(k: int, by_order: dict[int, Column]) -> Column:
        if k == 0:
            return _let(F.array(F.lit(1.0 / BASE)), lambda p: level(1, by_order, p))
        up = by_order[k + 1]
        return _let(_dense(BASE**k, lambda g: _total(BASE, lambda i: up[i * BASE**k + g])), lambda c: shorter(k - 1, {**by_order, k: c}))

    return shorter(ORDER - 1, {ORDER: counts})


def fit(labelled: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame:
    """One row: ratio, an array of 32**3 log-probability differences, one for each code.

    labelled: URLs with a boolean (null: ignored). All rows count.
    """
    grams = labelled.where(F.col(accepted).isNotNull()).select(F.col(accepted).alias("ok"), F.explode(codes(F.col(url))).alias("code"))
    seen = grams.groupBy("code").agg(F.count_if("ok").alias("n1"), F.count_if(~F.col("ok")).alias("n0"))
    # at most 32**3 entries, whatever the input
    one = seen.agg(F.sort_array(F.collect_list(F.struct("code", "n0", "n1"))).alias("seen"))

    def spread(n: str) -> Column:
        """The sorted counts with zeros between them."""
        ends = F.concat(F.transform(F.col("seen"), lambda s: s["code"]), F.array(F.lit(BASE**ORDER)))
        blocks = F.transform(ends, lambda e, i: F.concat(F.array_repeat(F.lit(0).cast("long"), e - F.when(i > 0, ends_at(i - 1) + 1).otherwise(0)), F.when(e < BASE**ORDER, F.array(F.col("seen")[i][n])).otherwise(F.array().cast("array<long>"))))
        return F.flatten(blocks)

    def ends_at(i: Column) -> Column:
        return F.col("seen")[i]["code"]

    has = F.exists(F.col("seen"), lambda s: s["n0"] > 0) & F.exists(F.col("seen"), lambda s: s["n1"] > 0)
    both = _let(spread("n0"), lambda n0: _let(spread("n1"), lambda n1: _let(_log_p(n0), lambda p0: _let(_log_p(n1), lambda p1: F.zip_with(p1, p0, lambda a, b: (a - b).cast("float"))))))
    return one.select(F.when(has, both).otherwise(F.array_repeat(F.lit(0.0).cast("float"), BASE**ORDER)).alias("ratio"))


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = DEFAULT_RULES, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict and score of every row.

    URLs that a rule fits are the labelled ones. Nine tenths of them, by a hash of the URL, fit the
    models; on the others the threshold is set as many standard deviations
    from the mean of either class.
    """
    host, path = parts(F.col(url))
    base = df.select(*keep, F.col(url).cast("string").alias("u"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    base = base.withColumns({"accepted": F.col("by_rule") == "allow", "held_out": F.conv(F.substring(F.md5("u"), 1, 8), 16, 10).cast("long") % 10 == 0})
    model = fit(base.where(~F.col("held_out")), "u")
    # one row of a fixed size
    scored = base.crossJoin(F.broadcast(model)).withColumn("code", codes(F.col("u")))
    total = F.aggregate(F.col("code"), F.lit(0.0), lambda a, c: a + F.col("ratio")[c])
    scored = scored.withColumn("score", F.round(total / F.greatest(F.size("code"), F.lit(1)), 6)).drop("ratio", "code")
    held = scored.where(F.col("held_out") & F.col("accepted").isNotNull())
    m = held.agg(*(f(F.when(F.col("accepted") == ok, F.col("score"))).alias(f"{n}{int(ok)}") for ok in (True, False) for n, f in (("m", F.avg), ("d", F.stddev_pop))))
    spread = F.col("d0") + F.col("d1")
    threshold = F.when(spread > 0, (F.col("m1") * F.col("d0") + F.col("m0") * F.col("d1")) / spread).otherwise((F.col("m0") + F.col("m1")) / 2)
    cut = m.select(F.coalesce(F.round(threshold, 6), F.lit(0.0)).alias("threshold"))
    out = scored.crossJoin(F.broadcast(cut))
    return out.select(*keep, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"), "score")
