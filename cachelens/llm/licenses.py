"""License scan: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages of a text that hold a licence cue meet an inverted index of template
terms; their weights are tf * idf, with document frequencies over all passages of the
corpus and the templates, and the best cosine of LEAST or more names the licence.
A file with its own passage keeps that licence. Others take that of the nearest
directory above them that holds a licence file: one whose words are mostly its
licence passage, or whose whole text is like one of license_texts (cosine WHOLE_LEAST or more of
its terms, without a cut at lines or cues; weights by document frequencies over those
texts); such a match also decides the file's own licence. Directories resolve once, files then join their own directory.

Defined results: null and empty texts have no passage; ties go to the smaller licence id;
a directory with several licence files takes its best, then the smaller id; a file without
a path, or without a licence above it, has licence null and origin `none`; repeated rows and keys are
files of their own in scan(), whereas detect() takes a key for one file; texts of any length are
read whole; columns beside those named are not read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Licence names, headers and opening sentences, in public wording.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
CUE = r"(?i)licen[sc]e|permission (?:is|to)|redistribution|public domain|free software|source code form"
LEAST, FILE_SHARE, WHOLE_LEAST = 0.5, 0.5, 0.7
TERM = r"[^a-z0-9.]+|\.(?![0-9])"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda w: w != "")


def passages(text: Column) -> Column:
    """Sentences that hold a cue: lines are cut after a stop that a space and a capital follow."""
    return F.filter(F.split(text, r"\n+|(?<=[.;!?])[ \t]+(?=[A-Z])"), lambda p: p.rlike(CUE))


def template_terms(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{lic}', {i}, '{t.replace(chr(39), '')}')" for lic, ts in TEMPLATES.items() for i, t in enumerate(ts))
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, variant, text)")
    return df.select("license", "variant", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "variant", "term").agg(F.count("*").alias("tf"))


def whole_texts() -> dict[str, str]:
    """Whole licence texts by licence."""
    return {f.name.removesuffix(".txt"): f.read_text() for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def detect_whole(base: DataFrame) -> DataFrame:
    """k, license and score of the files (k, w: their terms) that are like a whole licence text."""
    tfs = {lic: Counter(w for w in re.split(TERM, t.lower()) if w) for lic, t in whole_texts().items()}
    df = Counter(w for tf in tfs.values() for w in tf)
    idf = {w: math.log1p(len(tfs) / n) for w, n in df.items()}
    rows = []
    for lic, tf in tfs.items():
        b = {w: (1 + math.log(n)) * idf[w] for w, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in b.values()))
        rows += [(lic, w, x / norm) for w, x in b.items()]
    spark = base.sparkSession
    weights = spark.createDataFrame(list(idf.items()), "term string, idf double")
    tpl = spark.createDataFrame(rows, "license string, term string, b double")
    tf = base.select("k", F.explode("w").alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf"))
    a = tf.join(F.broadcast(weights), "term", "left").select("k", "term", ((1 + F.ln("tf")) * F.coalesce("idf", F.lit(math.log1p(len(tfs))))).alias("a"))  # both: the texts' terms
    na = a.groupBy("k").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"))
    dots = a.join(F.broadcast(tpl), "term").groupBy("k", "license").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    cos = dots.join(na.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).select("k", "license", F.round(F.least(F.col("dot") / F.col("na"), F.lit(1.0)), 6).alias("score"))
    return cos.where(F.col("score") >= WHOLE_LEAST)


def parsed(text: Column) -> tuple[Column, Column]:
    """Terms and passages (id, terms) of a text; null without a cue."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    found = F.transform(passages(t), lambda p: F.struct(F.md5(p).alias("id"), terms(p).alias("w")))
    return F.when(t.rlike(CUE), terms(t)), F.when(t.rlike(CUE), found)


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, license, score and share (of the text's words that lie in licence passages) for keys with a licence of their own; a key names one file."""
    w, p = parsed(F.col(text))
    base = stored(df.select(F.col(key).alias("k"), w.alias("w"), p.alias("p")).where("w is not null"), "passages")
    return matched(base).withColumnRenamed("k", key)


def matched(base: DataFrame) -> DataFrame:
    """k, license, score and share of the files of a stored table k, w, p (terms and passages) that have a licence of their own."""
    spark = base.sparkSession
    found = base.select("k", F.greatest(F.size("w"), F.lit(1)).alias("words"), F.explode("p").alias("x")).select("k", "words", "x.id", F.col("x.w").alias("w"))
    # a passage that many texts share is weighed once
    unique = found.groupBy("id").agg(F.first("w").alias("w"), F.count("*").alias("copies"))
    tf = unique.select("id", "copies", F.explode("w").alias("term")).groupBy("id", "copies", "term").agg(F.count("*").alias("tf"))
    tf = stored(tf, "tf")
    tpl = template_terms(spark)
    n_tpl = sum(map(len, TEMPLATES.values()))
    df_all = tf.groupBy("term").agg(F.sum("copies").alias("df")).unionByName(tpl.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    total = found.agg((F.count("*") + n_tpl).alias("n"))
    idf = df_all.crossJoin(F.broadcast(total)).select("term", (F.log1p(F.col("n") / F.col("df"))).alias("idf"))  # total: one row
    idf = stored(idf, "idf")
    weight = (1 + F.ln("tf")) * F.col("idf")
    a = tf.join(idf, "term").select("id", "term", weight.alias("a"))
    b = tpl.join(idf, "term").select("license", "variant", "term", weight.alias("b"))
    na = a.groupBy("id").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"))
    nb = b.groupBy("license", "variant").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    dots = a.join(F.broadcast(b), "term").groupBy("id", "license", "variant").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))  # b: the templates' terms
    cos = dots.join(na, "id").join(F.broadcast(nb), ["license", "variant"]).select("id", "license", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("score")).where(F.col("score") >= LEAST)
    best = cos.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m")).select("id", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))
    best = stored(best, "best")
    hit = found.select("k", "words", "id", F.size("w").alias("len")).join(best, "id")
    lines = hit.groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"), (F.sum("len") / F.max("words")).alias("share")).select("k", F.lit(1).alias("by"), F.col("m.s").alias("s"), F.col("m.license").alias("license"), "share")
    whole = detect_whole(base).select("k", F.lit(0).alias("by"), (-F.col("score")).alias("s"), "license", F.lit(1.0).alias("share"))
    both = whole.unionByName(lines).groupBy("k").agg(F.min(F.struct("by", "s", "license")).alias("m"), F.max("share").alias("share"))
    return both.select("k", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"), F.least("share", F.lit(1.0)).alias("share"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(files: DataFrame, own: DataFrame, key: str, path: str = "path", keep: str | None = None) -> DataFrame:
    """key (or keep in its place), path, license, score, origin (own, inherited, none) and license_dir of each file."""
    f = files.select(F.col(key).alias("k"), F.col(keep or key).alias("out"), F.col(path).alias("p"), parent(F.col(path)).alias("dir"))
    o = own.select(F.col(key).alias("k2"), "license", "score", "share")
    f = f.join(o, F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2")
    holders = f.where((F.col("share") >= FILE_SHARE) & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m")).select(F.col("dir").alias("up"), F.col("m.license").alias("dl"))
    f, holders = stored(f, "files"), stored(holders, "holders")  # plain sides of the joins: a holder above very many directories is split by adaptive execution
    dirs = f.where("dir is not null and license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))).alias("u")).select("dir", "u.*")
    near = ups.join(holders, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dl")).alias("m")).select("dir", F.col("m.up").alias("license_dir"), F.col("m.dl").alias("dl"))
    out = f.join(near, "dir", "left")
    return out.select(
        F.col("out").alias(keep or key), F.col("p").alias(path), F.coalesce("license", "dl").alias("license"), "score",
        F.when(F.col("license").isNotNull(), "own").when(F.col("dl").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("license_dir")).alias("license_dir"),
    )


def document_path() -> Column:
    """A tree for documents: source, thousands and two hundreds by doc_id. By a hash of doc_id one of 16 lies in the source's directory, three in that of the thousands, the rest below."""
    d = F.col("doc_id")
    depth = F.pmod(F.crc32(d.cast("string").cast("binary")), F.lit(16))
    thousands = F.when(depth >= 1, F.concat(F.lit("k"), F.floor(d / 1000)))  # concat_ws leaves nulls out
    hundreds = F.when(depth >= 4, F.concat(F.lit("t"), F.floor(d / 200)))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), thousands, hundreds, F.concat(d, F.lit(".txt")))
    return F.when(d.isNotNull(), path)


def document_paths(df: DataFrame) -> DataFrame:
    return df.select("doc_id", document_path().alias("path"))


def scan(df: DataFrame) -> DataFrame:
    """Documents in their tree; rows are told apart by their numbers, so equal and null keys stay files of their own."""
    w, p = parsed(F.col("text"))
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", document_path().alias("path"), w.alias("w"), p.alias("p")), "passages")  # the texts are read once
    own = matched(rows.where("w is not null").select(F.col("row").alias("k"), "w", "p"))
    return inherit(rows.select("row", "doc_id", "path"), own.withColumnRenamed("k", "row"), "row", keep="doc_id")
