"""The corpus pipeline, stage by stage."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from cachelens.llm import langid


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        path = str(tmp_path / name)
        out.write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    before, after = seen["language_id"]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * before.count()
    before, after = seen["near_duplicates"]
    assert 0.8 * before.count() < after.count() < before.count()
    assert before.dropDuplicates(["text"]).join(after, "text", "left_semi").count() == after.count()
    before, after = seen["secret_scan"]
    secret = r'token = "[0-9a-fA-F]{40}"'
    assert before.count() == after.count() and before.where(F.col("text").rlike(f"(?i){secret}")).count() > 0
    assert after.where(F.col("text").rlike(f"(?i){secret}")).count() == 0
    changed = before.alias("b").join(after.alias("a"), "doc_id").where("a.text <> b.text").select(F.col("b.text"), F.col("a.n_chars"), F.col("a.text").alias("now")).collect()
    assert all(re.search(secret, r[0], re.I) for r in changed) and all(r["n_chars"] == len(r["now"]) for r in changed)
    before, after = seen["pack"]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.agg(F.max("sequence_id"), F.sum("length")).first()[1] > 0 and langid.UND == "und"


def test_language_stage_rejects_only_what_has_no_language(spark):
    rows = [(1, "the cat and the dog", "en", "s", 1), (2, "12 34", "en", "s", 1), (3, None, None, "s", None), (4, "", "de", "s", 0), (5, "der Hund und die Katze", "de", "s", 1), (9, "x", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    keep = lambda x: sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, x, "").collect())
    assert set(keep(df)) >= {1, 5} and not set(keep(df)) & {2, 3, 4}
    assert keep(df.withColumn("lang", F.lit(None).cast("string"))) == [1, 5, 9] and keep(df.limit(0)) == []


def test_language_stage_keeps_a_corpus_of_one_language(spark):
    rows = [(i, None if i == 5 else "12 34" if i == 6 else f"the cat and the dog went out {i}", "en" if i % 3 else None, "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()) == [i for i in range(40) if i not in (5, 6)]


def test_language_stage_rejects_noise_and_keeps_the_rest(spark):
    import random

    r = random.Random(6)
    noise = [(10**6 + i, "".join(r.choice(a) for _ in range(500)), None, "s", 500) for i, a in enumerate(("abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "абвгдежзиклмнопрстуфхцчшщэюя"))]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = df.unionByName(spark.createDataFrame(noise, df.schema))
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, both, "").select("doc_id").collect()}
    assert kept == {x["doc_id"] for x in df.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
