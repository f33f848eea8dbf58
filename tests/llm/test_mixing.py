"""Raking against its targets; the SQL is compared in test_registry."""

import math

import pytest
from pyspark.sql import functions as F

from reelflow.llm import mixing as M


def test_margins_meet_their_targets(spark):
    rows = []
    for k in range(3000):
        n = 20 + (k * 37) % 300
        rows.append((k, " ".join(["wort"] * n) + (" license" if k % 5 == 0 else ""), ["en", "de", "fr"][k % 3 if k % 2 else 0], f"s{k % 7 if k % 4 else 0}", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = M.mixed(docs, languages={"en": 0.5, "de": 0.25, "fr": 0.25}).cache()
    total = out.agg(F.sum("n_tokens")).first()[0]
    by_lang = {r.lang: r.w / total for r in out.groupBy("lang").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("w")).collect()}
    assert by_lang == pytest.approx({"en": 0.5, "de": 0.25, "fr": 0.25}, abs=0.01)
    sources = {r.source: (r.w / total, math.sqrt(r.n)) for r in out.groupBy("source").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("w"), F.sum("n_tokens").alias("n")).collect()}
    roots = sum(r for _, r in sources.values())
    assert {k: w for k, (w, _) in sources.items()} == pytest.approx({k: r / roots for k, (_, r) in sources.items()}, rel=1e-4)
    expected = out.agg(F.sum(F.col("probability") * F.col("n_tokens"))).first()[0]
    assert expected == pytest.approx(M.BUDGET * total, rel=0.01)
    kept = out.where("kept").agg(F.sum("n_tokens")).first()[0]
    assert kept == pytest.approx(M.BUDGET * total, rel=0.1)


def test_cases(docs, spark):
    table = docs("a b c", None, "", (None, "d e"), (0, "a b c"), "x " * 30_000).withColumn("topic", F.lit("clash")).withColumn("mix", F.lit(1))
    table = table.withColumn("lang", F.when(F.col("doc_id") != 1, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    out = M.mixed(table).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == 0 and by[1].lang == "(none)" and by[2].source == "(none)" and not by[1].kept
    assert by[5].topic == "long" and by[None].n_tokens == 2
    kept = M.sampled(table)
    assert kept.columns == [c for c in table.columns if c != "mix"] + ["mix"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    assert M.mixed(docs()).collect() == [] and M.sampled(docs()).collect() == []
    assert [r.kept for r in M.mixed(docs("", None)).collect()] == [False, False]
