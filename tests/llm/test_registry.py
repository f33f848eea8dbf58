"""Registered queries against SQL, and the pipeline against its stages done plainly."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline as P
from reelflow.llm import registry
from reelflow.llm import mixing, toxicity
from reelflow.llm.common import read
from tests.conftest import SF
from tests.llm.test_minhash import brute as copies
from tests.llm.test_secrets import plain


def test_one_query_for_each_operator():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_pipeline_stages(spark, tmp_path):
    """Each stage's rows from its predecessor's, by brute force where the stage decides on rows."""
    docs = read(spark, SF, "documents").cache()
    outs, now = [], docs
    for _, stage in P.STAGES:
        now = stage(spark, now, SF).cache()
        outs.append(now)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert all(o.columns == docs.columns for o in outs[:-1])
    toxic = {r.doc_id for r in toxicity.grades(docs, read(spark, SF, "labels")).where("toxic").collect()}
    assert toxic and ids(outs[0]) == ids(docs) - toxic
    assert ids(outs[1]) == {i for i, (_, c) in copies(texts(outs[0]).items()).items() if i == c}
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    holds = {i for i, t in texts(outs[1]).items() if any(x in t for x in items)}
    assert holds and ids(outs[2]) == ids(outs[1]) - holds
    before, after = texts(outs[2]), texts(outs[3])
    assert ids(outs[3]) == ids(outs[2])
    for i, t in before.items():
        assert (after[i] == t) == (plain(t) == "" and "[SECRET]" not in after[i])
        assert plain(after[i]) == ""
    drawn = mixing.mixed(outs[3]).where("kept")
    assert ids(outs[4]) == ids(drawn) and outs[4].columns == [*docs.columns, "mix"]
    assert sorted(P.run(spark, SF).select("doc_id", "text").collect()) == sorted(outs[4].select("doc_id", "text").collect())


def test_pipeline_of_nothing(spark):
    now = read(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        now = stage(spark, now, SF)
    assert now.collect() == []


def test_pipeline_meets_odd_rows(spark):
    odd = read(spark, SF, "documents").limit(30).withColumn("toxic", F.lit("clash")).withColumn("document", F.lit(1)).withColumn("digest", F.lit(2))
    nulls = odd.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in odd.dtypes])
    now = odd.union(odd.limit(3)).union(nulls)
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == odd.columns
    assert now.where("doc_id is null").count() == 2 and now.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    P.STAGES[-1][1](spark, now, SF).collect()
