"""Held-out accuracy, the likelihood's optimum, and defined cases."""

import numpy as np
from pyspark.sql import functions as F

from reelflow.llm import toxicity as T
from reelflow.llm.common import read


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    out = T.grades(docs, labels.where(half)).join(labels.where(~half).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    positive = [r for r in out if r.y]
    assert sum(r.toxic for r in positive) >= 0.9 * len(positive)
    assert sum(r.toxic for r in out if not r.y) <= 0.005 * (len(out) - len(positive))


def test_weights_are_shared_and_ordered():
    r = np.random.default_rng(1)
    x = [sorted(r.integers(0, 4, r.integers(0, 4)).tolist()) for _ in range(600)]
    true = np.array([2.0, 1.0, 0.0, -1.0])
    score = np.array([true[f].sum() if f else 0.0 for f in x]) + r.logistic(size=600)
    grades = np.digitize(score, [0.5, 2.0])
    weights, limits = T.fit_ordinal(x, grades, 4)
    assert limits[0] < limits[1]
    assert weights[0] > weights[1] > weights[2] > weights[3]

    def loss(w, t):
        s = np.array([np.sum(np.array(w)[f]) if f else 0.0 for f in x])
        cut = np.concatenate(([-np.inf], t, [np.inf]))
        sig = lambda v: 1 / (1 + np.exp(-v))
        return -np.log(sig(cut[grades + 1] - s) - sig(cut[grades] - s)).sum() + 0.5 * T.RIDGE * np.square(w).sum()

    best = loss(weights, limits)
    for k in range(4):
        for d in (-0.02, 0.02):
            assert loss([w + d * (j == k) for j, w in enumerate(weights)], limits) > best - 1e-3


def test_cases(spark, docs, prose):
    rude = [prose(k, 60) + (" vilewort " if k % 3 else " ") + prose(k + 500, 20) + (" foulname" if k % 3 != 1 else "") for k in range(30)]
    fine = [prose(k + 1000, 80) for k in range(60)]
    table = docs(*rude, *fine, None, "", (None, "a vilewort"), "VILEWORT! " * 3, prose(7, 20_000), (0, rude[0])).withColumn("toxic", F.lit("clash"))
    labels = labelled(spark, [(k, 1) for k in range(30)] + [(30 + k, 0) for k in range(60)] + [(None, 1), (5, None), (9999, 1)])
    out = T.grades(table, labels).collect()
    assert len(out) == 96
    by = {r.doc_id: r for r in out}
    assert all(by[k].toxic and by[k].expected_severity > 0.5 for k in range(30))
    assert not any(by[k].toxic for k in range(30, 90))
    assert by[90].expected_severity == by[91].expected_severity and not by[90].toxic
    assert by[None].toxic and by[93].toxic and not by[94].toxic
    clean = T.clean(table, labels)
    assert clean.columns == table.columns and clean.count() == 63
    none = T.grades(table, labels.limit(0)).collect()
    assert len(none) == 96 and not any(r.toxic or r.expected_severity for r in none)
    assert T.grades(docs(), labels).collect() == []
