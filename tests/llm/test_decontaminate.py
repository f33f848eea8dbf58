"""Retrieval against scoring every passage with every segment."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reelflow.llm import decontaminate as D
from reelflow.llm.common import read, tokens
from tests.conftest import SF

ITEMS = "item_id long, text string"


def brute(docs, items):
    """(doc, item, score) of all verified retrievals, without index or bounds."""
    segments = []
    for i, t in items:
        w = tokens((t or "").encode())
        segments += [(i, w[k : k + D.SEGMENT]) for k in range(0, len(w), D.SEGMENT)]
    n, mean = len(segments), sum(len(s) for _, s in segments) / len(segments)
    df = Counter(w for _, s in segments for w in set(s))
    weights = []
    for _, s in segments:
        tf = Counter(s)
        own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w in tf}
        total = sum(own.values())
        weights.append({w: v / total for w, v in own.items()})
    out = {}
    for d, t in docs:
        w = tokens((t or "").encode())
        runs = {k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in range(1, 6)}
        share = lambda part: (lambda k: sum(tuple(part[j : j + k]) in runs[k] for j in {tuple(part[j : j + k]): j for j in range(len(part) - k + 1)}.values()) / len({tuple(part[j : j + k]) for j in range(len(part) - k + 1)}))(min(5, len(part))) if part else 1.0
        best = {}
        for at in range(0, len(w), D.SEGMENT):
            passage = set(w[at : at + 2 * D.SEGMENT])
            for (i, _), own in zip(segments, weights, strict=True):
                score = sum(v for x, v in own.items() if x in passage)
                if score >= D.THRESHOLD - 1e-9:
                    best[i] = max(best.get(i, 0), score)
        for i, score in best.items():
            question, answer = D.question_and_answer(dict(items)[i].encode())
            if share(question) >= 0.5 and share(answer) >= 0.5:
                out[d, i] = round(score, 6)
    return out


def found(df):
    return {(r.doc_id, r.item_id): r.score for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    got = found(D.contaminated(docs, items))
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_cases(spark, docs, prose, monkeypatch):
    question = prose(1, 40) + ". " + prose(2, 12) + "."
    long = prose(3, 300) + "? " + prose(4, 40) + "."
    items = spark.createDataFrame([(1, question), (2, long), (3, None), (4, ""), (5, "..."), (6, question), (7, "yes")], ITEMS)
    noise = prose(9, 500)
    table = docs(
        noise, noise + " " + question + " " + noise, noise + question.upper().replace(" ", "\n"), prose(1, 40) + " " + noise,
        prose(2, 12) + " " + noise, noise + " " + long, None, "", long[: len(long) // 3], (None, question),
    ).withColumn("item_id", F.lit("clash"))
    out = D.contaminated(table, items)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1, 1), (1, 6), (2, 1), (2, 6), (5, 2), (None, 1), (None, 6)}
    clean = D.clean(table, items)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == [0, 3, 4, 6, 7, 8]
    monkeypatch.setattr(D, "INDEX_CHARS", 600)  # several indexes find the same
    assert found(D.contaminated(table, items)) == found(out)
    assert D.contaminated(docs(), items).collect() == []
    assert D.contaminated(table, items.limit(0)).collect() == []
    assert D.clean(table, items.limit(0)).count() == 10


def test_retrieve_skips_nothing():
    """Block bounds never exclude an entry that reaches the threshold."""
    r = np.random.default_rng(3)
    words = [f"w{k}".encode() for k in range(60)]
    rows = [(i, 0, w, float(r.random())) for i in range(40) for w in r.choice(words, 12, replace=False)]
    index = D.Index.build(rows, [(i, b"") for i in range(40)])
    for _ in range(200):
        own = sorted(r.choice(60, 25, replace=False).tolist())
        numbers = np.array([index.terms[words[k]] for k in own if words[k] in index.terms])
        scores = np.zeros(40)
        for t in numbers:
            at = slice(index.starts[t], index.starts[t + 1])
            scores[index.entries[at]] += index.scores[at]
        want = set(np.flatnonzero(scores >= D.THRESHOLD).tolist())
        likely = D.likely_passages(index, numbers, np.zeros(len(numbers), np.int64), np.array([True, False]))
        got = set()
        for _, block in likely.tolist():
            got |= set(D.retrieve(index, np.unique(numbers).tolist(), block))
        assert got == want


def test_null_and_repeated_ids(spark, docs, prose):
    """Items that share an id, or have none, are found each by its own text."""
    texts = [prose(20 + k, 40) + ". " + prose(40 + k, 12) + "." for k in range(5)]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (1, texts[0])], ITEMS)
    noise = prose(9, 300)
    table = docs(*[noise + " " + t + " " + noise for t in texts], texts[0] + " " + texts[1], noise)
    got = sorted((r.doc_id, str(r.item_id)) for r in D.contaminated(table, items).collect())
    assert got == [(0, "1"), (1, "1"), (2, "None"), (3, "None"), (4, "None"), (5, "1"), (5, "1")]
    assert [r.doc_id for r in D.clean(table, items).collect()] == [6]
