"""Fingerprints against signatures made in Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from reelflow.llm import spotsigs as S
from reelflow.llm.common import read
from tests.conftest import SF


def signatures(text):
    words = [w for w in re.split(r"[\s.,;:!?\"'()]+", text.lower()) if w]
    found = set()
    for k, w in enumerate(words):
        if w in S.ANCHORS:
            chain = []
            for x in words[k + 1 :]:
                if x not in S.ANCHORS:
                    chain.append(x)
                if len(chain) == S.CHAIN:
                    found.add((w, *chain))
                    break
    return found or ({text} if text else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own = signatures(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(own, signatures(edited)), alike(own, signatures(after)), len(own)))
    return sorted(out, key=str)


def found(df):
    columns = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "n_signatures"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("size", [256, 7])
def test_whole_table_equals_python(spark, monkeypatch, size):
    monkeypatch.setattr(S, "PART_ROWS", size)  # many parts: each one's last row meets the next part's first
    table = read(spark, SF, "documents")
    assert found(S.fingerprints(table)) == brute([tuple(r) for r in table.select("doc_id", "text").collect()])


def test_cases(docs):
    table = docs("The cat sat on a mat", None, "", "x", "the the the", (-5, "é the 😀 b"), (10**15, "the one two"), (10**15, "the one two"), (None, "the n m"),
                 "the cat " * 10_000).withColumn("part", F.lit("clash")).withColumn("moved", F.lit(5))
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    out = S.fingerprints(table)
    assert found(out) == brute(rows)
    prints = {r.fingerprint for r in out.collect() if r.doc_id == 10**15}
    assert len(prints) == 1
    assert found(S.fingerprints(docs("the only one here"))) == brute([(0, "the only one here")])
    assert S.fingerprints(docs()).collect() == []


def test_only_column_expressions(docs):
    plan = S.fingerprints(docs("the a b c", "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_links_equal_all_pairs(spark, docs, prose):
    base = prose(1, 200).split()
    texts = []
    for k in range(25):
        w = [("the " + x if n % 3 == 0 else x) for n, x in enumerate(base)]
        for j in range(k):
            w[(j * 17 + k) % 200] = f"new{k}{j}"
        texts.append(" ".join(w))
    texts += [texts[0].upper(), "", prose(3, 50)]
    sets = [signatures(t) for t in texts]
    parent = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and alike(sets[a], sets[b]) >= 0.75:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs(*texts)).collect()}
    assert got == dict(enumerate(parent)) and len(set(parent)) < len(parent) - 3
    assert S.near_duplicates(docs()).collect() == []
