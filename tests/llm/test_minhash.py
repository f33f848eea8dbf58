"""Near duplicates against brute force over all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelflow.llm import minhash
from reelflow.llm.common import read
from reelflow.llm.components import components
from reelflow.llm.shingles import WordHashes, shingle_set
from tests.conftest import SF


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    table = read(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert found(minhash.near_duplicates(table)) == brute(rows)


def test_large_group_of_near_copies(docs, prose, monkeypatch):
    """Copies with up to nine changed words: lists are long, so the exact way decides."""
    monkeypatch.setattr(minhash, "SHORT", 4)
    r = random.Random(5)
    base, texts = prose(1, 150).split(), []
    for k in range(80):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"x{k}{r.randrange(50)}"
        texts.append(" ".join(w[: r.choice([150, 150, 140, 120])]))
    texts += [prose(1, 60) + " " + prose(100 + k, 60) for k in range(30)]  # a passage that many share
    rows = list(enumerate(texts))
    assert found(minhash.near_duplicates(docs(*texts))) == brute(rows)


def test_defined_cases(docs, prose):
    long = prose(2, 30_000)
    table = docs(
        "Same words here for all of us", "same  WORDS here\tfor all of us", None, "", " \t\n", "one two", "ONE two", "É a b c d", "é a b c d",
        long, long + " end", (None, "same words here for all of us"), (5, "one two"),
    ).withColumn("v", F.lit(1)).withColumn("component_id", F.lit("clash"))
    out = minhash.near_duplicates(table).collect()
    assert len(out) == 13
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None}
    assert by[0] == (3, 0, True) and by[1] == (3, 0, False)
    assert by[2] == by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[4] == (0, 4, True)
    assert by[5] == (1, 5, True) and by[6] == (1, 5, False)
    assert by[7] == (1, 7, True) and by[8] == (1, 8, True), "only A-Z are lowered"
    assert by[10][1:] == (9, False)
    assert [(r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is None] == [(3, None, True)]
    kept = minhash.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == [(False, i) for i in (0, 2, 3, 4, 5, 7, 8, 9)] + [(True, None)]


def test_empty_table(docs):
    assert minhash.near_duplicates(docs()).collect() == []
    assert minhash.one_of_each(docs()).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \t\né", max_size=12), max_size=5))
def test_shingle_counts(parts):
    text = " ".join(parts)
    assert len(shingle_set(text.encode(), WordHashes())) == len(shingles(text))


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (3, 4), (9, 8)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)]])
def test_components(spark, edges):
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges * 50:
        low = min(parent.get(a, a), parent.get(b, b))
        parent[a] = parent[b] = low
    assert out == {k: v for k, v in parent.items() if k != v}
