import random

import numpy as np
import pytest

from reelflow.llm import periodic as P


def brute(words):
    """Runs by comparing all words at each distance."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 4)):
            n, kinds = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
            words = [r.randrange(kinds) for _ in range(n)]
            if n and r.random() < 0.5:
                a, p = r.randrange(n), r.randint(1, max(1, n // 3))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        words = np.array([w for t in texts for w in t], np.int64)
        doc = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in brute(t)]
            at += len(t)
        assert P.word_runs(words, doc) == want


def test_long_texts_are_fast_enough():
    n = 100_000
    assert P.word_runs(np.zeros(n, np.int64), np.zeros(n, np.int64)) == [(0, n, 1)]
    assert P.word_runs(np.arange(n) % 7, np.zeros(n, np.int64)) == [(0, n, 7)]


def test_rows_of_all_kinds(spark, docs, prose):
    texts = [None, "", " \t\n", "a", "x y " * 3 + "x y z", "a a a a a a", "é é\né é é é", (None, "b " * 6), (7, "b " * 6), (7, "b " * 6), prose(1, 300) + " q" * 40_000 + " r"]
    rows = P.periodic_runs(docs(*texts).selectExpr("*", "1 as runs", "'x' as collapsed", "2 as n_words")).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    for k, t in enumerate(texts):
        if isinstance(t, tuple):
            continue
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]
        got = by_id[k]
        assert [(r.start, r.length, r.period) for r in got.runs] == (brute(words) if len(words) < 1000 else [(300, 40_000, 1)])
        assert got.n_words == len(words) and (len(words) > 1000 or got.collapsed == collapse(words, brute(words)))
    assert by_id[None].collapsed == "b" and sum(r.doc_id == 7 for r in rows) == 2
    assert P.periodic_runs(docs()).collect() == []


def test_planted_tails_are_found(docs, prose):
    """Texts whose checksum asks for it end in a run at the planted place; the others are left alone."""
    import zlib

    source = docs(*[prose(k, 200) for k in range(80)], (None, prose(99, 30)))
    edited = {r.doc_id: r.text for r in P.with_repeated_tails(source).collect()}
    found = {r.doc_id: r for r in P.digests(P.periodic_runs(P.with_repeated_tails(source))).collect()}
    planted = 0
    for k in range(80):
        h = zlib.crc32(str(k).encode())
        if h % 10:
            assert edited[k] == prose(k, 200)
            continue
        planted += 1
        g = h // 10
        a, p = g % 200, 1 + (200 - g % 200) // (3 + g % 8)
        words = prose(k, 200).split()
        want = [words[i] if i < a else words[a + (i - a) % p] for i in range(200)]
        assert edited[k].split() == want
        runs = brute(want)
        assert found[k].n_runs == len(runs)
        if runs:
            s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            assert (found[k].start, found[k].length, found[k].period, found[k].exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert found[k].start is found[k].length is found[k].period is found[k].exponent_milli is None
    assert planted and edited[None] == prose(99, 30)
