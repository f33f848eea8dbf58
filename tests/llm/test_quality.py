import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelflow.llm import quality as Q


def counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    held = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held)


def vector(text):
    n, chars, symbols, lines, repeated = counts(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    letters, words = chars + 250, n + 50
    v = [math.log(letters / words), *(math.log1p(100 * x / of) for x, of in ((symbols, letters), (capitals, letters), (lines, words), (repeated, words)))]
    return [math.floor(x * Q.UNIT + 0.5) for x in v]


def mcd(u):
    """Plain reweighted MCD of integer vectors from the same two starts."""
    x, ridge = np.array(u) / Q.UNIT, np.diag(np.square(list(Q.FLOORS.values())))
    estimate = lambda rows, factor: (rows.mean(0), np.cov(rows.T, bias=True) * factor + ridge)
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def nearest(m, c):
        bins = np.floor(np.log2(d2(m, c) + 2.0**-20) * Q.BINS)
        below = np.array([(bins < b).sum() for b in bins])
        return estimate(x[below < len(x) / 2], Q.consistency(0.5))

    at = lambda q: np.array([sorted(c)[math.ceil(len(c) * q) - 1] for c in x.T])
    starts = [(at(0.5), np.diag(np.square((at(0.75) - at(0.25)) / 1.349)) + ridge), estimate(x, 1.0)]
    best = []
    for start in starts:
        now = nearest(*start)
        while np.linalg.slogdet((step := nearest(*now))[1])[1] < np.linalg.slogdet(now[1])[1] - 1e-9:
            now = step
        best.append(now)
    m, c = min(best, key=lambda e: np.linalg.slogdet(e[1])[1])
    inside = x[d2(m, c) <= Q.quantile(Q.REWEIGHTED, x.shape[1])]
    return d2(*estimate(inside, Q.consistency(Q.REWEIGHTED)))


def test_chi_squared():
    assert Q.quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4) and Q.quantile(0.5, 2) == pytest.approx(2 * math.log(2))
    assert Q.consistency(1 - 1e-12) == pytest.approx(1, abs=1e-6)


def test_counts_equal_brute_force(docs, prose):
    line = prose(3, 12)
    texts = [None, "", "\n\n \t", "a", "a b c d e a b c d e a b c d e", "x " * 30, f"{line}\n{line}\nother\n{line}", "é# ü$%|<>&* Ö", "a b c d\x0be\x0cf\rg", prose(1, 20_000), " ".join(["one two three four five six"] * 2)]
    got = {r.doc_id: r for r in Q.counted(docs(*texts)).collect()}
    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == counts(t), t


def _corpus(prose):
    """(doc_id, text, lang, source): two languages, sources of which one is small, and junk of several kinds."""
    rows, bad = [], set()
    for k in range(260):
        text = ". ".join(s.capitalize() for s in (prose(1000 + 50 * k + j, 9 + (k + j) % 7) for j in range(3 + k % 20)))
        if k % 20 == 7:
            text = " ".join(w + "###" for w in text.split())
            bad.add(k)
        elif k % 20 == 13:
            text = " | ".join(text.split())
            bad.add(k)
        elif k % 20 == 17:
            text = text.upper()
            bad.add(k)
        rows.append((k, text, "en" if k % 3 else "de", "tiny" if k % 26 == 1 else "s"))
    return rows, bad


def test_verdicts_equal_brute_force(spark, prose):
    rows, bad = _corpus(prose)
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    place = lambda r: (r[2], r[3]) if r[3] == "s" else "rest"
    groups = {}
    for r in rows:
        n, *_, repeated = counts(r[1])
        failed = n < 10 or repeated * 100 > n * 20
        assert got[r[0]].base_failed == failed
        if not failed:
            groups.setdefault(place(r), []).append(r)
    assert len(groups["rest"]) < Q.LEAST_ROWS
    for name, own in groups.items():
        if name == "rest":
            assert all(got[r[0]].kept and got[r[0]].distance is None for r in own)
            continue
        want = mcd([vector(r[1]) for r in own])
        for r, d in zip(own, want, strict=True):
            assert got[r[0]].distance == pytest.approx(d, rel=1e-3, abs=1e-3)
            assert got[r[0]].kept == (d <= Q.quantile(Q.REJECTED, 5)) == (r[0] not in bad)


def test_small_groups_are_pooled(spark, prose):
    rows = [(k, prose(k, 60) if k else "a##| " * 60, "en", f"s{k % 9}") for k in range(90)]
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.distance is not None for r in got.values() if not r.base_failed) and not got[0].kept and all(got[k].kept for k in range(1, 90))


def test_hot_copies_and_odd_rows(spark, docs, prose):
    texts = [prose(1, 80)] * 60 + [prose(k, 80) for k in range(2, 62)] + [None, "", (None, prose(70, 80)), (5, prose(71, 80)), (5, prose(71, 80))]
    odd = docs(*texts).withColumn("place", F.lit("x")).withColumn("n_words", F.lit(1)).withColumn("u0", F.lit(2)).withColumn("m", F.lit(3))
    odd = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    got = Q.judged(odd).collect()
    assert len(got) == len(texts)
    assert all(r.kept for r in got if r.n_words) and not any(r.kept for r in got if not r.n_words)
    assert Q.judged(docs()).collect() == []
    assert json.loads(Q.judged(docs("a b")).toJSON().first())["kept"] is False


def test_steps_of_few_groups_write_one_file_each(spark, prose, monkeypatch):
    """A step's table has a row for each group; it was one file for each shuffle partition that held a group."""
    files, plain = [], Q.stored

    def stored(df):
        out = plain(df)
        if "l" in out.columns:
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Q, "stored", stored)
    rows = [(k, prose(k, 60), f"l{k % 6}", "s") for k in range(360)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(before, ("31", "false"), strict=True):
            spark.conf.set(c, v)
        got = Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(got) == 360 and all(r.distance is not None for r in got)
    assert len(files) > 4 and max(files[1:]) == 1  # the first are the starts, by which groups are counted
