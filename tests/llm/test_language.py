"""Accuracy on held-out text and the effect of each kind of evidence."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelflow.llm import language as L
from reelflow.llm.common import read
from tests.conftest import SF


def test_text_alone_is_accurate(spark):
    """Declarations hidden for one half; their texts still tell the language."""
    docs = read(spark, SF, "documents")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    table = docs.withColumn("lang", F.when(~hidden, F.col("lang")))
    truth = docs.where(hidden).select("doc_id", F.col("lang").alias("y"))
    out = L.identified(table, read(spark, SF, "pages")).join(truth, "doc_id").collect()
    assert sum(r.lang == r.y for r in out) >= 0.97 * len(out) > 50
    assert sum(r.text_lang == r.y for r in out) >= 0.95 * len(out)


def test_evidence_and_cases(spark, docs, pages):
    en = ["the river and the stone were in the house with the old man"] * 12
    de = ["der Fluss und der Stein waren in dem Haus mit dem alten Mann"] * 12
    table = docs(*en, *de, None, "", (None, "the house and the river"), "1234 !!", "the " * 40_000).withColumn("host", F.lit("clash"))
    table = table.withColumn("lang", F.when(F.col("doc_id").between(12, 23), "de").when(F.col("doc_id") < 24, "en")).withColumn("kind", F.lit(1))
    table = table.withColumn("source", F.when(F.col("doc_id") != 25, F.col("source")))
    page = lambda lang, body: f'<html lang="{lang}"><body><p>{body}</p></body></html>'
    web = [(k, f"http://a.test.de/x{k}", page("de", de[0])) for k in range(15)] + [(50 + k, f"http://b.test.uk/en/{k}", page("en", en[0])) for k in range(15)]
    web += [(90, "http://a.test.de/", "<html><body>12</body></html>"), (91, "http://new.test.uk/en/1", page("en-GB", "")), (92, None, None), (None, "x", ""),
            (94, "http://a.test.de/y", page("de", "the river and the stone"))]
    out = L.identified(table, pages(*web))
    rows = out.collect()
    assert len(rows) == 24 + 5 + len(web)
    docs_by, pages_by = ({r[c]: r for r in rows if r[c] is not None} for c in ("doc_id", "page_id"))
    assert all(docs_by[k].lang == ("de" if k >= 12 else "en") for k in range(24)) and docs_by[28].lang == "en"
    assert docs_by[24].text_lang is None and docs_by[24].lang is not None and docs_by[27].text_lang is None
    assert pages_by[90].lang == "de" and pages_by[90].text_lang is None, "host and suffix decide"
    assert pages_by[91].lang == "en" and pages_by[91].declared == "en"
    assert pages_by[92].text_lang is None and pages_by[94].text_lang == "en"
    assert all(0 < r.probability <= 1 for r in rows)
    none = L.identified(table.withColumn("lang", F.lit(None).cast("string")), pages(*web)).collect()
    assert len(none) == len(rows) and not any(r.lang for r in none)
    assert L.identified(docs(), pages()).collect() == [] and len(L.identified(table, pages()).collect()) == 29


def test_declaration_behind_long_start(docs, pages):
    """The html element counts wherever it stands, but not in comments or scripts."""
    table = docs("the river and the stone").withColumn("lang", F.lit("en"))
    long = "x" * 10_000
    web = [f'<!-- {long} <html lang="de"> --><html class="a" lang="fr-CA">', f'{" " * 10_000}<!DOCTYPE html><HTML LANG=es>', f"<html><script>'<html lang=de>'</script>{long}",
           f'<!--{long}', '<html xml:lang="de" lang="en">', "<html " * 50_000, '<!--><html lang="it">', "<html><body lang=de>",
           '<html lang="en" data-lang="de">', '<html data-lang="de" lang="en">', "<html hreflang=de>", "<html\nlang = 'it'>"]
    out = L.identified(table, pages(*[(k, f"http://h{k}.test/", html) for k, html in enumerate(web)])).collect()
    assert [r.declared for r in sorted((r for r in out if r.page_id is not None), key=lambda r: r.page_id)] == ["fr", "es", "", "", "en", "", "it", "", "en", "en", "", "it"]


def brute(rows, langs):
    """(kind, id) -> posterior of each language, from sums over all rows for each row anew."""
    n = range(len(langs))
    votes = []
    for r in rows:
        e = [math.exp(x) for x in r.text_log]
        votes.append([x / sum(e) for x in e])
    sums = {c: defaultdict(lambda: [0.0] * len(langs)) for c in ("host", "domain", "declared", "suffix", "declared_all", "suffix_all")}
    domain = lambda h: ".".join(h.split(".")[-2:])
    overall = [sum(v[k] for v in votes) for k in n]
    for r, v in zip(rows, votes, strict=True):
        for c, key in (("host", r.host), ("domain", domain(r.host)), ("declared", r.declared), ("suffix", r.suffix), ("declared_all", ""), ("suffix_all", "")):
            own = sums[c][r.kind, key]
            for k in n:
                own[k] += v[k]
    out = {}
    for r, v in zip(rows, votes, strict=True):
        post = []
        for k in n:
            prior = (overall[k] + L.SMOOTHING) / (sum(overall) + L.SMOOTHING * len(langs))
            d, h = sums["domain"][r.kind, domain(r.host)], sums["host"][r.kind, r.host]
            up = (max(d[k] - v[k], 0) + L.DOMAIN_ROWS * prior) / (sum(d) - 1 + L.DOMAIN_ROWS)
            total = r.text_log[k] + math.log((max(h[k] - v[k], 0) + L.HOST_ROWS * up) / (sum(h) - 1 + L.HOST_ROWS) if r.host else prior)
            for c in ("declared", "suffix"):
                if getattr(r, c):
                    total += math.log((max(sums[c][r.kind, getattr(r, c)][k] - v[k], 0) + L.SMOOTHING) / (sums[f"{c}_all"][r.kind, ""][k] + L.SMOOTHING * 10))
            post.append(total)
        best = max(post)
        out[r.kind, r.id] = (langs[post.index(best)], 1 / sum(math.exp(x - best) for x in post))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_posterior_equals_brute_force(spark, monkeypatch, broadcast):
    """Whole tables, with the small tables broadcast and with both sides shuffled."""
    if not broadcast:
        monkeypatch.setattr(L, "CELLS", 0)
    docs, pages = read(spark, SF, "documents"), read(spark, SF, "pages")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    model = L.fit(docs)
    want = brute(L.evidence(docs, pages, model).collect(), model[0])
    got = L.identified(docs, pages).collect()
    assert len(got) == len(want)
    for r in got:
        lang, probability = want["document" if r.doc_id is not None else "page", r.doc_id if r.doc_id is not None else r.page_id]
        assert r.lang == lang and r.probability == pytest.approx(probability, abs=2e-6)
