"""Base spans against the plain patterns; learned formats on planted values."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from reelflow.llm import secrets as S
from reelflow.llm.common import read
from tests.conftest import SF


def plain(text):
    """Spans of the three patterns as they are stated: match, then drop."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def check(table):
    out = S.secrets(table).collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in out:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("format")] == [x for x in base.split(",") if x]
        assert r.n_assign + r.n_access + r.n_hex + r.n_format == len([x for x in r.spans.split(",") if x])
    return {r.doc_id: r for r in out}


def test_whole_table_equals_plain_patterns(spark):
    table = read(spark, SF, "documents")
    assert len(check(table)) == table.count()


def test_cases(docs):
    table = docs(
        None, "", "token=abc", "Token = \"abcdef\" é", "API_KEY: 'x+/_.=-' and PASSWD=secret=abcdefgh", "AKIA" + "A" * 15, "é AKIA" + "B7" * 8,
        "0" * 23, "f" * 24 + "g" + "0a" * 20, "\u017fecret=abcdefgh to\u212aen=abcdefgh", "token  =   " + "9" * 100_000, (None, "token=abcdef"),
    ).withColumn("spans", F.lit("clash"))
    by = check(table)
    assert by[0].spans == by[1].spans == by[2].spans == "" and by[3].spans == 'assign:0:15'
    assert by[9].n_assign == 0 and by[10].n_assign == by[10].n_hex == 1 and by[None].n_assign == 1
    assert S.secrets(docs()).collect() == []


def test_learned_formats(docs):
    """Values like the labelled ones are found without a keyword; words, numbers and paths are not."""
    r = random.Random(2)
    key = lambda: "sk_" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    texts = [f"some words token={key()} more" for _ in range(120)]
    other = [f"plain {key()} end" for _ in range(20)]
    clean = ["https://example.com/a/b/c/2020/long-path-of-many-words-here", "x" * 40, "1234567890_1234567890_12345", "Some_Identifier_With_2_Parts_And_More"]
    table = docs(*texts, *other, *clean)
    by = check(table)
    assert sum(by[k].n_format for k in range(120, 140)) >= 18
    assert not any(by[k].n_format for k in range(140, 144))
    cleaned = {x.doc_id: x for x in S.redacted(table.withColumn("v", F.lit(1))).collect()}
    assert cleaned[0].text == "some words [SECRET] more" and cleaned[0].n_chars == len(cleaned[0].text)
    assert [cleaned[k].text for k in range(140, 144)] == clean
    assert S.redacted(docs(None, (None, "password: abcdefg"))).orderBy(F.col("doc_id").isNull()).select("text").collect() == [(None,), ("[SECRET]",)]


def scan(text, base, model):
    """Every run of credential characters outside base spans, letter by letter, whole and by parts."""
    covered = [any(s <= k < e for s, _, e, _ in base) for k in range(len(text))]
    free = lambda k: k < len(text) and not covered[k] and re.fullmatch(r"[A-Za-z0-9+/_.=-]", text[k])
    shortest, found, k = min(a["shortest"] for a in model["automata"]), [], 0
    while k < len(text):
        if not free(k):
            k += 1
            continue
        end = k
        while free(end):
            end += 1
        run, tries = text[k:end], [[(k, end)]]
        a, b = k + len(run) - len(run.lstrip("+/_.=-")), end - (len(run) - len(run.rstrip("+/_.=-")))
        tries.append([(a, max(a, b))])
        for mark in "=/.":
            if mark in text[a:b]:
                pieces, at = [], a
                for piece in text[a:b].split(mark):
                    pieces.append((at, at + len(piece)))
                    at += len(piece) + 1
                tries.append(pieces)
        for way in tries:
            own = [(x, y) for x, y in way if y - x >= shortest and S.fits(S.symbols(text[x:y]), model)]
            if own:
                found += own
                break
        k = end
    return found


def test_all_candidates_are_scored(spark, docs, prose):
    """Dotted, short and letter-only formats are found without their keyword, also beside base spans; words are not."""
    r = random.Random(6)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    dotted = lambda: f"{pick(small, 2)}.{pick(small, 2)}{pick(large, 3)}.{pick(small, 3)}{pick(digits, 1)}.{pick(large, 1)}{pick(small, 1)}{pick(large, 1)}{pick(small, 1)}{pick(large, 1)}{pick(small, 1)}"
    short = lambda: pick(large, 1) + pick(digits, 2) + pick(small, 1) + pick(digits, 2) + pick(large, 1)
    letters = lambda: "".join(pick(large, 1) + pick(small, 1) for _ in range(9))
    words = [prose(k, 60).capitalize() + "." for k in range(150)]
    for make in (dotted, short, letters):
        labelled = [f"{prose(k, 5)} token={make()} {prose(k + 1, 5)}" for k in range(60)]
        planted = [make() for _ in range(20)]
        other = [f"{prose(200 + k, 6)} {v}, see key={v} or /a/{v}. {'0a' * 13}/{v} {prose(300 + k, 6)}" for k, v in enumerate(planted)]
        table = docs(*labelled, *other, *words)
        by = check(table)
        assert sum(by[60 + k].n_format == 4 for k in range(20)) >= 18, make
        assert not any(by[80 + k].n_format for k in range(150)), make
        model = S.fit(table)
        for row in table.collect():
            base = S.base_spans(row.text)
            assert S.added_spans(row.text, base, model) == scan(row.text, base, model)


def test_background_counts_leave_base_spans_out():
    codes = S._class_codes()
    text = "ab token=abcdef9999 c"
    assert S.pair_counts(text, S.base_spans(text), codes).sum() == S.pair_counts("ab   c", [], codes).sum()
    assert S.pair_counts("", [], codes).sum() == 1
    logs = S.background(S.pair_counts("aaaa 9", [], codes).astype(float))
    assert abs(sum(2**logs["a", x] for x in ["", *S._CLASSES]) - 1) < 1e-9


def test_state_merging_keeps_probabilities():
    automaton = S.infer(["ab" * n for n in (1, 2, 3, 4) for _ in range(50)])
    for moves, end in automaton["states"]:
        assert abs(sum(2**p for _, p in moves.values()) + (2**end if end > -13 else 0) - 1) < 1e-6
    assert len(S.infer(["9" * 40] * 300 + ["a" * 5] * 300)["states"]) > 1
    assert S.infer([]) is None
