import random
import re
import zlib
from collections import Counter

import pytest

from reelflow.llm import spelling as S


def edits(word: str, letters: str) -> set[str]:
    cut = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return out - {word}


def brute(texts, deleted=None):
    """(word, form, root, n, n_near, form_n) from all edits of all words."""
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if deleted and doc_id is not None and h % deleted == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = "".join(sorted(set("".join(words))))
    form, near = {}, {}
    for w in words:
        own = [v for v in edits(w, letters) if v in words]
        near[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def noisy():
    """Texts over few letters, so that many words are near each other, with accents, capitals and one very long word."""
    r = random.Random(5)
    stems = ["".join(r.choice("abéÉß") for _ in range(r.randint(4, 8))) for _ in range(60)]
    texts = []
    for k in range(120):
        words = []
        for _ in range(80):
            w = r.choice(stems[: 1 + r.randrange(len(stems))])
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "a", "b", "é"]) + w[at + r.randrange(2) :]
            words.append(w.upper() if w.isascii() and r.random() < 0.1 else w)
        texts.append((k, " ".join(words)))
    long = "langeswort" * 30
    chain = "kaskad " * 3 + "kaskade " * 7 + "kaskaden " * 20 + "kaskadens " * 40
    return [*texts, (199, chain), (200, f"{long} {long} {long}x {long}x {long}x {long}"), (201, long + "\n" + long)]


@pytest.mark.parametrize("deleted", [None, 7])
def test_variants_equal_brute_force(docs, noisy, deleted):
    got = rows(S.spelling_variants(docs(*noisy), deleted))
    assert got == brute(noisy, deleted)
    assert any(r[1] != r[2] for r in got if r[1]) and any(len(r[0]) > S.LETTERED for r in got)


def test_small_blocks_give_the_same(spark, docs, noisy, monkeypatch):
    """Subtrees cut into blocks and searches in pieces change no result."""
    for name, value in (("BLOCK", 3), ("SEARCHED", 5), ("LEAF", 1), ("LEAF_ROWS", 2), ("HELD", 4)):
        monkeypatch.setattr(S, name, value)
    assert rows(S.spelling_variants(docs(*noisy[:40]))) == brute(noisy[:40])


def test_one_edit_is_exactly_one():
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(120)] + ["x" * 41, "x" * 42, "x" * 40 + "y"]
    given = S.Words([w.encode() for w in words])
    import numpy as np

    for i, w in enumerate(words):
        near = edits(w, "abxy")
        for j, v in enumerate(words):
            assert S.one_edit(w.encode(), v.encode()) == (v in near)
            assert bool(S.one_edit_apart(given, np.array([i]), given, np.array([j]))[0]) == (v in near)


def test_odd_rows(docs):
    texts = [None, "", "12 34 Āā", (None, "letter letter letter"), (5, "lette lette lette"), (5, "lette lette lette")]
    assert rows(S.spelling_variants(docs(*texts).selectExpr("*", "1 as word", "2 as n", "'f' as form"))) == [("lette", None, "lette", 6, 1, None), ("letter", "lette", "lette", 3, 1, 6)]
    assert rows(S.spelling_variants(docs())) == []
    ties = "aaaaa aaaaa aaaaa aaaab aaaab aaaab " * 2 + "aaaac aaaac aaaac"
    assert rows(S.spelling_variants(docs(ties)))[-1] == ("aaaac", "aaaaa", "aaaaa", 3, 2, 6)
