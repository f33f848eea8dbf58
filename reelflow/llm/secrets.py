"""Secrets in texts: fixed formats, and formats learned from them by grammar inference.

Base spans are matches of three fixed patterns. Their values are labelled credentials: for each kind
an automaton is inferred by state merging (ALERGIA). It starts as the prefix tree of the values;
a state is merged into an earlier one if no observed frequency of theirs, nor of the states behind
them, differs by more than the Hoeffding bound.

Every other run of credential characters is a candidate, whole and by its parts, what base spans leave of it
included, from the shortest labelled value on. It is a span of kind `format` if an automaton gives it the
likelihood of a labelled credential, at least that of the least likely ones it was trained on less a
margin, and if that is `ODDS` bits more than what plain text gives it: the character pairs of all texts
outside base spans. A format that looks like words, such as five small letters, is never more likely than they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import slices, stored

KINDS = ("assign", "access", "hex", "format")
#: Labelled values an automaton is trained on, those with the smallest hashes, and their length at most.
VALUES, VALUE_CHARS = 1000, 200
#: Bits by which a format must be more likely than plain text.
ODDS = 12.0
ALPHA = 0.01
#: Bits a character that a candidate may be less likely than the least likely twentieth of the labelled values.
MARGIN = 0.25
UNSEEN = 1e-4

# The fixed patterns of the task's definition.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_MARKS = "+/_.=-"
#: Characters by class in plain text: 0 for all that is no credential character.
_CLASSES = "9azAZ" + _MARKS

_RESULT = "base array<struct<kind string, start int, end int>>, added array<struct<kind string, start int, end int>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the fixed patterns, by start, then kind.

    A match of the assign pattern with a value of under 6 characters, or of the access pattern with
    under 20 in all, is consumed and dropped. Runs of hex digits are maximal, so asking for 24 finds
    the same ones as dropping shorter ones.
    """
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def symbols(value: str) -> str:
    """Characters by class: digits, letters up to f and beyond in either case; others stand for themselves."""
    return "".join("9" if "0" <= c <= "9" else ("a" if c <= "f" else "z") if "a" <= c <= "z" else ("A" if c <= "F" else "Z") if "A" <= c <= "Z" else c for c in value)


def _differ(f: int, n: int, g: int, m: int) -> bool:
    return abs(f / n - g / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


class _Tree:
    """Frequency prefix tree whose states are merged in place."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[int] = [0]
        self.ends: list[int] = [0]
        for word in words:
            state = 0
            self.seen[0] += 1
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(0)
                    self.ends.append(0)
                state = self.next[state][c]
                self.seen[state] += 1
            self.ends[state] += 1

    def compatible(self, red: int, blue: int) -> bool:
        todo, met = [(red, blue)], set()
        while todo:
            p, q = pair = todo.pop()
            if pair in met:
                continue
            met.add(pair)
            n, m = self.seen[p], self.seen[q]
            if _differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in sorted(self.next[p].keys() | self.next[q].keys()):
                a, b = self.next[p].get(c), self.next[q].get(c)
                # passages along c; a merged target's own count holds other passages too
                if _differ(self.flow(p, c), n, self.flow(q, c), m):
                    return False
                if a is not None and b is not None:
                    todo.append((a, b))
        return True

    def flow(self, state: int, c: str) -> int:
        return self.through.get((state, c), 0)

    def fold(self, red: int, blue: int) -> None:
        """Add the subtree of `blue` to the states that its words reach from `red`."""
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            for c, target in self.next[q].items():
                self.through[p, c] = self.through.get((p, c), 0) + self.through[q, c]
                if c in self.next[p]:
                    todo.append((self.next[p][c], target))
                else:
                    self.next[p][c] = target

    def merged(self) -> list[int]:
        """Merge states until the kept ones differ; returns these."""
        self.through = {(p, c): self.seen[q] for p, own in enumerate(self.next) for c, q in own.items()}
        red = [0]
        while True:
            blue = sorted({(q, p, c) for p in red for c, q in self.next[p].items() if q not in red})
            if not blue:
                return red
            q, p, c = blue[0]
            for r in red:
                if self.compatible(r, q):
                    self.next[p][c] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)


def infer(values: list[str]) -> dict | None:
    """The automaton of labelled values: per state the log2-probability of each symbol and of the end.

    `least` is the mean log2-likelihood a symbol that 95 of 100 values reach, less the margin.
    """
    words = sorted(symbols(v) for v in values)
    if not words:
        return None
    tree = _Tree(words)
    red = tree.merged()
    number = {s: k for k, s in enumerate(red)}
    states = [
        (
            {c: (number[q], math.log2(tree.through[s, c] / tree.seen[s])) for c, q in sorted(tree.next[s].items())},
            math.log2(max(tree.ends[s] / tree.seen[s], UNSEEN)),
        )
        for s in red
    ]
    own = sorted(likelihood(states, w) for w in words)
    return {"states": states, "least": own[len(own) // 20] - MARGIN, "shortest": min(map(len, words))}


def likelihood(states: list, word: str) -> float:
    """Mean log2-likelihood of the symbols and the end; an unseen symbol ends the walk with -inf."""
    at, total = 0, 0.0
    for c in word:
        if c not in states[at][0]:
            return -math.inf
        at, p = states[at][0][c]
        total += p
    return (total + states[at][1]) / (len(word) + 1)


def _class_codes() -> bytes:
    return bytes(_CLASSES.index(symbols(chr(c))) + 1 if chr(c).isascii() and _RUN.fullmatch(chr(c)) else 0 for c in range(256))


def pair_counts(text: str, base: list, codes: bytes) -> np.ndarray:
    """Pairs of neighbouring character classes of a text without its base spans."""
    parts, at = [], 0
    for s, _, e, _ in base:
        if e > at:
            parts += [text[at : max(s, at)], " "]
            at = e
    rest = text if not base else "".join([*parts, text[at:]])
    found = np.frombuffer(f" {rest} ".encode().translate(codes), np.uint8).astype(np.int64)
    size = len(_CLASSES) + 1
    return np.bincount(found[:-1] * size + found[1:], minlength=size * size)


def background(counts: np.ndarray) -> dict[tuple[str, str], float]:
    """log2-probability of each class after another in plain text; the empty string stands for both ends."""
    size = len(_CLASSES) + 1
    table = counts.reshape(size, size) + 0.5
    logs = np.log2(table / table.sum(1, keepdims=True))
    names = ["", *_CLASSES]
    return {(names[i], names[j]): float(logs[i, j]) for i in range(size) for j in range(size)}


def fits(word: str, model: dict) -> bool:
    """True if an automaton takes a candidate's symbols for a labelled value rather than plain text."""
    plain = None
    for a in model["automata"]:
        if len(word) < a["shortest"]:
            continue
        own = likelihood(a["states"], word)
        if own < a["least"]:
            continue
        if plain is None:
            plain = sum(map(model["background"].__getitem__, zip(["", *word], [*word, ""], strict=True)))
        if own * (len(word) + 1) - plain >= ODDS:
            return True
    return False


@cache
def _runs(shortest: int) -> re.Pattern:
    return re.compile(f"[A-Za-z0-9+/_.=-]{{{shortest},}}")


def parts(start: int, end: int, text: str) -> list[list[tuple[int, int]]]:
    """A run as a whole, without marks at its ends, and cut at each kind of mark; a later way counts if none before it fits."""
    ways = [[(start, end)]]
    s, e = start, end
    while s < e and text[s] in _MARKS:
        s += 1
    while e > s and text[e - 1] in _MARKS:
        e -= 1
    ways.append([(s, e)])
    for mark in "=/.":
        if mark in text[s:e]:
            cuts = [k for k in range(s, e) if text[k] == mark]
            ways.append(list(zip([s, *(k + 1 for k in cuts)], [*cuts, e], strict=True)))
    return ways


def added_spans(text: str, base: list, model: dict) -> list[tuple[int, int]]:
    """(start, end) of candidates with a learned format outside the base spans."""
    if not model["automata"]:
        return []
    shortest = min(a["shortest"] for a in model["automata"])
    taken: list[list[int]] = []  # base spans, overlapping ones as one
    for s, _, e, _ in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    found = []
    for m in _runs(shortest).finditer(text):
        free, at = [], m.start()
        for s, e in taken[max(0, bisect_left(taken, [at, 0]) - 1) :]:
            if s >= m.end():
                break
            if s > at:
                free.append((at, s))
            at = max(at, e)
        if at < m.end():
            free.append((at, m.end()))
        for s, e in free:
            for way in parts(s, e, text):
                own = [(x, y) for x, y in way if y - x >= shortest and fits(symbols(text[x:y]), model)]
                if own:
                    found += own
                    break
    return found


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled values, and pairs of character classes as rows of their own kind."""
    codes = _class_codes()
    size = (len(_CLASSES) + 1) ** 2
    for batch in slices(batches):
        found: list[tuple[str, str, int]] = []
        pairs = np.zeros(size, np.int64)
        for t in batch.column(0).to_pylist():
            if not t:
                continue
            base = base_spans(t)
            found += [(KINDS[k], v, 1) for _, k, _, v in base if len(v) <= VALUE_CHARS]
            pairs += pair_counts(t, base, codes)
        found += [("pair", str(k), int(pairs[k])) for k in np.flatnonzero(pairs)]
        kinds, values, n = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(n, pa.int64())], ["kind", "value", "n"])


def fit(docs: DataFrame) -> dict:
    """Automata for the kinds of base spans in `docs`, each from a bounded sample of distinct values, and the pairs of all texts."""
    counted = docs.select("text").mapInArrow(_values, "kind string, value string, n long")
    values = stored(counted.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    automata = []
    for kind in KINDS[:3]:
        own = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(VALUES)
        automata.append(infer([r.value for r in own.collect()]))
    counts = np.zeros((len(_CLASSES) + 1) ** 2)
    for r in values.where("kind = 'pair'").collect():  # one row for each pair of classes
        counts[int(r.value)] = r.n
    return {"automata": [a for a in automata if a], "background": background(counts)}


def find(text: Column, model: dict) -> Column:
    """A struct of the base and the added spans of a text column; null is empty."""

    @F.pandas_udf(_RESULT)
    def spans(texts: pd.Series) -> pd.DataFrame:
        base, added = [], []
        for t in texts:
            own = base_spans(t or "")
            base.append([(KINDS[k], s, e) for s, k, e, _ in own])
            added.append([(KINDS[3], s, e) for s, e in added_spans(t or "", own, model)])
        return pd.DataFrame({"base": base, "added": added})

    return spans(F.coalesce(text, F.lit("")))


def redact(text: Column, model: dict, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping ones, replaced by `mark`; null stays null."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            own = base_spans(t)
            spans = sorted([(s, e) for s, _, e, _ in own] + added_spans(t, own, model))
            parts, at = [], 0
            for k, (s, e) in enumerate(spans):
                if k and s < at:
                    at = max(at, e)
                    continue
                parts += [t[at:s], mark]
                at = e
            out.append("".join([*parts, t[at:]]) if spans else t)
        return pd.Series(out, dtype=object)

    return cleaned(text)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of `KINDS`, joined by commas."""
    order = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans) for every row of `docs`.

    Only `doc_id` and `text` are read. Null and empty texts have no span and the digest of an empty
    string; null ids are kept; repeated rows are reported again; an empty table gives an empty result.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), find(F.col("text"), fit(docs)).alias("f"))
    count = lambda k: F.size(F.filter("f.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.size("f.added").cast("long").alias("n_format"),
        F.sha2(_listed(F.col("f.base")), 256).alias("base_sha256"),
        _listed(F.concat("f.base", "f.added")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced in `text`, and `n_chars`, if there, counted again for these texts."""
    out = docs.withColumn("text", redact(F.col("text"), fit(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)
