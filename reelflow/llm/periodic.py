"""Periodic runs of words, found by enumerating maximal pairs.

A run of period q that begins at word s is a pair of equal stretches, one at s and one at s + q, that
no word to the left or right makes longer: a maximal pair at distance q. Its stretches have the
run's length less q words, so a run of at least `PERIODS` periods and `LEAST` words is a maximal
pair whose distance is at most a third of its length, and the other way round. Pairs are taken
from the tree of LCP intervals, built bottom-up: at an interval of depth l the positions of one
child are paired with those of the others if their left words differ and they lie within l / 3 words.

The positions of an interval are one ordered list with the left-word class of each. Positions within
l / 3 words of each other are multiples of one period apart, so all but the first of them have the
same left word: one look at the first and one at the next settle all class lists in reach, and what
is listed is only what is found. A run that also is one of two or three times its period is
found at each of these distances; the smallest is its period.

Only words that can be in a run get into the suffix array: those whose five words come again within a
quarter of the stretch of such words. Everything happens inside one task for each text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import CRC_SQL, crc_sql, slices, utf8

#: A run holds at least so many periods and at least so many words.
PERIODS, LEAST = 4, 6
#: A stretch of a run is at least this long: LEAST less a period of 1.
_WINDOW = LEAST - 1
_BLANK = r"[\x20\x09-\x0D]+"

_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Numbers(dict):
    """Word -> number, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _stretches(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of positions whose five words may belong to a run.

    Two positions with the same five words, hashed with their document, are partners. In a run of
    period q each position has a partner at distance q, and the run's positions, at least 4q - 4 of
    them, stand in one stretch. So a position whose nearest partner is further away than a quarter of its
    stretch and the four words behind it is in no run; the rest is looked at again until nothing goes.
    """
    n = len(words) - _WINDOW + 1
    if n <= 1:
        return []
    key = doc[:n].astype(np.uint64) + np.uint64(1)
    for k in range(_WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : n + k].astype(np.uint64)
    order = np.argsort(key ^ (key >> np.uint64(32)), kind="stable")
    order = order[doc[order] == doc[order + _WINDOW - 1]]  # no windows over the end of a text
    same = key[order[1:]] == key[order[:-1]]
    apart = order[1:] - order[:-1]
    near = np.full(n, n, np.int64)
    near[order[1:][same]] = apart[same]
    near[order[:-1][same]] = np.minimum(near[order[:-1][same]], apart[same])
    at = np.flatnonzero(near < n)
    while len(at):
        breaks = np.flatnonzero((np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]]))
        first, last = np.r_[0, breaks + 1], np.r_[breaks, len(at) - 1]
        size = last - first + 1
        fits = near[at] * PERIODS <= np.repeat(size, size) + _WINDOW - 1
        if fits.all():
            return list(zip(at[first].tolist(), at[last].tolist(), strict=True))
        at = at[fits]
    return []


def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP of neighbours by prefix doubling; the last symbol of `text` must be unique."""
    n = len(text)
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while ranks[-1].max() + 1 < n:
        r = ranks[-1]
        behind = np.zeros(n, np.int64)
        behind[: n - step] = r[step:] + 1
        ranks.append(np.unique(r * (n + 1) + behind, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(ranks) - 1, -1, -1):
        r = np.append(ranks[k], [-1, -2])
        x, y = np.minimum(a + lcp[1:], n), np.minimum(b + lcp[1:], n + 1)
        lcp[1:] += (r[x] == r[y]) * (1 << k)
    return order, lcp


def _pairs(small: list[int], large: list[int], depth: int, left: list[int], found: list[tuple[int, int, int]]) -> list[int]:
    """Report the maximal pairs between two children of an interval and give their positions as one list."""
    if len(small) > len(large):
        small, large = large, small
    reach = depth // (PERIODS - 1)
    for p in small:
        at = bisect_left(large, p)
        far = bisect_left(large, p - reach, 0, at)
        if far < at and left[large[far]] != left[p]:
            found.append((large[far], p, depth))
        if at < len(large) and large[at] <= p + reach and left[large[at]] != left[p]:
            for q in large[at : bisect_left(large, p + reach + 1, at)]:
                found.append((p, q, depth))
    for p in small:
        insort(large, p)
    return large


def _maximal_pairs(order: list[int], lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, length) of the maximal pairs within reach, by one walk over the LCP intervals bottom-up."""
    found: list[tuple[int, int, int]] = []
    opened: list[list] = []  # [depth, positions of its finished children]
    child = [order[0]] if order else []
    for p, depth in zip([*order[1:], -1], [*lcp[1:], 0], strict=True):
        while opened and opened[-1][0] > depth:
            own, positions = opened.pop()
            child = _pairs(child, positions, own, left, found)
        if depth >= _WINDOW:
            if opened and opened[-1][0] == depth:
                opened[-1][1] = _pairs(child, opened[-1][1], depth, left, found)
            else:
                opened.append([depth, child])
        child = [p]
    return found


def word_runs(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, length, period) of all runs of numbered words, in order; no run crosses texts.

    `doc` numbers the text of each word, in order.
    """
    parts = _stretches(words, doc)
    if not parts:
        return []
    at = np.concatenate([np.arange(a, b + _WINDOW + 1) for a, b in parts])
    sizes = [b + _WINDOW - a + 1 for a, b in parts]
    part = np.repeat(np.arange(len(parts)), sizes)
    ends = np.cumsum(sizes) - 1
    at = np.minimum(at, len(words) - 1)
    symbols = part * (int(words.max()) + 1) + words[at]
    symbols[ends] = symbols.max() + 1 + np.arange(len(parts))  # one end mark for each stretch
    order, lcp = _suffixes(symbols)
    before = at - 1
    left = np.where((before < 0) | (doc[before] != doc[at]), -1, words[before]).tolist()
    smallest: dict[tuple[int, int], int] = {}
    for i, j, depth in _maximal_pairs(order.tolist(), lcp.tolist(), left):
        key = (int(at[i]), depth + j - i)
        smallest[key] = min(j - i, smallest.get(key, j - i))
    return sorted((start, length, period) for (start, length), period in smallest.items())


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        texts = [t.split() if t else [] for t in utf8(batch.column(1))]
        numbers = _Numbers()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        offset = np.cumsum(sizes) - sizes
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for start, length, period in word_runs(words, doc):
            k = int(doc[start])
            runs[k].append((start - int(offset[k]), length, period))
        for own in runs:
            own.sort(key=lambda r: (r[0], r[2]))
        collapsed = []
        for text, own in zip(texts, runs, strict=True):
            if own:
                steps = np.zeros(len(text) + 1, np.int64)
                for start, length, period in own:
                    steps[start + period] += 1
                    steps[start + length] -= 1
                text = [text[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
            collapsed.append(b" ".join(text).decode())
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, kind), pa.array(collapsed, pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of `docs`: runs by start and period, and the text without repeats.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and return.
    `collapsed` joins by one space the words that no run holds behind its first period. Reads `doc_id` and `text` only; null
    and empty texts have no words and an empty `collapsed`; null ids are kept, repeated rows are
    repeated; an empty table gives no rows. A text of any length is one task's work.
    """
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_found, _SCHEMA)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's planted repeats: a tenth of the texts, by a checksum of the id, end in copies.

    From word a on, word i is replaced by word a + (i - a) % p. Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))

    edited = F.array_join(F.get(F.transform(F.array(words_of(F.col("text"))), repeated), F.lit(0)), " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.pmod(h, F.lit(10)) == 0, edited).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what `periodic_runs` gives."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.floor(-F.col("b.l") * 1000 / F.col("b.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def oracle_sql() -> str:
    """The digests in SQL: stretches of equal words at each distance at which some five words come again."""
    codes = "list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint)"
    return f"""
        with recursive {CRC_SQL},
        texts as (
            select row_number() over () r, doc_id, case when doc_id is not null then {crc_sql(codes)} end h,
                list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w
            from documents, crc_table),
        edited as (
            select r, doc_id, case when h % 10 = 0 and len(w) > 0 then list_transform(range(len(w)), lambda i: w[(case when i < a then i else a + (i - a) % p end) + 1]) else w end w
            from (select *, 1 + (len(w) - a) // (3 + (h // 10) % 8) p from (select *, (h // 10) % greatest(len(w), 1) a from texts))),
        grams as (
            select r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] || ' ' || w[i + 5] g
            from (select r, w, unnest(range(len(w) - 4)) i from edited)),
        matches as (
            select r, x.i, y.i - x.i d from grams x join grams y using (r, g) where y.i > x.i),
        islands as (
            select r, d, min(i) as first, count(*) + 4 + d as size
            from (select *, i - row_number() over (partition by r, d order by i) island from matches) group by r, d, island),
        runs as (
            select r, first as start, size as length, min(d) as period from islands where size >= greatest(6, 4 * d) group by all),
        dropped as (select distinct r, unnest(range(start + period, start + length)) i from runs),
        holes as (select r, list(i) gone from dropped group by r),
        listed as (
            select r, count(*) n, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) txt,
                arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) b
            from runs group by r)
        select doc_id, coalesce(n, 0)::bigint n_runs, b.s::bigint as start, b.l::bigint as length, b.p::bigint as period,
            (b.l * 1000 // b.p)::bigint exponent_milli, sha256(coalesce(txt, '')) runs_sha256,
            sha256(coalesce(array_to_string(case when gone is null then w else list_transform(list_filter(range(len(w)), lambda i: not list_contains(gone, i)), lambda i: w[i + 1]) end, ' '), '')) collapsed_sha256
        from edited left join listed using (r) left join holes using (r)"""
