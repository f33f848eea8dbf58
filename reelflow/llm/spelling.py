"""Spelling variants: words one inserted, deleted or replaced letter apart, found in frequency-vector tries.

Each word has a vector: how many of its letters fall into each of a list of letter groups, first
coarse ones, then single letters. Words ordered by their vectors are a trie, whose nodes are ranges of
words with the same first counts. One changed letter adds at most one to one count and takes at most one
from another, at either fineness. So a depth-first search goes with each word's vector down the trie and may
take a child whose count is one higher once (surplus) and one whose count is one lower once (deficit); what
is left at a leaf is verified letter by letter.

Scale: the first `depth` counts name a subtree, and a subtree is a block of rows in one task. Words go to
all subtrees that their budget can reach, each pair of subtrees once. A subtree of more than `BLOCK`
words is cut into blocks by a hash of the word, each with a trie of its own, and what is searched in it
is searched in all its blocks. A task holds the words of one block and searches streamed pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import CRC_SQL, crc_sql, slices, stored, utf8

#: A word of interest has at least so many letters and occurrences.
LETTERS, OCCURRENCES = 5, 3
#: A form occurs at least this many times as often as its variant.
DOMINANCE = 2
#: One of so many words of a document, by a checksum, has a letter deleted by the contract's query.
DELETED = 97
#: Words of one block of a subtree, words searched at a time, words of a leaf.
BLOCK, SEARCHED, LEAF = 4096, 100_000, 64
#: Rows of one comparison in a leaf; words up to this length are compared as arrays, longer ones one by one.
LEAF_ROWS, LETTERED = 4096, 40
#: Distinct words that a counting task holds before it passes them on.
HELD = 200_000

_COARSE = 8
#: Codes modulo 8 in the order of their levels: groups of frequent letters first, so that the first levels divide well.
_FIRST = (1, 5, 4, 6, 7, 2, 3, 0)
_LEVELS = 2 * _COARSE + 26

_PLACED = "subtree binary, block int, search boolean, above boolean, word binary, n long"
_NEAR = "word string, n long, near string, near_n long"


def _groups() -> tuple[np.ndarray, np.ndarray]:
    """The coarse and the fine level of each Latin-1 letter: by its code, then one for each of a-z."""
    codes = np.arange(256)
    coarse = np.argsort(_FIRST)[codes % _COARSE]
    fine = np.where((codes >= 97) & (codes <= 122), _COARSE + codes - 97, _COARSE + 26 + codes % _COARSE)
    return coarse, fine


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of each letter group, one row for each Latin-1 word."""
    coarse, fine = _groups()
    letters = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words))) * _LEVELS
    return np.bincount(np.r_[row + coarse[letters], row + fine[letters]], minlength=len(words) * _LEVELS).reshape(-1, _LEVELS).astype(np.int32)


def one_edit(a: bytes, b: bytes) -> bool:
    """True if one inserted, deleted or replaced letter makes one of the words the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k, short = 0, min(len(a), len(b))
    while k < short and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


class Words:
    """Words as arrays: their vectors, those in 60 bits, and their letters from the front and from the back."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.counts = np.minimum(vectors(words), np.iinfo(np.int16).max).astype(np.int16)
        fine = self.counts[:, _COARSE:]
        some = np.concatenate([fine > 0, fine[:, :26] > 1], axis=1)  # counts of a-z up to 2, of other letters up to 1
        self.bits = (some.astype(np.uint64) << np.arange(some.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
        short = self.sizes <= LETTERED
        row = np.repeat(np.arange(len(words)), np.where(short, self.sizes, 0))
        letters = np.frombuffer(b"".join(w for w, s in zip(words, short.tolist(), strict=True) if s), np.uint8)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(np.where(short, self.sizes, 0)) - np.where(short, self.sizes, 0), np.where(short, self.sizes, 0))
        self.front = np.zeros((len(words), LETTERED), np.uint8)
        self.front[row, column] = letters
        self.back = np.zeros((len(words), LETTERED), np.uint8)
        self.back[row, self.sizes[row] - 1 - column] = letters


def one_edit_apart(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """`one_edit` for pairs of words: what they share at the front and at the back leaves one letter at most."""
    size, other = a.sizes[i], b.sizes[j]
    long = np.maximum(size, other)
    out = np.abs(size - other) <= 1
    for k in np.flatnonzero(out & (long > LETTERED)).tolist():
        out[k] = one_edit(a.words[i[k]], b.words[j[k]])
    at = np.flatnonzero(out & (long <= LETTERED))
    if len(at):
        width = int(long[at].max())
        short = np.minimum(size, other)[at]

        def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            differ = x[i[at], :width] != y[j[at], :width]
            return np.where(differ.any(1), differ.argmax(1), width)

        head, tail = np.minimum(shared(a.front, b.front), short), np.minimum(shared(a.back, b.back), short)
        out[at] = (head + tail >= long[at] - 1) & ((head < long[at]) | (size[at] != other[at]))
    return out


class Trie:
    """The words of one block, ordered by their vectors."""

    def __init__(self, words: list[bytes]):
        given = vectors(words)
        self.place = np.lexsort(given.T[::-1])
        self.held = Words([words[k] for k in self.place])

    def search(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(searched, found) numbers of verified pairs; all words go down the trie together."""
        wanted, held = Words(words), self.held
        none = np.zeros(len(words), bool)
        todo = [(0, len(held.words), 0, np.arange(len(words)), none, none)]
        while todo:
            low, high, level, rows, surplus, deficit = todo.pop()
            if level == _LEVELS or high - low <= LEAF:
                for first in range(0, len(rows), LEAF_ROWS):
                    some = rows[first : first + LEAF_ROWS]
                    for start in range(low, high, LEAF_ROWS):
                        stop = min(start + LEAF_ROWS, high)
                        apart = np.bitwise_count(wanted.bits[some][:, None] ^ held.bits[None, start:stop])
                        s, f = np.nonzero(apart <= 2)  # at most one surplus and one deficit
                        s, f = some[s], f + start
                        near = one_edit_apart(wanted, s, held, f)
                        yield s[near], self.place[f[near]]
                continue
            if level == _COARSE:  # the fine counts have a budget of their own
                surplus, deficit = none[: len(rows)], none[: len(rows)]
            column = held.counts[low:high, level]
            cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
            own = wanted.counts[rows, level]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), high - low], strict=True):
                step = column[a] - own
                ok = (step == 0) | ((step == 1) & ~surplus) | ((step == -1) & ~deficit)
                if ok.any():
                    todo.append((low + a, low + b, level + 1, rows[ok], surplus[ok] | (step[ok] == 1), deficit[ok] | (step[ok] == -1)))


def reachable(start: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The first counts that a surplus and a deficit of one each lead to and that do not come before `start`."""
    found = {start}
    for k in range(len(start)):
        up = (*start[:k], start[k] + 1, *start[k + 1 :])
        found |= {up} | {(*up[:j], up[j] - 1, *up[j + 1 :]) for j in range(len(start)) if j != k and up[j]}
        if start[k]:
            found.add((*start[:k], start[k] - 1, *start[k + 1 :]))
    return [x for x in found if x >= start]


def _named(counts: tuple[int, ...]) -> bytes:
    return b"".join(c.to_bytes(4, "big") for c in counts)


def word_counts(docs: DataFrame, deleted: int | None = None) -> DataFrame:
    """(word, n): runs of the letters a-z (A-Z lowered) and U+00C0 to U+00FF in all texts, with their occurrences.

    With `deleted`, a word of a document whose checksum with the document's id that number
    divides has one letter deleted, if the id is there; words left without a letter go.
    """
    import re

    letters = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in slices(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                own: dict[bytes, int] = {}
                for word in letters.findall(text.lower()) if text else ():
                    own[word] = own.get(word, 0) + 1
                if deleted and doc_id is not None:
                    begun = crc32(b"%d:" % doc_id)
                    for word, n in own.items():
                        h = crc32(word, begun)
                        if h % deleted == 0:
                            whole = word.decode()
                            k = h % len(whole)
                            word = (whole[:k] + whole[k + 1 :]).encode()
                        if word:
                            total[word] = total.get(word, 0) + n
                else:
                    for word, n in own.items():
                        total[word] = total.get(word, 0) + n
                if len(total) >= HELD:
                    yield passed_on()
        if total:
            yield passed_on()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of `words` (word, n) one letter apart, in both directions.

    Words are distinct, not null and of Latin-1 letters; other characters make the job fail.
    """
    words = words.select("word", "n")
    total = words.count()
    depth = min(_COARSE, max(5, math.ceil(math.log(max(total / BLOCK, 1), 2.5))))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            names = [_named(tuple(v)) for v in vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])[:, :depth].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], ["subtree"])

    sizes = words.select("word").mapInArrow(subtrees, "subtree binary").groupBy("subtree").count()
    # one row for each BLOCK words at most
    cut = {bytes(r.subtree): -(-r["count"] // BLOCK) for r in sizes.where(F.col("count") > BLOCK).collect()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[tuple[int, ...], list[tuple[bytes, bool]]] = {}
        for batch in slices(batches, 2048):
            rows = []
            texts = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for word, n, v in zip(texts, batch.column(1).to_pylist(), vectors(texts)[:, :depth].tolist(), strict=True):
                start = tuple(v)
                if start not in near:
                    if len(near) > 10_000:
                        near.clear()
                    near[start] = [(_named(x), x > start) for x in reachable(start)]
                own = _named(start)
                rows.append((own, crc32(word) % cut.get(own, 1), False, False, word, n))
                rows += [(name, b, True, above, word, n) for name, above in near[start] for b in range(cut.get(name, 1))]
            kinds = (pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64())
            names = ["subtree", "block", "search", "above", "word", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    spread = words.mapInArrow(placed, _PLACED).repartition("subtree", "block").sortWithinPartitions("subtree", "block", "search")
    return spread.mapInArrow(_searched, _NEAR)


def _pairs(trie: Trie, held: list[tuple[bytes, int]], searched: list[tuple[bytes, int, bool]]) -> Iterator[pa.RecordBatch]:
    a, an, b, bn = [], [], [], []

    def passed_on() -> pa.RecordBatch:
        columns = [pa.array(a + b, pa.string()), pa.array(an + bn, pa.int64()), pa.array(b + a, pa.string()), pa.array(bn + an, pa.int64())]
        for x in (a, an, b, bn):
            x.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])

    for left, right in trie.search([w for w, _, _ in searched]):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            (w, n, above), (v, m) = searched[i], held[j]
            if above or w < v:  # a pair within one subtree is met from both sides
                a.append(w.decode("latin-1"))
                an.append(n)
                b.append(v.decode("latin-1"))
                bn.append(m)
        if len(a) >= SEARCHED:
            yield passed_on()
    yield passed_on()


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, those to be stored first."""
    name, trie = None, None
    held: list[tuple[bytes, int]] = []
    waiting: list[tuple[bytes, int, bool]] = []

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal trie
        if waiting and held:
            if trie is None:
                trie = Trie([w for w, _ in held])
            yield from _pairs(trie, held, waiting)
        waiting.clear()

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for subtree, block, search, above, word, n in zip(*columns, strict=True):
            if (subtree, block) != name:
                yield from done()
                name, trie = (subtree, block), None
                held.clear()
            if not search:
                held.append((word, n))
            elif held:
                waiting.append((word, n, above))
                if len(waiting) >= SEARCHED:
                    yield from done()
    yield from done()


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of `words` (word, n).

    `form` is the near word with the largest n, of equal ones the first in code-point order, if its n is at least
    `DOMINANCE` times the word's; `root` is where the forms of forms end, the word itself without a form.
    """
    words = words.select("word", "n")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("b"))
    known = words.join(best, "word", "left")
    large = -F.col("b.n") >= F.col("n") * DOMINANCE
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("b.near")).alias("form"), F.when(large, -F.col("b.n")).alias("form_n")))
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each turn doubles the steps; n doubles with each step, so there are few
        behind = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(behind, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").limit(1).count() == 0:
            break
        links = links.drop("moved")
    return known.join(links.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, deleted: int | None = None) -> DataFrame:
    """`variants` of the words of all texts with at least `LETTERS` letters and `OCCURRENCES` occurrences.

    Reads `doc_id` and `text` only. Null and empty texts have no words; rows without an id count, their words as they
    are; repeated rows count again. An empty table gives no rows.
    """
    counts = word_counts(docs, deleted).where((F.col("n") >= OCCURRENCES) & (F.length("word") >= LETTERS))
    return variants(stored(counts))


def oracle_sql() -> str:
    """The same in SQL: near words share what is left when a letter is deleted."""
    codes = "list_concat(list_transform(range(1, length(d) + 1), lambda k: ascii(substr(d, k, 1))::bigint), [58::bigint], flatten(list_transform(range(1, length(w) + 1), lambda k: case when unicode(substr(w, k, 1)) < 128 then [unicode(substr(w, k, 1))::bigint] else [195::bigint, unicode(substr(w, k, 1))::bigint - 64] end)))"
    return f"""
        with recursive {CRC_SQL},
        found as (
            select doc_id::varchar d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) n
            from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) w from documents) group by all),
        summed as (select d, w, n, case when d is null then 1 else {crc_sql(codes)} end h from found, crc_table),
        edited as (
            select case when h % {DELETED} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end w, n from summed),
        words as materialized (select w, sum(n)::bigint n from edited where length(w) >= {LETTERS} group by w having sum(n) >= {OCCURRENCES}),
        shorter as materialized (select w, n, k, substr(w, 1, k - 1) || substr(w, k + 1) s from (select w, n, unnest(range(1, length(w) + 1)) k from words)),
        pairs as (
            select a.w, b.w as near, b.n as near_n from shorter a join shorter b using (s, k) where a.w <> b.w
            union select a.w, b.w, b.n from shorter a join words b on a.s = b.w
            union select b.w, a.w, a.n from shorter a join words b on a.s = b.w),
        best as (select w, count(*) n_near, arg_min(near, (-near_n, encode(near))) form, max(near_n) form_n from pairs group by w),
        known as materialized (
            select w, n, coalesce(n_near, 0) n_near, case when form_n >= {DOMINANCE} * n then form end form, case when form_n >= {DOMINANCE} * n then form_n end form_n
            from words left join best using (w)),
        steps(w, target) as (
            select w, form from known where form is not null
            union all select s.w, form from steps s join known k on s.target = k.w where form is not null),
        ends as (select s.w, s.target from steps s join known k on s.target = k.w where k.form is null)
        select w as word, form, coalesce(target, w) as root, n::bigint n, n_near::bigint n_near, form_n::bigint form_n from known left join ends using (w)"""
