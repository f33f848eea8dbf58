"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Items are cut into segments of at most `SEGMENT` words; a segment is one entry of the inverted
index. A document is read as overlapping passages of 2 * `SEGMENT` words, one every `SEGMENT`
words, so each segment that occurs in it lies wholly in one passage. The score of an entry is its
BM25 score against the passage's distinct words, divided by its score against itself.

Block-max WAND retrieves every entry of at least `THRESHOLD`:

* Entries are numbered, and each word's posting list has the maximum of its scores in each block
  of `BLOCK` entries. Over a whole batch of passages at once, block maxima are added up per
  (passage, block). The most frequent words of a block whose maxima sum to `TAIL` at most are
  only added as that sum. A passage none of whose blocks reaches the threshold retrieves nothing.
* Only in the blocks that can reach it are the cursors of the posting lists moved, by WAND: the
  pivot is the first entry at which the lists' maxima reach the threshold, and what remains is
  scored in full.

A retrieved item is reported if at least half of the five-word runs of its question and half of
those of its answer (its last sentence) occur in the document.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.llm.common import slices, tokens, utf8

SEGMENT = 64
THRESHOLD = 0.6
OVERLAP = 0.5
RUN = 5
BLOCK = 2
TAIL = 0.25
K1, B = 1.2, 0.75
#: Characters of items in one index; more items make several indexes of this size.
INDEX_CHARS = 16_000_000

_SENTENCE = re.compile(rb"[.!?][\"')\]]*\s+")
_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_TERMS = "shard int, item long, segment int, term binary, tf int, size int"


def question_and_answer(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """An item's words up to its last sentence, and those of its last sentence.

    Without an inner sentence end, or with fewer than three words after it, the answer is the
    last quarter of the words.
    """
    whole = tokens(text)
    ends = [m.end() for m in _SENTENCE.finditer((text or b"").strip())]
    answer = tokens((text or b"").strip()[ends[-1] :]) if ends else []
    if not 3 <= len(answer) < len(whole):
        answer = whole[len(whole) - max(1, len(whole) // 4) :] if whole else []
    return whole[: len(whole) - len(answer)], answer


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        rows = []
        for shard, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            found = tokens(text)
            for at in range(0, len(found), SEGMENT):
                part = found[at : at + SEGMENT]
                rows += [(shard, item, at // SEGMENT, w, part.count(w), len(part)) for w in dict.fromkeys(part)]
        names = ["shard", "item", "segment", "term", "tf", "size"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


@dataclass
class Index:
    """One bounded inverted index: posting lists sorted by entry, and their block maxima."""

    terms: dict[bytes, int]
    items: np.ndarray  # item number of each entry
    ids: list  # item_id of each item number
    runs: list  # per item: runs of the question, runs of the answer
    starts: np.ndarray  # posting list of term t: starts[t] to starts[t + 1]
    entries: np.ndarray
    scores: np.ndarray
    block_starts: np.ndarray  # block maxima of the essential terms, as the lists
    blocks: np.ndarray
    block_peaks: np.ndarray
    tails: np.ndarray  # what a block's other terms can add

    @classmethod
    def build(cls, rows: list, texts: list, ids: dict | None = None) -> Index:
        """`rows`: (item, segment, term, score), `texts`: (item, text), both of one shard.

        An item is any number of its own; `ids` has the item_id of each, the number itself if not given.
        """
        order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows})
        entry = {k: n for n, k in enumerate(order)}
        terms = {word: n for n, word in enumerate(sorted({bytes(r[2]) for r in rows}))}
        postings = sorted((terms[bytes(r[2])], entry[r[0] is None, r[0] or 0, r[1]], r[3]) for r in rows)
        t, e = (np.array([p[k] for p in postings], np.int64) for k in (0, 1))
        s = np.array([p[2] for p in postings], float)
        total = np.bincount(e, s, len(order))
        s = s / np.maximum(total[e], 1e-300)
        df = np.bincount(t, minlength=len(terms))
        # block maxima; t and e are sorted, so equal (term, block) stand together
        key = t * (len(order) // BLOCK + 1) + e // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        peak = np.maximum.reduceat(s, first) if len(first) else np.empty(0)
        bt, bb = t[first], e[first] // BLOCK
        common = np.lexsort((bt, -df[bt], bb))  # per block the most frequent terms first
        tails, essential = np.zeros(len(order) // BLOCK + 1), np.ones(len(bt), bool)
        for k in common:
            if tails[bb[k]] + peak[k] <= TAIL:
                tails[bb[k]] += peak[k]
                essential[k] = False
        bt, bb, peak = bt[essential], bb[essential], peak[essential]
        numbers = {}
        items = np.array([numbers.setdefault(k[:2], len(numbers)) for k in order], np.int64)
        by_id = {(i is None, i or 0): question_and_answer(x) for i, x in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, r[1]))}
        runs = [tuple(_runs([terms[w] for w in part]) for part in by_id[k]) for k in numbers]
        bounds = lambda x: np.searchsorted(x, np.arange(len(terms) + 1))
        ids = [None if k[0] else ids[k[1]] if ids else k[1] for k in numbers]
        return cls(terms, items, ids, runs, bounds(t), e, s, bounds(bt), bb, peak, tails)


def _runs(numbers: list[int]) -> set[tuple]:
    """Runs of five words; a shorter text is one run."""
    size = min(RUN, len(numbers))
    return set(zip(*(numbers[k : len(numbers) - size + 1 + k] for k in range(size)), strict=True)) if size else set()


def _share(wanted: set, there: dict[int, set]) -> float:
    return sum(r in there[len(r)] for r in wanted) / len(wanted) if wanted else 1.0


def likely_passages(index: Index, numbers: np.ndarray, blocks: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(first text block, block of entries) of every passage and block that can reach the threshold.

    `numbers`: the words of many documents; `blocks`: the text block of each; `last`: of each text
    block, whether it is its document's last one.
    """
    known = numbers >= 0
    at, size = blocks[known], len(index.terms) + 1
    pair = np.unique(at * size + numbers[known])  # a word counts once in a text block
    at, term = pair // size, pair % size
    count = index.block_starts[term + 1] - index.block_starts[term]
    at, term, count = at[count > 0], term[count > 0], count[count > 0]
    if not len(at):
        return np.empty((0, 2), np.int64)
    ends = np.cumsum(count)
    where = np.arange(ends[-1]) + np.repeat(index.block_starts[term] - (ends - count), count)
    width = len(index.tails)
    key, inverse = np.unique(np.repeat(at, count) * width + index.blocks[where], return_inverse=True)
    bound = np.bincount(inverse, index.block_peaks[where], len(key))
    after = np.searchsorted(key, key + width)
    follows = (after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + width) & ~last[key // width]
    whole = bound + np.where(follows, bound[np.minimum(after, len(key) - 1)], 0) + index.tails[key % width]
    key = key[whole >= THRESHOLD - 1e-9]
    return np.stack((key // width, key % width), 1)


def retrieve(index: Index, terms: list[int], block: int) -> dict[int, float]:
    """Entry -> score of all entries of the block that reach the threshold, by WAND.

    List maxima are those inside the block. The pivot is the first entry at which the lists up to
    it can reach the threshold; lists before it move up to it, and only a pivot on which the
    first list already stands is scored.
    """
    cursors = []
    for t in terms:
        lo, hi = int(index.starts[t]), int(index.starts[t + 1])
        at = lo + int(index.entries[lo:hi].searchsorted(block * BLOCK))
        end = lo + int(index.entries[lo:hi].searchsorted((block + 1) * BLOCK))
        if at < end:
            cursors.append((index.entries[at:end].tolist(), index.scores[at:end].tolist(), max(index.scores[at:end].tolist())))
    found: dict[int, float] = {}
    least = THRESHOLD - 1e-9
    while cursors:
        cursors.sort(key=lambda c: c[0][0])
        bound, pivot = 0.0, None
        for own, _, peak in cursors:
            bound += peak
            if bound >= least:
                pivot = own[0]
                break
        if pivot is None:
            break
        if cursors[0][0][0] == pivot:
            score = sum(c[1][0] for c in cursors if c[0][0] == pivot)
            if score >= least:
                found[pivot] = score
            pivot += 1
        moved = []
        for own, scores, peak in cursors:
            at = bisect_left(own, pivot)
            if at < len(own):
                moved.append((own[at:], scores[at:], peak))
        cursors = moved
    return found


def _scan(index: Index, texts: list[bytes | None]) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item number, score, question overlap, answer overlap) of every verified retrieval."""
    found = [tokens(t) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    numbers = np.fromiter(map(index.terms.get, chain.from_iterable(found), repeat(-1)), np.int64, int(sizes.sum()))
    n_blocks = -(-sizes // SEGMENT)
    block_at, word_at = np.cumsum(n_blocks) - n_blocks, np.cumsum(sizes) - sizes
    inside = np.arange(len(numbers)) - np.repeat(word_at, sizes)
    blocks = inside // SEGMENT + np.repeat(block_at, sizes)
    last = np.zeros(int(n_blocks.sum()) + 1, bool)
    last[(block_at + n_blocks - 1)[n_blocks > 0]] = True
    best: dict[tuple[int, int], float] = {}
    for block, of_entries in likely_passages(index, numbers, blocks, last).tolist():
        row = int(np.searchsorted(block_at, block, "right")) - 1
        while not n_blocks[row]:
            row -= 1
        start = int(word_at[row]) + (block - int(block_at[row])) * SEGMENT
        passage = numbers[start : min(start + 2 * SEGMENT, int(word_at[row] + sizes[row]))]
        for entry, score in retrieve(index, np.unique(passage[passage >= 0]).tolist(), of_entries).items():
            key = row, int(index.items[entry])
            best[key] = max(best.get(key, 0.0), score)
    there: dict[int, set] = {}
    seen = -1
    for (row, item), score in sorted(best.items()):
        if row != seen:
            own, seen = numbers[word_at[row] : word_at[row] + sizes[row]].tolist(), row
            there = {k: set(zip(*(own[j : len(own) - k + 1 + j] for j in range(k)), strict=True)) for k in range(1, RUN + 1)}
        question, answer = (_share(r, there) for r in index.runs[item])
        if question >= OVERLAP and answer >= OVERLAP:
            yield row, item, score, question, answer


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of bounded size over all items; document frequencies and lengths are global."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    # item_ids may be null or repeat with other texts; each distinct pair is an item
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = math.ceil(chars / INDEX_CHARS)
    if not shards:
        return
    sharded = items.select(F.pmod("item", F.lit(shards)).cast("int").alias("shard"), "item", "text", "item_id")
    terms = sharded.select("shard", "item", "text").mapInArrow(_item_terms, _TERMS).distinct()
    totals = terms.groupBy("shard", "item", "segment").agg(F.first("size").alias("size")).agg(F.count("*"), F.avg("size")).first()
    if not totals[0]:
        return
    idf = F.log(1 + (F.lit(float(totals[0])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / float(totals[1])))
    scored = terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("score", score)
    for shard in range(shards):
        rows = scored.where(F.col("shard") == shard).select("item", "segment", "term", "score").collect()
        texts = sharded.where(F.col("shard") == shard).select("item", F.col("text").cast("binary"), "item_id").collect()
        if rows:
            yield Index.build([tuple(r) for r in rows], [(r[0], bytes(r[1])) for r in texts], {r[0]: r[2] for r in texts})


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): verified items of each document.

    Reads `doc_id`, `text` of `docs` and `item_id`, `text` of `benchmark`; other columns may have
    any name. Null and blank texts and items without a word match nothing. Null ids are reported as
    null. Repeated rows report again; items of equal text are all reported. If an item_id, or
    null, repeats with different texts, each of them is an item and reported under that id. An empty table on either
    side gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], _FOUND)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast([getattr(index, f.name) for f in fields(index)])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in slices(batches, 256):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], index.ids[i], round(s, 6), round(q, 6), round(a, 6)) for r, i, s, q, a in _scan(index, utf8(batch.column(1)))]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        out = out.union(texts.mapInArrow(scan, _FOUND))
    return out


def is_contaminated(text: Column, index: Index) -> Column:
    """Whether a text holds a verified item of the index; null is empty."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast([getattr(index, f.name) for f in fields(index)])

    @F.pandas_udf("boolean")
    def dirty(texts: pd.Series) -> pd.Series:
        index = Index(*shared.value)
        found = np.zeros(len(texts), bool)
        for start in range(0, len(texts), 256):
            for row, *_ in _scan(index, texts.iloc[start : start + 256].tolist()):
                found[start + row] = True
        return pd.Series(found)

    return dirty(F.coalesce(text, F.lit("")).cast("binary"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a verified item in their text; nothing is shuffled."""
    out = docs
    for index in indexes(benchmark):
        out = out.where(~is_contaminated(F.col("text"), index))
    return out
