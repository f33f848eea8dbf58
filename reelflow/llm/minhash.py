"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct five-word shingles; its sketch holds the 64 smallest
hashes. Two documents are linked if 100 * |A & B| >= 75 * |A | B|; components of links are groups
of copies. Documents with equal sets are one class, and only classes are compared:

1. Inverted lists of retained values. A linked pair shares at least `NEED` retained values: of the
   union's 64 smallest hashes each is common with probability 0.75 or more, so fewer than 20 happen
   with probability 2e-12; sets that fit into the sketch share 3/4 of it for certain. So of a
   class's values, in order of their frequency, the `NEED` - 1 most frequent need no list.
2. Each list's first class is its leader and meets every other class of the list: a number of
   pairs linear in the lists. The union sketch of a pair estimates its likeness and drops pairs
   below 20 of 64; the rest are confirmed on their full sets. Components follow.
3. Classes of one list that are not yet in one component are compared pair by pair while the list
   is short (`SHORT`).
4. Long lists are resolved on full sets: prefixes of the rarest shingles, lists, leaders and the
   positional bound again; no pair within one component is ever built, and pairs are found by
   size and remaining length of whole groups before classes are named.

Steps 3 and 4 together consider every pair that step 1 allows, so there is no cap on partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import slices, stored, utf8
from reelflow.llm.components import components
from reelflow.llm.shingles import WordHashes, digest, shingle_set

K = 64
NEED = 20
SHORT = 24

_SKETCHES = "doc_id long, n int, digest binary, sketch array<long>"
_SETS = "x long, n int, digest binary, hashes binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        found = [shingle_set(t, hashes) for t in utf8(batch.column(1))]
        kept = [s[:K] for s in found]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
        values = np.concatenate(kept) if kept else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in found], pa.int32()),
                pa.array([digest(s) for s in found], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64())),
            ],
            ["doc_id", "n", "digest", "sketch"],
        )


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        found = [shingle_set(t, hashes) for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in found], pa.int32()),
                pa.array([digest(s) for s in found], pa.binary()),
                pa.array([s.tobytes() for s in found], pa.binary()),
            ],
            ["x", "n", "digest", "hashes"],
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full sets are alike enough."""
    for batch in slices(batches, 256):
        left, right = (batch.column(k).to_pylist() for k in (2, 3))
        keep = []
        for a, b in zip(left, right, strict=True):
            a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            both = np.concatenate((a, b))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 75 * (len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        sets = [np.frombuffer(b, np.int64) for b in batch.column(2).to_pylist()]
        sizes = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)),
                pa.array(np.repeat(np.array(sizes, np.int32), sizes), pa.int32()),
                pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64()),
            ],
            ["x", "n", "v"],
        )


def _near_size(n: str, m: str) -> Column:
    return F.expr(f"100 * least({n}, {m}) >= 75 * greatest({n}, {m})")


def _reach(r: str, q: str, n: str, m: str) -> Column:
    """What is left of both from their first common value on can still make up the likeness."""
    return F.expr(f"7 * least({r}, {q}) >= 3 * ({n} + {m})")


def _lists(postings: DataFrame, need: Column) -> DataFrame:
    """(v, x, n, r): the values that must be looked up for each class, rarest first.

    `postings` is (x, n, s, v), s the number of values of x. r counts the values from v on.
    """
    often = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(often, "v").groupBy("x", "n", "s").agg(F.collect_set(F.struct("df", "v")).alias("p"))
    ordered = shared.withColumn("need", need).where("size(p) >= need").withColumn("p", F.array_sort("p"))
    return ordered.select(
        "x", "n", F.size("p").alias("left"), F.posexplode(F.slice("p", F.lit(1), F.size("p") - F.col("need") + 1)).alias("i", "e")
    ).select(F.col("e.v").alias("v"), "x", "n", (F.col("left") - F.col("i")).alias("r"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return (
        lists.join(labels.withColumnRenamed("node", "x"), "x", "left")
        .withColumn("c", F.coalesce("component", "x"))
        .drop("component")
    )


class _Comparison:
    """Full sets and sketches of the classes that share enough values with another class."""

    def __init__(self, sketches: DataFrame, sets: DataFrame):
        self.sketches, self.sets = sketches, sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the union sketch lets pass and the full sets confirm, written out."""
        left = self.sketches.select(F.col("x").alias("a"), F.col("sketch").alias("p"))
        right = self.sketches.select(F.col("x").alias("b"), F.col("sketch").alias("q"))
        union = F.slice(F.array_sort(F.array_union("p", "q")), 1, K)
        common = F.size(F.array_intersect("union", F.array_intersect("p", "q")))
        alike = F.when(F.size("union") < K, common * 4 >= F.size("union") * 3).otherwise(common >= NEED)
        likely = stored(pairs.join(left, "a").join(right, "b").withColumn("union", union).where(alike).select("a", "b"))
        left = self.sets.select(F.col("x").alias("a"), F.col("hashes").alias("p"))
        right = self.sets.select(F.col("x").alias("b"), F.col("hashes").alias("q"))
        both = likely.join(left, "a").join(right, "b").select("a", "b", "p", "q")
        return stored(both.mapInArrow(_confirm, "a long, b long"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, sketch) for every row; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, _SKETCHES)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of `docs`.

    Uses the columns `doc_id` and `text`; others may have any name. Null or blank text: an empty set,
    linked with nothing. Null doc_id: no part in any link, component_id null, kept. Rows that
    repeat a doc_id are one document; if their texts differ, the set with the smallest digest stands
    for it and each row still reports its own n_shingles. An empty table gives an empty result.
    """
    rows = stored(sketches(docs))
    named = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    classes = stored(
        rows.where("n > 0").join(named, ["doc_id", "digest"], "left_semi").groupBy("digest").agg(F.min("doc_id").alias("x"))
    )
    ids = classes.select(F.col("x").alias("doc_id"), "digest")
    own = rows.join(ids, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("x"), "n", "sketch")
    postings = own.select("x", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    lists = stored(_lists(postings, F.expr(f"least({NEED}, (3 * s + 3) div 4)")))
    links = _linked(docs, rows, lists, ids)
    labels = components(links).select(F.col("node").alias("x"), "component")
    found = (
        named.join(classes, "digest", "left")
        .join(labels, "x", "left")
        .select("doc_id", F.coalesce("component", "x", "doc_id").alias("component_id"))
    )
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept")
    )


def _linked(docs: DataFrame, rows: DataFrame, lists: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b): links enough to connect every component."""
    suspects = stored(lists.select("x").distinct().join(ids, F.col("x") == F.col("doc_id")).select("doc_id", "digest"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = texts.join(suspects.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(_full, _SETS).join(suspects.withColumnRenamed("doc_id", "x"), ["x", "digest"], "left_semi"))
    small = stored(rows.join(suspects, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("x"), "sketch").distinct())
    compare = _Comparison(small, sets)

    # every class of a list against the list's first one
    first = lists.groupBy("v").agg(F.min(F.struct(F.col("x").alias("y"), F.col("n").alias("m"))).alias("f"), F.count("*").alias("size"))
    first = first.where("size > 1").select("v", "f.y", "f.m")
    links = compare.links(_pairs(lists.join(first, "v").where("x <> y").where(_near_size("n", "m"))))

    # what is left of each list that is not one component yet
    here = _labelled(lists, components(links))
    state = here.groupBy("v").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    here = stored(here.join(state.select("v", "size"), "v"))
    short = here.where(f"size <= {SHORT}").select("v", "x", "n", "c")
    other = short.select("v", F.col("x").alias("y"), F.col("n").alias("m"), F.col("c").alias("d"))
    pairs = short.join(other, "v").where("x < y and c <> d").where(_near_size("n", "m"))
    links = links.union(compare.links(_pairs(pairs)))
    hot = stored(here.where(f"size > {SHORT}").select("x").distinct())
    if hot.isEmpty():
        return links
    return links.union(_hot_links(compare, hot, links))


def _hot_links(compare: _Comparison, hot: DataFrame, links: DataFrame) -> DataFrame:
    """Links among the classes of long lists, by exact prefixes of their full sets."""
    full = compare.sets.join(hot, "x", "left_semi").select("x", "n", "hashes").mapInArrow(_explode, "x long, n int, v long")
    lists = stored(_lists(full.withColumn("s", F.col("n")), F.expr("(3 * s + 3) div 4")))
    # the class with most of its values still to come is the most central one
    lead = lists.groupBy("v").agg(
        F.min(F.struct((-F.col("r")).alias("q"), F.col("x").alias("y"), F.col("n").alias("m"))).alias("f"), F.count("*").alias("size")
    )
    lead = stored(lead.where("size > 1").select("v", "f.y", "f.m", (-F.col("f.q")).alias("q")))
    pairs = lists.join(lead, "v").where("x <> y").where(_near_size("n", "m")).where(_reach("r", "q", "n", "m"))
    found = compare.links(_pairs(pairs))

    labels = components(links.union(found))
    here = stored(_labelled(lists, labels))
    main = _labelled(lead.select("v", F.col("y").alias("x")), labels).select("v", F.col("c").alias("main"))
    here = stored(here.join(main, "v").withColumn("inside", F.expr("c = main")).drop("main"))
    loose = here.where("not inside").select("v", "n", "r").distinct()
    kinds = here.select("v", "inside", F.col("n").alias("m"), F.col("r").alias("q")).distinct()
    fitting = stored(loose.join(kinds, "v").where(_near_size("n", "m")).where(_reach("r", "q", "n", "m")))
    left = here.where("not inside").select("v", "n", "r", "x", "c")
    right = here.select("v", "inside", F.col("n").alias("m"), F.col("r").alias("q"), F.col("x").alias("y"), F.col("c").alias("d"))
    pairs = left.join(fitting, ["v", "n", "r"]).join(right, ["v", "inside", "m", "q"]).where("c <> d")
    return found.union(compare.links(_pairs(pairs)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept: one of each group of copies.

    Of rows that repeat a kept doc_id the one with the smallest text stays; rows without an id stay.
    """
    columns = docs.columns
    decided = stored(near_duplicates(docs))
    dropped = decided.where("not kept").select("doc_id").distinct()
    kept = docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*columns)
    repeated = stored(decided.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti").select(*columns)
    again = kept.join(repeated, "doc_id", "left_semi").select(*columns)
    first = again.groupBy(F.col("doc_id").alias("id")).agg(F.min_by(F.struct(*columns), F.coalesce("text", F.lit(""))).alias("row"))
    return once.union(first.select("row.*"))
