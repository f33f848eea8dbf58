"""SpotSigs fingerprints in column expressions only.

A signature is a common word (an anchor) with the two content words that follow it, other common
words skipped. A text's fingerprint names the set of its distinct signatures; a text without any
has one signature, itself. Texts are compared by the Jaccard likeness of their sets.

`near_duplicates` joins sets by likeness: sets are partitioned by their length so that only sets
of the same or the next partition can be alike, and within a partition sets that share one of their
rarest signatures are compared, unless lengths and remaining signatures rule the pair out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.llm.common import stored
from reelflow.llm.components import components

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it not of on or she that the they this to was were "
    "which with you au ce dans de des du elle en est et il la le les mais ou par pas pour que qui se sur un une aber als auch "
    "auf das dem den der die ein eine er es für ich ist mit nicht sich sie und von wie zu al como con del el ella esta lo los "
    "las más no o para pero por su una y"
).split()
CHAIN = 2
LIKENESS = 0.75
#: Rows of one ordered part of the table: at least this many, or the square root of all rows over 8.
PART_ROWS = 256
_GAP = r"[\s.,;:!?\"'()]+"


def signatures(text: Column) -> Column:
    """The distinct signatures of a text as 64-bit hashes; none for an empty one."""
    common = lambda w: w.isin(ANCHORS)

    def found(words: Column) -> Column:
        content = F.filter(words, lambda w: ~common(w))
        anchors = F.filter(F.transform(words, lambda w, i: F.when(common(w), F.struct(w.alias("w"), i.alias("i")))), lambda s: s.isNotNull())

        def chains(both: Column) -> Column:
            # the k-th common word at place i has i - k content words before it
            chain = F.transform(both["anchors"], lambda s, k: F.when(
                s["i"] - k + CHAIN <= F.size(both["content"]),
                F.xxhash64(s["w"], *(F.get(both["content"], s["i"] - k + c) for c in range(CHAIN)))))
            return F.array_distinct(F.filter(chain, lambda x: x.isNotNull()))

        return F.get(F.transform(F.array(F.struct(content.alias("content"), anchors.alias("anchors"))), chains), F.lit(0))

    words = F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")
    out = F.get(F.transform(F.array(words), found), F.lit(0))
    whole = F.when(text == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(text, F.lit(0))))
    return F.get(F.transform(F.array(out), lambda s: F.when(F.size(s) > 0, s).otherwise(whole)), F.lit(0))


def fingerprint(found: Column) -> Column:
    """The number of signatures and 128 bits of their set."""
    ordered = F.array_sort(found)
    code = F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), ordered))), 16, "0") for k in range(2)))
    return F.concat(F.size(found).cast("string"), F.lit("-"), code)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each row and the next one by descending doc_id.

    After the last row comes the first. Equal ids stand by text, null ids last. Rows are dealt into
    ordered parts of doc_id, about as many as the square root of the rows at most; the first row of
    each part is also dealt to the part before it, so one shuffle of the texts does.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least, most, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    size = max(PART_ROWS, math.isqrt(count) // 8)
    low, width = least or 0, max(1, -(-((most or 0) - (least or 0) + 1) * size // max(count, 1)))
    part = F.coalesce(F.floor((F.col("doc_id").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")) / F.lit(str(width)).cast("decimal(38,0)")).cast("long"), F.lit(-1))
    rows = rows.withColumn("part", part)
    firsts = rows.groupBy("part").agg(F.max("doc_id").alias("first"))
    everywhere = Window.orderBy(F.desc("part"))
    firsts = stored(firsts.select("first", F.coalesce(F.lag("part").over(everywhere), F.min("part").over(Window.partitionBy())).alias("part")))
    moved = rows.drop("part").join(firsts, F.expr("doc_id <=> first")).select("doc_id", "text", "part", F.lit(1).alias("moved"))
    dealt = rows.withColumn("moved", F.lit(0)).unionByName(moved).repartition("part")
    order = Window.partitionBy("part").orderBy("moved", F.desc_nulls_last("doc_id"), "text")
    signed = dealt.withColumn("sigs", signatures(F.col("text")))
    follows = F.lead(F.struct("text", "sigs")).over(order)
    out = signed.withColumn("next", follows).where("moved = 0")
    return out.select("doc_id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of `docs`, of its edited text, and how alike they are.

    The edited text has its last half (rounded down, code points) replaced by as many code points
    from the start of the next document. Only `doc_id` and `text` are read; null text is empty;
    null ids are kept and come last. Repeated rows follow one another. An empty table gives an
    empty result; a single document is its own next one.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    rows = rows.select("doc_id", "text", "sigs", "next_sigs", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("own"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("own")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("own")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
        length_partition(F.size("sigs")).alias("length_partition"),
    )


def length_partition(size: Column) -> Column:
    """Sets that are alike are in the same partition or in neighbouring ones; -1 for empty sets."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / math.log(1 / LIKENESS)).cast("int")).otherwise(-1)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): documents linked by a likeness of `LIKENESS` or more of their signatures.

    Equal sets are one class. Classes are looked up by their rarest signatures, which two alike sets
    must share, within a length partition and the next one; a pair is counted only if lengths and
    the signatures that remain can make up the likeness. Empty texts and null ids are linked with nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    rows = stored(rows.withColumn("f", fingerprint(F.col("sigs"))))
    named = rows.where("doc_id is not null and size(sigs) > 0")
    classes = stored(named.groupBy("f").agg(F.min("doc_id").alias("x"), F.min("sigs").alias("sigs")))
    postings = classes.select("x", F.size("sigs").alias("n"), F.explode("sigs").alias("v"))
    often = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(often, "v").groupBy("x", "n").agg(F.array_sort(F.collect_set(F.struct("df", "v"))).alias("p"))
    shared = shared.withColumn("need", F.expr("(3 * n + 3) div 4")).where("size(p) >= need")
    prefix = shared.select("x", "n", F.size("p").alias("left"), F.posexplode(F.slice("p", F.lit(1), F.size("p") - F.col("need") + 1)).alias("i", "e"))
    prefix = prefix.select("x", "n", (F.col("left") - F.col("i")).alias("r"), F.col("e.v").alias("v"), length_partition(F.col("n")).alias("k"))
    probe = prefix.withColumn("k", F.explode(F.array("k", F.col("k") - 1)))
    index = prefix.select("k", "v", F.col("x").alias("y"), F.col("n").alias("m"), F.col("r").alias("q"))
    pairs = probe.join(index, ["k", "v"]).where("x <> y and (n > m or (n = m and x < y))")
    pairs = pairs.where("4 * m >= 3 * n and 7 * least(r, q) >= 3 * (n + m)").select("x", "y").distinct()
    pairs = pairs.join(classes.select("x", F.col("sigs").alias("a")), "x").join(classes.select(F.col("x").alias("y"), F.col("sigs").alias("b")), "y")
    links = pairs.where(likeness(F.col("a"), F.col("b")) >= LIKENESS).select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(links).select(F.col("node").alias("x"), "component")
    found = classes.join(labels, "x", "left").select("f", F.coalesce("component", "x").alias("component_id"))
    out = rows.join(found, "f", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
