"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are fused for each text: how likely its bytes are in each language, the
language that the markup or the metadata declares, the suffix of the address, and which languages
the host has. The byte model is trained on a bounded sample of documents with a language. The
other three are counted over all rows: each row's language given its text alone is added up by
declaration, suffix and host with grouped aggregates. Host priors are smoothed hierarchically, a
host's by its domain's and that one's by the priors of all rows; a row's own vote is taken out of
its host's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.llm.common import slices, stored, utf8
from reelflow.llm.urls import host_and_path

#: Documents of each language in the training sample, those with the smallest hashes of their ids,
#: and how many languages there may be, the most frequent ones.
PER_LANGUAGE, LANGUAGES = 2000, 200
BUCKETS = 1 << 16
#: A text counts as this many independent byte triples at most; neighbours are not independent.
EVIDENCE = 30.0
#: Rows that the prior of the level above is worth, and the share of any declaration in any language.
HOST_ROWS, DOMAIN_ROWS, SMOOTHING = 5.0, 20.0, 1.0

#: Numbers of a table of counts that may be broadcast: 8 MB.
CELLS = 1_000_000

_TAG = re.compile(rb"<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", re.S | re.I)
_SPACE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _codes(text: bytes | None, markup: bool) -> np.ndarray:
    """Hashed byte triples of the words of a text, A-Z lowered, other ASCII than letters as one space."""
    if not text:
        return np.empty(0, np.int64)
    if markup:
        text = _TAG.sub(b" ", text)
    b = np.frombuffer(b" " + _SPACE.sub(b" ", text).lower().strip() + b" ", np.uint8).astype(np.uint32)
    return (((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        counts: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(_codes(text, False), minlength=BUCKETS)
        langs, codes, n = [], [], []
        for lang, own in counts.items():
            found = np.flatnonzero(own)
            langs += [lang] * len(found)
            codes.append(found)
            n.append(own[found])
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(join(codes), pa.int32()), pa.array(join(n), pa.int64())], ["lang", "code", "n"])


def fit(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability of each byte triple in each; empty without labels.

    The driver gets counts of at most `LANGUAGES` * `BUCKETS` triples.
    """
    given = documents.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    langs = [r.lang for r in given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not langs:
        return [], np.zeros((0, BUCKETS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = given.where(F.col("lang").isin(langs)).distinct().withColumn("rank", F.row_number().over(order))
    sample = sample.where(F.col("rank") <= PER_LANGUAGE).drop("rank")
    # at most PER_LANGUAGE * LANGUAGES short rows, whatever the input's size
    texts = documents.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = texts.mapInArrow(_gram_counts, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    langs = sorted(langs)
    counts = np.full((len(langs), BUCKETS), 0.05)
    found = rows.toPandas()
    np.add.at(counts, (np.searchsorted(langs, found.lang.to_numpy(str)), found.code.to_numpy(int)), found.n.to_numpy(float))
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def _domain(host: Column) -> Column:
    """The last two labels of a host; a source without dots is its own domain."""
    return F.substring_index(host, ".", -2)


def _declared(html: Column) -> Column:
    """The language of the first html element that has one, comments and raw text left out; else empty."""
    markup = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--(?:-?>|.*?(?:-->|\z))|<(script|style|textarea|title)\b.*?(?:</\1\b|\z)", " ")
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)<html\b([^>]*)"), 1)
    langs = F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)(?<=\s)lang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.lower(F.coalesce(F.get(F.filter(langs, lambda x: x != ""), F.lit(0)), F.lit("")))


def evidence(documents: DataFrame, pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(kind, id, host, declared, suffix, text_log): one row for each document and page.

    `text_log` are log-likelihoods by language, tempered to `EVIDENCE` triples at most. A document
    declares its `lang`, has its source as host and no address; a page declares the language of
    its html element and has as suffix the last label of its host and a two-letter path start.
    """
    langs, logs = model
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(logs.T))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, 256):
            out = []
            for text, kind in zip(utf8(batch.column(5)), batch.column(0).to_pylist(), strict=True):
                codes = _codes(text, kind == "page")
                mean = table[codes].mean(0) if len(codes) else np.zeros(table.shape[1])
                out.append(((mean - mean.max()) * min(len(codes), EVIDENCE)).tolist() if len(mean) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.list_(pa.float64()))], ["kind", "id", "host", "declared", "suffix", "text_log"])

    declared = _declared(F.col("html"))
    host, path = host_and_path(F.col("url"))
    section = F.lower(F.regexp_extract(path, r"^/([a-zA-Z]{2})(?:/|$)", 1))
    texts = documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.lower(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("declared"), F.lit("").alias("suffix"), F.col("text").alias("body"))
    web = pages.select(
        F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), host.alias("host"), declared.alias("declared"),
        F.when(host == "", "").otherwise(F.concat_ws("/", F.substring_index(host, ".", -1), section)).alias("suffix"), F.col("html").alias("body"))
    schema = "kind string, id long, host string, declared string, suffix string, text_log array<double>"
    return texts.mapInArrow(scored, schema).union(web.mapInArrow(scored, schema))


def _added(columns: list[str], by: str) -> list[Column]:
    return [F.sum(c).alias(f"{by}{k}") for k, c in enumerate(columns)]


def _with_counts(rows: DataFrame, counts: DataFrame, key: str, languages: int) -> DataFrame:
    """Rows with the counts of their `kind` and `key`; rows with an empty key have none.

    A small table is broadcast, `CELLS` numbers at most. Beyond that both sides are shuffled; rows with an empty key, which may be
    most rows, then go to places of their own that match nothing.
    """
    counts = counts.where(F.col(key) != "")
    if counts.limit(CELLS // languages + 1).count() <= CELLS // languages:
        return rows.join(F.broadcast(counts), ["kind", key], "left")
    place = F.when(F.col(key) == "", -1 - F.pmod(F.xxhash64("id", "host", "declared", "suffix", "text_log"), F.lit(1 << 30))).otherwise(F.lit(0).cast("long"))
    placed = counts.withColumn("place", F.lit(0).cast("long"))
    return rows.withColumn("place", place).join(placed, ["kind", key, "place"], "left").drop("place")


def identified(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, lang, probability, text_lang, declared, host) for every document and page.

    One of doc_id and page_id is set. `lang` is the most probable language given all evidence, of equal
    ones the first by name, `text_lang` the one given the text alone (null for a text without
    letters). Null texts, hosts and declarations are no evidence; null ids are kept; repeated rows
    are repeated. Without any labelled document every language is null. Empty tables give no rows.
    """
    model = fit(documents)
    langs = model[0]
    rows = evidence(documents, pages, model)
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select(
            F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
            none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "host")
    number = range(len(langs))
    odds = [F.exp(F.col("text_log")[k]) for k in number]
    whole = sum(odds[1:], odds[0])
    votes = [f"p{k}" for k in number]
    rows = stored(rows.select("*", *[(o / whole).alias(f"p{k}") for k, o in enumerate(odds)], _domain(F.col("host")).alias("domain")))
    overall = rows.agg(*_added(votes, "o")).first()
    prior = [((overall[k] or 0.0) + SMOOTHING) / (sum(x or 0.0 for x in overall) + SMOOTHING * len(langs)) for k in number]
    hosts = stored(rows.groupBy("kind", "host", "domain").agg(*_added(votes, "h")))
    domains = hosts.groupBy("kind", "domain").agg(*_added([f"h{k}" for k in number], "d"))
    hosts = stored(hosts.join(domains, ["kind", "domain"]).drop("domain"))
    tables = {c: rows.groupBy("kind", c).agg(*_added(votes, c[0] + "_")) for c in ("declared", "suffix")}
    totals = {c: t.groupBy("kind").agg(*_added([f"{c[0]}_{k}" for k in number], f"{c[0]}t_")) for c, t in tables.items()}
    out = _with_counts(rows, hosts, "host", len(langs))
    for c, t in tables.items():
        out = _with_counts(out, stored(t.join(totals[c], "kind")), c, len(langs))

    def log_posterior(k: int) -> Column:
        own = F.col(f"p{k}")
        domain_rows = sum((F.col(f"d{j}") for j in number[1:]), F.col("d0")) - 1
        domain = (F.greatest(F.col(f"d{k}") - own, F.lit(0.0)) + DOMAIN_ROWS * prior[k]) / (domain_rows + DOMAIN_ROWS)
        host_rows = sum((F.col(f"h{j}") for j in number[1:]), F.col("h0")) - 1
        host = (F.greatest(F.col(f"h{k}") - own, F.lit(0.0)) + HOST_ROWS * domain) / (host_rows + HOST_ROWS)
        host = F.when(F.col("host") == "", F.lit(prior[k])).otherwise(host)
        total = F.col("text_log")[k] + F.log(host)
        for c in tables:
            share = (F.greatest(F.col(f"{c[0]}_{k}") - own, F.lit(0.0)) + SMOOTHING) / (F.col(f"{c[0]}t_{k}") + SMOOTHING * 10)
            total = total + F.when(F.col(c) == "", F.lit(0.0)).otherwise(F.log(share))
        return total

    out = out.withColumn("post", F.array(*map(log_posterior, number)))
    best = F.array_max("post")
    names = F.array(*map(F.lit, langs))
    said = F.exists("text_log", lambda x: x < 0)
    return out.select(
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        F.get(names, (F.array_position("post", best) - 1).cast("int")).alias("lang"),
        F.round(1 / F.aggregate(F.transform("post", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x), 6).alias("probability"),
        F.when(said, F.get(names, (F.array_position("text_log", F.array_max("text_log")) - 1).cast("int"))).alias("text_lang"),
        "declared", "host",
    )
