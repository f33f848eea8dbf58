"""URL verdicts: list rules first, then naive Bayes over segmented host and path tokens.

Host names and path parts are cut at every character that is no letter; what remains is split into
words by the most probable segmentation under a unigram model (Viterbi). The model counts the words
of all pages, but for the names that the page's own host is made of, and the hyphenated pieces of all
hosts. A multinomial naive Bayes
model of the words is trained on hosts, each counted once: a host is an example to block if its
words hold one of the seed words, else an example to allow. Words of no example say nothing.

The vocabulary and the log-odds are tables without a bound. Of both only what distinct hosts and
paths contain is joined to these; texts are joined by their 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import slices, stored, utf8

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SEEDS = frozenset("adult ads bet bets casino malware pills poker porn spam track tracker warez xxx".split())
#: Names that stand in many hosts and are no concatenations.
HOST_WORDS = "www blog mail shop news com net org edu gov info example test".split()
#: Longest word that the vocabulary knows, and starts of words in one batch of a run's pieces.
WORD_CHARS, RANGE = 20, 4096
SMOOTHING = 0.1

_TAG = re.compile(rb"<script.*?</script>|<style.*?</style>|<[^>]*>", re.S | re.I)
_LETTERS = re.compile(rb"[a-z]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both parts of a url; empty without `://` or for null. A-Z of the host are lowered."""
    parts = r"://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(given, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(given, parts, 2)


def matching_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits the host or a domain it is in, and its verdict; of equally long ones the longest host."""
    best, at = None, 0
    while True:
        suffix = host[at:]
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start) and (best is None or len(suffix) + len(start) > len(best[0])):
                best = suffix + start, verdict
        dot = host.find(".", at)
        if dot < 0:
            return best or (None, None)
        at = dot + 1


@dataclass
class Words:
    """Unigram log-probabilities; an unknown word costs more the longer it is."""

    log: dict[str, float]
    unknown: float

    def split(self, text: str) -> list[str]:
        """The most probable words of a run of letters; of equally probable ones the longer last word."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - WORD_CHARS), end):
                word = text[start:end]
                p = self.log.get(word)
                options.append((best[start][0] + (self.unknown - len(word) * math.log(10) if p is None else p), -start))
            score, start = max(options)
            best.append((score, -start))
        out, end = [], len(text)
        while end:
            start = best[end][1]
            out.append(text[start:end])
            end = start
        return out[::-1]

    def tokens(self, text: str) -> list[str]:
        return [w for run in re.findall("[a-z]+", text.lower()) for w in self.split(run)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        found: Counter = Counter()
        for host, html in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
            labels = (host or b"").split(b".")
            found.update(w for label in labels if b"-" in label for w in _LETTERS.findall(label) if len(w) <= WORD_CHARS)
            own = {w for label in labels if b"-" not in label for w in _LETTERS.findall(label)}
            found.update(w for w in _LETTERS.findall(_TAG.sub(b" ", html or b"").lower()) if len(w) <= WORD_CHARS and w not in own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
        )


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): the runs of a-z in page texts and hyphenated hosts."""
    host, _ = host_and_path(F.col("url"))
    return pages.select(host.alias("host"), "html").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [(k, at, r) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at, r in enumerate(re.findall("[a-z]+", t.lower()))]
        columns = zip(*found, strict=True) if found else ((), (), ())
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "at", "run"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Substrings of each run that can be words, distinct within `RANGE` starts; a longer run makes several batches."""
    for batch in slices(batches, 64):
        for k, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for first in range(0, len(run), RANGE):
                starts = range(first, min(first + RANGE, len(run)))
                found = sorted({run[a:b] for a in starts for b in range(a + 1, min(len(run), a + WORD_CHARS) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found, pa.string())], ["run_key", "word"])


def text_words(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, words) of every row (key, text) of `texts` that holds a letter; `counts` are those of `word_counts`."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    fixed = dict.fromkeys(HOST_WORDS, math.log(0.01))

    @F.udf("array<string>")
    def split(run, known):
        return Words({k.word: math.log(k.n / total) for k in known or ()} | fixed, math.log(10 / total)).split(run)

    runs = stored(texts.select("key", "text").mapInArrow(_runs, "key long, at long, run string"))
    distinct = runs.select("run").distinct().select(F.xxhash64("run").alias("run_key"), "run")
    known = distinct.mapInArrow(_pieces, "run_key long, word string").join(counts, "word").groupBy("run_key").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    words = stored(distinct.join(known, "run_key", "left").select("run", split("run", "known").alias("words")))
    listed = runs.join(words, "run").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("l"))
    return listed.select("key", F.flatten(F.transform("l", lambda x: x["words"])).alias("words"))


def fit_bayes(pairs: DataFrame, words: DataFrame, seeds: frozenset[str] = SEEDS) -> tuple[float, DataFrame]:
    """Prior log-odds of blocking, and (token, odds) of all host and path words.

    `pairs` are the distinct (host_key, path_key) of urls with a host, `words` has the words of each
    key. A host that many pages have counts once.
    """
    hosts = pairs.select(F.col("host_key").alias("key")).distinct().join(words, "key", "left")
    hosts = stored(hosts.select(F.col("key").alias("host_key"), F.coalesce("words", F.array().cast("array<string>")).alias("words")))
    block = F.exists("words", lambda w: w.isin(*sorted(seeds)))
    own = hosts.select("host_key", F.explode(F.concat("words", F.array(F.lit("")))).alias("token"))
    there = pairs.join(words.withColumnRenamed("key", "path_key"), "path_key").select("host_key", F.explode("words").alias("token"))
    found = own.union(there).distinct().join(hosts.select("host_key", block.alias("block")), "host_key")
    counted = stored(found.groupBy("token").agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("a")))
    n, all_a, all_b = counted.where("token != ''").agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    none = counted.where("token = ''").first()
    share = lambda c, whole: F.log((F.col(c) + SMOOTHING) / F.lit(whole + SMOOTHING * n))
    odds = counted.where("token != ''").select("token", (share("b", all_b) - share("a", all_a)).alias("odds"))
    return math.log(((none.b if none else 0) + SMOOTHING) / ((none.a if none else 0) + 1)), odds


def verdicts(pages: DataFrame, rules: tuple = RULES, seeds: frozenset[str] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block, words) for every row of `pages`.

    `rules` are (host, path, verdict). Reads `page_id`, `url` and, for the word model, `html`; other
    columns may have any name. A null url or one without `://` has an empty host and path and, as no
    rule fits, the prior's verdict; a null html has no words; null ids are kept; repeated rows are
    judged again. Without any host the prior allows. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", F.xxhash64("host").alias("host_key"), F.xxhash64("path").alias("path_key"))
    texts = rows.select("host").union(rows.select("path")).distinct().toDF("text").select(F.xxhash64("text").alias("key"), "text")
    words = stored(text_words(texts, stored(word_counts(pages))))
    prior, odds = fit_bayes(rows.where("host != ''").select("host_key", "path_key").distinct(), words, seeds)
    sums = words.select("key", F.explode("words").alias("token")).join(odds, "token").groupBy("key").agg(F.sum("odds").alias("odds"))
    known = stored(words.join(sums, "key", "left").select("key", F.array_join("words", " ").alias("words"), F.coalesce("odds", F.lit(0.0)).alias("odds")))
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule_host, start, verdict in rules:
        by_host.setdefault(rule_host, []).append((start, verdict))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([matching_rule(h, p, by_host) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"], dtype=object)

    rows = rows.join(known.toDF("host_key", "words", "host_odds"), "host_key", "left")
    rows = rows.join(known.select(F.col("key").alias("path_key"), F.col("odds").alias("path_odds")), "path_key", "left")
    total = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    chance = F.round(1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total)))), 6)
    rows = rows.select("page_id", "host", "path", judge("host", "path").alias("v"), chance.alias("p_block"), F.coalesce("words", F.lit("")).alias("words"))
    verdict = F.coalesce("v.verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "v.rule", verdict.alias("verdict"), "p_block", "words")
