"""A stored text index that is kept up by changes, and searches for phrases.

The index lives in one folder and is written in segments, numbered upwards, that are never rewritten:
`postings/segment=k/bucket=b` (term, film_id, dtf, u, norm, positions), `documents/segment=k` (film_id) and
`tombstones/segment=k` (film_id). A segment of changes has a tombstone for each film it touches and the postings of the
films' new versions. A posting counts if no later segment has a tombstone of its film, so the newest
version of a film wins and a deleted film has none. `merge_segments` writes what counts as a new index.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.operators.changes import effective_changes
from reelflow.operators.search import STOPWORDS, build_term_index, score_with_index, term_positions

COLUMNS = ("title", "description")
BUCKETS = 64


def positional_postings(docs: DataFrame, cols: Sequence[str] = COLUMNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, film_id, positions): every word of every document with its 1-based positions, no shuffle."""
    found = term_positions(docs, cols)
    return found.select(F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket"), "term", "film_id", "positions")


def phrase_words(phrase: str) -> list[str]:
    """The words of a phrase as the index has them: lower-cased, none left out."""
    import re

    return re.findall(r"\w+", phrase.lower())


def _less(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def find_phrase(postings: DataFrame, phrase: str, buckets: int = BUCKETS) -> DataFrame:
    """(film_id, n_hits, first_position) of the documents that hold the words of `phrase` one after the other.

    Only the buckets of these words are read. Each word's positions, less its place in the phrase, are where the
    phrase would begin; what all words agree on is where it does. Lists of one document and word meet, nothing larger.
    """
    words = phrase_words(phrase)
    distinct = list(dict.fromkeys(words))
    if not words:
        return postings.select("film_id", F.lit(0).cast("long").alias("n_hits"), F.lit(0).alias("first_position")).where(F.lit(False))
    wanted = F.col("bucket").isin([F.pmod(F.hash(F.lit(w)), F.lit(buckets)) for w in distinct])
    hits = postings.where(wanted & F.col("term").isin(distinct))
    by_word = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"w{k}") for k, w in enumerate(distinct)]
    rows = hits.groupBy("film_id").agg(*by_word)
    lists = [_less(F.col(f"w{distinct.index(word)}"), place) for place, word in enumerate(words)]
    begins = reduce(F.array_intersect, lists)
    # a word that is missing makes the list NULL
    found = rows.select("film_id", begins.alias("b")).where("size(b) > 0")
    return found.select("film_id", F.size("b").cast("long").alias("n_hits"), F.array_min("b").alias("first_position"))


def _write(df: DataFrame, path: str, kind: str, segment: int, by_bucket: bool = False) -> None:
    target = f"{path.rstrip('/')}/{kind}/segment={segment}"
    if by_bucket:
        spread = df.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(target)
    else:
        df.write.mode("overwrite").parquet(target)


def _postings(docs: DataFrame, stopwords: Sequence[str], min_len: int) -> DataFrame:
    index = build_term_index(docs, COLUMNS, BUCKETS, stopwords, min_len)
    return index.select("bucket", "term", "film_id", "dtf", "u", "norm")


def create_index(docs: DataFrame, path: str, stopwords: Sequence[str] = STOPWORDS, min_len: int = 4) -> None:
    """Segment 0: all films of `docs` (film_id, title, description), which are unique by film_id."""
    _write(_postings(docs, stopwords, min_len), path, "postings", 0, by_bucket=True)
    _write(docs.select("film_id"), path, "documents", 0)
    _write(docs.select("film_id").limit(0), path, "tombstones", 0)


def apply_changes(changes: DataFrame, path: str, segment: int, null_safe: bool = False, stopwords: Sequence[str] = STOPWORDS, min_len: int = 4) -> None:
    """Write film changes, as `sync_film_text` takes them, as one more segment.

    Work and files are those of the changed films; no older segment is read or rewritten. Writing a segment number again
    replaces that segment, so a replayed batch does no harm.
    """
    done = effective_changes(changes, null_safe)
    fresh = done.where("op <> 'delete'").select(F.col("new_film_id").alias("film_id"), F.col("new_title").alias("title"), F.col("new_description").alias("description"))
    touched = done.where("op <> 'insert'").select(F.col("old_film_id").alias("film_id")).union(fresh.select("film_id")).distinct()
    _write(_postings(fresh, stopwords, min_len), path, "postings", segment, by_bucket=True)
    _write(fresh.select("film_id"), path, "documents", segment)
    _write(touched, path, "tombstones", segment)


def _counting(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.parquet(f"{path.rstrip('/')}/{kind}")
    last = spark.read.parquet(f"{path.rstrip('/')}/tombstones").groupBy("film_id").agg(F.max("segment").alias("touched"))
    return rows.join(last, "film_id", "left").where("touched is null or segment >= touched").drop("touched")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings that count, number of documents): what `score_with_index` takes, with `BUCKETS` buckets."""
    documents = _counting(spark, path, "documents").agg(F.count(F.lit(1)).alias("n"))
    return _counting(spark, path, "postings").drop("segment"), documents


def search_index(spark: SparkSession, path: str, query: str, stopwords: Sequence[str] = STOPWORDS, min_len: int = 4, max_doc_share: float = 0.5) -> DataFrame:
    """(film_id, score), equal to `score_documents` over the films as they are after all segments."""
    postings, documents = read_index(spark, path)
    return score_with_index(postings, documents, query, BUCKETS, stopwords, min_len, max_doc_share)


def merge_segments(spark: SparkSession, path: str, target: str) -> None:
    """A new index in the folder `target` with one segment, equal in all searches; the old one stays as it is."""
    _write(_counting(spark, path, "postings").drop("segment"), target, "postings", 0, by_bucket=True)
    _write(_counting(spark, path, "documents").select("film_id"), target, "documents", 0)
    _write(spark.read.parquet(f"{path.rstrip('/')}/tombstones").select("film_id").limit(0), target, "tombstones", 0)
