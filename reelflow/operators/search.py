"""Natural-language text search and term vectors over a (film_id, title, description) table.

Ranking (the classic natural-language weight; N documents, nf documents holding the term, dtf
occurrences in the document, U distinct terms of the document, qf occurrences in the query):

    score(d) = sum over query terms
               qf * (ln(dtf) + 1) / sum_t(ln(dtf_t) + 1) * U / (1 + 0.0115 * U) * ln((N - nf) / nf)

Terms in at least `max_doc_share` of the documents and terms shorter than `min_len` are ignored,
as are stopwords.

Scale: everything about one document is computed inside its own row, so the text is never
exploded or shuffled. One scan counts the documents per query term (a single-row aggregate); the
second scan scores only documents that contain a query term. The per-term document counts, one
number per word of the query text, are the only data that every task receives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A short English stopword list. Other full-text indexes ship longer ones, so the
# functions below take the list as a parameter.
STOPWORDS = (
    "a", "about", "an", "are", "as", "at", "be", "by", "com", "de", "en", "for", "from", "how",
    "i", "in", "is", "it", "la", "of", "on", "or", "that", "the", "this", "to", "was", "what",
    "when", "where", "who", "will", "with", "und", "the", "www",
)
LENGTH_PIVOT = 0.0115
WORD_CLASS = r"\p{L}\p{N}_"


def word_pattern(min_len: int) -> str:
    return f"[{WORD_CLASS}]{{{min_len},}}"


def _document_text(cols: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *cols))


def tokens(cols: Sequence[str], stopwords: Sequence[str] = STOPWORDS, min_len: int = 4) -> Column:
    """Lower-cased words of the given columns in reading order, without short words and stopwords."""
    words = F.regexp_extract_all(_document_text(cols), F.lit(f"({word_pattern(min_len)})"), 1)
    banned = sorted({w for w in stopwords if len(w) >= min_len})
    return F.filter(words, lambda w: ~w.isin(banned)) if banned else words


def query_terms(query: str, stopwords: Sequence[str] = STOPWORDS, min_len: int = 4) -> dict[str, int]:
    """Distinct searchable words of the query text with their number of occurrences."""
    words = re.findall(r"\w+", query.lower())
    return dict(Counter(w for w in words if len(w) >= min_len and w not in stopwords))


def _has_term(text: Column, term: str) -> Column:
    """Whole-word test. The plain substring test is cheap and settles most documents."""
    return text.contains(term) & text.rlike(f"(?<![{WORD_CLASS}]){re.escape(term)}(?![{WORD_CLASS}])")


def _any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whole-word test for any of the terms in one pass, without building the word list.

    One pattern, because a filter evaluates its input text anew for every mention.
    """
    alternatives = "|".join(re.escape(t) for t in terms)
    return text.rlike(f"(?<![{WORD_CLASS}])(?:{alternatives})(?![{WORD_CLASS}])")


def _length_terms(words: Column) -> Column:
    """(U, sum over terms of ln(dtf) + 1) from one pass over the sorted word list.

    A repeated word raises its own ln(dtf) by ln(run + 1) - ln(run).
    """
    start = F.struct(
        F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("u"), F.lit(0.0).alias("norm")
    )

    def step(acc: Column, word: Column) -> Column:
        same = acc["prev"] == word
        return F.struct(
            word.alias("prev"),
            F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
            F.when(same, acc["u"]).otherwise(acc["u"] + 1).alias("u"),
            (acc["norm"] + F.when(same, F.log((acc["run"] + 1) / acc["run"])).otherwise(F.lit(1.0))).alias("norm"),
        )

    return F.aggregate(F.sort_array(words), start, step)


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def _document_frequencies(docs: DataFrame, cols: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """One row: N and, per query term, the number of documents that hold it."""
    text = _document_text(cols)
    return docs.select(text.alias("_text")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(_has_term(F.col("_text"), t)).alias(f"nf{i}") for i, t in enumerate(terms)]
    )


def _term_weights(docs: DataFrame, cols: Sequence[str], terms: Sequence[str], max_doc_share: float) -> Column:
    """Array of ln((N - nf) / nf) per query term, 0 for unknown or too common terms."""
    n = F.col("n")
    weights = [
        F.when((F.col(f"nf{i}") > 0) & (F.col(f"nf{i}") < n * max_doc_share), F.log((n - F.col(f"nf{i}")) / F.col(f"nf{i}")))
        .otherwise(F.lit(0.0))
        for i in range(len(terms))
    ]
    return _document_frequencies(docs, cols, terms).select(F.array(*weights)).scalar()


def score_documents(
    docs: DataFrame,
    cols: Sequence[str],
    query: str,
    stopwords: Sequence[str] = STOPWORDS,
    min_len: int = 4,
    max_doc_share: float = 0.5,
) -> DataFrame:
    """Rows of `docs` with a positive `score` for the query."""
    wanted = query_terms(query, stopwords, min_len)
    if not wanted:
        return docs.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    terms = list(wanted)
    candidates = docs.filter(_any_term(_document_text(cols), terms))
    split = candidates.withColumn("_words", tokens(cols, stopwords, min_len))
    measured = split.select(
        *docs.columns,
        _length_terms(F.col("_words")).alias("_len"),
        F.filter("_words", lambda w: w.isin(terms)).alias("_hits"),
        _term_weights(docs, cols, terms, max_doc_share).alias("_w"),
    )
    total: Column = F.lit(0.0)
    for i, term in enumerate(terms):
        dtf = _occurrences(F.col("_hits"), term)
        local = F.when(dtf > 0, F.log(dtf) + 1).otherwise(F.lit(0.0))
        total = total + F.lit(float(wanted[term])) * local * F.col("_w")[i]
    pivot = F.col("_len.u") / (F.lit(1.0) + F.lit(LENGTH_PIVOT) * F.col("_len.u"))
    # `explode` drops the rows without a positive score. A filter would be pushed below the
    # projections and split the text into words once per mention.
    score = F.filter(F.array(total / F.col("_len.norm") * pivot), lambda s: s > 0)
    return measured.select(*docs.columns, F.explode(score).alias("score"))


def matching_documents(
    docs: DataFrame,
    cols: Sequence[str],
    query: str,
    stopwords: Sequence[str] = STOPWORDS,
    min_len: int = 4,
    max_doc_share: float = 0.5,
) -> DataFrame:
    """Rows that match the query, without ranking.

    A document scores above zero as soon as it holds one term that is not too common, as long as
    all usable weights are positive (`max_doc_share <= 0.5`), so no word list is needed.
    """
    terms = list(query_terms(query, stopwords, min_len))
    if max_doc_share > 0.5:
        return score_documents(docs, cols, query, stopwords, min_len, max_doc_share).drop("score")
    if not terms:
        return docs.filter(F.lit(False))
    text = F.col("_text")
    useful = F.lit(False)
    for i, term in enumerate(terms):
        useful = useful | ((F.col("_w")[i] > 0) & _has_term(text, term))
    return (
        docs.withColumn("_text", _document_text(cols))
        .filter(_any_term(text, terms))
        .withColumn("_w", _term_weights(docs, cols, terms, max_doc_share))
        .filter(useful)
        .drop("_text", "_w")
    )


def _term_positions(cols: Sequence[str], min_len: int, stopwords: Sequence[str]) -> Column:
    """A document's distinct terms with their 1-based positions, ordered by term, made inside the row.

    Words are sorted by (term, position); a run of equal terms starts where a term differs from the
    one before it.
    """
    words = F.transform(tokens(cols, stopwords, min_len), lambda w, i: F.struct(w.alias("term"), (i + 1).alias("pos")))

    def runs(s: Column) -> Column:
        terms, places = s["terms"], s["places"]
        begins = F.filter(
            F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(terms, i - 1) != F.get(terms, i)))

        def one(bounds: Column) -> Column:
            return F.transform(bounds, lambda at, k: F.struct(
                F.get(terms, at).alias("term"),
                F.slice(places, at + 1, F.coalesce(F.get(bounds, k + 1), F.size(terms)) - at).alias("positions")))

        return F.get(F.transform(F.array(begins), one), F.lit(0))

    # both parts of the sorted words are bound once as arrays of their own, so that a run is one slice
    def parts(s: Column) -> Column:
        return F.struct(s["term"].alias("terms"), s["pos"].alias("places"))

    halves = F.transform(F.array(F.sort_array(words)), parts)
    return F.get(F.transform(halves, runs), F.lit(0))


def term_positions(docs: DataFrame, cols: Sequence[str], min_len: int = 1, stopwords: Sequence[str] = ()) -> DataFrame:
    """(film_id, term, positions): every word of every document with its 1-based positions."""
    entries = docs.select("film_id", F.explode_outer(_term_positions(cols, min_len, stopwords)).alias("e"))
    return entries.where("e is not null").select("film_id", "e.*")


def build_term_vectors(docs: DataFrame, cols: Sequence[str] = ("title", "description")) -> DataFrame:
    """(film_id, fulltext): a map from term to its positions, for every film. No stemming, no shuffle."""
    return docs.select("film_id", F.map_from_entries(_term_positions(cols, 1, ())).alias("fulltext"))


def build_term_index(
    docs: DataFrame,
    cols: Sequence[str] = ("title", "description"),
    buckets: int = 256,
    stopwords: Sequence[str] = STOPWORDS,
    min_len: int = 4,
) -> DataFrame:
    """Search index: (bucket, term, film_id, dtf, u, norm), one row per term and document.

    `u` and `norm` are the document's number of terms and its sum of ln(dtf) + 1, repeated on
    every row so that a lookup needs nothing else. All of it is made inside the document's row, so
    the text is read once and never shuffled.
    """

    def entries(terms: Column) -> Column:
        """The document's rows; its length terms are bound once, so the work is linear in its terms."""
        lengths = F.struct(
            F.size(terms).cast("long").alias("u"),
            F.aggregate(terms, F.lit(0.0), lambda total, t: total + F.log(F.size(t["positions"])) + 1).alias("norm"),
        )

        def rows(bound: Column) -> Column:
            return F.transform(terms, lambda t: F.struct(
                t["term"].alias("term"), F.size(t["positions"]).cast("long").alias("dtf"), bound["u"].alias("u"), bound["norm"].alias("norm")))

        return F.get(F.transform(F.array(lengths), rows), F.lit(0))

    found = F.get(F.transform(F.array(_term_positions(cols, min_len, stopwords)), entries), F.lit(0))
    # an inner explode would have the optimizer repeat the whole expression in a filter below it
    return docs.select("film_id", F.explode_outer(found).alias("e")).where("e is not null").select(
        F.pmod(F.hash("e.term"), F.lit(buckets)).alias("bucket"), "e.term", "film_id", "e.dtf", "e.u", "e.norm"
    )


def write_term_index(index: DataFrame, path: str) -> None:
    """Store the index by bucket; a bucket with a very frequent term is split over several files.

    Rows are sorted by term, so that a lookup reads the row groups of its words only.
    """
    spread = index.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup_terms(index: DataFrame, terms: Sequence[str], buckets: int = 256) -> DataFrame:
    """Index rows of the given words; a stored index is read in the words' buckets only."""
    words = [F.lit(t.lower()) for t in terms]
    wanted = F.col("bucket").isin([F.pmod(F.hash(w), F.lit(buckets)) for w in words])
    return index.filter(wanted & F.col("term").isin([t.lower() for t in terms]))


def score_with_index(
    index: DataFrame,
    n_documents: DataFrame,
    query: str,
    buckets: int = 256,
    stopwords: Sequence[str] = STOPWORDS,
    min_len: int = 4,
    max_doc_share: float = 0.5,
) -> DataFrame:
    """(film_id, score), like `score_documents`, from the index instead of the text.

    `n_documents` is a one-row, one-column DataFrame with the number of documents. Stopwords and
    minimum length must be those of the index.
    """
    wanted = query_terms(query, stopwords, min_len)
    if not wanted:
        return index.select("film_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    hits = lookup_terms(index, list(wanted), buckets)
    n = n_documents.scalar()
    counts = hits.agg(F.array(*[F.count_if(F.col("term") == t) for t in wanted])).scalar()
    held = hits.withColumn("_n", n).withColumn("_nf", counts)
    part: Column = F.lit(0.0)
    for i, (term, qf) in enumerate(wanted.items()):
        nf = F.col("_nf")[i]
        usable = (F.col("term") == term) & (nf < F.col("_n") * max_doc_share)
        part = part + F.when(usable, F.lit(float(qf)) * F.log((F.col("_n") - nf) / nf)).otherwise(F.lit(0.0))
    u = F.col("u")
    local = (F.log("dtf") + 1) / F.col("norm") * u / (F.lit(1.0) + F.lit(LENGTH_PIVOT) * u)
    return held.groupBy("film_id").agg(F.sum(part * local).alias("score")).filter(F.col("score") > 0)
