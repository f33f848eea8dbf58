"""Mixing documents to target weights by iterative proportional fitting (raking).

Tokens are counted per cell (source, language, topic). A cell's weight is the product of three
factors, one for each margin, raked in turn until `SWEEPS` sweeps are done: each source's
weighted tokens become its target, then each language's, then each topic's. A document is kept
with the probability min(1, scale * weight of its cell), the scale chosen so that the expected
tokens are the budget's share of all; the draw is a hash of the doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import stored

SWEEPS = 8
ROUNDS = 8
BUDGET = 0.5
#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
_BLANK = r"[\x20\x09-\x0D]+"
#: Characters counted as symbols.
SYMBOLS = "#$%&*@+=<>|~^_{}"
DIGITS = "0123456789"


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _BLANK), lambda w: w != "")).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A plain topic of the whole text: the first rule that holds."""
    share = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return (
        F.when(F.contains(F.lower(text), F.lit("license")), "license")
        .when(share(SYMBOLS) * 50 >= F.greatest(F.length(text), F.lit(1)), "symbols")
        .when(share(DIGITS) * 50 >= F.greatest(F.length(text), F.lit(1)), "digits")
        .when(tokens < 100, "short")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """(document, doc_id, source, lang, topic, n_tokens); `document` is the whole row.

    Null text is empty, null source and lang are `(none)`.
    """
    counted = docs.select(
        F.struct(*docs.columns).alias("document"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    counted = counted.withColumn("n_tokens", n_tokens(F.col("text")))
    return counted.withColumn("topic", topic(F.col("text"), F.col("n_tokens"))).drop("text")


def _lookup(column: str, values: dict[str, float]) -> Column:
    pairs = [x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.create_map(*pairs)[F.col(column)] if pairs else F.lit(None).cast("double")


def _tempered(totals: dict[str, float]) -> dict[str, float]:
    """Target shares: square roots of the observed tokens, made to sum to 1."""
    whole = math.fsum(math.sqrt(v) for v in totals.values())
    return {k: math.sqrt(v) / whole for k, v in totals.items()}


def _margin(matrix: dict[tuple[str, str], float], at: int) -> dict[str, float]:
    out: dict[str, list[float]] = {}
    for key, value in sorted(matrix.items()):
        out.setdefault(key[at], []).append(value)
    return {k: math.fsum(v) for k, v in out.items()}


def weights(rows: DataFrame, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> tuple[DataFrame, float]:
    """(source, lang, topic, n, weight) for each cell with tokens, and the scale of the probabilities.

    `rows` is what `described` gives. Targets of languages and topics are shares by name; by default,
    as for sources, the square roots of what is there. Weights are 1 on average over all tokens.
    The driver holds sums by language and topic only, at most six times the number of languages;
    source margins, of which there may be many, are Spark aggregates.
    """
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("n")).where("n > 0")
    cells = stored(cells)
    matrix = {(r.lang, r.topic): r.v for r in cells.groupBy("lang", "topic").agg(F.sum("n").alias("v")).collect()}
    total = math.fsum(matrix.values())
    languages, topics = languages or _tempered(_margin(matrix, 0)), topics or _tempered(_margin(matrix, 1))
    by_source = cells.groupBy("source").agg(F.sqrt(F.sum("n")).alias("t"))
    roots = by_source.agg(F.sum("t")).first()[0]
    if not roots:
        return cells.withColumn("weight", F.lit(0.0)), 0.0
    cells = stored(cells.join(by_source.withColumn("t", F.col("t") / roots * total), "source"))
    g, h = {k[0]: 1.0 for k in matrix}, {k[1]: 1.0 for k in matrix}
    for _ in range(SWEEPS):
        raked = _raked(cells, g, h).groupBy("lang", "topic").agg(F.sum(F.col("n") * F.col("f")).alias("v"))
        matrix = {(r.lang, r.topic): r.v for r in raked.collect()}
        now = _margin({k: v * h[k[1]] for k, v in matrix.items()}, 0)
        g = {k: languages.get(k, 0.0) * total / v if v else 0.0 for k, v in now.items()}
        now = _margin({k: v * g[k[0]] for k, v in matrix.items()}, 1)
        h = {k: topics.get(k, 0.0) * total / v if v else 0.0 for k, v in now.items()}
    weight = F.col("f") * _lookup("lang", g) * _lookup("topic", h)
    cells = stored(_raked(cells, g, h).select("source", "lang", "topic", "n", weight.alias("weight")))
    return cells, _scale(cells, total)


def _raked(cells: DataFrame, g: dict[str, float], h: dict[str, float]) -> DataFrame:
    """Cells with the source factor `f` that belongs to the factors of languages and topics."""
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * _lookup("lang", g) * _lookup("topic", h)).alias("s"))
    return cells.join(sums, "source").withColumn("f", F.expr("if(s > 0, t / s, 0.0D)")).drop("s")


def _scale(cells: DataFrame, total: float) -> float:
    """The scale at which the expected tokens are the budget, or the last one if all cells are whole by then."""
    scale = BUDGET
    for _ in range(ROUNDS):
        whole = F.col("weight") * scale >= 1
        full, rest = cells.agg(F.sum(F.when(whole, F.col("n"))), F.sum(F.when(~whole, F.col("n") * F.col("weight")))).first()
        if not rest:
            break
        scale = max(0.0, BUDGET * total - (full or 0.0)) / rest
    return scale


def _drawn(docs: DataFrame, languages: dict[str, float] | None, topics: dict[str, float] | None) -> DataFrame:
    rows = described(docs)
    cells, scale = weights(rows.drop("document", "doc_id"), languages, topics)
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    out = rows.join(cells.drop("n"), ["source", "lang", "topic"], "left")
    out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("p", F.least(F.lit(1.0), F.col("weight") * scale))
    return out.withColumn("kept", number.cast("double") / 2**52 < F.col("p"))


def mixed(docs: DataFrame, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) for every row of `docs`.

    Reads `doc_id`, `text`, `source` and `lang`; other columns may have any name. Null text is empty;
    documents without a token have weight and probability 0 where no cell of theirs has tokens.
    Null ids draw as the empty string does. Rows that repeat a doc_id share its draw, so the draw
    can be repeated on any part of the input. An empty table gives an empty result.
    """
    return _drawn(docs, languages, topics).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("probability"), "kept"
    )


def sampled(docs: DataFrame, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> DataFrame:
    """The rows of `docs` that the draw keeps, and a column `mix` of topic, tokens, weight and probability."""
    mix = F.struct("topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("probability"))
    kept = _drawn(docs, languages, topics).where("kept").select("document", mix.alias("mix"))
    return kept.select(*[F.col("document")[c].alias(c) for c in docs.columns if c != "mix"], "mix")


def oracle_sql() -> str:
    """The same in SQL: each raking step and each round of the scale is a table of its own."""
    share = lambda chars: f"length(text) - length(translate(text, '{chars}', ''))"
    parts = [f"""
        texts as (
            select doc_id, coalesce(source, '(none)') source, coalesce(lang, '(none)') lang, coalesce(text, '') as text,
                len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint n_tokens
            from documents),
        described as (
            select doc_id, source, lang, n_tokens,
                case when contains(lower(text), 'license') then 'license'
                    when ({share(SYMBOLS)}) * 50 >= greatest(length(text), 1) then 'symbols'
                    when ({share(DIGITS)}) * 50 >= greatest(length(text), 1) then 'digits'
                    when n_tokens < 100 then 'short' when n_tokens >= 1000 then 'long' else 'prose' end topic
            from texts),
        cells as (
            select source, lang, topic, sum(n_tokens)::double n from described group by all having sum(n_tokens) > 0),
        total as (select sum(n) t from cells)"""]
    for dim in ("source", "lang", "topic"):
        parts.append(f"""
        target_{dim} as (
            select {dim}, sqrt(sum(n)) / sum(sqrt(sum(n))) over () * (select t from total) as goal from cells group by {dim})""")
    parts.append("step0 as (select source, lang, topic, n, n as w from cells)")
    steps = ["source", "lang", "topic"] * SWEEPS + ["source"]
    for k, dim in enumerate(steps):
        parts.append(f"""
        step{k + 1} as materialized (
            select source, lang, topic, n, w * goal / sum(w) over (partition by {dim}) w
            from step{k} join target_{dim} using ({dim}))""")
    parts.append(f"weighted as (select source, lang, topic, n, w / n as weight from step{len(steps)})")
    parts.append(f"scale0 as (select {BUDGET}::double s)")
    for k in range(ROUNDS):
        parts.append(f"""
        scale{k + 1} as materialized (
            select coalesce(greatest(0, {BUDGET} * (select t from total) - coalesce(sum(n) filter (weight * s >= 1), 0))
                / sum(n * weight) filter (weight * s < 1), any_value(s)) s
            from weighted, scale{k})""")
    return f"""
        with {", ".join(parts)}
        select doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 0), 6) weight, round(p, 6) probability,
            ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496 < p as kept
        from (
            select d.*, weight, least(1.0::double, coalesce(weight, 0) * (select s from scale{ROUNDS})) p
            from described d left join weighted using (source, lang, topic))"""
