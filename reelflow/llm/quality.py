"""Quality rules by robust multivariate outliers, in column expressions only.

A text has plain counts, and from them a vector of transformed statistics. For each language and
source the centre and covariance of these vectors are estimated by the minimum covariance determinant:
the half of the documents whose covariance has the smallest determinant, found by concentration steps
from two starts (medians and quartile ranges; plain mean and covariance), then one reweighting. A
document whose Mahalanobis distance is beyond a quantile of the chi-squared distribution is
rejected, as is one that fails the base rules; those take no part in the estimates.

Most clean texts have no symbol and no repeated line at all, so a covariance may be singular: each
statistic has a least deviation, `FLOORS`, whose square is added to the diagonal (the regularised
form of the estimate).

Scale: texts are read once, by one map; what is stored is a short row for each. A concentration step is
one aggregate of these rows by group and distance bin, with sums of products for each bin, so the half is
the bins up to the middle one and no row is sorted or looked at twice. Sums are of integers, so the
estimates do not depend on the order of adding; steps go on until no determinant gets smaller.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.llm.common import stored

#: Base rules: fewest words, and the share of words in repeated windows that is allowed.
FEWEST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
_BLANK, _NOT_BLANK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Every text counts as if it had this many words of this many letters more, so that short ones do not scatter.
PRIOR_WORDS, PRIOR_LETTERS = 50, 5
#: The statistics: word length, symbols, capitals, repeated lines, words in repeated windows, with their least deviations.
FLOORS = {"length": 0.04, "symbols": 0.3, "capitals": 0.3, "lines": 0.5, "windows": 0.8}
#: Quantiles of the distance for the reweighting and for the verdict.
REWEIGHTED, REJECTED = 0.975, 0.9999
#: A language and source with fewer documents is pooled with the other small ones of the language, then of all.
LEAST_ROWS = 50
#: Statistics are integers of this unit; distances fall into so many bins for each doubling.
UNIT, BINS = 512, 64
#: Estimates of so many groups may be broadcast, 200 bytes each.
BROADCAST_GROUPS = 20_000

_P = len(FLOORS)
_U = [f"u{k}" for k in range(_P)]
_FLOOR = list(FLOORS.values())
_PAIRS = [(j, k) for j in range(_P) for k in range(j + 1)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once in each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more; windows are compared by 64-bit hashes."""
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - WINDOW + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def twice(order: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            same = (F.get(order, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(order, k - 1)["h"] == x["h"]))
            return F.when(same, x["at"])

        return _let(F.sort_array(F.filter(F.transform(order, place), lambda x: x.isNotNull())), covered)

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(order, twice))

    return _let(hashes, count)


def _number_of(characters: str) -> Column:
    """How many characters of the text are of a class, given as in a regular expression."""
    kept = F.length(F.regexp_replace("text", F.lit(f"[^{characters}]+"), F.lit(""))).cast("long")
    return F.when(F.rlike("text", F.lit(f"[{characters}]")), kept).otherwise(F.lit(0).cast("long"))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_capitals, n_dup_lines, n_repeat_words) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("lang").alias("lang"), name("source").alias("source"), text.alias("text"))
    words = F.filter(F.split("text", _BLANK), lambda w: w != "")
    of_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated_words(w).alias("repeated")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_NOT_BLANK))
    again = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rows = rows.select(
        "doc_id", "lang", "source", of_words.alias("w"), _number_of(SYMBOLS).alias("n_symbols"), _number_of("A-Z").alias("n_capitals"),
        F.when(F.contains("text", F.lit("\n")), again).otherwise(F.lit(0).cast("long")).alias("n_dup_lines"))
    return rows.select(
        "doc_id", "lang", "source", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_capitals", "n_dup_lines",
        F.col("w.repeated").alias("n_repeat_words"))


def _base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)


def statistics() -> list[Column]:
    """The transformed statistics of a row of counts, as whole numbers of 1 / `UNIT`."""
    letters, words = F.col("word_chars") + PRIOR_WORDS * PRIOR_LETTERS, F.col("n_words") + PRIOR_WORDS
    share = lambda n, of: F.log1p(F.col(n) * 100 / of)
    values = [F.log(letters / words), share("n_symbols", letters), share("n_capitals", letters), share("n_dup_lines", words), share("n_repeat_words", words)]
    return [F.round(v * UNIT).cast("long").alias(u) for v, u in zip(values, _U, strict=True)]


def _chi2(x: float, freedom: int) -> float:
    """Distribution function of the chi-squared distribution, by the series of the incomplete gamma function."""
    a, half = freedom / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= half / (a + k)
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, freedom) < share else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the `share` of normal vectors nearest to the centre is to be multiplied by."""
    return share / _chi2(quantile(share, _P), _P + 2)


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with their `place`, a text that names language and source, or a pool of small ones, or null without enough rows."""
    pair = F.to_json(F.struct("lang", "source"))
    sizes = stored(rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n")))
    large = F.col("n") >= LEAST_ROWS
    pools = sizes.where(~large).groupBy("lang").agg(F.sum("n").alias("pool"))
    rest = pools.where(F.col("pool") < LEAST_ROWS).agg(F.coalesce(F.sum("pool"), F.lit(0))).scalar()
    named = sizes.join(pools, "lang", "left").select(
        "lang", "source",
        F.when(large, pair).when(F.col("pool") >= LEAST_ROWS, F.to_json(F.struct("lang"))).when(rest >= LEAST_ROWS, "{}").alias("place"))
    named = stored(named)
    return _joined(rows, named, ["lang", "source"], _few(named), "left")


def _few(table: DataFrame) -> bool:
    return table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _kept(table: DataFrame, few: bool) -> DataFrame:
    """A table of groups, stored; one file if they are few, as each executor reads all of it and each step writes one."""
    return stored(table.repartition(1) if few else table)


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Rows joined to a table of groups, which is broadcast if they are few; hot groups of many are left to adaptive execution."""
    return rows.join(F.broadcast(table) if few else table, keys, how)


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre `m`, Cholesky factor `l` of the covariance and `determinant`, its logarithm, from n, sums and sums of products."""

    def measured(t: Column) -> Column:
        n, s, p = t["n"].cast("double"), t["s"], t["p"]
        mean = lambda k: F.get(s, F.lit(k)) / n / UNIT
        cover = lambda i, j, k: (F.get(p, F.lit(i)) / n / UNIT**2 - mean(j) * mean(k)) * factor
        cells = [F.greatest(cover(i, j, k), F.lit(0.0)) + _FLOOR[j] ** 2 if j == k else cover(i, j, k) for i, (j, k) in enumerate(_PAIRS)]
        return F.struct(F.array(*map(mean, range(_P))).alias("m"), _let(F.array(*cells), _cholesky).alias("l"))

    given = F.struct("n", F.array(*[f"s{k}" for k in range(_P)]).alias("s"), F.array(*[f"s{j}_{k}" for j, k in _PAIRS]).alias("p"))
    return _with_determinant(sums.select(*keys, _let(given, measured).alias("e")).select(*keys, "e.*"))


def _cholesky(cells: Column) -> Column:
    """The lower triangle, row by row, of a matrix given by its own; each cell from those before it."""
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(j * (j + 1) // 2).alias("row"), F.lit(k * (k + 1) // 2).alias("other")) for i, (j, k) in enumerate(_PAIRS)])

    def cell(done: Column, at: Column) -> Column:
        products = F.zip_with(F.slice(done, at["row"] + 1, at["k"]), F.slice(done, at["other"] + 1, at["k"]), lambda a, b: a * b)
        rest = F.get(cells, at["i"]) - F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
        return F.concat(done, F.array(F.when(at["j"] == at["k"], F.sqrt(F.greatest(rest, F.lit(1e-12)))).otherwise(rest / F.get(done, at["other"] + at["k"]))))

    return F.aggregate(places, F.array().cast("array<double>"), cell)


def _with_determinant(factored: DataFrame) -> DataFrame:
    return factored.withColumn("determinant", sum((F.log(F.get("l", F.lit(i))) * 2 for i, (j, k) in enumerate(_PAIRS) if j == k), F.lit(0.0)))


def _solved(rows: DataFrame) -> DataFrame:
    """Adds `d2`, the squared Mahalanobis distance, by forward substitution in the joined estimate."""
    out = rows
    for j in range(_P):
        row = _PAIRS.index((j, 0))
        rest = F.col(f"u{j}") / UNIT - F.get("m", F.lit(j)) - sum((F.get("l", F.lit(row + i)) * F.col(f"y{i}") for i in range(j)), F.lit(0.0))
        out = out.withColumn(f"y{j}", rest / F.get("l", F.lit(row + j)))
    return out.withColumn("d2", sum((F.col(f"y{j}") * F.col(f"y{j}") for j in range(_P)), F.lit(0.0)))


def _sums() -> list[Column]:
    products = [F.sum(F.col(f"u{j}") * F.col(f"u{k}")).alias(f"s{j}_{k}") for j, k in _PAIRS]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"u{k}").alias(f"s{k}") for k in range(_P)], *products]


def _added(bins: DataFrame, keys: list[str]) -> DataFrame:
    names = ["n", *[f"s{k}" for k in range(_P)], *[f"s{j}_{k}" for j, k in _PAIRS]]
    return bins.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates of each place to start from: 0 by medians and quartile ranges, 1 by mean and covariance."""
    plain = _estimate(rows.groupBy("place").agg(*_sums()), ["place"], 1.0).withColumn("start", F.lit(1))
    each = rows.select("place", F.posexplode(F.array(*_U)).alias("k", "u")).groupBy("place", "k", "u").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("place", "k").orderBy("u")
    placed = each.withColumn("below", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("place", "k")))
    at = lambda q: F.min(F.when(F.col("below") >= F.col("all") * q, F.col("u")))
    marks = placed.groupBy("place", "k").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"))
    scale = (F.col("high") - F.col("low")) / (1.349 * UNIT)
    marks = marks.select("place", "k", (F.col("middle") / UNIT).alias("m"), (scale * scale).alias("v"))
    sides = F.array_sort(F.collect_list(F.struct("k", "m", "v")))  # one entry for each statistic
    wide = marks.groupBy("place").agg(sides.alias("x"))
    cells = F.array(*[F.get("x", F.lit(j))["v"] + _FLOOR[j] ** 2 if j == k else F.lit(0.0) for j, k in _PAIRS])
    wide = wide.select("place", F.transform("x", lambda x: x["m"]).alias("m"), _let(cells, _cholesky).alias("l"))
    return _with_determinant(wide).withColumn("start", F.lit(0)).unionByName(plain)


def _concentrated(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """The estimate of each place and start of `estimates` from the half of the rows that is nearest by it."""
    near = _solved(_joined(rows, estimates.drop("determinant"), ["place"], few))
    number = F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS)
    bins = near.groupBy("place", "start", number.alias("bin")).agg(*_sums())
    keys = ["place", "start"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.sum("n").over(Window.partitionBy(*keys)) / 2
    nearest = bins.select("*", before.alias("before"), half.alias("half")).where("before < half").drop("bin")
    return _estimate(_added(nearest, keys), keys, consistency(0.5))


def estimates(rows: DataFrame) -> DataFrame:
    """(place, m, l): centre and Cholesky factor of each place's vectors u0.. by the reweighted MCD."""
    begun = stored(_starts(rows))
    few = _few(begun)
    now = _kept(_concentrated(rows, begun, few), few)  # the starts are of no half, so the first step always counts
    finished: list[DataFrame] = []
    while True:
        old = now.select("place", "start", F.col("determinant").alias("was"))
        step = _concentrated(rows, now, few).join(old, ["place", "start"])
        better = _kept(step.where(F.col("determinant") < F.col("was") - 1e-9).drop("was"), few)
        finished.append(now.join(better.select("place", "start"), ["place", "start"], "left_anti"))
        if better.limit(1).count() == 0:
            break
        now = better
    ended = reduce(DataFrame.unionByName, finished)
    names = [c for c in ended.columns if c not in ("place", "start")]
    best = ended.groupBy("place").agg(F.min_by(F.struct(*names), F.struct("determinant", "start")).alias("e"))
    chosen = _kept(best.select("place", "e.*").drop("determinant"), few)
    inside = _solved(_joined(rows, chosen, ["place"], few)).where(F.col("d2") <= quantile(REWEIGHTED, _P))
    return _kept(_estimate(inside.groupBy("place").agg(*_sums()), ["place"], consistency(REWEIGHTED)).drop("determinant"), few)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every row of `docs`.

    Reads `doc_id`, `text`, `lang` and `source`; an absent `lang` or `source` is one for all rows. Null texts are empty and fail the base
    rules; null languages and sources are groups like others; null ids are kept, repeated rows are
    repeated and count again in the estimates. `distance` is the squared Mahalanobis distance, null for
    rows that fail the base rules and where fewer than `LEAST_ROWS` rows can be pooled, which keeps them.
    An empty table gives no rows.
    """
    rows = counted(docs).withColumn("base_failed", _base_failed())
    rows = stored(rows.select("*", *statistics()))
    rows = stored(_grouped(rows))
    judgeable = rows.where("not base_failed and place is not null").select("place", *_U)
    found = estimates(judgeable)
    out = _solved(_joined(rows, found, ["place"], _few(found), "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= quantile(REJECTED, _P), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round(distance, 4).alias("distance"))
