"""Mixing to target weights by soft domain membership. DataFrame functions only.

A labelled table teaches a multinomial model of hashed words for each domain; its posterior gives every
document a soft membership p(domain | text), computed within the row. Rates r >= 0, one a document, are
then sought whose expected tokens, sum of r * tokens * p, are nearest to the targets of the domains (least
squares), by an implicit projected-gradient step from r = 1: r = cut(1 + a . gap / eps), a = tokens * p, with
the gap that r itself leaves. These are the rates of smallest squared gap + eps * |r - 1|^2; eps falls until a bound
on the distance from the best totals is small. The step is as many numbers as there are domains, found by
Newton's method with the Gram matrix of the rows that are not cut, so a round is one sum over a narrow
table and no per-document state is carried from round to round.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

BUCKETS = 16384
CALM = 0.3  # words are dependent, so their summed log odds are too sure; they count by this factor
TAUGHT = 20_000  # labelled rows that the model is fitted on at most (those of smallest hash)
CLOSE = 2e-5  # the totals' distance from the best ones, as a share of the largest target


def words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def word_model(labelled: DataFrame, domains: list[str]) -> list[tuple[list[float], float]]:
    """For each domain after the first: BUCKETS log odds against the first, and its log prior odds.

    labelled has b (buckets) and domain. Its size is fixed by BUCKETS and the domains.
    """
    counts = labelled.select("domain", F.explode("b").alias("k")).groupBy("k").pivot("domain", domains).count()
    n = [f"n{i}" for i in range(len(domains))]
    every = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left")
    every = materialise(every.select("k", *[(F.coalesce(F.col(f"`{d}`"), F.lit(0)) + 1.0).alias(c) for d, c in zip(domains, n, strict=True)]), "words")
    total = every.agg(*[F.sum(c).alias(c) for c in n]).first()
    rows = labelled.agg(*[F.count_if(F.col("domain") == d).alias(c) for d, c in zip(domains, n, strict=True)]).first()
    odds = [(F.log(F.col(c) / total[c]) - F.log(F.col(n[0]) / total[n[0]])).alias(f"o{i}") for i, c in enumerate(n) if i]
    found = every.select("k", *odds).orderBy("k").collect()  # BUCKETS rows
    forget(every)
    return [([r[f"o{i}"] for r in found], math.log((rows[n[i]] + 1) / (rows[n[0]] + 1))) for i in range(1, len(n))]


def memberships(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", taught: int = TAUGHT) -> DataFrame:
    """doc_id, tokens and p (posteriors in the order of domains) of every row. labels: id_col and domain, taught of them at most."""
    src = docs.select(F.col(id_col).alias("doc_id"), buckets(F.col(text_col)).alias("b"))
    some = labels.select(F.col(id_col).alias("_id"), "domain").filter(F.col("domain").isin(domains)).orderBy(F.xxhash64("_id"), "_id", "domain").limit(taught)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id")  # bounded by taught
    taught_rows = own.select("domain", buckets(F.col("_t")).alias("b"))
    model = word_model(taught_rows, domains)
    scored = src.select("doc_id", "b", F.size("b").alias("tokens"))
    odds = [F.lit(0.0)]
    for values, prior in model:
        odds.append(F.aggregate("b", F.lit(0.0), adds(literal(values))) * CALM + prior)
    scored = scored.select("doc_id", "tokens", F.array(*odds).alias("o"))
    soft = F.transform("o", lambda x: F.exp(x - F.array_max("o")))
    scored = scored.select("doc_id", "tokens", soft.alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return scored.select("doc_id", "tokens", F.transform("e", lambda x: x / whole).alias("p"))


def adds(values: Column) -> Callable[[Column, Column], Column]:
    return lambda total, k: total + F.get(values, k)


def literal(values: list[float]) -> Column:
    """A constant array, parsed from text at once (a Column a number would be slow to build)."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


def solve(m: list[list[float]], v: list[float]) -> list[float]:
    """m x = v for a small symmetric m, by elimination; a ridge keeps empty domains harmless."""
    n = len(v)
    ridge = 1e-9 * max(max(m[i][i] for i in range(n)), 1e-300)
    a = [[m[i][j] + (ridge if i == j else 0) for j in range(n)] + [v[i]] for i in range(n)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def dot(values: list[float]) -> Column:
    """tokens of each domain (columns a0, a1 ...) . values."""
    return sum((F.col(f"a{i}") * v for i, v in enumerate(values)), F.lit(0.0))


def rate(step: list[float], most: float | None) -> Column:
    """1 + a . step, cut at 0 (and at most, if given)."""
    r = F.greatest(F.lit(0.0), F.lit(1.0) + dot(step))
    return r if most is None else F.least(F.lit(float(most)), r)


def fit(sized: DataFrame, goal: list[float], most: float | None) -> tuple[list[float], list[float], bool]:
    """The step of rate(), the domains' expected tokens at it, and whether these are known to be the nearest to goal (within CLOSE).

    sized has a0, a1 ... (tokens of each domain). With r the rates and u the gap, a limit on the rates gives a bound: totals
    differ from the best ones by sqrt(2 * sum of (largest a . u within the limits - r * a . u)) at most. Without a
    limit the projected gradient must vanish against that of r = 0.
    """
    n, largest = len(goal), max(max(goal), 1.0)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    norm = lambda v: math.sqrt(sum(x * x for x in v))

    def value(step: list[float]) -> Column:
        """The dual function without its terms in goal and eps."""
        r = rate(step, most)
        return total(r * (F.lit(1.0) + dot(step)) - r * r / 2)

    def at(step: list[float]) -> tuple[float, list[float], list[list[float]]]:
        """That value, the domains' tokens, and the Gram matrix of the rows that are not cut."""
        r = rate(step, most)
        loose = (r == F.lit(1.0) + dot(step)).cast("double")
        row = sized.agg(value(step), *[total(F.col(f"a{i}") * r) for i in range(n)], *[total(F.col(f"a{i}") * F.col(f"a{j}") * loose) for i, j in pairs]).first()
        upper = dict(zip(pairs, row[n + 1 :], strict=True))
        return row[0], list(row[1 : n + 1]), [[upper[min(i, j), max(i, j)] for j in range(n)] for i in range(n)]

    def dual(v: float, step: list[float], eps: float) -> float:
        return v + sum(eps * s * s / 2 - s * g for s, g in zip(step, goal, strict=True))

    def lowest(steps: list[list[float]], eps: float) -> tuple[float, list[float]]:
        row = sized.agg(*[value(s).alias(f"v{i}") for i, s in enumerate(steps)]).first()
        return min((dual(v, s, eps), s) for v, s in zip(row, steps, strict=True))

    def proven(step: list[float], now: list[float]) -> bool:
        gap = [g - x for g, x in zip(goal, now, strict=True)]
        if max(map(abs, gap)) <= CLOSE * largest:
            return True
        pull, r = dot(gap), rate(step, most)
        if most is not None:
            return math.sqrt(2 * max(sized.agg(total(F.greatest(F.lit(0.0), pull * float(most)) - r * pull)).first()[0], 0.0)) <= CLOSE * largest
        left = F.when(r > 0, pull).otherwise(F.greatest(F.lit(0.0), pull))
        row = sized.agg(total(left * left), total(dot(goal) * dot(goal))).first()
        return math.sqrt(row[0]) <= CLOSE * math.sqrt(row[1])

    step = [0.0] * n
    found = at(step)
    scale = sum(found[2][i][i] for i in range(n)) / n
    if not scale:
        return step, found[1], True  # no tokens, nothing to choose
    best = (math.inf, step, found[1])
    for power in range(2, 15):
        eps = scale * 10.0**-power
        if power > 2:
            longer = [10 * s for s in step]  # right where the gap stays, step where it goes
            if lowest([step, longer], eps)[1] == longer:
                step, found = longer, at(longer)
        while True:
            slope = [x - g + eps * s for x, g, s in zip(found[1], goal, step, strict=True)]
            if norm(slope) <= max(1e-3 * eps * norm(step), CLOSE * 1e-2 * largest):
                break
            way = solve([[x + (eps if i == j else 0.0) for j, x in enumerate(row)] for i, row in enumerate(found[2])], [-x for x in slope])
            before = dual(found[0], step, eps)
            new = [s + w for s, w in zip(step, way, strict=True)]
            then = at(new)
            if dual(then[0], new, eps) >= before:  # too far: parts of the way
                low, new = lowest([[s + w / 2**k for s, w in zip(step, way, strict=True)] for k in range(1, 18)], eps)
                if low >= before:
                    break  # below the precision of doubles
                then = at(new)
            step, found = new, then
        gap = norm([g - x for g, x in zip(goal, found[1], strict=True)])
        if gap < best[0]:
            best = (gap, step, found[1])
        if proven(step, found[1]):
            return step, found[1], True
        if gap > best[0] * 1.001:
            break  # steps have grown beyond what doubles can tell apart
    return best[1], best[2], False


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str, most: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, tokens, p_<domain> for each domain, rate.

    weights: share of each domain's expected tokens in the mixture. The anchor domain is used as it is and
    fixes the scale: the target of another is anchor's tokens * weight / anchor's weight, but not more than
    it has while most is 1 (no document is repeated). most: the largest rate, None for no limit.
    labels: id_col and domain, rows of other domains or of no document take no part; without any, all
    domains are equally likely. Null and empty texts have no tokens and keep rate 1. Rows that repeat an id
    are rated each; a null id is rated too. An empty table gives no rows.
    """
    domains = [anchor, *sorted(d for d in weights if d != anchor)]
    n = len(domains)
    soft = memberships(docs, labels, domains, id_col, text_col)
    soft = materialise(soft.select("doc_id", "tokens", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(n)]), "memberships")
    sized = soft.withColumns({f"a{i}": F.col(f"p{i}") * F.col("tokens") for i in range(n)})
    have = [x or 0.0 for x in sized.agg(*[F.sum(f"a{i}") for i in range(n)]).first()]
    goal = [have[0] * weights[d] / weights[anchor] for d in domains]
    if most is not None and most <= 1:
        goal = [min(g, h) for g, h in zip(goal, have, strict=True)]
    step, now, best = fit(sized, goal, most)
    if not best:
        warnings.warn(f"mixing: not the nearest rates; tokens {dict(zip(domains, now, strict=True))} for targets {dict(zip(domains, goal, strict=True))}", stacklevel=2)
    return sized.select("doc_id", F.col("tokens").cast("long").alias("tokens"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], rate(step, most).alias("rate"))


def draw(rates: DataFrame) -> DataFrame:
    """rates with copies: the rate rounded up or down by a hash of the id, so that its expectation is the rate."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    return rates.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """labels (quality, toxic) as domains: toxic, else low (quality 0), else clean; nulls have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select(id_col, domain.alias("domain"))
