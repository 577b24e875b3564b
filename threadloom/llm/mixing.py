"""Document rates that mix sources to target weights, with soft domain membership.

A classifier learned from a labelled table gives each document posteriors over domains: naive Bayes
on its distinct words, hashed to ``BUCKETS`` features that all have a weight for each domain. The rates
r >= ``least`` are fitted by projected-gradient least squares, so that the expected tokens of each
domain, the sum of rate x tokens x posterior, meet the targets: gradients are summed up in one slope
for each domain, and the rates are the projection of 1 - posterior . slope. A step is scaled by the
Gram matrix of the documents that the projection leaves free, and halved where it would not bring the
totals nearer.

A rate depends on the posteriors alone, taken in steps of 1/``GRAIN``. So the rounds aggregate a narrow
table of the distinct posteriors with their exact token sums. Texts are neither stored nor shuffled: where
``text`` is not kept, the kept columns and posteriors are stored once; where it is, the posteriors are
found again in a second pass. Only one number for each domain (and pair of domains) comes to the driver in
a round. Everything is built-in functions.

Targets are shares of the domains; the total is the least that leaves the domain with the smallest
ratio of target to present tokens unchanged, so that no document has to be thrown away, or
``total`` tokens if given. Targets out of reach (a domain without documents, one whose target lies below
what ``least`` leaves) are met as nearly as squares allow, and ``rates`` warns with the miss.

Defined results: null, empty and blank texts, and those without a letter, have the prior as posterior,
and no tokens unless there are words; with no domain at all every rate is 1; a target for a domain that
no label has is an error, and so are more than ``DOMAINS`` domains; a domain without a target keeps its
tokens; repeated rows are documents of their own; an empty table gives none. A very long text, or one
unbroken run of letters (one word, or one for each character of a script without blanks), takes time and
memory in proportion to its length. Other columns are ignored.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import cut

#: Words are learned from at most so many labelled rows, as many of each domain; more domains than that are an error.
FIT_ROWS = 4000
DOMAINS = 64
#: Hashed words.
BUCKETS = 8192
ROUNDS = 60
TOLERANCE = 1e-4
#: Weight of staying near rate 1.
STAY = 1e-6
#: Posteriors are taken in such steps where rates follow from them.
GRAIN = 1000
#: Rates this near to a whole number count as it.
WHOLE = 0.01
#: What parts words: ASCII and Latin-1 signs, general and ideographic punctuation; and every character of the
#: scripts that write no blanks (South East Asia, kana, Han).
BREAK = (
    r"[\x00-\x60\x7b-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\x{2000}-\x{206f}\x{3000}-\x{303f}]+"
    r"|(?=[\x{0e00}-\x{0fff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}])"
)


def tokens(text: Column) -> Column:
    """Words of a text: runs without white space."""
    runs = F.split(F.coalesce(text, F.lit("")), r"\s+")
    edge = (F.get(runs, F.lit(0)) == "").cast("long") + ((F.size(runs) > 1) & (F.element_at(runs, -1) == "")).cast("long")
    return F.size(runs).cast("long") - edge


def features(text: Column) -> Column:
    """The distinct buckets (from 0) of the words of a text in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def _adds(table: Column):
    return lambda total, at: total + F.get(table, at)


class DomainModel:
    """Priors of the domains and log-likelihoods of the buckets (``BUCKETS`` x domains)."""

    def __init__(self, domains: list[str], prior: np.ndarray, weights: np.ndarray):
        self.domains, self.prior, self.weights = domains, prior, weights

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``p0, p1, ...``: the posterior of each domain given the column ``text``."""
        names = [f"log{d}" for d in range(len(self.domains))]
        docs = docs.withColumn("found", features(F.col("text")))
        logs = {}
        for d, name in enumerate(names):
            # one literal array: the optimizer folds it
            table = F.split(F.lit(",".join(repr(float(v)) for v in self.weights[:, d])), ",").cast("array<double>")
            logs[name] = F.aggregate("found", F.lit(float(np.log(self.prior[d]))), _adds(table))
        docs = docs.withColumns(logs)
        most = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        docs = docs.withColumns({f"e{d}": F.exp(F.col(x) - most) for d, x in enumerate(names)})
        whole = reduce(Column.__add__, (F.col(f"e{d}") for d in range(len(names))))
        docs = docs.withColumns({f"p{d}": F.col(f"e{d}") / whole for d in range(len(names))})
        return docs.drop("found", *names, *(f"e{d}" for d in range(len(names))))


def fit_domains(labelled: DataFrame, rows: int = FIT_ROWS) -> DomainModel | None:
    """The model of ``labelled(text, domain)``; None without labels. Domains and priors are those of all
    labelled rows; words are learned from the same number of texts of each domain, copies counted once."""
    known = labelled.where("domain IS NOT NULL").select(F.coalesce("text", F.lit("")).alias("text"), F.col("domain").cast("string").alias("domain"))
    known = known.withColumn("h", F.xxhash64("text", "domain"))
    sizes = known.groupBy("domain", "h").agg(F.count("*").alias("n")).groupBy("domain").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    found = sorted(sizes.limit(DOMAINS + 1).collect(), key=lambda r: r["domain"])
    if len(found) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    domains = [r["domain"] for r in found]
    if not domains:
        return None
    size = np.array([r["n"] for r in found], float)
    each = max(1, rows // len(domains))

    def of_domain(values):
        return F.element_at(F.create_map(*(F.lit(x) for pair in zip(domains, values, strict=True) for x in pair)), F.col("domain"))

    # about 1.2 x each + 20 texts of a domain pass by hash, so that no task gets more than that to sort
    bound = of_domain([int(min(1.0, (1.2 * each + 20) / r["texts"]) * (1 << 30)) for r in found])
    some = known.where(F.pmod("h", F.lit(1 << 30)) < bound).groupBy("domain", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("h"))
    few = some.withColumn("place", place).where(F.col("place") <= each)
    counts = np.zeros((BUCKETS, len(domains)))
    for r in few.select("domain", F.explode(features(F.col("text"))).alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n")).collect():  # at most BUCKETS x DOMAINS
        counts[r["b"], domains.index(r["domain"])] = r["n"]
    sums = counts.sum(axis=0)
    level = sums[sums > 0].mean() if sums.any() else 0.0
    weights = np.log(counts * np.divide(level, sums, out=np.zeros_like(sums), where=sums > 0) + 1.0)
    weights[:, sums == 0] = 0.0
    return DomainModel(domains, size / size.sum(), weights - weights.mean(axis=1, keepdims=True))


def tempered(shares: np.ndarray, power: float = 0.7) -> np.ndarray:
    """Shares to a power below 1, summing to 1: rare domains get more."""
    out = np.where(shares > 0, shares, 0) ** power
    return out / out.sum() if out.sum() else out


def _bare(keys: list[str], slope: np.ndarray) -> Column:
    """The rate before the projection."""
    return reduce(Column.__sub__, (F.col(k) * float(s) for k, s in zip(keys, slope, strict=True)), F.lit(1.0))


def _keys(size: int) -> dict[str, Column]:
    return {f"k{d}": F.round(F.col(f"p{d}") * GRAIN) / GRAIN for d in range(size)}


def _steps(groups: DataFrame, size: int, goal_of, least: float) -> tuple[np.ndarray, float]:
    """The slope of each domain and the greatest miss as a share of all wanted tokens."""
    keys, held = [f"k{d}" for d in range(size)], [f"t{d}" for d in range(size)]

    def totals(slope):
        # sums of rate x tokens, and those sums' derivative by the slopes, over rows that are free to move
        rows = groups.withColumn("bare", _bare(keys, slope)).withColumn("rate", F.greatest(F.lit(float(least)), "bare"))
        free = F.when(F.col("bare") >= least - 1e-12, 1.0).otherwise(0.0)
        sums = [F.sum(F.col(t) * F.col("rate")) for t in held]
        sums += [F.sum(F.col(t) * F.col(k) * free) for t in held for k in keys]
        row = [v or 0.0 for v in rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()]
        return np.array(row[:size]), np.array(row[size:]).reshape(size, size)

    slope = np.zeros(size)
    done, gram = totals(slope)
    goal = goal_of(done)
    scale = max(float(goal.sum()), 1e-12)
    stay = STAY * max(float(np.trace(gram)) / size, 1e-12)

    def miss(done, slope):
        return done - goal - stay * slope

    rounds, share = 0, 1.0
    while rounds < ROUNDS and np.abs(miss(done, slope)).max() > TOLERANCE * scale and share > 1e-6:
        step = np.linalg.pinv(gram + stay * np.eye(size)) @ miss(done, slope)
        share = 1.0
        while share > 1e-6:
            rounds += 1
            new = slope + share * step
            now = totals(new)
            if np.linalg.norm(miss(now[0], new)) < np.linalg.norm(miss(done, slope)) * (1 - 1e-4 * share):
                slope, (done, gram) = new, now
                break
            share /= 2 if share == 1.0 else 4
    return slope, float(np.abs(done - goal).max() / scale)


def rates(docs: DataFrame, model: DomainModel | None, targets: dict[str, float] | None = None, total: float | None = None, keep: list[str] = (), least: float = 0.0) -> DataFrame:
    """``keep`` columns of ``docs`` with ``n_tokens``, the posteriors ``p_<domain>`` and ``rate``.

    ``targets`` are shares of the domains; without them the present shares, tempered. No rate is below ``least``."""
    if model is None:
        return docs.select(*keep, tokens(F.col("text")).alias("n_tokens"), F.lit(1.0).alias("rate"))
    if unknown := set(targets or ()) - set(model.domains):
        raise ValueError(f"no labels of {sorted(unknown)}")
    size = len(model.domains)
    p = [f"p{d}" for d in range(size)]
    # kept columns travel in one, so that their names cannot clash
    stem = docs.select(F.struct(*(keep or [F.lit(0).alias("none")])).alias("kept"), "text").withColumn("n_tokens", tokens(F.col("text")))
    rows = model.posteriors(stem).select("kept", "n_tokens", *p)
    rows = rows if "text" in keep else cut(rows)
    rows = rows.withColumns(_keys(size))
    keys = [f"k{d}" for d in range(size)]
    groups = cut(rows.groupBy(*keys).agg(*(F.sum(F.col("n_tokens") * F.col(x)).alias(f"t{d}") for d, x in enumerate(p))))

    def goal_of(have):
        wanted = np.full(size, np.nan)
        if targets is None:
            wanted = tempered(have / have.sum() if have.sum() else np.full(size, 1 / size))
        else:
            wanted[:] = [targets.get(d, np.nan) for d in model.domains]
        given = ~np.isnan(wanted)
        whole = total
        if whole is None:
            usable = given & (have > 0) & (wanted > 0)
            whole = float(np.max(have[usable] / wanted[usable])) if usable.any() else 0.0
        return np.where(given, wanted * whole, have)

    slope, missed = _steps(groups, size, goal_of, least)
    if missed > TOLERANCE * 2:
        warnings.warn(f"token targets missed by up to {missed:.2g} of all wanted tokens", stacklevel=2)
    rate = F.greatest(F.lit(float(least)), _bare(keys, slope)).alias("rate")
    return rows.select(*(["kept.*"] if keep else []), "n_tokens", *(F.col(x).alias(f"p_{d}") for x, d in zip(p, model.domains, strict=True)), rate)


def copies(rate: Column, key: Column) -> Column:
    """How often a document of that rate is taken: the whole part, and once more for a share of
    the keys' hashes equal to the rest."""
    near = F.round(rate)
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.when(F.abs(rate - near) < WHOLE, near).otherwise(F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")
