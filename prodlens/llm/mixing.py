"""Mixing sources to target weights with soft membership, with DataFrame functions only.

A table classifier, naive Bayes over counts of labelled rows, gives each document a posterior over the
domains (sources). Rates r >= 0 for documents are then fitted by projected gradient, so that the expected
token total of each domain, sum over documents of r * tokens * posterior, has its target share.

The gradient of a document's rate, taken per token, depends on its posterior alone, and all rates start at 1. So documents of
equal features and label have equal rates in every step. Documents of equal features are one cell, a row with the classifier's
posterior and the tokens of each label; the sums of each step run over cells, and a step sends one number for each domain to
the driver. A label is a one-hot share of the posterior, so a cell needs no posterior for each of its labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: How far a document's own label counts; the rest of its posterior is the classifier's. Without a label all is.
TRUST = 0.9
STEPS = 12
#: Groups that are broadcast to the documents, at most; beyond that Spark joins by shuffle.
BROADCAST_ROWS = 250_000
FEATURES = ["f_lang", "f_size", "f_caps"]


def featured(docs: DataFrame, domain_col: str) -> DataFrame:
    """Rows (r, the whole row of docs; mix_tokens; features; mix_domain)."""
    text = F.coalesce(F.col("r.text"), F.lit(""))
    caps = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r")).withColumns({
        "mix_tokens": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"),
        "f_lang": F.coalesce("r.lang", F.lit("?")),
        "f_size": F.floor(F.log2(F.length(text) + 1)).cast("int"),
        "f_caps": F.floor(8 * caps / F.greatest(F.length(text), F.lit(1))).cast("int"),
        "mix_domain": F.col("r")[domain_col].cast("string"),
    })


def posteriors(groups: DataFrame, domains: DataFrame) -> DataFrame:
    """For each cell of features `p`, the classifier's posterior over the domains (mix_domain, d) in the order of d, from 0.

    Naive Bayes with add-one smoothing: prior and each feature's distribution within a domain, by labelled documents. Each
    feature's table has a row of all domains for each of its values, so a cell's posterior is a sum of three rows and the prior.
    """
    labelled = groups.join(domains, "mix_domain")
    size = domains.count()
    total = labelled.groupBy("d").agg(F.sum("n").alias("n_domain"))
    filled = lambda pairs: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.coalesce(F.try_element_at(pairs, d), F.lit(0)).cast("double"))
    counts = lambda df, *by: df.groupBy(*by).agg(filled(F.map_from_entries(F.collect_list(F.struct("d", "n")))).alias("c"))
    prior = counts(total.withColumnRenamed("n_domain", "n").withColumn("one", F.lit(1)), "one").select(F.col("c").alias("n_domain"), "one")
    cells = groups.select(*FEATURES).distinct().withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")  # the prior is one row
    score = F.transform("n_domain", lambda n: F.log(n))
    for f in FEATURES:
        values = groups.select(f).distinct().count()
        known = counts(labelled.groupBy(f, "d").agg(F.sum("n").alias("n")), f).withColumnRenamed("c", f"c_{f}")
        cells = cells.join(known, f, "left")
        none = F.transform("n_domain", lambda n: F.lit(0.0))
        ratio = F.zip_with(F.coalesce(f"c_{f}", none), "n_domain", lambda c, n: F.log((c + 1) / (n + values)))
        score = F.zip_with(score, ratio, lambda a, b: a + b)
    cells = cells.select(*FEATURES, score.alias("s")).withColumn("top", F.array_max("s")).select(*FEATURES, F.transform("s", lambda x: F.exp(x - F.col("top"))).alias("e"))
    return cells.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).select(*FEATURES, F.transform("e", lambda x: x / F.col("z")).alias("p"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _rates(history: list[list[float]], trust: float = TRUST) -> Column:
    """For each of a cell's labels (own: d, null without a label, and tokens) the rate after the steps so far, each given by its weighted residuals."""
    if not history:
        return F.transform("own", lambda o: F.struct(o["d"].alias("d"), o["tokens"].alias("tokens"), F.lit(1.0).alias("r")))
    steps = F.array(*(F.array(*map(F.lit, h)) for h in history))
    each = F.transform(steps, lambda h: F.struct(h.alias("h"), _dot(F.col("p"), h).alias("dot")))
    down = lambda o, s: F.when(o["d"].isNull(), s["dot"]).otherwise(s["dot"] * (1 - trust) + F.get(s["h"], o["d"]) * trust)
    rate = lambda o, all_: F.aggregate(all_, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - down(o, s)))
    return F.transform(F.array(each), lambda all_: F.transform("own", lambda o: F.struct(o["d"].alias("d"), o["tokens"].alias("tokens"), rate(o, all_).alias("r"))))[0]


def _totals(cells: DataFrame, history: list[list[float]], size: int, trust: float = TRUST) -> tuple[float, list[float]]:
    """All expected tokens, and those of each domain."""
    rated = cells.select("p", _rates(history, trust).alias("own"))
    sum_of = lambda keep, share: F.aggregate(F.filter("own", keep), F.lit(0.0), lambda a, o: a + o["tokens"] * o["r"] * share)
    soft = sum_of(lambda o: o["d"].isNull(), 1.0) + sum_of(lambda o: o["d"].isNotNull(), 1 - trust)
    soft = rated.select("p", soft.alias("m")).select(F.posexplode(F.transform("p", lambda x: x * F.col("m"))).alias("d", "m"))
    own = rated.select(F.explode("own").alias("o")).filter("o.d is not null").select(F.col("o.d").alias("d"), (F.col("o.tokens") * F.col("o.r") * trust).alias("m"))
    sums = {r.d: r.m for r in soft.unionAll(own).groupBy("d").agg(F.sum("m").alias("m")).collect()}
    by_domain = [sums.get(d) or 0.0 for d in range(size)]
    return sum(by_domain), by_domain


def fitted(cells: DataFrame, domains: list[str], targets: dict[str, float], trust: float = TRUST) -> Column:
    """The rates of cells (p, own), as a function of their columns, after STEPS projected-gradient steps.

    Residuals are weighted by one over the domains' token shares. The matrix that a step applies to them then has rows that sum
    to 1, so a step of length 1 converges.
    """
    weight = sum(targets.get(d, 0.0) for d in domains) or 1.0
    goal = [targets.get(d, 0.0) / weight for d in domains]
    history: list[list[float]] = []
    shares: list[float] = []
    for _ in range(STEPS):
        total, sums = _totals(cells, history, len(domains), trust)
        if not total:
            break
        now = [x / total for x in sums]
        shares = shares or now
        step = [(x - g) / s if s > 0 else 0.0 for x, g, s in zip(now, goal, shares, strict=True)]
        if max(map(abs, step)) < 1e-6:
            break
        history.append(step)
    return _rates(history, trust)


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "source", trust: float = TRUST) -> DataFrame:
    """docs with mix_tokens, mix_rate (>= 0) and mix_copies (whole, expected value mix_rate).

    targets: weight of each domain's tokens, normalised over those that have documents; None is equal weights. A document without
    a label has the classifier's posterior; without any labelled document all rates are 1. A null text has no tokens
    and the rate of its group. Copies round up or down by a hash of the row's text and id column, so repeated rows get equal
    numbers. Columns named as the three are replaced, and no other names matter; an empty table gives an empty table.
    """
    columns = docs.columns
    full = featured(docs, domain_col)
    scratch = Scratch(docs.sparkSession, "mixing")
    groups = scratch.keep(full.groupBy(*FEATURES, "mix_domain").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")))
    domains = sorted(r[0] for r in groups.filter("mix_domain is not null").select("mix_domain").distinct().collect())
    if domains:
        numbered = docs.sparkSession.createDataFrame(list(enumerate(domains)), "d int, mix_domain string")
        own = groups.join(numbered, "mix_domain", "left").groupBy(*FEATURES).agg(F.array_sort(F.collect_list(F.struct("d", F.col("tokens").cast("double").alias("tokens")))).alias("own"))
        cells = scratch.keep(own.join(posteriors(groups, numbered), FEATURES))
        rates = cells.select(*FEATURES, F.explode(fitted(cells, domains, targets or dict.fromkeys(domains, 1.0), trust)).alias("o")).select(*FEATURES, F.col("o.d").alias("d"), F.col("o.r").alias("mix_rate"))
        rates = scratch.keep(rates.join(numbered, "d", "left").select(*(F.col(f).alias(f"at_{f}") for f in FEATURES), F.col("mix_domain").alias("at_domain"), "mix_rate"))
        scratch.free(groups, cells)
        rates = F.broadcast(rates) if rates.count() <= BROADCAST_ROWS else rates
        full = full.join(rates, [full[f] == rates[f"at_{f}"] for f in FEATURES] + [full["mix_domain"].eqNullSafe(rates["at_domain"])], "left")
    else:
        full = full.withColumn("mix_rate", F.lit(1.0))
    part = F.pmod(F.xxhash64(*[F.col("r")[c] for c in ("doc_id", "text") if c in columns]), F.lit(1 << 20)) / (1 << 20)
    copies = F.floor("mix_rate") + F.when(part < F.col("mix_rate") - F.floor("mix_rate"), 1).otherwise(0)
    made = ("mix_tokens", "mix_rate", "mix_copies")
    return full.withColumn("mix_copies", copies.cast("long")).select(*(F.col("r")[c].alias(c) for c in columns if c not in made), *made)
