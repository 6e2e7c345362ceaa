"""Mixing to target weights with soft domain membership.

A multinomial classifier over hashed words, fitted on a bounded sample of labelled texts,
gives each document posteriors p over domains.  With n tokens in a document and a rate r,
the expected tokens of domain k are the sum of n * p[k] * r.  The rates minimise

    sum over k of (tokens[k] - target[k])^2 / (2 * T^2) + ridge / 2 * sum of n / T * (r - 1)^2

over r >= 0 by projected gradient steps on the rates, scaled by the curvature.  With w = n / T, off = tokens / T - target and
A the documents whose rate is above zero, the gradient of rate i (over w) is

    g[i] = p[i] . off + ridge * (r[i] - 1)

and the curvature on A is H = C + ridge, where C takes x to p . (sum over A of w * p * x).  A step is r <- max(0, r - H^-1 g).  By
Woodbury's identity, with the small matrix K = sum over A of w * p * p^T,

    (H^-1 g)[i] = r[i] - 1 + p[i] . (K + ridge)^-1 (off - sum over A of w * p * (r - 1))

so the new rates are max(0, 1 - p . theta) with theta = (K + ridge)^-1 (off - sum over A of w * p * (r - 1)): the rates themselves need not be stored, a vector of a
number for each domain gives them.  As the old rates were of this form, the sum is -K theta_old, and theta = theta_old + (K + ridge)^-1 (off - ridge * theta_old), which
is what ``fit`` computes.  If a whole step doesn't lower the cost, theta moves by half of it, and so on; at a fixed point theta = off / ridge, which
are the conditions of the only minimum.  Each step is one aggregation that returns totals and their curvature over the
documents above zero, a handful of numbers.

Tokens are those of the column that ``tokens`` names (as of the BPE operator), or else words.

Rates become whole copies by a hash of the row, without bias: floor(r + u).

Only DataFrame operations and the JVM's classifier are used.

Defined cases: null texts are empty, with no tokens; they get posteriors as any other text
and move no total.  Null token counts are 0.  Texts of any length are read whole.  Labels of ids that no document has are ignored, and several labels
of an id count once, the least domain.  With fewer than two labelled domains all
posteriors are even.  Rows equal in id and text have equal rates.  Columns of other names are passed on or ignored.  Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import materialise, whole_text

#: Domains of the labelled table and their target shares of all tokens.
TARGETS = {"good": 0.80, "good toxic": 0.08, "poor": 0.10, "poor toxic": 0.02}
#: Labelled rows that the classifier sees at most, width of its hashed words.
SAMPLE, WIDTH = 4000, 4096


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain."""
    name = F.concat(F.when(F.col("quality") == 0, "poor").otherwise("good"), F.when(F.col("toxic") == 1, " toxic").otherwise(""))
    return labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("domain"))


def words(text="text"):
    return F.filter(F.split(F.lower(F.col(text)), r"[\s.,;:!?]+"), lambda w: w != "")


def _rows(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    counted = F.lit(None) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), counted.cast("long").alias("n_tokens"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), words().alias("words"), "n_tokens")
    return rows.withColumn("n_tokens", F.coalesce("n_tokens", F.size("words").cast("long")))


def posteriors(docs: DataFrame, domains: DataFrame, names: list[str], sample: int = SAMPLE, width: int = WIDTH, tokens: str | None = None) -> DataFrame:
    """doc_id, th, n_tokens, p (one number for each name)."""
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=width)
    known = domains.where(F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    # Exactly bounded by `sample`, and therefore broadcast.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    label = F.array_position(F.array(*map(F.lit, names)), F.col("domain")).cast("double") - 1
    train = hashed.transform(_rows(docs).join(F.broadcast(known), "doc_id")).select("features", label.alias("label"))
    train = materialise(train)
    rows = hashed.transform(_rows(docs, tokens)).select("doc_id", "th", "n_tokens", "features")
    seen = train.select("label").distinct().count()
    if seen < 2:
        return rows.select("doc_id", "th", "n_tokens", F.array(*(F.lit(1 / len(names)) for _ in names)).alias("p"))
    model = LogisticRegression(family="multinomial", maxIter=25, regParam=0.01).fit(train)
    p = vector_to_array("probability")
    if model.numClasses < len(names):  # the last names have no labelled row
        p = F.concat(p, F.array(*(F.lit(0.0) for _ in range(len(names) - model.numClasses))))
    return model.transform(rows).select("doc_id", "th", "n_tokens", p.alias("p"))


def _rate(theta: list[float]):
    return F.greatest(F.lit(0.0), 1 - sum((F.lit(float(t)) * F.col("p")[k] for k, t in enumerate(theta)), F.lit(0.0)))


def fit(weighed: DataFrame, shares: list[float], ridge: float = 1e-3, steps: int = 30, tolerance: float = 1e-6) -> tuple[list[float], list[float]]:
    """theta and the expected share of tokens of each domain that it leads to.  weighed: n_tokens, p."""
    size = len(shares)
    total = weighed.agg(F.sum("n_tokens")).first()[0] or 0
    theta, target = np.zeros(size), np.array(shares) / sum(shares)
    if not total:
        return theta.tolist(), [0.0] * size
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def state(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        rows = weighed.withColumn("r", _rate(at.tolist())).withColumn("w", F.col("n_tokens") / F.lit(float(total)))
        p = [F.col("p")[k] for k in range(size)]
        got = rows.agg(*(F.sum(F.col("w") * F.col("r") * x) for x in p), *(F.sum(F.when(F.col("r") > 0, F.col("w") * p[i] * p[j]).otherwise(0.0)) for i, j in pairs), F.sum(F.col("w") * (F.col("r") - 1) ** 2)).first()
        shares, curve = np.array(got[:size], float), np.zeros((size, size))
        for (i, j), v in zip(pairs, got[size:-1], strict=True):
            curve[i, j] = curve[j, i] = v
        off = shares - target
        return float(off @ off + ridge * got[-1]) / 2, shares, curve, off - ridge * at

    cost, share, curve, gradient = state(theta)
    for _ in range(steps):
        if np.abs(gradient).max() < tolerance * max(ridge, 1e-3):
            break
        move, scale = np.linalg.solve(curve + ridge * np.eye(size), gradient), 1.0
        while scale > 1e-3:
            new = state(theta + scale * move)
            if new[0] <= cost + 1e-15:
                break
            scale /= 2
        else:
            break
        done = cost - new[0] < 1e-12
        theta = theta + scale * move
        cost, share, curve, gradient = new
        if done:
            break
    return theta.tolist(), share.tolist()


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, **settings) -> DataFrame:
    """doc_id, th, n_tokens, p, rate: a row for each row of docs."""
    targets = targets or TARGETS
    weighed = materialise(posteriors(docs, domains, list(targets), **settings))
    theta, _ = fit(weighed, list(targets.values()))
    return weighed.withColumn("rate", _rate(theta))


def copies():
    """Whole copies of a row with a rate."""
    u = F.pmod(F.xxhash64("doc_id", "th", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("rate") + u).cast("int")


def apply(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, **settings) -> DataFrame:
    """The rows of docs, each as often as its rate says."""
    n = mix(docs, domains, targets, **settings).select("doc_id", "th", copies().alias("__n")).distinct().withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    out = docs.withColumn("__h", F.xxhash64(whole_text()))
    out = out.join(n.where("__n > 0"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")))
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__h", "__id", "__th", "__n", "__k")
