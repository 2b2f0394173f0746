"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log-likelihood ratio of a logistic model over counts of its characters, words and lines.
The share of good documents of a host shrinks toward the share of all, and that of a path of the host toward the host's;
how strongly, the spread between hosts and between paths decides (method of moments). A document's posterior is its evidence
on top of the log-odds of its path, from which its own part is taken out. All shares come from grouped sums over all
documents; the model alone is fitted on a bounded sample of labelled ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoframe.llm.shared import written

#: Labelled documents the model is fitted on, the first by a hash of their ids.
SAMPLE = 20000
THRESHOLD = 0.5
#: Paths whose sums are sent to every task; beyond that the documents are joined to them by a salted shuffle.
SENT_PATHS = 200_000
SALTS = 64
#: Bounds of the prior's weight, in documents.
WEIGHTS = (2.0, 10_000.0)
N_FEATURES = 11
#: Letters a word counts as having at most, and bounds of the model's log-odds: a text unlike any labelled one isn't far
#: beyond all of them.
LONGEST, FARTHEST = 20.0, 30.0

#: Columns that the operator adds.
MADE = ("evidence", "host_share", "path_share", "posterior", "keep")


def features(text: Column) -> Column:
    """An array of numbers of about 0 to 1, all by built-in functions; zeros for a text without a character."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    letters, capitals, digits = left(r"[^\p{L}]+"), left(r"[^\p{Lu}]+"), left(r"[^\p{N}]+")
    blanks, stops, calls, bars = left(r"\S+"), left(r"[^.,;:]+"), left(r"[^!?]+"), left(r"[^|]+")
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")
    n_words, types = F.size(words), F.size(F.array_distinct(words))
    share = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.array(
        F.log1p(n.cast("double")) / 12,
        share(letters, n),
        share(capitals, letters),
        share(digits, n),
        share(stops, n) * 5,
        share(calls, n) * 5,
        share(bars, n) * 5,
        share(n - letters - digits - blanks - stops - calls - bars, n) * 5,
        F.least(share(letters, n_words) / 10, F.lit(LONGEST / 10)),
        F.when(n_words > 1, F.log(types.cast("double")) / F.log(n_words.cast("double"))).otherwise(1.0),
        share(F.size(F.array_distinct(lines)), F.size(lines)),
    )


def expanded(x: np.ndarray) -> np.ndarray:
    """1, the features, and all their products."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic model over expanded(x), by damped Newton steps; zeros where only one class is there."""
    phi = expanded(x) if len(x) else np.zeros((0, 1 + N_FEATURES + N_FEATURES * (N_FEATURES + 1) // 2))
    w = np.zeros(phi.shape[1])
    if len(np.unique(y)) < 2:
        return w

    def loss(w: np.ndarray) -> float:
        z = phi @ w
        return float(np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * (w[1:] @ w[1:]))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(phi @ w, -35, 35)))
        slope = phi.T @ (p - y) / len(y) + ridge * np.append(0, w[1:])
        bend = (phi * (p * (1 - p))[:, None]).T @ phi / len(y) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4 and (new := loss(w - size * step)) > now:
            size /= 2
        w = w - size * step
        if now - new < 1e-9:
            break
        now = new
    return w


def _score(x: Column, w: np.ndarray) -> Column:
    """The model's log-odds. Array functions keep the optimizer from copying the features into every product of them."""
    products = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 1, N_FEATURES), lambda b: a * b)))
    terms = F.zip_with(F.concat(F.array(F.lit(1.0)), x, products), F.lit([float(v) for v in w]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


class Model:
    """Weights, and the log-odds of the sample they were fitted on."""

    def __init__(self, w: np.ndarray, y: np.ndarray):
        share = min(max(float(np.mean(y)) if len(y) else 0.5, 1e-4), 1 - 1e-4)
        self.w, self.odds = w, math.log(share / (1 - share)) if w.any() else 0.0

    def logit(self, x: Column) -> Column:
        return F.greatest(F.least(_score(x, self.w), F.lit(FARTHEST)), F.lit(-FARTHEST))


def _strength(sums: DataFrame, mean: Column, n: str, s: str) -> float:
    """The weight of a beta prior: what share of the groups' spread around `mean` isn't due to their size."""
    m = F.col(s) / F.col(n)
    row = sums.where(F.col(n) > 1).agg(F.sum(F.col(n) * (m - mean) ** 2), F.sum(F.col(n)), F.sum(F.lit(1.0)), F.avg(mean * (1 - mean))).first()
    if not row[1] or row[2] < 2:
        return WEIGHTS[1]
    typical = row[1] / row[2]
    between = (row[0] / row[2] - row[3]) / typical
    if between <= 0:
        return WEIGHTS[1]
    return min(max(row[3] / between - 1, WEIGHTS[0]), WEIGHTS[1])


def _blank(text: Column) -> Column:
    return ~F.coalesce(F.regexp_like(text, F.lit(r"\S")), F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_id: str, label: str, sample: int = SAMPLE) -> Model:
    """docs: (lf_id, lf_x). Labels that are null or of no document are left out; of several labels of an id the lowest holds."""
    one = labels.where(F.col(label_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label_id).alias("lf_id")).agg(F.min(label).cast("double").alias("y"))
    rows = written(docs.join(one, "lf_id").select(F.col("lf_x").alias("x"), "y", "lf_id", F.xxhash64("lf_id").alias("h")), "labelled")
    # Each task sends the driver its first rows: those below a hash that twice the sample lies under, so that they are few together.
    share = min(1.0, 2 * sample / max(rows.count(), 1))
    low = rows.where(F.col("h") <= min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1))
    rows = (low if low.count() >= sample else rows).orderBy("h", "lf_id", "x").limit(sample).toPandas()
    y = rows["y"].to_numpy()
    return Model(fit(np.array(rows["x"].tolist()).reshape(-1, N_FEATURES), y), y)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", section_col: str = "lang", label_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Add evidence, host_share, path_share, posterior and keep (posterior >= threshold) to every row.

    A path is a host with a section of it. Texts that are null or blank have evidence and posterior null, aren't kept, and
    count in no share. Null hosts or sections form groups of their own; repeated rows count as often as they stand; without
    labels of both classes there is no evidence and everything is kept but blank texts; an empty table gives an empty table;
    texts of any length are measured whole. Words count LONGEST letters at most, the log-odds stay within FARTHEST and the
    weights of priors within WEIGHTS. Other columns, of any names, pass, and those named as the new ones are replaced. keep: the columns that stay (all by default).
    """
    stay = [c for c in docs.columns if c.lower() not in MADE and (keep is None or c in keep)]
    text, host, section = F.col(f"`{text_col}`"), F.col(f"`{host_col}`").alias("lf_host"), F.col(f"`{section_col}`").alias("lf_section")
    made = [host, section, features(text).alias("lf_x"), _blank(text).alias("lf_blank")]
    # The features are written with what passes, so that they are made once and joined to nothing.
    narrow = written(docs.select(F.col(f"`{id_col}`").alias("lf_id"), *made, *[F.col(f"`{c}`").alias(f"lf_{k}") for k, c in enumerate(stay)]), "features")
    real = narrow.where("not lf_blank")
    model = train(real, labels, label_id, label, sample)
    chance = lambda z: 1 / (1 + F.exp(-z))
    sums = real.groupBy("lf_host", "lf_section").agg(F.count("*").alias("lf_n"), F.sum(chance(model.logit(F.col("lf_x")))).alias("lf_s"))
    sums = written(sums, "paths")
    hosts = sums.groupBy("lf_host").agg(F.sum("lf_n").alias("lf_hn"), F.sum("lf_s").alias("lf_hs"))
    total = hosts.agg(F.sum("lf_hn"), F.sum("lf_hs")).first()
    overall = min(max(total[1] / total[0], 1e-4), 1 - 1e-4) if total[0] else 0.5
    k_host = _strength(hosts, F.lit(overall), "lf_hn", "lf_hs")
    paths = sums.join(hosts.withColumnRenamed("lf_host", "lf_h2"), F.col("lf_host").eqNullSafe(F.col("lf_h2"))).drop("lf_h2")
    k_path = _strength(paths, F.col("lf_hs") / F.col("lf_hn"), "lf_n", "lf_s")
    paths = written(paths.withColumnsRenamed({"lf_host": "lf_host2", "lf_section": "lf_section2"}), "shares")
    # What passes is one column, so that no name of its columns meets one used here.
    row = lambda columns: F.struct(*[c.alias(n) for c, n in zip(columns, stay)] or [F.lit(0)]).alias("lf_row")
    rows = narrow.select(row([F.col(f"lf_{k}") for k in range(len(stay))]), "lf_host", "lf_section", "lf_x", "lf_blank")
    on = [F.col("lf_host").eqNullSafe(F.col("lf_host2")), F.col("lf_section").eqNullSafe(F.col("lf_section2"))]
    if paths.count() <= SENT_PATHS:
        rows = rows.join(F.broadcast(paths), on, "left")
    else:
        rows = rows.withColumn("lf_salt", F.floor(F.rand(3) * SALTS).cast("int"))
        paths = paths.withColumn("lf_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(paths, [*on, F.col("lf_salt") == F.col("lf_salt2")], "left")
    z = F.when(~F.col("lf_blank"), model.logit(F.col("lf_x")))
    rows = rows.withColumn("lf_z", z).withColumn("lf_p", chance(F.col("lf_z")))
    host_share = (F.col("lf_hs") - F.col("lf_p") + k_host * overall) / (F.col("lf_hn") - 1 + k_host)
    path_share = (F.col("lf_s") - F.col("lf_p") + k_path * F.col("lf_hshare")) / (F.col("lf_n") - 1 + k_path)
    rows = rows.withColumn("lf_hshare", host_share).withColumn("lf_pshare", path_share)
    evidence = F.col("lf_z") - F.lit(model.odds)
    odds = F.log(F.col("lf_pshare")) - F.log1p(-F.col("lf_pshare")) if model.w.any() else F.lit(0.0)
    rows = rows.withColumn("lf_post", F.when(F.col("lf_z").isNotNull(), chance(evidence + odds)))
    return rows.select(
        *[F.col("lf_row")[c].alias(c) for c in stay],
        evidence.alias("evidence"),
        F.col("lf_hshare").alias("host_share"),
        F.col("lf_pshare").alias("path_share"),
        F.col("lf_post").alias("posterior"),
        F.coalesce(F.col("lf_post") >= threshold, F.lit(False)).alias("keep"),
    )
