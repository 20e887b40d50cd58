"""Non-negative positive-unlabelled learning in numpy, over rows of active feature numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Bounds of the training sample: rows of confirmed positives and of unlabelled text.
MAX_POSITIVES, MAX_UNLABELLED = 6_000, 12_000


@dataclass
class Linear:
    """score = sigmoid(bias + sum of the weights of a row's active features)."""

    weights: np.ndarray
    bias: float

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weights[feature], rows)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def nonnegative_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part) of the class-prior-corrected logistic risk: prior * R_p(+1), and R_u(-1) - prior * R_p(-1)."""
    return prior * float(_softplus(-zp).mean()), float(_softplus(zu).mean() - prior * _softplus(zp).mean())


def fit(positives: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], features: int, prior: float, epochs: int = 400, rate: float = 0.05, decay: float | None = None, seed: int = 7) -> Linear:
    """Minimises the non-negative risk by Adam over the whole sample. ``positives`` and ``unlabelled`` are (row, feature, rows).

    Where the negative part of the risk falls below 0 by more than a standard error of its estimate, the step climbs back out of it instead. ``decay`` is the L2 weight, by default less
    the more positives there are; the bias has none."""
    rp, fp, n_p = positives
    ru, fu, n_u = unlabelled
    decay = 1e-4 + 0.1 / n_p if decay is None else decay
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1e-3, features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, epochs + 1):
        zp = b + np.bincount(rp, w[fp], n_p)
        zu = b + np.bincount(ru, w[fu], n_u)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
        _, negative = nonnegative_risk(zp, zu, prior)
        slack = np.sqrt(_softplus(zu).var() / n_u + prior**2 * _softplus(zp).var() / n_p)
        gp, gu = -prior * sp / n_p, su / n_u
        if negative >= -slack:
            gp = gp + prior * (sp - 1) / n_p
        else:
            gp, gu = -gp, -gu
        grad = np.empty(features + 1)
        grad[:-1] = np.bincount(fp, gp[rp], features) + np.bincount(fu, gu[ru], features) + decay * w
        grad[-1] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return Linear(w, b)


def fit_bag(positives: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], features: int, prior: float, members: int = 3, **how) -> list[Linear]:
    """Classifiers on bootstrap samples of the rows; their mean score is the answer."""
    out = []
    for k in range(members):
        rng = np.random.default_rng(k)

        def resampled(x: tuple[np.ndarray, np.ndarray, int], rng=rng) -> tuple[np.ndarray, np.ndarray, int]:
            row, feature, n = x
            order = np.argsort(row, kind="stable")
            row, feature = row[order], feature[order]
            starts = np.searchsorted(row, np.arange(n + 1))
            drawn = rng.integers(0, n, n)
            sizes = (starts[1:] - starts[:-1])[drawn]
            at = np.repeat(starts[drawn] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            return np.repeat(np.arange(n), sizes), feature[at], n

        out.append(fit(resampled(positives), resampled(unlabelled), features, prior, seed=k, **how))
    return out


def _chosen(sample: tuple[np.ndarray, np.ndarray, int], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows of a sample where ``mask`` holds."""
    row, feature, _ = sample
    held = mask[row]
    return (np.cumsum(mask) - 1)[row[held]], feature[held], int(mask.sum())


def estimated_prior(positives: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], features: int, seed: int = 1) -> float:
    """The share of positives among the unlabelled rows, from positive and unlabelled rows alone.

    Above any score the unlabelled rows are at least the prior times as dense as the positive ones, and just so where no negative scores as high: the
    estimate is the least ratio of the two shares, over scores that half of the positives or more reach. A half of the rows trains the classifier that
    scores the other half, and the other way round; the mean of both counts. Kept within 1/1000 of 0 and 1; 0.5 where a half is empty."""
    rng = np.random.default_rng(seed)
    halves = [rng.random(x[2]) < 0.5 for x in (positives, unlabelled)]
    least = []
    for side in (True, False):
        train = [_chosen(x, h == side) for x, h in zip((positives, unlabelled), halves, strict=True)]
        test = [_chosen(x, h != side) for x, h in zip((positives, unlabelled), halves, strict=True)]
        if not all(x[2] for x in (*train, *test)):
            return 0.5
        bag = fit_bag(*train, features, 0.5, members=1, epochs=300, rate=0.3, decay=1e-4)
        p, u = (mean_scores(bag, *x) for x in test)
        least.append(min(float((u >= t).mean() / (p >= t).mean()) for t in np.quantile(p, np.linspace(0, 0.5, 26))))
    return min(max(float(np.mean(least)), 1e-3), 1 - 1e-3)


def mean_scores(bag: list[Linear], row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
    return np.mean([m.scores(row, feature, rows) for m in bag], axis=0)


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, trainable: Column, id_col: str = "doc_id", text_col: str = "text", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> tuple[DataFrame, float]:
    """((doc_id, text, positive, unlabelled), class prior) from rows where ``trainable`` (on column doc_id) holds.

    Positives are rows labelled 1; their texts repeat once. Unlabelled rows are drawn without regard to labels. Both are drawn by a hash of the id at
    the rate that gives the bound at most (within chance), so each task keeps its own rows and nothing is ordered. The prior is the share of 1 among
    the trainable labels, kept within 1/1000 of 0 and 1; without labels 0.5. A row with several labels counts as positive if one is 1."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("label")).where(trainable)
    n = known.agg(F.count("*").alias("all"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    total = docs.select(F.count("*")).first()[0]
    prior = min(max(n["ones"] / n["all"], 1e-3), 1 - 1e-3) if n["all"] else 0.5

    def drawn(rate: float, salt: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(rate * (1 << 30))

    chosen = known.where("label = 1").where(drawn(min(1.0, max_positives / max(n["ones"], 1)), 1)).select("doc_id", F.lit(True).alias("positive"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(trainable)
    rows = rows.join(F.broadcast(chosen), "doc_id", "left").withColumn("unlabelled", drawn(min(1.0, max_unlabelled / max(total, 1)), 2))  # about max_positives rows
    rows = rows.where("positive or unlabelled").select("doc_id", "text", F.coalesce("positive", F.lit(False)).alias("positive"), "unlabelled")
    return cut(rows), prior
