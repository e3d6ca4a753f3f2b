"""Toxicity grades by a cumulative-link (proportional odds) regression on sparse words.

P(grade >= k | x) = sigmoid(w.x - theta_k) with one weight vector w for all thresholds and theta_1 < theta_2 < ...;
the expected severity is the sum of these probabilities over k. Features are the distinct words of the whole text and
their first 3 to 6 letters, marked ~, and ~2 and ~3 where so many words of the text begin with them: as far as they are
associated with the labels of the sample.

A document is rejected at the probability of grade 1 or more that gives the best mean of caught and spared documents out of
fold: the sample is dealt into FOLDS parts, and each part is scored by a model whose words, grades and weights come from the
other parts alone. (Toxic labels are few, so a half as the cut would miss many.)

A limit: the labels hold two values, so the order among toxic documents, and with it grades 1 to GRADES, comes from the
features themselves (the share of associated words). Expected severity is held against labels; the grades can't be.

Defined results: a null or empty text has no features and gets the score of the thresholds alone; labels that are
null or have no document are left out; a document labelled twice counts once, with its highest label; with no
toxic or no clean label, or no label at all, every document gets severity 0 and none is rejected. Repeated rows
get equal scores. Extra columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are fitted on; those with the smallest hash of their id, so the choice doesn't depend on order.
SAMPLE = 8_000
#: A feature needs this document frequency and chi-square in the sample.
MIN_DF, MIN_CHI2 = 5, 15.0
#: The cut where the folds can't tell: a document goes if it is more likely than not that its grade is at least 1.
REJECT_AT = 0.5
FOLDS, GRADES = 4, 3

WORD = re.compile(r"[^\W\d_]+")
STEMS, REPEATS = (3, 4, 5, 6), 3


def words_and_stems(text: str | None) -> tuple[set[str], Iterator[tuple[str, int]]]:
    """The distinct words of a text, and each beginning of words with its number of words."""
    words = WORD.findall((text or "").lower())
    return set(words), (x for k in STEMS for x in Counter([w[:k] for w in words if len(w) > k]).items())


def marked(stem: str, n: int) -> list[str]:
    return [stem + "~", *(f"{stem}~{k}" for k in range(2, min(n, REPEATS) + 1))]


def features(text: str | None) -> set[str]:
    words, stems = words_and_stems(text)
    return words.union(*(marked(s, n) for s, n in stems))


@dataclass(frozen=True)
class OrdinalModel:
    words: dict[str, float]
    theta: tuple[float, ...]
    cut: float = REJECT_AT

    def margins(self, texts) -> np.ndarray:
        known, stems = self.words.keys(), {w.partition("~")[0] for w in self.words if "~" in w}

        def margin(text: str | None) -> float:
            words, begun = words_and_stems(text)
            found = [self.words[w] for w in known & words]
            for s, n in begun:
                if s in stems:
                    found += [self.words[w] for w in marked(s, n) if w in known]
            return math.fsum(found)  # the same in any order

        return np.array([margin(t) for t in texts], dtype=float)

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """One column for each threshold: P(grade >= k)."""
        if not self.theta:
            return np.zeros((len(margins), 1))
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - np.array(self.theta)[None, :], -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-3, rate: float = 0.1):
    """Weights and thresholds by Adam on the mean negative log-likelihood. rows, cols: places of ones in the sparse matrix."""
    n, top = len(grades), int(grades.max())
    params = np.zeros(n_features + top)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    params[n_features] = first[0]
    params[n_features + 1 :] = np.log(np.maximum(np.diff(first), 1e-2))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
        theta = params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, w[cols], n)[:, None] - theta[None, :]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        like = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        low, high = slope[at, grades] / like, slope[at, grades + 1] / like
        dz = -(low - high)
        d_theta = np.array([(low * (grades == k)).sum() - (high * (grades == k - 1)).sum() for k in range(1, top + 1)]) / n
        grad = np.concatenate([np.bincount(cols, dz[rows], n_features) / n + l2 * w, [d_theta.sum()], [d_theta[j:].sum() * gaps[j - 1] for j in range(1, top)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_features], params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1 :]))])


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The probability at and above which documents go so that the mean of the shares of toxic ones caught and of others spared
    is greatest; it lies in the middle (of log odds) of the gap between two scores, the widest gap if there are several."""
    order = np.argsort(scores, kind="stable")
    odds, bad = np.log(scores[order] / (1 - scores[order])), toxic[order].astype(float)
    if not 0 < bad.sum() < len(bad):
        return REJECT_AT
    gap = np.concatenate([[0.0], np.diff(odds)])  # cutting before place i; equal scores have no gap
    spared = np.concatenate([[0.0], np.cumsum(1 - bad)])[:-1] / (1 - bad).sum()
    caught = 1 - np.concatenate([[0.0], np.cumsum(bad)])[:-1] / bad.sum()
    value = np.where(gap > 0, spared + caught, -1.0)
    at = max(range(len(value)), key=lambda k: (round(value[k], 12), gap[k]))
    return float(1 / (1 + np.exp(-(odds[at] - gap[at] / 2)))) if value[at] > 1 else REJECT_AT


def _trained(m: pd.DataFrame, f: list[np.ndarray], features_of: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (of all features; 0 for those not in features_of) and thresholds from the rows of m, or None without both labels.
    f: each row's places of features; bad: features that are more frequent in toxic documents."""
    y, at = m["y"].to_numpy(), np.full(len(features_of), -1)
    at[features_of] = np.arange(features_of.sum())
    f = [at[x][at[x] >= 0] for x in f]
    toxic = np.flatnonzero(y > 0)
    if not 0 < len(toxic) < len(y) or not features_of.any():
        return None
    worse = bad[features_of]
    grades = np.zeros(len(y), dtype=int)
    share = np.array([worse[f[i]].sum() / max(1, m["size"].iloc[i]) for i in toxic])
    grades[toxic] = 1 + (np.argsort(np.argsort(share, kind="stable"), kind="stable") * GRADES) // len(toxic)
    lengths = np.array([len(x) for x in f])
    weights, theta = fit_ordinal(np.repeat(np.arange(len(f)), lengths), np.concatenate(f).astype(int), grades, int(features_of.sum()))
    out = np.zeros(len(features_of))
    out[features_of] = weights
    return out, theta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most `sample` labelled documents.

    The labels say toxic or not; grades 1 to GRADES of toxic documents are the equal parts of their order by the
    share of words that are associated with toxic labels. The sample, its words' counts and the sparse matrix are
    bounded by `sample`, whatever the size of the corpus.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
        .withColumn("__fold", F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS)).cast("int"))
    )
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null").join(F.broadcast(chosen), "__id")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__y": b["__y"], "__fold": b["__fold"], "w": [sorted(features(t)) for t in b["__text"]]})

    words = rows.select("__y", "__fold", "__text").mapInPandas(spread, "__y int, __fold int, w array<string>").persist()
    try:
        parts = {r["__fold"]: (r["n"], r["t"]) for r in words.groupBy("__fold").agg(F.count("*").alias("n"), F.sum("__y").alias("t")).collect()}
        n, t = (int(sum(p[k] for p in parts.values())) for k in (0, 1))
        if not 0 < t < n:
            return OrdinalModel({}, ())
        count = words.select("__y", "__fold", F.explode("w").alias("w")).groupBy("w").agg(
            F.count("*").alias("df"), F.sum("__y").alias("a"), *(F.count_if(F.col("__fold") == k).alias(f"df{k}") for k in range(FOLDS)), *(F.sum(F.when(F.col("__fold") == k, F.col("__y")).otherwise(0)).alias(f"a{k}") for k in range(FOLDS))
        )

        def chosen_in(k: int | None):
            """Whether a word is a feature for the sample without fold k."""
            m, u = (n, t) if k is None else (n - parts.get(k, (0, 0))[0], t - parts.get(k, (0, 0))[1])
            a, df = (F.col(c) - (0 if k is None else F.col(f"{c}{k}")) for c in ("a", "df"))
            a, df = a.cast("double"), df.cast("double")
            if not 0 < u < m:
                return F.lit(False)
            chi2 = m * F.pow(a * (m - df - u + a) - (df - a) * (u - a), 2) / (df * (m - df) * u * (m - u))
            return F.when((df >= MIN_DF) & (df < m), chi2 >= MIN_CHI2).otherwise(False)

        chosen_as = [chosen_in(None).alias("all"), *(chosen_in(k).alias(f"f{k}") for k in range(FOLDS))]
        kept = count.where(F.col("df") >= MIN_DF).select("w", "a", "df", *(f"{c}{k}" for c in ("a", "df") for k in range(FOLDS)), *chosen_as)
        kept = kept.where(" or ".join(["all", *(f"f{k}" for k in range(FOLDS))])).orderBy("w").toPandas()
        if not kept["all"].any():
            return OrdinalModel({}, ())
        at = {w: i for i, w in enumerate(kept["w"])}

        def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"y": b["__y"], "fold": b["__fold"], "size": b["w"].map(len), "f": [sorted(at[x] for x in w if x in at) for w in b["w"]]})

        m = words.mapInPandas(sparse, "y int, fold int, size int, f array<int>").toPandas()
    finally:
        words.unpersist()
    f = [np.asarray(x, dtype=int) for x in m["f"]]
    scores = np.full(len(m), np.nan)
    for k, (held_n, held_t) in parts.items():
        rest, held = np.flatnonzero((m["fold"] != k).to_numpy()), np.flatnonzero((m["fold"] == k).to_numpy())
        df = (kept["df"] - kept[f"df{k}"]).to_numpy(float)
        bad = (kept["a"] - kept[f"a{k}"]).to_numpy(float) / np.maximum(df, 1) > (t - held_t) / max(1, n - held_n)
        if (trained := _trained(m.iloc[rest], [f[i] for i in rest], kept[f"f{k}"].to_numpy(bool), bad)) is not None:
            weights, theta = trained
            margin = np.array([weights[f[i]].sum() for i in held])
            scores[held] = 1 / (1 + np.exp(-np.clip(margin - theta[0], -40, 40)))
    known = ~np.isnan(scores)
    cut = best_cut(scores[known].clip(1e-15, 1 - 1e-15), m["y"].to_numpy()[known] > 0) if known.any() else REJECT_AT
    used = kept["all"].to_numpy(bool)
    weights, theta = _trained(m, f, used, (kept["a"] / kept["df"] > t / n).to_numpy())
    return OrdinalModel({w: float(v) for w, v, u in zip(kept["w"], weights, used, strict=True) if u}, tuple(map(float, theta)), cut)


def severity(model: OrdinalModel, text: Column) -> Column:
    """struct(at_least array<double>, expected_severity double, grade int, rejected boolean) of a text column."""

    @F.pandas_udf("at_least array<double>, expected_severity double, grade int, rejected boolean")
    def score(texts: pd.Series) -> pd.DataFrame:
        p = model.at_least(model.margins(texts))
        return pd.DataFrame({"at_least": list(p), "expected_severity": p.sum(axis=1), "grade": (p >= 0.5).sum(axis=1).astype("int32"), "rejected": (p[:, 0] >= model.cut) & bool(model.theta)})

    return score(text)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, P(grade >= k) for each k, expected severity, grade and the decision, for every row of docs."""
    return docs.select(F.col(id_col), severity(model, F.col(text_col)).alias("s")).select(id_col, "s.at_least", "s.expected_severity", "s.grade", "s.rejected")
