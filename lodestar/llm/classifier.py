"""Quality classifier with hierarchical empirical Bayes.

A logistic model of a few shares (kinds of characters, distinct words, word length) is the document's own evidence.
It is fitted on a bounded sample of labelled rows. Then all documents, labelled or not, are summed up per host and per
path of a host: the posterior of a host is its mean, shrunk towards the global mean the more, the fewer documents it
has; that of a path is shrunk towards its host's. How strongly is itself estimated from how much hosts, and paths
within hosts, differ. A document's posterior odds are its own evidence times the odds of its path, from which its own
share is taken out.

The sums are pre-aggregated in each task, so a host with a third of all rows costs a row per task.

Defined results: a null or empty text has all shares zero; null hosts and paths are groups of their own; null and
unknown labels are no labels, and of several labels for one id the lowest counts; without labels of both kinds the
model has no evidence and every posterior is one half, which keeps the document; repeated rows count each; an empty
table gives no rows; other columns pass through in ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import field, with_row
from lodestar.session import written

FEATURES = ("lower", "upper", "digit", "space", "stop", "symbol", "wide", "distinct", "length", "repeated")


def _byte_classes() -> np.ndarray:
    classes = np.full(256, 5, np.intp)
    for k, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"()-")):
        classes[list(members)] = k
    classes[128:] = 6
    return classes


CLASSES = _byte_classes()


def features_of(text: bytes) -> list[float]:
    """Shares of kinds of bytes, of distinct words and of words equal to the one before, and the mean word length."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    shares = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=7) / len(text)
    # The share of distinct words falls with length by itself: a root takes most of that out.
    distinct = min(1.0, len(set(words)) / len(words) ** 0.75)
    repeated = sum(map(bytes.__eq__, words[1:], words)) / len(words)
    return [*shares.tolist(), distinct, min(3.0, len(b"".join(words)) / len(words) / 10), repeated]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Evidence:
    """A logistic model over the features, without the share of good rows it was fitted on."""

    weights: tuple[float, ...]
    offset: float
    prior: float

    def log_odds(self, features: Column) -> Column:
        return sum((F.coalesce(F.get(features, i), F.lit(0.0)) * w for i, w in enumerate(self.weights)), F.lit(self.offset))


def fit(rows: np.ndarray, good: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> Evidence:
    """Newton's method on the penalised likelihood. With one kind of label only there is no evidence."""
    if len(set(good.tolist())) < 2:
        return Evidence((0.0,) * len(FEATURES), 0.0, 0.5)
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
    x = np.hstack([(rows - mean) / scale, np.ones((len(rows), 1))])
    shrink = np.full(x.shape[1], penalty * len(rows))
    shrink[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (good - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    prior = float(good.mean())
    weights = w[:-1] / scale
    return Evidence(tuple(weights.tolist()), float(w[-1] - weights @ mean - np.log(prior / (1 - prior))), prior)


def labelled_sample(scored: DataFrame, labels: DataFrame, rows: int, doc_id: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about so many labelled documents, chosen by a hash of the id: no more than twice as
    many come to the driver."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("good"))
    own = scored.select(field(doc_id).alias("id"), "features").join(known, "id")
    n = own.count()
    chance = min(1.0, rows / max(n, 1))
    chosen = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < chance * (1 << 30)).limit(2 * rows).toArrow()
    x = np.array(chosen.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    return x, chosen.column("good").to_numpy().astype(float)


def _strength(groups: DataFrame) -> float:
    """Documents that the level above counts for, by moments of ``(n, total, prior)``: the less the groups differ
    beyond chance, the more."""
    spread = F.col("total") - F.col("n") * F.col("prior")
    chance = F.col("prior") * (1 - F.col("prior"))
    row = groups.filter("n > 1").agg(
        F.sum(spread * spread / F.col("n")).alias("seen"), F.sum(chance).alias("expected"), F.sum(chance * (F.col("n") - 1)).alias("weight")
    ).first()
    if not row["weight"]:
        return 10.0
    # seen = chance * (1 + (n - 1) / (1 + strength)), summed over the groups.
    share = (row["seen"] - row["expected"]) / row["weight"]
    return float(min(1e6, max(1.0, 1 / share - 1))) if share > 0 else 1e6


def classified(docs: DataFrame, labels: DataFrame, host: str, path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, fit_rows: int = 20_000, least: float = 0.5) -> DataFrame:
    """``row``, ``own`` (probability by the document alone), ``host_mean``, ``path_mean`` (posterior means without
    the document itself), ``posterior`` and ``kept``. ``labels`` has ``doc_id`` and ``quality``, 0 or 1."""
    scored = with_row(docs, keep, host=F.col(host), path=F.col(path), features=_features(F.coalesce(F.col(text), F.lit(""))))
    scored = written(scored, "features")
    model = fit(*labelled_sample(scored, labels, fit_rows, doc_id))
    evidence = model.log_odds(F.col("features"))
    prior_odds = float(np.log(model.prior / (1 - model.prior)))
    scored = scored.select("row", "host", "path", evidence.alias("evidence"), (1 / (1 + F.exp(-evidence - prior_odds))).alias("own"))
    # Paths first: hosts are sums of their paths, and all documents are the sum of the hosts.
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("total")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    everything = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_total").alias("total")).first()
    mean = everything["total"] / everything["n"] if everything["n"] else 0.5
    of_hosts = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_total").alias("total"), F.lit(mean).alias("prior")))
    shrunk = (F.col("host_total") + of_hosts * mean) / (F.col("host_n") + of_hosts)
    levels = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    of_paths = _strength(levels.select("n", "total", shrunk.alias("prior")))
    levels = levels.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "total", "host_n", "host_total")
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    joined = scored.join(levels, same)
    host_mean = (F.col("host_total") - F.col("own") + of_hosts * mean) / (F.col("host_n") - 1 + of_hosts)
    joined = joined.withColumn("host_mean", host_mean)
    path_mean = (F.col("total") - F.col("own") + of_paths * F.col("host_mean")) / (F.col("n") - 1 + of_paths)
    joined = joined.withColumn("path_mean", F.least(F.greatest(path_mean, F.lit(1e-6)), F.lit(1 - 1e-6)))
    odds = F.col("evidence") + F.log(F.col("path_mean") / (1 - F.col("path_mean")))
    joined = joined.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return joined.select("row", "own", "host_mean", "path_mean", "posterior", (F.col("posterior") >= least).alias("kept"))
