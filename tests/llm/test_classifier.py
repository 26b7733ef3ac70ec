import numpy as np
import pytest

from lodestar.llm.classifier import FEATURES, classified, features_of, fit
from lodestar.llm.queries import op2_hierarchical_bayes

DOCS = "doc_id long, text string, host string, path string, kept string"
LABELS = "doc_id long, quality int"
GOOD, BAD = "plain words in a row, one after another.", "*** ### $$$ THE %%% &&& *** THE"


def run(spark, docs, labels):
    docs, labels = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(labels, LABELS)
    return classified(docs, labels, "host", "path").collect()


def test_features():
    assert features_of(b"") == features_of(b" \n") == [0.0] * len(FEATURES)
    shares = features_of("Ab1 é*\n!".encode())[:7]
    assert shares == pytest.approx([1 / 9, 1 / 9, 1 / 9, 2 / 9, 0, 2 / 9, 2 / 9])
    assert features_of(b"a a a b")[-1] == 0.5


def test_fit_recovers_the_separation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(FEATURES)))
    good = (x[:, 0] - x[:, 3] + rng.normal(size=2000) > 0).astype(float)
    model = fit(x, good)
    odds = x @ np.array(model.weights) + model.offset
    assert ((odds > 0) == (good > 0.5)).mean() > 0.75
    assert model.weights[0] > 0 > model.weights[3]


def test_posteriors_against_plain_sums(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        host = f"h{i % 7}" if i % 3 else "hot"
        good = rng.random() < (0.9 if host == "hot" else 0.1 * (i % 7))
        docs.append((i, (GOOD if good else BAD) + f" w{i % 13}" * (i % 5), host, f"p{i % 2}" if i % 11 else None))
        if i % 2:
            labels.append((i, int(good if rng.random() < 0.9 else not good)))
    got = run(spark, docs, labels)
    own = {r["row"]["doc_id"]: r["own"] for r in got}
    mean = sum(own.values()) / len(own)

    def sums(key):
        out = {}
        for d in docs:
            n, total = out.get(key(d), (0, 0.0))
            out[key(d)] = (n + 1, total + own[d[0]])
        return out

    def strength(groups):
        rows = [(n, t, p) for n, t, p in groups if n > 1]
        seen, chance = sum((t - n * p) ** 2 / n for n, t, p in rows), sum(p * (1 - p) for _, _, p in rows)
        share = (seen - chance) / sum(p * (1 - p) * (n - 1) for n, _, p in rows)
        return min(1e6, max(1.0, 1 / share - 1)) if share > 0 else 1e6

    hosts, paths = sums(lambda d: d[2]), sums(lambda d: d[2:])
    a = strength([(n, t, mean) for n, t in hosts.values()])
    shrunk = {h: (t + a * mean) / (n + a) for h, (n, t) in hosts.items()}
    b = strength([(n, t, shrunk[k[0]]) for k, (n, t) in paths.items()])
    for r in got:
        i, d = r["row"]["doc_id"], docs[r["row"]["doc_id"]]
        (n, t), (m, u) = hosts[d[2]], paths[d[2:]]
        host = (t - own[i] + a * mean) / (n - 1 + a)
        assert r["host_mean"] == pytest.approx(host)
        assert r["path_mean"] == pytest.approx((u - own[i] + b * host) / (m - 1 + b))
    assert len(got) == 600


def test_odd_rows(spark):
    docs = [(1, None, None, None), (2, "", "h", None), (None, GOOD, None, "p"), (3, GOOD, "h", "p"), (3, GOOD, "h", "p"), (4, "x " * 100_000, "h", "q")]
    for labels in ([], [(3, 1)], [(3, 1), (4, 0), (None, 1), (9, 7), (4, None), (4, 1)]):
        got = run(spark, docs, labels)
        assert len(got) == 6 and all(0 <= r["posterior"] <= 1 for r in got)
        assert all(r["kept"] for r in got) or len(labels) > 1
    assert run(spark, [], [(1, 1)]) == []


def test_accuracy_on_rows_not_fitted(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = classified(docs, labels.filter("doc_id % 2 = 0"), "source", "lang", keep=["doc_id"])
    kept = {r["row"]["doc_id"]: r["kept"] for r in found.collect()}
    rest = [(kept[r["doc_id"]], r["quality"] == 1) for r in labels.filter("doc_id % 2 = 1").collect()]
    good, bad = [k for k, q in rest if q], [k for k, q in rest if not q]
    assert np.mean(good) >= 0.98 and 1 - np.mean(bad) >= 0.9, (np.mean(good), np.mean(bad))
    assert op2_hierarchical_bayes(spark, folder).count() == len(kept)
