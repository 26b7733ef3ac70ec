"""Stored postings and n-grams, against what the texts themselves say."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.plans import postings
from lodestar.session import scratch_path
from lodestar.sources import versions

WORDS = ["the", "a", "b", "ghost", "Ünder", "x1"]


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.sample(WORDS, rng.randrange(len(WORDS))) + ["common"])) for i in range(n)]


def index_of(spark, rows, files=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return postings.text_rows(docs, "doc_id", "text")


def having(rows, terms):
    return sorted({i for i, text in rows if text and set(terms) <= set(text.lower().split())})


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_terms_over_segments(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BITS", 8)  # many blocks
    first, second, third = texts(900, 1), texts(300, 2), texts(40, 3)
    path = scratch_path(spark, "postings")
    index = postings.build_postings(index_of(spark, first), path, files=5)
    old = postings.open_postings(spark, path)
    index = index.append(index_of(spark, [(i + 5000, t) for i, t in second]))
    index = index.append(index_of(spark, third))  # known ids, with further texts
    assert index.version == 2 and postings.open_postings(spark, path).segments == index.segments
    everything = first + [(i + 5000, t) for i, t in second]
    for terms in (["the"], ["a", "b"], ["common", "ünder", "x1"], ["the", "the"], ["nothing"], ["the", "nothing"], ["common"]):
        assert ids(old.having_all(terms)) == having(first, terms)
        both = sorted({*having(everything, terms), *having(third, terms)})
        assert ids(index.having_all(terms)) == both, terms
    with pytest.raises(ValueError):
        index.having_all([])


def test_odd_rows(spark):
    path = scratch_path(spark, "postings")
    rows = [(1, None), (2, ""), (3, " .,; "), (4, "Word word WORD"), (4, "word"), (5, "y" * 100_000 + " word")]
    index = postings.build_postings(index_of(spark, rows), path)
    assert ids(index.having_all(["word"])) == [4, 5] and ids(index.having_all(["y" * 100_000])) == [5]
    empty = postings.build_postings(index_of(spark, rows).limit(0), scratch_path(spark, "postings"))
    assert empty.having_all(["word"]).count() == 0
    assert ids(empty.append(index_of(spark, rows)).having_all(["word"])) == [4, 5]


def test_a_search_reads_the_index_only(spark):
    path = scratch_path(spark, "postings")
    index = postings.build_postings(index_of(spark, texts(2000, 4)), path, files=8)
    found = index.having_all(["ghost", "a"])
    assert all(f"/{path.rsplit('/', 1)[1]}/" in name for name in found.inputFiles())
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [a,ghost])" in scan.replace("PushedFilters: ", "")
    read = index.files_read(["ghost"]).first()
    assert read["files"] >= 4 and read["files_with_terms"] == 1 and read["postings"] == 1


def test_substrings(spark):
    rng = random.Random(6)
    keys = ["".join(rng.choices("ab_19é", k=rng.randrange(12))) for _ in range(400)] + ["", "a", "aaaaaaa", "aaa"]
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(None, 0)], "row string, value int")
    index = postings.build_postings(postings.key_rows(table), scratch_path(spark, "grams"), files=4)
    terms = ["", "a", "9", "é", "ab", "_1", "aaa", "aaaa", "ab_", "b_1a", "ab_19é", "nowhere", "%", "."] + [k[1:6] for k in keys[:6]]
    for term in terms:
        got = postings.grep_stored(table, index, term)
        assert sorted(got.select("row", "value").collect()) == sorted(table.filter(F.col("row").contains(term)).collect()), term


def test_versions(spark):
    path = scratch_path(spark, "versions")
    assert versions.last_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.publish_version(spark, path, None, {"a": [1, "é"]}) == 0
    assert versions.publish_version(spark, path, 0, {"a": 2}) == 1
    with pytest.raises(versions.Conflict):
        versions.publish_version(spark, path, 0, {"a": 3})
    assert versions.read_version(spark, path) == (1, {"a": 2})
