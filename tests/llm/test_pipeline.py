"""The pipeline against the stages' rules, checked row by row in plain Python."""

import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm.queries import WORD_BPE, op1_quality_divergence
from tests.llm.test_packing import check
from tests.llm.test_simhash import slow_components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"
NAMES = ["quality rules", "language ID", "SimHash near-dedup", "benchmark decontamination", "packing"]


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    before, now, kept = docs, docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, FOLDER).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.dtypes == before.dtypes
        kept.append(by_id(now))
    start = by_id(docs)
    assert all(kept[-1][i] == start[i] for i in kept[-1])

    assert set(kept[0]) == {r["doc_id"] for r in op1_quality_divergence(spark, FOLDER).collect() if r["kept"]}
    assert set(kept[0]) - set(kept[1]) == {i for i in kept[0] if not re.search(r"[^\W\d_]", kept[0][i]["text"])}
    prints = [(i, slow_fingerprint(r["text"])) for i, r in kept[1].items()]
    assert set(kept[2]) == {c for _, _, c in slow_components(prints)}
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {i for i, r in kept[2].items() if any(f" {item} " in f" {words(r['text'])} " for item in items)}
    assert set(kept[2]) - set(kept[3]) == held

    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    check(pieces, [(i, r["text"]) for i, r in kept[3].items()], Tokenizer.from_file(WORD_BPE))
    assert Counter(p["doc_id"] for p in pieces).keys() == kept[3].keys()


def test_stages_can_be_chained_without_writing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() > 0


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and an empty table go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"the word{i} of item{i}" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", None, 5), (None, text, "en", None, 5),
            (3, text + " more", "en", "s", 1), (3, text + " more", "en", "s", 1), (4, "x" * 200_000, "de", "s", 1)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, FOLDER).write.parquet(path := f"{tmp_path}/{len(part)}-{name.replace(' ', '-')}")
            docs = spark.read.parquet(path)
        assert docs.filter("start = 0").count() == (3 if part else 0)
