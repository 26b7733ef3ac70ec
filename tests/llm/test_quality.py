import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm.oracles import ORACLES
from lodestar.llm.quality import COMMON_WORDS, QualityRules, judged, measured, references
from tests.compare import differences

PROSE = "the cat sat on the mat and the dog was in a house that is old, as it was with him. "


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    places = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places),
    )


def texts():
    numbered = " ".join(f"{w}{i}" for i, w in enumerate(PROSE.split() * 8))
    return [
        None, "", " \n\t ", "one", "a b a b a b a", "x\x0by\x0cz\r\n", "line\nline\n\nline\n", "naïve café   né",
        PROSE, numbered, PROSE * 3 + numbered, numbered.upper() + " !!", " | ".join(numbered.split()), "word " * 30_000,
        " ".join(f"{w}***" for w in numbered.split()), numbered, numbered,
    ]


def test_counts_against_brute_force(spark):
    rows = [(i, t, "en", "other") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["row"]["doc_id"]: tuple(r[n] for n in names) for r in judged(docs).collect()}
    assert got == {i: brute(t) for i, t, _, _ in rows}


def test_verdicts(spark):
    prose = [" ".join(f"{w}{i * k % 7}" if len(w) > 3 else w for i, w in enumerate(PROSE.split() * 8)) for k in range(1, 9)]
    prose = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], p) for p in prose]
    junk = [prose[0].upper(), " | ".join(prose[1].split()), " ".join(w + "###" for w in prose[2].split())]
    rows = [(i, t, "en") for i, t in enumerate(prose + junk)] + [(90, None, None), (91, prose[0], None), (None, prose[1], "en")]
    found = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), QualityRules(max_repeat_percent=101))
    kept = {(r["row"]["doc_id"], r["kept"]) for r in found.collect()}
    assert kept == {(i, True) for i in range(8)} | {(i, False) for i in range(8, 11)} | {(90, False), (91, True), (None, True)}
    # Without their labels they are judged alike, as long as the references stay.
    bare = spark.createDataFrame(rows[:6] + [(i, t, None) for i, t, _ in rows[6:]], "doc_id long, text string, lang string")
    assert {(r["row"]["doc_id"], r["kept"]) for r in judged(bare, QualityRules(max_repeat_percent=101)).collect()} == kept


def test_without_rows_or_languages(spark):
    schema = "doc_id long, text string, lang string"
    assert judged(spark.createDataFrame([], schema)).count() == 0
    unknown = spark.createDataFrame([(1, PROSE * 2, "xx"), (1, PROSE * 2, "xx")], schema)
    assert references(measured(unknown, QualityRules(), COMMON_WORDS), COMMON_WORDS) == {}
    assert [r["class_distance"] for r in judged(unknown).collect()] == [None, None]


def several_languages():
    english = [" ".join(f"{w}{'abcdefg'[i * k % 7]}" if len(w) > 3 else w for i, w in enumerate(PROSE.split() * 8)) for k in range(1, 5)]
    to_hebrew = str.maketrans({chr(97 + i): chr(0x5D0 + i) for i in range(26)})
    hebrew = [t.translate(to_hebrew) for t in english]
    polish = [re.sub(r"\b(the|that|was|and|in|a|is|it|as|on|with)\b", lambda m: m[0][::-1] + "ł", t) for t in english]
    rows = [(i, t, "en") for i, t in enumerate(english)] + [(10 + i, t, "he") for i, t in enumerate(hebrew)] + [(20 + i, t, "pl") for i, t in enumerate(polish)]
    junk = [polish[0].upper(), re.sub(r"(\w) ", "\\1### ", hebrew[0]), english[0].upper(), " | ".join(english[1].split())]
    return rows + [(30, hebrew[0], None), (31, polish[0], None)], junk


def test_any_labelled_language(spark):
    """Clean documents in a language without a list are kept, junk is not, and the label of a document decides nothing."""
    rows, junk = several_languages()
    for labels in (["pl", "he", "en", "en"], [None] * 4, ["en", "xx", "he", None]):
        docs = rows + [(40 + i, t, lang) for i, (t, lang) in enumerate(zip(junk, labels))]
        found = judged(spark.createDataFrame(docs, "doc_id long, text string, lang string"), QualityRules(max_repeat_percent=101))
        got = {r["row"]["doc_id"]: r["kept"] for r in found.collect()}
        assert {i for i, kept in got.items() if not kept} == {40, 41, 42, 43}, labels
    # Nobody has labelled this language: it is like prose, or in letters that no reference has.
    unlabelled = [(i, t, lang if lang == "en" else None) for i, t, lang in rows]
    found = judged(spark.createDataFrame(unlabelled, "doc_id long, text string, lang string"), QualityRules(max_repeat_percent=101))
    assert all(r["kept"] for r in found.collect())


def test_sql_agrees_on_missing_labels_and_a_fifth_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(d["doc_id"], d["text"], None if d["doc_id"] % 2 else "xx" if d["lang"] == "es" else d["lang"]) for d in docs]
    more, junk = several_languages()
    # Every word with the number of its place: no window comes twice.
    numbered = lambda t: " ".join(w + "abcdefghij"[i % 10] * (i // 40) for i, w in enumerate(t.split()))
    rows += [(100_000 + i, numbered(t), lang) for i, t, lang in more] + [(200_000 + i, numbered(t), None) for i, t in enumerate(junk)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = judged(frame).select(F.col("row.doc_id").alias("doc_id"), *counts)
    connection = duckdb.connect()
    connection.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}))
    assert differences(got, connection, ORACLES["op1_quality_divergence"]) is None
    assert got.filter("NOT kept AND NOT base_failed AND doc_id % 2 = 1").count() > 10
