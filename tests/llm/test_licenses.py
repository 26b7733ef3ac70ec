import random
import re

from lodestar.llm.licenses import TEMPLATES, prepared, scanned
from lodestar.llm.queries import op9_license_templates

FOLDER = "/root/testdata/sf0.01"


def filler(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))


def test_every_template_at_every_place():
    texts = [f"{filler(k, k % 40)} {t} {filler(k + 1, 30)}" for k, (_, t) in enumerate(TEMPLATES * 10)]
    found = prepared(TEMPLATES).matches(texts)
    for k, (name, _) in enumerate(TEMPLATES * 10):
        own = {m["license"]: m for m in found[k]}
        assert own[name]["containment"] == 1.0 and own[name]["word"] <= k % 40


def test_changed_and_foreign_texts():
    long = TEMPLATES[2][1].split()
    changed = " ".join("thing" if i == 20 else w for i, w in enumerate(long))
    broken = " ".join("thing" if i % 6 == 0 else w for i, w in enumerate(long))
    texts = [filler(1, 50) + " " + changed, broken, filler(2, 5000), "", "MIT", "released UNDER the\nmit   license!"]
    got = [[m["license"] for m in row] for row in prepared(TEMPLATES).matches(texts)]
    assert got == [["MIT"], [], [], [], [], ["MIT"]]


def test_neighbours_do_not_mix():
    assert prepared(TEMPLATES).matches(["released under", "the mit license", "released under the MIT license"])[:2] == [[], []]


def test_rows(spark):
    notice = TEMPLATES[0][1]
    rows = [(1, None), (2, ""), (3, notice), (3, notice), (None, f"{notice} {notice}"), (4, "word " * 50_000 + notice)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted((str(r["row"]["doc_id"]), r["license"], r["word"]) for r in scanned(docs).collect())
    assert got == [("3", "MIT", 0), ("3", "MIT", 0), ("4", "MIT", 50_000), ("None", "MIT", 0)]
    assert scanned(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    """Each notice that stands word by word in a text, and nothing but what shares most of a template's shingles."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    threes = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    docs = {d["doc_id"]: words(d["text"]) for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {(r["doc_id"], r["license"]) for r in op9_license_templates(spark, FOLDER).collect()}
    sure = {(d, n) for d, own in docs.items() for n, t in TEMPLATES if f" {' '.join(words(t))} " in f" {' '.join(own)} "}
    may = {(d, n) for d, own in docs.items() for n, t in TEMPLATES if len(threes(own) & threes(words(t))) >= 0.8 * len(threes(words(t)))}
    assert sure <= got <= may and len(sure) > 10
