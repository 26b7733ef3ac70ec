import random
import re

import numpy as np
import pytest
import xxhash

from lodestar.llm import simhash
from lodestar.llm.components import components
from lodestar.llm.queries import op4_simhash_components

FOLDER = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """Smallest id reachable for each (id, fingerprint)."""
    best = {}
    for i, f in rows:
        best[f] = min(best.get(f, i), i)
    prints, parent = list(best), dict(best)
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= 4 and parent[b] < parent[a]:
                    parent[a], changed = parent[b], True
    return [(i, f, parent[f]) for i, f in rows]


def test_fingerprints():
    texts = ["", " \n", "One", "a b c", "A b c D", "a b c d e", "É é É é x\x0by\x0cz w", "the same the same " * 5000]
    texts += [" ".join(random.Random(i).choices("alpha Beta gamma delta éps zeta".split(), k=i)) for i in range(60)]
    for text in texts:
        assert simhash.fingerprint_of(text.encode()) == np.uint64(slow_fingerprint(text)).astype(np.int64), text[:50]


def clustered(n, seed):
    """Fingerprints of which many lie near each other, in chains and stars."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            out.append(f)
            for _ in range(rng.choice([0, 2, 4, 5])):
                f ^= 1 << rng.randrange(64)
    return out[:n]


def test_near_pairs_of_runs():
    prints = np.array(clustered(500, 1), np.uint64)
    ends = np.array(sorted(random.Random(2).sample(range(1, 500), 30)) + [500])
    run_end = ends[np.searchsorted(ends, np.arange(500), side="right")]
    found = {(a, b) for i, j in simhash.near_pairs(prints, run_end, 4) for a, b in zip(i.tolist(), j.tolist())}
    wanted = {(a, b) for a in range(500) for b in range(a + 1, run_end[a]) if bin(int(prints[a] ^ prints[b])).count("1") <= 4}
    assert found == wanted and len(wanted) > 200


@pytest.mark.parametrize("unit", [4, simhash.UNIT])
def test_classes(spark, unit):
    rows = [(i * 7 % 1009, f - (f >> 63 << 64)) for i, f in enumerate(clustered(900, 3))]
    got = simhash.linked_classes(spark.createDataFrame(rows, "id long, fingerprint long"), unit=unit).collect()
    wanted = {f - (f >> 63 << 64): c for _, f, c in slow_components([(i, f % (1 << 64)) for i, f in rows])}
    assert {r["fingerprint"]: r["component"] for r in got} == wanted


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999), (5, 5)], "u long, v long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(1, 301)} | {(1000, 999)}


def test_rows_to_keep(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (None, text), (7, "another text altogether here"), (8, None), (6, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["row"]["doc_id"], r["component"]) for r in got if r["row"]["doc_id"]) == [(3, 3), (3, 3), (5, 3), (6, 6), (7, 7), (8, 6), (9, 3)]
    kept = [r["row"] for r in simhash.deduplicated(docs).collect()]
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "6", "7", "None"]
    assert all(r["component"] == 1 for r in kept)
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.deduplicated(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    wanted = slow_components([(d["doc_id"], slow_fingerprint(d["text"])) for d in docs])
    got = [tuple(r) for r in op4_simhash_components(spark, FOLDER).collect()]
    assert sorted(got) == sorted((i, f"{f:016x}", c) for i, f, c in wanted)
