import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.packing import LENGTH, hilbert_keys, packed
from lodestar.llm.queries import WORD_BPE, op5_hilbert_packing
from lodestar.llm.tokens import TextIds, text_ids

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def ids(reader, *texts):
    return [own.tolist() for own in reader.of(pa.array(texts, pa.string()))]


ALPHABET = st.one_of(
    st.characters(exclude_categories=["Cs"]), st.characters(max_codepoint=0x260), st.sampled_from(list(" \n\t\x0b\x1c\x85\u3000'sdtlrevm.,_²ÁéİıΣ9<|>"))
)


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=30), st.sampled_from(["", " ", "<|endoftext|>", "'s", "\u0301"]))
def test_ids_are_the_text_ids(text, between):
    ready = text_ids(WORD_BPE)
    for t in (text + between + text, "it's " + text):
        wanted = ready.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids(ready, t)[0] == wanted


def test_every_plain_character():
    ready = text_ids(WORD_BPE)
    for code in range(0x260):
        for t in (chr(code), f"a{chr(code)}b", f"1{chr(code)}'", f" {chr(code)} "):
            assert ids(ready, t)[0] == ready.tokenizer.encode(t, add_special_tokens=False).ids, code


def test_another_kind_of_tokenizer():
    other = TextIds(WORD_BPE.replace("word_bpe_49k", "byte_bpe_50k"))
    assert not other.by_word
    assert ids(other, "some Text", None) == [other.tokenizer.encode("some Text").ids, []]


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["a b c d e f g h", "the cat", "x" * 200, "a b the é"] * 3
    wanted = ids(TextIds(WORD_BPE), *texts)
    monkeypatch.setattr("lodestar.llm.tokens.REMEMBERED", 3)
    small = TextIds(WORD_BPE)
    assert [ids(small, t)[0] for t in texts] == wanted == ids(small, *texts)
    assert ids(small) == [] and ids(small, None, "", " ", "a", None) == [[], [], [], wanted[0][:1], []]


@pytest.mark.parametrize("dimensions, depth", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(dimensions, depth):
    cells = np.array(list(product(range(1 << depth), repeat=dimensions)))
    order = np.argsort(keys := hilbert_keys(cells, depth))
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def check(pieces, texts, tokenizer):
    """Every id in exactly one piece, sequences gapless, lengths full or powers of two."""
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts}
    covered, sequences = {d: [] for d in ids}, {}
    for p in pieces:
        own = ids[p["doc_id"]]
        part = own[p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and len(own) == p["doc_tokens"]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
        covered[p["doc_id"]].append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for d, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= LENGTH and at & (at - 1) == 0


def test_small_and_odd_texts(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "one"), (4, "long words " * 20_000), (None, "no id"), (5, "<|endoftext|> ok"), (6, "x" * 5000)]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, ids int")
    check(packed(docs, WORD_BPE).collect(), texts, tokenizer)
    assert packed(docs.limit(0), WORD_BPE).count() == 0
    twice = packed(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), WORD_BPE).collect()
    assert sum(p["length"] for p in twice) == 6


def test_long_documents_spread(spark, tokenizer, monkeypatch):
    """A document of many sequences spans ranges, goes on within a sequence as one piece, and so do equal ids."""
    monkeypatch.setattr("lodestar.llm.packing.RANGE_BYTES", 1 << 15)
    rng = np.random.default_rng(2)
    long = " ".join(map(str, rng.integers(0, 10**6, 20_000)))
    docs = [(1, long), (2, "short"), (3, long + " end"), (4, None)]
    pieces = packed(spark.createDataFrame(docs, "doc_id long, text string"), WORD_BPE).collect()
    check(pieces, docs, tokenizer)
    assert len({p["sequence_id"] >> 40 for p in pieces if p["doc_id"] == 1}) > 1
    within = {}
    for p in pieces:
        within.setdefault((p["sequence_id"], p["doc_id"]), []).append(p)
    assert all(len(own) == 1 for own in within.values())
    twice = spark.createDataFrame([(1, long), (1, long), (1, long[::-1])], "doc_id long, text string")
    got = packed(twice, WORD_BPE).collect()
    total = 2 * len(tokenizer.encode(long, add_special_tokens=False).ids) + len(tokenizer.encode(long[::-1], add_special_tokens=False).ids) + 3
    assert sum(p["length"] for p in got) == total
    wholes = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in (long, long[::-1])]
    for p in got:
        spans = [own[p["start"] : p["start"] + p["length"]] for own in wholes if len(own) == p["doc_tokens"]]
        assert p["ids_crc32"] in {zlib.crc32(np.array(own, "<u4").tobytes()) for own in spans}


@pytest.mark.parametrize("size", [1 << 12, 1 << 14])
def test_ranges_follow_the_bytes(spark, tokenizer, monkeypatch, size):
    """More text makes more ranges, not larger ones, whatever the session's number of shuffle partitions."""
    monkeypatch.setattr("lodestar.llm.packing.RANGE_BYTES", size)
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(map(str, rng.integers(0, 10**6, 200)))) for i in range(100)]
    pieces = packed(spark.createDataFrame(texts, "doc_id long, text string"), WORD_BPE).collect()
    check(pieces, texts, tokenizer)
    ranges = len({p["sequence_id"] >> 40 for p in pieces})
    assert sum(p["length"] for p in pieces) * 2 / size / 2 < ranges < sum(p["length"] for p in pieces) * 2 / size * 2 + 2


def test_query(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    check(op5_hilbert_packing(spark, FOLDER).collect(), [(d["doc_id"], d["text"]) for d in docs], tokenizer)
