"""One query per text operator, each over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import chat, classifier, decontaminate, embeddings, html, langid, licenses, packing, phrases, quality, repair, simhash, urls
from lodestar.session import written


def _tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers, which lie in a folder of their own on every machine."""
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin) if found else "/opt/tokenizers", name)


WORD_BPE = _tokenizer_file("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per document and whether the base rules and the distance from the language references keep it."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality.judged(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, "base_failed", "kept")


def op2_hierarchical_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document from its own evidence and from what its source, and its source's texts in one
    language, are like."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = classifier.classified(docs, labels, host="source", path="lang", keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "own", "host_mean", "path_mean", "posterior", "kept")


def op3_page_differencing(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html.main_text(table(spark, folder, "pages"), keep=["page_id", "url"])
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


def op4_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    marked = simhash.fingerprinted(table(spark, folder, "documents").select("doc_id", "text"))
    marked = written(marked.select(F.col("row.doc_id").alias("doc_id"), "fingerprint"), "fingerprints")
    classes = simhash.linked_classes(marked.withColumnRenamed("doc_id", "id"))
    return marked.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op5_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, neighbours on the curve together."""
    return packing.packed(table(spark, folder, "documents"), WORD_BPE)


URL_RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]


def op7_url_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    found = urls.judged(table(spark, folder, "pages"), URL_RULES)
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_chat_template(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, and what is read back from the formatted text and from the loss flags.

    A further conversation, -7, says the template's own control strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = chat.formatted(rows.unionByName(planted)).withColumns(
        {"turns": chat.read_back(F.col("formatted")), "learnt": chat.learnt_text(F.col("segments"))}
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op8_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from two thirds of them; the other third is held out."""
    docs = table(spark, folder, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    samples = langid.sample(docs.filter(remainder != 1))
    found = langid.identified(docs, samples, keep=["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses that documents declare: how much of the notice is there, and at which word it begins."""
    found = licenses.scanned(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "license", "containment", "word")


def op10_template_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents: how many of the item's words, and whether with other parameters."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    rows, found = decontaminate.found_items(docs, items, keep=["doc_id"])
    return found.join(rows, "at").select(
        F.col("row.doc_id").alias("doc_id"), "item_id", F.col("covered").cast("long").alias("covered"), F.col("words").cast("long").alias("words"), "changed"
    )


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 phrases of each language that stand out most from what their parts would make by chance."""
    return phrases.collocations(table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of damaged conversations, the cheapest edits that repair them, and a digest of what these give."""
    rows = repair.damaged(table(spark, folder, "conversations"))
    done = repair.repaired(rows, present=F.col("present"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return done.select("conv_id", *counts, "audit", F.sha2(said, 256).alias("repaired_sha256"))


def op13_small_worlds(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector, by cosines of 0.9 and more."""
    found = embeddings.linked(table(spark, folder, "embeddings"), keep=["vec_id"])
    return found.select(F.col("row.vec_id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_hierarchical_bayes": op2_hierarchical_bayes,
    "op3_page_differencing": op3_page_differencing,
    "op4_simhash_components": op4_simhash_components,
    "op5_hilbert_packing": op5_hilbert_packing,
    "op6_chat_template": op6_chat_template,
    "op7_url_vocabulary": op7_url_vocabulary,
    "op8_cross_parsing": op8_cross_parsing,
    "op9_license_templates": op9_license_templates,
    "op10_template_windows": op10_template_windows,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_small_worlds": op13_small_worlds,
}
