"""Quality rules: counts per document, and its distance from language references.

Every document gets the histogram of its character classes and of common words. The references are the pooled
histograms of all documents of one labelled language that pass the base rules and look like prose. The words of four
languages are listed; any other labelled language is known by its own most frequent words. A document is measured by what it says,
never by its label: it is as far from the references as from the nearest one, by Jensen-Shannon distance (base 2, 0 to
1). Where its common words are those of a reference, its characters may differ from prose a little; where they are those of none, it is
junk or in a language that nobody has labelled, and only characters very much like prose are kept. The guards leave short
documents unjudged, since their histograms are noise, and a text in letters without case is only compared with references
in such letters. All of it is column expressions over one narrow pass; only the references are aggregated, a row per language.

Defined results: a null or empty text has no words and fails the base rules; a null language takes no part in
the references; without any reference (or any in letters of its kind) the base rules alone decide; repeated rows are
judged one by one; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import with_row, words_of
from lodestar.session import written

# Frequent function words per language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "was", "on", "are", "as", "with", "be"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}

# Character classes, each as the pattern of what is not in it. What no class takes is the last bin. Digits go with
# small letters: an identifier or a phone number in a short text is no sign of junk.
CLASSES = {
    "body": r"[^\p{Ll}\p{Nd}]+",
    "upper": r"[^\p{Lu}]+",
    "space": r"[^ \t-\r]+",
    "stop": r"[^.,;:!?'\"()-]+",
    "symbol": r"[^#*$%&|<>]+",
    "caseless": r"[^\p{Lo}\p{Lm}\p{M}]+",
}

#: How many of its own words stand for a language without a list.
OWN_WORDS = 16


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. Distances run from 0 (equal histograms) to 1 (nothing in common)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.15
    max_strange_class_distance: float = 0.10
    min_class_chars: int = 200
    max_word_distance: float = 0.31
    min_distance_words: int = 80
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _count(text: Column, others: str) -> Column:
    """Characters left after removing the others."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _window_keys(words: Column) -> Column:
    """One key per window of three words."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    keys = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, keys).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, rules: QualityRules, common_words: dict[str, list[str]], text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``row`` and the counts of each document. Windows of words are compared by 64-bit hash within the document."""
    vocabulary = _vocabulary(common_words)
    df = with_row(docs, keep, text=F.coalesce(F.col(text), F.lit("")), lang=F.col(lang))
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("keys", _window_keys(F.col("words")))
    spoken = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    df = df.select(
        "row",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[_count(F.col("text"), others).alias(f"n_{name}") for name, others in CLASSES.items()],
        F.length("text").cast("long").alias("n_chars"),
        spoken.alias("lines"),
        F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(vocabulary)), "  "), F.lit(" ")).alias("common"),
        # Sorted with their places only where a key comes twice.
        F.when(F.size(F.array_distinct("keys")) < F.size("keys"),
               F.sort_array(F.transform("keys", lambda key, at: F.struct(key.alias("key"), at.alias("at")))))
        .otherwise(F.array().cast("array<struct<key:bigint,at:int>>")).alias("windows"),
    )

    def twice(window: Column, k: Column) -> Column:
        before, after = F.get("windows", k - 1)["key"], F.get("windows", k + 1)["key"]
        return F.coalesce(window["key"] == before, F.lit(False)) | F.coalesce(window["key"] == after, F.lit(False))

    starts = F.sort_array(F.transform(F.filter("windows", twice), lambda window: window["at"]))
    df = df.withColumn("starts", starts)
    covered = F.transform("starts", lambda at, k: F.coalesce(F.least(F.lit(3), at - F.get("starts", k - 1)), F.lit(3)))
    found = lambda w: (F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
    return df.select(
        "row", "lang", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda total, n: total + n).alias("n_repeat_words"),
        "n_chars",
        F.array(*[F.col(f"n_{name}") for name in CLASSES], F.col("n_chars") - sum((F.col(f"n_{name}") for name in CLASSES), F.lit(0))).alias("classes"),
        F.array(*[found(w).cast("long") for w in vocabulary]).alias("counts"),
    ).withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def _class(name: str) -> Column:
    return F.col("classes")[list(CLASSES).index(name)]


def _prose() -> Column:
    """Hardly a symbol, few capitals."""
    return (F.col("n_symbols") * 1000 <= F.col("n_chars")) & (_class("upper") * 5 <= _class("body") + _class("caseless"))


def _vocabulary(common_words: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in common_words.values() for w in words})


def frequent_words(docs: DataFrame, rules: QualityRules, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The most frequent words of each labelled language that the rules do not list, over its documents that pass the base
    rules and look like prose. So many rows a language come to the driver."""
    others = docs.filter(F.col(lang).isNotNull() & ~F.col(lang).isin(sorted(rules.common_words)))
    if others.select(lang).isEmpty():
        return {}
    fit = others.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Written first: a filter would pull the counting of repeats into itself, many times over.
    clean = written(measured(fit, rules, rules.common_words, keep=["text"]), "others").filter(~F.col("base_failed") & _prose())
    words = clean.select("lang", F.explode(words_of(F.col("row.text"))).alias("word")).filter(F.col("word").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    most = words.groupBy("lang", "word").count().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= OWN_WORDS)
    found: dict[str, list[str]] = {}
    for row in most.orderBy("lang", "n").collect():
        found.setdefault(row["lang"], []).append(row["word"])
    return found


def references(counted: DataFrame, common_words: dict[str, list[str]]) -> dict[str, tuple[list[float], list[float]]]:
    """Per language the shares of character classes and of its common words, over all its documents that pass the
    base rules and look like prose (hardly a symbol, few capitals), so that junk does not shape its own measure. At
    most one row per language comes to the driver."""
    vocabulary = _vocabulary(common_words)
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.col("counts")[i]).alias(f"w{i}") for i in range(len(vocabulary))]
    known = counted.filter(~F.col("base_failed") & _prose() & F.col("lang").isin(sorted(common_words)))
    found = {}
    for row in known.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect():
        classes = [row[f"c{i}"] for i in range(len(CLASSES) + 1)]
        own = [row[f"w{vocabulary.index(w)}"] for w in common_words[row["lang"]]]
        bins = [*own, row["n"] - sum(own)]
        found[row["lang"]] = ([c / sum(classes) for c in classes], [b / row["n"] for b in bins])
    return found


def _distance(bins: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counted bins from a reference, base 2."""

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    shares = F.transform(bins, lambda n: n / total)
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), lambda p, q: term(p, q) + term(q, p))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def judged(docs: DataFrame, rules: QualityRules | None = None, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``row``, the counts, ``base_failed``, the distances from the nearest reference (null where a guard leaves
    them out or there is no reference) and ``kept``."""
    rules = rules or QualityRules()
    common_words = rules.common_words | frequent_words(docs, rules, text, lang)
    vocabulary = _vocabulary(common_words)
    counted = written(measured(docs, rules, common_words, text, lang, keep), "quality")
    caseless = _class("caseless") > _class("body") + _class("upper")
    by_class, by_word = [F.lit(None).cast("double")], [F.lit(None).cast("double")]
    body, upper, letters = (list(CLASSES).index(name) for name in ("body", "upper", "caseless"))
    for language, (classes, shares) in references(counted, common_words).items():
        alike = caseless == F.lit(classes[letters] > classes[body] + classes[upper])
        by_class.append(F.when(alike, _distance(F.col("classes"), F.col("n_chars"), classes)))
        own = [F.col("counts")[vocabulary.index(w)] for w in common_words[language]]
        bins = F.array(*own, F.col("n_words") - sum(own, F.lit(0)))
        by_word.append(F.when(alike, _distance(bins, F.col("n_words"), shares)))
    nearest = {
        "class_distance": F.when(F.col("n_chars") >= rules.min_class_chars, F.array_min(F.array(*by_class))),
        "word_distance": F.when(F.col("n_words") >= rules.min_distance_words, F.array_min(F.array(*by_word))),
    }
    strange = F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance
    limit = F.when(strange, rules.max_strange_class_distance).otherwise(rules.max_class_distance)
    far = F.coalesce("class_distance", F.lit(0.0)) > limit
    return counted.withColumns(nearest).withColumn("kept", ~F.col("base_failed") & ~far).drop("lang", "classes", "counts", "n_chars")
