"""URL filters: host and path rules, then a weighted vocabulary found by one Aho-Corasick pass.

A term counts where neither neighbour is a letter or digit. One strict term, or several distinct soft terms, block
the url. Rules go first: the longest that fits decides, and the vocabulary decides for urls that no rule fits. The
work is row by row, so nothing is shuffled and no host can become hot.

Defined results: a null url has an empty host and path, fits no rule, has no terms and is allowed, as is an empty
one; a url without ``://`` has an empty host and path but is searched for terms; repeated rows are judged one by
one; other columns pass through in ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import with_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Terms of which one is enough, and terms of which several distinct ones are needed.
STRICT_TERMS = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = (
    "bet", "bets", "bonus", "cash", "cheap", "coupon", "crack", "credit", "dating", "deal", "discount", "download",
    "farm", "free", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "payday", "pharmacy", "pill", "pills",
    "poker", "replica", "sale", "sex", "torrent", "win", "winner",
)


@dataclass(frozen=True)
class Rule:
    """Fits a host, all its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in strict))
    found.make_automaton()
    return found


def _terms(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms with a boundary on both sides."""
    hits = set()
    for last, (term, strict) in automaton.iter(url):
        first = last - len(term)
        if (first < 0 or not url[first].isalnum()) and (last + 1 == len(url) or not url[last + 1].isalnum()):
            hits.add((term, strict))
    return sum(strict for _, strict in hits), sum(not strict for _, strict in hits)


def term_counts(url: Column, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS) -> Column:
    """Struct of the distinct ``strict`` and ``soft`` terms of a lower-cased url."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict int, soft int")
    def counts(urls: pd.Series) -> pd.DataFrame:
        automaton = _automaton(strict, soft)
        return pd.DataFrame([_terms(u or "", automaton) for u in urls], columns=["strict", "soft"], dtype="int32")

    return counts(url)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z lower-cased, and path; both empty without ``://``."""
    # (?s): a url may hold line breaks.
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _best(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of its name and verdict."""
    best = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(best)
    return best


def judged(
    pages: DataFrame, rules: Sequence[Rule] = (), url: str = "url", soft_needed: int = 2,
    strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS,
) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule``, the numbers of distinct terms and the ``verdict``."""
    df = with_row(pages, url=F.coalesce(F.col(url), F.lit("")))
    host, path = host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path, "terms": term_counts(F.translate("url", UPPER, LOWER), strict, soft)})
    df = df.withColumn("best", _best(rules, F.col("host"), F.col("path")))
    bad = (F.col("terms.strict") >= 1) | (F.col("terms.soft") >= soft_needed)
    return df.select(
        "row", "host", "path", F.col("best.name").alias("rule"),
        F.col("terms.strict").alias("strict_terms"), F.col("terms.soft").alias("soft_terms"),
        F.coalesce("best.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
    )
