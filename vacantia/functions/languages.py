"""The language of a text by the frequent words it holds; no model, all in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Frequent words of all languages together that a plan may hold.
MOST_WORDS = 20_000


def _among(words: list[str]):
    return lambda x: x.isin(*words)


def detect_language(
    texts: DataFrame, key: str, text: str, profiles: DataFrame, least_words: int = 20, least_hits: int = 5, least_share: float = 0.3,
) -> DataFrame:
    """(key, code, hits, confidence): the language whose frequent words a text holds most often.

    The code is empty where a text has too few words, too few hits, a tie, or less than the least share of all hits.
    `profiles` has (lang, word) and is of a few hundred rows by its nature; it becomes literals of the plan. More than
    MOST_WORDS different ones are refused.
    """
    words: dict[str, set[str]] = {}
    rows = profiles.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words of languages")
    for r in rows:
        words.setdefault(r.lang, set()).add(r.word)
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    rows = texts.select(F.col(key), found.alias("w"))
    counts = [
        F.struct((-F.size(F.filter("w", _among(sorted(ws))))).alias("hits"), F.lit(lang).alias("lang"))
        for lang, ws in sorted(words.items())
    ]
    none = F.array().cast("array<struct<hits:int,lang:string>>")
    ranked = rows.select(key, F.size("w").alias("n"), F.array_sort(F.array(*counts) if counts else none).alias("c"))
    total = F.aggregate("c", F.lit(0), lambda a, x: a - x["hits"])
    best, second = -F.get("c", F.lit(0))["hits"], F.coalesce(-F.get("c", F.lit(1))["hits"], F.lit(0))
    share = F.when(total > 0, best / total).otherwise(0.0)
    enough = F.col("n") >= least_words
    sure = enough & (best >= least_hits) & (best != second) & (share >= least_share)
    return ranked.select(
        key, F.when(sure, F.get("c", F.lit(0))["lang"]).otherwise("").alias("code"),
        F.when(enough, best).otherwise(0).cast("long").alias("hits"), F.when(enough, F.round(share, 4)).otherwise(0.0).alias("confidence"))
