"""Places read from free text by exact aliases: an equi-join of word runs with the alias list, so any list size works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.fold import fold

#: Words that name no place.
ANYWHERE = ("remote", "anywhere", "ovunque", "hybrid", "onsite", "on", "site", "office", "in", "flexible", "zdalnie", "worldwide", "global", "eu", "emea", "europe", "job", "jobs")
_SEGMENT = r"[,;|/()\[\]]| - | · "


def alias_table(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(alias, words, short, alone, country, city) from lists with ref_id, name, aliases (and country, standalone_aliases)."""
    both = lambda: F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")
    g = groups.select(F.col("ref_id").alias("country"), F.lit(None).cast("int").alias("city"), both(), F.lit(False).alias("alone"))
    owner = groups.select(F.col("name").alias("_g"), F.col("ref_id").alias("_c"))
    m = members.join(owner, F.col("country") == F.col("_g")).select(F.col("_c").alias("country"), F.col("ref_id").alias("city"), both(), "standalone_aliases")
    m = m.select("country", "city", "alias", F.coalesce(F.array_contains("standalone_aliases", F.col("alias")), F.lit(False)).alias("alone"))
    words = F.array_join(F.filter(F.split(fold("alias"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    return g.unionByName(m).select("country", "city", "alone", (F.length("alias") <= 3).alias("short"), words.alias("words")).where("words <> ''").distinct()


def resolve(raws: DataFrame, raw: str, aliases: DataFrame) -> DataFrame:
    """(raw, country, city, to_map) of each distinct value: the ids the aliases give, null where they give none.

    A whole value that is an alias which counts alone wins. Else the country is the one named last, by an alias of four
    letters or more anywhere or by a short one as a whole segment; the city is that of the longest alias, a short one
    only as a segment and beside a country, and never a city of another country. Runs of words up to the longest alias are tried. `to_map` says that a city seems to be
    named that the list lacks. Null values are left out; each distinct value is read once.
    """
    longest = F.coalesce(aliases.agg(F.max(F.size(F.split("words", " ")))).scalar(), F.lit(1))
    values = raws.select(F.col(raw).alias("raw")).where("raw is not null").distinct().withColumn("f", fold("raw"))
    word = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = values.select("raw", longest.alias("longest"), word("f").alias("w"), F.filter(F.transform(F.split("f", _SEGMENT), lambda s: F.array_join(word(s), " ")), lambda s: s != "").alias("s"))
    runs = F.flatten(F.transform("w", lambda x, i: F.transform(
        F.sequence(F.lit(1), F.least(F.col("longest"), F.size("w") - i)),
        lambda n: F.struct(F.array_join(F.slice("w", i + 1, n), " ").alias("words"), i.alias("at"), F.lit(False).alias("segment")))))
    parts = F.transform("s", lambda x: F.struct(x.alias("words"), (F.size("w") - F.array_position(F.reverse("w"), x)).cast("int").alias("at"), F.lit(True).alias("segment")))
    said = cut.select("raw", F.explode(F.concat(runs, parts)).alias("x")).select("raw", "x.*")
    hits = said.join(aliases, "words").where(F.col("segment") == F.col("short"))
    whole = said.where("segment").groupBy("raw").agg(F.count("*").alias("n"))
    hits = hits.join(whole, "raw").withColumn("sole", F.col("alone") & F.col("segment") & (F.col("n") == 1))
    country = F.max(F.when(F.col("city").isNull(), F.struct("at", "country")))["country"]
    sole = F.max(F.when(F.col("sole"), F.struct("country", "city")))
    cities = F.collect_set(F.when(F.col("city").isNotNull(), F.struct(F.length("words").alias("size"), "country", "city", "segment")))
    named = F.collect_set(F.when(F.col("city").isNull(), F.col("words")))
    found = hits.groupBy("raw").agg(sole.alias("sole"), country.alias("named"), cities.alias("cities"), named.alias("country_words"))
    fits = F.filter("cities", lambda c: (F.col("named").isNull() & ~c["segment"]) | (c["country"] == F.col("named")))
    best = found.select("raw", "sole", "named", "country_words", F.array_max(fits).alias("best"))
    joined = cut.join(best, "raw", "left")
    first = F.split(F.coalesce(F.get("s", F.lit(0)), F.lit("")), " ")
    used = F.flatten(F.transform(F.coalesce("country_words", F.array().cast("array<string>")), lambda x: F.split(x, " ")))
    left = F.filter(first, lambda x: (x != "") & ~x.isin(*ANYWHERE) & ~F.array_contains(used, x))
    city = F.coalesce(F.col("sole.city"), F.col("best.city"))
    return joined.select("raw", F.coalesce(F.col("sole.country"), "named", F.col("best.country")).alias("country"), city.alias("city"), (city.isNull() & (F.size(left) > 0)).alias("to_map"))
