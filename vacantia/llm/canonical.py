"""Problem 1: freely typed values mapped to the entries of a reference list, with misses reported."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.fold import folded as fold
from vacantia.runtime import spread, table

#: Names and aliases held by every worker at once; a longer list is met in blocks of this many.
BLOCK = 20_000
#: Two-letter forms that are no mistake for a letter (fixed values); æ is also typed as plain a.
DIGRAPHS = {"ä": ("ae",), "ö": ("oe",), "ü": ("ue",), "å": ("aa",), "ø": ("oe",), "æ": ("a",)}
#: Signs that part a value into segments; a dash only between blanks.
SEGMENTS = regex.compile(r"[,;/|()\[\]{}•·:\n\t]|\s[-–—]+\s|^[-–—]+\s")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
#: Weight of a mistake between signs that look alike or are neighbours on a keyboard; others weigh 1.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_ALIKE = {frozenset(p) for p in ("0o", "1l", "1i", "il", "5s", "uv", "mn")} | {frozenset(r[i : i + 2]) for r in _ROWS for i in range(len(r) - 1)}


def forms(name: str) -> set[str]:
    """Every folded spelling of a name that counts as free of mistakes, without blanks and signs."""
    text = unicodedata.normalize("NFC", name.casefold())
    choices = [[fold(c), *DIGRAPHS.get(c, ())] for c in text]
    return {"".join(_WORD.findall("".join(x))) for x in product(*choices)}


def deletes(text: str, most: int) -> set[str]:
    """`text` with up to `most` letters left out."""
    found, layer = {text}, {text}
    for _ in range(most):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        found |= layer
    return found


def _single(a: str, b: str) -> tuple[int, float] | None:
    """`distance` of two spellings that are equal or one mistake apart, None for all others."""
    if a == b:
        return 0, 0.0
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        if a[at + 1 :] == b[at + 1 :]:
            return 1, 0.5 if frozenset((a[at], b[at])) in _ALIKE else 1.0
        swapped = a[at + 1 : at + 2] == b[at] and b[at + 1 : at + 2] == a[at] and a[at + 2 :] == b[at + 2 :]
        return (1, 0.75) if swapped else None
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return (1, 1.0) if longer[at + 1 :] == shorter[at:] else None


def distance(a: str, b: str, most: int) -> tuple[int, float] | None:
    """(mistakes, weight) between two spellings; None beyond `most`.

    Damerau-Levenshtein distance without restriction: a swap of neighbours is one mistake, also where another letter has
    come between them or gone from there. The weight counts look-alikes half and swaps three quarters.
    """
    if abs(len(a) - len(b)) > most:
        return None
    near = _single(a, b)
    if near or most < 2:
        return near if near and near[0] <= most else None
    n, m = len(a), len(b)
    far = (n + m, float(n + m))
    table = [[far] * (m + 2)] + [[far] + [(j, float(j)) for j in range(m + 1)]] + [[far, (i, float(i))] + [far] * m for i in range(1, n + 1)]
    last_row: dict[str, int] = {}
    for i in range(1, n + 1):
        x, last_column = a[i - 1], 0
        above, row = table[i], table[i + 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            c, w = above[j]
            best = (c, w) if x == y else (c + 1, w + (0.5 if frozenset((x, y)) in _ALIKE else 1.0))
            best = min(best, (above[j + 1][0] + 1, above[j + 1][1] + 1), (row[j][0] + 1, row[j][1] + 1))
            k, l = last_row.get(y, 0), last_column
            if k and l:
                gaps = i - k - 1 + j - l - 1
                c, w = table[k][l]
                best = min(best, (c + gaps + 1, w + gaps + 0.75))
            if x == y:
                last_column = j
            row[j + 1] = best
        if min(row)[0] > most:
            return None  # no later row has less, whatever is swapped
        last_row[x] = i
    return table[n + 1][m + 1] if table[n + 1][m + 1][0] <= most else None


@dataclass(frozen=True)
class Alias:
    """One name of an entry. `group` is the entry it lies in (0: it is such a group itself)."""

    ref: int
    group: int
    name: str
    alone: bool = False  # a short alias that counts without its group


class Dictionary:
    """Symmetric-delete dictionary of aliases: spellings within the allowed mistakes share a shortened form."""

    def __init__(self, aliases: tuple[Alias, ...]) -> None:
        self.short: dict[str, list[Alias]] = defaultdict(list)
        self.keys: dict[str, list[int]] = defaultdict(list)
        self.names: list[tuple[str, int, list[Alias]]] = []  # spelling, mistakes allowed, what it names
        self.widest = 1
        by_form: dict[tuple[str, int], dict[Alias, None]] = defaultdict(dict)
        for a in aliases:
            flat = "".join(_WORD.findall(fold(a.name)))
            if not flat:
                continue
            if len(a.name.strip()) <= 3:
                self.short[fold(a.name.strip())].append(a)
                continue
            self.widest = max(self.widest, len(_WORD.findall(a.name)))
            for f in forms(a.name):
                by_form[f, 1 if len(flat) < 9 else 2][a] = None
        for (form, most), named in by_form.items():
            self.names.append((form, most, list(named)))
            for d in deletes(form, most):
                self.keys[d].append(len(self.names) - 1)
        self.longest = max((len(n[0]) for n in self.names), default=0)
        self.seen: dict[str, list] = {}

    def near(self, text: str) -> list[tuple[int, int, float]]:
        """(name, mistakes, weight) of the names `text` may be."""
        if len(text) > self.longest + 2 or len(text) < 3:
            return []
        if text not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            at = {i for d in deletes(text, 1 if len(text) < 7 else 2) for i in self.keys.get(d, ())}
            found = ((i, distance(text, self.names[i][0], self.names[i][1])) for i in at)
            self.seen[text] = [(i, *d) for i, d in found if d]
        return self.seen[text]

    def candidates(self, value: str) -> list[tuple]:
        """(ref, group, form, mistakes, weight, length, position, whole) of every alias the value may hold.

        `whole` is 0 for a name found anywhere, 1 for a short alias that is a segment, 2 if it also counts alone and is
        the whole value.
        """
        folded = fold(value)
        words = [(m.group(), m.start()) for m in _WORD.finditer(folded)]
        found = []
        for i, (_, start) in enumerate(words):
            text = ""
            for word, _ in words[i : i + self.widest + 1]:
                text += word
                for n, mistakes, weight in self.near(text):
                    form, _, named = self.names[n]
                    found += [(a.ref, a.group, form, mistakes, weight, len(form), start, 0) for a in named]
        segments = [s for s in (_EDGE.sub("", x) for x in SEGMENTS.split(folded)) if s]
        for k, s in enumerate(segments):
            for a in self.short.get(s, ()):
                found.append((a.ref, a.group, s, 0, 0.0, len(s), k, 2 if a.alone and len(segments) == 1 else 1))
        return found


def decide(found: list[tuple], frequency: dict[int, int]) -> int:
    """The entry a value means: the listed member it names, else the listed group, else 0.

    Groups: least mistakes, then the one named last. Members: those of the named group first, then the least weight,
    the longest name, the more frequent entry. A spelling that names several members needs one of their groups beside it.
    """
    groups = [c for c in found if c[1] == 0]
    group = min(groups, key=lambda c: (c[4], -c[6], -c[5], c[0]))[0] if groups else 0
    named = {c[0] for c in groups}
    members = [c for c in found if c[1] and (c[7] == 0 or c[1] in named or (c[7] == 2 and not named))]
    shared = defaultdict(set)
    for c in members:
        shared[c[2]].add(c[0])
    members = [c for c in members if len(shared[c[2]]) == 1 or c[1] in named]
    if not members:
        return group
    return min(members, key=lambda c: (c[1] not in named, c[7] != 0, c[4], -c[5], -frequency.get(c[0], 0), c[0]))[0]


@lru_cache(maxsize=2)
def _dictionary(aliases: tuple[Alias, ...]) -> Dictionary:
    return Dictionary(aliases)


def frequencies(values: DataFrame, text: str, count: str, aliases: DataFrame) -> DataFrame:
    """(ref, n): how many rows are exactly a name of each entry, whatever their case; at most one row an entry."""
    names = aliases.select(F.lower("name").alias("_k"), "ref").distinct()
    return values.withColumn("_k", F.lower(F.trim(text))).join(names, "_k").groupBy("ref").agg(F.sum(count).alias("n"))


def map_values(df: DataFrame, text: str, aliases: DataFrame, block: int = BLOCK) -> DataFrame:
    """`df`'s distinct non-blank values of `text` with `ref`, the entry each means (0: none), and `n`, their rows.

    `aliases` has (ref int, grp int, name string, alone boolean): `grp` is the entry this one lies in, 0 for groups.
    Names over three letters count anywhere with at most two mistakes, one under nine letters; shorter aliases only as
    a segment. Each distinct value is resolved once, so a value that a third of all rows hold is one row of work. The
    list is sent to the workers in blocks of at most `block` names; if it has several, each value's candidates from all
    blocks are brought together by value and decided there. Null and blank values and a null or blank name are left
    out; an empty list gives 0 for every value. Repeated names of an entry count once.
    """
    blank = F.regexp_replace(text, r"[\s\p{Z}]+", "") == ""
    values = df.select(F.col(text).alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("n"))
    values = values.withColumnRenamed("_v", text).where(~blank)
    listed = aliases.select("ref", "grp", "name", "alone").where("name is not null and ref is not null").distinct()
    often = {r.ref: r.n for r in frequencies(values, text, "n", listed.where("length(name) > 3")).toLocalIterator()}
    blocks, held = [], []
    for r in listed.orderBy("ref", "name").toLocalIterator():
        held.append(Alias(r.ref, r.grp or 0, r.name, bool(r.alone)))
        if len(held) == block:
            blocks.append(tuple(held))
            held = []
    blocks += [tuple(held)] if held or not blocks else []
    if len(blocks) == 1:
        return _resolve(values, text, blocks[0], often)
    parts = [_candidates(values, text, b) for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy(text).agg(F.flatten(F.collect_list("found")).alias("found"), F.first("n").alias("n"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs = [decide([tuple(c.values()) for c in found], often) for found in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(refs, pa.int32()), b.column(2)], names=[text, "ref", "n"])

    return merged.mapInArrow(pick, f"`{text}` string, ref int, n long")


def _resolve(values: DataFrame, text: str, aliases: tuple[Alias, ...], often: dict[int, int]) -> DataFrame:
    sent = values.sparkSession.sparkContext.broadcast(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _dictionary(sent.value)
        for b in batches:
            refs = [decide(words.candidates(v), often) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(refs, pa.int32()), b.column(1)], names=[text, "ref", "n"])

    return spread(values.select(text, "n")).mapInArrow(run, f"`{text}` string, ref int, n long")


_FIELDS = ("ref", "grp", "form", "mistakes", "weight", "length", "position", "whole")
_KIND = pa.list_(pa.struct(list(zip(_FIELDS, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())))))


def _candidates(values: DataFrame, text: str, aliases: tuple[Alias, ...]) -> DataFrame:
    sent = values.sparkSession.sparkContext.broadcast(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _dictionary(sent.value)
        for b in batches:
            found = [[dict(zip(_FIELDS, c)) for c in words.candidates(v)] for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, _KIND)], names=[text, "n", "found"])

    shape = "ref:int,grp:int,form:string,mistakes:int,weight:double,length:int,position:int,whole:int"
    return spread(values.select(text, "n")).mapInArrow(run, f"`{text}` string, n long, found array<struct<{shape}>>")


def place_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The two reference lists as one alias table: countries are the groups, cities their members."""
    geo = table(spark, folder, "geo_reference")
    city = table(spark, folder, "city_reference").alias("c").join(geo.select(F.col("name").alias("country"), F.col("ref_id").alias("grp")), "country")
    alone = F.coalesce(F.array_contains("standalone_aliases", F.col("a")), F.lit(False))
    countries = geo.select(F.col("ref_id").alias("ref"), F.lit(0).alias("grp"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array()))).alias("name"), F.lit(True).alias("alone"))
    cities = city.select(F.col("ref_id").alias("ref"), "grp", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array()))).alias("a"), "standalone_aliases")
    return countries.unionByName(cities.select("ref", "grp", F.col("a").alias("name"), alone.alias("alone")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(entry_id, ref_id): the city or country each typed place means, 0 for none."""
    places = table(spark, folder, "places")
    mapped = map_values(places, "raw", place_aliases(spark, folder))
    return places.select("entry_id", "raw").join(mapped, "raw").select("entry_id", F.col("ref").alias("ref_id"))


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """(raw, entries): the values that mean no entry, with their rows."""
    mapped = map_values(table(spark, folder, "places"), "raw", place_aliases(spark, folder))
    return mapped.where("ref = 0").select("raw", F.col("n").alias("entries"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched}
ORACLES: dict[str, str] = {}
