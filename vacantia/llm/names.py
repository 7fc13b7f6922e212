"""Problem 3: spellings of names that denote one organisation, linked and clustered."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.canonical import distance, fold
from vacantia.operators.components import connected_components
from vacantia.runtime import materialize, spread, table

#: Words that say what an organisation is, where it sits or what it belongs to, not which one it is.
LEGAL = frozenset("""
srl srls spa snc sas sapa scarl gmbh mbh ltd limited plc inc incorporated corp corporation llc llp company kgaa ohg aktiengesellschaft
gesellschaft beschrankter haftung mit societa societe azioni per responsabilita limitata sarl sasu eurl anonyme publ aktiebolag bvba nvsa
besloten vennootschap naamloze spolka ograniczona odpowiedzialnoscia zoo sociedad anonima limitada lda
""".split())
TRADE = frozenset("""
studio studios tecnico technical tecnica research ricerche ricerca recherche forschung international internazionale internationale
water acque acqua wasser eau engineering engineers ingegneria ingenieure ingenieria logistics logistica logistik logistique
technologies technology tecnologie tecnologia technologie technik solutions solution soluzioni losungen soluciones laboratories laboratory
laboratori laboratorio laboratoires associates associati associes partners systems system sistemi systeme systemes sistemas services
service servizi dienste servicios manufacturing manifattura fertigung consulting consultants consulenza beratung conseil robotics
robotica robotik robotique energy energia energie staffing trading commerce industries industrie industria
""".split())
BRANCH = frozenset("""
group gruppe gruppo groupe holding holdings europe europa headquarters sede centrale italia italy deutschland germany france francia
espana spain polska poland nederland portugal brothers fratelli figli gli sons gebruder and the und von der
""".split())
#: Forms under which a given name is typed.
NICKNAMES = {
    "giuseppe": "beppe peppe peppino pino bepi", "francesco": "checco franco cecco", "antonio": "tonio toni tony nino tonino", "giovanni": "gianni nanni vanni",
    "luigi": "gigi gino", "francisco": "paco pancho curro frasco", "jose": "pepe", "maria": "chema josema marisa", "johannes": "hannes hans jan johann",
    "heinrich": "heinz heiner", "friedrich": "fritz", "cornelis": "kees cees", "william": "bill will willy billy liam", "robert": "bob rob bobby bert",
    "richard": "dick rick", "alexander": "alex sandy sascha xander", "elisabeth": "betty lisbeth elsbeth beth lisa", "katherine": "kathy kate kitty kat",
    "margarete": "gretel grete greta gretchen margit", "stanislaw": "staszek stach stas staszko", "jean": "jeannot", "pierre": "pierrot",
}
GIVEN = {form: name for name, forms in NICKNAMES.items() for form in (name, *forms.split())}
GENERIC = LEGAL | TRADE | BRANCH
#: Least Jaro-Winkler similarity of any two words taken for one, and of all words of a name in the mean.
WORD_LIKE, NAME_LIKE = 0.76, 0.88
#: Consonants heard as one (fixed values); vowels, h and y leave no trace.
_SOUNDS = str.maketrans({**dict.fromkeys("bp", "B"), **dict.fromkeys("dt", "D"), **dict.fromkeys("gkcqj", "K"), **dict.fromkeys("fvw", "F"), **dict.fromkeys("szx", "S"), **dict.fromkeys("mn", "N"), "l": "L", "r": "R", **dict.fromkeys("aeiouhy", None)})
_DOTTED = regex.compile(r"\b((?:\p{L}\.){2,}\p{L}?)")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: A shared word of more distinct names than this has its block divided by what stands beside it, without losing a pair.
CROWDED = 200


@lru_cache(1)
def _near_generic() -> dict[str, list[str]]:
    """Generic words of six letters or more by all that is left of them without one letter."""
    found: dict[str, list[str]] = {}
    for w in sorted(GENERIC):
        for x in _shortened(w) if len(w) > 5 else ():
            found.setdefault(x, []).append(w)
    return found


def _mistyped(word: str) -> str | None:
    """The generic word this one is but for one mistake."""
    near = {w for x in _shortened(word) for w in _near_generic().get(x, ())} if len(word) > 4 else set()
    return min((w for w in near if distance(word, w, 1)), default=None)


def _shortens(short: str, whole: str) -> bool:
    """Whether a word is short for another: its beginning, with a plural s or not, or up to seven of its letters in order with one vowel at most."""
    if short[0] != whole[0] or len(short) > len(whole) - 2:
        return False
    if whole.startswith(short) or (short[-1] == "s" and whole.startswith(short[:-1])):
        return True
    letters = iter(whole)
    return len(short) < 8 and sum(c in "aeiou" for c in short) < 2 and all(c in letters for c in short)


@lru_cache(1 << 16)
def _kind(word: str) -> str:
    """Empty for a distinctive word, the given names one may stand for joined by +, `-` for a word that doesn't tell organisations apart."""
    if word in GIVEN:
        return GIVEN[word]
    if len(word) < 3 or word in GENERIC:
        return "-"
    if word.isalpha():
        if len(word) < 5 and (names := [n for n in NICKNAMES if _shortens(word, n)]):
            return "+".join(names)
        if any(_shortens(word, w) for w in TRADE | {"headquarters", "brothers"}):
            return "-"
    return "-" if len(word) < 6 and not any(c in "aeiouy0123456789" for c in word) else ""


def distinctive(name: str | None) -> list[str]:
    """The words that tell an organisation from others, folded and sorted.

    Legal forms, trade words and what they are shortened to, additions, given names and words of one or two letters go.
    A name of nothing else, or of nothing else but a generic word with one mistake, keeps all its words, the mistake put
    right, and is marked so that it only meets names of the very same words; a null or empty one gives none.
    """
    return _parts(name)[0]


def _parts(name: str | None) -> tuple[list[str], list[str]]:
    """(distinctive words, given names under their first form) of a name."""
    text = _DOTTED.sub(lambda m: m.group().replace(".", ""), fold(name or "").replace("'", "").replace("’", ""))
    words = _WORD.findall(text)
    kinds = [(w, _kind(w)) for w in words]
    own = [w for w, k in kinds if not k]
    given = sorted({n for _, k in kinds if k and k != "-" for n in k.split("+")})
    if own and (given or (fixed := {w: _mistyped(w) for w in own}) and not all(fixed.values())):
        return sorted(set(own)), given
    if own:
        words = [fixed.get(w, w) for w in words]
    return (["=" + " ".join(sorted(words))] if words else []), []


def split(key: str) -> tuple[list[str], set[str]]:
    """(distinctive words, given names) of the key of a name."""
    words, _, given = key.partition(" ~")
    return [words] if words[0] == "=" else words.split(" "), set(given.split("+")) if given else set()


def code(word: str) -> str:
    """Phonetic code: the classes of the consonants in order."""
    return word.translate(_SOUNDS) or word


def _shortened(text: str) -> set[str]:
    """A text and all it becomes when one letter is left out."""
    return {text} | {text[:i] + text[i + 1 :] for i in range(len(text))}


def beside(words: list[str], shared: str) -> set[str]:
    """What the crowded block of a shared word is divided by; any two names in it that `same` links have some in common.

    The other words with up to two letters left out: `same` links them by a word beside the shared one, within the
    mistakes that `word_distance` allows. It may also take the shared word itself for one of the others, but then both
    names have a word that is nearly the shared one; those meet under a star.
    """
    others = [w for w in words if w != shared]
    found = {x for w in others for y in _shortened(w) for x in (_shortened(y) if len(w) > 3 else (y,))}
    return found | {"*"} if any(word_distance(w, shared) is not None for w in others) else found


def blocks(words: list[str]) -> list[str]:
    """The keys under which a name is compared; the first letter is the kind.

    c: the phonetic codes of two words in order, each whole or with one consonant left out, so that one wrong consonant
    in each doesn't hide a name. w: a word as it is, so that any mistakes in the others don't. d: a word with one letter
    left out, where a lone word meets the words of longer names. j: the code's beginning and end of all words run
    together, where a long lone word meets names it may be the words of.
    """
    if words[0][0] == "=":
        return []
    codes = [code(w) for w in words]
    keys = {f"d{x}" for w in words for x in _shortened(w)}
    if len(words) == 1:
        if len(words[0]) >= 10:
            keys |= {f"j{codes[0][:5]}", f"j-{codes[0][-5:]}"}
        return sorted(keys)
    for i, w in enumerate(words):
        keys.add(f"w{w}")
        keys |= {f"c{min(x, y)}-{max(x, y)}" for j in range(i) for x in _shortened(codes[i]) for y in _shortened(codes[j])}
    for run in (code("".join(words)), code("".join(words[::-1]))):
        keys |= {f"j{run[:5]}", f"j-{run[-5:]}"}
    return sorted(keys)


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two words, raised for a common beginning."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + start * 0.1 * (1 - jaro)


def word_distance(a: str, b: str) -> int | None:
    """Mistakes between two spellings of a word, None if they aren't taken for the same."""
    if a == b:
        return 0
    d = distance(a, b, 1 if max(len(a), len(b)) < 6 else 2)
    return d[0] if d and jaro_winkler(a, b) >= WORD_LIKE else None


def same(a: list[str], b: list[str]) -> bool:
    """Whether every word of the shorter name is a word of the longer; two words at least.

    Words are paired by Jaro-Winkler similarity, the likest first, and must be WORD_LIKE each and NAME_LIKE in the mean;
    an exact count of mistakes follows, which bears two a word (one under six letters) and three in all, so that blocks
    can be sure to hold every pair. Words run together count: a lone word is also compared with the two words of the
    other name without the blank.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        flat = {"".join(b), "".join(b[::-1])} if len(b) == 2 else set()
        return any(jaro_winkler(a[0], f) >= NAME_LIKE and distance(a[0], f, 2) is not None for f in flat)
    likeness = sorted(((-jaro_winkler(w, x), i, j) for i, w in enumerate(a) for j, x in enumerate(b)))
    pairs: dict[int, tuple[int, float]] = {}
    taken: set[int] = set()
    for s, i, j in likeness:
        if i not in pairs and j not in taken:
            pairs[i] = (j, -s)
            taken.add(j)
    least, mean = min(s for _, s in pairs.values()), sum(s for _, s in pairs.values()) / len(a)
    if least < WORD_LIKE or mean < NAME_LIKE:
        return False
    mistakes = [word_distance(a[i], b[j]) for i, (j, _) in pairs.items()]
    return None not in mistakes and sum(mistakes) <= 3


def parsed(df: DataFrame, key: str, name: str) -> DataFrame:
    """(id, key): the distinctive part of each name, with its given names under their first form behind a tilde."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_parts(n) for n in b.column(1).to_pylist()]
            text = pa.array([" ".join(w) + (" ~" + "+".join(g) if g else "") or None for w, g in parts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["id", "key"])

    return df.select(F.col(key).cast("string").alias("id"), F.col(name).alias("_n")).mapInArrow(run, "id string, key string")


def _number(text: str) -> int:
    """A 64-bit number for a block."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


#: `kind`: 2 for the block of an intact word, 1 for one that all names in it meet in, 0 for one made for lone words.
_BLOCKS = "key long, block long, kind int, lone boolean"


def _rows(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["key", "block", "kind", "lone"])


def _blocked(keys: DataFrame) -> DataFrame:
    """(key, block, kind, lone): a row for each block of each distinct name (key, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, _ = split(name)
                rows += [(k, _number(x), 2 if x[0] == "w" else int(x[0] == "c"), len(words) == 1) for x in blocks(words)]
            yield _rows(rows)

    return spread(keys).mapInArrow(run, _BLOCKS)


def _divided(crowded: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of crowded blocks of a shared word, one for each part of the block they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, block, name in zip(*(c.to_pylist() for c in b.columns)):
                words, _ = split(name)
                shared = next(w for w in words if _number(f"w{w}") == block)
                rows += [(k, _number(f"{block}|{x}"), 1, False) for x in beside(words, shared)]
            yield _rows(rows)

    return crowded.select("key", "block").join(keys, "key").select("key", "block", "name").mapInArrow(run, _BLOCKS)


def _pairs(blocked: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct names that share a block; in blocks made for lone words, only those with a lone word."""
    size = blocked.groupBy("block").agg(F.count("*").alias("n"), F.max("lone").alias("any_lone"))
    rows = blocked.join(size.where("n > 1"), "block").where("any_lone or kind > 0")
    crowded = (F.col("n") > CROWDED) & (F.col("kind") == 2)
    calm = rows.where(~crowded).select("key", "block", "kind", "lone")
    live = materialize(calm.unionByName(_divided(rows.where(crowded), keys)).distinct())
    left, right = live.where("lone or kind > 0").alias("l"), live.alias("r")
    meet = (F.col("l.block") == F.col("r.block")) & (F.col("l.key") != F.col("r.key"))
    met = left.join(right, meet).where((F.col("l.kind") == 0) | (F.col("l.key") < F.col("r.key")))
    return met.select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b")).distinct()


def relation(a: str, b: str) -> list[tuple[bool, str, int, bool]]:
    """The links (turned, kind, mistakes, single) of two names: `name` for one organisation, `cut` where the first (the second, if turned) may be the other with something left out.

    Names with given names that have none in common are never linked. A name without a given name where the other has
    one is cut, as is a lone word that resembles a word of the other. `single`: what it is cut from is a lone word too.
    """
    (x, given), (y, other) = split(a), split(b)
    if given and other and not given & other:
        return []
    whole = same(x, y) or (len(x) == 1 and x == y)
    if whole and bool(given) == bool(other) and (len(x) > 1 or len(y) > 1 or given):
        return [(False, "name", 0, False)]
    if whole:
        return [(not other, "cut", 0, len(y if other else x) == 1)]
    if min(len(x), len(y)) > 1:
        return []
    near = [d for w in (x if len(x) == 1 else y) for v in (y if len(x) == 1 else x) if (d := word_distance(w, v)) is not None]
    return [(turned, "cut", min(near), len(rest) == 1) for turned, own, rest in ((False, x, y), (True, y, x)) if len(own) == 1] if near else []


def _compared(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, kind, mistakes, single): `relation` of each pair of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, j, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(j, i, *r) if turned else (i, j, *r) for turned, *r in relation(a, b)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["a", "b", "kind", "mistakes", "single"])

    left, right = (keys.select(F.col("key").alias(k), F.col("name").alias(f"name_{k}")) for k in ("a", "b"))
    named = spread(pairs).join(left, "a").join(right, "b").select("a", "b", "name_a", "name_b")
    return named.mapInArrow(run, "a long, b long, kind string, mistakes int, single boolean")


def organisations(df: DataFrame, key: str, name: str) -> DataFrame:
    """(id, organisation): each row with the smallest id of its organisation.

    Rows of one distinctive part and the same given names are one class; only classes are compared, so copies cost
    nothing and a class of any size is never expanded. Two names of several words are one organisation if `same` says
    so and their given names, if both have any, have one in common; those links are closed by connected components. A
    name cut to one word, or without its given name, joins the one organisation that has the rest with the fewest
    mistakes; if several do (a shared word), it joins none. A row with a null or empty name is its own organisation;
    a null id is left out. An empty table gives no rows. Classes and blocks go by 64-bit hashes: among a billion
    different names, two share one by chance with a probability of 3 %.
    """
    rows = materialize(parsed(df, key, name).where("id is not null").select("id", F.col("key").alias("name"), F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("key")))
    keys = materialize(rows.where("name is not null").groupBy("key").agg(F.min("name").alias("name")))
    found = materialize(_compared(_pairs(materialize(_blocked(keys)), keys), keys))
    whole = materialize(connected_components(found.where("kind = 'name'").select("a", "b")))
    cut = found.where("kind = 'cut'").join(whole.select(F.col("node").alias("b"), "component"), "b", "left")
    cut = cut.select("a", F.coalesce("component", "b").alias("to"), F.struct("single", "mistakes").alias("rank"))
    best = cut.groupBy("a").agg(F.min("rank").alias("best"))
    tied = cut.join(best, "a").where("best = rank").groupBy("a").agg(F.min("to").alias("b"), F.max("to").alias("other"))
    links = whole.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tied.where("b = other").select("a", "b"))
    classes = connected_components(links).withColumnRenamed("node", "key")
    member = rows.where("key is not null").join(classes, "key", "left").select("id", F.coalesce("component", "key").alias("c"))
    first = member.groupBy("c").agg(F.min("id").alias("organisation"))
    nameless = rows.where("key is null").select("id", F.col("id").alias("organisation"))
    return member.join(first, "c").select("id", "organisation").union(nameless).distinct()


def p3_organisations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, organisation, spellings): every company row with its organisation and how many rows that has."""
    each = organisations(table(spark, folder, "companies"), "id", "name")
    size = each.groupBy("organisation").agg(F.count("*").alias("spellings"))
    return each.join(size, "organisation").select("id", "organisation", "spellings")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id_a, company_id_b): all pairs of rows of one organisation."""
    each = materialize(organisations(table(spark, folder, "companies"), "id", "name"))
    left, right = each.alias("l"), each.alias("r")
    pair = (F.col("l.organisation") == F.col("r.organisation")) & (F.col("l.id") < F.col("r.id"))
    return left.join(right, pair).select(F.col("l.id").alias("company_id_a"), F.col("r.id").alias("company_id_b"))


QUERIES = {"p3_found": p3_found, "p3_organisations": p3_organisations}
ORACLES: dict[str, str] = {}
