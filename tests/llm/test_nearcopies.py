import random

import numpy as np
from pyspark.sql import functions as F

from vacantia.llm.darts import EMPTY, band_keys, mix, signatures
from vacantia.llm.nearcopies import near_copies, words_of


def jaccard(x, y, size=3):
    a, b = words_of(x or ""), words_of(y or "")
    s, t = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a, b))
    return len(s & t) / max(1, len(s | t))


def test_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(3)
    universe = mix(np.arange(1, 121, dtype=np.uint64))
    weight = draw.uniform(0.05, 3, 120)
    pick = [np.arange(0, 100), np.arange(20, 120)]
    rows = np.concatenate([np.full(len(p), i) for i, p in enumerate(pick)])
    at = np.concatenate(pick)
    sig = signatures(universe[at], rows, weight[at], 3, 2048)
    want = weight[20:100].sum() / weight.sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and (sig[2] == EMPTY).all() and (sig[:2] != EMPTY).all()
    keys = band_keys(sig[:, :128], 4)
    assert keys.shape == (3, 32) and len(set(keys[0].tolist())) == 32


def edit(draw, words, share):
    return [draw.choice(VOCABULARY) if draw.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


def test_links_equal_brute_force_also_in_crowded_buckets(spark):
    draw = random.Random(5)
    texts = {}
    for g in range(25):
        base = draw.choices(VOCABULARY, k=draw.randint(60, 140))
        for c in range(60 if g == 0 else draw.randint(1, 4)):
            texts[f"{g:02}-{c:02}"] = " ".join(edit(draw, base, 0.012 * (c > 0)))
    texts |= {"e1": "", "e2": None, "s1": "too short", "s2": "too short", "long": " ".join(draw.choices(VOCABULARY, k=20000)), "dup": texts["03-00"]}
    texts["html"] = "<p>" + texts["04-00"].upper().replace(" ", "&nbsp;<br/> ", 5) + "</p>"
    rows = [(i, t, 1, 2) for i, t in texts.items()] + [("00-01", texts["00-01"], 1, 2), (None, texts["00-01"], 1, 2)]
    df = spark.createDataFrame(rows, "id string, text string, key int, grams int")
    members, links, classes = near_copies(df, "id", F.col("text"), size=3, threshold=0.5, least=60)
    key = dict(members.collect())
    got = {frozenset((r.a, r.b)) for r in links.collect()}
    ids = sorted(key)
    want = {frozenset((key[x], key[y])) for x in ids for y in ids if key[x] != key[y] and jaccard(texts[x], texts[y]) >= 0.5}
    assert got == want and key["dup"] == key["03-00"] and key["html"] == key["04-00"]
    assert not {"e1", "e2", "s1", None} & set(key)
    groups = dict(classes.collect())
    assert len({groups[key[i]] for i in ids if i.startswith("00-")}) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    members, links, classes = near_copies(df, "id", F.col("text"))
    assert members.count() == links.count() == classes.count() == 0


def check_links(spark, texts, low, high):
    """The links of `texts` are those of brute force, of which there are some from `low` to `high`."""
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    members, links, _ = near_copies(df, "id", F.col("text"), size=3, threshold=0.5, least=60)
    key = dict(members.collect())
    got = {frozenset((r.a, r.b)) for r in links.collect()}
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in texts.items())}
    near = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in texts for y in texts if x < y}
    assert sum(low <= j < high for j in near.values()) > 20
    assert got == {frozenset((key[x], key[y])) for (x, y), j in near.items() if j >= 0.5 and key[x] != key[y]}


def test_hot_group_of_loosely_edited_copies_is_found_whole(spark):
    draw = random.Random(7)
    base = draw.choices(VOCABULARY, k=120)
    texts = {f"h{i:03}": " ".join(edit(draw, base, 0.038)) for i in range(120)}
    texts |= {f"o{i:03}": " ".join(draw.choices(VOCABULARY, k=120)) for i in range(240)}
    check_links(spark, texts, 0.6, 0.7)


def test_chain_through_a_copy_of_the_leader_is_kept(spark):
    draw = random.Random(11)
    core = draw.choices(VOCABULARY, k=60)
    texts = {}
    for i in range(45):
        y = core + draw.choices(VOCABULARY, k=14)
        texts[f"y{i:02}"] = " ".join(y)
        texts[f"x{i:02}"] = " ".join(draw.choices(VOCABULARY, k=16) + y[16:])
    check_links(spark, texts, 0.55, 0.7)


def test_pairs_with_boilerplate_of_a_tenth_of_all_texts_are_found(spark):
    draw = random.Random(13)
    boilerplate = draw.choices(VOCABULARY, k=60)
    texts = {f"o{i:03}": " ".join(draw.choices(VOCABULARY, k=110)) for i in range(540)}
    for i in range(30):
        own = draw.choices(VOCABULARY, k=50)
        for c in "ab":
            texts[f"{c}{i:02}"] = " ".join(boilerplate + edit(draw, own, 0.17 * (c == "b")))
    check_links(spark, texts, 0.5, 0.8)


def recall(spark, monkeypatch, draw_pair, low, high):
    """Share of the pairs of brute force, `low` to `high` close, that the bands find without any help of probes."""
    monkeypatch.setattr("vacantia.llm.nearcopies.PROBES", 0)
    texts = {}
    while len(texts) < 600:
        a, b = draw_pair()
        if low <= jaccard(a, b) < high:
            texts |= {f"a{len(texts):04}": a, f"b{len(texts):04}": b}
    members, links, _ = near_copies(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", F.col("text"), size=3, threshold=0.5, least=60)
    key = dict(members.collect())
    got = {frozenset((r.a, r.b)) for r in links.collect()}
    pairs = [i for i in texts if i[0] == "a"]
    return sum(frozenset((key[i], key["b" + i[1:]])) in got for i in pairs) / len(pairs)


def test_bands_find_pairs_at_the_threshold(spark, monkeypatch):
    draw = random.Random(17)

    def pair():
        base = draw.choices(VOCABULARY, k=120)
        return " ".join(base), " ".join(edit(draw, base, 0.11))

    assert recall(spark, monkeypatch, pair, 0.5, 0.6) >= 0.9


def test_crowded_buckets_and_hot_groups_are_compared_in_blocks(spark, monkeypatch):
    for name, value in (("FEW", 4), ("PROBES", 60), ("HOT", 4), ("BLOCK", 40)):
        monkeypatch.setattr(f"vacantia.llm.nearcopies.{name}", value)
    draw = random.Random(19)
    base = draw.choices(VOCABULARY, k=120)
    texts = {f"h{i:03}": " ".join(edit(draw, base, 0.03)) for i in range(100)}
    for g in range(12):
        other = draw.choices(VOCABULARY, k=100)
        texts |= {f"g{g:02}{i}": " ".join(edit(draw, other, 0.012)) for i in range(12)}
    check_links(spark, texts, 0.6, 0.8)
