import random

from vacantia.llm.names import code, distinctive, jaro_winkler, organisations, same

ROWS = [
    ("a1", "Drapaketi Tozilti Solutions Ltd"), ("a2", "TOZILTI, DRAPAKETI soluzioni"), ("a3", "Drapaketi S.p.A."), ("a4", "DrapaketiTozilti Group"),
    ("a5", "Drapakteii Tozilti & Figli"), ("b1", "Gelkomavi Tozilti Solutions Ltd"), ("c1", "Beppe Rinsobel Vakomer e Figli"), ("c2", "Giuseppe Rinsobel Vakomer"),
    ("d1", "Tozilti Inc."), ("e1", None), ("e2", ""), ("f1", "Solutions GmbH"), ("f2", "SOLUTIONS gmbh"), ("f3", "Energy GmbH"), ("g1", "x" * 50_000), ("a1", "Drapaketi Tozilti Solutions Ltd"),
]
GROUPS = [{"a1", "a2", "a3", "a4", "a5"}, {"b1"}, {"c1", "c2"}, {"d1"}, {"e1"}, {"e2"}, {"f1", "f2"}, {"f3"}, {"g1"}]


def grouped(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id string, name string, key string, component int")
    found = {}
    for r in organisations(df, "id", "name").collect():
        found.setdefault(r.organisation, set()).add(r.id)
    return sorted(found.values(), key=min)


def test_groups(spark):
    assert grouped(spark, [*ROWS, (None, "Drapaketi Tozilti")]) == GROUPS


def test_empty(spark):
    assert grouped(spark, []) == []


def test_crowded_word_still_finds_variants(spark):
    draw = random.Random(1)
    heads = sorted({"".join(draw.choice(["ba", "ke", "lo", "mi", "ru", "tan", "vel", "zor"]) for _ in range(4)) for _ in range(260)})
    rows = [(f"{i:04}", f"{h} Hotword Energy") for i, h in enumerate(heads)]
    variant = heads[7][:-1] + "w"
    groups = grouped(spark, [*rows, ("z", f"Hotword {variant} Srl")])
    assert any({"0007", "z"} <= g for g in groups)


def test_links_do_not_depend_on_how_many_share_a_word(spark, monkeypatch):
    draw = random.Random(2)
    names = sorted({"".join(draw.choice(["ba", "ke", "lo", "mi", "ru", "tan", "vel", "zor"]) for _ in range(5)) for _ in range(230)})
    rows = [(f"{i:04}", f"{h} Hotword") for i, h in enumerate(names)]
    rows += [("p", "Hotword Rinsobel"), ("q", "Hotword Rilsotel"), ("r", "Hotword Aquamilo Rilsotel"), ("s", "Hotword Hotwird"), ("t", "Hotwort Hotword")]
    crowded = grouped(spark, rows)
    monkeypatch.setattr("vacantia.llm.names.CROWDED", 10**9)
    assert crowded == grouped(spark, rows) and {"p", "q", "r"} in crowded and {"s", "t"} in crowded


def test_parts():
    assert distinctive("José María Lemerquendil Sosaga & F.gli S.p.A.") == ["lemerquendil", "sosaga"]
    assert distinctive("R&D Pelteltale Botaga Sp. z o.o. Deutschland") == ["botaga", "pelteltale"]
    assert distinctive(" ") == [] and distinctive("GmbH")[0] == "=gmbh"
    assert code("pigago") == code("bikaco") and jaro_winkler("martha", "marhta") > 0.96 and jaro_winkler("abc", "xyz") == 0
    assert same(["rinsobel", "vakomer"], ["rinsobl", "vakomre"]) and not same(["rinsobel", "vakomer"], ["gelkomavi", "vakomer"])


def test_given_names_tell_organisations_apart_in_any_form(spark):
    rows = [("a", "Giuseppe Rossi Srl"), ("b", "Beppe ROSSI"), ("c", "Antonio Rossi"), ("d", "Maria Bianchi & Figli"), ("e", "Robert Bianchi"), ("f", "Studio Bob Bianchi"),
            ("g", "Katherine Rinsobel Vakomer"), ("h", "Rinsobel Vakomer"), ("i", "William Gelkomavi Tozilti"), ("j", "Robert Gelkomavi Tozilti"), ("k", "Gelkomavi Tozilti")]
    assert grouped(spark, rows) == [{"a", "b"}, {"c"}, {"d"}, {"e", "f"}, {"g", "h"}, {"i"}, {"j"}, {"k"}]


def test_generic_names_take_a_mistake(spark):
    rows = [("a", "Studio Tecnico Energia"), ("b", "Studio Tecnico Enrgia"), ("c", "Water Research International"), ("d", "Water Reserch International"), ("e", "Studio Tecnico Acque")]
    assert grouped(spark, rows) == [{"a", "b"}, {"c", "d"}, {"e"}]


def test_a_pair_is_found_however_many_share_its_word(spark):
    draw = random.Random(3)
    for n in (100, 260, 5000):
        heads = {"".join(draw.choice(["bra", "ken", "lov", "mig", "rus", "tan", "vel", "zor", "pid", "fag"]) for _ in range(6)) for _ in range(n)}
        rows = [(f"{i:05}", f"{h} Hotword") for i, h in enumerate(sorted(heads))]
        groups = grouped(spark, [*rows, ("y", "Bakelo Hotword"), ("z", "Zakero Hotword")])
        assert {"y", "z"} in groups
