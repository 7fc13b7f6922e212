import random
import string

from vacantia.llm.canonical import Alias, Dictionary, decide, deletes, distance, fold, forms, map_values

LISTED = [
    (1, 0, "Italia", True), (1, 0, "IT", True), (2, 0, "Canada", True), (2, 0, "CA", True), (3, 0, "Regno Unito", True),
    (10, 1, "Ondrarazza", False), (10, 1, "OZ", False), (11, 1, "Sorbesera", False), (11, 1, "SS", True),
    (12, 3, "Ormcombe", False), (13, 2, "Dunderwickham", False), (14, 3, "Dunderwickham", False),
    (15, 2, "Skjælnæsø", False), (16, 2, "Längköpnäs", False), (17, 2, "New Copper Crest", False), (10, 1, "Ondrarazza", False),
]
SCHEMA = "ref int, grp int, name string, alone boolean"
CASES = {
    "Ondrarazza": 10, "ondrarazza HQ": 10, "Onfrarzaza": 10, "Onfrarzazax": 0, "OZ": 0, "OZ, Italia": 10, "OZ, Canada": 2,
    "SS": 11, "SS, CA": 2, "\"SS\"": 11, "IT": 1, "IT Manager": 0, "Italai": 1, "Ormcombx": 12, "Ormcmbx": 0,
    "Dunderwickham": 0, "Dunderwickham, CA": 13, "Regno Unito - Dunderwickhamm": 14, "Dunderwickham, Italia": 1,
    "Skjalnaso": 15, "Skjaelnaeso": 15, "SKJÆLNÆSØ": 15, "Laengkoepnas": 16, "12 Copper crest new": 0, "Nwe Coper Crest": 17,
    "remote": 0, "x" * 100_000: 0, "Ondrarazza, Canada": 10,
}


def aliases(spark):
    return spark.createDataFrame(LISTED + [(18, 1, None, False), (19, 1, "", False)], SCHEMA)


def test_cases_inline_and_in_blocks(spark):
    rows = [(i, v, "clash") for i, v in enumerate([*CASES, None, "", "  ", "OZ, Italia"])]
    df = spark.createDataFrame(rows, "i int, raw string, ref string")
    for block in (20_000, 3):
        got = {r.raw: r.ref for r in map_values(df, "raw", aliases(spark), block).collect()}
        assert got == CASES
    assert {r.n for r in map_values(df, "raw", aliases(spark)).where("raw = 'OZ, Italia'").collect()} == {2}


def test_empty_inputs(spark):
    df = spark.createDataFrame([("Roma",)], "raw string")
    assert map_values(df.limit(0), "raw", aliases(spark)).count() == 0
    assert [r.ref for r in map_values(df, "raw", aliases(spark).limit(0)).collect()] == [0]


def test_symmetric_deletes_find_what_all_pairs_find():
    draw = random.Random(2)
    names = ["".join(draw.choice("abcd") for _ in range(draw.randint(4, 12))) for _ in range(60)]
    words = Dictionary(tuple(Alias(i + 1, 0, n) for i, n in enumerate(names)))
    for _ in range(400):
        text = list(draw.choice(names))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "z"])
        text = "".join(text)
        want = {n for n in set(names) if distance(text, n, 1 if len(n) < 9 else 2)}
        assert {words.names[i][0] for i, _, _ in words.near(text)} == (want if len(text) >= 3 else set())


def test_distance_and_forms():
    assert distance("abcd", "abdc", 2)[0] == 1 and distance("ca", "abc", 2)[0] == 2 and distance("quill", "qikull", 2)[0] == 2 and distance("", "ab", 2)[0] == 2
    assert distance("roma", "r0ma", 1) == (1, 0.5) and distance("abc", string.ascii_lowercase, 2) is None
    assert fold("Łódź ÅØ") == "lodz ao" and forms("Wörth") == {"worth", "woerth"}
    assert deletes("ab", 1) == {"ab", "a", "b"} and decide([], {}) == 0
