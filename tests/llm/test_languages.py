import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm.crf import Field, pad
from vacantia.llm.languages import LANGUAGES, classify, fit, label_code, label_languages, segments, sentences
from vacantia.runtime import table

FOLDER = "/root/testdata/sf0.01"
DE = "Wir suchen eine neue Kollegin für unser Team in Berlin. Jede Woche trifft sich die Abteilung, um über das Archiv zu sprechen."
EN = "Please tell us why you want to join the team. Our office runs the quality control and it is growing faster than we planned."
IT = "Ogni settimana il reparto si riunisce per controllare la nuova grafica. Offriamo ferie aggiuntive in estate e un contratto di lavoro."


@pytest.fixture(scope="module")
def field(spark):
    return fit(table(spark, FOLDER, "documents"), "doc_id", "text", "lang", table(spark, FOLDER, "common_words"), sample=400)


def test_forward_backward_equals_enumeration():
    from itertools import product

    f = Field(("a", "b"), {})
    draw = np.random.default_rng(1)
    f.moves = draw.normal(size=(2, 2, 2)).astype(np.float32)
    emit = draw.normal(size=(4, 2, 2)).astype(np.float32)
    start = np.array([[1, 1], [0, 1], [1, 0], [0, 0]], bool)
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    p, _, moved = f.marginals(emit, start, mask, expect=True)
    want_moves = np.zeros((2, 2, 2))
    for j, n in ((0, 4), (1, 3)):
        weight, at, total = {}, np.zeros((n, 2)), 0.0
        for path in product((0, 1), repeat=n):
            w = np.exp(sum(emit[t, j, path[t]] for t in range(n)) + sum(f.moves[int(start[t, j]), path[t - 1], path[t]] for t in range(1, n)))
            weight[path], total = w, total + w
        for path, w in weight.items():
            for t in range(n):
                at[t, path[t]] += w / total
                if t:
                    want_moves[int(start[t, j]), path[t - 1], path[t]] += w / total
        assert np.allclose(p[:n, j], at, atol=1e-4)
    assert np.allclose(moved, want_moves, atol=1e-3)


def test_held_out_accuracy(spark, field):
    rows = table(spark, FOLDER, "documents").where("length(text) between 200 and 4000 and doc_type = 'ad_text' and lang is not null").select("text", "lang").collect()
    codes = [label_code(r.lang) for r in rows]
    found = [segments(x) for x in classify(field, [sentences(r.text) for r in rows])]
    right = sum(max(s, key=lambda x: x[2])[0] == c for s, c in zip(found, codes) if s)
    assert right / len(rows) > 0.9  # about one label in twenty is wrong itself


def test_segments_of_mixed_text(spark, field):
    texts = {
        "mixed": f"<p>{EN}</p><h3>Über uns</h3><p>{DE}</p>", "plain": IT, "three": f"{EN}\n\n## Profil\n{DE} {EN}", "null": None, "empty": "", "digits": "12 34",
        "names": f"{IT} Perilog, Sketrail, Python e ZETA-9 sono gli strumenti che si usano per il lavoro.", "long": (EN + " ") * 3000,
    }
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [("plain", IT, "x", 1), (None, EN, "x", 1)]
    df = spark.createDataFrame(rows, "key string, t string, segments string, words int")
    got = {r.id: r for r in label_languages(df, "key", F.col("t"), field).collect()}
    langs = {i: [s.lang for s in r.segments] for i, r in got.items()}
    assert langs == {"mixed": ["en", "de"], "plain": ["it"], "three": ["en", "de", "en"], "null": [], "empty": [], "digits": [], "names": ["it"], "long": ["en"]}
    assert all(0.6 < s.confidence <= 1 for r in got.values() for s in r.segments) and got["plain"].words == 21
    assert label_languages(df.limit(0), "key", F.col("t"), field).count() == 0


def test_labels_and_padding():
    assert [label_code(x) for x in ("de-DE", "en_US", "Inglese", "??", "", None, "sv", " pt ")] == ["de", "en", "en", "", "", "", "", "pt"]
    words, start, mask, _ = pad([([5], [True], [0]), ([1, 2], [True, False], [0, 1])])
    assert mask.tolist() == [[True, True], [False, True]] and words[1, 1] == 2 and len(LANGUAGES) == 8 and start[0].all()
