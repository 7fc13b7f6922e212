import numpy as np

from vacantia.llm.quality import KINDS, STATES, Lines, fit, lines_of, observe, shape_of, shares, statistics

COMMON = frozenset("the of and to in a is that for it with as was on are be this you have we at or our der die und in das mit".split())
PROSE = "We look for a person that likes to work with numbers and who is not afraid of the new tools we have. You will join the team in the office on the coast."
ITEMS = ["- Python", "- a driving licence", "- two days at home", "- extra leave", "- Data Analyst", "- write reports", "- SQL"]
TEXTS = {
    "prose": f"{PROSE}\n\nYour profile:\n{PROSE}", "short list inside": f"{PROSE}\n{PROSE}\n- Python\n- SQL\n{PROSE}", "list": "\n".join(ITEMS * 2),
    "plain list": "\n".join(x[2:] for x in ITEMS * 2), "introduced list": PROSE[:60] + ".\n\n" + "\r\n".join(f"{i}. {x[2:]}" for i, x in enumerate(ITEMS * 3)),
    "csv": "role;place;pay\n" + "\n".join(f"Engineer;Town{i};{20000 + i}" for i in range(9)), "pipes": "\n".join(f"| Data Analyst | Town | {i}000 |" for i in range(9)),
    "gaps": "\n".join(f"Engineer      Town{i}     {i}0000   FT" for i in range(9)), "html": "<table>" + "\n".join(f"<tr><td>Analyst</td><td>{i}</td><td>n/a</td></tr>" for i in range(9)) + "</table>",
    "hex": "\n".join("%064x" % (i * 7**70) for i in range(1, 9)), "phrase": "write automated checks ! " * 30, "noise": "ggwjwjphkj jbkpq hpvxpjgkg qxtvk tzhbfkw hfbfgx xthqbzkp qpgfwv" * 3,
    "css": "\n".join(f".a-{i} {{ margin:{i}px; color:#ff30b3; display:none }}" for i in range(9)), "null": None, "empty": "", "blank": " \n\t ", "long": (PROSE + " ") * 3000,
}
WANT = {"list": "list", "plain list": "list", "introduced list": "list", "csv": "table", "pipes": "table", "gaps": "table", "html": "table", "hex": "junk", "phrase": "junk", "noise": "junk", "css": "junk"}


def test_shapes_and_statistics(spark):
    rows = [*TEXTS.items(), ("csv", TEXTS["csv"]), (None, PROSE)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id string, text string, list string, prose double")
    out = statistics(df, "doc_id", "text", Lines(), COMMON)
    got = out.withColumn("shape", shape_of()).collect()
    assert len(got) == len(rows) and {r.doc_id: r["shape"] for r in got if r["shape"]} == WANT
    by = {r.doc_id: r for r in got}
    assert by["null"].words == by["blank"].words == 0 and by["empty"].prose == 0
    assert by["list"].words == 30 and by["long"].words == 3000 * len(PROSE.split()) and 0.99 < sum(by["csv"][s] for s in STATES) < 1.01
    assert by["prose"].ended_lines == 1 and by["prose"].common_words > 0.4
    assert statistics(df.limit(0), "doc_id", "text", Lines(), COMMON).count() == 0


def test_forward_backward_and_viterbi_equal_enumeration():
    from itertools import product

    m = Lines()
    seen = observe(lines_of("- a b\nHello there, we are the people of this town.\n12;3;4\n12;3;5"), COMMON)
    e, k = m.emissions(seen), len(STATES)
    score = {p: m.start[p[0]] + e[0, p[0]] + sum(m.moves[p[t - 1], p[t]] + e[t, p[t]] for t in range(1, len(p))) for p in product(range(k), repeat=len(seen))}
    assert m.label(seen) == list(max(score, key=score.get))
    total, at = np.logaddexp.reduce(list(score.values())), np.zeros((len(seen), k))
    for p, s in score.items():
        for t, x in enumerate(p):
            at[t, x] += np.exp(s - total)
    assert np.allclose(m.posterior(seen)[0], at)


def test_estimation_keeps_distributions_and_addresses_do_not_count():
    m = Lines()
    m.estimate([observe(lines_of(t), COMMON) for t in TEXTS.values() if t and t.strip() and len(t) < 5000])
    assert all(np.allclose(np.exp(t).sum(axis=1), 1) for t in m.tables) and len(m.tables) == len(KINDS)
    assert shares(PROSE + "\n\nhttps://x.example/form?id=886384535200&lang=en#step-2", m, COMMON)[0] == 1


def test_every_text_counts_in_the_estimation(spark):
    texts = [t for t in TEXTS.values() if t is None or len(t) < 5000] * 60
    rows = [(str(i), t) for i, t in enumerate(texts)]
    model = fit(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), "text", COMMON)
    seen = [observe(x, COMMON) for t in texts if t and (x := lines_of(t))]
    assert len(seen) > 600
    want = Lines()
    p, moved = zip(*(want.posterior(s) for s in seen))
    got = want.expected(seen)
    assert np.allclose(got[-16:].reshape(4, 4), sum(moved)) and np.allclose(got[:16].reshape(4, 4), [sum(x[s[:, 0] == v].sum(axis=0) for x, s in zip(p, seen)) for v in range(4)])
    want.estimate(seen)
    assert np.allclose(model.moves, want.moves, atol=1e-6) and all(np.allclose(a, b, atol=1e-6) for a, b in zip(model.tables, want.tables))
    assert fit(spark.createDataFrame([], "doc_id string, text string"), "text", COMMON).moves.shape == (4, 4)
