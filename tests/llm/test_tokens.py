import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm.merges import Transducer, decode, load_ranks, merge, sufficient_lookahead
from vacantia.llm.tokens import decoded, encode

tiktoken = pytest.importorskip("tiktoken")
PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RANKS = load_ranks(PATH)
LOOK = sufficient_lookahead(RANKS)
WORDS = {i: w for w, i in RANKS.items()}


@pytest.fixture(scope="module")
def public():
    from vacantia.llm.merges import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def streamed(text, chunk):
    t = Transducer(RANKS, LOOK)
    out = []
    for i in range(0, len(text), chunk):
        out.extend(t.feed(text[i : i + chunk]))
    return out + list(t.finish())


HARD = [
    "a" * 3000, " " * 2500 + "x", "-" * 4100, "=-" * 900, "1234567890" * 200, "  \n\t  " * 300, "don't we're 'll 'R", "é" * 900,
    "x'" + "re" * 3, "!" * 700 + "'s", "日本語テキスト" * 150, "   z", "👩‍👩‍👧" * 90, "a\x00b", " " * 700,
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts_whole_and_in_chunks(public, text):
    want = public.encode_ordinary(text)
    assert Transducer(RANKS, LOOK).encode(text) == want
    for chunk in (1, 7, 500):
        assert streamed(text, chunk) == want
    assert "".join(decode(want, WORDS)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_any_text_in_any_chunks(text, chunk):
    from vacantia.llm.merges import PATTERN

    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary(text)
    assert streamed(text, chunk) == want


def test_lookahead_suffices_on_chained_tokens():
    draw = random.Random(4)
    long = [w for w in RANKS if w.isalpha()]
    by_first = {}
    for w in long:
        by_first.setdefault(w[:1], []).append(w)
    t = Transducer(RANKS, LOOK)
    for _ in range(150):
        data = b""
        while len(data) < 3 * t.window:  # tokens that overlap with their successors
            w = draw.choice(by_first.get(data[-1:], long))
            data += w[1:] if data[-1:] == w[:1] else w
        assert t.piece(data) == [RANKS[x] for x in merge(data, RANKS)]


def test_operator_on_nulls_blanks_repeats_and_clashing_columns(spark, public):
    rows = [(1, None, 9), (2, "", 9), (3, "  ", 9), (4, "Ciao mondo", 9), (4, "Ciao mondo", 9), (None, "x" * 70000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(encode(df, "doc_id", "text").collect(), key=str)
    want = sorted([(i, public.encode_ordinary(t) if t else []) for i, t, _ in rows], key=str)
    assert [(r.doc_id, r.ids) for r in got] == [(i, x) for i, x in want] or sorted(map(str, got)) == sorted(f"Row(doc_id={i}, ids={x})" for i, x in want)
    assert encode(df.limit(0), "doc_id", "text").count() == 0
    back = decoded(encode(df.where("doc_id is not null"), "doc_id", "text"), "doc_id", "ids").collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t, _ in rows if i}


def test_left_growing_tokens_longer_than_the_lookahead_end():
    letters = "abcdefghijklmnop"
    ranks = {bytes([i]): i for i in range(256)}
    for n in range(2, len(letters) + 1):
        ranks[letters[:n].encode()] = 254 + n
    coder = Transducer(ranks, sufficient_lookahead(ranks))
    text = letters * 40 + "abcab" * 30
    assert coder.encode(text) == [ranks[t] for t in merge(text.encode(), ranks)]


def test_random_merge_lists_agree_with_whole_merging():
    draw = random.Random(23)
    for _ in range(150):
        ranks = {bytes([i]): i for i in range(256)}
        known = [b"a", b"b", b"c"]
        for _ in range(draw.randint(3, 25)):
            left, right = (known[-1] if draw.random() < 0.5 else draw.choice(known)), draw.choice(known)
            if draw.random() < 0.3:
                left, right = right, left
            if len(left + right) <= 60 and left + right not in ranks:
                ranks[left + right] = len(ranks)
                known.append(left + right)
        coder = Transducer(ranks, sufficient_lookahead(ranks))
        for _ in range(6):
            data = b"".join(draw.choices(known, k=60))
            assert coder.piece(data) == [ranks[t] for t in merge(data, ranks)]
