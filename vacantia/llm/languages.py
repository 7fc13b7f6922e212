"""Problem 4: a language with a confidence for each text and each of its segments."""

from __future__ import annotations

import html
import pickle
import random
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.crf import Field, pad
from vacantia.runtime import table

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pl", "pt")
#: Codes and names of the languages, as labels are typed.
LABELS = {
    "de": "de deu ger deutsch german tedesco allemand alemán alemao alemão duits niemiecki",
    "en": "en eng english inglese anglais englisch inglés ingles inglês engels angielski",
    "es": "es spa esp spanish español espanol spagnolo espagnol spanisch espanhol spaans castellano hiszpański",
    "fr": "fr fra fre french français francais francese französisch franzoesisch francés frances francês frans francuski",
    "it": "it ita italian italiano italien italienisch italiaans włoski",
    "nl": "nl nld dut ned dutch nederlands olandese néerlandais neerlandais niederländisch holandés neerlandés holandês niderlandzki holenderski",
    "pl": "pl pol polish polski polacco polonais polnisch polaco polonês pools",
    "pt": "pt por portuguese português portugues portoghese portugais portugiesisch portugués portugees portugalski",
}
CODES = {name: code for code, names in LABELS.items() for name in names.split()}
#: Labelled texts the field is trained on, at most; they are the first by hash of their key, so the same at every run.
SAMPLE = 1000
#: Words of all lexicons together that the field may hold.
MOST_WORDS = 100_000
_TRAINED: dict[str, Field] = {}
_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|br|h\d|tr|td|section)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_END = re.compile(r"(?<=[.!?…])[\s]+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_ANY = re.compile(r"[^\W_]+")


def label_code(label: str | None) -> str:
    """The code a label means; empty for a missing label, a placeholder or a language that isn't listed."""
    text = (label or "").strip().lower()
    return CODES.get(text) or CODES.get(re.split(r"[-_ ]", text)[0] if text else "", "")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, lower-cased, in order.

    Tags and Markdown are removed, entities decoded. Headings (up to six words without an end, or anything before a
    colon at a line's end) belong to what surrounds them and are left out, unless there is nothing else; pieces of
    fewer than three words join the sentence before.
    """
    if "<" in text:
        text = _TAG.sub(" ", _BLOCK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    kept: list[list[str]] = []
    heads: list[list[str]] = []
    for piece in _END.split(text):
        words = _WORD.findall(piece.lower())
        if not words:
            continue
        end = piece.rstrip(" *_\"'»”)")[-1:]
        if end == ":" and len(words) <= 8 or len(words) <= 6 and end not in ".!?…;" or piece.lstrip()[:1] == "#":
            heads.append(words)
        elif len(words) < 3 and kept:
            kept[-1] = kept[-1] + words
        else:
            kept.append(words)
    return kept or heads


def train(rows: Sequence[tuple[str, str]], lexicon: dict[str, list[str]]) -> Field:
    """A field from (text, code) rows: sentences are strung together across languages so that the moves are learned.

    Labels may be wrong here and there: after the first rounds, sentences that the field gives to another language are
    left out.
    """
    field = Field(LANGUAGES, lexicon)
    draw = random.Random(7)
    pool = [(s, LANGUAGES.index(code)) for text, code in rows for s in sentences(text) if len(s) >= 4]
    if not pool:
        return field
    for rounds in (25, 35):
        draw.shuffle(pool)
        texts, i = [], 0
        by_label = {c: [s for s, l in pool if l == c] for c in range(len(LANGUAGES))}
        while i < len(pool):
            words: list[str] = []
            starts: list[bool] = []
            labels: list[int] = []
            label = pool[i][1]
            for _ in range(5):
                if i >= len(pool):
                    break
                if draw.random() < 0.15:
                    label = pool[i][1]
                own = by_label[label]
                s = own.pop() if own else pool[i][0]
                here = label if own else pool[i][1]
                words += s
                starts += [True] + [False] * (len(s) - 1)
                labels += [here] * len(s)
                i += 1
            texts.append((words, starts, labels))
        field.fit(texts, rounds)
        guess = classify(field, [[s] for s, _ in pool])
        pool = [p for p, g in zip(pool, guess) if g[0][0] == p[1]] or pool
    return field


def classify(field: Field, texts: Sequence[list[list[str]]], chunk: int = 512) -> list[list[tuple[int, float, int]]]:
    """(label, confidence, words) of each sentence of each text: the mean of its words' marginals."""
    out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: sum(map(len, texts[i])))
    at = 0
    while at < len(order):
        longest = sum(map(len, texts[order[min(at + chunk, len(order)) - 1]]))
        take = max(1, min(chunk, 400_000 // max(1, longest)))
        part = order[at : at + take]
        at += take
        rows = []
        for i in part:
            ids = field.look_up([w for s in texts[i] for w in s])
            rows.append((ids, [j == 0 for s in texts[i] for j in range(len(s))], ids))
        ids, start, mask, _ = pad(rows)
        p, _, _ = field.marginals(field.scores[ids], start, mask)
        p = np.ascontiguousarray(p.transpose(1, 0, 2))
        for row, i in enumerate(part):
            sizes = [len(s) for s in texts[i]]
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(p[row, : sum(sizes)], begin, axis=0) / np.array(sizes)[:, None]
            best = mean.argmax(axis=1)
            out[i] = list(zip(best.tolist(), mean[np.arange(len(best)), best].tolist(), sizes))
    return out


def segments(found: Sequence[tuple[int, float, int]]) -> list[tuple[str, float, int]]:
    """(language, confidence, words) of the maximal runs of sentences of one language; confidence is weighted by words."""
    runs: list[list] = []
    for label, p, n in found:
        if runs and runs[-1][0] == label:
            runs[-1][1] += p * n
            runs[-1][2] += n
        else:
            runs.append([label, p * n, n])
    return [(LANGUAGES[l], s / n, n) for l, s, n in runs]


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Field:
    return pickle.loads(model)


def fit(texts: DataFrame, key: str, text: str, label: str, lexicon: DataFrame, sample: int = SAMPLE) -> Field:
    """The field trained on `sample` labelled rows, the first by hash of their key; the rest of `texts` isn't collected.

    It is trained once in a driver's process for the same rows and lexicon. A lexicon of more than MOST_WORDS is refused.
    """
    known = F.lower(F.trim(F.split_part(F.regexp_replace(label, "[-_]", " "), F.lit(" "), F.lit(1)))).isin(list(CODES))
    rows = texts.where(F.col(text).isNotNull() & known & (F.length(text) >= 60)).select(F.col(text).alias("t"), F.col(label).alias("l"), F.xxhash64(key).alias("h"))
    chosen = [(r.t, label_code(r.l)) for r in rows.orderBy("h", "t").limit(sample).collect()]
    words: dict[str, list[str]] = {}
    listed = lexicon.where("word is not null and lang is not null").select("lang", "word").distinct().orderBy("lang", "word").limit(MOST_WORDS + 1).collect()
    if len(listed) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in the lexicon")
    for r in listed:
        words.setdefault(r.word.lower(), []).append(r.lang)
    learned = [(t, c) for t, c in chosen if c]
    name = xxhash.xxh128_hexdigest(pickle.dumps((learned, sorted(words.items()))))
    if name not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[name] = train(learned, words)
    return _TRAINED[name]


def label_languages(df: DataFrame, key: str, text: Column, field: Field) -> DataFrame:
    """(id, words, segments): each text's words and its segments as (lang, confidence, words), one row for each id.

    A repeated row of an id counts once (of differing rows the one of least digest). A null, empty or wordless text has
    no segments; a null id is left out. Ties between languages go to the first by code. Texts of any length are read
    whole. The model is a few megabytes whatever the corpus.
    """
    model = pickle.dumps(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(model)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [segments(x) for x in classify(own, [sentences(t) for t in texts])]
            count = [len(_ANY.findall(_TAG.sub(" ", t) if "<" in t else t)) for t in texts]
            digest = [xxhash.xxh64_intdigest(t) >> 1 for t in texts]
            rows = pa.array([[{"lang": l, "confidence": c, "words": n} for l, c, n in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.int64()), pa.array(count, pa.int32()), rows, b.column(2)], names=["id", "digest", "words", "segments", "label"])

    shape = "id string, digest long, words int, segments array<struct<lang:string,confidence:double,words:int>>, label string"
    label = F.col("_label") if "_label" in df.columns else F.lit(None).cast("string")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), text.alias("t"), label.alias("label"))
    one = rows.mapInArrow(run, shape).groupBy("id").agg(F.min(F.struct("digest", "words", "label", "segments")).alias("x"))
    return one.select("id", "x.words", "x.label", "x.segments")


def _ads(spark: SparkSession, folder: str) -> DataFrame:
    field = fit(table(spark, folder, "documents"), "doc_id", "text", "lang", table(spark, folder, "common_words"))
    ads = table(spark, folder, "opportunities").withColumn("_label", F.get_json_object("data", "$.language"))
    return label_languages(ads, "id", F.get_json_object("data", "$.description"), field)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(opportunity_id, segment_no, lang): the segments of ads whose label is missing or wrong or that mix languages."""
    rows = _ads(spark, folder).where("words >= 15 and size(segments) > 0")
    code = F.element_at(F.create_map(*[F.lit(x) for p in CODES.items() for x in p]), F.lower(F.trim("label")))
    head = F.element_at(F.create_map(*[F.lit(x) for p in CODES.items() for x in p]), F.regexp_extract(F.lower(F.trim("label")), r"^([^-_ ]+)", 1))
    label = F.coalesce(code, head, F.lit(""))
    odd = rows.where((F.size("segments") > 1) | (label != F.col("segments")[0]["lang"]))
    return odd.select(F.col("id").alias("opportunity_id"), F.posexplode("segments").alias("n", "s")).select(
        "opportunity_id", (F.col("n") + 1).alias("segment_no"), F.col("s.lang").alias("lang"))


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(opportunity_id, segment_no, lang, confidence, words) of every ad's description."""
    return _ads(spark, folder).select(F.col("id").alias("opportunity_id"), F.posexplode("segments").alias("n", "s")).select(
        "opportunity_id", (F.col("n") + 1).alias("segment_no"), F.col("s.lang").alias("lang"),
        F.round("s.confidence", 6).alias("confidence"), F.col("s.words").alias("words"))


QUERIES = {"p4_found": p4_found, "p4_segments": p4_segments}
ORACLES: dict[str, str] = {}
