"""Sentences in which a company says what it does, taken from its ads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.html import html_lines
from vacantia.functions.text import lists_any


@dataclass(frozen=True)
class Speech:
    """How companies speak of themselves, as lower-case phrases and beginnings of words; pass another for other languages.

    openings: what a statement starts with, beside the company's name. acts: beginnings of the verbs that tell what it
    does. being: words after which it says what it is, and kinds: beginnings of nouns for that. aside: phrases of
    sentences about the vacancy or the conditions of work, which say nothing about the business.
    """

    openings: tuple[str, ...] = (
        "we", "our company", "our firm", "our office", "our site", "wir", "unsere firma", "unser standort", "nous", "notre société", "notre bureau", "noi", "la nostra azienda",
        "la nostra sede", "nosotros", "nuestra empresa", "nuestra oficina", "wij", "ons bedrijf", "ons kantoor", "nossa empresa", "o nosso escritório", "nasza firma", "nasze biuro")
    acts: tuple[str, ...] = (
        "build", "make", "produc", "provide", "design", "develop", "manufactur", "operat", "run", "suppl", "baue", "entwickel", "betreib", "verantwort", "gestisc", "costrui", "progett",
        "svilupp", "gèr", "fabriqu", "conç", "gestion", "constru", "fabric", "beheer", "maak", "gere", "prowadzi", "tworzy")
    being: tuple[str, ...] = ("is", "are", "ist", "sind", "est", "sommes", "è", "siamo", "es", "somos", "zijn", "é", "jest", "jesteśmy")
    kinds: tuple[str, ...] = ("compan", "firm", "business", "provider", "supplier", "manufacturer", "maker", "agenc", "bank", "leader", "unternehmen", "hersteller", "entrepris", "fournisseur", "aziend", "fornitor", "empres", "bedrijf", "producent")
    aside: tuple[str, ...] = (
        "looking for", "you will", "we hire", "equal opportunity", "your role", "wir suchen", "du wirst", "nous recherchons", "vous allez", "cerchiamo", "il tuo ruolo", "buscamos",
        "wij zoeken", "procuramos", "szukamy")
    #: Words after the opening within which the act has to come.
    reach: int = 5


SPEECH = Speech()


def sentences(lines: Column) -> Column:
    """The trimmed sentences of lines in order, each once."""
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda s: s != ""))


def _begins(words: Column, stems: tuple[str, ...]) -> Column:
    """Whether one of the words begins with one of the stems."""
    return F.exists(words, lambda w: F.greatest(F.lit(False), *[F.startswith(w, F.lit(s)) for s in stems]))


def states_business(text: Column, name: Column, speech: Speech = SPEECH) -> Column:
    """Whether a sentence is a statement of the company `name` about its business."""
    low = F.lower(text)
    own = F.nullif(F.lower(F.trim(name)), F.lit(""))
    subjects = F.array_compact(F.array(*[F.lit(o) for o in speech.openings], own))
    subject = F.array_max(F.transform(F.filter(subjects, lambda s: F.startswith(low, F.concat(s, F.lit(" ")))), F.length))
    words = F.filter(F.split(F.substr(low, subject + 2), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    acts = _begins(F.slice(words, 1, speech.reach), speech.acts)
    is_one = F.get(words, F.lit(0)).isin(*speech.being) & _begins(words, speech.kinds)
    return F.coalesce((acts | is_one) & ~lists_any(low, speech.aside), F.lit(False))


def employer_sentences(ads: DataFrame, companies: DataFrame, speech: Speech = SPEECH) -> DataFrame:
    """(company_id, text, id): statements of `ads` (id, company_id, description) about the company, each once, with its first ad.

    A null description gives none; a null or empty name is no subject, so that only the openings count.
    """
    told = ads.select("id", "company_id", F.explode(sentences(html_lines("description"))).alias("text"))
    named = told.join(companies.select(F.col("id").alias("company_id"), "name"), "company_id", "left")
    return named.where(states_business(F.col("text"), F.col("name"), speech)).groupBy("company_id", "text").agg(F.min("id").alias("id"))
