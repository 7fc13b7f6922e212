"""Ordered decisions: rule flags, tables of thresholds, cascades of judges, choices among scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_flags(text: Column, patterns: dict[str, str], exceptions: dict[str, str] | None = None) -> Column:
    """The keys of the patterns a text matches, in their order; an exception pattern takes its key back."""
    exceptions = exceptions or {}
    hit = lambda p: text.rlike("(?iU)" + p)
    keys = [F.when(hit(p) & ~(hit(exceptions[k]) if k in exceptions else F.lit(False)), F.lit(k)) for k, p in patterns.items()]
    return F.array_compact(F.array(*keys))


def decision_table(branches: Sequence[tuple[Column, str]], default: str) -> Column:
    """The outcome of the first true branch."""
    chain = F.when(F.lit(False), F.lit(default))
    for condition, outcome in branches:
        chain = chain.when(condition, F.lit(outcome))
    return chain.otherwise(F.lit(default))


def first_decided(judgements: Sequence[Column], decided: Sequence[str], default: str) -> Column:
    """The first judgement, in order of strength, whose `verdict` is one of `decided`; the default otherwise."""
    known = [F.when(j["verdict"].isin(*decided), j) for j in judgements]
    return F.coalesce(*known, F.struct(F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("judge")))


def judgement(verdict: Column, judge: str) -> Column:
    """A judge's verdict with its name."""
    return F.struct(verdict.alias("verdict"), F.lit(judge).alias("judge"))


def axis(labels: Column, wanted: Sequence[str], missing: str, yes: str, no: str) -> Column:
    """A verdict on a list of labels: missing without any, yes if one is wanted, else no."""
    return F.when(F.coalesce(F.size(labels), F.lit(0)) == 0, missing).when(F.arrays_overlap(labels, F.array(*[F.lit(w) for w in wanted])), yes).otherwise(no)


def choose(scores: Column, least: float, single: float, pair: float) -> Column:
    """Labels from a list of (score, name): the best two if they add up to `pair`, else the best if it reaches `single`.

    Only scores of at least `least` count; ties go to the name.
    """
    ranked = F.array_sort(F.transform(F.filter(scores, lambda s: s["score"] >= least), lambda s: F.struct((-s["score"]).alias("o"), s["name"].alias("name"))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    both = F.slice(ranked, 1, 2)
    names = F.transform(F.when(-(first["o"] + second["o"]) >= pair, both).when(-first["o"] >= single, F.slice(ranked, 1, 1)), lambda s: s["name"])
    return F.coalesce(names, F.array().cast("array<string>"))
