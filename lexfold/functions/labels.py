"""Readers of risk labels from model output: one for each of the data model's five conventions, and the serving form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, strip

RISKS = ("Low", "Medium", "High")
#: Words that make the stand-in classifier say High or Medium.
HIGH_WORDS = ("indemnif", "liabil", "damages", "penalty")
MEDIUM_WORDS = ("terminat", "notice", "warrant")


def by_priority(c: Column) -> Column:
    """high, medium or low: the gravest that stands as a word; null without one."""
    low = F.lower(c)
    return F.coalesce(*(F.when(low.rlike(rf"(?U)\b{w}\b"), F.lit(w)) for w in ("high", "medium", "low")))


def marked_or_first(c: Column) -> Column:
    """The label after the first "Risk Level:", else the first label word, else Unknown."""
    return F.initcap(F.coalesce(found(c, r"(?iU)Risk Level:\s*(Low|Medium|High)"), found(c, r"(?iU)\b(Low|Medium|High)\b"), F.lit("Unknown")))


def terminal_or_last(c: Column) -> Column:
    """The Low or High that ends a "Risk Level:" line, else the last such word, else Unknown."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?iU)\b(Low|High)\b"), F.lit(1)), F.lit(-1))
    return F.initcap(F.coalesce(found(c, r"(?imdU)Risk Level:\s*(Low|High)\s*$"), last, F.lit("Unknown")))


def upper_binary(c: Column) -> Column:
    """HIGH or LOW after "RISK LEVEL:", else the first such word, else UNKNOWN."""
    up = F.upper(c)
    return F.coalesce(found(up, r"(?U)RISK LEVEL\s*:\s*(HIGH|LOW)"), found(up, r"(?U)\b(HIGH|LOW)\b"), F.lit("UNKNOWN"))


def word_or_part(c: Column) -> Column:
    """The first label word, else the gravest label within any word, else Unknown."""
    low = F.lower(c)
    part = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in ("high", "medium", "low")))
    return F.initcap(F.coalesce(found(c, r"(?iU)\b(Low|Medium|High)\b"), part, F.lit("Unknown")))


def served(c: Column) -> Column:
    """(risk, explanation) of a two-line answer: the last "Risk Level:" line says Low or High, else High; the last "Explanation:" line, else all."""
    lines = F.transform(F.split(c, "\n"), strip)
    last = lambda mark: F.try_element_at(F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(mark))), F.lit(-1))
    risk, why = last("risk level:"), last("explanation:")
    return F.struct(
        F.when(F.contains(F.lower(F.substring(risk, 12, 1 << 30)), F.lit("low")), "Low").otherwise("High").alias("risk"),
        F.coalesce(strip(F.substring(why, 13, 1 << 30)), strip(c)).alias("explanation"),
    )


def labelled(c: Column) -> Column:
    """(risk, explanation) of an annotator's answer after its scratchpad is cut; null unless both are there."""
    from .text import without_scratchpad

    text = without_scratchpad(c)
    risk, why = found(text, r"(?iU)Risk Level:\s*(Low|Medium|High)"), found(text, r"(?isU)Explanation:\s*(.+)")
    return F.when(risk.isNotNull() & why.isNotNull(), F.struct(F.initcap(risk).alias("risk"), F.substring(strip(why), 1, 400).alias("explanation")))


def stand_in(clause: Column, role: Column, high: tuple[str, ...] = HIGH_WORDS, medium: tuple[str, ...] = MEDIUM_WORDS) -> Column:
    """(risk, explanation) by key words, for when no model is there."""
    low = F.lower(clause)
    has = lambda words: low.rlike("|".join(words))
    risk = F.when(has(high), "High").when(has(medium), "Medium").otherwise("Low")
    # fixed values: the stand-in's answers
    why = (
        F.when(has(high), F.concat(F.lit("[Placeholder] Clause contains liability/indemnification language — High risk for "), role, F.lit(".")))
        .when(has(medium), F.concat(F.lit("[Placeholder] Clause involves rights/obligations that create moderate risk for "), role, F.lit(".")))
        .otherwise(F.concat(F.lit("[Placeholder] Clause appears administrative — Low risk for "), role, F.lit(".")))
    )
    return F.struct(risk.alias("risk"), why.alias("explanation"))


def severity(risk: Column) -> Column:
    """0, 1, 2 for Low, Medium, High; null for others."""
    return F.when(risk == "Low", 0).when(risk == "Medium", 1).when(risk == "High", 2)


def from_severity(n: Column) -> Column:
    """The label of a severity; Low for null."""
    return F.when(n == 2, "High").when(n == 1, "Medium").otherwise("Low")


def clause_class(parties: Column) -> Column:
    """The gravest risk of a clause's parties; Low without any."""
    return from_severity(F.array_max(F.transform(F.map_values(parties), lambda p: severity(p["risk"]))))


def combined(parties: Column, first: str = "Licensor", second: str = "Licensee") -> Column:
    """Both parties' risks joined by |."""
    return F.concat_ws("|", F.coalesce(parties[first]["risk"], F.lit("Unknown")), F.coalesce(parties[second]["risk"], F.lit("Unknown")))


def merged(risk: Column, source: str = "Medium", target: str = "High") -> Column:
    return F.when(risk == source, target).otherwise(risk)


def malformed_answer(c: Column) -> Column:
    """Whether no line of a text ends as "Risk Level: Low" or "High"."""
    return ~c.rlike(r"(?imdU)Risk Level:\s*(Low|High)\s*$")
