"""Prompts and training examples as columns. Their wording is part of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt texts that training data and models of the data model share.
ANALYST = (
    "You are a legal risk analyst specializing in licensing agreements. "
    "Your task is to analyze a contract clause and assess its risk level from a specific party's perspective. "
    "Focus on the practical consequences for the party — what they stand to lose, what obligations they must perform, "
    "and how protected they are if things go wrong. As a rough guide: low risk implies little to no liability for the party "
    "and high risk implies exposure."
)


# The requests below are fixed values too.


def user_request(clause: Column, party: Column) -> Column:
    return F.concat(F.lit("Analyze the following contract clause from the perspective of the **"), party, F.lit('**.\n\nClause:\n"""\n'), clause, F.lit('\n"""\n\nProvide:\n1. Risk Level\n2. Explanation'))


def training_text(clause: Column, party: Column, risk: Column, explanation: Column, system: str = ANALYST) -> Column:
    """A chat-formatted example with its answer."""
    header = lambda role: F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n")
    end = F.lit("<|eot_id|>")
    answer = F.concat(F.lit("Risk Level: "), risk, F.lit("\nExplanation: "), explanation)
    return F.concat(F.lit("<|begin_of_text|>"), header("system"), F.lit(system), end, header("user"), user_request(clause, party), end, header("assistant"), answer, end)


def classification_request(clause: Column, role: Column) -> Column:
    return F.concat(F.lit("Party role: "), role, F.lit("\n\nContract clause:\n"), clause, F.lit("\n\nWhat is the risk level of this clause for the above party?"))


def annotation_request(clause: Column) -> Column:
    return F.concat(F.lit("NOW ANALYZE:\n\n"), clause)


def one_word_request(clause: Column, party: Column) -> Column:
    """A zero-shot request that a party's risk be named in one word."""
    from .text import strip

    head = "You are a contract risk analyst reviewing a clause from a commercial agreement.\n\nYour task: classify the risk level of this clause FROM THE PERSPECTIVE OF THE "
    rest = '.\n\nRespond with ONLY one of these three words — nothing else:\nLow\nMedium\nHigh\n\nClause:\n"""'
    return F.concat(F.lit(head), F.upper(party), F.lit(rest), strip(clause), F.lit('"""\n\nRisk level for '), party, F.lit(":"))


def typed_request(clause: Column, kind: Column) -> Column:
    """A zero-shot request by clause type."""
    head = "You are a legal risk analyst. Your task is to classify the risk level of a legal contract clause.\n\nClause Type: "
    rest = (
        "\n\nClassify the risk level of this clause as exactly one of: Low, Medium, High\n- Low: Clause is standard and poses minimal risk to either party\n"
        "- Medium: Clause may require negotiation or careful attention\n- High: Clause poses significant legal or financial risk\n\n"
        "Respond with only one word — Low, Medium, or High. Do not explain.\n\nRisk Level:"
    )
    return F.concat(F.lit(head), kind, F.lit("\nClause Text: "), clause, F.lit(rest))


def enriched(clause: Column, licensor: Column, licensee: Column) -> Column:
    """The text by which a clause is retrieved."""
    return F.concat(F.lit("Licensor Risk: "), licensor, F.lit(". Licensee Risk: "), licensee, F.lit(". Clause: "), clause)


def in_section(clause: Column, section: Column) -> Column:
    """The clause after its section, where it has one."""
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("[Section: "), section, F.lit("]\n"), clause)).otherwise(clause)
