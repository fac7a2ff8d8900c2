"""Text functions over columns. Patterns treat white space, digits and letters as Unicode does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the data model, written without lookaround so that any engine can run them.
ROMAN = r"(?:x{1,3}(?:ix|iv|v?i{0,3})|ix|iv|vi{0,3}|i{1,3})"
PARTY_REFS = r"\b(licensor|licensee|party\s+a|party\s+b|either\s+party|both\s+parties|each\s+party|the\s+parties)\b"
INLINE_LABEL = r"^([A-Z][A-Z\s]{3,40}):\s+"
SUBPART_LABEL = rf"^\s*(\((?:{ROMAN}|[a-z]|\d{{1,2}})\)|(?:{ROMAN}|[a-z])\.)\s*"
DECIMAL_LABEL = r"^\s*(?:(?:sub)?section\s+)?(\d+\.\d+\.?\d*)\s*\.?\s*"
BODY_MARK = 'Clause:\n"""'
BODY_END = '"""'
ASSISTANT = "<|start_header_id|>assistant<|end_header_id|>"
TURN_END = "<|eot_id|>"
EXPLANATION = "Explanation: "
# Words that give a label away, and what stands for them.
LEAKS = (("high", "significant"), ("medium", "moderate"), ("low", "minimal"))

# Signs in an error's message of a rate limit, and of a context that is too long.
RATE_LIMIT = "rate_limit|rate limit|ratelimit|429|too many requests"
CONTEXT_LENGTH = "context_length_exceeded|tokens_limit_reached|maximum context|too long"
CONTEXT_PAIRS = (("context", "length"), ("reduce", "token"))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one or when empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def party_refs(c: Column, pattern: str = PARTY_REFS) -> Column:
    """Distinct references to parties, lower-cased and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?iU)" + pattern), F.lit(1)), lambda x: F.lower(x))))


def inline_label(c: Column, pattern: str = INLINE_LABEL) -> Column:
    return strip(found(c, "(?U)" + pattern))


def subpart_label(c: Column) -> Column:
    """The leading label of a clause: (a), ii., 2.1 ...; null without one."""
    return F.coalesce(strip(found(c, "(?iU)" + SUBPART_LABEL)), strip(found(c, "(?iU)" + DECIMAL_LABEL)))


def between(c: Column, mark: str, end: str) -> Column:
    """What stands after the first mark up to the next end, stripped; null without the mark."""
    return F.when(F.contains(c, F.lit(mark)), strip(F.split_part(F.substring(c, F.instr(c, mark) + len(mark), F.length(c)), F.lit(end), F.lit(1))))


def clause_body(c: Column, fallback: Column | None = None) -> Column:
    """The clause in a prompt, between its triple quotes; without a marker the fallback, by default the whole text."""
    return F.coalesce(between(c, BODY_MARK, BODY_END), c if fallback is None else fallback)


def clause_body_before_answer(c: Column) -> Column:
    """The clause in a prompt up to the closing quotes that precede "Provide:"; null without markers."""
    return F.when(F.contains(c, F.lit('"""\n\nProvide:')), between(c, BODY_MARK, '"""\n\nProvide:'))


def clause_between_headings(c: Column) -> Column:
    """What stands between "Clause:" and "Provide:", without quotes."""
    return F.when(F.contains(c, F.lit("Clause:")), strip(F.replace(F.split_part(F.split_part(c, F.lit("Clause:"), F.lit(2)), F.lit("Provide:"), F.lit(1)), F.lit('"""'), F.lit(""))))


def explanation(c: Column) -> Column:
    """The explanation of the answer, up to the end of its turn; null without one."""
    return F.when(F.regexp_instr(c, F.lit(r"(?s)Explanation:\s*.*?<\|eot_id\|>")) > 0, F.regexp_extract(c, r"(?s)Explanation:\s*(.*?)<\|eot_id\|>", 1))


def with_explanation(c: Column, new: Column) -> Column:
    """The text with the last turn's explanation replaced; unchanged where the text does not end with one."""
    head = F.regexp_extract(c, r"(?s)^(.*Explanation:\s*)(?:(?!Explanation:).)*<\|eot_id\|>\s*$", 1)
    return F.when(head != "", F.concat(head, new, F.lit(TURN_END))).otherwise(c)


def unleaked(c: Column) -> Column:
    """The text with label words after the first "Explanation: " replaced, in the case they were written."""
    at = F.instr(c, EXPLANATION)
    head, tail = F.substring(c, F.lit(1), at + len(EXPLANATION) - 1), F.substring(c, at + len(EXPLANATION), F.length(c))
    for word, other in LEAKS:
        for pattern, put in ((word.upper(), other.upper()), (word.title(), other.title()), (f"(?i){word}", other)):
            tail = F.regexp_replace(tail, ("(?U)" if not pattern.startswith("(?i)") else "(?iU)") + rf"\b{pattern.removeprefix('(?i)')}\b", put)
    return F.when(at > 0, F.concat(head, tail)).otherwise(c)


def prompt_only(c: Column, mark: str = ASSISTANT + "\n\n") -> Column:
    """The text through the assistant's header; the whole text without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, F.lit(1), at + len(mark) - 1)).otherwise(c)


def prompt_cut(c: Column, mark: str = ASSISTANT) -> Column:
    """What stands before the assistant's header, and the header, which is added where it lacks."""
    return F.concat(F.split_part(c, F.lit(mark), F.lit(1)), F.lit(mark + "\n\n"))


def response_only(c: Column, mark: str = ASSISTANT + "\n\n") -> Column:
    """The text after the assistant's header; null without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c)))


def without_scratchpad(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<scratchpad>.*?</scratchpad>", ""))


def unquoted(c: Column) -> Column:
    """Without one pair of double quotes around the whole."""
    return F.regexp_replace(c, r'(?s)^"(.*)"$', "$1")


def last_object(c: Column) -> Column:
    """The last balanced {...} of a text, by a scan of its braces from the end; null without one, or where a { comes before any }.

    Braces within strings count like others.
    """
    # pieces that start with a brace each, but for the first; upto: where what is left ends
    pieces = F.split(c, "(?=[{}])")
    state = F.struct(F.length(c).alias("upto"), F.lit(0).alias("open"), F.lit(0).alias("end"), F.lit(0).alias("start"))

    def step(a: Column, piece: Column) -> Column:
        at, going = a["upto"] - F.length(piece) + 1, a["start"] == 0
        closing, opening = F.startswith(piece, F.lit("}")) & going, F.startswith(piece, F.lit("{")) & going
        return F.struct(
            (at - 1).alias("upto"),
            (a["open"] + F.when(closing, 1).when(opening, -1).otherwise(0)).alias("open"),
            F.when(closing & (a["open"] == 0), at).otherwise(a["end"]).alias("end"),
            F.when(opening & (a["open"] == 1), at).otherwise(a["start"]).alias("start"),
        )

    got = F.aggregate(F.reverse(pieces), state, step)
    return F.when(F.contains(c, F.lit("{")) & F.contains(c, F.lit("}")), F.when((got["start"] > 0) & (got["end"] > 0), F.substring(c, got["start"], got["end"] - got["start"] + 1)))


def snippet(c: Column, n: int, dots: bool = False) -> Column:
    """The first n characters on one line; with dots, those of a longer text are marked."""
    cut = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(cut, F.lit("..."))).otherwise(c) if dots else F.replace(cut, F.lit("\n"), F.lit(" "))


def mentioned_clauses(c: Column) -> Column:
    """Clause numbers that a question names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?iU)clause\s*(\d+)"), F.lit(1)), lambda x: x.try_cast("int")))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_rate_limit(message: Column) -> Column:
    """Whether an error speaks of a rate limit."""
    return F.lower(message).rlike(RATE_LIMIT)


def is_context_length(message: Column) -> Column:
    """Whether an error speaks of a context that is too long."""
    m = F.lower(message)
    got = m.rlike(CONTEXT_LENGTH)
    for a, b in CONTEXT_PAIRS:
        got = got | (F.contains(m, F.lit(a)) & F.contains(m, F.lit(b)))
    return got
