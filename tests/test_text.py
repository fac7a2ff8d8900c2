"""Text functions and label readers against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexfold.functions import labels as L
from lexfold.functions import prompts as P
from lexfold.functions import text as X


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


OUTPUTS = [
    "Risk Level: high", "The risk is not low but HIGH", "highlight", "below average", "", "Risk Level: Low\nmore\nRisk Level: High", "I think medium. Risk Level: Low", "MEDIUM", "risk level : HIGH",
    "Risk Level:  Medium \nExplanation: because", "no label", "highly risky", "Low\nHigh", "Risk Level: low.",
]


def word(pattern, s, flags=re.I):
    m = re.search(pattern, s, flags)
    return m.group(1) if m else None


def test_label_readers(spark):
    def priority(s):
        return next((w for w in ("high", "medium", "low") if re.search(rf"\b{w}\b", s.lower())), None)

    def marked(s):
        return (word(r"Risk Level:\s*(Low|Medium|High)", s) or word(r"\b(Low|Medium|High)\b", s) or "Unknown").capitalize()

    def terminal(s):
        m = word(r"Risk Level:\s*(Low|High)\s*$", s, re.I | re.M)
        every = re.findall(r"\b(Low|High)\b", s, re.I)
        return (m or (every[-1] if every else "Unknown")).capitalize()

    def binary(s):
        return word(r"RISK LEVEL\s*:\s*(HIGH|LOW)", s.upper()) or word(r"\b(HIGH|LOW)\b", s.upper()) or "UNKNOWN"

    def part(s):
        return (word(r"\b(Low|Medium|High)\b", s) or next((w for w in ("high", "medium", "low") if w in s.lower()), "Unknown")).capitalize()

    for f, g in ((L.by_priority, priority), (L.marked_or_first, marked), (L.terminal_or_last, terminal), (L.upper_binary, binary), (L.word_or_part, part)):
        assert column(spark, OUTPUTS, f) == [g(s) for s in OUTPUTS], f.__name__


def test_served_takes_the_last_lines(spark):
    got = column(spark, ["Risk Level: Low\nExplanation: fine", "Risk Level: Low\nrisk level: none\nexplanation: a\nExplanation: b", "free text", "  Risk Level: quite LOW "], L.served)
    assert [tuple(r) for r in got] == [("Low", "fine"), ("High", "b"), ("High", "free text"), ("Low", "Risk Level: quite LOW")]


def test_stand_in(spark):
    got = column(spark, ["The Licensee shall INDEMNIFY", "on notice", "hello"], lambda c: L.stand_in(c, F.lit("Licensee")))
    assert [r["risk"] for r in got] == ["High", "Medium", "Low"] and all("for Licensee." in r["explanation"] for r in got)


def test_labelled_answer(spark):
    got = column(spark, ["<scratchpad>High</scratchpad>Risk Level: low\nExplanation: ok " + "x" * 500, "Risk Level: Low", ""], L.labelled)
    assert got[0]["risk"] == "Low" and len(got[0]["explanation"]) == 400 and got[1] is None and got[2] is None


def last_object(s):
    depth = end = start = None
    depth = 0
    for i in range(len(s) - 1, -1, -1):
        if s[i] == "}":
            end = i if depth == 0 else end
            depth += 1
        elif s[i] == "{":
            depth -= 1
            if depth == 0:
                start = i
                break
    return None if start is None or end is None else s[start : end + 1]


def test_last_object(spark):
    random.seed(3)
    texts = ["", "{}", 'x {"a": {"b": 1}} y', "{ only", "only }", '{"a": 1} then {"b": 2} end', '{"a": "}"}', "} {"] + ["".join(random.choice("{}ab ") for _ in range(12)) for _ in range(200)]
    assert column(spark, texts, X.last_object) == [last_object(t) for t in texts]


def test_bodies_and_explanations(spark):
    rows = [('user Clause:\n"""\n A b \n"""\n\nProvide: x',), ("none",), ('Clause:\n"""  """ t',)]
    texts = [r[0] for r in rows]
    assert column(spark, texts, lambda c: X.clause_body(c, F.lit("X"))) == ["A b", "X", ""]
    assert column(spark, texts, X.clause_body)[1] == "none"
    assert column(spark, texts, X.clause_body_before_answer) == ["A b", None, None]
    assert column(spark, texts, X.clause_between_headings) == ["A b", None, "t"]
    full = "q Explanation: old a<|eot_id|>x Explanation: old b $1 \\2<|eot_id|>"
    assert column(spark, [full, "none"], X.explanation) == ["old a", None]
    assert column(spark, [full, "none"], lambda c: X.with_explanation(c, F.lit("new $1 \\d"))) == ["q Explanation: old a<|eot_id|>x Explanation: new $1 \\d<|eot_id|>", "none"]


def test_unleaked_keeps_case_and_head(spark):
    assert column(spark, ["High Explanation: HIGH High high hIgH highly LOW Medium", "low only"], X.unleaked) == ["High Explanation: SIGNIFICANT Significant significant significant highly MINIMAL Moderate", "low only"]


@pytest.mark.parametrize(
    "text,label",
    [("(a) x", "(a)"), ("(iv) x", "(iv)"), ("ii. x", "ii."), ("U.S. dollars", "U."), ("2.1 x", "2.1"), ("Section 3.2. x", "3.2."), ("(xlii) x", None), ("plain", None), ("(12) x", "(12)")],
)
def test_subpart_labels(spark, text, label):
    assert column(spark, [text], X.subpart_label) == [label]


def test_small_functions(spark):
    assert column(spark, ["  a \n"], X.strip) == ["a"]
    assert column(spark, ["a  b\n c", "", " "], X.token_count) == [3, 0, 0]
    assert column(spark, ["The Parties and the parties; LICENSOR"], X.party_refs) == [["licensor", "the parties"]]
    assert column(spark, ["GRANT OF RIGHTS: we", "No: x"], X.inline_label) == ["GRANT OF RIGHTS", None]
    assert column(spark, ['"a"', 'a"'], X.unquoted) == ["a", 'a"']
    assert column(spark, ["clause 3, Clause4 and clause 3"], X.mentioned_clauses) == [[3, 4]]
    assert column(spark, ["Error 429", "Too long", "context of great length", "reduce the tokens", "fine"], lambda c: F.struct(X.is_rate_limit(c), X.is_context_length(c))) == [(True, False), (False, True), (False, True), (False, True), (False, False)]
    assert column(spark, ["a" * 5], lambda c: X.snippet(c, 3, dots=True)) == ["aaa..."]
    assert column(spark, ["x<|start_header_id|>assistant<|end_header_id|>\n\ny", "z"], X.prompt_cut) == ["x<|start_header_id|>assistant<|end_header_id|>\n\n", "z<|start_header_id|>assistant<|end_header_id|>\n\n"]
    assert column(spark, ["c"], lambda c: P.one_word_request(c, F.lit("Licensor")))[0].endswith('"""c"""\n\nRisk level for Licensor:')
