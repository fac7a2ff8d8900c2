"""Analysis sessions and chat histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentioned_clauses, snippet, strip
from .order import running


def histories(turns: DataFrame, session: str = "session_id", order: str = "turn", last: int | None = None, characters: int | None = None) -> DataFrame:
    """turns with history: the (turn, role, content) of the session before, all of them or the last ones.

    All of them take room with the square of a session's turns, as a model's requests
    do: for sessions that people write. Longer ones need a bound: last turns and, of
    these, as many from the end as have so many characters together, as a model's
    context has room for.
    """
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding if last is None else -last, -1)
    got = turns.withColumn("history", F.collect_list(F.struct(F.col(order).alias("turn"), "role", "content")).over(before))
    if characters is None:
        return got
    size = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda n, x: n + F.length(F.coalesce(x["content"], F.lit(""))))
    fits = lambda _, i: size(F.slice("history", i + 1, F.size("history"))) <= characters
    return got.withColumn("history", F.filter("history", fits))


def requests(turns: DataFrame, is_request: Column, last: int, characters: int | None = None, session: str = "session_id", order: str = "turn") -> DataFrame:
    """The turns that ask a model something, with the history that it is shown; other turns carry no history anywhere."""
    return histories(turns, session, order, last, characters).where(is_request)


def sessions(events: DataFrame, user: str, order: str, is_reset: Column) -> DataFrame:
    """events with session_no: a reset starts a new session; events before the first are 0."""
    return running(events, user, [order], session_no=is_reset.cast("int"))


def relevant(results: DataFrame, question: Column) -> DataFrame:
    """Analysis results to talk about: those whose output says high anywhere, and those that the question names."""
    return results.where(F.contains(F.lower("model_output"), F.lit("high")) | F.coalesce(F.array_contains(mentioned_clauses(question), F.col("clause_index")), F.lit(False)))


# The wording of the summary, of a question with its references, and of the system prompt.
COUNSEL = (
    "You are a legal AI assistant helping analyze a contract.\n"
    "You will be given:\n"
    "  1. A summary of the initial risk analysis of the contract clauses.\n"
    "  2. Reference clauses retrieved from a legal database relevant to the question.\n"
    "  3. The conversation history so far.\n\n"
    "Rules:\n"
    "  - Always analyze from the perspective of the {role}.\n"
    "  - Ground your answers in the retrieved reference clauses wherever possible.\n"
    "  - If the references don't cover the question, say so rather than guessing.\n"
    "  - Be concise and specific. Avoid generic legal disclaimers."
)


def summary_line(clause_index: Column, output: Column, text: Column) -> Column:
    """A result as a line of the summary."""
    return F.concat(F.lit("  Clause "), clause_index.cast("string"), F.lit(": "), strip(F.split_part(output, F.lit("\n"), F.lit(1))), F.lit(' | "'), snippet(text, 80), F.lit('..."'))


def first_k(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= k).drop("__n")


def question_with_context(question: Column, contexts: Column) -> Column:
    """A question after the clauses that were retrieved for it; contexts is an array of texts."""
    some = F.when(F.size(contexts) > 0, F.array_join(contexts, "\n\n")).otherwise("No closely matching reference clauses found.")
    return F.concat(F.lit("RELEVANT REFERENCE CLAUSES (retrieved for this question):\n"), some, F.lit("\n\nQUESTION:\n"), question)


def messages(system: Column, history: Column, question: Column) -> Column:
    """What a chat model is given: the system message, the history's (role, content), the question."""
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    past = F.transform(history, lambda h: F.struct(h["role"].alias("role"), h["content"].alias("content")))
    return F.concat(one("system", system), past, one("user", question))


def system_prompt(role: Column, summary: Column) -> Column:
    """What a chat model is told: its rules, whose side it takes, and the summary of the analysis (an array of lines)."""
    lines = F.when(F.size(summary) > 0, F.array_join(summary, "\n")).otherwise("  No high-risk clauses identified.")
    return F.concat(F.replace(F.lit(COUNSEL), F.lit("{role}"), role), F.lit("\n\nCONTRACT ANALYSIS SUMMARY ("), role, F.lit(" perspective):\n"), lines)


def turn(questions: DataFrame, results: DataFrame, references: DataFrame, role: Column, history: DataFrame | None = None) -> DataFrame:
    """session_id and messages of one turn: system prompt with the summary, the history, the question after its references.

    questions: (session_id, question), a row a session; results: (session_id, clause_index,
    clause_text, model_output), what the session's analysis found; references: (session_id,
    rank, text), retrieved for the question; history: (session_id, turn, role, content).
    """
    asked = questions.select("session_id", "question")
    named = F.coalesce(F.array_contains(mentioned_clauses(F.col("question")), F.col("clause_index")), F.lit(False))
    told = results.join(asked, "session_id").where(F.contains(F.lower("model_output"), F.lit("high")) | named)
    told = told.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("clause_index", summary_line(F.col("clause_index"), F.col("model_output"), F.col("clause_text")).alias("line")))).alias("told"))
    found = references.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found"))
    df = asked.join(told, "session_id", "left").join(found, "session_id", "left")
    past = F.array().cast("array<struct<turn:int,role:string,content:string>>")
    if history is not None:
        before = history.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), "role", "content"))).alias("past"))
        df, past = df.join(before, "session_id", "left"), F.coalesce("past", past)
    some = lambda c, field, kind: F.coalesce(F.transform(c, lambda x: x[field]), F.array().cast(f"array<{kind}>"))
    system = system_prompt(role, some(F.col("told"), "line", "string"))
    return df.select("session_id", messages(system, past, question_with_context(F.col("question"), some(F.col("found"), "text", "string"))).alias("messages"))
