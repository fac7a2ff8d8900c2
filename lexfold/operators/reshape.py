"""Between annotations, parties, examples and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.labels import merged


def party_rows(annotations: DataFrame) -> DataFrame:
    """A row a clause and party: clause_index, clause_text, party, risk, explanation."""
    return annotations.select("clause_index", "clause_text", F.explode("parties").alias("party", "p")).select("clause_index", "clause_text", "party", F.col("p.risk").alias("risk"), F.col("p.explanation").alias("explanation"))


def evaluation_rows(annotations: DataFrame) -> DataFrame:
    """party_rows of non-empty clauses with lower-cased risks."""
    return party_rows(annotations.where("status = 'success' and trim(clause_text) <> ''")).withColumn("risk", F.lower("risk"))


def constant_risk(clauses: DataFrame, parties: tuple[str, ...] = ("Licensor", "Licensee"), risk: str = "High", why: str = "This %s clause exposes the %s to risk.") -> DataFrame:
    """Each clause (clause_index, clause_text, clause_type) for each party with one risk and a templated explanation."""
    df = clauses.withColumn("party", F.explode(F.array(*map(F.lit, parties))))
    return df.withColumn("risk", F.lit(risk)).withColumn("explanation", F.format_string(why, F.col("clause_type"), F.col("party")))


def examples(rows: DataFrame, source: str | None = None) -> DataFrame:
    """party_rows as training examples: text and _meta."""
    text = prompts.training_text(F.col("clause_text"), F.col("party"), F.col("risk"), F.col("explanation"))
    meta = F.struct(F.col("clause_index").cast("int").alias("clause_index"), "party", "risk", F.lit(source).cast("string").alias("source"))
    return rows.select(text.alias("text"), meta.alias("_meta"))


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("text", "_meta.*")


def _of(party: str, name: str, default: str) -> Column:
    return F.coalesce(F.col("parties")[party][name], F.lit(default))


def chunks(annotations: DataFrame) -> DataFrame:
    """Successful annotations as retrieval chunks, parties side by side; defaults are Unknown and the empty string."""
    df = annotations.where("status = 'success'").select(
        F.concat(F.lit("clause_"), F.col("clause_index").cast("string")).alias("chunk_id"), F.col("clause_text").alias("raw_clause"),
        _of("Licensor", "risk", "Unknown").alias("licensor_risk"), _of("Licensee", "risk", "Unknown").alias("licensee_risk"),
        _of("Licensor", "explanation", "").alias("licensor_explanation"), _of("Licensee", "explanation", "").alias("licensee_explanation"), "clause_index",
    )
    return df.withColumn("enriched_text", prompts.enriched(F.col("raw_clause"), F.col("licensor_risk"), F.col("licensee_risk")))


def for_role(chunks: DataFrame, role: Column) -> DataFrame:
    """chunks with risk and explanation of the role's party."""
    own = lambda c: F.when(role == "Licensor", F.col(f"licensor_{c}")).otherwise(F.col(f"licensee_{c}"))
    return chunks.withColumn("risk", own("risk")).withColumn("explanation", own("explanation"))


def merged_labels(annotations: DataFrame, source: str = "Medium", target: str = "High") -> DataFrame:
    """annotations with a risk renamed for every party."""
    return annotations.withColumn("parties", F.transform_values("parties", lambda _, p: p.withField("risk", merged(p["risk"], source, target))))


def conversions(annotations: DataFrame, source: str = "Medium") -> DataFrame:
    """How many risks merged_labels renames, by party."""
    return party_rows(annotations).groupBy("party").agg(F.count_if(F.col("risk") == source).alias("converted"))
