"""What a model's Python worker holds at once."""

from pyspark.sql import functions as F

from lexfold.operators import hooks


def test_a_model_gets_few_prompts_at_a_time(spark):
    sizes = lambda: lambda prompts: [str(len(prompts))] * len(prompts)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        df = spark.range(0, 3000, 1, 1).select("id", F.lit("p").alias("p"), F.lit("wide").alias("text"))
        got = hooks.generated(df, "p", sizes, "said", error="why")
        assert got.columns == ["id", "p", "text", "said", "why"]
        rows = got.collect()
        assert [r["id"] for r in rows] == list(range(3000)) and max(int(r["said"]) for r in rows) <= 512
        assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # other columns stay in the JVM
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_last_object_steps_from_brace_to_brace(spark):
    """A step a brace, not a step a character, each of which would look for its place from the text's start."""
    from lexfold.functions.text import last_object

    texts = {"x" * 300_000 + ' {"é": {"b": 1}} y' + "z" * 300_000: '{"é": {"b": 1}}', "{a}} {": "{a}", "} {": None, "{": None, "}{}": "{}", "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", last_object(F.col("t")).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == texts
    assert "sequence(" not in df._jdf.queryExecution().analyzed().toString()


def test_annotations_get_few_prompts_at_a_time(spark):
    def sizes():
        return lambda prompts: ['{"parties": {"Licensor": {"risk": "%d"}}}' % len(prompts)] * len(prompts)

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        df = spark.range(0, 2000, 1, 1).select(F.col("id").alias("clause_index"), F.lit("t").alias("clause_text"))
        got = hooks.annotated(df, sizes).select(F.col("parties")["Licensor"]["risk"].cast("int").alias("n")).collect()
        assert len(got) == 2000 and max(r["n"] for r in got) <= 512
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
