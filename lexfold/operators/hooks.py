"""Models as hooks: callables over pandas batches, with deterministic stand-ins.

A hook is loaded once a worker, by its factory, and called a batch at a time.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import served, stand_in
from ..functions.text import CONTEXT_LENGTH, CONTEXT_PAIRS, RATE_LIMIT
from ..schemas import ANNOTATION
from ..storage import bounded
from .limiter import STOPPED, Limiter, paced

#: Makes a function from texts to outputs.
Factory = Callable[[], Callable[[list[str]], list[str]]]


def generated(rows: DataFrame, prompt: str, factory: Factory, output: str = "raw_output", retries: int = 1, wait_s: float = 0.0, error: str | None = None, patient: bool = True) -> DataFrame:
    """rows with a model's output for the prompt column; after the last retry the output is null, and error, if named, says why.

    Where a batch fails its texts are tried one by one, so one bad text costs none of
    the others. A text that is too long is not tried again. Unless patient, a task
    stops calling the model once a text has met the rate limit on its last try.
    Python gets the prompts alone, few at a time.
    """
    bounded(rows.sparkSession)
    limited, lengthy = re.compile(RATE_LIMIT).search, re.compile(CONTEXT_LENGTH).search
    too_long = lambda said: lengthy(said) or any(a in said and b in said for a, b in CONTEXT_PAIRS)

    @F.pandas_udf("output string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, stopped = factory(), None

        def one(text: str) -> tuple[str | None, str | None]:
            nonlocal stopped
            if stopped:
                return None, stopped
            said = ""
            for attempt in range(1 + retries):
                try:
                    return model([text])[0], None
                except Exception as e:
                    said = str(e) or type(e).__name__
                    if too_long(said.lower()):
                        break
                    if attempt < retries:
                        time.sleep(wait_s * (attempt + 1))
            if not patient and limited(said.lower()):
                stopped = said
            return None, said

        for b in batches:
            texts = b.tolist()
            try:
                if stopped:
                    raise RuntimeError(stopped)
                got = [(x, None) for x in model(texts)]
                if len(got) != len(texts):
                    raise RuntimeError("the model answered another number of texts")
            except Exception:
                got = [one(t) for t in texts]
            yield pd.DataFrame({"output": pd.Series([x for x, _ in got], dtype=object), "error": pd.Series([e for _, e in got], dtype=object)})

    # a model may answer otherwise when asked again
    got = rows.withColumn("__got", run.asNondeterministic()(F.col(prompt)))
    put = {output: F.col("__got")["output"]} | ({error: F.col("__got")["error"]} if error else {})
    return got.withColumns(put).drop("__got")


def classified(clauses: DataFrame, role: str, factory: Factory | None = None, text_col: str = "text") -> DataFrame:
    """clauses with risk and explanation for a role: the model's, or the stand-in's without one."""
    if factory is None:
        return clauses.withColumn("__a", stand_in(F.col(text_col), F.lit(role))).select("*", "__a.risk", "__a.explanation").drop("__a")
    from ..functions.prompts import classification_request

    df = generated(clauses.withColumn("__p", classification_request(F.col(text_col), F.lit(role))), "__p", factory, "__o")
    return df.withColumn("__a", served(F.coalesce("__o", F.lit("")))).select("*", "__a.risk", "__a.explanation").drop("__a", "__o", "__p")


def annotated(clauses: DataFrame, factory: Factory | None = None, retries: int = 1, wait_s: float = 0.0, limiter: Limiter | None = None) -> DataFrame:
    """clauses (clause_index, clause_text) as annotations.

    Status: success; json_error where no object parses; context_too_long, to be
    skipped; rate_limited, where the model refused on the last try and its task
    stopped calling it; api_error otherwise. error is the model's own message. With a
    limiter all tasks keep to one timetable, and all of them stop calling the model once
    it has refused as often as the limiter says; rows that were not called are
    rate_limited too, and for another run.
    """
    from ..functions.prompts import annotation_request
    from ..functions.text import is_context_length, is_rate_limit, last_object

    if factory is None:
        parties = F.map_from_arrays(F.array(F.lit("Licensor"), F.lit("Licensee")), F.array(*(F.struct(stand_in(F.col("clause_text"), F.lit(r))["risk"].alias("risk"), stand_in(F.col("clause_text"), F.lit(r))["explanation"].alias("explanation")) for r in ("Licensor", "Licensee"))))
        df = clauses.withColumn("raw_response", F.to_json(F.struct(parties.alias("parties")))).withColumn("error", F.lit(None).cast("string"))
    elif limiter is not None:
        df = paced(clauses.withColumn("__p", annotation_request(F.col("clause_text"))), "__p", "clause_index", factory, limiter, "raw_response", "error", 1 + retries)
    else:
        df = generated(clauses.withColumn("__p", annotation_request(F.col("clause_text"))), "__p", factory, "raw_response", retries, wait_s, "error", patient=False)
    party = "map<string,struct<risk:string,explanation:string,trigger_quote:string,evidence_quote:string>>"
    parsed = F.from_json(last_object(F.col("raw_response")), f"parties {party}")["parties"]
    said = F.coalesce("error", F.lit("no response"))
    failed = F.when(is_context_length(said), "context_too_long").when(is_rate_limit(said) | (said == STOPPED), "rate_limited").otherwise("api_error")
    status = F.when(F.col("raw_response").isNull(), failed).when(parsed.isNull(), "json_error").otherwise("success")
    names = [c.split()[0] for c in ANNOTATION.split(", ")]
    df = df.withColumn("parties", parsed).withColumn("status", status).withColumn("error", F.when(F.col("raw_response").isNull(), said))
    return df.withColumn("clause_index", F.col("clause_index").cast("int")).select(*names)


def hashing_embedder(dim: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A stand-in embedder: words hashed to signed places, unit length."""

    def make() -> Callable[[list[str]], list[list[float]]]:
        import zlib

        import numpy as np

        def embed(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 16 & 1 else -1
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(size > 0, size, 1)).tolist()

        return embed

    return make


def embedded(rows: DataFrame, text_col: str, factory=None, prefix: str = "", unit: bool = True) -> DataFrame:
    """rows with embedding, of unit length unless the model's own is asked for; prefix is for queries alone. A vector of zeros stays one."""
    bounded(rows.sparkSession)
    make = factory or hashing_embedder()

    def sized(vectors: list) -> list:
        import numpy as np

        m = np.asarray(vectors, float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        off = (np.abs(size - 1) > 1e-6) & (size > 0)
        return np.where(off, m / np.where(size > 0, size, 1), m).tolist()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            got = model([prefix + (t or "") for t in texts])
            yield pd.Series(sized(got) if unit and len(got) else got)

    return rows.withColumn("embedding", embed(F.col(text_col)))


def rephrased(rows: DataFrame, factory: Factory | None = None, explanation: str = "explanation", retries: int = 5) -> DataFrame:
    """rows with rephrased: the model's wording, or the original where it fails."""
    if factory is None:
        return rows.withColumn("rephrased", F.col(explanation))
    from ..functions.text import unquoted

    return generated(rows, explanation, factory, "rephrased", retries).withColumn("rephrased", F.coalesce(unquoted(F.trim("rephrased")), F.col(explanation)))
