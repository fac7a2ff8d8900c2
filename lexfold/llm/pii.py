"""Personal data by patterns, checksums and context words, in DataFrame operations alone.

Regular expressions propose spans; validators (digit counts, octets, Luhn, mod 97)
confirm them; words near a span adjust its score. Email, ip, card and phone spans
that their validators confirm always stay. The method adds IBANs, social security
numbers and secrets, each kept from a score of ``THRESHOLD``.

Matches and the text between them come from one pattern, so a match's place is
the summed length of what stands before it, in code points. Sums go by blocks of
matches and context is read from the pieces beside a match, so that a text with
very many matches is not read again for each. The patterns below find the
contract's leftmost matches with linear work on any text: a run of a class is
entered at its start only and left without going back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
THRESHOLD = 0.6
#: Code points before a span that are searched for context words: in the piece before it, the match before and the piece before that.
NEAR = 40
#: Matches whose lengths are summed at once.
BLOCK = 64

PATTERNS = {
    # entered at a run's start or where the last match ended
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # whole runs of 13 to 19 digits, single spaces and hyphens between them
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # a name of a secret, an assignment with or without spaces and quotes, and all up to the next space
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|api_?key|(?:access|auth)_token|token)[\"']?[ \t]{0,8}[=:][ \t]{0,8}[^\x00-\x20]{8,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
}
#: What a text must contain for the pattern to be worth a search.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
#: Score of a confirmed span by itself, and with a context word near.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.7}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|mastercard",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "secret": "login|user|config|env|credential",
}
CONTEXT_ADDS = 0.3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes ISO 7064's mod 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).substr(1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return (F.length(F.replace(m, F.lit(" "), F.lit(""))) <= 34) & mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _pieces(df: DataFrame, kind: str) -> DataFrame:
    """Adds __g, the text between the matches of a kind, __m, the matches, and __s, a span with its score for each match, null where it is not confirmed."""
    pattern, text = PATTERNS[kind], F.col("__t")
    worth = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    df = df.withColumn("__m", F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)).otherwise(F.array(text)))
    df = df.withColumn("__n", F.expr("transform(__m, (x, i) -> length(__g[i]) + length(x))"))
    # sums of lengths over blocks, then over the blocks before each, then up to each match in its block
    total = lambda of, first, end: f"case when {first} < {end} then aggregate(sequence({first}, {end} - 1), 0L, (a, y) -> a + {of}[y]) else 0L end"
    df = df.withColumn("__b", F.expr(f"transform(sequence(0, greatest(0, size(__n) - 1) div {BLOCK}), j -> {total('__n', f'j * {BLOCK}', f'least(size(__n), (j + 1) * {BLOCK})')})"))
    df = df.withColumn("__b", F.expr(f"transform(__b, (x, j) -> {total('__b', '0', 'j')})"))
    # __b is named twice so that the optimizer keeps it a column instead of summing anew for each match
    start = f"__b[least(i div {BLOCK}, size(__b) - 1)] + {total('__n', f'i - i % {BLOCK}', 'i')} + length(__g[i])"
    near = f"right(concat(case when i > 0 then concat(__g[i - 1], __m[i - 1]) else '' end, __g[i]), {NEAR})"
    df = df.withColumn("__p", F.expr(f"transform(__m, (x, i) -> named_struct('m', x, 'start', {start}, 'near', {near}))"))

    def span(x: Column) -> Column:
        found = F.lower(x["near"]).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])")
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(found, CONTEXT_ADDS).otherwise(0.0))
        own = F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), score.alias("score"))
        return F.when(_confirmed(kind, x["m"]) & ((score >= THRESHOLD) if kind in ADDED else F.lit(True)), own)

    return df.withColumn("__s", F.transform("__p", span)).drop("__n", "__b", "__p")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, score), by kind, then start, for every row.

    A null text is empty. Very long texts and those of very many matches are read
    whole. Repeated rows return a row each; other columns are ignored, whatever
    their names; an empty table returns no row.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    for kind in BASE + ADDED:
        df = _pieces(df, kind).withColumn(f"__{kind}", F.array_compact("__s")).drop("__g", "__m", "__s")
    return df.select("doc_id", F.concat(*(F.col(f"__{k}") for k in BASE + ADDED)).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every found match of each kind replaced by <KIND>; kinds in order.

    Works kind by kind on the text that the last one left. Other cases as in found.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    for kind in BASE + ADDED:
        parts = F.expr(f"transform(arrays_zip(__g, __m, __s), x -> concat(x.__g, case when x.__m is null then '' when x.__s is null then x.__m else '<{kind.upper()}>' end))")
        df = _pieces(df, kind).select("doc_id", F.array_join(parts, "").alias("__t"))
    return df.select("doc_id", F.col("__t").alias("text"))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, spans), then the added kinds' counts and the spans' scores."""

    def text(kinds: tuple[str, ...]) -> Column:
        own = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",").alias("scores")
    return spans.select("doc_id", *map(count, BASE), F.sha2(text(BASE).cast("binary"), 256).alias("base_sha256"), text(BASE + ADDED).alias("spans"), *map(count, ADDED), scores)
