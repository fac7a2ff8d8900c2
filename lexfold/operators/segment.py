"""Lines to clauses: flags, blocks, merging, splitting and enrichment, all as scans over a document.

What a sequential pass would remember is a lag, a running sum or a last value. Every
step is keyed by source_file, so one shuffle serves windows over documents; with long,
documents are scanned chunk by chunk instead, and no task holds a whole one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DECIMAL_LABEL, PARTY_REFS, ROMAN, SUBPART_LABEL, inline_label, party_refs, strip, subpart_label, token_count
from ..storage import stored
from .order import chunked, cut, lag, last, medians, total, whole, windowed

# Line patterns of the data model, without lookaround.
HEADER = r"^(ARTICLE\s+\w+|SECTION\s+\d+|SCHEDULE\s+\w+|EXHIBIT\s+\w+|ANNEX\s+\w+|WHEREAS|NOW[,\s]+THEREFORE|IN WITNESS WHEREOF|RECITALS?|DEFINITIONS?|[A-Z][A-Z\s,;]{4,}[A-Z])$"
TOP_LEVEL = r"^\s*\d+\.(?:\s+\S|[^\s\d])"
TOP_LEVEL_SPACED = r"^\s*\d+\.\s+\S"
DECIMAL = r"^\s*\d+\.\d+\.?\d*[\s\S]"
SECTION_DECIMAL = r"^\s*(?:sub)?section\s+\d+\.\d+"
SUBPART = rf"^\s*(?:\((?:{ROMAN}|[a-z]|\d{{1,2}})\)|(?:{ROMAN}|[a-z])\.)\s*\S"
NUMBERED = r"^\s*(\d+\.\d*\.?\s+|[A-Z]\.\s+|\(\w+\)\s+)"
EIGHT_TOKENS = r"(?U)^\s*\S+(?:\s+\S+){7}"
SUBPART_BREAK = rf"(?<=[.;])\s*(\((?:{ROMAN}|[a-z]|\d{{1,2}})\)\s*|\d+\.\d+\.?\d*\s+|(?:sub)?section\s+\d+\.\d+[\. \d]*\.?\s*)"
# Lines that are no clause. The flag tells whether case matters.
BOILERPLATE = (
    (r"^\s*Page\s+\d+\s*(of\s+\d+)?\s*$", False),
    (r"^\s*-\s*\d+\s*-\s*$", True),
    (r"^\s*[—–]\s*\d+\s*[—–]\s*$", True),
    (r"^\s*\d{1,4}\s*$", True),
    (r"^\s*[ivxlcdmIVXLCDM]{1,6}\s*$", True),
    (r"^(Initialed|Signed|Date|Name|Title|Witnessed By)\s*[:\.]?", False),
    (r"^\s*\[.*?\]\s*$", True),
    (r"^(CONFIDENTIAL|PRIVILEGED AND CONFIDENTIAL|DRAFT)\s*$", False),
    (r"^(IN WITNESS WHEREOF|Signature Page)", False),
    (r"^By:\s*$", False),
    (r"^Exhibit\s+\d+[\.\d]*\s*$", False),
    (r"^(©|Copyright\s+\d{4}|All\s+Rights\s+Reserved)", False),
    (r"^\s*[\w\s\-]+\.pdf\s*$", False),
    (r"^Source\s*:", False),
)
OLDEST_BOILERPLATE = (
    (r"^\s*Page\s+\d+\s*(of\s+\d+)?\s*$", False),
    (r"^\s*-\s*\d+\s*-\s*$", True),
    (r"^(Source|Initialed|Signed|Date|Name|Title|Witnessed By)\s*[:\.]?", False),
    (r"^\s*\[.*?\]\s*$", True),
    (r"^(CONFIDENTIAL)\s*$", False),
    (r"^(IN WITNESS WHEREOF|Signature Page)", False),
    (r"^By:\s*$", False),
    (r"^Exhibit\s+\d+[\.\d]*\s*$", False),
)


@dataclass(frozen=True)
class Rules:
    """What the passes go by. The defaults are version 4's; older() gives versions 1 and 2."""

    header: str = HEADER
    top_level: str = TOP_LEVEL
    gap: float = 1.5
    height: float = 10.0
    numbered: bool = True
    sealed: bool = True
    min_tokens: int = 10
    preamble: str = "PREAMBLE"
    party_refs: str = PARTY_REFS
    boilerplate: tuple[tuple[str, bool], ...] = field(default=BOILERPLATE)

    @staticmethod
    def older(version: int) -> Rules:
        if version == 1:
            return Rules(numbered=False, sealed=False, boilerplate=OLDEST_BOILERPLATE)
        if version == 2:
            source = tuple((p.replace("(Initialed", "(Source|Initialed"), c) for p, c in BOILERPLATE)
            return Rules(top_level=TOP_LEVEL_SPACED, sealed=False, boilerplate=source)
        raise ValueError("versions 1 and 2 are older")


def is_header(text: Column, bold: Column, rules: Rules = Rules()) -> Column:
    """A heading by its words, or a short bold line in capitals."""
    t = strip(text)
    loud = bold & (F.length(t) < 65) & (F.upper(t) == t) & F.rlike(t, F.lit("(?U)[A-Z]")) & ~F.rlike(t, F.lit(EIGHT_TOKENS))
    return F.coalesce(t.rlike("(?U)" + rules.header) | loud, F.lit(False))


def is_top_level(text: Column, rules: Rules = Rules()) -> Column:
    return text.rlike("(?U)" + rules.top_level) if rules.numbered else F.lit(False)


def is_decimal(text: Column, rules: Rules = Rules()) -> Column:
    return (text.rlike("(?U)" + DECIMAL) | text.rlike("(?iU)" + SECTION_DECIMAL)) & ~is_top_level(text, rules)


def is_subpart(text: Column) -> Column:
    return text.rlike("(?iU)" + SUBPART)


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"(?U)[.;:]\s*$")


def is_boilerplate(text: Column, rules: Rules = Rules()) -> Column:
    hit = F.lit(False)
    for pattern, case in rules.boilerplate:
        hit = hit | text.rlike(("(?U)" if case else "(?iU)") + pattern)
    return hit


def is_noise(text: Column, min_length: int = 30) -> Column:
    """Paragraphs of an older segmentation that are no clause: short, page numbers, signature and source lines."""
    t = strip(text)
    # fixed values: what such paragraphs look like
    return (F.length(t) < min_length) | t.rlike(r"(?U)^[-–]?\s*\d+\s*[-–]?$") | t.rlike(r"(?iU)^(By|Name|Its|Title|Date)\s*:|^/s/|^_{3,}|^Source\s*:")


def flagged(lines: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Lines with is_header, is_subpart, is_decimal and sealed (whether a line opens a block of its own)."""
    t = F.col("text")
    df = lines.withColumns({"is_header": is_header(t, F.coalesce("bold", F.lit(False)), rules), "is_subpart": is_subpart(t), "is_decimal": is_decimal(t, rules), "is_top": is_top_level(t, rules)})
    sealed = (F.col("is_subpart") | F.col("is_decimal") | F.col("is_top")) if rules.sealed else F.col("is_top")
    return df.withColumn("sealed", sealed)


def with_blocks(lines: DataFrame, rules: Rules = Rules(), long: bool = False) -> DataFrame:
    """Flagged lines with block_no: a block breaks at a page, a wide gap, a header, after one, and at a sealed line."""
    df, order = flagged(lines, rules), ["line_no"]
    height, before = F.when(F.col("height") > 2, F.col("height")), {"__bottom": lag(F.col("bottom")), "__page": lag(F.col("page")), "__header": lag(F.col("is_header")), "__n": total(F.lit(1))}
    if long:
        df = stored(df, "flagged")
        df = chunked(cut(df, "source_file", order), "source_file", order, medians(df, "source_file", height).withColumnRenamed("median", "__median"), **before)
    else:
        df = windowed(df.withColumn("__median", F.percentile(height, 0.5).over(Window.partitionBy("source_file"))), "source_file", order, **before)
    wide = F.coalesce(F.col("top") - F.col("__bottom") > rules.gap * F.coalesce("__median", F.lit(rules.height)), F.lit(False))
    turned = F.coalesce(F.col("page") != F.col("__page"), F.lit(False))
    breaks = (F.col("__n") == 1) | turned | wide | F.col("is_header") | F.coalesce("__header", F.lit(False)) | F.col("sealed")
    df = df.withColumn("__break", breaks.cast("int")).drop("__median", "__bottom", "__page", "__header", "__n")
    walk = chunked if long else windowed
    return walk(df, "source_file", order, block_no=total(F.col("__break"))).withColumn("block_no", F.col("block_no").cast("int")).drop("__break", "__by", "__part")


def _joined(order: str, text: str = "text") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")


def blocks(lines: DataFrame, rules: Rules = Rules(), long: bool = False) -> DataFrame:
    """One row a block: its text, first page and top, last bottom, the first line's flags, and whether all of it is bold."""
    first = lambda c: F.min_by(c, "line_no").alias(c)
    return with_blocks(lines, rules, long).groupBy("source_file", "block_no").agg(
        _joined("line_no").alias("text"), first("page"), first("top"), F.max_by("bottom", "line_no").alias("bottom"), first("is_header"), first("is_subpart"), first("is_decimal"), F.every(F.coalesce("bold", F.lit(False))).alias("bold")
    )


def merged(blocks: DataFrame, rules: Rules = Rules(), long: bool = False) -> DataFrame:
    """Blocks with those that go on an unfinished sentence joined to it; block_no is the first one's.

    A block starts anew after or at a header or sealed block, after the end of a
    sentence, and where it is numbered.
    """
    walk, t, order = chunked if long else windowed, F.col("text"), ["block_no"]
    sealed = (F.col("is_subpart") | F.col("is_decimal")) if rules.sealed else F.lit(False)
    own = F.col("is_header") | sealed | t.rlike("(?U)" + NUMBERED) | is_top_level(t, rules)
    closed = F.col("is_header") | sealed | ends_sentence(t)
    df = blocks.withColumns({"__own": own, "__ends": closed})
    df = cut(stored(df, "blocks"), "source_file", order) if long else df
    df = walk(df, "source_file", order, __closed=lag(F.col("__ends")))
    df = walk(df, "source_file", order, __group=total((F.col("__own") | F.coalesce("__closed", F.lit(True))).cast("int")))
    first = lambda c: F.min_by(c, "block_no").alias(c)
    return df.groupBy("source_file", "__group").agg(
        _joined("block_no").alias("text"), F.min("block_no").alias("block_no"), first("page"), first("top"), F.max_by("bottom", "block_no").alias("bottom"), first("is_header"), first("is_subpart"), first("is_decimal"), F.every("bold").alias("bold")
    ).drop("__group")


def split(blocks: DataFrame) -> DataFrame:
    """Blocks cut before markers that follow a sentence's end; adds part_no from 0. Flags of the parts are read anew."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", "(?iU)" + SUBPART_BREAK, "\u0001$1"), "\u0001"), strip), lambda x: x != "")
    cut = F.size(parts) > 1
    df = blocks.withColumn("__parts", F.when(~F.col("is_header") & cut, parts)).withColumn("__cut", F.col("__parts").isNotNull())
    rest = [c for c in blocks.columns if c not in ("text", "is_subpart", "is_decimal")]
    df = df.select(*rest, "is_subpart", "is_decimal", "__cut", F.posexplode(F.coalesce("__parts", F.array("text"))).alias("part_no", "text"))
    sub = F.when(F.col("__cut"), F.col("text").rlike("(?iU)" + SUBPART_LABEL)).otherwise(F.col("is_subpart"))
    dec = F.when(F.col("__cut"), F.col("text").rlike("(?iU)" + DECIMAL_LABEL) & ~F.col("text").rlike("(?iU)" + SUBPART_LABEL)).otherwise(F.col("is_decimal"))
    return df.withColumn("is_decimal", dec).withColumn("is_subpart", sub).drop("__cut")


def enriched(blocks: DataFrame, rules: Rules = Rules(), long: bool = False) -> DataFrame:
    """Blocks (source_file, block_no, part_no, text, page, flags) to clauses.

    A clause's position counts kept clauses against all blocks that are no header,
    dropped ones too. A child's parent is the last clause before it that is none.
    """
    walk, order = chunked if long else windowed, ["block_no", "part_no"]
    df = blocks.withColumn("__clause", ~F.col("is_header") & ~is_boilerplate(F.col("text"), rules)).withColumn("text", strip(F.col("text"))).withColumn("token_count", token_count(F.col("text")))
    df = df.withColumn("__clause", F.coalesce(F.col("__clause") & (F.col("token_count") >= rules.min_tokens), F.lit(False))).withColumn("__child", F.col("is_subpart") | F.col("is_decimal"))
    df = df.withColumn("__header", F.when(F.col("is_header"), F.col("text"))).withColumn("text", F.when(F.col("__clause"), F.col("text")))
    df = cut(stored(df, "clauses"), "source_file", order) if long else df
    df = walk(df, "source_file", order, section_header=last(F.col("__header")), __total=whole((~F.col("is_header")).cast("long")), clause_id=total(F.col("__clause").cast("int")))
    df = df.where("__clause").withColumn("section_header", F.coalesce("section_header", F.lit(rules.preamble))).withColumn("clause_id", F.col("clause_id").cast("int"))
    share = F.col("clause_id") / F.greatest(F.col("__total"), F.lit(1))
    alone = F.when(~F.col("__child"), F.struct("clause_id", "section_header"))
    df = walk(df, "source_file", order, __parent=last(alone, before=True))
    parent = lambda c: F.when(F.col("__child"), F.col("__parent")[c])
    return df.select(
        "source_file", "clause_id", "text", "section_header", inline_label(F.col("text")).alias("inline_label"), "page",
        F.when(share < 0.25, "early").when(share >= 0.75, "late").otherwise("middle").alias("position"),
        party_refs(F.col("text"), rules.party_refs).alias("party_refs"), "token_count", "is_subpart", F.col("is_decimal").alias("is_decimal_section"),
        F.when(F.col("__child"), subpart_label(F.col("text"))).alias("subpart_label"), parent("clause_id").alias("parent_clause_id"), parent("section_header").alias("parent_clause_header"),
    )


def clauses(lines: DataFrame, rules: Rules = Rules(), long: bool = False) -> DataFrame:
    """All passes: lines to clauses. long: documents may be longer than a task should hold."""
    return enriched(split(merged(blocks(lines, rules, long), rules, long)), rules, long)


def documents(clauses: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row a document: its clauses in order, their number and its pages, the last clause's page if not given."""
    own = [c for c in clauses.columns if c != "source_file"]
    got = clauses.groupBy("source_file").agg(F.max("page").alias("total_pages"), F.count("*").cast("int").alias("clause_count"), F.array_sort(F.collect_list(F.struct(*own))).alias("clauses"))
    if pages is not None:
        got = got.drop("total_pages").join(pages.select("source_file", "total_pages"), "source_file", "left")
    return got.select("source_file", "total_pages", "clause_count", "clauses")


def paragraphs(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """An older segmentation: paragraphs between blank lines, each on one line. Adds paragraph_no from 1 and paragraph."""
    whole = F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), r"\n{2,}")
    one = F.transform(whole, lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""), " "))
    kept = F.filter(one, lambda p: p != "")
    return texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(kept).alias("__n", "paragraph")).withColumn("paragraph_no", F.col("__n") + 1).drop("__n")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain texts as lines of one page without geometry; empty lines are left out."""
    df = docs.select(F.col(id_col).cast("string").alias("source_file"), F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")).alias("line_no", "text"))
    nothing = F.lit(None).cast("double")
    return df.where(strip(F.col("text")) != "").select("source_file", "line_no", "text", F.lit(1).alias("page"), nothing.alias("top"), nothing.alias("bottom"), nothing.alias("height"), F.lit(False).alias("bold"), nothing.alias("size"))
