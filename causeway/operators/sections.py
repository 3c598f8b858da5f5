"""Section tags of report paragraphs: detection, forward fill over a document, and record levels.

Scale: detection is a column expression. The forward fill needs the order of a whole document, one window by
document; its rows are small (tags only are carried), and documents are bounded by their pages. Null
documents are a document of their own; ties in the order go to the row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.patterns import bind, strip, unicode
from causeway.functions.text_predicates import is_good_sentence, is_long_enough, keeps_paragraph, is_contents_page
from causeway.functions.text_transforms import SUBSECTION, clean, paragraphs, sentences, truncate_title

# Headings of the reporting standard: pattern, code, category, name; the first match counts.
SECTIONS = (
    (r"^(?:ESRS\s+2|General\s+[Dd]isclosures)", "ESRS2", "General", "General Disclosures"),
    (r"^(?:ESRS\s+)?E1[\s\-–].*(?:Climate|climate)", "E1", "E", "Climate Change"),
    (r"^(?:ESRS\s+)?E2[\s\-–].*(?:Pollution|pollution)", "E2", "E", "Pollution"),
    (r"^(?:ESRS\s+)?E3[\s\-–].*(?:Water|water)", "E3", "E", "Water and Marine Resources"),
    (r"^(?:ESRS\s+)?E4[\s\-–].*(?:Biodiversity|biodiversity)", "E4", "E", "Biodiversity and Ecosystems"),
    (r"^(?:ESRS\s+)?E5[\s\-–].*(?:Resource|resource|Circular|circular)", "E5", "E", "Resource Use and Circular Economy"),
    (r"^(?:ESRS\s+)?S1[\s\-–].*(?:Own\s+[Ww]orkforce|workforce)", "S1", "S", "Own Workforce"),
    (r"^(?:ESRS\s+)?S2[\s\-–].*(?:Workers|workers|Value\s+Chain|value\s+chain)", "S2", "S", "Workers in the Value Chain"),
    (r"^(?:ESRS\s+)?S3[\s\-–].*(?:Affected|affected|Communities|communities)", "S3", "S", "Affected Communities"),
    (r"^(?:ESRS\s+)?S4[\s\-–].*(?:Consumers|consumers|End[\s-]Users|end[\s-]users)", "S4", "S", "Consumers and End Users"),
    (r"^(?:ESRS\s+)?G1[\s\-–].*(?:Business|business|Conduct|conduct)", "G1", "G", "Business Conduct"),
    (r"^EU\s+Taxonomy\b", "EU-Tax", "General", "EU Taxonomy"),
)
#: The section of paragraphs before any heading, and of the general sub-section prefixes.
DEFAULT = SECTIONS[0][1:]
GENERAL_PREFIXES = ("GOV", "SBM", "IRO", "BP", "MDR")


def _tag(row: tuple[str, str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("section", "category", "section_name"))])


def detect_section(text: Column) -> Column:
    """SEC-1: struct(section, category, section_name) of a heading within the first 100 characters, else null."""
    def of(head: Column) -> Column:
        found = None
        for pattern, *row in SECTIONS:
            test = head.rlike(unicode(pattern, ignore_case=True))
            found = F.when(test, _tag(tuple(row))) if found is None else found.when(test, _tag(tuple(row)))
        return found

    return bind(F.substring(strip(text), 1, 100), of)


def detect_subsection(text: Column) -> Column:
    """SEC-2: struct(code, title) of a sub-section heading within the first 200 characters, else null."""
    pattern = unicode(SUBSECTION, ignore_case=True)

    def of(head: Column) -> Column:
        code, title = F.upper(F.regexp_extract(head, pattern, 1)), F.regexp_extract(head, pattern, 2)
        return F.when(head.rlike(pattern), F.struct(code.alias("code"), bind(title, lambda t: truncate_title(t)).alias("title")))

    return bind(F.substring(strip(text), 1, 200), of)


def parent_section(code: Column) -> Column:
    """SEC-3: the section a sub-section code belongs to."""
    def of(prefix: Column) -> Column:
        found = F.when(prefix.isin(*GENERAL_PREFIXES), _tag(DEFAULT))
        for _, *row in SECTIONS[1:-1]:
            found = found.when(prefix == row[0], _tag(tuple(row)))
        return found

    return bind(F.regexp_extract(code, r"^([A-Z]+\d?)", 1), of)


def tag_paragraphs(rows: DataFrame, document: str, order: list[str], text: str = "text") -> DataFrame:
    """SEC-4: section and sub-section of each paragraph, carried over pages until the next heading.

    One shuffle by document and one sort serve this and ``records``. A document is one report: rows without one must be given documents of their own.

    ``rows`` must hold surviving paragraphs only: others must not change the state.
    """
    sub = detect_subsection(F.col(text))
    marked = rows.withColumn("__sub", sub).withColumn(
        "__section", F.coalesce(detect_section(F.col(text)), parent_section(F.col("__sub.code")))
    )
    so_far = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = marked.withColumn("__section", F.coalesce(F.last("__section", True).over(so_far), _tag(DEFAULT))).withColumn(
        "__sub", F.last("__sub", True).over(so_far)
    )
    return filled.select(
        *rows.columns,
        F.col("__section.section").alias("tag_section"),
        F.col("__section.category").alias("tag_category"),
        F.col("__section.section_name").alias("tag_section_name"),
        F.col("__sub.code").alias("tag_subsection"),
        F.col("__sub.title").alias("tag_subsection_title"),
    )


def page_paragraphs(pages: DataFrame, *keys: str) -> DataFrame:
    """The surviving paragraphs of pages: ``report_id, page, pos, text``, and ``keys`` of the page."""
    # the page tests are values, not filters: filters would be pushed below a repartition of few large files
    text = F.col("text")
    kept = F.when(is_long_enough(text, 50) & ~is_contents_page(text), text).alias("text")
    cleaned = pages.select("report_id", "page", *keys, kept).select("report_id", "page", *keys, clean(text).alias("text"))
    rows = cleaned.select("report_id", "page", *keys, F.posexplode(paragraphs(F.col("text"))).alias("pos", "text"))
    return rows.where(keeps_paragraph(F.col("text")))


def records(tagged: DataFrame, document: str, order: list[str], text: str = "text") -> DataFrame:
    """SEC-5: paragraphs and their good sentences, numbered from 1 in each document; a paragraph comes before its sentences."""
    number = Window.partitionBy(document).orderBy(*order)
    numbered = tagged.withColumn("para_no", F.row_number().over(number))
    # null stands for the paragraph itself, so everything before is computed once
    parts = F.concat(F.array(F.lit(None).cast("string")), F.filter(sentences(F.col(text)), lambda s: is_good_sentence(s)))
    split = numbered.select("*", F.posexplode(parts).alias("__pos", "__sentence"))
    so_far = Window.partitionBy(document).orderBy("para_no", "__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent_no = F.when(F.col("__sentence").isNotNull(), F.count("__sentence").over(so_far).cast("int"))
    return split.withColumn("sent_no", sent_no).withColumn(text, F.coalesce("__sentence", text)).drop("__pos", "__sentence")


def compact(rows: DataFrame, text: str = "text") -> DataFrame:
    """SEC-6: one JSON record per row, text first, nulls left out."""
    fields = F.struct(
        F.col(text).alias("text"), F.col("tag_section").alias("section"), F.col("tag_category").alias("category"),
        F.col("tag_subsection").alias("subsection"), F.col("page"),
    )
    return rows.select(F.to_json(fields).alias("record"))


def verbose(rows: DataFrame, text: str = "text") -> DataFrame:
    """SEC-6: all fields by their long names."""
    return rows.select(
        F.col(text).alias("text"), "page", F.col("para_no").alias("para_id"), F.col("sent_no").alias("sent_id"),
        F.col("tag_section").alias("esrs_section"), F.col("tag_category").alias("esrs_category"),
        F.col("tag_section_name").alias("esrs_section_name"), F.col("tag_subsection").alias("esrs_subsection"),
        F.col("tag_subsection_title").alias("esrs_subsection_title"),
    )
