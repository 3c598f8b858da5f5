"""Lexicon scanning of corpus rows: concept hits, causal markers, and windows of rows that cover all concepts.

Corpus rows have ``file, lineno, page, section, subsection, text``. A lexicon is a dict of concept -> patterns,
a list of markers is a list of patterns; both are arguments. Concepts are bits of a mask, so unions over windows are ``bit_or``.
Windows count surviving rows, not line numbers; row frames run on blocks (see ``frames``).

Null texts and texts under 40 characters are no rows; null pages do not count for page spans; ties in ranks go to file and line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.patterns import all_matches, matches, strip, words
from causeway.operators.frames import in_blocks, number_rows
from causeway.sources.checkpoints import cut_lineage

# Concept lexicons and causal markers of the strict scan.
CONCEPTS: dict[str, tuple[str, ...]] = {
    "CG": (
        r"corporate governance", r"\bgovernance mechanism", r"\bgovernance structure", r"board of directors", r"board composition",
        r"board characteristic", r"board independence", r"board size", r"board gender diversity", r"sustainability committee",
        r"environmental committee", r"climate committee", r"climate change committee", r"csr committee", r"governance committee",
        r"board oversight", r"board[- ]level (climate|esg|sustainability)", r"esg[- ]linked (executive )?compensation",
        r"sustainable compensation", r"pay[- ]for[- ]sustainability",
    ),
    "ER": (
        r"environmental reporting", r"environmental disclosure", r"carbon disclosure", r"ghg disclosure", r"climate disclosure",
        r"climate[- ]related disclosure", r"climate risk disclosure", r"voluntary carbon disclosure", r"carbon transparency",
        r"sustainability reporting", r"integrated reporting", r"\bcdp\b", r"cdp reporting", r"cdp participation", r"cdp disclosure",
        r"\btcfd\b", r"tcfd[- ]aligned", r"tcfd disclosure", r"esrs environmental", r"non[- ]financial report",
        r"science[- ]based target", r"\bsbti\b", r"climate policy disclosure", r"carbon management policy", r"emissions reduction target",
    ),
    "GHG": (
        r"ghg emission", r"greenhouse gas emission", r"carbon emission", r"co2 emission", r"co₂ emission", r"co2e emission",
        r"co₂e emission", r"carbon dioxide emission", r"scope 1", r"scope 2", r"scope 3", r"scope 1\s*\+\s*2", r"direct emission",
        r"indirect emission", r"carbon intensity", r"emissions intensity", r"carbon footprint", r"carbon performance",
    ),
    "MBV": (
        r"tobin'?s q", r"tobin q", r"\bq[- ]ratio\b", r"\bpbv\b", r"price[- ]to[- ]book", r"\bp/b\b", r"market[- ]to[- ]book", r"\bm/b\b",
        r"\bmbv\b", r"market capitali[sz]ation", r"market cap\b", r"market value", r"\bmve\b", r"equity market value",
        r"market value of equity", r"market value of common equity", r"firm value", r"firm valuation", r"corporate valuation",
        r"market valuation", r"market[- ]based firm value", r"valuation premium", r"valuation discount", r"valuation profile",
        r"shareholder value", r"investor confidence",
    ),
}
MARKERS: tuple[str, ...] = (
    r"\bcaused? by\b", r"\bcause[ds]?\b", r"\bcausing\b", r"\bdriv(e|es|en|ing)\b", r"\bproduce[ds]?\b", r"\bproducing\b",
    r"\benable[ds]?\b", r"\benabling\b", r"\bresult(s|ed|ing)? in\b", r"\blead(s|ing)? to\b", r"\bled to\b", r"\btranslate[ds]? into\b",
    r"\bcontribut(e|es|ed|ing) to\b", r"\breduce[ds]?\b", r"\breducing\b", r"\blower(s|ed|ing)?\b", r"\braise[ds]?\b", r"\braising\b",
    r"\bincrease[ds]?\b", r"\bimprove[ds]?\b", r"\bimproving\b", r"\bstrengthen(s|ed|ing)?\b", r"\bweaken(s|ed|ing)?\b",
    r"\bmitigate[ds]?\b", r"\bmitigating\b", r"\bsupport(s|ed|ing)?\b", r"\bunderpin(s|ned|ning)?\b", r"\bgenerate[ds]?\b",
    r"\byield(s|ed|ing)?\b", r"\bbecause\b", r"\bdue to\b", r"\bas a result of\b", r"\bconsequence of\b", r"\bthanks to\b",
    r"\bowing to\b", r"\bin response to\b", r"\breflected (in|by)\b", r"\bthrough\b", r"\bvia\b", r"\bby means of\b", r"\bdriven by\b",
    r"\bsupported by\b", r"\bunderpinned by\b", r"\benabled by\b", r"\bimpact of\b", r"\beffect of\b", r"\binfluences?\b",
    r"\bhelp(s|ed|ing)? (to )?\b",
)
# The relaxed lexicons and markers.
RELAXED_CONCEPTS: dict[str, tuple[str, ...]] = {
    "CG": (
        r"corporate governance|\bgovernance structure|\bgovernance\b|board of directors|supervisory board|management board"
        r"|sustainability committee|risk committee|audit committee|oversight|stewardship|voting policy|voting rights|voting right"
        r"|proxy voting|remuneration policy|\bremuneration\b|compensation policy|executive compensation|internal control"
        r"|executive director|non-executive|chief risk officer|chief sustainability officer|governance structures",
    ),
    "ER": (
        r"\btcfd\b|task force on climate[- ]related|\bcdp\b|\bsbti\b|science[- ]based targets?|climate disclosure|non[- ]financial report"
        r"|non[- ]financial statement|sustainability report|sustainability disclosure|emissions reduction target|\bsfdr\b"
        r"|sustainable finance disclosure|\bnfrd\b|\bcsrd\b|\besrs\b|\bgri\b|\bgri [0-9]|transition plan|eu taxonomy|taxonomy regulation"
        r"|unep fi|un environment programme finance initiative|\bprb\b|principles for responsible banking|\bpri\b"
        r"|principles for responsible investment|net[- ]zero banking alliance|\bnzba\b|un global compact|ipsf|pcaf"
        r"|partnership for carbon accounting financials|sustainability reporting",
    ),
    "GHG": (
        r"ghg emission|greenhouse gas|scope [123]|carbon emission|carbon footprint|net[- ]?zero|paris agreement|decarboni[sz]|low[- ]carbon"
        r"|climate[- ]neutral|carbon neutral|emission reduction|emissions reduction|reduce emissions|financed emissions|emission intensity"
        r"|emissions intensity|carbon intensity|climate transition|climate risk|climate risks|climate change",
    ),
    "MBV": (
        r"shareholder value|long[- ]term value|long[- ]term performance|firm value|investor confidence|market capitalisation"
        r"|market capitalization|enterprise value|\bprofitability\b|profitable growth|earnings per share|return on equity|\broe\b"
        r"|financial performance|sustainable value|creating value|create value|long[- ]term financial|long[- ]term shareholder"
        r"|economic value|value creation|financial strength|financial resilience",
    ),
}
RELAXED_MARKERS: tuple[str, ...] = (
    r"\bbecause\b|\bthereby\b|\btherefore\b|\bthus\b|\bhence\b|\bas a result\b|\bso that\b|leads? to|lead to|drives?|driven by|promotes?"
    r"|enables?|supports?|contributes? to|helps? (?:to )?(?:realise|realize|achieve|deliver|reduce|mitigate|ensure)|in order to|to ensure"
    r"|to reduce|to mitigate|to achieve|to enhance|to support|aligns? with|aligned with|in line with|ensures?|requires?|impacts?|affects?"
    r"|influences?|improves?|reinforces?|strengthens?|fosters?|facilitates?|accelerates?|reduces?|mitigates?|addresses?|integrates?|embeds?"
    r"|commits? to|committed to|is essential to|is fundamental to|underpins?|depends? on|result in|results in|resulting in"
    r"|has (?:a )?significant impact",
)

Lexicon = Mapping[str, Sequence[str]]


def alternation(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def concept_mask(text: Column, lexicon: Lexicon) -> Column:
    """LEX-1: bit k is set if the k-th concept of the lexicon is mentioned."""
    hits = [F.when(matches(text, alternation(p), ignore_case=True), F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(lexicon.values())]
    mask = hits[0]
    for hit in hits[1:]:
        mask = mask.bitwiseOR(hit)
    return mask


def concept_names(mask: Column, lexicon: Lexicon) -> Column:
    """LEX-1: the sorted names of a mask."""
    named = [F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(lexicon)]
    return F.array_sort(F.array_compact(F.array(*named)))


def marker_hits(text: Column, markers: Sequence[str]) -> Column:
    """LEX-3: every marker in order, repeats kept."""
    return all_matches(text, alternation(markers), ignore_case=True)


def distinct_markers(text: Column, markers: Sequence[str]) -> Column:
    """LEX-2: the distinct marker strings, sorted."""
    return F.array_sort(F.array_distinct(marker_hits(text, markers)))


def word_count(text: Column) -> Column:
    """LEX-15."""
    return F.size(words(text))


def widest_match(patterns: Sequence[str]) -> int | None:
    """Characters that a match of one of the patterns can have at most; None if there is no bound."""
    widest = max(_parser.parse(p).getwidth()[1] for p in patterns)
    return widest if widest < 10_000 else None


def scan(
    rows: DataFrame, lexicon: Lexicon = CONCEPTS, markers: Sequence[str] = MARKERS, head_of: str | None = None, with_text: bool = False
) -> DataFrame:
    """The surviving corpus rows with ``mask``, number of markers ``n_markers`` and their number ``rn`` in the file.

    Texts are left behind where they are read, for windows over rows must not carry them: of rows that mention the
    concept ``head_of`` the first 300 characters stay as ``head``; all of the text and its markers only if asked for.
    """
    text = F.col("text")
    marked = rows.where(F.length(strip(text)) >= 40).select(
        "file", "lineno", "page", "section", "subsection", concept_mask(text, lexicon).alias("mask"), marker_hits(text, markers).alias("markers"), "text"
    )
    head = F.when(F.col("mask").bitwiseAND(F.lit(1 << list(lexicon).index(head_of))) != 0, F.substring("text", 1, 300)) if head_of else F.lit(None)
    own = ["markers", "text"] if with_text else []
    kept = marked.select("file", "lineno", "page", "section", "subsection", "mask", F.size("markers").alias("n_markers"), head.cast("string").alias("head"), *own)
    return number_rows(kept, "file", "lineno", "lineno")


def prefilter(rows: DataFrame, lexicon: Lexicon = CONCEPTS, markers: Sequence[str] = MARKERS, special: str = "MBV") -> DataFrame:
    """LEX-4, 5: rows with two concepts and a marker, with ``nodes, n_nodes, causal_markers, score``."""
    text = F.col("text")
    kept = rows.where(F.length(strip(text)) >= 40).withColumn("mask", concept_mask(text, lexicon))
    kept = kept.withColumn("n_nodes", F.bit_count("mask")).where("n_nodes >= 2")
    kept = kept.withColumn("causal_markers", distinct_markers(text, markers)).where(F.size("causal_markers") >= 1)
    has = F.col("mask").bitwiseAND(F.lit(1 << list(lexicon).index(special))) != 0
    return kept.withColumn("nodes", concept_names(F.col("mask"), lexicon)).withColumn(
        "score", 10 * F.col("n_nodes") + F.when(has, 5).otherwise(0)
    )


def ranked(candidates: DataFrame) -> DataFrame:
    """LEX-6: in the order of the score, ties by file and line; a range-partitioned sort."""
    return candidates.orderBy(F.desc("score"), "file", "lineno")


def combinations(candidates: DataFrame) -> DataFrame:
    """LEX-7: how often each set of concepts occurs."""
    return candidates.groupBy("nodes").agg(F.count(F.lit(1)).alias("n"))


def smallest_windows(
    scanned: DataFrame, lexicon: Lexicon = CONCEPTS, most_rows: int = 20, most_pages: int = 6, one_section: bool = False
) -> DataFrame:
    """LEX-8: per start row with a concept the smallest qualifying window.

    It covers all concepts, ends in a row with one, has two rows with markers, spans at most ``most_pages`` pages and,
    if asked, one section.
    """
    full = (1 << len(lexicon)) - 1
    frame = Window.partitionBy("file", "__block").orderBy("rn").rowsBetween(0, most_rows - 1)
    row = F.struct("lineno", "page", "section", "mask", (F.col("n_markers") > 0).alias("marked"))
    blocks = in_blocks(scanned, "rn", behind=0, ahead=most_rows - 1)
    framed = blocks.withColumn("w", F.collect_list(row).over(frame)).where("__own AND mask <> 0")
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("mask"), F.lit(0).alias("marked"), F.lit(None).cast("int").alias("lo"),
        F.lit(None).cast("int").alias("hi"), F.lit(True).alias("same"), F.lit(0).alias("found"),
    )

    def step(s: Column, r: Column) -> Column:
        i, mask = s["i"] + 1, s["mask"].bitwiseOR(r["mask"])
        marked = s["marked"] + F.when(r["marked"], 1).otherwise(0)
        lo, hi = F.least(s["lo"], r["page"]), F.greatest(s["hi"], r["page"])
        same = s["same"] & r["section"].eqNullSafe(F.get(F.col("w"), F.lit(0))["section"])
        good = (
            (s["found"] == 0) & (i >= 2) & (mask == full) & (r["mask"] != 0) & (marked >= 2)
            & (F.coalesce(hi - lo, F.lit(0)) <= most_pages) & (same | F.lit(not one_section))
        )
        return F.struct(
            i.alias("i"), mask.alias("mask"), marked.alias("marked"), lo.alias("lo"), hi.alias("hi"), same.alias("same"),
            F.when(good, i).otherwise(s["found"]).alias("found"),
        )

    sized = framed.withColumn("n_rows", F.aggregate("w", start, step, lambda s: s["found"])).where("n_rows > 0")
    cut = F.slice("w", 1, F.col("n_rows"))
    inside = sized.withColumn("w", cut)
    pages = F.transform("w", lambda r: r["page"])
    return inside.select(
        "file", F.col("rn").alias("start_rn"), F.col("lineno").alias("start_line"), F.element_at("w", -1)["lineno"].alias("end_line"), "n_rows",
        F.array_min(pages).alias("first_page"), F.array_max(pages).alias("last_page"), "section",
        F.size(F.filter("w", lambda r: r["marked"])).alias("rows_with_markers"),
    )


def window_details(windows: DataFrame, scanned: DataFrame, lexicon: Lexicon = CONCEPTS) -> DataFrame:
    """LEX-10: the windows with what their rows hold; ``scanned`` has texts. Only rows of windows are fetched."""
    wanted = windows.withColumn("__rn", F.explode(F.sequence("start_rn", F.col("start_rn") + F.col("n_rows") - 1)))
    row = F.struct("rn", "subsection", "mask", "markers", "text")
    held = wanted.join(scanned.select(F.col("file").alias("__file"), "rn", row.alias("__row")), (F.col("file") == F.col("__file")) & (F.col("__rn") == F.col("rn")))
    listed = held.groupBy("file", "start_rn").agg(F.array_sort(F.collect_list("__row")).alias("w"))
    return windows.join(listed, ["file", "start_rn"]).select(
        *windows.columns,
        F.array_sort(F.array_distinct(F.array_compact(F.transform("w", lambda r: r["subsection"])))).alias("subsection_set"),
        F.transform("w", lambda r: concept_names(r["mask"], lexicon)).alias("nodes_per_row"),
        F.transform("w", lambda r: r["markers"]).alias("markers_per_row"),
        F.transform("w", lambda r: r["text"]).alias("texts"),
    )


def window_rank(windows: DataFrame) -> DataFrame:
    """LEX-9: in the order of few rows, many rows with markers, file and line."""
    return windows.orderBy("n_rows", F.desc("rows_with_markers"), "file", "start_line")


def anchored(
    scanned: DataFrame, lexicon: Lexicon = CONCEPTS, anchor: str = "MBV", reach: int = 15, least_markers: int = 2, most_pages: int = 6
) -> DataFrame:
    """LEX-11: rows that mention ``anchor`` whose neighbourhood of ``reach`` rows either side covers all concepts; scanned with ``head_of=anchor``."""
    full = (1 << len(lexicon)) - 1
    bit = 1 << list(lexicon).index(anchor)
    near = Window.partitionBy("file", "__block").orderBy("rn").rowsBetween(-reach, reach)
    over = in_blocks(scanned, "rn", behind=reach, ahead=reach).select(
        "*", F.bit_or("mask").over(near).alias("union"), F.sum("n_markers").over(near).alias("total_markers"),
        F.min("page").over(near).alias("first_page"), F.max("page").over(near).alias("last_page"),
        F.min("lineno").over(near).alias("span_start"), F.max("lineno").over(near).alias("span_end"),
    )
    hits = over.where(F.col("__own") & (F.col("mask").bitwiseAND(F.lit(bit)) != 0)).where(
        (F.col("union") == full) & (F.col("total_markers") >= least_markers)
        & (F.coalesce(F.col("last_page") - F.col("first_page"), F.lit(0)) <= most_pages)
    )
    return hits.select(
        "file", F.col("lineno").alias("anchor_line"), F.col("page").alias("anchor_page"), F.col("head").alias("anchor_text"),
        "span_start", "span_end", "first_page", "last_page", "total_markers", concept_names(F.col("union"), lexicon).alias("nodes"), "section", "rn",
    )


def per_file(hits: DataFrame) -> DataFrame:
    """LEX-12: number of hits of each file with hits."""
    return hits.groupBy("file").agg(F.count(F.lit(1)).alias("n_hits"))


def relaxed(
    rows: DataFrame, lexicon: Lexicon = RELAXED_CONCEPTS, markers: Sequence[str] = RELAXED_MARKERS, reach: int = 7,
    least_markers: int = 4, most_pages: int = 5, skip: DataFrame | None = None,
) -> DataFrame:
    """LEX-13: anchors whose neighbourhood, read as one text, mentions all concepts and enough markers; files of ``skip`` are left out.

    Every row is matched once by itself and once at its border to the next rows; hits of rows add up, and only
    neighbourhoods with a border that has other hits than its two sides are read as one text.
    """
    text, full = F.col("text"), (1 << len(lexicon)) - 1
    if skip is not None:
        rows = rows.join(skip.select("file").distinct(), "file", "left_anti")
    kept = rows.where(F.length(strip(text)) >= 40)
    tie = F.xxhash64("text").alias("__tie")

    # what each row has by itself, and what its border to the rows after it has beyond the two sides
    width = widest_match([*(alternation(p) for p in lexicon.values()), alternation(markers)])
    by_row = Window.partitionBy("file", "__block").orderBy("rn")
    hits = lambda x: F.struct(concept_mask(x, lexicon).alias("mask"), F.size(marker_hits(x, markers)).alias("n"))
    if width is None:  # patterns of any width: every neighbourhood is read as a whole
        plain_rows = number_rows(kept.select("file", "lineno", "page", tie), "file", "lineno", "__tie")
        marked = plain_rows.select("file", "lineno", "rn", "page", F.lit(full).alias("mask"), F.lit(least_markers).alias("n"), F.lit(True).alias("odd"))
    else:
        edges = kept.select("file", "lineno", "page", tie, hits(text).alias("own"), F.substring(text, 1, width).alias("head"), F.right(text, F.lit(width)).alias("tail"))
        edges = number_rows(edges, "file", "lineno", "__tie")
        after = in_blocks(edges, "rn", behind=0, ahead=2)
        after = after.select("*", F.concat_ws(" ", F.lead("head", 1).over(by_row), F.lead("head", 2).over(by_row)).alias("next")).where("__own")
        parts = after.select("*", F.concat_ws(" ", "tail", F.when(F.col("next") != "", F.col("next"))).alias("both"))
        apart, whole = (hits(F.col("tail")), hits(F.col("next"))), hits(F.col("both"))
        odd = (whole["mask"] != apart[0]["mask"].bitwiseOR(apart[1]["mask"])) | (whole["n"] != apart[0]["n"] + apart[1]["n"])
        marked = parts.select("file", "lineno", "rn", "page", "own.mask", "own.n", ((F.col("next") != "") & odd).alias("odd"))
    near = by_row.rowsBetween(-reach, reach)
    inner = by_row.rowsBetween(-reach, reach - 1)  # borders inside the neighbourhood
    over = in_blocks(marked, "rn", behind=reach, ahead=reach).select(
        "file", "lineno", "rn", "__own", F.bit_or("mask").over(near).alias("mask"), F.sum("n").over(near).alias("n"), F.bool_or("odd").over(inner).alias("odd"),
        (F.max("page").over(near) - F.min("page").over(near)).alias("page_span"),
    )
    own = over.where("__own").where(F.coalesce("page_span", F.lit(0)) <= most_pages)
    own = cut_lineage(own.where("odd OR (mask = %d AND n >= %d)" % (full, least_markers)))  # two consumers
    plain = own.where(~F.col("odd") & (F.col("mask") == full) & (F.col("n") >= least_markers)).select("file", "lineno", "rn", "page_span", F.col("n").cast("int").alias("marker_count"))

    # where a match may lie across a border, the neighbourhood is read as one text
    doubtful = own.where("odd").select("file", "lineno", "rn", "page_span")
    wanted = doubtful.withColumn("__rn", F.explode(F.sequence(F.col("rn") - reach, F.col("rn") + reach)))
    texts = number_rows(kept.select("file", "lineno", "text", tie), "file", "lineno", "__tie").select(F.col("file").alias("__file"), F.col("rn").alias("__own_rn"), "text")
    joined = wanted.join(texts, (F.col("file") == F.col("__file")) & (F.col("__rn") == F.col("__own_rn")))
    read = joined.groupBy("file", "lineno", "rn", "page_span").agg(F.array_sort(F.collect_list(F.struct("__rn", "text"))).alias("w"))
    read = read.withColumn("around", F.array_join(F.transform("w", lambda r: r["text"]), " ")).where(concept_mask(F.col("around"), lexicon) == full)
    read = read.withColumn("marker_count", F.size(marker_hits(F.col("around"), markers))).where(F.col("marker_count") >= least_markers)
    found = plain.unionByName(read.select("file", "lineno", "rn", "page_span", "marker_count"))
    return found.select("file", F.col("lineno").alias("anchor_line"), "rn", F.coalesce("page_span", F.lit(0)).alias("page_span"), "marker_count")


def collapse_anchors(hits: DataFrame, gap: int = 6) -> DataFrame:
    """LEX-14: of anchors that follow each other within ``gap`` rows the one with most markers (first of equals)."""
    # a hit opens an island if no other is within the gap before it; islands are numbered like rows, by blocks
    by_block = Window.partitionBy("file", "__block").orderBy("rn")
    seen = in_blocks(hits, "rn", behind=gap, ahead=0).withColumn("__lag", F.lag("rn").over(by_block))
    opened = seen.where("__own").withColumn("__new", F.when(F.col("rn") - F.col("__lag") <= gap, 0).otherwise(1))
    per_block = opened.groupBy("file", "__block").agg(F.sum("__new").alias("n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("file", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    islands = opened.withColumn("__k", F.sum("__new").over(by_block)).join(starts, ["file", "__block"])
    islands = islands.withColumn("island", F.col("__start") + F.col("__k"))
    best = F.max_by(F.struct("anchor_line", "rn", "marker_count"), F.struct(F.col("marker_count"), -F.col("rn")))
    return islands.groupBy("file", "island").agg(best.alias("b")).select("file", "b.anchor_line", "b.rn", "b.marker_count")
