"""Documents as typed blocks, sections, chunks, evidence and representations."""

from __future__ import annotations

import html.parser
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from lorespark.functions import text as T
from lorespark.functions.scratch import cut
from lorespark.operators import packing

DOC = ["kb_id", "document_id"]
PLACE = ["page_number", "reading_order"]
TARGET, MOST, LEAST = 1200, 1600, 240
# Characters after which a long text may be cut.
SENTENCE_ENDS = "。！？!?；;：:\n"


def text_blocks(docs: DataFrame, id_col: str, text_col: str, kb: Column, per_page: int = 20) -> DataFrame:
    """Blocks of plain texts: a line each; short lines are titles, lines with bars tables, blank lines none."""
    lines = docs.select(kb.alias("kb_id"), F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "line"))
    kind = F.when(F.contains("line", F.lit(" | ")), "table").when(F.length("line") <= 30, "title").otherwise("text")
    return lines.select(*DOC, (F.floor(F.col("pos") / per_page) + 1).alias("page_number"), (F.col("pos") % per_page).cast("long").alias("reading_order"), F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"), kind.alias("type"), F.col("line").alias("text"))


def html_blocks(pages: DataFrame, id_col: str, html_col: str, kb: Column) -> DataFrame:
    """Title and paragraph blocks of raw pages, in order: headings h1 to h6, paragraphs; scripts, styles and other tags dropped."""
    body = F.regexp_replace(html_col, r"(?is)<(script|style|nav)\b.*?</\1>|<!--.*?-->", " ")
    raw = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>.*?(?=</?(?:h[1-6]|p|article|div|body|html|footer|ul|table)\b|$)"), F.lit(0))
    rows = pages.select(kb.alias("kb_id"), F.col(id_col).cast("string").alias("document_id"), F.posexplode(raw).alias("pos", "raw"))
    plain = F.trim(F.regexp_replace(unescaped(F.regexp_replace("raw", r"(?s)<[^>]*>", " ")), r"\s+", " "))
    kind = F.when(F.col("raw").rlike(r"(?i)^<h"), "title").otherwise("text")
    rows = rows.select(*DOC, "pos", kind.alias("type"), plain.alias("text")).where("text <> ''")
    order = F.row_number().over(Window.partitionBy(*DOC).orderBy("pos")) - 1
    return rows.select(*DOC, F.lit(1).cast("long").alias("page_number"), order.cast("long").alias("reading_order"), F.concat(F.lit("p1-b"), order.cast("string")).alias("block_id"), "type", "text")


def unescaped(c: Column) -> Column:
    """The five predefined entities and the no-break space."""
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def adapted(items: DataFrame) -> DataFrame:
    """A parser's content list (document_id, pos, type, page_idx, text, text_level, table_body, captions, latex, img_path, bbox) as blocks.

    Auxiliary items are dropped before places are given; boxes of thousandths are clamped; a table's body is HTML if it has a table tag.
    """
    df = items.where(~F.col("type").isin("header", "footer", "page_number", "page_footnote", "discarded"))
    order = F.row_number().over(Window.partitionBy("document_id", "page_idx").orderBy("pos")) - 1
    is_html = F.lower("table_body").contains("<table")
    kind = F.when((F.col("type") == "text") & (F.col("text_level") > 0), "title").when(F.col("type") == "equation", "formula").when(F.col("type").isin("image", "chart"), "image").when(F.col("type") == "table", "table").otherwise("text")
    box = F.when(F.size("bbox") == 4, F.transform("bbox", lambda v: F.least(F.greatest(v / 1000.0, F.lit(0.0)), F.lit(1.0))))
    page = F.col("page_idx") + 1
    return df.select("document_id", page.alias("page_number"), order.alias("reading_order"), F.concat(F.lit("p"), page.cast("string"), F.lit("-b"), order.cast("string")).alias("block_id"), kind.alias("type"), F.when(kind.isin("title", "text"), F.col("text")).alias("text"), F.when(is_html, F.col("table_body")).alias("html"), F.when(~is_html, F.col("table_body")).alias("markdown"), F.when(kind == "formula", F.col("text")).alias("latex"), F.array_join("captions", "\n").alias("caption"), F.col("img_path").alias("asset_ref"), box.alias("bbox"))


class _Cells(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.words: list[str] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "br" and self.open:
            self.rows[-1][-1] += " "
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag not in ("td", "th", "tr")

    def handle_data(self, data):
        self.words.append(data)
        if self.open:
            self.rows[-1][-1] += data


def _flat(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def table_rows(markup: str) -> list[list[str]]:
    """The cells of each row of an HTML table."""
    p = _Cells()
    p.feed(markup)
    return [list(map(_flat, r)) for r in p.rows]


def table_text(markup: str | None) -> str | None:
    """Rows of an HTML table as `a | b`; without cells all its text, without text the markup."""
    if markup is None:
        return None
    p = _Cells()
    p.feed(markup)
    rows = [" | ".join(map(_flat, r)) for r in p.rows if any(map(_flat, r))]
    return "\n".join(rows) or _flat(" ".join(p.words)) or markup


def rendered_table(markup: Column) -> Column:
    def of(s: pd.Series) -> pd.Series:
        return s.map(table_text)

    return F.pandas_udf(of, StringType())(markup)


def rendered(blocks: DataFrame, optional: tuple[str, ...] = ("markdown", "html", "latex", "caption")) -> Column:
    """A block's text: title and formula marked, tables with their caption, images by theirs."""
    col = lambda c: F.col(c) if c in blocks.columns else F.lit(None).cast("string")
    body = F.coalesce(col("markdown"), col("html"), F.col("text"))
    parts = F.array_join(F.filter(F.array(col("caption"), body), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return F.when(F.col("type") == "title", F.concat(F.lit("## "), "text")).when(F.col("type") == "formula", F.concat(F.lit("$$\n"), F.coalesce(col("latex"), F.col("text")), F.lit("\n$$"))).when(F.col("type") == "table", parts).when(F.col("type") == "image", F.coalesce(col("caption"), F.lit(""))).otherwise(F.col("text"))


def sectioned(blocks: DataFrame) -> DataFrame:
    """blocks with section (from 0): a new one begins at the first title after other content; titles in a row belong together."""
    w = Window.partitionBy(*DOC).orderBy(*PLACE)
    title = F.col("type") == "title"
    begins = title & ~F.coalesce(F.lag(title).over(w), F.lit(True))
    return blocks.withColumn("section", F.sum(begins.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def section_paths(sections: DataFrame) -> DataFrame:
    """document, section, path (its titles in order), n_blocks, title_only."""
    rows = sections.groupBy(*DOC, "section").agg(F.array_sort(F.collect_list(F.struct(*PLACE, "type", "text"))).alias("b"))
    titles = F.transform(F.filter("b", lambda x: x["type"] == "title"), lambda x: x["text"])
    return rows.select(*DOC, "section", titles.alias("path"), F.size("b").cast("long").alias("n_blocks"), (F.size(titles) == F.size("b")).alias("title_only"))


def split_text(text: str, most: int = MOST) -> list[str]:
    """Pieces of at most `most` characters that join to the text: cut after a sentence end, else after white space, else hard."""
    out = []
    while len(text) > most:
        head = text[:most]
        cut = max((head.rfind(c) for c in SENTENCE_ENDS), default=-1) + 1
        cut = cut or max(i + 1 if c.isspace() else 0 for i, c in enumerate(head)) or most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def pieces(text: Column, most: int = MOST) -> Column:
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: split_text(x or "", most))

    return F.pandas_udf(of, ArrayType(StringType()))(text)


def chunked(sections: DataFrame, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Chunks of each section, packed greedily in order: a chunk ends once it has `target` characters or the next block would bring it over `most`;
    leading titles stay with what follows; long texts are split, other long blocks stand alone; a short last chunk joins the one before
    if both fit; a last chunk of formulas alone joins the one before. Every block is in a chunk.

    Only the blocks of one chunk are gathered in a row, not those of a section. Texts are gathered beside the blocks' places, so that readers of places alone
    don't shuffle them.
    """
    by = [*DOC, "section"]
    place = Window.partitionBy(*by).orderBy(*PLACE, "block_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = sections.withColumn("shown", rendered(sections)).select(*by, *PLACE, "block_id", "type", "shown")
    rows = rows.withColumn("unit", F.count_if(F.col("type") != "title").over(place))  # titles belong to the block after them
    long = (F.col("type") == "text") & (F.length("shown") > most)
    split = rows.where(long).select(*by, *PLACE, "block_id", "type", "unit", F.posexplode(pieces(F.col("shown"), most)).alias("piece", "shown"))
    rows = rows.where(~F.coalesce(long, F.lit(False))).withColumn("piece", F.lit(0)).unionByName(split)
    rows = cut(rows.withColumn("chars", F.length("shown")))
    size = (F.sum("chars") + packing.JOINT * (F.count("*") - 1)).alias("size")
    units = rows.groupBy(*by, "unit", "piece").agg(size)
    parts = packing.packed(units, by, ["unit", "piece"], "size", target, most)
    block = [*PLACE, "unit", "piece", "block_id", "type"]
    gathered = lambda *more: F.sort_array(F.collect_list(F.struct(*block, *more)))
    chunks = rows.join(parts.drop("size"), [*by, "unit", "piece"]).groupBy(*by, "part").agg(gathered().alias("b"), gathered("shown").alias("t"), size)
    w = Window.partitionBy(*by).orderBy("part")
    ids = F.transform("b", lambda x: x["block_id"])
    few = (F.col("size") < least) | F.forall("b", lambda x: x["type"] == "formula")
    fits = (F.lag("size").over(w) + packing.JOINT + F.col("size") <= most) & ~F.arrays_overlap(F.lag(ids).over(w), ids)
    last = F.lead("part").over(w).isNull()
    chunks = chunks.withColumn("joins", F.coalesce(last & few & fits, F.lit(False))).withColumn("part", F.col("part") - F.col("joins").cast("int"))
    chunks = chunks.groupBy(*by, "part").agg(*[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in "bt"])  # two at most
    pick = lambda name: F.transform("b", lambda x: x[name])
    shown = F.array_join(F.filter(F.transform("t", lambda x: x["shown"]), lambda x: x != ""), "\n\n")
    chunks = chunks.select(*by, "part", shown.alias("text"), F.array_distinct(pick("block_id")).alias("block_ids"), F.array_min(pick("page_number")).alias("page_start"), F.array_max(pick("page_number")).alias("page_end"), F.array_distinct(pick("type")).alias("content_types"))
    ordinal = F.row_number().over(Window.partitionBy(*DOC).orderBy("section", "part")) - 1
    chunks = chunks.withColumn("ordinal", ordinal.cast("long"))
    return chunks.withColumn("chunk_id", T.identity("chunk", {"document_id": F.col("document_id"), "ordinal": F.col("ordinal"), "blocks": F.col("block_ids")}))


def lineage_faults(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """code, n of what must not be: unknown_block (blocks), uncovered_block (blocks in no chunk), and chunks by the first rule that they break: order (blocks
    repeated or not in reading order), page_range, section (blocks of several), path (not the titles of the section), types, assets.

    Sections, paths and assets are judged as far as blocks have section and asset_ref, chunks path and asset_refs. A chunk with unknown blocks is judged by
    no other rule.
    """
    has = lambda df, c: c in df.columns
    extra = [c for c in ("content_types", "path", "asset_refs") if has(chunks, c)]
    # read several times below, so both are made once, without texts but titles
    chunks = cut(chunks.select(*DOC, "ordinal", "block_ids", "page_start", "page_end", *extra))
    own = [c for c in ("section", "asset_ref") if has(blocks, c)]
    title = [F.when(F.col("type") == "title", F.col("text")).alias("text")] if has(blocks, "text") else []
    blocks = cut(blocks.select(*DOC, "block_id", *PLACE, "type", *own, *title))
    used = chunks.select(*DOC, "ordinal", F.posexplode("block_ids").alias("at", "block_id"))
    section = F.col("section") if has(blocks, "section") else F.lit(0)
    asset = F.when(F.col("type").isin("table", "image"), F.col("asset_ref")) if has(blocks, "asset_ref") else F.lit(None).cast("string")
    known = blocks.select(*DOC, "block_id", *PLACE, "type", section.alias("section"), asset.alias("asset"), F.lit(True).alias("known"))
    both = used.join(known, [*DOC, "block_id"], "left")
    row = F.struct("at", *PLACE, "type", "section", "asset", "known")
    own = both.groupBy(*DOC, "ordinal").agg(F.array_sort(F.collect_list(row)).alias("r")).join(chunks.select(*DOC, "ordinal", "page_start", "page_end", *extra), [*DOC, "ordinal"])
    each = lambda f: F.transform("r", f)
    places = each(lambda x: F.struct(x["page_number"], x["reading_order"]))
    pages = each(lambda x: x["page_number"])
    rules = [
        ("order", (places != F.array_sort(places)) | (F.size(F.array_distinct(places)) < F.size(places))),
        ("page_range", (F.array_min(pages) != F.col("page_start")) | (F.array_max(pages) != F.col("page_end"))),
        ("section", F.size(F.array_distinct(each(lambda x: x["section"]))) > 1),
    ]
    if has(chunks, "path") and has(blocks, "section"):
        own = own.withColumn("section", F.get("r", F.lit(0))["section"]).join(section_paths(blocks).select(*DOC, "section", F.col("path").alias("titles")), [*DOC, "section"], "left")
        rules.append(("path", ~F.col("path").eqNullSafe(F.col("titles"))))
    if has(chunks, "content_types"):
        rules.append(("types", F.col("content_types") != F.array_distinct(each(lambda x: x["type"]))))
    if has(chunks, "asset_refs"):
        rules.append(("assets", F.col("asset_refs") != F.array_distinct(F.filter(each(lambda x: x["asset"]), lambda a: a.isNotNull()))))
    code = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        code = F.when(broken, F.lit(name)).otherwise(code)
    found = own.where(F.forall("r", lambda x: x["known"].isNotNull())).select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))
    one = lambda df, code: df.select(F.lit(code).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return one(both.where("known is null").select(*DOC, "block_id").distinct(), "unknown_block").unionByName(found).unionByName(one(known.join(used, [*DOC, "block_id"], "left_anti"), "uncovered_block"))


def profile(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """One row: chunks, documents, blocks per chunk, length distribution, oversized, atomic, and texts that go on in the next chunk."""
    n = F.length("text")
    w = Window.partitionBy(*DOC).orderBy("ordinal")
    split = F.arrays_overlap("block_ids", F.lag("block_ids").over(w))
    df = chunks.select(n.alias("n"), "document_id", F.size("block_ids").alias("b"), F.coalesce(split, F.lit(False)).alias("goes_on"))
    q = lambda p: F.round(F.percentile("n", p), 4)
    return df.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.round(F.avg("b"), 6).alias("mean_blocks"), F.min("n").alias("shortest"), F.max("n").alias("longest"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.count_if(F.col("n") > most).alias("oversized"), F.count_if(F.col("b") == 1).alias("atomic"), F.count_if("goes_on").alias("split_texts"))


def context(blocks: DataFrame, titles: int = 4, title_chars: int = 160, neighbour_chars: int = 480, most: int = 1200) -> DataFrame:
    """document, block_id, context: the last titles of the page so far and the texts beside a block; titles have none of the latter."""
    w = Window.partitionBy(*DOC, "page_number").orderBy("reading_order")
    so_far = F.collect_list(F.when(F.col("type") == "title", F.substring("text", 1, title_chars))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = F.array(*[F.substring(f("text").over(w), 1, neighbour_chars) for f in (F.lag, F.lead)])
    df = blocks.select(*DOC, "block_id", "type", so_far.alias("path"), near.alias("near"))
    path = F.array_join(F.when(F.size("path") > titles, F.slice("path", -titles, titles)).otherwise(F.col("path")), " / ")
    beside = F.array_join(F.filter("near", lambda x: x.isNotNull()), " ")
    parts = F.filter(F.array(F.when(path != "", F.concat(F.lit("章节: "), path)), F.when((F.col("type") != "title") & (beside != ""), F.concat(F.lit("邻近文本: "), beside))), lambda x: x.isNotNull())
    return df.select(*DOC, "block_id", F.substring(F.array_join(parts, "; "), 1, most).alias("context"))


# The modality of each block type.
MODALITY = {"title": "text", "text": "text", "table": "table", "formula": "formula", "image": "image"}


def evidence(blocks: DataFrame) -> DataFrame:
    """One evidence for each block: identity, modality, page, block, fingerprint of its content."""
    modality = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in MODALITY.items()])
    shown = rendered(blocks)
    df = blocks.select(*DOC, "page_number", "block_id", "type", modality.alias("modality"), shown.alias("content"), F.sha2(shown, 256).alias("source_fingerprint"))
    return df.withColumn("evidence_id", T.identity("evidence", {"block_id": F.col("block_id"), "document_id": F.col("document_id"), "kb_id": F.col("kb_id")}))


def representations(evidences: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each evidence fanned out: its text (or markdown, or latex) and its context, as far as there are any; both searchable."""
    kind = F.when(F.col("modality") == "table", "markdown").when(F.col("modality") == "formula", "latex").when(F.col("modality") == "image", "caption").otherwise("text")
    both = evidences.join(contexts, [*DOC, "block_id"], "left")
    fan = F.filter(F.array(F.struct(kind.alias("representation_type"), F.col("content").alias("content"), F.lit(True).alias("searchable")), F.struct(F.lit("context").alias("representation_type"), F.col("context").alias("content"), F.lit(True).alias("searchable"))), lambda x: x["content"].isNotNull() & (x["content"] != ""))
    return both.select(*DOC, "block_id", "evidence_id", "modality", F.explode(fan).alias("r")).select(*DOC, "block_id", "evidence_id", "modality", "r.*")


def carrier(text: Column, path: Column, types: Column) -> Column:
    """What stands for a chunk: its text, else its path and types."""
    head = F.array_join(path, " / ")
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, text).otherwise(F.concat(F.when(head != "", F.concat(head, F.lit(" "))).otherwise(""), F.lit("["), F.array_join(types, ", "), F.lit("]")))


def subject(path: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The rule group that a path matches, ambiguous if several do, unknown if none."""
    hits = {name: F.array_contains(F.array(*[F.contains(F.lower(path), F.lit(t)) for t in terms]), True) for name, terms in rules.items()}
    n = sum((h.cast("int") for h in hits.values()), F.lit(0))
    one = F.coalesce(*[F.when(h, name) for name, h in hits.items()])
    return F.when(n == 0, "unknown").when(n > 1, "ambiguous").otherwise(one)
