"""Extraction outputs of language models: strict parsing against the taxonomies, grounding in the text, table cells."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from lorespark.functions import text as T
from lorespark.operators.blocks import table_rows

# The types that entities and relations may have.
ENTITY_TYPES = ("人物", "地点", "组织", "事件", "概念", "物质", "制度", "技术", "时间", "数值")
RELATION_TYPES = ("属于", "位于", "包括", "组成", "导致", "影响", "发生于", "先于", "用于", "体现", "具有", "相关")
# Most characters of a label and of an evidence, most aliases, entities and relations.
LABEL, EVIDENCE, ALIASES, ENTITIES, RELATIONS = 200, 500, 20, 100, 200


def without_fence(text: Column) -> Column:
    """The inside of a code fence (plain or json) that encloses the whole text, else the text; trimmed."""
    inside = F.regexp_extract(text, r"(?is)^\s*```(?:json)?[ \t]*\r?\n(.*)\r?\n[ \t]*```\s*$", 1)
    return F.trim(F.when(inside != "", inside).otherwise(text))


def _is_text(element: Column, name: str, most: int) -> Column:
    """Whether a field of an object (a map of variants) is a string of 1 to `most` characters that isn't blank."""
    value = F.try_variant_get(F.get(F.map_values(F.map_filter(element, lambda k, _: k == name)), F.lit(0)), "$", "string")
    kind = F.schema_of_variant(F.get(F.map_values(F.map_filter(element, lambda k, _: k == name)), F.lit(0)))
    return F.coalesce((kind == "STRING") & F.length(value).between(1, most) & (F.length(T.label(value)) > 0), F.lit(False))


def _only(element: Column, names: tuple[str, ...]) -> Column:
    return element.isNotNull() & (F.size(F.array_except(F.map_keys(element), F.array(*map(F.lit, names)))) == 0)


def _objects(root: Column, name: str) -> tuple[Column, Column]:
    """(elements of an array of objects, whether the field is absent or such an array); what isn't an object is null."""
    field = F.try_variant_get(root, f"$.{name}", "variant")
    kind = F.schema_of_variant(field)
    return F.try_variant_get(root, f"$.{name}", "array<map<string,variant>>"), kind.isNull() | F.startswith(kind, F.lit("ARRAY"))


def _good_aliases(element: Column) -> Column:
    """Aliases are absent or up to ALIASES distinct labels, each a string that isn't blank."""
    value = F.get(F.map_values(F.map_filter(element, lambda k, _: k == "aliases")), F.lit(0))
    strings = F.try_variant_get(value, "$", "array<string>")
    kinds = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.schema_of_variant(v))
    labels = F.transform(strings, T.label)
    fits = F.forall(kinds, lambda k: k == "STRING") & F.forall(labels, lambda x: F.length(x) > 0) & (F.size(F.array_distinct(labels)) == F.size(labels)) & (F.size(labels) <= ALIASES)
    return ~F.array_contains(F.map_keys(element), "aliases") | F.coalesce(fits, F.lit(False))


def parsed(outputs: DataFrame, text: str = "output", entity_types: tuple[str, ...] = ENTITY_TYPES, relation_types: tuple[str, ...] = RELATION_TYPES) -> DataFrame:
    """outputs with parsed (struct of entities and relations) and category: ok, invalid_json, schema_validation, unknown_entity_type or
    unknown_relation_type; only ok ones have entities and relations.

    An output is an object of `entities` (name, entity_type, perhaps aliases) and `relations` (source, target, relation_type, evidence),
    each of which may be absent. Every element is checked as it is written: no other fields, no other types, lengths within their bounds, aliases
    distinct as labels. An object that repeats a key is no JSON here.
    """
    root = F.try_parse_json(without_fence(F.col(text)))
    df = outputs.withColumn("_v", root)
    e, e_fits = _objects(F.col("_v"), "entities")
    r, r_fits = _objects(F.col("_v"), "relations")
    top = F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>"))
    df = df.withColumns({"_e": e, "_r": r, "_fits": e_fits & r_fits, "_top": top})
    e, r = F.col("_e"), F.col("_r")
    none = F.array().cast("array<map<string,variant>>")
    good_e = F.forall(F.coalesce(e, none), lambda x: F.coalesce(_only(x, ("name", "entity_type", "aliases")) & _is_text(x, "name", LABEL) & _is_text(x, "entity_type", LABEL) & _good_aliases(x), F.lit(False)))
    good_r = F.forall(F.coalesce(r, none), lambda x: F.coalesce(_only(x, ("source", "target", "relation_type", "evidence")) & _is_text(x, "source", LABEL) & _is_text(x, "target", LABEL) & _is_text(x, "relation_type", LABEL) & _is_text(x, "evidence", EVIDENCE), F.lit(False)))
    sound = F.col("_fits") & (F.size(F.array_except("_top", F.array(F.lit("entities"), F.lit("relations")))) == 0) & (F.size(F.coalesce(e, none)) <= ENTITIES) & (F.size(F.coalesce(r, none)) <= RELATIONS) & good_e & good_r
    as_text = lambda m, k: F.try_variant_get(F.element_at(m, k), "$", "string")
    aliases = lambda m: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("aliases")), "$", "array<string>"), F.array().cast("array<string>"))
    entities = F.transform(F.coalesce(e, none), lambda x: F.struct(as_text(x, "name").alias("name"), as_text(x, "entity_type").alias("entity_type"), aliases(x).alias("aliases")))
    relations = F.transform(F.coalesce(r, none), lambda x: F.struct(*[as_text(x, k).alias(k) for k in ("source", "target", "relation_type", "evidence")]))
    df = df.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    df = df.withColumn("_p", F.when(F.col("_sound"), F.struct(entities.alias("entities"), relations.alias("relations"))))
    category = (
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(~F.col("_sound"), "schema_validation")
        .when(F.exists("_p.entities", lambda x: ~x["entity_type"].isin(*entity_types)), "unknown_entity_type")
        .when(F.exists("_p.relations", lambda x: ~x["relation_type"].isin(*relation_types)), "unknown_relation_type")
        .otherwise("ok")
    )
    df = df.withColumn("category", category)
    return df.withColumn("parsed", F.when(F.col("category") == "ok", F.col("_p"))).drop("_v", "_e", "_r", "_fits", "_top", "_sound", "_p")


def mentions(entities: DataFrame, key: str = "entity_id", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """document_id, entity, mention: the labels by which a document's entities may be named."""
    spelled = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    rows = entities.select("document_id", F.col(key).alias("entity"), F.explode(spelled).alias("m"))
    return rows.select("document_id", "entity", T.folded_label(F.col("m")).alias("mention")).where("mention <> ''").distinct()


def grounded_relations(relations: DataFrame, entities: DataFrame, texts: DataFrame) -> DataFrame:
    """relations (relation_no, document_id, source, target, relation_type, evidence) with source_id, target_id and status: ground, endpoint (an end isn't the
    mention of exactly one entity of the document), evidence (the quote isn't in the text), source or target (the quote names
    neither name nor alias of that end), or duplicate (another relation has the same ends and type, and comes first by its label, source and number).

    entities: document_id, entity_id, name, aliases; texts: document_id, text. All are compared as folded labels, each text folded once.
    """
    known = mentions(entities)
    single = known.groupBy("document_id", "mention").agg(F.min("entity").alias("entity"), F.count("*").alias("n")).where("n = 1").drop("n")
    folded = texts.select("document_id", T.folded_label(F.col("text")).alias("_text"))
    df = relations.withColumns({"_s": T.folded_label(F.col("source")), "_t": T.folded_label(F.col("target")), "_e": T.folded_label(F.col("evidence"))})
    for end, label in (("source", "_s"), ("target", "_t")):
        df = df.join(single.select("document_id", F.col("mention").alias(label), F.col("entity").alias(f"{end}_id")), ["document_id", label], "left")
    all_of = known.groupBy("document_id", "entity").agg(F.collect_set("mention").alias("m"))  # one entity's labels
    for end in ("source", "target"):
        df = df.join(all_of.select("document_id", F.col("entity").alias(f"{end}_id"), F.col("m").alias(f"_{end}")), ["document_id", f"{end}_id"], "left")
    df = df.join(folded, "document_id", "left")
    named = lambda c: F.coalesce(F.exists(c, lambda m: F.contains(F.col("_e"), m)), F.lit(False))
    first = F.row_number().over(Window.partitionBy("document_id", "_s", "_t", "relation_type").orderBy("source", "relation_no"))
    same = F.row_number().over(Window.partitionBy("document_id", "source_id", "target_id", "relation_type", "_ok").orderBy("_s", "_t", "relation_no"))
    quoted = F.coalesce((F.length("_e") > 0) & F.contains("_text", F.col("_e")), F.lit(False))
    status = F.when(F.col("_first") > 1, "duplicate").when(F.col("source_id").isNull() | F.col("target_id").isNull(), "endpoint").when(~quoted, "evidence").when(~named("_source"), "source").when(~named("_target"), "target").otherwise("ground")
    df = df.withColumn("_first", first).withColumn("status", status).withColumn("_ok", F.col("status") == "ground")
    df = df.withColumn("_same", same).withColumn("status", F.when(F.col("_ok") & (F.col("_same") > 1), "duplicate").otherwise(F.col("status")))
    return df.select(*relations.columns, "source_id", "target_id", "status")


def _flat(cell: str) -> str:
    return " ".join(cell.split())


def markdown_rows(table: str | None) -> list[list[str]]:
    """Rows of a Markdown table: a bar behind a backslash belongs to its cell; rules and rows without content are left out."""
    rows = []
    for line in (table or "").splitlines():
        cells, cell, escaped = [], [], False
        for c in line.strip():
            if c == "|" and not escaped:
                cells.append("".join(cell))
                cell = []
            else:
                if escaped and c != "|":
                    cell.append("\\")
                if c != "\\" or escaped:
                    cell.append(c)
            escaped = c == "\\" and not escaped
        if not cells:
            continue  # no bar, no row
        cells.append("".join(cell))
        cells = cells[not cells[0].strip() :]
        cells = [_flat(x) for x in (cells[:-1] if cells and not cells[-1].strip() else cells)]
        if any(cells) and not all(re.fullmatch(r":?-*:?", x) for x in cells):
            rows.append(cells)
    return rows


def _rows_of(read) -> Column:
    def of(s: pd.Series) -> pd.Series:
        return s.map(read)

    return F.pandas_udf(of, ArrayType(ArrayType(StringType())))


def markdown_cells(markdown: Column) -> Column:
    """Rows of cells of a Markdown table; rules and rows without content are left out."""
    return _rows_of(markdown_rows)(markdown)


def html_cells(html: Column) -> Column:
    """Rows of cells of an HTML table, without markup; rows without content are left out."""
    return _rows_of(lambda x: [r for r in table_rows(x or "") if any(r)])(html)
