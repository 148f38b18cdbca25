"""Blocks of documents: Markdown, tables, trees and messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_escape


def joined(rows: DataFrame, keys: list[str], order: str, value: Column, sep: str, name: str) -> DataFrame:
    """Values of each key in their order, joined; nulls are left out."""
    parts = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["v"]), sep).alias(name))


def rendered(kind: Column, text: Column, level: Column, image: Column) -> Column:
    """One block as Markdown; image is its running number."""
    depth = F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("int")
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), text)).when(kind == "bullet", F.concat(F.lit("- "), text)).when(kind == "ordered", F.concat(F.lit("1. "), text)).when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind == "image", F.concat(F.lit("[image "), image.cast("string"), F.lit(": "), text, F.lit("]"))).otherwise(text)


def to_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks key, pos, kind, text and level become key, markdown and counts."""
    number = F.sum((F.col("kind") == "image").cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    rows = blocks.withColumn("_md", rendered(F.col("kind"), F.col("text"), F.col("level"), number))
    parts = F.array_sort(F.collect_list(F.struct("pos", "_md")))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["_md"]), "\n\n").alias("markdown"), F.count("*").alias("blocks"), F.count_if(F.col("kind") == "image").alias("images"), F.sum(F.length("text")).alias("chars"))


def grid(cells: DataFrame, key: str) -> DataFrame:
    """Sparse cells key, r, c (from 0) and text become a Markdown table; of cells of one place the least text counts."""
    one = cells.groupBy(key, "r", "c").agg(F.min("text").alias("text"))
    rows = one.groupBy(key, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("m"))
    size = one.groupBy(key).agg(F.max("c").alias("width"), F.max("r").alias("height"))
    full = size.select(key, "width", F.explode(F.sequence(F.lit(0), F.col("height"))).alias("r")).join(rows, [key, "r"], "left")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width")), lambda c: cell_escape(F.try_element_at("m", c))), " | ")
    return joined(full, [key], "r", F.concat(F.lit("| "), text, F.lit(" |")), "\n", "grid")


def matrix_markdown(rows: Column) -> Column:
    """An array of rows of cells as Markdown, with a rule below the first."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell_escape), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    body = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 2**30)), "\n")


def markdown_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cells key, r, c and cell of lines with bars, but for rules."""
    at = docs.select(key, F.posexplode(F.split(text, "\n")).alias("r", "line")).filter(F.contains("line", F.lit("|")) & ~F.col("line").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\|", ""), r"\|$", "")
    return at.select(key, F.col("r").cast("long").alias("r"), F.posexplode(F.split(inner, r"\|")).alias("c", "cell")).select(key, "r", F.col("c").cast("long").alias("c"), F.trim("cell").alias("cell"))


def heading_kind(line: Column) -> Column:
    """What a paragraph is by how it starts."""
    return F.when(line.rlike(r"^#{1,6}\s"), "markdown").when(line.rlike(r"^[0-9]+([.][0-9]+)*[.)]?\s"), "numbered").when(line.rlike("^第.+[章节]"), "chapter").when(line.rlike(r"^[-*•]\s"), "bullet").when((F.length(line) <= 40) & ~line.rlike(r"[.。!?,，;；:]$"), "short").otherwise("text")


def split_message(text: str, most: int) -> list[str]:
    """Parts of a message within so many bytes, at least four: paragraphs together while they fit, without white space at
    the ends of what is together; longer ones are cut between characters, and their rest takes in what follows."""
    if most < 4:
        raise ValueError("a character may take four bytes")
    parts, current = [], ""
    for paragraph in text.split("\n\n"):
        both = f"{current}\n\n{paragraph}".strip()
        if len(both.encode()) <= most:
            current = both
            continue
        parts += [current] if current else []
        current = paragraph
        while len(current.encode()) > most:
            parts.append(current.encode()[:most].decode("utf-8", "ignore"))
            current = current[len(parts[-1]) :]
    parts += [current] if current else []
    return [f"（{i}/{len(parts)}）\n{p}" for i, p in enumerate(parts, 1)] if len(parts) > 1 else parts


def message_parts(messages: DataFrame, key: str, text: str, most: int = 12000) -> DataFrame:
    """Rows key, part (from 1), parts and body."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, len(p), x) for k, t in zip(b[key], b[text], strict=True) for p in [split_message(t or "", most)] for i, x in enumerate(p, 1)]
            yield pd.DataFrame(rows, columns=[key, "part", "parts", "body"])

    rows = messages.select(key, text)
    return rows.mapInPandas(work, f"{key} {dict(rows.dtypes)[key]}, part long, parts long, body string")
