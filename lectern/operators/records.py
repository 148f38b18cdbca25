"""Rows of the review sheet as typed records, and the rules on one record."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

# The sheet's header, methods and states.
HEADER = ["序号", "文档名称", "文档链接", "文档所属知识库", "投稿人", "审稿方式", "审稿人", "当前文档状态", "审稿轮次", "文档更新时间", "上次AI审稿时间", "公示时间", "node_token", "obj_token"]
AI_METHODS = ("AI", "人工+AI")
AI_STATES = ("AI审稿中", "已修改待复审")
METHODS = {"ai": "AI", "人工+ai": "人工+AI"}
STATES = {"待分配审稿": "待分配人工审稿", "已驳回": "已拒稿"}
WIDTH = len(HEADER)
MOST_ROUNDS = 2**31 - 1


def cell_text(cell: Column) -> Column:
    """What a cell shows: of an object in JSON its text, name or token, of a list of these all of them, else itself."""
    one = lambda x: F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("text", "name", "token")], F.lit(""))
    items = F.from_json(cell, "array<struct<text:string,name:string,token:string>>")
    many = F.array_join(F.transform(items, lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), F.nullif(x["name"], F.lit("")), x["token"], F.lit(""))), "")
    return F.btrim(F.when(cell.startswith("{"), one(cell)).when(cell.startswith("["), F.coalesce(many, cell)).otherwise(F.coalesce(cell, F.lit(""))), F.lit(" \t\r\n\u3000"))


def cell_link(cell: Column) -> Column:
    """The first link in a cell, its link field first."""
    own = F.when(cell.startswith("{"), F.get_json_object(cell, "$.link"))
    return F.coalesce(F.nullif(own, F.lit("")), T.first_link(F.coalesce(cell, F.lit(""))))


def renamed(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def records_of(rows: DataFrame) -> DataFrame:
    """Records of sheet rows row_no (from 1, the header) and cells; rows without anything behind the first cell go.

    Short rows are filled up. error names a round that is no whole number from 0 to MOST_ROUNDS; other fields are then as
    they are. What the cells of a row show is worked out once, and is what all fields are made of.
    """
    header = rows.filter("row_no = 1").select(F.transform(F.slice("cells", 1, WIDTH), cell_text).alias("h")).first()
    if header is None or header["h"] != HEADER:
        raise ValueError("the header of the review sheet is not the agreed one")
    full = rows.filter("row_no > 1").select("row_no", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.get("cells", i), F.lit(""))).alias("c"))
    full = full.select("row_no", F.get("c", F.lit(2)).alias("link_cell"), F.transform("c", cell_text).alias("t"))
    full = full.select("row_no", "t", cell_link(F.col("link_cell")).alias("link")).filter(F.exists(F.slice("t", 2, WIDTH - 1), lambda x: x != ""))
    c = lambda i: F.get("t", F.lit(i))
    number = F.coalesce(F.nullif(c(8), F.lit("")), F.lit("0")).try_cast("double")
    whole = F.coalesce((number >= 0) & (number <= MOST_ROUNDS) & (number == F.floor(number)), F.lit(False))
    method = F.replace(F.replace(c(5), F.lit("＋"), F.lit("+")), F.lit(" "), F.lit(""))
    link, node = F.col("link"), c(12)
    token = T.node_token(F.when(link != "", link).otherwise(c(2)))
    fields = {
        "title": c(1),
        "link": link,
        "wiki_name": c(3),
        "author": c(4),
        "method": renamed(method, METHODS),
        "reviewer": c(6),
        "status": renamed(c(7), STATES),
        "round": F.when(whole, number.try_cast("int")),
        "updated": T.moment_text(c(9)),
        "reviewed": T.moment_text(c(10)),
        "published": c(11),
        "node": F.when(node != "", node).otherwise(token),
        "obj": c(13),
        "error": F.when(~whole, "illegal_round"),
    }
    return full.select("row_no", *[v.alias(k) for k, v in fields.items()])


def published() -> Column:
    return (F.col("published") != "") | (F.col("status") == "已公示")


def eligible() -> Column:
    """Whether a record is reviewed without anyone asking for it."""
    return F.col("method").isin(*AI_METHODS) & F.col("status").isin(*AI_STATES) & ~published() & (F.col("node") != "") & (F.col("obj") != "")


def newer(a: Column, b: Column) -> Column:
    """Whether one moment is behind another; false where either is none."""
    return F.coalesce(T.moment(a) > T.moment(b), F.lit(False))


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """JSON text with the names of every object sorted, a space behind each comma and colon, and no ASCII escapes; null for
    what is no JSON. Numbers are written as Python does, whatever they were written like."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return texts.map(one)


def digest(value: Column) -> Column:
    """The SHA-256 of a struct, map or array as canonical JSON, whose null fields are null."""
    return text_digest(F.to_json(value, {"ignoreNullFields": "false"}))


def text_digest(text: Column) -> Column:
    """The SHA-256 of JSON text in its canonical form."""
    return F.sha2(canonical(text).cast("binary"), 256)
