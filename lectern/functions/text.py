"""Text as review sees it: normal forms, headings, bodies, keywords, samples, dates.

Patterns carry (?U) wherever they use a class by letter, so that classes are Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as content, and what is left out of bodies.
MEANINGFUL = "[^0-9A-Za-z\\u4e00-\\u9fff]+"
PLACEHOLDER = r"\[图片说明：.*?\]|!\[[^\]]*\]\([^)]*\)"
UNITS = "V mV A mA W kW Hz kHz MHz GHz ms s min mm cm m km g kg ℃ °C % dB rpm Mbps 层 S"
TERMS = "无人机 飞控 硬件 控制器 传感器 惯性测量 通信 电源 电源树 原理图 电路板 接口 固件 标定 台架测试 环回测试 振动测试 温升测试 故障排查 实验记录 复现 验证 测试 日志 部署 配置 参数"
ENTITIES = r"(?U)(?i:\b(?:STM32[A-Z0-9-]*|ICM[-A-Z0-9]*|BMP\d+|CAN(?:-FD)?|UART|SPI|I2C|USB|GNSS|GPS|IMU|PWM|ADC|DC-DC|LDO|PCB|EMI|EMC|PID|ROS2?|PX4|ArduPilot|Python|Pytest|PowerShell)\b)|\b[A-Z]{2,}[A-Z0-9-]*\d+[A-Z0-9-]*\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal(text: Column) -> Column:
    """Lower case, with only digits, Latin letters and Chinese characters."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z\\u4e00-\\u9fff]+", "")


def packed(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def squeezed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def meaningful_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), PLACEHOLDER, ""), MEANINGFUL, ""))


def content_hash(text: Column) -> Column:
    return F.sha2(packed(text), 256)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def unique(values: Column, limit: int, key: Callable[[Column], Column] = F.lower) -> Column:
    """The first of the values of each key, in their order, without blank ones, limit at most.

    Keys are met by hash; only those that are returned are looked for, so that long lists take no square of their length.
    """

    def first(v: Column) -> Column:
        return let(F.transform(v, lambda x: key(x)), lambda k: F.transform(F.slice(F.filter(F.array_distinct(k), lambda x: x != ""), 1, limit), lambda x: F.element_at(v, F.array_position(k, x).cast("int"))))

    return let(F.transform(F.array_distinct(values), lambda x: squeezed(x)), first)


def markdown_headings(text: Column, limit: int = 20) -> Column:
    return unique(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), 1), limit)


def line_headings(text: Column, limit: int = 20) -> Column:
    """Lines of 2 to 30 characters that do not end like a sentence."""
    short = F.filter(F.transform(lines(text), squeezed), lambda x: F.length(x).between(2, 30) & ~x.rlike("[。！？；.!?;]$"))
    return unique(short, limit)


def technical_entities(text: Column, limit: int = 40) -> Column:
    return unique(F.regexp_extract_all(text, F.lit(ENTITIES), 0), limit)


def parameters(text: Column, limit: int = 40) -> Column:
    """Numbers or ranges of numbers with a unit, which no other letter or digit touches."""
    units = "|".join(UNITS.split())
    number = r"[-+]?\d+(?:\.\d+)?"
    return unique(F.regexp_extract_all(text, F.lit(rf"(?Ui)(?<!\w){number}(?:\s*[~～至-]\s*{number})?\s*(?:{units})(?!\w)"), 0), limit)


def clean_body(text: Column) -> Column:
    """Lines without list marks, headings, fences, placeholders or repetitions."""
    bare = F.replace(F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, ""), r"(?m)^```[^\n]*$", ""), F.lit("【表格】"), F.lit(""))
    body = F.filter(lines(bare), lambda x: ~x.rlike(r"^\s*#{1,6}\s+"))
    parts = F.transform(body, lambda x: F.btrim(squeezed(F.regexp_replace(x, r"^\s*(?:[-+*>]|\d+[.)]|#{1,6})\s*", "")), F.lit(" |\t")))

    def once(p: Column) -> Column:
        keys = F.transform(p, packed)
        return let(keys, lambda k: F.filter(p, lambda x, i: (packed(x) != "") & (F.array_position(k, packed(x)) == i + 1)))

    return F.array_join(let(parts, once), "\n")


def clean_content(text: Column) -> Column:
    """Lines with single spaces, without blank ones."""
    return F.array_join(F.filter(F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")


def terms_by_position(text: Column, terms: list[str]) -> Column:
    """The terms that occur, by where they first do, then by themselves."""
    there = F.filter(F.array(*[F.struct(F.instr(text, F.lit(t)).alias("at"), F.lit(t).alias("term")) for t in terms]), lambda x: x["at"] > 0)
    return F.transform(F.array_sort(there), lambda x: x["term"])


def keywords(text: Column, headings: Column, entities: Column, terms: list[str] | None = None, limit: int = 30) -> Column:
    short = F.filter(headings, lambda x: F.length(x).between(2, 20))
    return unique(F.concat(short, terms_by_position(text, terms or TERMS.split()), entities), limit)


def cuts(text: Column, size: int) -> Column:
    """The text in pieces of so many characters; an empty text has none."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def segments(text: Column, size: int = 500) -> Column:
    """Sentences by their end marks and by lines, none longer than size."""
    ends = F.flatten(F.transform(lines(text), lambda x: F.split(x, "(?<=[。！？!?；;])")))
    return F.flatten(F.transform(F.filter(F.transform(ends, lambda x: F.trim(x)), lambda x: x != ""), lambda x: cuts(x, size)))


def evenly(values: Column, slots: int) -> Column:
    """At most so many of the values, the first, the last and others at equal steps (halves go to the even place)."""

    def some(v: Column) -> Column:
        n, k = F.size(v), F.least(F.size(v), F.lit(slots))
        at = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1)), 0).cast("int"))
        return F.when(n == 0, F.slice(v, 1, 0)).otherwise(F.transform(F.array_distinct(at), lambda i: F.get(v, i)))

    return let(values, some)


def query_text(title: Column, headings: Column, words: Column, entities: Column, params: Column, body: Column, limit: int) -> Column:
    """What an article is looked for by: its metadata and its body, or an even sample of it where both are too long."""
    named = [("标题", title), *((n, F.when(F.size(c) > 0, F.array_join(c, "、"))) for n, c in (("章节", headings), ("关键词", words), ("技术实体", entities), ("关键参数", params)))]
    meta = F.concat_ws("\n", *[F.concat(F.lit(f"{n}："), c) for n, c in named])
    whole = F.concat(meta, F.lit("\n正文：\n"), body)
    head = F.concat(meta, F.lit("\n正文（已按全文均匀取样）：\n"))
    slots = F.greatest(F.lit(2), F.floor((limit - F.length(head)) / 240))
    part = let(segments(body), lambda s: F.filter(s, lambda _, i: i % F.greatest(F.lit(1), F.ceil(F.size(s) / slots)) == 0))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.substring(F.concat(head, F.array_join(F.transform(part, lambda x: F.substring(x, 1, 240)), "\n")), 1, limit))


def contains_any(text: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def windows(c: Column, n: int) -> Column:
    """Runs of n of an array of characters, joined. Taking them from a text by place would walk it each time."""
    return F.array_compact(F.transform(c, lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, n)])))


def bigrams(text: Column) -> Column:
    return F.array_distinct(let(chars(text), lambda c: windows(c, 2)))


def grounding(content: Column, source: Column, common: list[str] = ()) -> Column:
    """Share of the content's pairs of characters, but for common ones, that the source has; null if there is none."""
    own = F.array_except(bigrams(content), F.array(*map(F.lit, common)).cast("array<string>"))
    return let(source, lambda s: let(own, lambda g: F.when(F.size(g) > 0, F.size(F.filter(g, lambda x: F.contains(s, x))) / F.size(g))))


def first_link(cell: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(cell, r"""https?://[^\s"')]+""", 0), "/+$", "")


def node_token(cell: Column) -> Column:
    """The token of a wiki link, or the cell itself if it looks like one, or nothing."""
    own = F.regexp_extract(cell, "/wiki/([A-Za-z0-9_-]+)", 1)
    return F.when(own != "", own).when(cell.rlike("^[A-Za-z0-9_-]{10,}$"), cell).otherwise("")


def moment(cell: Column) -> Column:
    """Time without zone of a cell: serial days, seconds or milliseconds since 1970, or ISO with - or /; else null."""
    n = F.expr("1") * 0 + cell.try_cast("double")
    seconds = F.when(n.between(20000, 80000), (n - 25569) * 86400).when(n > 1e11, n / 1000).when(n > 1e9, n)
    iso = F.try_to_timestamp(F.replace(cell, F.lit("/"), F.lit("-")))
    return F.coalesce(F.timestamp_seconds(F.round(seconds, 0).cast("long")), F.when(n.isNull(), iso))


def moment_text(cell: Column) -> Column:
    return F.coalesce(F.date_format(moment(cell), "yyyy/MM/dd HH:mm:ss"), cell)


def column_letters(index: Column) -> Column:
    """The letters of a sheet's column, from 1, for up to three letters."""
    letter = lambda n: F.char(F.lit(65) + (n - 1) % 26)
    up = lambda n: F.floor((n - 1) / 26)
    return F.concat(F.when(index > 702, letter(up(up(index)))).otherwise(""), F.when(index > 26, letter(up(index))).otherwise(""), letter(index))


def backoff(attempt: Column, most: int = 8) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def without_fence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def file_key(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"(?U)[^\w-]", "_"), 1, 120)


def cell_escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
