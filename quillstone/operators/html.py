"""Legal HTML: blocks, heading tree, plain text; Markdown to HTML. Parsing is row by row in Arrow batches, the tree in window functions."""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import tree_id

# Elements that are blocks, and elements whose content is not text.
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table", "div")
SILENT = ("script", "style", "noscript")
# Levels of the tree and how their lines begin.
LEVELS = ["chuong", "muc", "dieu", "khoan", "diem"]
STARTS = {"chuong": r"(?iu)^#{0,6}\s*chương\s+[ivxlcdm0-9]+(?![\p{L}\p{N}_])", "muc": r"(?iu)^#{0,6}\s*mục\s+\d+(?![\p{L}\p{N}_])", "dieu": r"(?iu)^#{0,6}\s*điều\s+\d+\."}
CLAUSE, POINT = r"^(\d{1,2})\.\s+\S", r"(?iu)^([a-zđ]{1,2})\)\s+\S"
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Text of every block element in document order; a div that holds blocks is skipped; table cells are joined by ' | '."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.found: list[dict] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS:
            for o in self.open:
                o["nested"] = True
            if tag == "p" and self.open and self.open[-1]["tag"] == "p":
                self.open.pop()
            block = {"tag": tag, "text": [], "nested": False, "rows": []}
            self.open.append(block)
            self.found.append(block)
        if tag == "tr":
            for o in self.open:
                o["rows"].append([])
        if tag in ("td", "th"):
            for o in self.open:
                (o["rows"] or o["rows"].append([]) or o["rows"])[-1].append([])
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in BLOCKS and any(o["tag"] == tag for o in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if self.silent:
            return
        for o in self.open:
            o["text"].append(data)
            if o["rows"] and o["rows"][-1]:
                o["rows"][-1][-1].append(data)


def html_blocks_of(page: str | None) -> list[tuple[str, bool]]:
    """(text, is table) of a page's blocks."""
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    out = []
    clean = lambda parts: _SPACE.sub(" ", "".join(parts)).strip()
    for b in parser.found:
        if b["tag"] == "div" and b["nested"]:
            continue
        if b["tag"] == "table":
            lines = [" | ".join(clean(c) for c in row) for row in b["rows"] if row]
            text = "\n".join(x for x in lines if x.strip(" |"))
        else:
            text = clean(b["text"])
        if text:
            out.append((text, b["tag"] == "table"))
    return out


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT[:2]

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT[:2]))

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def plain_text_of(page: str | None) -> str:
    """All text nodes joined by line ends."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.parts)


def html_text(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(plain_text_of), "string")(F.coalesce(c, F.lit("")))


def meta_content(c: Column, name: str) -> Column:
    """content of a <meta name=…>; null without."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), rf'(?is)<meta\s+name=["\']{name}["\']\s+content=["\']([^"\']*)["\']', 1), F.lit(""))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, text, is_table."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(rows):
        for pdf in rows:
            out = [(k, i, t, is_table) for k, page in zip(pdf["k"], pdf["h"], strict=True) for i, (t, is_table) in enumerate(html_blocks_of(page))]
            frame = pd.DataFrame(out, columns=["k", "at", "text", "is_table"])
            yield frame.astype({"k": pdf["k"].dtype}) if len(frame) else frame.astype({"k": pdf["k"].dtype, "at": "int32", "is_table": bool})

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(parse, f"k {kind}, at int, text string, is_table boolean").withColumnRenamed("k", key)


def heading_tree(rows: DataFrame, doc: str, at: str = "at", text: str = "text", is_table: str = "is_table") -> DataFrame:
    """Blocks as a tree: level, heading, chunk_id, parent_id, order.

    Clauses and points count only inside an article: the latest heading of chapter, section and article level is an article.
    A heading's parent is the latest heading of a higher level that no heading of a still higher level has closed.
    """
    order = W.partitionBy(doc).orderBy(at)
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    body = F.trim(F.col(text))
    major = F.when(F.col(is_table), None)
    for level in ("chuong", "muc", "dieu"):
        major = major.when(body.rlike(STARTS[level]), level)
    rows = rows.withColumn("__major", major)
    inside = F.last("__major", ignorenulls=True).over(before) == "dieu"
    minor = F.when(~F.col(is_table) & F.col("__major").isNull() & F.coalesce(inside, F.lit(False)), F.when(body.rlike(CLAUSE), "khoan").when(body.rlike(POINT), "diem"))
    rows = rows.withColumn("level", F.coalesce("__major", minor, F.when(F.col(is_table), "bang").otherwise("doan")))
    for k, level in enumerate(LEVELS):
        hit = F.when(F.col("level") == level, F.col(at))
        rows = rows.withColumn(f"__at{k}", F.last(hit, ignorenulls=True).over(upto)).withColumn(f"__n{k}", F.count(hit).over(upto))
    live = []  # the path of headings in force at a row, itself included
    for k in range(len(LEVELS)):
        higher = F.greatest(F.lit(-1), *(F.coalesce(f"__at{j}", F.lit(-1)) for j in range(k))) if k else F.lit(-1)
        live.append(F.when(F.col(f"__at{k}") > higher, F.concat(F.lit(LEVELS[k]), F.col(f"__n{k}").cast("string"))))
    rank = F.coalesce(*(F.when(F.col("level") == level, k) for k, level in enumerate(LEVELS)), F.lit(99))
    leaf = F.count(F.when(F.col("level").isin("doan", "bang"), 1)).over(upto)
    path = F.array_compact(F.array(*(F.when(rank >= k, live[k]) for k in range(len(LEVELS)))))
    rows = rows.withColumn("__path", F.when(rank == 99, F.concat(path, F.array(F.concat("level", leaf.cast("string"))))).otherwise(path))
    own = F.array_join("__path", "/")
    up = F.array_join(F.slice("__path", 1, F.size("__path") - 1), "/")
    return rows.select(
        doc, F.col(at).alias("order_index"), "level", F.when(F.col("__major").isNotNull(), F.col(text)).alias("heading"), text, tree_id(F.col(doc).cast("string"), own).alias("chunk_id"),
        F.when(F.size("__path") > 1, tree_id(F.col(doc).cast("string"), up)).alias("parent_id"), (F.size("__path") == 1).alias("document_fallback"),
    )


def markdown_to_html_of(text: str | None) -> str:
    """Headings, paragraphs and verbatim tables; bold marks go; everything else is escaped."""
    out, table = [], False
    for line in (text or "").split("\n"):
        if re.match(r"\s*<table", line, re.I):
            table = True
        if table:
            out.append(line)
            table = not re.search(r"</table>", line, re.I)
            continue
        said = re.sub(r"\*\*(.+?)\*\*", r"\1", line.strip())
        if not said:
            continue
        m = re.match(r"(#{1,6})\s+(.*)", said)
        out.append(f"<h{len(m[1])}>{_html.escape(m[2].strip())}</h{len(m[1])}>" if m else f"<p>{_html.escape(said)}</p>")
    return "\n".join(out)


def markdown_to_html(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(markdown_to_html_of), "string")(F.coalesce(c, F.lit("")))


def document_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, title: documents that the lines 'Căn cứ …' name by number, each once (its first line)."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"))
    body = F.regexp_extract(F.trim("line"), r"(?iu)^căn cứ\s+(.+?)[;.]?\s*$", 1)
    number = F.regexp_replace(F.regexp_extract(body, r"(?<![\p{L}\p{N}])(\d+\s*/\s*\d{4}\s*/\s*[A-ZĐ][A-Z0-9Đ\-]*)", 1), r"\s+", "")
    found = lines.select(key, "at", number.alias("number"), body.alias("title")).filter("number != ''")
    return found.groupBy(key, "number").agg(F.min_by("title", "at").alias("title"))


def own_number(c: Column) -> Column:
    """The number of a document's own 'Số:' line."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?m)^Số:\s*(\S.*?)\s*$", 1), r"\s+", ""), F.lit(""))
