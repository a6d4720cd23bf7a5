"""Documents as typed blocks and lines, rule-based types, masking."""
from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import pieces, tidy
from .names import trim

# Cue words of each document type.
CUES = {
    "exam": ("題目", "配分", "學號", "答案卷"), "official": ("發文字號", "主旨", "說明", "辦法"), "receipt": ("金額", "品項", "統一編號"),
    "contract": ("甲乙方", "條款", "簽章"), "report": ("章節", "圖表", "參考文獻"), "letter": ("稱謂", "敬啟", "署名"), "form": ("欄位", "勾選", "填寫"),
}
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "dt", "dd", "figcaption")
MASKED = r"\b[A-Z][12]\d{8}\b|\b\d{10,16}\b"


def markdown_blocks(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per block: heading (level 1, 2, or 3 for deeper), list item, fenced code, or paragraph of joined lines."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    w = Window.partitionBy(key).orderBy("line")
    fence = F.col("raw").startswith("```")
    lines = lines.withColumns({"fence": fence, "inside": F.sum(fence.cast("int")).over(w) % 2 == 1})
    kind = (
        F.when(F.col("fence"), "fence").when(F.col("inside"), "code").when(F.col("raw").rlike(r"^# "), "h1").when(F.col("raw").rlike(r"^## "), "h2")
        .when(F.col("raw").rlike(r"^#{3,6} "), "h3").when(F.col("raw").rlike(r"^\s*([-*+]|\d+\.) "), "li").when(trim(F.col("raw")) == "", "blank").otherwise("p")
    )
    lines = lines.withColumn("kind", kind).withColumn("body", F.regexp_replace("raw", r"^(#{1,6} |\s*([-*+]|\d+\.) )", ""))
    before = F.lag("kind").over(w)
    starts = before.isNull() | (before != F.col("kind")) | ~F.col("kind").isin("p", "code")
    lines = lines.withColumn("block", F.sum(starts.cast("int")).over(w)).filter(~F.col("kind").isin("fence", "blank"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.when(F.col("kind") == "code", F.col("raw")).otherwise(F.col("body")).alias("b")))), lambda x: x["b"]), "\n")
    return lines.groupBy(key, "block", "kind").agg(joined.alias("body"))


class _Walk(HTMLParser):
    """Innermost blocks of a page's body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.stack: list[list] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in BLOCKS:
            if self.stack and self.stack[-1][0] == tag and tag in ("li", "p"):  # its end tag may be left out
                self._emit(*self.stack.pop())
            self.stack.append([tag, []])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif any(s[0] == tag for s in self.stack):
            while self.stack:
                name, parts = self.stack.pop()
                self._emit(name, parts)
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.skip and self.stack:
            self.stack[-1][1].append(data)

    def _emit(self, name: str, parts: list[str]) -> None:
        text = " ".join("".join(parts).split())
        if text:
            self.out.append((name, text))

    def done(self) -> list[tuple[str, str]]:
        self.close()
        while self.stack:
            self._emit(*self.stack.pop())
        return self.out


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per innermost block element of a page: its place, tag, and XML-escaped text."""

    schema = StructType([pages.schema[key], *StructType.fromDDL("pos int, tag string, body string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            at, pos, tags, bodies = [], [], [], []
            for row, text in enumerate(piece.column(1).to_pylist()):
                walk = _Walk()
                walk.feed(text or "")
                out = walk.done()
                at += [row] * len(out)
                pos += range(len(out))
                tags += [tag for tag, _ in out]
                bodies += [body for _, body in out]
            keys = piece.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), pa.array(tags, pa.string()), pa.array(bodies, pa.string())], names=schema.names)

    out = pages.select(key, html).mapInArrow(tidy(run), schema)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = out.withColumn("body", F.replace("body", F.lit(a), F.lit(b)))
    return out


def to_markdown(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, pos, style, body) to one text, joined by blank lines."""
    mark = F.when(F.col("style") == "h1", "# ").when(F.col("style") == "h2", "## ").when(F.col("style") == "h3", "### ").when(F.col("style") == "li", "- ").otherwise("")
    line = F.struct("pos", F.concat(mark, "body").alias("l"))
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n\n").alias("markdown"))


def page_lines(parts: DataFrame, key: str, page: str, text: str = "text") -> DataFrame:
    """Trimmed non-empty lines; the first of every page but the first breaks the page."""
    lines = parts.select(key, page, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).withColumn("line", trim(F.col("raw"))).filter("line <> ''")
    w = Window.partitionBy(key, page).orderBy("pos")
    return lines.select(key, page, "pos", "line", ((F.row_number().over(w) == 1) & (F.col(page) > 0)).alias("page_break"))


def with_doc_type(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds doc_type, the type with most cues, the first of equals, `other` without any; and confidence, its share of all cues.

    Cues are looked for once, in a projection of their own; later ones read the counts.
    """
    count = lambda cues: sum((F.contains(F.col(text), F.lit(c)).cast("int") for c in cues), F.lit(0))
    counted = df.withColumn("__cues", F.array(*[F.struct(count(cues).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, cues) in enumerate(CUES.items())]))
    counted = counted.withColumns({"__best": F.array_max("__cues"), "__all": F.aggregate("__cues", F.lit(0), lambda a, h: a + h["n"])})
    some = F.coalesce(F.col("__all") > 0, F.lit(False))
    out = counted.withColumns({"doc_type": F.when(some, F.col("__best.t")).otherwise("other"), "confidence": F.when(some, F.col("__best.n") / F.col("__all")).otherwise(0.0)})
    return out.drop("__cues", "__best", "__all")


def masked(text: Column) -> tuple[Column, Column]:
    """Text with ids and account numbers masked, and how many there were."""
    return F.regexp_replace(text, MASKED, "***"), F.regexp_count(text, F.lit(MASKED))


def prefix_text(parts: DataFrame, key: str, order: str, text: str = "text", most_chars: int = 2000, most_parts: int = 5) -> DataFrame:
    """The first parts, up to the one that exceeds the budget, joined, white space collapsed, cut to the budget."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = parts.withColumns({"__b": before, "__n": F.row_number().over(w)}).filter((F.col("__b") <= most_chars) & (F.col("__n") <= most_parts))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return kept.groupBy(key).agg(F.substring(trim(F.regexp_replace(joined, r"(?U)\s+", " ")), 1, most_chars).alias("snippet"))
