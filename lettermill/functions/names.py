"""File names: rules, quality, cleaning, collisions. Column expressions only, but for NFC of non-ASCII names."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..sources.shared import written

# Patterns of names that say nothing, in order.
LOW_INFO = (
    r"^(IMG|PXL|DSC|SCAN|SCN|PHOTO|VID|VIDEO|MOV|MVI|PANA|CIMG|GOPR|GH\d{2}|DJI)[-_ ]?\d+",
    r"^(IMG|PXL)[-_ ]?\d{8}[_-]?\d{4,6}.*$",
    r"^IMG-\d{8}-WA\d+.*$",
    r"^(WhatsApp Image|WeChat|LINE|LINE_ALBUM|Telegram)[-_ ]?.*$",
    r"^(Screenshot|Screen ?Shot|截圖|螢幕截圖|螢幕擷取畫面)[-_ ]?\d{4}[-_ ]?\d{2}[-_ ]?\d{2}.*$",
    r"^(掃描文件|掃描|已掃描文件)[-_ ]?\d+.*$",
    r"^[0-9_\-]{6,}$",
    r"^[0-9]{8}[_-]?[0-9]{4,6}$",
    r"^[a-f0-9]{32}$",
    r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
    r"^(new|doc|file|scan|image|document|untitled|無標題|未命名|tmp|temp)$",
    r"^(invoice|receipt|bill|statement|estimate|quote|quotation|po|purchase[_-]?order)[-_ ]?([a-z0-9]{4,}|\d{4,})([-_ ][a-z0-9]{2,})*$",
    r"^(invoice|receipt|bill|statement|quotation|quote)[-_ ]?[A-Za-z0-9]{3,}[-_ ]?\d{3,}(?:\b.*)?$",
)
# Words that say nothing beside a number, and names reserved by file systems.
GENERIC = ("invoice", "receipt", "bill", "statement", "document", "doc", "image", "photo", "scan", "scanned", "file", "untitled", "tmp", "temp", "report")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def trim(c: Column, chars: str = r"\s") -> Column:
    return F.regexp_replace(c, rf"(?U)^[{chars}]+|[{chars}]+$", "")


def split_path(path: Column) -> tuple[Column, Column]:
    """(stem, suffix) of the last part; a leading dot or a final one starts no suffix."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    suffix = F.regexp_extract(base, r"^.*[^.](\.[^.]+)$", 1)
    return F.substring(base, F.lit(1), F.length(base) - F.length(suffix)), suffix


def zfill(n: Column, width: int) -> Column:
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def rename(df: DataFrame, order: str, name: str = "name", prefix: str = "", suffix: str = "", find: str = "", replace: str = "", numbering: bool = False, start: int = 1, digits: int = 3, position: str = "suffix", batch: str | None = None) -> DataFrame:
    """Adds `renamed` and `changed`: find and replace, then prefix, suffix, and a number in order."""
    stem, ext = split_path(F.col(name))
    new = F.replace(stem, F.lit(find), F.lit(replace)) if find else stem
    new = F.concat(F.lit(prefix), new, F.lit(suffix))
    if numbering:
        df = numbered(df, [order], [batch] if batch else [], "__n")
        n = zfill(F.col("__n") - 1 + start, digits)
        new = F.concat(n, F.lit("_"), new) if position == "prefix" else F.concat(new, F.lit("_"), n)
    out = F.concat(new, ext)
    return df.withColumn("renamed", out).withColumn("changed", F.col("renamed") != F.col(name)).drop("__n")


def patterns(spec: str | None) -> list[str]:
    """The parts of a list separated by comma or semicolon; parts that aren't patterns are dropped."""
    out = []
    for p in re.split("[,;]", spec or ""):
        if p.strip():
            try:
                re.compile(p)
            except re.error:
                continue
            out.append(p)
    return out


def low_info(stem: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether a stem says nothing: too short, listed, like a camera's or scanner's, or generic words with codes."""
    s = trim(stem)
    any_of = lambda ps: F.coalesce(*[F.when(s.rlike("(?iU)" + p), True) for p in ps], F.lit(False)) if ps else F.lit(False)
    tokens = F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda t: t != "")
    generic = F.exists(tokens, lambda t: F.lower(t).isin(*GENERIC))
    coded = F.exists(tokens, lambda t: F.length(t) >= 4)
    heuristic = (F.size(tokens) <= 3) & generic & coded
    return F.when(F.length(s) < 4, True).when(any_of(patterns(include)), True).when(any_of(patterns(exclude)), False).when(any_of(LOW_INFO), True).when(F.size(tokens) == 0, True).otherwise(heuristic)


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def sanitise(name: Column) -> Column:
    """A name safe on any file system, of 120 characters at most. Expects composed characters."""
    n = F.regexp_replace(name, r"\p{C}", "")
    n = F.regexp_replace(n, r'[\\/:*?"<>|]', " ")
    n = F.regexp_replace(n, r"(?U)\s+", " ")
    n = F.regexp_replace(n, r"^[ .]+|[ .]+$", "")
    n = F.when(F.upper(n).isin(*RESERVED), F.concat(F.lit("_"), n)).otherwise(n)
    n = F.when(F.length(n) > 120, F.regexp_replace(F.substring(n, 1, 120), r"(?U)\s+$", "")).otherwise(n)
    return F.when(n == "", "unnamed").otherwise(n)


def sanitised(df: DataFrame, name: str) -> DataFrame:
    """`name` cleaned by sanitise, composed to NFC first; only rows that aren't ASCII leave the JVM."""
    plain = df.filter(F.coalesce(~F.col(name).rlike(r"[^\x00-\x7F]"), F.lit(True)))
    other = df.filter(F.col(name).rlike(r"[^\x00-\x7F]")).withColumn(name, F.pandas_udf(_nfc, "string")(name))
    return plain.unionByName(other).withColumn(name, sanitise(F.col(name)))


def attachment_name(name: Column) -> Column:
    n = F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
    return F.when(n.endswith(".pdf"), n).otherwise(F.concat(n, F.lit(".pdf")))


def roc_date(d: Column) -> Column:
    return F.concat(zfill(F.greatest(F.lit(1), F.year(d) - 1911), 3), F.date_format(d, "MMdd"))


def suggestion(raw: Column) -> Column:
    marks = r"'\"“”`，。！!？?：:；;\[\]（）(){}《》<> "
    return sanitise(F.regexp_replace(trim(raw), f"^[{marks}]+|[{marks}]+$", ""))


def allowed(ext: Column, spec: str) -> Column:
    """Whether the extension is among those of a text such as "pdf; .DOCX"; an empty list allows all."""
    want = sorted({"." + p.strip().lower().lstrip(".") for p in re.split("[,;]", spec) if p.strip()})
    return F.lower(ext).isin(*want) if want else F.lit(True)


def apply_map(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Files by a rename map (original, renamed, pos): the last entry of a name counts for all its rows."""
    last = renames.groupBy("original").agg(F.max_by("renamed", "pos").alias("new"))
    out = files.join(last, files["name"] == last["original"], "left")
    return out.select(*[files[c] for c in files.columns], F.coalesce("new", "name").alias("renamed"))


#: Numbers that a name can get: "stem (2)" to "stem (999)".
MOST = 999
_K = r"([2-9]|[1-9]\d{1,2})"
#: A numbered name with a suffix, or one without: stem, number, suffix; stem, number.
NUMBERED = rf"^(?:(.*[^.]) \({_K}\)(\.[^.]+)|(\.*[^.]*) \({_K}\))$"


def _free(n: Column, taken: Column) -> Column:
    """The n-th number from 2 that is not among the sorted taken ones."""
    return F.aggregate(taken, n + 1, lambda s, t: F.when(t <= s, s + 1).otherwise(s))


def _family(name: str) -> tuple[Column, Column]:
    """(name, number) of which a name is the numbered form; null where it is none."""
    part = lambda *groups: F.nullif(F.concat(*[F.regexp_extract(F.col(name), NUMBERED, g) for g in groups]), F.lit(""))
    return part(1, 3, 4), part(2, 5).cast("int")


def _target(name: str, nth: Column, slot: Column, numbered_name: Column, late: Column) -> Column:
    return F.when(nth == 0, F.col(name)).when(slot <= MOST, numbered_name).otherwise(late)


def _settled(wanted: DataFrame) -> DataFrame:
    """Which wanted names go to the first row that asks for them, and which numbers of a name others hold.

    A name "stem (k)" is lost to a row that asked for "stem" and reached k before
    anyone asked for it. Whether that is so follows from the times at which both
    are asked for, and from the smaller numbers of the same stem; so all forms of
    a stem are decided in one pass, and those of "stem (k)" itself in the next, in
    as many rounds as names are nested. A pass sees at most 998 numbers and the
    first 1,000 rows of a name, as there are no more numbers to give.
    """
    kids = wanted.filter(F.col("__of").isNotNull()).join(wanted.select(F.col("__name").alias("__of")), "__of", "left_semi")
    deepest = kids.agg(F.max(F.length(F.regexp_extract("__name", rf"((?: \({_K}\))+)(?:\.[^.]+)?$", 1)))).first()[0]
    none = F.array().cast("array<int>")
    if deepest is None:
        return wanted.select("__name", (~F.col("__there")).alias("__plain"), F.col("__taken").alias("__used"))
    fold = wanted.join(kids.select("__name"), "__name", "left_anti").withColumn("__plain", ~F.col("__there"))
    out = None
    for _ in range(deepest // 4 + 1):
        order = F.struct(F.col("__k").alias("k"), F.element_at("__times", 1).alias("first"), F.col("__name").alias("name"), F.col("__there").alias("there"))
        under = kids.groupBy(F.col("__of").alias("__name")).agg(F.array_sort(F.collect_list(order)).alias("__kids"))
        fold = fold.join(under, "__name", "left")
        asked = F.slice("__times", F.when(F.col("__plain"), 2).otherwise(1), F.lit(MOST + 1))  # by those that get a number

        def step(state, kid):
            before = F.size(F.filter("__taken", lambda t: (t >= 2) & (t < kid["k"])))
            nth = kid["k"] - 1 - before - F.size(state)  # the row that comes to this number
            lost = kid["there"] | F.coalesce(F.try_element_at(asked, F.greatest(nth, F.lit(1))) < kid["first"], F.lit(False))  # noqa: B023
            return F.when(lost, state).otherwise(F.array_append(state, kid["k"]))

        won = F.aggregate(F.coalesce("__kids", F.array().cast(under.schema["__kids"].dataType)), none, step)
        fold = written(fold.withColumn("__won", won), "names")
        done = fold.select("__name", "__plain", F.array_sort(F.array_union("__taken", "__won")).alias("__used"))
        out = done if out is None else out.unionByName(done)
        plain = fold.select(F.explode("__kids").alias("kid"), "__won").select(F.col("kid.name").alias("__name"), F.array_contains("__won", F.col("kid.k")).alias("__plain"))
        fold = kids.join(plain, "__name")
    return out


def collision_free(new: DataFrame, existing: DataFrame, order: str, name: str = "name", stamp: str = "0", once: bool = True) -> DataFrame:
    """Adds `target`: the name, or its first free "stem (k)" from k = 2, as if rows came one by one in order.

    A name is free while it does not exist and no earlier row holds it, be it
    asked for or given as the numbered form of another. Past 999 the stem gets
    `stamp`, and from the second such row on `stamp` and its first free number
    from 2; names that exist or are asked for are passed over. Without `once` the
    bare stamp is given as often as it is needed, whatever has it. No step brings
    together all rows of a name.
    """
    stem, ext = split_path(F.col(name))
    taken = existing.select(F.col(name).alias("__name")).distinct()
    of, k = _family("__name")
    numbers = taken.select(of.alias("__name"), k.alias("__k")).filter("__name IS NOT NULL").groupBy("__name").agg(F.array_sort(F.collect_set("__k")).alias("__taken"))
    rows = numbered(new, [order], [name], "__n")
    times = rows.filter(F.col("__n") <= MOST + 1).groupBy(F.col(name).alias("__name")).agg(F.array_sort(F.collect_list(order)).alias("__times"))
    wanted = times.join(taken.withColumn("__hit", F.lit(True)), "__name", "left").join(numbers, "__name", "left").select(
        "__name", "__times", F.coalesce("__hit", F.lit(False)).alias("__there"), F.coalesce("__taken", F.array().cast("array<int>")).alias("__taken"), of.alias("__of"), k.alias("__k")
    )
    wanted = written(wanted, "wanted")
    rows = rows.join(_settled(wanted), F.col(name) == F.col("__name"))
    nth = (F.col("__n") - F.when(F.col("__plain"), 1).otherwise(0)).cast("int")  # 0: the name itself
    slot = _free(nth, F.col("__used"))
    numbered_name = F.concat(stem, F.lit(" ("), slot.cast("string"), F.lit(")"), ext)
    if not once:
        late = F.concat(stem, F.lit("."), F.lit(stamp), ext)
        return rows.select(*new.columns, _target(name, nth, slot, numbered_name, late).alias("target"))
    # names that look stamped, read with and without a suffix; the bare stamp counts as 1
    known = taken.union(wanted.select("__name")).distinct()
    parts = [rf"^(.*)\.{re.escape(stamp)}(?:-([2-9]|[1-9]\d{{1,8}}))?({suffix})$" for suffix in (r"\.[^.]+", "")]
    stamped = [known.filter(F.col("__name").rlike(p)).select(F.concat(*[F.regexp_extract("__name", p, g) for g in (1, 3)]).alias("__of"), F.regexp_extract("__name", p, 2).alias("__m")) for p in parts]
    number = F.when(F.col("__m") == "", 1).otherwise(F.expr("try_cast(__m AS int)"))
    stamps = stamped[0].union(stamped[1]).groupBy("__of").agg(F.array_sort(F.collect_set(number)).alias("__stamps"))
    rows = rows.join(stamps, F.col(name) == F.col("__of"), "left")
    past = nth - (MOST - 1) + F.size("__used")
    m = F.aggregate(F.coalesce("__stamps", F.array().cast("array<int>")), past, lambda s, t: F.when(t <= s, s + 1).otherwise(s))
    late = F.concat(stem, F.lit("."), F.lit(stamp), F.when(m == 1, "").otherwise(F.concat(F.lit("-"), m.cast("string"))), ext)
    return rows.select(*new.columns, _target(name, nth, slot, numbered_name, late).alias("target"))


def suggest(files: DataFrame, only: str = "", as_roc: bool = True) -> DataFrame:
    """Adds reason and target: extension, low information, content, model answer, in that order.

    Needs name, stem, ext, mdate, snippet (text of the file) and answer (the model's).
    """
    reason = (
        F.when(~allowed(F.col("ext"), only), "skip-ext").when(~low_info(F.col("stem")), "not-low")
        .when(F.coalesce("snippet", F.lit("")) == "", "no-content:low-info").when(F.coalesce("answer", F.lit("")) == "", "llm-fail:low-info").otherwise("ok")
    )
    head = F.concat(roc_date(F.col("mdate")), F.lit("_")) if as_roc else F.lit("")
    out = files.withColumn("reason", reason)
    return out.withColumn("target", F.when(F.col("reason") == "ok", F.concat(sanitise(F.concat(head, suggestion(F.col("answer")))), F.col("ext"))))


def apply_plan(items: DataFrame, catalogue: DataFrame, order: str, once: bool = True) -> DataFrame:
    """Status of each requested rename (name, wanted): nothing is moved, the rows are the plan; `once` as for collision_free."""
    there = catalogue.select("name").distinct().withColumn("__there", F.lit(True))
    status = (
        F.when((F.coalesce("name", F.lit("")) == "") | (F.coalesce("wanted", F.lit("")) == ""), "missing-fields")
        .when(F.col("__there").isNull(), "source-missing").when(F.col("name") == F.col("wanted"), "same-name").otherwise("renamed")
    )
    out = items.join(there, "name", "left").withColumn("status", status).drop("__there")
    moved = collision_free(out.filter("status = 'renamed'").withColumn("__s", F.col("name")).withColumn("name", F.col("wanted")), catalogue, order, once=once)
    moved = moved.withColumn("name", F.col("__s")).drop("__s")
    return moved.unionByName(out.filter("status <> 'renamed'").withColumn("target", F.lit(None).cast("string")))


def oversize(size: Column, limit: int = 10 << 20) -> Column:
    """A message for sizes above the limit, else null."""
    mb = F.format_string("%.1f", F.floor(size / (1 << 20) * 10 + 0.5) / 10)
    return F.when(size > limit, F.concat(F.lit("file too large: "), mb, F.lit(f" MB, limit {limit >> 20} MB")))


def intake(rows: DataFrame, batch: str, order: str, most: int = 50, limit: int = 20 << 20) -> DataFrame:
    """Files taken in: batches of more than `most` are refused, larger files dropped, unnamed ones numbered."""
    n = rows.groupBy(batch).agg(F.count("*").alias("__n"))
    kept = rows.join(n, batch).filter((F.col("__n") <= most) & (F.col("size") <= limit))
    w = Window.partitionBy(batch).orderBy(order)
    at = F.row_number().over(w) - 1
    return kept.withColumn("__at", at).withColumn("name", F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("image_"), F.col("__at").cast("string"))).otherwise(F.col("name"))).drop("__n", "__at")
