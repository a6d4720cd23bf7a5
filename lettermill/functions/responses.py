"""Model responses and chat texts: tolerant JSON recovery, validation, parsers of lines and postbacks."""
from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.contacts import is_email
from .names import trim

#: The whole record, each field with its kind.
RESULT = {
    "doc_type": "string", "doc_type_label": "string", "confidence": "double", "subject": "string", "body": "string", "filename": "string",
    "extracted_text_summary": "string", "detected_language": "string", "suggested_recipients": "array<string>",
}
REQUIRED = ("doc_type", "subject", "body", "filename")
LEAST_CONFIDENCE = 0.3
DEEPEST = 1000  # nesting that the JSON reader takes
# Ends that a response cut off in the middle may have, dropped in this order.
CUT_ENDS = (r',\s*"[^"]*"\s*:\s*"[^"]*$', r',\s*"[^"]*"\s*:\s*\[[^\]]*$', r',\s*"[^"]*"\s*:\s*$', r',\s*"[^"]*$', r',\s*$')


def _is_object(c: Column) -> Column:
    """Whether the text is one JSON object, nested to any depth; repeated keys in an object are no JSON here.

    As the only element of an array, so that nothing may follow it.
    """
    got = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.startswith(F.ltrim(c), F.lit("{")) & got.isNotNull() & F.try_variant_get(got, "$[1]", "variant").isNull()


def _closers(text: Column) -> Column:
    """What closes all that is open at the end, innermost first; null where a bracket is closed that isn't open.

    Brackets inside strings don't count. Null too where more is open than `DEEPEST`, which no text that parses has.
    """
    outside = F.regexp_replace(text, r'(?s)"(?:\\.|[^"\\])*+(?:"|\\?\z)', "")
    marks = F.split(F.regexp_replace(outside, r"[^\[\]{}]+", ""), "")

    def step(todo: Column, mark: Column) -> Column:
        opened = F.when(F.length(todo) < DEEPEST, F.concat(F.translate(mark, "{[", "}]"), todo))
        return F.when(mark == "", todo).when(mark.isin("{", "["), opened).when(F.startswith(todo, mark), F.substr(todo, F.lit(2)))

    return F.aggregate(marks, F.lit(""), step)


def _closed(text: Column) -> Column:
    """A text that was cut off: from its first brace, without the unfinished end, all that is open closed."""
    t = F.substr(text, F.nullif(F.instr(text, "{"), F.lit(0)))
    for end in CUT_ENDS:
        t = F.regexp_replace(t, end, "")
    return F.concat(t, _closers(t))


def salvage(text: Column) -> Column:
    """A struct of the JSON object's text and the strategy that gave it, the first of five that does; null where none does.

    Later ways are only tried on rows for which the earlier ones fail.
    """
    whole = F.trim(text)
    fenced = F.trim(F.regexp_replace(whole, r"^```[a-zA-Z]*\s*|(?<!\s)\s*```$", ""))
    first, after = F.instr(whole, "{"), F.instr(F.reverse(whole), "}")
    widest = F.when((first > 0) & (after > 0) & (first + after <= F.length(whole)), F.substr(whole, first, F.length(whole) - first - after + 2))
    commas = F.regexp_replace(F.coalesce(widest, fenced), r",\s*([}\]])", "$1")
    ways = (("whole", whole), ("fence", fenced), ("braces", widest), ("commas", commas), ("truncated", _closed(whole)))
    return F.coalesce(*[F.when(_is_object(c), F.struct(c.alias("json"), F.lit(n).alias("strategy"))) for n, c in ways])


def record(json: Column) -> Column:
    """All fields of a JSON object as a struct, with `missing`, the names of those that it does not have.

    A field that is null is not missing. A value of another kind is cast where
    that makes sense, else null; a single recipient is no list and so null.
    """
    v = F.try_parse_json(json)
    at = lambda f, kind: F.try_variant_get(v, f"$.{f}", kind)
    fields = [at(f, kind).alias(f) for f, kind in RESULT.items()]
    missing = F.filter(F.array(*[F.when(at(f, "variant").isNull(), f) for f in RESULT]), lambda f: f.isNotNull())
    return F.when(v.isNotNull(), F.struct(*fields, missing.alias("missing")))


def recover(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `result` (a struct of all fields and the missing ones' names) and `strategy`."""
    got = df.withColumn("salvaged", salvage(F.col(text)))
    return got.withColumns({"strategy": F.col("salvaged.strategy"), "result": record(F.col("salvaged.json"))}).drop("salvaged")


def answered(df: DataFrame, scorer: Callable[[str], str], text: str = "text", attempts: int = 2) -> DataFrame:
    """Adds `answer`, what scorer says to each text, and `tried`, how often it was asked.

    An error or an empty answer is asked for again, up to `attempts` times; then
    the answer stays null, and `validate` gives the fallback record. Nulls are
    asked for as empty texts.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            answers, tried = [], []
            for t in batch.column(1).to_pylist():
                got, n = None, 0
                while not got and n < attempts:
                    n += 1
                    with contextlib.suppress(Exception):  # the scorer may raise anything
                        got = scorer(t or "")
                answers.append(got or None)
                tried.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(tried, pa.int32())], ["row", "answer", "tried"])

    rows = df.select(F.struct("*").alias("row"), F.col(text).alias("asked"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("answer string, tried int").fields])
    return rows.mapInArrow(run, schema).select("row.*", "answer", "tried")


def validate(df: DataFrame, as_of: str) -> DataFrame:
    """The fields of the result, or of a whole fallback record if a required one is missing; low confidence is flagged.

    A required field may be null. A missing or null confidence is 0, and so low;
    the fallback record is not flagged, as nobody judged it.
    """
    result = F.col("result")
    ok = F.coalesce(~F.arrays_overlap(result["missing"], F.array(*map(F.lit, REQUIRED))), F.lit(False))
    now = F.lit(as_of).cast("timestamp")
    fallback = {
        "doc_type": F.lit("other"), "doc_type_label": F.lit("Document"), "confidence": F.lit(0.0),
        "subject": F.concat(F.lit("Scanned document, "), F.date_format(now, "yyyy/MM/dd")), "body": F.lit("Please see the attachment."),
        "filename": F.concat(F.lit("document_"), F.date_format(now, "yyyyMMdd_HHmm"), F.lit(".pdf")),
        "extracted_text_summary": F.lit("(not recognised, please check)"), "detected_language": F.lit("zh-TW"),
        "suggested_recipients": F.array().cast("array<string>"),
    }
    value = lambda f: F.coalesce(result[f], F.lit(0.0)) if f == "confidence" else result[f]
    out = df.withColumns({**{f: F.when(ok, value(f)).otherwise(v) for f, v in fallback.items()}, "fallback": ~ok})
    return out.withColumn("low_confidence", ~F.col("fallback") & (F.col("confidence") < LEAST_CONFIDENCE))


def contact_line(text: Column) -> dict[str, Column]:
    """name, email, department, title of "name email [department] [title]"; `valid` if the second is an address."""
    part = F.split(trim(text), r"(?U)\s+")
    return {
        "name": F.get(part, 0), "email": F.get(part, 1), "department": F.coalesce(F.get(part, 2), F.lit("")),
        "title": F.coalesce(F.get(part, 3), F.lit("")), "valid": is_email(F.coalesce(F.get(part, 1), F.lit(""))),
    }


def _value(data: Column, key: str) -> Column:
    """The first value of a key in a=b&c=d text; null if there is none or it is blank."""
    pairs = F.filter(F.split(data, "&"), lambda p: F.startswith(p, F.lit(f"{key}=")) & (F.length(p) > len(key) + 1))
    return F.try_url_decode(F.substr(F.get(pairs, 0), F.lit(len(key) + 2)))


def postback(data: Column) -> tuple[Column, Column]:
    """(action, argument) by priority: select_contact, confirm_send, edit, edit_field, back_to_preview, cancel."""
    contact = _value(data, "select_contact").try_cast("long").cast("string")
    action, field = _value(data, "action"), _value(data, "edit_field")
    name = (
        F.when(contact.isNotNull(), "select_contact").when(action == "confirm_send", "confirm_send").when(action == "edit", "edit")
        .when(field.isNotNull(), "edit_field").when(action == "back_to_preview", "back_to_preview").when(action == "cancel", "cancel").otherwise("unknown")
    )
    return name, F.when(name == "select_contact", contact).when(name == "edit_field", field)
