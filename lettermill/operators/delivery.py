"""Commands, delivery plans and outcomes, task progress, session-like state in batch."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contacts import or_else

# Words that are commands, and the handler of each state.
COMMANDS = {"help": "help", "contacts": "contacts", "history": "history", "stats": "stats", "cancel": "cancel", "說明": "help", "聯絡人": "contacts", "統計": "stats"}
BY_STATE = {"awaiting_contact": "contact_input", "editing": "edit_input", "idle": "hint"}
FINAL = ("completed", "failed")


def route(text: Column, state: Column) -> Column:
    """A command by its lower-case text, else the handler of the session's state, else busy."""
    t = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for word, command in COMMANDS.items():
        out = out.when(t == word, f"command:{command}")
    for s, handler in BY_STATE.items():
        out = out.when(state == s, handler)
    return out.otherwise("busy")


# Ways to deliver, in order, each with the condition under which it is tried.
STRATEGIES = (
    ("starttls-587", lambda port, user: port == 587), ("ssl-465", lambda port, user: port == 465),
    ("starttls-own", lambda port, user: ~port.isin(587, 465, 25)), ("plain-25", lambda port, user: F.lit(True)),
    ("starttls-25", lambda port, user: (port != 25) & (user != "")), ("ssl-465-extra", lambda port, user: (port != 465) & (user != "")),
    ("starttls-587-extra", lambda port, user: (port != 587) & (user != "")),
)


def delivery_plan(messages: DataFrame) -> DataFrame:
    """One row per message and applicable way, numbered in order: an array filtered per row, no join."""
    port, user = F.col("port"), F.coalesce("smtp_user", F.lit(""))
    ways = F.filter(F.array(*[F.when(f(port, user), F.lit(n)) for n, f in STRATEGIES]), lambda x: x.isNotNull())
    return messages.select("message_id", F.posexplode(ways).alias("step", "strategy")).withColumn("step", F.col("step") + 1)


def outcomes(attempts: DataFrame) -> DataFrame:
    """Per message the first success in order, else all errors joined; failed logins are named."""
    error = F.when(F.col("outcome") == "auth", "authentication failed").otherwise("connection error")
    first = F.min(F.when(F.col("outcome") == "ok", F.col("attempt"))).alias("ok_at")
    errors = F.array_sort(F.collect_list(F.when(F.col("outcome") != "ok", F.struct("attempt", error.alias("e")))))
    out = attempts.groupBy("message_id").agg(first, errors.alias("all"))
    before = F.filter("all", lambda x: F.col("ok_at").isNull() | (x["attempt"] < F.col("ok_at")))
    return out.select("message_id", F.col("ok_at").isNotNull().alias("success"), "ok_at", F.array_join(F.transform(before, lambda x: x["e"]), "; ").alias("errors"))


def batch_summary(results: DataFrame, batch: Column) -> DataFrame:
    out = results.groupBy(batch.alias("batch")).agg(F.count("*").alias("total"), F.count_if("success").alias("success_count"))
    fail = F.col("total") - F.col("success_count")
    return out.select("batch", "total", "success_count", fail.alias("fail_count"), (F.col("success_count") > 0).alias("any_success"), (fail == 0).alias("session_cleared"))


def message_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """Subject, body and file name: of the request, else of the analysis, else a constant; the name ends in .pdf."""
    name = or_else("filename", "ai_filename", F.concat(F.lit("document_"), now))
    return rows.withColumns({
        "subject": or_else("subject", "ai_subject", F.lit("Document")), "body": or_else("body", "ai_body", F.lit("Please see the attachment.")),
        "filename": F.when(name.endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf"))),
    })


def from_address(email: Column, smtp_user: Column, host: Column) -> Column:
    domain = F.regexp_replace(host, r"^mail\.", "gm.")
    return F.when(email != "", email).when(smtp_user.contains("@"), smtp_user).when(smtp_user != "", F.concat(smtp_user, F.lit("@"), domain)).otherwise("mailer@localhost")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html(body: Column, name: Column, title: Column, safe: bool = False) -> Column:
    b = F.replace(escaped(body) if safe else body, F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit("<html><body><p>"), b, F.lit("</p><hr><p>"), name, F.lit("</p><p>"), title, F.lit("</p></body></html>"))


def analysis_requests(items: DataFrame, contacts: DataFrame, senders: DataFrame) -> DataFrame:
    """Prompt text of each item with its recipient and sender; rejected where the contact is unknown."""
    c = contacts.select("user_id", F.col("id").alias("contact_id"), F.col("name").alias("c_name"), F.col("title").alias("c_title"))
    s = senders.select("user_id", F.col("name").alias("s_name"))
    out = items.join(c, ["user_id", "contact_id"], "left").join(s, "user_id", "left")
    prompt = F.concat(F.lit("From "), "s_name", F.lit(" to "), "c_name", F.when(F.col("c_title") != "", F.concat(F.lit(", "), "c_title")).otherwise(""), F.lit(": "), "filename")
    return out.select("id", F.col("c_name").isNull().alias("rejected"), F.when(F.col("c_name").isNotNull(), prompt).alias("prompt"))


def progress(c: Column) -> Column:
    """Never above 100; null stays null."""
    return F.when(c > 100, 100).otherwise(c)


def progress_feed(updates: DataFrame) -> DataFrame:
    """Rows whose progress differs from the row before, or that end the task; nothing after the end. Null differs from any number."""
    w = Window.partitionBy("task_id").orderBy("seq")
    final = F.coalesce(F.col("status").isin(*FINAL), F.lit(False))
    ended = F.coalesce(F.max(final).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    own = updates.withColumn("progress", progress(F.col("progress")))
    first, before = F.row_number().over(w) == 1, F.lag("progress").over(w)
    return own.withColumns({"__e": ended, "__s": final | first | ~before.eqNullSafe(F.col("progress"))}).filter(~F.col("__e") & F.col("__s")).drop("__e", "__s")


def latest_status(progress: DataFrame) -> DataFrame:
    got = progress.groupBy("task_id").agg(F.max_by(F.struct("progress", "status"), "seq").alias("s"))
    return got.select("task_id", F.least(F.col("s.progress"), F.lit(100)).alias("progress"), F.col("s.status").alias("status"))


def retained(tasks: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Without finished tasks older than the limit; running ones stay."""
    old = F.lit(as_of).cast("timestamp") - F.col("ts").cast("timestamp") > F.expr(f"INTERVAL '{minutes}' MINUTE")
    return tasks.filter(~(old & F.col("status").isin(*FINAL)))


def media_type(c: Column) -> Column:
    return F.when(c.isin("image/jpeg", "image/png", "image/gif", "image/webp"), c).otherwise("image/jpeg")


def fold_edits(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Last edit of each field over the base rows; an edited file name ends in .pdf."""
    pick = lambda f: F.max_by("value", F.when(F.col("field") == f, F.col("seq"))).alias(f"__{f}")
    e = edits.groupBy("id").agg(*[pick(f) for f in ("subject", "filename")])
    name = F.when(F.col("__filename").endswith(".pdf"), F.col("__filename")).otherwise(F.concat("__filename", F.lit(".pdf")))
    return base.join(e, "id", "left").select("id", F.coalesce("__subject", "subject").alias("subject"), F.coalesce(name, F.col("filename")).alias("filename"))
