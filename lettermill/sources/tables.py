"""Logical tables of the correspondence model, derived from the given tables.

Each table has a Spark form and, for checking, SQL of its own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Document types in the order of their codes, and group names.
DOC_TYPES = ("exam", "official", "receipt", "contract", "report", "letter", "form", "other")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "EMPTY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_of(key: str) -> Column:
    return F.concat(F.lit("u"), F.col(key).cast("string"))


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def contacts(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("at"))
    key = F.col("c_custkey")
    return table(spark, d, "customer").join(used, key == F.col("o_custkey"), "left").select(
        key.alias("id"), user_of("c_nationkey").alias("user_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("c"), key.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com")).alias("email"),
        F.col("c_mktsegment").alias("department"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "Manager").otherwise("Clerk").alias("title"),
        F.coalesce("n", F.lit(0)).cast("long").alias("frequency"),
        F.when(key % 10 != 0, F.col("at")).alias("last_used_at"),
    )


def send_history(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    seg = F.lower("c_mktsegment")
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"), user_of("c_nationkey").alias("user_id"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"), seg, F.lit(".example.com")).alias("recipient_email"),
        F.col("c_name").alias("recipient_name"),
        F.concat("o_orderpriority", F.lit(" #"), key.cast("string")).alias("subject"),
        F.when(key % 8 == 7, "").otherwise(pick(DOC_TYPES, key % 8)).alias("doc_type"),
        F.concat(F.lit("doc_"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        ((key % 100) / 100).alias("ai_confidence"), F.col("o_totalprice").cast("long").alias("file_size"),
        F.col("o_orderdate").alias("sent_at"),
    )


def contact_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, SEGMENTS))).alias("i", "name")).select(
        (F.col("n_nationkey") * 10 + F.col("i")).cast("long").alias("id"), user_of("n_nationkey").alias("user_id"), "name"
    )


def group_members(spark: SparkSession, d: str) -> DataFrame:
    c = contacts(spark, d).select(F.col("id").alias("contact_id"), "user_id", F.col("department").alias("name"))
    return c.join(contact_groups(spark, d), ["user_id", "name"]).filter("contact_id % 4 <> 0").select(F.col("id").alias("group_id"), "contact_id")


def email_templates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n, F.posexplode(F.array(*map(F.lit, DOC_TYPES))).alias("i", "doc_type")).filter((n + F.col("i")) % 3 == 0).select(
        (n * 8 + F.col("i")).cast("long").alias("id"), user_of("n_nationkey").alias("user_id"), "doc_type",
        F.concat(F.lit("[{doc_type}] {summary} "), user_of("n_nationkey")).alias("subject_template"),
        F.lit("Body: {summary}").alias("body_template"), F.lit(0).alias("is_default"),
    )


def sender_profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").filter("n_nationkey % 2 = 1").select(
        user_of("n_nationkey").alias("user_id"), F.initcap("n_name").alias("name"),
        F.concat(F.lower(F.regexp_replace("n_name", " ", "-")), F.lit("@mail.example.com")).alias("email"),
        F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("Agent").alias("title"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(user_of("n_nationkey").alias("user_id"))


def state_events(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """`events`: the table's rows as a stream, say, instead of a read of it."""
    events = table(spark, d, "events") if events is None else events
    kind, key = F.col("event_type"), F.col("event_id")
    target = (
        F.when(key % 29 == 0, "bogus").when(kind == "signup", "awaiting_contact").when(kind == "view", "processing")
        .when((kind == "click") & (key % 5 == 0), "editing").when(kind == "click", "awaiting_confirm")
        .when(kind == "purchase", "sending").otherwise("idle")
    )
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), target.alias("target_state"))


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").agg(F.count("*").alias("n"))
    return table(spark, d, "events").filter("event_type = 'purchase'").join(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("contact_id"), "ts")


def delivery_attempts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    outcome = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "R", "auth").otherwise("error")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.row_number().over(w).alias("attempt"), outcome.alias("outcome"))


def task_progress(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    last = F.max("turn").over(Window.partitionBy("conv_id"))
    half = F.floor(F.col("turn") / 2)
    status = F.when(F.col("turn") < last, "running").when(F.col("conv_id") % 5 == 0, "failed").otherwise("completed")
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("long").alias("task_id"), F.col("turn").cast("long").alias("seq"),
        F.least(F.lit(100), half * 40).cast("long").alias("progress"), status.alias("status"),
    )


def bundles(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id").cast("long")
    return table(spark, d, "conversations").groupBy(c.alias("item_id")).agg(F.count("*").alias("n_pages")).select(
        "item_id", F.floor(F.col("item_id") / 10).alias("bundle_id"), (F.col("item_id") % 10).alias("pos"), "n_pages",
        (200 + F.col("item_id") % 7 * 50).alias("width"), (300 + F.col("item_id") % 5 * 40).alias("height"),
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    stem = (
        F.when(i % 10 == 0, F.concat(F.lit("IMG_"), i.cast("string")))
        .when(i % 10 == 1, F.concat(F.lit("Screenshot 2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")))
        .when(i % 10 == 2, F.concat(F.lit("掃描文件_"), i.cast("string")))
        .when(i % 10 == 3, F.concat(F.lit("invoice-AB"), i.cast("string"), F.lit("-0003")))
        .when(i % 10 == 4, "report").when(i % 10 == 5, F.concat(F.lit("meeting notes "), "lang", F.lit(" "), "source"))
        .when(i % 10 == 6, "會議紀錄摘要").when(i % 10 == 7, F.concat("lang", F.lit(".tar")))
        .when(i % 10 == 8, F.md5(i.cast("string").cast("binary"))).otherwise(F.concat(F.lit("Budget_plan_"), "source"))
    )
    return table(spark, d, "documents").select(
        i.alias("id"), stem.alias("stem"), pick((".JPG", ".pdf", ".txt", ""), i % 4).alias("ext"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int")).alias("mdate"), F.col("n_chars").cast("long").alias("size"),
    ).withColumn("name", F.concat("stem", "ext"))


def quads(spark: SparkSession, d: str) -> DataFrame:
    """Candidate corner sets (four x, y pairs in order) of 800 x 600 images."""
    k = F.floor(F.col("vec_id") / 3) % 5
    e = lambda i: F.element_at("embedding", i + 1).cast("double") * 200
    hx, hy = 60 + 85 * k, 45 + 64 * k
    corner = lambda sx, sy, i: (400 + sx * hx + e(i), 300 + sy * hy + e(i + 1))
    cols = [F.floor(F.col("vec_id") / 5).alias("item_id"), (F.col("vec_id") % 5).alias("ord")]
    for n, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
        x, y = corner(sx, sy, 2 * n)
        cols += [x.alias(f"x{n}"), y.alias(f"y{n}")]
    return table(spark, d, "embeddings").select(*cols)


def segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("item_id"), F.abs(F.col("l_quantity") - 25).alias("dx"), ((F.col("l_discount") - F.col("l_tax")) * 10).alias("dy")
    )


#: The same tables in SQL.
SQL = {
    "contacts": """SELECT c_custkey AS id, 'u' || c_nationkey AS user_id, c_name AS name,
        'c' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' AS email, c_mktsegment AS department,
        CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Manager' ELSE 'Clerk' END AS title,
        coalesce(n, 0) AS frequency, CASE WHEN c_custkey % 10 <> 0 THEN latest END AS last_used_at
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "send_history": """SELECT o_orderkey AS id, 'u' || c_nationkey AS user_id,
        'c' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' AS recipient_email, c_name AS recipient_name,
        o_orderpriority || ' #' || o_orderkey AS subject,
        (['exam','official','receipt','contract','report','letter','form',''])[o_orderkey % 8 + 1] AS doc_type,
        'doc_' || o_orderkey || '.pdf' AS filename, (o_orderkey % 100) / 100 AS ai_confidence,
        CAST(trunc(o_totalprice) AS BIGINT) AS file_size, o_orderdate AS sent_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "contact_groups": """SELECT CAST(n_nationkey * 10 + i AS BIGINT) AS id, 'u' || n_nationkey AS user_id,
        (['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY','EMPTY'])[i + 1] AS name FROM nation, range(6) r(i)""",
    "group_members": """SELECT g.id AS group_id, c.id AS contact_id FROM contacts c JOIN contact_groups g
        ON c.user_id = g.user_id AND c.department = g.name WHERE c.id % 4 <> 0""",
    "email_templates": """SELECT CAST(n_nationkey * 8 + i AS BIGINT) AS id, 'u' || n_nationkey AS user_id,
        (['exam','official','receipt','contract','report','letter','form','other'])[i + 1] AS doc_type,
        '[{doc_type}] {summary} u' || n_nationkey AS subject_template, 'Body: {summary}' AS body_template, 0 AS is_default
        FROM nation, range(8) r(i) WHERE (n_nationkey + i) % 3 = 0""",
    "sender_profiles": """SELECT 'u' || n_nationkey AS user_id,
        array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
        lower(replace(n_name, ' ', '-')) || '@mail.example.com' AS email,
        CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'Agent' END AS title FROM nation WHERE n_nationkey % 2 = 1""",
    "users": "SELECT 'u' || n_nationkey AS user_id FROM nation",
    "state_events": """SELECT event_id, user_id, ts, CASE WHEN event_id % 29 = 0 THEN 'bogus' WHEN event_type = 'signup' THEN 'awaiting_contact'
        WHEN event_type = 'view' THEN 'processing' WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'editing'
        WHEN event_type = 'click' THEN 'awaiting_confirm' WHEN event_type = 'purchase' THEN 'sending' ELSE 'idle' END AS target_state FROM events""",
    "usage_events": "SELECT event_id, event_id % (SELECT count(*) FROM customer) AS contact_id, ts FROM events WHERE event_type = 'purchase'",
    "delivery_attempts": """SELECT l_orderkey AS message_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS attempt,
        CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'auth' ELSE 'error' END AS outcome FROM lineitem""",
    "task_progress": """SELECT CAST(conv_id AS BIGINT) AS task_id, CAST(turn AS BIGINT) AS seq, CAST(least(100, turn // 2 * 40) AS BIGINT) AS progress,
        CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN 'running' WHEN conv_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM conversations""",
    "bundles": """SELECT CAST(conv_id AS BIGINT) AS item_id, CAST(conv_id // 10 AS BIGINT) AS bundle_id, CAST(conv_id % 10 AS BIGINT) AS pos, count(*) AS n_pages,
        CAST(200 + conv_id % 7 * 50 AS BIGINT) AS width, CAST(300 + conv_id % 5 * 40 AS BIGINT) AS height FROM conversations GROUP BY conv_id""",
    "files": """SELECT *, stem || ext AS name FROM (SELECT doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'IMG_' || doc_id
        WHEN 1 THEN 'Screenshot 2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 2 THEN '掃描文件_' || doc_id
        WHEN 3 THEN 'invoice-AB' || doc_id || '-0003' WHEN 4 THEN 'report' WHEN 5 THEN 'meeting notes ' || lang || ' ' || source
        WHEN 6 THEN '會議紀錄摘要' WHEN 7 THEN lang || '.tar' WHEN 8 THEN md5(CAST(doc_id AS VARCHAR)) ELSE 'Budget_plan_' || source END AS stem,
        (['.JPG','.pdf','.txt',''])[doc_id % 4 + 1] AS ext, CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS DATE) AS mdate, CAST(n_chars AS BIGINT) AS size FROM documents)""",
    "quads": """SELECT vec_id // 5 AS item_id, vec_id % 5 AS ord, 400 - (60 + 85 * k) + 200 * CAST(e[1] AS DOUBLE) AS x0, 300 - (45 + 64 * k) + 200 * CAST(e[2] AS DOUBLE) AS y0,
        400 + (60 + 85 * k) + 200 * CAST(e[3] AS DOUBLE) AS x1, 300 - (45 + 64 * k) + 200 * CAST(e[4] AS DOUBLE) AS y1, 400 + (60 + 85 * k) + 200 * CAST(e[5] AS DOUBLE) AS x2,
        300 + (45 + 64 * k) + 200 * CAST(e[6] AS DOUBLE) AS y2, 400 - (60 + 85 * k) + 200 * CAST(e[7] AS DOUBLE) AS x3, 300 + (45 + 64 * k) + 200 * CAST(e[8] AS DOUBLE) AS y3
        FROM (SELECT vec_id, embedding AS e, vec_id // 3 % 5 AS k FROM embeddings)""",
    "segments": "SELECT l_suppkey AS item_id, abs(l_quantity - 25) AS dx, (l_discount - l_tax) * 10 AS dy FROM lineitem",
}
_NEEDS = {"group_members": ("contacts", "contact_groups")}


def with_tables(body: str, *names: str) -> str:
    """The query with the named logical tables in front."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
