"""Send history: statistics, latest sends, reports. Times are measured from a given `as_of`, never a clock."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contacts import or_else

NO_TYPE = "其他"
# Label and colour of each document type.
DOC_TYPE_STYLE = {
    "exam": ("考試", "#E74C3C"), "official": ("公文", "#3498DB"), "receipt": ("收據", "#2ECC71"), "contract": ("合約", "#9B59B6"),
    "report": ("報告", "#F39C12"), "letter": ("信件", "#1ABC9C"), "form": ("表單", "#34495E"), "other": ("其他", "#95A5A6"),
}


def recent(as_of: str, days: int = 30) -> Column:
    """From midnight `days` days before, inclusive, without an upper bound."""
    return F.col("sent_at") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")


def totals(history: DataFrame) -> DataFrame:
    return history.groupBy("user_id").agg(F.count("*").alias("total"))


def monthly(history: DataFrame, as_of: str) -> DataFrame:
    return history.groupBy("user_id").agg(F.count_if(recent(as_of)).alias("monthly"))


def by_type(history: DataFrame) -> DataFrame:
    """Sends of each user by type, `rank` from 1 for the most frequent; users are not sorted among each other."""
    n = history.groupBy("user_id", "doc_type").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "doc_type")))


def stats(history: DataFrame, as_of: str) -> DataFrame:
    """Total, last month and counts by type of every user, in one pass: partial counts per type first."""
    part = history.groupBy("user_id", "doc_type").agg(F.count("*").alias("n"), F.count_if(recent(as_of)).alias("m"))
    own = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "doc_type"))), lambda x: F.concat(x["doc_type"], F.lit(":"), (-x["o"]).cast("string")))
    return part.groupBy("user_id").agg(F.sum("n").alias("total"), F.sum("m").alias("monthly"), F.array_join(own, ",").alias("by_type"))


def report(history: DataFrame) -> DataFrame:
    """One line per type and user, joined; a blank type has its own name."""
    n = history.groupBy("user_id", or_else("doc_type", F.lit(NO_TYPE)).alias("t")).agg(F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "t"))), lambda x: F.concat(F.lit("• "), x["t"], F.lit(": "), (-x["o"]).cast("string")))
    return n.groupBy("user_id").agg(F.array_join(lines, "\n").alias("report"))


def dashboard(history: DataFrame, contacts: DataFrame, groups: DataFrame) -> DataFrame:
    parts = [d.groupBy("user_id").agg(F.count("*").alias(c)) for d, c in ((history, "sent"), (contacts, "contacts"), (groups, "groups"))]
    out = parts[0].join(parts[1], "user_id", "full").join(parts[2], "user_id", "full")
    return out.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sent", "contacts", "groups")])


def latest(history: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("sent_at"), F.desc("id"))
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def type_dimension(spark) -> DataFrame:
    rows = [(t, label, colour) for t, (label, colour) in DOC_TYPE_STYLE.items()]
    return spark.createDataFrame(rows, "doc_type string, label string, colour string")


def with_style(df: DataFrame) -> DataFrame:
    """Label and colour of the type; those of `other` where it is unknown."""
    dim = F.broadcast(type_dimension(df.sparkSession))
    label, colour = DOC_TYPE_STYLE["other"]
    out = df.join(dim, "doc_type", "left")
    return out.withColumns({"label": F.coalesce("label", F.lit(label)), "colour": F.coalesce("colour", F.lit(colour))})


def cards(history: DataFrame, k: int = 10) -> DataFrame:
    out = with_style(latest(history, k))
    return out.select("user_id", "rank", "label", or_else("subject", F.lit("—")).alias("subject"), F.substring(F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"), 1, 16).alias("sent"))


def rolling(history: DataFrame, days: int = 30) -> DataFrame:
    """Sends per user in sliding windows of `days` days, one a day."""
    t = history.withColumn("t", F.col("sent_at").cast("timestamp"))
    return t.groupBy("user_id", F.window("t", f"{days} days", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("start"), "n")


def byte_size(n: Column) -> Column:
    """B, KB or MB; one decimal, halves up."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / (1024 * 1024)), F.lit(" MB")))


def confidence(c: Column) -> tuple[Column, Column]:
    """Whole percent, cut, and a warning below 0.3."""
    return (c * 100).cast("int"), F.when(c < 0.3, "low confidence").otherwise("")
