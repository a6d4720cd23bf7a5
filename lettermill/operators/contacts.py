"""Contacts, groups, templates and senders: lookups, joins and keyed changes, for all users at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NO_GROUPS = "—"
MISSING_CONTACT = "聯絡人不存在"


def or_else(value: Column | str, *rest: Column | str) -> Column:
    """The first value that is neither null nor empty, else the last one."""
    cols = [F.col(v) if isinstance(v, str) else v for v in (value, *rest)]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def scoped(df: DataFrame, user: str = "user_id", default: str = "default_user") -> DataFrame:
    """Rows without a user belong to the default user."""
    return df.withColumn(user, or_else(user, F.lit(default)))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def search(contacts: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """Per user the `limit` most used contacts whose name, email or department holds the keyword.

    Letters A-Z match in either case; % and _ in the keyword are wildcards.
    """
    like = f"%{keyword}%".translate(str.maketrans(UPPER, LOWER))
    hit = F.lit(False)
    for c in ("name", "email", "department"):
        hit = hit | F.coalesce(ascii_fold(F.col(c)).like(like), F.lit(False))
    return top_contacts(contacts.filter(hit), limit)


def ui_filter(contacts: DataFrame, text: str, favourites: bool = False) -> DataFrame:
    out = contacts.filter(F.col("name").contains(text) | F.lower("email").contains(text.lower()))
    return out.filter("frequency > 0") if favourites else out


def top_contacts(contacts: DataFrame, k: int) -> DataFrame:
    """Per user the k contacts used most, then latest, then of the least id; `rank` from 1."""
    w = Window.partitionBy("user_id").orderBy(F.desc("frequency"), F.desc_nulls_last("last_used_at"), "id")
    return contacts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def delete_owned(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Without the rows whose (id, user_id) is requested; another user's request has no effect."""
    return table.join(requests.select("id", "user_id"), ["id", "user_id"], "left_anti")


def members_of(groups: DataFrame, members: DataFrame, contacts: DataFrame) -> DataFrame:
    own = members.join(contacts.withColumnRenamed("id", "contact_id"), "contact_id")
    return own.join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id")


def groups_with_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("group_id").agg(F.count("contact_id").alias("member_count"))
    out = groups.join(n, groups["id"] == n["group_id"], "left")
    return out.select("id", "user_id", "name", F.coalesce("member_count", F.lit(0)).cast("long").alias("member_count"))


def group_detail(groups: DataFrame, members: DataFrame, contacts: DataFrame) -> DataFrame:
    """Groups with their members' names as one text in order of the name."""
    m = members_of(groups, members, contacts).groupBy("group_id")
    m = m.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "contact_id"))), lambda x: x["name"]), ",").alias("members"))
    return groups.join(m, groups["id"] == m["group_id"], "left").select("id", "name", F.coalesce("members", F.lit("")).alias("members"))


def resolve(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    """Requests (request_id, ids) to one row per place: the contact, or a note that it is missing."""
    each = requests.select("request_id", F.posexplode("ids").alias("pos", "contact_id"))
    c = contacts.select(F.col("id").alias("contact_id"), "name", "email")
    return each.join(c, "contact_id", "left").withColumn("error", F.when(F.col("email").isNull(), MISSING_CONTACT))


def select_existing(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    """As `resolve`, without the unknown ids; places count from 0 among those left."""
    w = Window.partitionBy("request_id").orderBy("pos")
    got = resolve(requests, contacts).filter(F.col("error").isNull())
    return got.withColumn("place", F.row_number().over(w) - 1).select("request_id", "place", "contact_id", "email")


def sender_or_default(users: DataFrame, senders: DataFrame) -> DataFrame:
    """A user's own profile, or the whole default row; columns are never mixed."""
    default = {"name": "Mail Assistant", "email": "noreply@example.com", "title": ""}
    s = senders.withColumn("own", F.lit(True))
    cols = [F.when(F.col("own"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in default.items()]
    return users.join(s, "user_id", "left").select("user_id", *cols)


# Document types and their names.
DEFAULT_TEMPLATES = {
    "exam": "考試通知", "official": "公文", "receipt": "收據", "contract": "合約",
    "report": "報告", "letter": "信件", "form": "表單", "other": "文件",
}


def default_templates(spark) -> DataFrame:
    """A handful of literal rows: the built-in template of each document type."""
    rows = [(t, f"[{{doc_type}}] {{summary}} {label}", "{summary}") for t, label in DEFAULT_TEMPLATES.items()]
    return spark.createDataFrame(rows, "doc_type string, subject_template string, body_template string")


def template_for(requests: DataFrame, templates: DataFrame, defaults: DataFrame) -> DataFrame:
    """(user_id, doc_type) to a template: the user's own, else the built-in one, else that of `other`."""
    w = Window.partitionBy("user_id", "doc_type").orderBy("is_default", "id")
    own = templates.withColumn("n", F.row_number().over(w)).filter("n = 1").select("user_id", "doc_type", F.col("subject_template").alias("own_subject"), F.col("body_template").alias("own_body"))
    built = defaults.select(F.col("doc_type").alias("built_type"), F.col("subject_template").alias("built_subject"), F.col("body_template").alias("built_body"))
    known = F.when(F.col("doc_type").isin(*DEFAULT_TEMPLATES), F.col("doc_type")).otherwise("other")
    out = requests.join(own, ["user_id", "doc_type"], "left").withColumn("built_type", known).join(F.broadcast(built), "built_type", "left")
    source = F.when(F.col("own_subject").isNotNull(), "own").otherwise("default")
    return out.select("user_id", "doc_type", source.alias("source"), F.coalesce("own_subject", "built_subject").alias("subject_template"), F.coalesce("own_body", "built_body").alias("body_template"))


def list_templates(users: DataFrame, templates: DataFrame, defaults: DataFrame) -> DataFrame:
    """Own templates, and the built-in ones of the types for which a user has none."""
    own = templates.select("user_id", "doc_type", "subject_template", F.lit("own").alias("source"))
    built = users.crossJoin(F.broadcast(defaults)).select("user_id", "doc_type", "subject_template", F.lit("default").alias("source"))
    return own.unionByName(built.join(own, ["user_id", "doc_type"], "left_anti"))


def groups_of_contact(contacts: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    g = members.join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("g")), "group_id")
    g = g.groupBy("contact_id").agg(F.array_join(F.array_sort(F.collect_list("g")), "、").alias("groups"))
    return contacts.join(g, contacts["id"] == g["contact_id"], "left").select("id", F.coalesce("groups", F.lit(NO_GROUPS)).alias("groups"))


def recipients_of(groups: DataFrame, members: DataFrame) -> DataFrame:
    own = members.join(groups.select(F.col("id").alias("group_id"), "user_id"), "group_id")
    return own.select("user_id", "contact_id").dropDuplicates(["user_id", "contact_id"])


GRAM = 8  # characters of a piece in the index of names


def _pieces(text: Column, length: Column | int) -> Column:
    """All different substrings of a length."""
    length = F.lit(length) if isinstance(length, int) else length
    last = F.length(text) - length + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, length)))).otherwise(F.array().cast("array<string>"))


def looked_up(names: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """(by, name, text) of names of GRAM characters or more: texts that have the name's rarest piece of that length.

    A name with a piece that no text has is part of none and left out.
    """
    of_texts = texts.select(by, "text", F.explode(_pieces(F.col("text"), GRAM)).alias("piece"))
    of_names = names.select(by, "name", F.explode(_pieces(F.col("name"), GRAM)).alias("piece"))
    count = of_texts.groupBy(by, "piece").agg(F.count("*").alias("n"))
    rarest = of_names.join(count, [by, "piece"], "left").groupBy(by, "name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest"))
    return rarest.filter("rarest.n > 0").select(by, "name", F.col("rarest.piece").alias("piece")).join(of_texts, [by, "piece"]).select(by, "name", "text")


def names_within(names: DataFrame, texts: DataFrame, by: str = "user_id") -> DataFrame:
    """(by, name, text): which names (by, name) are part of which texts (by, text); both distinct.

    Long names are looked up by their rarest piece and compared in full; shorter
    ones meet all pieces of their own length. So candidates follow the texts'
    lengths, not the product of names and texts, whoever holds the rows.
    """
    names, texts = names.dropna(subset=["name"]), texts.dropna(subset=["text"])
    found = looked_up(names.filter(F.length("name") >= GRAM), texts, by).filter(F.contains("text", "name"))
    short = names.filter(F.length("name") < GRAM)
    lengths = short.groupBy(by).agg(F.collect_set(F.length("name")).alias("lengths"))  # GRAM at most
    whole = texts.join(lengths, by).select(by, "text", F.explode("lengths").alias("size"))
    parts = whole.select(by, "text", F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(_pieces(F.col("text"), F.col("size")))).alias("name"))
    return found.unionByName(parts.join(short, [by, "name"], "left_semi").select(by, "name", "text"))


def contact_history(contacts: DataFrame, history: DataFrame, k: int = 5) -> DataFrame:
    """Per contact the k latest sends whose recipient's name holds the contact's, or that went to its address.

    An empty name is part of any. Names and addresses are looked up once each,
    with the k latest sends of each, which all contacts of that name share.
    """
    newest = [F.desc("sent_at"), F.desc("send_id")]
    h = history.select("user_id", F.col("id").alias("send_id"), F.col("recipient_name").alias("text"), F.col("recipient_email").alias("email"), "sent_at")
    c = contacts.select("user_id", F.col("id").alias("contact_id"), "name", "email")

    def latest(sends: DataFrame, *key: str) -> DataFrame:
        return sends.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).filter(F.col("n") <= k).drop("n")

    texts = latest(h.drop("email").dropna(subset=["text"]), "user_id", "text")
    within = names_within(c.select("user_id", "name").distinct(), texts.select("user_id", "text").distinct())
    named = latest(texts.join(within, ["user_id", "text"]).select("user_id", "name", "send_id", "sent_at"), "user_id", "name")
    sent = latest(h.select("user_id", "email", "send_id", "sent_at").dropna(subset=["email"]), "user_id", "email")
    hit = c.join(named, ["user_id", "name"]).select("contact_id", "send_id", "sent_at").union(c.join(sent, ["user_id", "email"]).select("contact_id", "send_id", "sent_at"))
    # 2 k sends of a contact at most, some of them twice
    own = hit.groupBy("contact_id").agg(F.slice(F.reverse(F.array_sort(F.collect_set(F.struct("sent_at", "send_id")))), 1, k).alias("sends"))
    return own.select("contact_id", F.posexplode("sends").alias("pos", "s")).select("contact_id", (F.col("pos") + 1).alias("rank"), "s.send_id")


def cascade(members: DataFrame, deleted_contacts: DataFrame, deleted_groups: DataFrame) -> DataFrame:
    out = members.join(deleted_contacts.select(F.col("id").alias("contact_id")), "contact_id", "left_anti")
    return out.join(deleted_groups.select(F.col("id").alias("group_id")), "group_id", "left_anti").select("group_id", "contact_id")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], replaced: list[str], order: str) -> DataFrame:
    """Full outer merge: `replaced` columns of a known key take the last change's values, all else stays."""
    pick = F.max_by(F.struct(*replaced), order).alias("__new")
    last = changes.groupBy(*keys).agg(pick).withColumn("__hit", F.lit(True))
    out = table.withColumn("__old", F.lit(True)).join(last, keys, "full")
    cols = [F.when(F.col("__hit"), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in table.columns]
    return out.select(*cols, F.col("__old").isNull().alias("inserted"))


def replace_members(members: DataFrame, groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """Groups in `groups` get exactly the members wanted (an empty list clears them); others keep theirs."""
    kept = members.join(groups.select("group_id").distinct(), "group_id", "left_anti").select("group_id", "contact_id")
    return kept.unionByName(wanted.join(groups.select("group_id").distinct(), "group_id", "left_semi").select("group_id", "contact_id").distinct())


def patch_templates(templates: DataFrame, created: DataFrame, patches: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deletes, then patches by id, then appends."""
    p = patches.groupBy("id").agg(F.max_by("subject_template", "seq").alias("__s"))
    cols = [c for c in templates.columns if c != "subject_template"]
    out = templates.join(deleted.select("id"), "id", "left_anti").join(p, "id", "left")
    return out.select(*cols, F.coalesce("__s", "subject_template").alias("subject_template")).unionByName(created.select(*templates.columns))


def add_usage(contacts: DataFrame, events: DataFrame) -> DataFrame:
    """Counts events into the frequency; the last use is the later of both."""
    n = events.groupBy("contact_id").agg(F.count("*").alias("n"), F.max("ts").alias("at"))
    out = contacts.join(n, contacts["id"] == n["contact_id"], "left")
    return out.select("id", (F.col("frequency") + F.coalesce("n", F.lit(0))).alias("frequency"), F.greatest("last_used_at", "at").alias("last_used_at"))


def insert_groups(groups: DataFrame, new: DataFrame) -> DataFrame:
    """Each new group with `accepted`: false where the user already has the name, or an earlier row takes it."""
    w = Window.partitionBy("user_id", "name").orderBy("seq")
    known = groups.select("user_id", "name").distinct().withColumn("known", F.lit(True))
    out = new.withColumn("n", F.row_number().over(w)).join(known, ["user_id", "name"], "left")
    return out.select("seq", "user_id", "name", (F.col("known").isNull() & (F.col("n") == 1)).alias("accepted"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def quick_list(contacts: DataFrame, k: int = 10, width: int = 20) -> DataFrame:
    """Top contacts as labels of at most `width` characters, with a last row to add one, per user."""
    full = F.concat("name", F.when(F.col("title") != "", F.concat(F.lit(" "), F.col("title"))).otherwise(""))
    label = F.when(F.length(full) > width, F.concat(F.substring(full, 1, width - 3), F.lit("..."))).otherwise(full)
    top = top_contacts(contacts, k).select("user_id", "rank", label.alias("label"))
    add = top.groupBy("user_id").agg((F.max("rank") + 1).alias("rank")).withColumn("label", F.lit("+"))
    return top.unionByName(add.select("user_id", "rank", "label"))


def listing(users: DataFrame, contacts: DataFrame, k: int = 10) -> DataFrame:
    """Per user the numbered contact list as one text."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), "name",
        F.when(F.col("title") != "", F.concat(F.lit(" ("), "title", F.lit(")"))).otherwise(""), F.lit(" "), "email",
    )
    top = top_contacts(contacts, k).groupBy("user_id")
    text = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return users.join(text, "user_id", "left").select("user_id", F.coalesce("text", F.lit("no contacts")).alias("text"))


def normalised(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each column from the first of its aliases that is neither null nor empty."""
    return rows.select(*[or_else(*names, F.lit("")).alias(c) for c, names in aliases.items()])
