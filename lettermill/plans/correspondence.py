"""Queries over contacts, groups, templates, senders and history."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import history as H
from ..sources import tables as T
from .base import query

AS_OF = "2001-08-01"


@query("a1_contact_scan", "SELECT id, user_id, name, email, coalesce(department, '') AS department, coalesce(title, '') AS title, frequency FROM contacts", "contacts")
def _(spark, d):
    c = T.contacts(spark, d)
    return c.select("id", "user_id", "name", "email", *[F.coalesce(x, F.lit("")).alias(x) for x in ("department", "title")], "frequency")


@query("b1_user_scope", "SELECT CASE WHEN coalesce(user_id, '') = '' THEN 'default_user' ELSE user_id END AS user_id, count(*) AS n FROM (SELECT CASE WHEN id % 7 = 0 THEN '' WHEN id % 7 = 1 THEN NULL ELSE user_id END AS user_id FROM contacts) GROUP BY 1", "contacts")
def _(spark, d):
    c = T.contacts(spark, d)
    c = c.select(F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 == 1, None).otherwise(F.col("user_id")).alias("user_id"))
    return C.scoped(c).groupBy("user_id").agg(F.count("*").alias("n"))


TOP = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frequency DESC, last_used_at DESC NULLS LAST, id) AS rank FROM contacts"


@query("b2_contact_search", f"SELECT user_id, CAST(rank AS INTEGER) AS rank, id FROM ({TOP} WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%mach_nery%' OR lower(email) LIKE '%mach_nery%' OR lower(department) LIKE '%mach_nery%') WHERE rank <= 10", "contacts")
def _(spark, d):
    return C.search(T.contacts(spark, d), "MACH_nery").select("user_id", "rank", "id")


@query("b3_ui_filter", "SELECT id, name FROM contacts WHERE (contains(name, '9') OR contains(lower(email), 'auto')) AND frequency > 0", "contacts")
def _(spark, d):
    return C.ui_filter(T.contacts(spark, d), "9", True).union(C.ui_filter(T.contacts(spark, d), "AUTO", True).filter(~F.col("name").contains("9"))).select("id", "name")


@query("b4_email_check", r"SELECT id, regexp_matches(e, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS ok FROM (SELECT id, CASE id % 4 WHEN 0 THEN email WHEN 1 THEN replace(email, '@', ' ') WHEN 2 THEN replace(email, '.com', '.c') ELSE email || '!' END AS e FROM contacts)", "contacts")
def _(spark, d):
    i = F.col("id") % 4
    e = F.when(i == 0, F.col("email")).when(i == 1, F.replace("email", F.lit("@"), F.lit(" "))).when(i == 2, F.replace("email", F.lit(".com"), F.lit(".c"))).otherwise(F.concat("email", F.lit("!")))
    return T.contacts(spark, d).select("id", C.is_email(e).alias("ok"))


@query("b10_owned_delete", "SELECT id, user_id FROM contacts WHERE NOT (id % 5 = 0 AND user_id = CASE WHEN id % 2 = 0 THEN user_id ELSE 'u0' END)", "contacts")
def _(spark, d):
    c = T.contacts(spark, d)
    asked = c.filter("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise("u0").alias("user_id"))
    return C.delete_owned(c, asked).select("id", "user_id")


@query("b11_aliases", "SELECT id, CASE WHEN coalesce(recipient_name, '') <> '' THEN recipient_name ELSE recipient_email END AS recipient, CASE WHEN coalesce(doc_type, '') <> '' THEN doc_type ELSE '' END AS kind FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE recipient_name END AS recipient_name, recipient_email, doc_type FROM send_history)", "send_history")
def _(spark, d):
    h = T.send_history(spark, d).withColumn("recipient_name", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("recipient_name"))).withColumn("id", F.col("id").cast("string"))
    return C.normalised(h, {"id": ["id"], "recipient": ["recipient_name", "recipient_email"], "kind": ["doc_type"]}).withColumn("id", F.col("id").cast("long"))


@query("c1_group_members", "SELECT m.group_id, c.id AS contact_id, c.name FROM group_members m JOIN contacts c ON c.id = m.contact_id", "group_members")
def _(spark, d):
    return C.members_of(T.contact_groups(spark, d), T.group_members(spark, d), T.contacts(spark, d)).select("group_id", "contact_id", "name")


@query("c2_groups_with_counts", "SELECT g.id, g.user_id, g.name, count(m.contact_id) AS member_count FROM contact_groups g LEFT JOIN group_members m ON m.group_id = g.id GROUP BY ALL", "contact_groups", "group_members")
def _(spark, d):
    return C.groups_with_counts(T.contact_groups(spark, d), T.group_members(spark, d))


@query("c3_group_detail", "SELECT g.id, g.name, coalesce(string_agg(c.name, ',' ORDER BY c.name, c.id), '') AS members FROM contact_groups g LEFT JOIN group_members m ON m.group_id = g.id LEFT JOIN contacts c ON c.id = m.contact_id GROUP BY g.id, g.name", "contact_groups", "group_members")
def _(spark, d):
    return C.group_detail(T.contact_groups(spark, d), T.group_members(spark, d), T.contacts(spark, d))


def _requests(spark, d):
    """One request per order: three contact ids, some unknown."""
    k = F.col("o_orderkey")
    return T.table(spark, d, "orders").select(k.alias("request_id"), F.array(k % 1700, (k * 7) % 1700, (k * 13) % 1700).alias("ids"))


REQUESTS = "requests AS (SELECT o_orderkey AS request_id, p.pos, CASE p.pos WHEN 0 THEN o_orderkey % 1700 WHEN 1 THEN o_orderkey * 7 % 1700 ELSE o_orderkey * 13 % 1700 END AS contact_id FROM orders, range(3) p(pos))"


@query("c4_recipients", f"WITH {REQUESTS} SELECT request_id, CAST(pos AS INTEGER) AS pos, contact_id, email, CASE WHEN email IS NULL THEN '聯絡人不存在' END AS error FROM requests r LEFT JOIN contacts c ON c.id = r.contact_id", "contacts")
def _(spark, d):
    return C.resolve(_requests(spark, d), T.contacts(spark, d)).select("request_id", "pos", "contact_id", "email", "error")


@query("c11_selection", f"WITH {REQUESTS} SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS INTEGER) AS place, contact_id, email FROM requests r JOIN contacts c ON c.id = r.contact_id", "contacts")
def _(spark, d):
    return C.select_existing(_requests(spark, d), T.contacts(spark, d))


@query("c5_sender_or_default", "SELECT u.user_id, CASE WHEN s.user_id IS NULL THEN 'Mail Assistant' ELSE s.name END AS name, CASE WHEN s.user_id IS NULL THEN 'noreply@example.com' ELSE s.email END AS email, CASE WHEN s.user_id IS NULL THEN '' ELSE s.title END AS title FROM users u LEFT JOIN sender_profiles s ON s.user_id = u.user_id", "users", "sender_profiles")
def _(spark, d):
    return C.sender_or_default(T.users(spark, d), T.sender_profiles(spark, d))


DEFAULTS = "defaults AS (SELECT * FROM (VALUES ('exam', '考試通知'), ('official', '公文'), ('receipt', '收據'), ('contract', '合約'), ('report', '報告'), ('letter', '信件'), ('form', '表單'), ('other', '文件')) v(doc_type, label))"
ASKED = "asked AS (SELECT user_id, id, CASE WHEN doc_type = '' THEN 'memo' ELSE doc_type END AS doc_type, filename FROM send_history)"


def _asked(spark, d):
    return T.send_history(spark, d).select("user_id", "id", F.when(F.col("doc_type") == "", "memo").otherwise(F.col("doc_type")).alias("doc_type"), "filename")


@query("c6_template_for", f"WITH {DEFAULTS}, {ASKED} SELECT a.user_id, a.doc_type, CASE WHEN t.id IS NULL THEN 'default' ELSE 'own' END AS source, coalesce(t.subject_template, '[{{doc_type}}] {{summary}} ' || f.label) AS subject_template, coalesce(t.body_template, '{{summary}}') AS body_template FROM asked a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, doc_type ORDER BY is_default, id) AS n FROM email_templates) t ON t.user_id = a.user_id AND t.doc_type = a.doc_type AND t.n = 1 LEFT JOIN defaults f ON f.doc_type = CASE WHEN a.doc_type IN (SELECT doc_type FROM defaults) THEN a.doc_type ELSE 'other' END", "send_history", "email_templates")
def _(spark, d):
    return C.template_for(_asked(spark, d).select("user_id", "doc_type"), T.email_templates(spark, d), C.default_templates(spark))


@query("g8_template_text", f"WITH {DEFAULTS}, {ASKED} SELECT a.id, replace(replace(coalesce(t.subject_template, '[{{doc_type}}] {{summary}} ' || f.label), '{{summary}}', a.filename || '{{doc_type}}'), '{{doc_type}}', a.doc_type) AS subject FROM asked a LEFT JOIN email_templates t ON t.user_id = a.user_id AND t.doc_type = a.doc_type LEFT JOIN defaults f ON f.doc_type = CASE WHEN a.doc_type IN (SELECT doc_type FROM defaults) THEN a.doc_type ELSE 'other' END", "send_history", "email_templates")
def _(spark, d):
    asked = _asked(spark, d)
    kinds = asked.select("user_id", "doc_type").distinct()
    t = C.template_for(kinds, T.email_templates(spark, d), C.default_templates(spark))
    summary = F.coalesce(F.concat("filename", F.lit("{doc_type}")), F.lit(""))
    out = asked.join(t, ["user_id", "doc_type"])
    filled = F.replace(F.replace(F.col("subject_template"), F.lit("{summary}"), summary), F.lit("{doc_type}"), F.col("doc_type"))
    return out.select("id", filled.alias("subject"))


@query("c7_template_list", f"WITH {DEFAULTS} SELECT user_id, doc_type, subject_template, 'own' AS source FROM email_templates UNION ALL SELECT u.user_id, f.doc_type, '[{{doc_type}}] {{summary}} ' || label, 'default' FROM users u, defaults f WHERE NOT EXISTS (SELECT 1 FROM email_templates t WHERE t.user_id = u.user_id AND t.doc_type = f.doc_type)", "users", "email_templates")
def _(spark, d):
    return C.list_templates(T.users(spark, d), T.email_templates(spark, d), C.default_templates(spark))


STYLE = "style AS (SELECT * FROM (VALUES ('exam','考試','#E74C3C'),('official','公文','#3498DB'),('receipt','收據','#2ECC71'),('contract','合約','#9B59B6'),('report','報告','#F39C12'),('letter','信件','#1ABC9C'),('form','表單','#34495E'),('other','其他','#95A5A6')) v(doc_type, label, colour))"


@query("c8_type_lookup", f"WITH {STYLE} SELECT h.id, coalesce(s.label, '其他') AS label, coalesce(s.colour, '#95A5A6') AS colour FROM send_history h LEFT JOIN style s USING (doc_type)", "send_history")
def _(spark, d):
    return H.with_style(T.send_history(spark, d)).select("id", "label", "colour")


@query("c9_contact_history", "SELECT contact_id, CAST(rank AS INTEGER) AS rank, send_id FROM (SELECT c.id AS contact_id, h.id AS send_id, row_number() OVER (PARTITION BY c.id ORDER BY sent_at DESC, h.id DESC) AS rank FROM contacts c JOIN send_history h ON h.user_id = c.user_id AND (contains(h.recipient_name, c.name) OR h.recipient_email = c.email)) WHERE rank <= 5", "contacts", "send_history")
def _(spark, d):
    return C.contact_history(T.contacts(spark, d), T.send_history(spark, d))


_ONE_USER = "substr(name, 1 + id % 3, CASE id % 11 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 9 WHEN 3 THEN 7 ELSE 18 END)"


@query("c9_parts_of_names", f"WITH c AS (SELECT id, email, CASE WHEN id % 13 = 0 THEN substr(name, 13) ELSE {_ONE_USER} END AS name FROM contacts), h AS (SELECT id, recipient_email, recipient_name, sent_at FROM send_history) SELECT contact_id, CAST(rank AS INTEGER) AS rank, send_id FROM (SELECT c.id AS contact_id, h.id AS send_id, row_number() OVER (PARTITION BY c.id ORDER BY sent_at DESC, h.id DESC) AS rank FROM c JOIN h ON contains(h.recipient_name, c.name) OR h.recipient_email = c.email) WHERE rank <= 5", "contacts", "send_history")
def _(spark, d):
    """All rows of one user, and names that are parts of others, down to none."""
    i, name = F.col("id"), F.col("name")
    size = F.when(i % 11 == 0, 0).when(i % 11 == 1, 4).when(i % 11 == 2, 9).when(i % 11 == 3, 7).otherwise(18)
    c = T.contacts(spark, d).withColumns({"user_id": F.lit("u"), "name": F.when(i % 13 == 0, F.substr(name, F.lit(13))).otherwise(F.substring(name, (i % 3 + 1).cast("int"), size))})
    return C.contact_history(c, T.send_history(spark, d).withColumn("user_id", F.lit("u")))


@query("c10_groups_of_contact", "SELECT c.id, coalesce(string_agg(g.name, '、' ORDER BY g.name), '—') AS groups FROM contacts c LEFT JOIN group_members m ON m.contact_id = c.id LEFT JOIN contact_groups g ON g.id = m.group_id GROUP BY c.id", "group_members", "contacts")
def _(spark, d):
    return C.groups_of_contact(T.contacts(spark, d), T.contact_groups(spark, d), T.group_members(spark, d))


@query("c12_group_recipients", "SELECT DISTINCT g.user_id, m.contact_id FROM group_members m JOIN contact_groups g ON g.id = m.group_id", "group_members")
def _(spark, d):
    return C.recipients_of(T.contact_groups(spark, d), T.group_members(spark, d))


@query("c17_cascade", "SELECT group_id, contact_id FROM group_members WHERE contact_id % 6 <> 0 AND group_id % 7 <> 0", "group_members")
def _(spark, d):
    return C.cascade(T.group_members(spark, d), T.contacts(spark, d).filter("id % 6 = 0"), T.contact_groups(spark, d).filter("id % 7 = 0"))


@query("d1_contact_upsert", "WITH n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), ch AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN c.email ELSE 'x' || c.email END AS email, c.user_id, 'N' || k AS name FROM n JOIN contacts c ON c.id = o_custkey) SELECT coalesce(c.user_id, ch.user_id) AS user_id, coalesce(c.email, ch.email) AS email, c.id, coalesce(ch.name, c.name) AS name, c.frequency, c.id IS NULL AS inserted FROM contacts c FULL JOIN ch ON ch.user_id = c.user_id AND ch.email = c.email", "contacts")
def _(spark, d):
    c = T.contacts(spark, d).select("id", "user_id", "email", "name", "frequency")
    changes = T.table(spark, d, "orders").filter("o_orderkey % 3 = 0").join(c, F.col("o_custkey") == F.col("id"))
    email = F.when(F.col("o_custkey") % 2 == 0, F.col("email")).otherwise(F.concat(F.lit("x"), "email"))
    changes = changes.select("user_id", email.alias("email"), F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderkey")
    return C.upsert(c, changes, ["user_id", "email"], ["name"], "o_orderkey")


@query("d2_sender_upsert", "SELECT coalesce(s.user_id, u.user_id) AS user_id, CASE WHEN u.user_id IS NOT NULL THEN 'New ' || u.user_id ELSE s.name END AS name, s.email, s.user_id IS NULL AS inserted FROM sender_profiles s FULL JOIN (SELECT * FROM users WHERE substr(user_id, 2)::INT % 3 = 0) u ON u.user_id = s.user_id", "sender_profiles", "users")
def _(spark, d):
    s = T.sender_profiles(spark, d).select("user_id", "name", "email")
    ch = T.users(spark, d).filter(F.substring("user_id", 2, 9).cast("int") % 3 == 0).select("user_id", F.concat(F.lit("New "), "user_id").alias("name"), F.lit(1).alias("seq"))
    return C.upsert(s, ch, ["user_id"], ["name"], "seq")


@query("d3_replace_members", "SELECT group_id, contact_id FROM group_members WHERE group_id % 4 <> 0 UNION ALL SELECT group_id, contact_id + 1 FROM group_members WHERE group_id % 4 = 0 AND group_id % 8 = 0", "group_members")
def _(spark, d):
    m = T.group_members(spark, d)
    wanted = m.filter("group_id % 8 = 0").select("group_id", (F.col("contact_id") + 1).alias("contact_id"))
    return C.replace_members(m, T.contact_groups(spark, d).filter("id % 4 = 0").select(F.col("id").alias("group_id")), wanted.union(wanted))


@query("d4_template_changes", "SELECT id, user_id, CASE WHEN id % 3 = 0 THEN 'S' || id ELSE subject_template END AS subject_template FROM email_templates WHERE id % 5 <> 0 UNION ALL SELECT id + 1000, user_id, 'created' FROM email_templates WHERE id % 2 = 0", "email_templates")
def _(spark, d):
    t = T.email_templates(spark, d)
    patches = t.filter("id % 3 = 0").select("id", F.concat(F.lit("S"), F.col("id").cast("string")).alias("subject_template"), F.lit(2).alias("seq"))
    patches = patches.union(patches.select("id", F.lit("old"), F.lit(1)))
    created = t.filter("id % 2 = 0").withColumns({"id": F.col("id") + 1000, "subject_template": F.lit("created")})
    return C.patch_templates(t, created, patches, t.filter("id % 5 = 0")).select("id", "user_id", "subject_template")


@query("d5_usage", "SELECT c.id, c.frequency + coalesce(n, 0) AS frequency, strftime(greatest(coalesce(last_used_at, latest), coalesce(latest, last_used_at)), '%Y-%m-%d %H:%M:%S') AS last_used FROM contacts c LEFT JOIN (SELECT contact_id, count(*) AS n, max(ts) AS latest FROM usage_events GROUP BY 1) u ON u.contact_id = c.id", "contacts", "usage_events")
def _(spark, d):
    out = C.add_usage(T.contacts(spark, d), T.usage_events(spark, d))
    return out.select("id", "frequency", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@query("d6_insert_groups", "SELECT c.id AS seq, c.user_id, upper(c.title) AS name, row_number() OVER (PARTITION BY c.user_id, upper(c.title) ORDER BY c.id) = 1 AND NOT EXISTS (SELECT 1 FROM contact_groups g WHERE g.user_id = c.user_id AND g.name = upper(c.title)) AS accepted FROM (SELECT id, user_id, CASE WHEN title = '' THEN department ELSE title END AS title FROM contacts) c", "contacts", "contact_groups")
def _(spark, d):
    new = T.contacts(spark, d).select(F.col("id").alias("seq"), "user_id", F.upper(C.or_else("title", "department")).alias("name"))
    return C.insert_groups(T.contact_groups(spark, d), new)


@query("d6_key_audit", "SELECT name, count(*) AS n FROM files GROUP BY name HAVING count(*) > 1", "files")
def _(spark, d):
    return C.duplicates(T.files(spark, d), ["name"])


for _k, _n in (("f1_top_contacts", 10), ("f1_top_contacts_50", 50), ("f1_top_contacts_5", 5)):
    query(_k, f"SELECT user_id, CAST(rank AS INTEGER) AS rank, id FROM ({TOP}) WHERE rank <= {_n}", "contacts")(
        lambda spark, d, n=_n: C.top_contacts(T.contacts(spark, d), n).select("user_id", "rank", "id")
    )


@query("f3_contact_listing", f"SELECT u.user_id, coalesce(t, 'no contacts') AS text FROM users u LEFT JOIN (SELECT user_id, string_agg(rank || '. ' || name || CASE WHEN title <> '' THEN ' (' || title || ')' ELSE '' END || ' ' || email, chr(10) ORDER BY rank) AS t FROM ({TOP}) WHERE rank <= 10 GROUP BY 1) x ON x.user_id = u.user_id", "users", "contacts")
def _(spark, d):
    return C.listing(T.users(spark, d), T.contacts(spark, d))


@query("f12_quick_list", f"WITH t AS (SELECT user_id, rank, name || CASE WHEN title <> '' THEN ' ' || title ELSE '' END AS l FROM ({TOP}) WHERE rank <= 10) SELECT user_id, CAST(rank AS INTEGER) AS rank, CASE WHEN length(l) > 20 THEN substr(l, 1, 17) || '...' ELSE l END AS label FROM t UNION ALL SELECT user_id, CAST(max(rank) + 1 AS INTEGER), '+' FROM t GROUP BY 1", "contacts")
def _(spark, d):
    return C.quick_list(T.contacts(spark, d))


@query("e1_totals", "SELECT user_id, count(*) AS total FROM send_history GROUP BY 1", "send_history")
def _(spark, d):
    return H.totals(T.send_history(spark, d))


MONTH = "sent_at >= TIMESTAMP '2001-07-02 00:00:00'"


@query("e2_monthly", f"SELECT user_id, count(*) FILTER (WHERE {MONTH}) AS monthly FROM send_history GROUP BY 1", "send_history")
def _(spark, d):
    return H.monthly(T.send_history(spark, d), AS_OF)


@query("e3_by_type", "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, doc_type) AS INTEGER) AS rank FROM (SELECT user_id, doc_type, count(*) AS n FROM send_history GROUP BY 1, 2)", "send_history")
def _(spark, d):
    return H.by_type(T.send_history(spark, d))


@query("e4_stats_record", f"SELECT user_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(m) AS BIGINT) AS monthly, string_agg(doc_type || ':' || n, ',' ORDER BY n DESC, doc_type) AS by_type FROM (SELECT user_id, doc_type, count(*) AS n, count(*) FILTER (WHERE {MONTH}) AS m FROM send_history GROUP BY 1, 2) GROUP BY 1", "send_history")
def _(spark, d):
    return H.stats(T.send_history(spark, d), AS_OF)


@query("e5_report", "SELECT user_id, string_agg('• ' || t || ': ' || n, chr(10) ORDER BY n DESC, t) AS report FROM (SELECT user_id, CASE WHEN doc_type = '' THEN '其他' ELSE doc_type END AS t, count(*) AS n FROM send_history GROUP BY 1, 2) GROUP BY 1", "send_history")
def _(spark, d):
    return H.report(T.send_history(spark, d))


@query("e6_dashboard", "SELECT u.user_id, (SELECT count(*) FROM send_history h WHERE h.user_id = u.user_id) AS sent, (SELECT count(*) FROM contacts c WHERE c.user_id = u.user_id) AS contacts, (SELECT count(*) FROM contact_groups g WHERE g.user_id = u.user_id) AS groups FROM users u", "users", "send_history", "contacts", "contact_groups")
def _(spark, d):
    return H.dashboard(T.send_history(spark, d), T.contacts(spark, d), T.contact_groups(spark, d))


LATEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sent_at DESC, id DESC) AS rank FROM send_history"


@query("f2_latest_sends", f"SELECT user_id, CAST(rank AS INTEGER) AS rank, id FROM ({LATEST}) WHERE rank <= 20", "send_history")
def _(spark, d):
    return H.latest(T.send_history(spark, d), 20).select("user_id", "rank", "id")


@query("f13_cards", f"WITH {STYLE} SELECT user_id, CAST(rank AS INTEGER) AS rank, coalesce(label, '其他') AS label, CASE WHEN coalesce(subject, '') = '' THEN '—' ELSE subject END AS subject, strftime(sent_at, '%Y-%m-%d %H:%M') AS sent FROM ({LATEST}) h LEFT JOIN style s USING (doc_type) WHERE rank <= 10", "send_history")
def _(spark, d):
    return H.cards(T.send_history(spark, d))


@query("i7_rolling_month", "SELECT user_id, strftime(day, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT user_id, unnest(generate_series(date_trunc('day', sent_at) - INTERVAL 29 DAY, date_trunc('day', sent_at), INTERVAL 1 DAY)) AS day FROM send_history) GROUP BY 1, 2", "send_history")
def _(spark, d):
    return H.rolling(T.send_history(spark, d))


ONE = "printf('%.1f', floor({0} * 10 + 0.5) / 10)"


@query("g13_byte_sizes", "SELECT id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN " + ONE.format("s / 1024.0::DOUBLE") + " || ' KB' ELSE " + ONE.format("s / 1048576.0::DOUBLE") + " || ' MB' END AS size FROM (SELECT id, CASE id % 3 WHEN 0 THEN file_size % 1500 WHEN 1 THEN file_size ELSE file_size * 37 END AS s FROM send_history)", "send_history")
def _(spark, d):
    s, i = F.col("file_size"), F.col("id") % 3
    return T.send_history(spark, d).select("id", H.byte_size(F.when(i == 0, s % 1500).when(i == 1, s).otherwise(s * 37)).alias("size"))


@query("g14_confidence", "SELECT id, CAST(trunc(ai_confidence * 100) AS INTEGER) AS percent, CASE WHEN ai_confidence < 0.3 THEN 'low confidence' ELSE '' END AS note FROM send_history", "send_history")
def _(spark, d):
    percent, note = H.confidence(F.col("ai_confidence"))
    return T.send_history(spark, d).select("id", percent.alias("percent"), note.alias("note"))
