"""Queries over responses, chat texts, page arrays, document blocks, sessions and streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import documents as K
from ..functions import responses as R
from ..operators import contacts as C
from ..sources import catalog as S
from ..sources import tables as T
from ..sources.shared import scratch
from ..streaming import sessions as I
from .base import query


def _responses(spark, d):
    """Answers by number: whole, fenced, in prose, with a comma too much, cut off, without a subject, and none at all."""
    i = F.col("doc_id")
    more = F.when(i % 5 == 0, "").when(i % 5 == 1, ', "confidence": null').otherwise(F.format_string(', "confidence": 0.%s', i % 9))
    rest = F.when(i % 3 == 0, "").when(i % 3 == 1, ', "suggested_recipients": ["A %", "B"], "detected_language": "en", "extracted_text_summary": null, "doc_type_label": "Report"').otherwise(', "suggested_recipients": []')
    full = F.concat(F.format_string('{"doc_type": "report", "subject": "S %s", "body": "a, b", "filename": "f%s.pdf", "more": {"a": {"b": {"c": {"d": {"e": [1, {}]}}}}}', i, i), rest, more, F.lit("}"))
    cut = F.format_string('{"doc_type": "report", "subject": "S %s", "tags": ["x"], "body": ', i)
    half = F.concat(cut, T.pick(('"half a va', '["x", "y', ""), i % 3))
    text = (
        F.when(i % 7 == 0, full).when(i % 7 == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(i % 7 == 2, F.concat(F.lit("Here: "), full, F.lit(" done.")))
        .when(i % 7 == 3, F.regexp_replace(full, r"\}$", ",}")).when(i % 7 == 4, half)
        .when(i % 7 == 5, F.regexp_replace(full, r'"subject": "[^"]*"', F.when(i % 2 == 0, '"subject": null').otherwise('"topic": "x"'))).otherwise(F.concat(F.lit("sorry, no idea: "), F.translate(F.coalesce("text", F.lit("")), "{}", "")))
    )
    return T.table(spark, d, "documents").select("doc_id", text.alias("text"))


_WHOLE = "doc_id % 7 IN (0, 1, 2, 3, 5)"


@query("g11_json_salvage", f"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'whole' WHEN 1 THEN 'fence' WHEN 2 THEN 'braces' WHEN 3 THEN 'commas' WHEN 4 THEN 'truncated' WHEN 5 THEN 'whole' END AS strategy,
  CASE WHEN doc_id % 7 < 5 THEN 'S ' || doc_id END AS subject, CASE WHEN {_WHOLE} THEN 'a, b' END AS body, CASE WHEN doc_id % 7 < 6 THEN 'report' END AS doc_type,
  CASE WHEN {_WHOLE} THEN 'f' || doc_id || '.pdf' END AS filename, CASE WHEN {_WHOLE} AND doc_id % 5 > 1 THEN doc_id % 9 / 10 END AS confidence,
  CASE WHEN {_WHOLE} AND doc_id % 3 = 1 THEN 'Report' END AS label, CASE WHEN {_WHOLE} AND doc_id % 3 = 1 THEN 'en' END AS language,
  CASE WHEN {_WHOLE} AND doc_id % 3 = 1 THEN 'A %|B' WHEN {_WHOLE} AND doc_id % 3 = 2 THEN '' END AS recipients,
  CASE WHEN {_WHOLE} THEN concat_ws(',', CASE WHEN doc_id % 3 <> 1 THEN 'doc_type_label' END, CASE WHEN doc_id % 5 = 0 THEN 'confidence' END, CASE WHEN doc_id % 7 = 5 AND doc_id % 2 = 1 THEN 'subject' END,
    CASE WHEN doc_id % 3 <> 1 THEN 'extracted_text_summary,detected_language' END, CASE WHEN doc_id % 3 = 0 THEN 'suggested_recipients' END)
  WHEN doc_id % 7 = 4 THEN 'doc_type_label,confidence,body,filename,extracted_text_summary,detected_language,suggested_recipients' END AS missing FROM documents""")
def _(spark, d):
    r = R.recover(_responses(spark, d))
    own = [F.col(f"result.{f}").alias(f) for f in ("subject", "body", "doc_type", "filename", "confidence")]
    return r.select("doc_id", "strategy", *own, F.col("result.doc_type_label").alias("label"), F.col("result.detected_language").alias("language"), _text(F.col("result.suggested_recipients"), "|").alias("recipients"), _text(F.col("result.missing")).alias("missing"))


@query("g12_result_checks", """WITH r AS (SELECT *, doc_id % 7 IN (4, 6) OR (doc_id % 7 = 5 AND doc_id % 2 = 1) AS f FROM documents)
SELECT doc_id, f AS fallback, CASE WHEN f THEN 'document_20240131_0000.pdf' ELSE 'f' || doc_id || '.pdf' END AS filename, NOT f AND (doc_id % 5 < 2 OR doc_id % 9 < 3) AS low_confidence,
  CASE WHEN f OR doc_id % 5 < 2 THEN 0.0 ELSE doc_id % 9 / 10 END AS confidence, CASE WHEN f THEN 'Scanned document, 2024/01/31' WHEN doc_id % 7 < 5 THEN 'S ' || doc_id END AS subject,
  CASE WHEN f THEN 'Document' WHEN doc_id % 3 = 1 THEN 'Report' END AS label, CASE WHEN f THEN '(not recognised, please check)' END AS summary,
  CASE WHEN f THEN 'zh-TW' WHEN doc_id % 3 = 1 THEN 'en' END AS language, CASE WHEN f OR doc_id % 3 = 2 THEN '' WHEN doc_id % 3 = 1 THEN 'A %|B' END AS recipients FROM r""")
def _(spark, d):
    got = R.validate(R.recover(_responses(spark, d)), "2024-01-31")
    return got.select("doc_id", "fallback", "filename", "low_confidence", "confidence", "subject", F.col("doc_type_label").alias("label"), F.col("extracted_text_summary").alias("summary"), F.col("detected_language").alias("language"), _text(F.col("suggested_recipients"), "|").alias("recipients"))


@query("j2_scored", "SELECT doc_id, CAST(CASE WHEN length(coalesce(text, '')) % 5 < 2 THEN 2 ELSE 1 END AS INTEGER) AS tried, length(coalesce(text, '')) % 5 = 0 AS fallback, CASE WHEN length(coalesce(text, '')) % 5 > 0 THEN length(coalesce(text, '')) || ' characters' ELSE 'Scanned document, 2024/01/31' END AS subject FROM documents")
def _(spark, d):
    def scorer(text: str, asked=set()) -> str:  # noqa: B006
        """Fails for some lengths at first, for others always."""
        kind = len(text) % 5
        if kind == 0 or (kind == 1 and text not in asked):
            asked.clear()
            asked.add(text)
            raise TimeoutError(text)
        asked.clear()
        return '{"doc_type": "report", "subject": "%d characters", "body": "b", "filename": "f.pdf", "confidence": 0.9}' % len(text)

    got = R.answered(T.table(spark, d, "documents").select("doc_id", "text"), scorer)
    return R.validate(R.recover(got, "answer"), "2024-01-31").select("doc_id", "tried", "fallback", "subject")


@query("g9_contact_lines", "SELECT id, valid, CASE WHEN id % 5 = 1 THEN NULL ELSE email END AS email, CASE WHEN id % 5 IN (2, 3) THEN 'Dept' ELSE '' END AS department FROM (SELECT id, email, id % 5 <> 1 AS valid FROM contacts)", "contacts")
def _(spark, d):
    i, n = F.col("id") % 5, F.lit("Nm")
    text = (
        F.when(i == 1, n).when(i == 2, F.concat_ws(" ", n, "email", F.lit("Dept"), F.lit("Boss"))).when(i == 3, F.concat_ws("\t", n, "email", F.lit("Dept"), F.lit("Boss"), F.lit("x"), F.lit("y")))
        .when(i == 4, F.concat(F.lit("　"), n, F.lit("　"), "email")).otherwise(F.concat_ws("  ", n, "email"))
    )
    p = R.contact_line(text)
    return T.contacts(spark, d).select("id", p["valid"].alias("valid"), p["email"].alias("email"), p["department"].alias("department"))


@query("g10_postbacks", "SELECT id, (['select_contact', 'edit', 'edit_field', 'cancel', 'unknown', 'confirm_send'])[id % 6 + 1] AS action, CASE id % 6 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 2 THEN 'sub ject' END AS argument FROM contacts", "contacts")
def _(spark, d):
    i, k = F.col("id") % 6, F.col("id").cast("string")
    data = (
        F.when(i == 0, F.concat(F.lit("action=edit&select_contact="), k, F.lit("&select_contact=9"))).when(i == 1, "action=edit").when(i == 2, "edit_field=sub%20ject&action=cancel")
        .when(i == 3, "select_contact=x&action=cancel").when(i == 4, "action=&edit_field=").otherwise("x=1&action=confirm_send&action=edit")
    )
    action, arg = R.postback(data)
    return T.contacts(spark, d).select("id", action.alias("action"), arg.alias("argument"))


def _pages(spark, d):
    n = F.col("id") % 6
    a = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda x: F.concat(F.lit("p"), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    return T.contacts(spark, d).select("id", n.cast("int").alias("n"), a.alias("a"))


PAGES = "pg AS (SELECT id, CAST(id % 6 AS INTEGER) AS n, list_transform(range(1, id % 6 + 1), lambda x: 'p' || x) AS a FROM contacts)"


def _text(c, mark=","):
    return F.array_join(c, mark)


@query("h2_toggle", f"WITH {PAGES} SELECT id, array_to_string(CASE WHEN list_contains(a, 'p2') THEN list_filter(a, lambda x: x <> 'p2') ELSE list_append(a, 'p2') END, ',') AS pages FROM pg", "contacts")
def _(spark, d):
    return _pages(spark, d).select("id", _text(A.toggled(F.col("a"), F.lit("p2"))).alias("pages"))


@query("h3_append", f"WITH {PAGES} SELECT id, array_to_string(list_append(a, 'new'), ',') AS pages, CAST(len(a) AS INTEGER) AS at FROM pg", "contacts")
def _(spark, d):
    return _pages(spark, d).select("id", _text(F.array_append("a", F.lit("new"))).alias("pages"), F.size("a").alias("at"))


@query("h4_remove", f"WITH {PAGES} SELECT id, array_to_string(list_concat(a[1:id % 4], a[id % 4 + 2:]), ',') AS pages FROM pg", "contacts")
def _(spark, d):
    return _pages(spark, d).select("id", _text(A.removed_at(F.col("a"), (F.col("id") % 4).cast("int"))).alias("pages"))


@query("h5_reorder", f"WITH {PAGES} SELECT id, CASE WHEN id % 5 = 0 AND n > 1 THEN NULL ELSE array_to_string(list_reverse(a), ',') END AS pages FROM pg", "contacts")
def _(spark, d):
    p = _pages(spark, d)
    order = F.when(F.col("n") > 0, F.reverse(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))))).otherwise(F.array().cast("array<int>"))
    order = F.when((F.col("id") % 5 == 0) & (F.col("n") > 1), F.transform(order, lambda _: F.lit(0))).otherwise(order)
    return p.select("id", _text(A.reordered(F.col("a"), order)).alias("pages"))


@query("h6_move", f"WITH {PAGES} SELECT id, array_to_string(list_concat(a[2:3], a[1:1], a[4:]), ',') AS pages FROM pg WHERE n >= 3", "contacts")
def _(spark, d):
    return _pages(spark, d).filter("n >= 3").select("id", _text(A.moved(F.col("a"), F.lit(0), F.lit(2))).alias("pages"))


@query("h7_page_list", f"WITH {PAGES} SELECT id, CAST(k - 1 AS INTEGER) AS pos, a[k] AS page, n AS total FROM pg, range(1, 7) r(k) WHERE k <= n", "contacts")
def _(spark, d):
    return _pages(spark, d).select("id", F.posexplode("a").alias("pos", "page"), F.col("n").alias("total"))


def _marked(spark, d):
    """Documents whose lines are decorated by number: headings, list items, a fence."""
    mark = lambda x, i: F.concat(F.when(i % 11 == 0, "# ").when(i % 11 == 3, "## ").when(i % 11 == 5, "#### ").when(i % 11 == 7, "- ").otherwise(""), x)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), mark)
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n\n```\ncode # 1\n\nmore\n```\nend"))
    return T.table(spark, d, "documents").select("doc_id", text.alias("text"))


_MARKED = "marked AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE (i - 1) % 11 WHEN 0 THEN '# ' WHEN 3 THEN '## ' WHEN 5 THEN '#### ' WHEN 7 THEN '- ' ELSE '' END || x), chr(10)) || repeat(chr(10), 2) || '```' || chr(10) || 'code # 1' || chr(10) || chr(10) || 'more' || chr(10) || '```' || chr(10) || 'end' AS text FROM documents)"


@query("k1_markdown_blocks", rf"""WITH {_MARKED}, l AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM marked)),
f AS (SELECT *, starts_with(raw, '```') AS fence, sum(CAST(starts_with(raw, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS inside FROM l),
k AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN inside THEN 'code' WHEN starts_with(raw, '# ') THEN 'h1' WHEN starts_with(raw, '## ') THEN 'h2' WHEN regexp_matches(raw, '^#{{3,6}} ') THEN 'h3'
  WHEN regexp_matches(raw, '^\s*([-*+]|\d+\.) ') THEN 'li' WHEN regexp_matches(raw, '^\s*$') THEN 'blank' ELSE 'p' END AS kind FROM f),
s AS (SELECT *, CASE WHEN kind = 'code' THEN raw ELSE regexp_replace(raw, '^(#{{1,6}} |\s*([-*+]|\d+\.) )', '') END AS b, CASE WHEN lag(kind) OVER w = kind AND kind IN ('p', 'code') THEN 0 ELSE 1 END AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM s)
SELECT doc_id, CAST(block AS BIGINT) AS block, kind, string_agg(b, chr(10) ORDER BY line) AS body FROM g WHERE kind NOT IN ('fence', 'blank') GROUP BY 1, 2, 3""")
def _(spark, d):
    return K.markdown_blocks(_marked(spark, d))


@query("k2_html_blocks")
def _(spark, d):
    return K.html_blocks(T.table(spark, d, "pages"))


@query("k3_to_markdown", "SELECT CAST(conv_id AS BIGINT) AS doc_id, string_agg((['# ', '## ', '### ', '- ', ''])[turn % 5 + 1] || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def _(spark, d):
    b = T.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").alias("pos"), T.pick(("h1", "h2", "h3", "li", "p"), F.col("turn") % 5).alias("style"), F.col("text").alias("body"))
    return K.to_markdown(b)


@query("k4_page_lines", "WITH l AS (SELECT doc_id, 0 AS page, CAST(p - 1 AS INTEGER) AS pos, trim(string_split(text, chr(10))[p], ' ' || chr(9) || chr(13)) AS line FROM documents, range(1, 10000) r(p) WHERE p <= len(string_split(text, chr(10)))) SELECT doc_id, CAST(doc_id % 3 AS BIGINT) AS page, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 AND doc_id % 3 > 0 AS page_break FROM l WHERE line <> ''")
def _(spark, d):
    p = T.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("page"), "text")
    return K.page_lines(p, "doc_id", "page")


def _cued(spark, d):
    """Whole texts with cue words and numbers after them."""
    i = F.col("doc_id")
    cue = T.pick(("題目 配分", "主旨", "金額 品項 題目", "條款", "圖表 章節", "敬啟", "勾選 主旨", "none"), i % 8)
    number = F.when(i % 11 == 0, F.concat(F.lit(" A1"), F.lpad((i % 100000000).cast("string"), 8, "0"), F.lit(" "))).otherwise("")
    return T.table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "text", cue, number, F.lit("1234567890123"), F.col("doc_id").cast("string")).alias("text"))


_CUED = "cued AS (SELECT doc_id, coalesce(text || ' ', '') || (['題目 配分', '主旨', '金額 品項 題目', '條款', '圖表 章節', '敬啟', '勾選 主旨', 'none'])[doc_id % 8 + 1] || ' ' || CASE WHEN doc_id % 11 = 0 THEN ' A1' || lpad(CAST(doc_id % 100000000 AS VARCHAR), 8, '0') || ' ' ELSE '' END || ' 1234567890123 ' || doc_id AS text FROM documents)"
_TYPES = ", ".join("{'n': " + " + ".join(f"CAST(contains(text, '{c}') AS INTEGER)" for c in cues) + f", 'o': {-i}, 't': '{t}'}}" for i, (t, cues) in enumerate(K.CUES.items()))


@query("k5_doc_types", f"WITH {_CUED}, hits AS (SELECT doc_id, [{_TYPES}] AS h FROM cued) SELECT doc_id, CASE WHEN list_max(h).n > 0 THEN list_max(h).t ELSE 'other' END AS doc_type, round(CASE WHEN list_max(h).n > 0 THEN list_max(h).n / list_sum(list_transform(h, lambda x: x.n)) ELSE 0.0 END, 6) AS confidence FROM hits")
def _(spark, d):
    return K.with_doc_type(_cued(spark, d)).select("doc_id", "doc_type", F.round("confidence", 6).alias("confidence"))


@query("k6_masked", f"WITH {_CUED} SELECT doc_id, CAST(len(regexp_extract_all(text, '{K.MASKED}')) AS INTEGER) AS hits, md5(regexp_replace(text, '{K.MASKED}', '***', 'g')) AS masked_md5 FROM cued")
def _(spark, d):
    text, hits = K.masked(F.col("text"))
    return _cued(spark, d).select("doc_id", hits.alias("hits"), F.md5(text).alias("masked_md5"))


@query("f7_prefix_text", "WITH p AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, substr(trim(regexp_replace(string_agg(text, chr(10) ORDER BY turn), '\\s+', ' ', 'g')), 1, 300) AS snippet FROM p WHERE b <= 300 AND n <= 5 GROUP BY 1")
def _(spark, d):
    return K.prefix_text(T.table(spark, d, "conversations"), "conv_id", "turn", most_chars=300)


ALLOWED = ", ".join(f"'{a}>{b}'" for a, bs in I.TRANSITIONS.items() for b in sorted(bs))


SESSION_SQL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM state_events),
f AS (SELECT user_id, rn, event_id, 'idle>' || target_state IN ({ALLOWED}) AS accepted, CASE WHEN 'idle>' || target_state IN ({ALLOWED}) THEN target_state ELSE 'idle' END AS state,
  CASE WHEN 'idle>' || target_state IN ({ALLOWED}) THEN ts END AS upd FROM e WHERE rn = 1
UNION ALL SELECT user_id, rn, event_id, ok, CASE WHEN ok THEN target_state ELSE cur END, CASE WHEN ok THEN ts ELSE upd END FROM (
  SELECT *, cur || '>' || target_state IN ({ALLOWED}) AS ok FROM (SELECT e.user_id, e.rn, e.event_id, e.ts, e.target_state, f.upd,
  CASE WHEN f.state <> 'idle' AND f.upd IS NOT NULL AND e.ts - f.upd > INTERVAL 30 MINUTE THEN 'idle' ELSE f.state END AS cur FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)))
SELECT event_id, user_id, accepted, state FROM f"""


@query("i2_session_fold", SESSION_SQL, "state_events")
def _(spark, d):
    return I.fold(T.state_events(spark, d))


@query("i4_activity", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def _(spark, d):
    return I.activity(T.state_events(spark, d))


@query("i5_first_events", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return I.first_events(T.state_events(spark, d))


def _stream(spark, d, name):
    return I.source(spark, d, name, T.table(spark, d, name).schema)


@query("i1_session_stream", SESSION_SQL, "state_events")
def _(spark, d):
    return I.run_to_table(I.fold_stream(T.state_events(spark, d, _stream(spark, d, "events"))), scratch(spark, "sessions"))


def _arrivals(df, slice_of, count=4):
    """A stream of a table's rows that come in `count` files, one after the other and each a batch of its own."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "arrivals")
    for n in range(count):
        df.filter(slice_of == n).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


_SPAN = "(SELECT min(ts) AS a, max(ts) AS b FROM events)"
_SLICE = "least(3, CAST(floor(4 * (epoch_us(ts) - epoch_us(a))::DOUBLE / (epoch_us(b) - epoch_us(a) + 1)) AS BIGINT))"


def _sliced(events):
    """Events with the number of the file that they come in, by time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(us).alias("a"), F.max(us).alias("b"))
    n = F.floor((us - F.col("a")) * 4.0 / (F.col("b") - F.col("a") + 1))
    return events.join(F.broadcast(span)).withColumn("slice", F.least(F.lit(3), n.cast("long"))).drop("a", "b")


@query("a6_event_source", f"""WITH s AS (SELECT event_id, ts, least(3, {_SLICE} + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END) AS n FROM events, {_SPAN}),
m AS (SELECT x.n, max(s.ts) - INTERVAL 10 MINUTE AS mark FROM (SELECT DISTINCT n FROM s) x JOIN s ON s.n < x.n GROUP BY 1), f AS (SELECT event_id, coalesce(ts < mark, false) AS late FROM s LEFT JOIN m USING (n))
SELECT event_id, late, count(*) FILTER (NOT late) OVER () AS on_time, count(*) FILTER (late) OVER () AS too_late FROM f""")
def _(spark, d):
    e = _sliced(T.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")))
    e = e.withColumn("slice", F.least(F.lit(3), F.col("slice") + F.when(F.col("event_id") % 17 == 0, 2).otherwise(0)))
    on_time, late, counts = I.with_late_rows(_arrivals(e, F.col("slice")), scratch(spark, "events"))
    rows = on_time.select("event_id", F.lit(False).alias("late")).union(late.select("event_id", F.lit(True)))
    return rows.join(F.broadcast(counts.select("on_time", F.col("late").alias("too_late"))))


@query("i3_expired_sessions", f"""{SESSION_SQL.replace("SELECT event_id, user_id, accepted, state FROM f", "")}, moved AS (SELECT f.user_id, f.state, e.ts, lead(e.ts) OVER (PARTITION BY f.user_id ORDER BY f.rn) AS nxt FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn WHERE f.accepted),
ended AS (SELECT user_id, max(ts) AS last FROM state_events GROUP BY 1)
SELECT m.user_id, m.state AS was, 'idle' AS state, 'image/jpeg' AS image_media_type, true AS cleared, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS reset_at
FROM moved m JOIN ended USING (user_id), (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM state_events)
WHERE m.state <> 'idle' AND (nxt IS NULL OR nxt - ts > INTERVAL 30 MINUTE) AND (last - ts > INTERVAL 30 MINUTE OR ts + INTERVAL 30 MINUTE < mark)""", "state_events")
def _(spark, d):
    e = _sliced(T.table(spark, d, "events"))
    stream = T.state_events(spark, d, _arrivals(e, F.col("slice")))
    out = I.run_to_table(I.expiries(stream), scratch(spark, "expiries"), timers=True)
    cleared = F.col("selected_contact_id").isNull() & F.col("ai_result").isNull() & F.col("edit_field").isNull()
    return out.select("user_id", "was", "state", "image_media_type", cleared.alias("cleared"), F.date_format("reset_at", "yyyy-MM-dd HH:mm:ss").alias("reset_at"))


@query("i3_session_sweep", """WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS updated_at FROM events GROUP BY 1), x AS (SELECT *, state <> 'idle' AND mark - updated_at > INTERVAL 30 MINUTE AS expired FROM (SELECT user_id, CASE state WHEN 'view' THEN 'idle' ELSE state END AS state, updated_at FROM s), (SELECT max(ts) AS mark FROM events))
SELECT user_id, expired, CASE WHEN expired THEN 'idle' ELSE state END AS state, CASE WHEN expired THEN 'image/jpeg' ELSE 'image/png' END AS image_media_type, CASE WHEN NOT expired THEN 7 END AS selected_contact_id,
  CASE WHEN NOT expired THEN '{}' END AS ai_result, CASE WHEN NOT expired THEN 'body' END AS edit_field, strftime(CASE WHEN expired THEN mark ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM x""")
def _(spark, d):
    e = T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("updated_at"))
    payload = {"image_media_type": F.lit("image/png"), "selected_contact_id": F.lit(7).cast("long"), "ai_result": F.lit("{}"), "edit_field": F.lit("body")}
    sessions = last.withColumns({"state": F.when(F.col("state") == "view", "idle").otherwise(F.col("state")), **payload})
    out = I.expire(sessions.join(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("now"))
    return out.select("user_id", "expired", "state", "image_media_type", "selected_contact_id", "ai_result", "edit_field", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("i8_progress_stream", "WITH o AS (SELECT *, lag(progress) OVER w AS before, max(CAST(status IN ('completed', 'failed') AS INTEGER)) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM task_progress WINDOW w AS (PARTITION BY task_id ORDER BY seq)) SELECT task_id, seq, progress, status FROM o WHERE coalesce(ended, 0) = 0 AND (status IN ('completed', 'failed') OR before IS NULL OR before <> progress)", "task_progress")
def _(spark, d):
    p = T.task_progress(spark, d).withColumn("ts", F.timestamp_seconds(1_704_067_200 + F.col("seq") * 60))
    return I.push_progress(_arrivals(p, F.least(F.lit(3), F.expr("seq div 2"))), scratch(spark, "progress"))


@query("i6_stream_counts", "SELECT CAST(event_type AS VARCHAR) AS event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return I.merge_counts(_stream(spark, d, "events").select("event_type"), "event_type", scratch(spark, "counts"))


@query("i9_stream_usage", "SELECT c.id, c.frequency + coalesce(n, 0) AS frequency FROM contacts c LEFT JOIN (SELECT contact_id, count(*) AS n FROM usage_events GROUP BY 1) u ON u.contact_id = c.id", "contacts", "usage_events")
def _(spark, d):
    total = T.table(spark, d, "customer").count()
    e = _stream(spark, d, "events").filter("event_type = 'purchase'").select((F.col("event_id") % total).alias("contact_id"))
    n = I.merge_counts(e, "contact_id", scratch(spark, "usage"))
    out = T.contacts(spark, d).join(n, F.col("id") == F.col("contact_id"), "left")
    return out.select("id", (F.col("frequency") + F.coalesce("n", F.lit(0))).alias("frequency"))


@query("j1_file_transform", "SELECT doc_id || '.up' AS output, CASE WHEN doc_id % 10 <> 0 AND text <> '' THEN md5('FILE ' || text) END AS content_md5, NOT coalesce(doc_id % 10 <> 0 AND text <> '', false) AS failed FROM documents")
def _(spark, d):
    f = T.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.coalesce("text", F.lit(""))).cast("binary").alias("content"))

    def headed(name: str, content: bytes) -> bytes:
        if not content:
            raise ValueError("empty")
        return b"FILE " + content

    return S.transform_files(f, headed, ".up").select("output", F.md5("content").alias("content_md5"), F.col("error").isNotNull().alias("failed"))


@query("j3_named_transforms", "SELECT doc_id, upper(lang) AS a, lang AS b FROM documents")
def _(spark, d):
    c = F.col("lang")
    return T.table(spark, d, "documents").select("doc_id", S.named_transform("upper", c).alias("a"), S.named_transform("no such", c).alias("b"))


@query("a2_catalogue", "SELECT name || '.parquet' AS name, name AS stem, '.parquet' AS ext, true AS filled FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name)")
def _(spark, d):
    """The folder of the given tables: what is there, without reading it."""
    return S.catalogue(spark, d).filter("ext = '.parquet'").select("name", "stem", "ext", (F.col("size") > 0).alias("filled"))


@query("a3_snippets", "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 2000) AS snippet FROM documents")
def _(spark, d):
    return T.table(spark, d, "documents").select("doc_id", S.snippet(F.col("text").cast("binary")).alias("snippet"))


@query("a4_history_sink", "SELECT user_id, count(*) AS n FROM send_history WHERE id % 3 <> 0 GROUP BY 1", "send_history")
def _(spark, d):
    path = scratch(spark, "history")
    S.append_history(T.send_history(spark, d).select("id", "user_id", (F.col("id") % 3 != 0).alias("success")), path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("a5_contact_seed", "SELECT user_id, email, CASE WHEN id % 4 = 0 THEN 'Seed ' || name ELSE name END AS name FROM contacts", "contacts")
def _(spark, d):
    every = T.contacts(spark, d).select("id", "user_id", "email", "name")
    seeds = every.filter("id % 4 = 0").select("user_id", "email", F.concat(F.lit("Seed "), "name").alias("name"), F.lit(1).alias("seq"))  # half of them are new
    return C.upsert(every.filter("id % 8 <> 0"), seeds, ["user_id", "email"], ["name"], "seq").select("user_id", "email", "name")
