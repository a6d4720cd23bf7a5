"""Names of one batch, numbering, names within names, streams in several batches, whole answers."""
import contextlib
import datetime
import random
from html.parser import HTMLParser
from pathlib import PurePosixPath
from unittest import mock

import pyarrow as pa
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from lettermill.functions import documents, geometry, names, responses
from lettermill.operators import contacts, delivery
from lettermill.operators.numbering import numbered
from lettermill.sources import catalog, tables
from lettermill.streaming import sessions
from lettermill.streaming.ledger import Ledger

START = datetime.datetime(2024, 1, 1)


def one_by_one(rows, old):
    taken, out = set(old), {}
    for i, n in sorted(rows):
        p = PurePosixPath(n)
        out[i] = n if n not in taken else next(c for k in range(2, 1000) if (c := f"{p.stem} ({k}){p.suffix}") not in taken)
        taken.add(out[i])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_of_one_batch(spark, seed):
    rng = random.Random(seed)

    def name():
        b = rng.choice(["x.pdf", "x.pdf", "x", "a.b.c", ".hid", "y.tar", "x. (2)", "x.0 (3)"])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            p = PurePosixPath(b)
            b = f"{p.stem} ({rng.randrange(1, 8)}){p.suffix}"
        return b

    rows = [(i, name()) for i in range(rng.randrange(20, 260))]
    old = {name() for _ in range(rng.randrange(12))} | {"x.y (2)", "x (02).pdf"}
    new = spark.createDataFrame(rows, "i int, name string").repartition(5)
    got = {r.i: r.target for r in names.collision_free(new, spark.createDataFrame([(n,) for n in old], "name string"), "i").collect()}
    assert got == one_by_one(rows, old)


def test_no_names(spark):
    none = spark.createDataFrame([], "i int, name string")
    assert names.collision_free(none, none.select("name"), "i").count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_numbers_of_a_hot_key(spark, by):
    rows = [(None if i % 3 == 0 else "hot", i * 7919 % 30011, i) for i in range(30_000)]
    given = spark.createDataFrame(rows, "k string, o int, i int").repartition(7)
    seen, want = {}, {}
    for k, o, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "") * bool(by) + (r[1],)):
        seen[k if by else 0] = seen.get(k if by else 0, 0) + 1
        want[i] = seen[k if by else 0]
    got = numbered(given, ["o"], by)
    assert {r.i: r.n for r in got.collect()} == want and got.columns == ["k", "o", "i", "n"]
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("FileScan")[0].split("Window")[0]
    assert numbered(given.limit(0), ["o"], by).count() == 0


def test_names_within_names(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = {(rng.choice("uv"), word(rng.randrange(30))) for _ in range(150)}
    wanted = {(rng.choice("uv"), word(rng.randrange(7))) for _ in range(60)} | {(u, t[i : i + 11]) for u, t in texts for i in (0, 3) if len(t) > i} | {("u", ""), ("u", "zzzzzzzzz")}
    frame = lambda rows, c: spark.createDataFrame([*rows, ("u", None), (None, "ab")], f"user_id string, {c} string")
    got = contacts.names_within(frame(wanted, "name"), frame(texts, "text")).collect()
    assert sorted(map(tuple, got)) == sorted((u, n, t) for u, n in wanted for w, t in texts if u == w and n in t)


def test_candidates_follow_the_input(spark):
    """One user holds all rows, and all names begin alike."""

    def candidates(n):
        own = spark.range(n).select(F.lit("u").alias("user_id"), F.format_string("Customer#%09d", "id").alias("name"))
        return contacts.looked_up(own, own.withColumnRenamed("name", "text"), "user_id").count()

    few, many = candidates(500), candidates(4000)
    assert 500 <= few <= 12 * 500 and many <= 12 * 4000


def test_ledger_of_twenty_batches(spark, tmp_path):
    total = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    ledger = Ledger(f"file://{tmp_path}/l", one.schema, total)
    read = lambda: {r.k: r.n for r in total(ledger.read(spark)).collect()}
    assert read() == {}
    most, crashed = 0, False
    for number in range(20):
        if number == 8:  # the first fold: the snapshot is there, its pointer is not
            point, ledger._point = ledger._point, lambda *_: (_ for _ in ()).throw(OSError("gone"))
            with pytest.raises(OSError, match="gone"):
                ledger.put(one, number)
            ledger._point, crashed = point, True
            assert read() == {"a": 9, "b": 18}
        ledger.put(one, number)
        ledger.put(one, number)  # a repeated batch counts once
        most = max(most, ledger.tables(spark))
        assert read() == {"a": number + 1, "b": 2 * number + 2}
    assert crashed and most <= ledger.most + 2
    assert total(ledger.read(spark, before=19)).filter("k = 'a'").first().n == 19


def arriving(spark, folder, rows, schema):
    """Adds one file to a folder that a stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_kept(spark, tmp_path):
    at, schema = (lambda m: START + datetime.timedelta(minutes=m)), "i int, ts timestamp"
    folder, stream = f"file://{tmp_path}/in", lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    arriving(spark, folder, [(1, at(0)), (2, at(60)), (3, None)], schema)
    arriving(spark, folder, [(4, at(50)), (5, at(49)), (6, at(90))], schema)
    run = lambda: sessions.with_late_rows(stream(), f"file://{tmp_path}/out")
    ids = lambda df: sorted(r.i for r in df.collect())
    on_time, late, counts = run()
    assert (ids(on_time), ids(late)) == ([1, 2, 4, 6], [3, 5]) and counts.first()[1:] == (4, 2)
    arriving(spark, folder, [(7, at(79)), (8, at(80))], schema)
    for _ in range(2):  # over a restart, and over one without new rows
        on_time, late, counts = run()
        assert (ids(on_time), ids(late)) == ([1, 2, 4, 6, 8], [3, 5, 7]) and counts.first()[1:] == (5, 3)


def test_progress_feeds_agree(spark, tmp_path):
    rng = random.Random(2)
    rows = [(t, s, rng.choice([None, 0, 0, 50, 100, 130]), rng.choice(["pending", "running", "running", None, "failed", "completed"])) for t in range(40) for s in range(6)]
    rows += [(99, 0, 0, "pending"), (99, 1, 0, "running"), (99, 2, 50, "running"), (99, 3, 100, "completed")]
    schema = "task_id long, seq long, progress int, status string"
    for s in range(6):
        arriving(spark, f"file://{tmp_path}/in", [(*r, START + datetime.timedelta(minutes=s)) for r in rows if r[1] == s], schema + ", ts timestamp")
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    pushed = sorted(map(tuple, sessions.push_progress(stream, f"file://{tmp_path}/out").collect()), key=repr)
    feed = sorted(map(tuple, delivery.progress_feed(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert pushed == feed and [r[1] for r in feed if r[0] == 99] == [0, 2, 3]


def test_expired_sessions(spark, tmp_path):
    at, schema = (lambda m: START + datetime.timedelta(minutes=m)), "event_id long, user_id long, ts timestamp, target_state string"
    folder, stream = f"file://{tmp_path}/in", lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    arriving(spark, folder, [(1, 1, at(0), "awaiting_contact"), (2, 2, at(0), "awaiting_contact"), (3, 2, at(1), "idle"), (4, 3, at(5), "awaiting_contact")], schema)
    arriving(spark, folder, [(5, 1, at(20), "processing"), (6, 3, at(36), "awaiting_contact"), (7, 4, at(36), "sending")], schema)
    run = lambda: sorted(map(tuple, sessions.run_to_table(sessions.expiries(stream()), f"file://{tmp_path}/out", timers=True).collect()))
    reset = lambda user, was, m: (user, was, "idle", "image/jpeg", None, None, None, at(m))
    assert run() == [reset(3, "awaiting_contact", 35)]  # by its next event
    arriving(spark, folder, [(8, 9, at(61), "idle")], schema)
    assert run() == [reset(1, "processing", 50), reset(3, "awaiting_contact", 35)]  # by the timer, over a restart
    arriving(spark, folder, [(9, 9, at(90), "idle")], schema)
    assert run() == [reset(1, "processing", 50), reset(3, "awaiting_contact", 35), reset(3, "awaiting_contact", 66)]


def test_sweep(spark):
    rows = [(1, "editing", START), (2, "idle", START), (3, "editing", START + datetime.timedelta(minutes=1)), (4, "editing", None)]
    table = spark.createDataFrame(rows, "user_id int, state string, updated_at timestamp").withColumns({"image_media_type": F.lit("image/png"), "edit_field": F.lit("body")})
    got = {r.user_id: (r.state, r.image_media_type, r.edit_field, r.expired) for r in sessions.expire(table, F.lit("2024-01-01 00:31:00").cast("timestamp")).collect()}
    assert got == {1: ("idle", "image/jpeg", None, True), **{i: (s, "image/png", "body", False) for i, s in ((2, "idle"), (3, "editing"), (4, "editing"))}}


def test_missing_and_null_fields(spark):
    whole = '"doc_type": "a", "subject": null, "body": "b", "filename": "f"'
    texts = ["{%s}" % whole, '{%s, "confidence": null}' % whole, '{%s, "confidence": "0.5", "suggested_recipients": ["x", 1]}' % whole, '{%s, "confidence": 0.2, "suggested_recipients": "x"}' % whole, '{"doc_type": "a", "body": "b", "filename": "f", "confidence": 1}', "none", None]
    got = responses.validate(responses.recover(spark.createDataFrame(list(enumerate(texts)), "i int, text string")), "2024-01-31 08:05:00").orderBy("i").collect()
    assert [r.fallback for r in got] == [False] * 4 + [True] * 3
    assert [(r.confidence, r.low_confidence) for r in got] == [(0.0, True), (0.0, True), (0.5, False), (0.2, True), (0.0, False), (0.0, False), (0.0, False)]
    assert [r.suggested_recipients for r in got] == [None, None, ["x", "1"], None, [], [], []] and got[0].subject is None
    assert got[4].filename == "document_20240131_0805.pdf" and got[4].subject == "Scanned document, 2024/01/31" and got[4].doc_type_label == "Document"


def test_least_rectangle(spark):
    import math

    def area(points):
        cols = [F.lit(float(v)).alias(f"{c}{i}") for i, p in enumerate(points) for c, v in zip("xy", p, strict=True)]
        return spark.range(1).select(*cols).select(geometry.least_rectangle()).first()[0]

    turned = lambda w, h, a: [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in ((0, 0), (w, 0), (w, h), (0, h))]
    for a in (0, 0.3, 1.2):
        assert area(turned(30, 20, a)) == pytest.approx(600)
    assert area([(0, 0), (4, 0), (2, 1), (2, 3)]) == pytest.approx(12)  # one point inside
    assert area([(0, 0), (1, 1), (2, 2), (3, 3)]) == area([(1, 1)] * 4) == 0


def test_pages_against_a_plain_reading(spark):
    """Every given page's blocks against a reading that looks at one tag after the other."""

    def blocks(html):
        events, stack, out = [], [], []

        class Tags(HTMLParser):
            handle_starttag = lambda self, tag, attrs: events.append(("open", tag))
            handle_endtag = lambda self, tag: events.append(("close", tag))
            handle_data = lambda self, data: events.append(("text", data))

        p = Tags(convert_charrefs=True)
        p.feed(html)
        p.close()
        hidden, shut = 0, lambda: out.append((stack[-1][0], " ".join(stack.pop()[1].split())))
        for kind, x in events:
            if x in ("script", "style") and kind != "text":
                hidden = hidden + 1 if kind == "open" else max(0, hidden - 1)
            elif kind == "open" and x in documents.BLOCKS:
                if x in ("p", "li") and stack and stack[-1][0] == x:
                    shut()
                stack.append((x, ""))
            elif kind == "close" and any(s[0] == x for s in stack):
                while stack[-1][0] != x:
                    shut()
                shut()
            elif kind == "text" and stack and not hidden:
                stack[-1] = (stack[-1][0], stack[-1][1] + x)
        while stack:
            shut()
        return [(t, b.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) for t, b in out if b]

    pages = tables.table(spark, SMALL, "pages")
    want = [(r.page_id, i, *b) for r in pages.collect() for i, b in enumerate(blocks(r.html or ""))]
    assert sorted(map(tuple, documents.html_blocks(pages).collect())) == sorted(want)


def given_batches(df, make, batch):
    """What a task of make(df) gives for one batch."""
    with mock.patch.object(type(df), "mapInArrow", autospec=True, return_value=df) as put, contextlib.suppress(Exception):
        make(df)
    return list(put.call_args.args[1](iter([batch])))


def test_blocks_leave_in_pieces(spark):
    """A batch of ten thousand pages isn't held as blocks all at once."""
    page = "<body>" + "<p>some words</p>" * 500 + "</body>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int32()), pa.array([None, *[page] * 1998, "<p>" + "x" * 3_000_000])], names=["page_id", "html"])
    got = given_batches(df, documents.html_blocks, batch)
    assert len(got) >= 17 and sum(b.num_rows for b in got) == 1998 * 500 + 1 and max(b.num_rows for b in got) <= 70_000
    assert [r["pos"] for b in got for r in b.to_pylist() if r["page_id"] == 1998] == list(range(500))


def test_files_leave_in_pieces(spark):
    """A batch of large files isn't held whole, nor is what a function makes of it; failures stay in their rows."""
    df = spark.createDataFrame([("a", b"x")], "name string, content binary")
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(40)]), pa.array([b"x" * 200_000 if i % 4 else None for i in range(40)])], names=["name", "content"])
    got = given_batches(df, lambda df: catalog.transform_files(df, lambda _, content: content * 3, ".up"), batch)
    assert max(b.nbytes for b in got) < 2_000_000
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["name"] for r in rows] == [f"f{i}" for i in range(40)]
    assert all((r["content"] == b"x" * 600_000) == (r["error"] is None) == bool(i % 4) for i, r in enumerate(rows))


def test_expiries_of_many_users(spark, tmp_path):
    """State is kept for groups of users, not for each; a row without a user is a user of its own; each reset comes once."""
    rng, at = random.Random(3), lambda m: START + datetime.timedelta(minutes=m)
    schema, users = "event_id long, user_id long, ts timestamp, target_state string", [None, 0, -7, *range(1 << 60, (1 << 60) + 300)]
    rows = [(i, rng.choice(users), at(i * 0.05), rng.choice(sorted(sessions.TRANSITIONS))) for i in range(4000)] + [(4000, 5, at(600), "idle")]
    for n in range(0, 4001, 1000):
        arriving(spark, f"file://{tmp_path}/in", rows[n : n + 1000], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = sessions.run_to_table(sessions.expiries(stream, groups=4), f"file://{tmp_path}/out", timers=True)
    want, last = [], {}
    for _, user, ts, target in [*rows, *((0, u, at(9999), "bogus") for u in users)]:
        state, since = last.get(user, ("idle", None))
        if state != "idle" and ts - since > sessions.TIMEOUT:
            want.append((user, state, since + datetime.timedelta(minutes=30)))
        last[user] = sessions.advance(state, since, ts, target)[:2]
    assert sorted(((r.user_id, r.was, r.reset_at) for r in got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 100
    keys = spark.read.format("statestore").load(f"file://{tmp_path}/out/checkpoint", batchId=1).count()
    assert 0 < keys <= 5
