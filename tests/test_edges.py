"""Hand-written edge rows."""
import pandas as pd
from pyspark.sql import functions as F

from lettermill.functions import arrays, documents, names, responses
from lettermill.operators import contacts, delivery
from lettermill.sources import catalog
from lettermill.streaming import sessions


def one(spark, value, f):
    return spark.range(1).select(f(F.lit(value)).alias("x")).first().x


def test_path_parts(spark):
    for path, want in {".bashrc": (".bashrc", ""), "a.tar.gz": ("a.tar", ".gz"), "dir/a.jpg": ("a", ".jpg"), "a.": ("a.", ""), "x": ("x", "")}.items():
        stem, suffix = names.split_path(F.lit(path))
        assert tuple(spark.range(1).select(stem, suffix).first()) == want, path


def test_safe_names(spark):
    rows = {"CON": "_CON", "con": "_con", "***": "unnamed", "": "unnamed", "a" * 130: "a" * 120, " .x. ": "x", "é": "é", "a​b": "ab"}
    df = spark.createDataFrame(list(enumerate(rows)), "i int, n string")
    got = [r.n for r in names.sanitised(df, "n").orderBy("i").collect()]
    assert got == list(rows.values())


def test_low_information(spark):
    for stem, want in {"abc": True, "IMG_1234": True, "report": True, "會議紀錄摘要": True, "Budget plan 2024": False, "Invoice-QTGTVJK9-0003": True}.items():
        assert one(spark, stem, names.low_info) is want, stem
    assert one(spark, "Budget plan", lambda c: names.low_info(c, include="budget")) is True
    assert one(spark, "IMG_1234", lambda c: names.low_info(c, exclude="IMG;(")) is False


def test_search_keywords(spark):
    df = spark.createDataFrame([(1, "u", "Émile", "a@b.co", "X", 1, None), (2, "u", "Bob_1", "c@d.co", "100%", 2, None)], "id int, user_id string, name string, email string, department string, frequency int, last_used_at timestamp")
    ids = lambda k: sorted(r.id for r in contacts.search(df, k).collect())
    assert ids("É") == [1] and ids("é") == [] and ids("") == [1, 2] and ids("BOB") == [2] and ids("_ob") == [2]


def test_numbering_is_never_cut(spark):
    assert one(spark, 12345, lambda c: names.zfill(c, 3)) == "12345"


def test_collisions(spark):
    new = spark.createDataFrame([(1, "x.pdf"), (2, "x.pdf"), (3, "y"), (4, "y")], "i int, name string")
    old = spark.createDataFrame([("x.pdf",), ("x (2).pdf",), ("y (2)",)], "name string")
    assert [r.target for r in names.collision_free(new, old, "i").orderBy("i").collect()] == ["x (3).pdf", "x (4).pdf", "y", "y (3)"]


def test_collisions_past_999(spark):
    new = spark.range(1, 2501).select("id", F.lit("x.pdf").alias("name")).union(spark.createDataFrame([(2501, "x.0-3.pdf"), (2502, "y")], "id long, name string"))
    old = spark.createDataFrame([("x.pdf",), ("x (7).pdf",), ("x.0.pdf",), ("x.0-2.pdf",), ("x.0-5.pdf",)], "name string")
    got = {r.id: r.target for r in names.collision_free(new, old, "id").collect()}
    assert len(got) == len(set(got.values())) == 2502 and not set(got.values()) & {r.name for r in old.collect()}
    assert got[997] == "x (999).pdf" and got[998] == "x.0-4.pdf" and got[999] == "x.0-6.pdf" and got[2501] == "x.0-3.pdf"
    plan = spark.range(3000).select("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit("new.pdf").alias("wanted"))
    moved = [r.target for r in names.apply_plan(plan, plan.select("name"), "id").collect()]
    assert len(set(moved)) == 3000 and {"new.pdf", "new (999).pdf", "new.0.pdf", "new.0-2.pdf"} <= set(moved)


def test_one_stamp_past_999(spark):
    """The queries' SQL gives the bare stamp to every row past 999, also where it exists."""
    new = spark.range(1, 1101).select("id", F.lit("x.pdf").alias("name"))
    old = spark.createDataFrame([("x.pdf",), ("x (7).pdf",), ("x.0.pdf",)], "name string")
    got = {r.id: r.target for r in names.collision_free(new, old, "id", once=False).collect()}
    assert len(got) == 1100 and got[997] == "x (999).pdf" and {got[i] for i in range(998, 1101)} == {"x.0.pdf"}


def test_one_stamp_past_999_in_a_plan(spark):
    plan = spark.range(1100).select("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit("new.pdf").alias("wanted"))
    got = {r.id: r.target for r in names.apply_plan(plan, plan.select("name"), "id", once=False).collect()}
    assert got[0] == "new.pdf" and got[998] == "new (999).pdf" and {got[i] for i in range(999, 1100)} == {"new.0.pdf"}


def test_page_orders(spark):
    a = F.array(F.lit("a"), F.lit("b"))
    for order, want in (([1, 0], ["b", "a"]), ([0, 0], None), ([0], None), ([0, 2], None)):
        assert spark.range(1).select(arrays.reordered(a, F.array(*map(F.lit, order))).alias("x")).first().x == want
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(arrays.reordered(empty, F.array().cast("array<int>")).alias("x")).first().x == []


def test_json_salvage(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": [1]}}}}}}'
    cases = {
        "": None, "[1]": None, '{"subject": "a"} tail': "braces", '{"subject": "a",}': "commas", '{"subject": "a"': "truncated", "null": None, deep: "whole",
        '{"subject": "a", "tags": ["x", "y': "truncated", '{"subject": "a", "tags": ["x"], "body": "b': "truncated", '{"a": 1} {"b": 2}': None, '{"subject": "a': None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "n int, text string")
    got = {r.text: (r.strategy, r.result and r.result.body) for r in responses.recover(df).collect()}
    assert {t: x[0] for t, x in got.items()} == cases and got['{"subject": "a", "tags": ["x"], "body": "b'][1] is None


def test_brackets_of_cut_json(spark):
    """Closed innermost first, those in strings left alone, wrong or endless nesting not mended."""
    long = '{"subject": "' + "x\\\\[{" * 50_000 + '", "more": {"a": [1'
    cases = {
        '{"subject": "a", "more": [{"b": 1': "a", '{"subject": "a [x {", "more": {"b": {"c": 1': "a [x {", r'{"subject": "\"]", "more": [[1': '"]', '{"subject": [1}': None,
        '{"more": ' + "[" * 100_000: None, long: "x\\[{" * 50_000,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: (r.result and r.result.subject, r.strategy) for r in responses.recover(df).collect()}
    assert got == {t: (want, want and "truncated") for t, want in cases.items()}


def test_answers_are_asked_for_twice(spark):
    def scorer(text):
        if text == "never":
            raise ValueError
        return "" if text == "empty" else "yes " + text

    df = spark.createDataFrame([("a", 1), ("never", 2), ("empty", 3), (None, 4)], "text string, answered int")
    got = {r.answered: (r.answer, r.tried) for r in responses.answered(df, scorer).collect()}
    assert got == {1: ("yes a", 1), 2: (None, 2), 3: (None, 2), 4: ("yes ", 1)}


def test_long_postback(spark):
    name, argument = responses.postback(F.lit("edit_field=" + "x" * 20_000))
    assert len(spark.range(1).select(argument.alias("x")).first().x) == 20_000


def test_counts_over_restarts(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([("a",), ("b",), ("a",)], "k string").coalesce(1).write.parquet(f"{root}/in")
    (tmp_path / "none").mkdir()
    stream = lambda p: spark.readStream.schema("k string").parquet(f"{root}/{p}")
    count = lambda p: {r.k: r.n for r in sessions.merge_counts(stream(p), "k", f"{root}/out-{p}").collect()}
    assert count("in") == {"a": 2, "b": 1}
    spark.createDataFrame([("a",)], "k string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert count("in") == {"a": 3, "b": 1} and count("in") == {"a": 3, "b": 1} and count("none") == {} and count("none") == {}


def test_progress_as_a_stream(spark, tmp_path):
    rows = [(1, 0, 10, "running"), (1, 1, 10, "running"), (1, 2, 120, "completed"), (1, 3, 50, "running"), (2, 0, 0, "running")]
    df = spark.createDataFrame([(*r, pd.Timestamp("2024-01-01").to_pydatetime()) for r in rows], "task_id long, seq long, progress int, status string, ts timestamp")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    got = sessions.push_progress(stream, f"file://{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 10, "running"), (1, 2, 100, "completed"), (2, 0, 0, "running")]


def test_progress_feed(spark):
    rows = [(1, 0, 100, "completed"), (1, 1, 100, "running"), (2, 0, 0, "running"), (2, 1, 0, "running"), (2, 2, 120, "failed")]
    df = spark.createDataFrame(rows, "task_id int, seq int, progress int, status string")
    assert sorted((r.task_id, r.seq) for r in delivery.progress_feed(df).collect()) == [(1, 0), (2, 0), (2, 2)]
    assert {r.task_id: r.progress for r in delivery.latest_status(df).collect()}[2] == 100


def test_session_limits():
    t = pd.Timestamp("2024-01-01")
    assert sessions.advance("processing", t, t + pd.Timedelta(minutes=30), "awaiting_confirm")[2]
    assert not sessions.advance("processing", t, t + pd.Timedelta(minutes=30, seconds=1), "awaiting_confirm")[2]
    assert not sessions.advance("idle", None, t, "idle")[2] and not sessions.advance("idle", None, t, "bogus")[2]


def test_stream_agrees_with_batch(spark, tmp_path):
    from oracle import SMALL

    from lettermill.sources import tables

    e = tables.state_events(spark, SMALL)
    e.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/in")
    got = sessions.run_to_table(sessions.fold_stream(stream), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sessions.fold(e).collect()))


def test_html(spark):
    html = "<body><div>skip<p>a &amp; <b>b</b></p><script>x</script><ul><li>one<li>two</ul></div></body>"
    rows = documents.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r.tag, r.body) for r in rows] == [("p", "a &amp; b"), ("li", "one"), ("li", "two")]


def test_catalogue(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(b"x" * 5)
    (tmp_path / "t.txt").write_bytes("é  b\xff\n c".encode("latin1"))
    got = {r.name: (r.stem, r.ext, r["size"]) for r in catalog.catalogue(spark, f"file://{tmp_path}").collect()}
    assert got["a.tar.gz"] == ("a.tar", ".gz", 5)
    assert {r.path.split("/")[-1]: r.snippet for r in catalog.text_files(spark, f"file://{tmp_path}").collect()}["t.txt"] == "b c"


def test_catalogue_of_tables_in_folders(spark, tmp_path):
    """A table of several part files is one entry, as a table of one file is; plain folders are none."""
    root = f"file://{tmp_path}/in"
    spark.range(90).repartition(3).write.parquet(f"{root}/many.parquet")
    spark.range(9).select("id", (F.col("id") % 2).alias("k")).write.partitionBy("k").parquet(f"{root}/by key.parquet")
    (tmp_path / "in" / "plain").mkdir()
    (tmp_path / "in" / "plain" / "x.txt").write_bytes(b"x")
    (tmp_path / "in" / "one.parquet").write_bytes(b"x" * 7)
    got = {r.name: (r.stem, r.ext, r["size"]) for r in catalog.catalogue(spark, root).collect()}
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / "in" / p).rglob("part-*"))
    assert got == {"many.parquet": ("many", ".parquet", size("many.parquet")), "by key.parquet": ("by key", ".parquet", size("by key.parquet")), "one.parquet": ("one", ".parquet", 7)}
