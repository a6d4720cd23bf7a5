"""Source divergence, conversation repair and exact deduplication against brute force on awkward rows."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from oracle import SMALL, compare
from pyspark.sql import functions as F

from lettermill.llm import divergence, exact, queries, structure

DOCS = "doc_id long, text string, lang string, source string, digest string, run int, n long"
TURNS = "conv_id long, turn long, role string, text string, gone string, fault int, conv string"


def some_docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["Ka", "to", "é", "漢", "x"]) for _ in range(rng.randrange(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(120)] + [None, "", " ", "12 !", "Ka-ka_KA\0ka`ka{ka", "y" * 9_000_000 + " Ka Ka"]
    rows = [(i, t, rng.choice(["a", "b", None]), rng.choice(["s", "s", "s", "t", "u", None]), "clash", 1, 2) for i, t in enumerate(texts)]
    rows += [(500, "no terms kept here", "c", "s", None, None, None), (501, None, "c", "t", None, None, None)]
    return rows + [rows[3]] * 40 + [(None, texts[3], "a", "s", None, None, None), (-4, "only one", "a", "s", None, None, None), (None, "null id alone", "a", "t", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(37).cache()


def test_exact(spark, docs):
    rows = some_docs()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact.classes(docs, keep=keep).collect()
        want = collections.Counter()
        for t, ids in groups.items():
            stays = best((i for i in ids if i is not None), default=None)
            want.update((i, stays, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.doc_id == r.keep_id for r in got if r.kept) and sum(r.kept for r in got) == len(groups)
        kept = exact.one_of_each(docs, keep=keep)
        assert kept.columns == docs.columns and len({r.text or "" for r in kept.collect()}) == kept.count() == len(groups)
    assert exact.classes(docs.limit(0)).count() == 0


def test_exact_has_no_python(spark, docs):
    plan = exact.classes(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortAggregate" in plan


def test_exact_differing_texts_are_noticed(spark):
    """Rows of equal digest whose length or second hash differ stop the job instead of losing a document."""
    rows = [(0, b"d", 1, (4, 1)), (1, b"d", 2, (5, 1))]
    runs = spark.createDataFrame(rows, "run long, digest binary, doc_id long, proof struct<n: int, h: long>").selectExpr("run", "digest", "struct(doc_id) AS row", "1L AS n", "proof AS low", "proof AS high")
    with pytest.raises(Exception, match="differ"):
        exact._merged(runs, exact.FAN_BITS, F.max).collect()


def divergences(rows):
    split = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    own = [(r[2] or "", r[3] or "", split(r[1] or "")) for r in rows]
    out = []
    for lang in {x[0] for x in own}:
        df = collections.Counter(w for x in own if x[0] == lang for w in set(x[2]))
        kept = {w for w, n in df.items() if n >= 3}
        v, count = len(kept), {s: collections.Counter() for g, s, _ in own if g == lang}
        for g, s, words in own:
            if g == lang:
                count[s].update(w for w in words if w in kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v) for w in kept}
        p, every = {s: share(c) for s, c in count.items()}, share(sum(count.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            found = {"pair": [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in count if o != s], "term": [(f(p[s][w], every[w]), w) for w in kept if count[s][w] and p[s][w] > every[w]]}
            for part, values in found.items():
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, w, x, k) for k, (x, w) in enumerate(values, 1) if part == "pair" or k <= 200]
    return collections.Counter(out)


@pytest.mark.parametrize("held", [200_000, 20])
def test_divergence(spark, docs, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "COMBINATIONS", held // 4)
    assert collections.Counter(map(tuple, divergence.audit(docs).collect())) == divergences(some_docs())
    assert divergence.audit(docs.limit(0)).count() == 0


def test_tree_shares_paths():
    """A node and its ancestor are worked out once, whatever the number of terms on the path."""
    import numpy as np

    paths = sorted(([(1, 5), (2, 7), (3, 9)], [(1, 5), (2, 7)], [(1, 5), (3, 9)], [(2, 7), (3, 9)], [(1, 6)], [(1, 5), (2, 7), (4, 2)]))
    times, none, seen = [3, 1, 4, 1, 5, 9], {1: 1, 2: 2, 3: 3, 4: 4}, []
    want = collections.Counter()
    f = lambda a, b: (a - b) ** 2 // b
    for path, m in zip(paths, times, strict=True):
        for (x, p), (y, q) in itertools.permutations(path, 2):
            want[x, y] += m * (f(p, q) - f(p, none[y]) - f(none[x], q) + f(none[x], none[y]))
    apart = divergence._apart
    divergence._apart = lambda p, q: (seen.append(np.broadcast(p, q).size), apart(p, q))[1]
    try:
        flat = [x for path in paths for x in path]
        got = divergence.tree_corrections(np.cumsum([0, *map(len, paths)]), *(np.array(x) for x in ([x[0] for x in flat], [x[1] for x in flat], [none[x[0]] for x in flat], times)))
    finally:
        divergence._apart = apart
    assert {(a, b): v for a, b, v in zip(*map(list, got), strict=True)} == {k: v for k, v in want.items() if v or want[k[::-1]]}
    nodes = {tuple(path[: i + 1]) for path in paths for i in range(len(path))}
    assert sum(seen) <= 8 * sum(len(x) - 1 for x in nodes)


def cheapest(rows):
    """All ways, by recursion from each place: (cost, edits, repaired)."""
    import functools

    follows = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.lru_cache(None)
    def go(i, s, inserted):
        ways = [(0, "", ())] if i == len(rows) and s in (0, 3) else []
        asked, to = ("assistant", 3) if s == 2 else ("user", 2)
        if i < len(rows):
            role, text, fault = rows[i]
            ways += [(c + 2, "D" + e, t) for c, e, t in go(i + 1, s, 0)]
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                ways += [(c + 1 + more, "R" + e, (f"{asked}:{text}", *t)) for c, e, t in go(i + 1, to, 0)]
                if (k := follows.get((s, role[:1]))) is not None:
                    ways += [(c + more, "K" + e, (f"{role}:{text}", *t)) for c, e, t in go(i + 1, k, 0)]
        if inserted < 3:
            ways += [(c + 5, "I" + e, (f"{asked}:", *t)) for c, e, t in go(i, to, inserted + 1)]
        return [min(ways)] if ways else []

    return go(0, 0, 0)[0]


def test_search():
    rng = random.Random(2)
    for n in [*range(14)] * 150:
        rows = tuple((rng.choice(["user", "assistant", "system", "", "other"]), f"t{j}", rng.choice([0, 0, 0, 0, 1, 2, 3])) for j in range(n))
        edits, texts = [], []
        search = structure.Search(lambda e, r, t: (edits.append(e), e == "D" or texts.append((r + b":" + t).decode())))  # noqa: B023
        for role, text, fault in rows:
            search.row(role.encode(), text.encode(), fault in (1, 2), fault == 3)
        assert (search.end(), "".join(edits), tuple(texts)) == cheapest(rows)


def test_search_forgets():
    """Edits that stay open do not grow with the conversation, and freed nodes leave the tree."""
    rng, done, worst = random.Random(3), [], 0
    search = structure.Search(lambda *x: done.append(x[0]))

    def nodes(n):
        return 1 + sum(map(nodes, n.below))

    for i in range(20_000):
        search.row(rng.choice([b"user", b"assistant", b"system"]), b"t", rng.random() < 0.1, rng.random() < 0.1)
        worst = max(worst, i + 1 - len(done))
        assert i % 500 or nodes(search.root) < 400
    assert worst < 100


def turns():
    rng = random.Random(4)
    text = lambda: rng.choice(["Yes.", "No", "So?! ", "", " \n", None, "Well.\t", "é!", "long " * 300_000 + "."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
    rows = [(c, rng.choice([t, t, t + 1, None]), role(), text(), "x", 1, "y") for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, role(), f"t{t}.", None, None, None) for t in range(40)] + [(77, t, role(), f"t{t}.", None, None, None) for t in range(300)]
    return rows + rows[:9]


def damage(rows):
    for c, t, role, text, *_ in rows:
        word = lambda x: " " if x is None else str(x)
        role, text = word(role), word(text)
        code = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            yield from [(c, t, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def test_conversations(spark):
    rows = turns()
    given = spark.createDataFrame(rows, TURNS).repartition(5)
    by = {r[0]: [] for r in rows}
    for c, *r in damage(rows):
        by[c].append(r)
    want = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not end else 2 if (role, text) in seen else 0 if end[-1] in ".!?" else 3)
            seen.add((role, text))
        there = [r[0] for r in own if r[0] is not None]
        gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, edits, texts = cheapest(tuple((r[1], r[2], f) for r, f in zip(own, faults, strict=True)))
        want[c] = (c, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, edits, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    got = structure.audits(structure.damaged(given))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.values(), key=repr)
    edits = collections.defaultdict(dict)
    for r in structure.repaired(structure.damaged(given)).collect():
        edits[r.conv][r.pos] = r
    for c, found in edits.items():
        found = [found[k] for k in range(len(found))]
        assert "".join(r.edit for r in found) == want[c][-2]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in found if r.edit != "D").encode()).hexdigest() == want[c][-1]
    assert structure.audits(structure.plain(given.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_conversation_repair", "op13_exact_dedup"])
def test_against_sql(spark, name):
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SMALL) == ""
