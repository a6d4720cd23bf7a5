"""Conversation structure: damage for testing, audit, and the cheapest repair by a survivor-coalescence Viterbi search.

The search keeps, for each state of the role pattern, the cheapest edits that
reach it, as paths in one tree of backpointers. Nodes count their children and the
survivors that end in them; a dropped survivor frees its nodes, and once all
survivors share an edit it is emitted and its row forgotten. Ties compare all that
is not yet emitted: survivors agree on the rest, and of two tied ones neither is
the other's beginning, so the comparison decides them whatever comes later.

One conversation's rows come to one task, sorted, and are read as a stream; its
digest is one hash over all its texts in order, so they must pass through one
place. Memory follows the edits that are still open, not the conversation.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import quoted, task

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role kept; START and ASSISTANT may end a conversation
FOLLOWS = {(START, b"s"): SYSTEM, (START, b"u"): USER, (SYSTEM, b"u"): USER, (USER, b"a"): ASSISTANT, (ASSISTANT, b"u"): USER}
ASKED = {START: (b"user", USER), SYSTEM: (b"user", USER), USER: (b"assistant", ASSISTANT), ASSISTANT: (b"user", USER)}
#: BRIDGE[y][x]: by how much the cheapest way to a legal end from y is dearer than that from x, at most. A survivor in x
#: that costs more than one in y and its bridge can neither win nor tie.
BRIDGE = {
    START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}
SPACES = " \t\n\x0b\x0c\r"
LEGAL = (b"su", b"ua", b"au")


class Node:
    __slots__ = ("above", "below", "depth", "edit", "held", "role", "text")

    def __init__(self, above: Node | None, edit: str, role: bytes = b"", text: bytes = b""):
        self.above, self.edit, self.role, self.text, self.below, self.held = above, edit, role, text, [], 0
        self.depth = 0 if above is None else above.depth + 1
        if above is not None:
            above.below.append(self)


class Search:
    """The cheapest edits of one conversation: rows are given in order, edits are handed to `emit` when they are certain."""

    def __init__(self, emit: Callable[[str, bytes, bytes], None]) -> None:
        self.emit, self.root, self.best = emit, Node(None, ""), {}
        self._offer(self.best, START, 0, self.root)
        self._inserts()

    @staticmethod
    def _less(a: Node, b: Node) -> bool:
        x, y = [], []
        while a is not b:
            if a.depth >= b.depth:
                x.append(a.edit)
                a = a.above
            else:
                y.append(b.edit)
                b = b.above
        return x[::-1] < y[::-1]

    def _free(self, n: Node) -> None:
        while n is not self.root and not n.held and not n.below:
            n.above.below.remove(n)
            n = n.above

    def _drop(self, node: Node) -> None:
        node.held -= 1
        self._free(node)

    def _offer(self, best: dict, state: int, cost: int, node: Node) -> None:
        """Makes a node a state's survivor if it is better than the one there."""
        was = best.get(state)
        if was is not None and (was[0] < cost or (was[0] == cost and not self._less(node, was[1]))):
            self._free(node)
            return
        best[state] = (cost, node)
        node.held += 1
        if was is not None:
            self._drop(was[1])

    def _inserts(self) -> None:
        """Rows put in at this place: two at most, as a third leads back to a state that was cheaper before."""
        for _ in range(2):
            for s, (cost, node) in list(self.best.items()):
                role, to = ASKED[s]
                if self.best[s][1] is node and (to not in self.best or cost + INSERT <= self.best[to][0]):
                    self._offer(self.best, to, cost + INSERT, Node(node, "I", role))

    def row(self, role: bytes, text: bytes, must_go: bool, truncated: bool) -> None:
        new: dict[int, tuple[int, Node]] = {}
        more = TRUNCATED if truncated else 0
        for s, (cost, node) in self.best.items():
            self._offer(new, s, cost + DELETE, Node(node, "D"))
            if not must_go:
                if (to := FOLLOWS.get((s, role[:1]))) is not None:
                    self._offer(new, to, cost + more, Node(node, "K", role, text))
                asked, to = ASKED[s]
                self._offer(new, to, cost + REROLE + more, Node(node, "R", asked, text))
        for _, node in self.best.values():
            self._drop(node)
        self.best = new
        self._inserts()
        for x in list(self.best):
            if any(y != x and self.best[x][0] > cost + BRIDGE[y][x] for y, (cost, _) in self.best.items()):
                self._drop(self.best.pop(x)[1])
        self._settle()

    def _settle(self) -> None:
        """Emits what all survivors share."""
        while not self.root.held and len(self.root.below) == 1:
            self.root = self.root.below[0]
            self.root.above = None
            self.emit(self.root.edit, self.root.role, self.root.text)
            self.root.text = b""

    def end(self) -> int:
        """Emits the rest of the cheapest edits and returns their cost."""
        last: dict[int, tuple[int, Node]] = {}
        for x in (START, ASSISTANT):
            if x in self.best:
                self._offer(last, START, *self.best[x])
        for _, node in self.best.values():
            self._drop(node)
        self.best = last
        self._settle()
        return last[START][0]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows with faults planted by crc32(`conv:turn`) % 20, those it drops marked as gone.

    Null roles and texts, and null ids in the key, read as one space. 0 drops a
    row, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes it a user's.
    """
    words = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", words(conv), words(turn)).cast("binary")) % 20
    own = rows.select(F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).alias("turn"), words(role).alias("role"), words(text).alias("text"), code.alias("code"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select(
        "conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("gone"), F.explode(times).alias("copy"),
    ).drop("copy")


def plain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows as they are; null roles and texts read as one space."""
    words = lambda c: F.coalesce(F.col(quoted(c)), F.lit(" "))
    return rows.select(F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).alias("turn"), words(role).alias("role"), words(text).alias("text"), F.lit(False).alias("gone"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's rows together and in order, with their faults; one exchange."""
    dealt = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).repartition("conv")
    place = [F.col("turn").asc_nulls_first(), "role", "text", "seen"]
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    out = dealt.select("*", seen.alias("seen"), end.alias("end")).sortWithinPartitions("conv", "gone", *place)
    blank = F.col("end") == ""
    return out.select(
        "conv", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "gone",
        F.when(blank, 1).when(F.col("seen") > 1, 2).when(F.right("end", F.lit(1)).isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a conversation begins, its row) for all rows."""
    last, first = None, True
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield first or row[0] != last, row
            last, first = row[0], False


def _schema(rows: DataFrame, more: str) -> StructType:
    return StructType([rows.schema["conv"], *StructType.fromDDL(more).fields])


def repaired(rows: DataFrame) -> DataFrame:
    """The cheapest edits as rows (conv, pos, edit, role, text), of rows as `plain` or `damaged` give them.

    pos counts a conversation's edits; a deleted row (D) has null role and text, a
    kept (K), reroled (R) or inserted (I) one those of the repaired conversation.
    """
    schema = _schema(rows, "pos long, edit string, role binary, text binary")

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        out, conv, pos, search, size, types = [], None, 0, None, 0, None

        def emit(edit, role, text):
            nonlocal pos, size
            out.append((conv, pos, edit, None if edit == "D" else role, None if edit == "D" else text))
            pos, size = pos + 1, size + len(text)

        def rest():
            nonlocal size
            size, got = 0, list(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)

        def typed(batches):
            nonlocal types
            for batch in batches:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.binary(), pa.binary()]
                yield batch

        for begins, (key, _turn, role, text, gone, fault) in _conversations(typed(batches)):
            if begins:
                if search is not None:
                    search.end()
                conv, pos, search = key, 0, Search(emit)
            if not gone:
                search.row(role, text, fault in (1, 2), fault == 3)
            if len(out) > 10_000 or size > 1 << 22:
                yield rest()
        if search is not None:
            search.end()
        if out:
            yield rest()

    got = _in_order(rows).mapInArrow(run, schema)
    return got.select("conv", "pos", "edit", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows as `plain` or `damaged` give them: its faults, and the digest of its cheapest repair.

    Rows go by turn (nulls first), then role and text. Null ids are one
    conversation; a conversation whose rows are all gone has zeros, no edits and
    the hash of nothing; an empty table gives no rows. Texts of any length are
    taken whole; repeated rows are duplicates; other columns are not read.
    """
    schema = _schema(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        out, kind = [], None
        search = hashed = None
        edits, conv, any_row, faults, illegal, before, turns = [], None, False, [0] * 4, 0, None, (None, None, 0)

        def emit(edit, role, text):
            nonlocal any_row
            edits.append(edit)
            if edit != "D":
                hashed.update((b"\n" if any_row else b"") + role + b":")
                hashed.update(text)
                any_row = True

        def close():
            cost, (low, high, n) = search.end(), turns
            out.append((conv, high - low + 1 - n if n else 0, *faults[1:], illegal, cost, "".join(edits), hashed.hexdigest()))

        def rest():
            got = list(out)
            out.clear()
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)

        def typed(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for begins, (key, turn, role, text, gone, fault) in _conversations(typed(batches)):
            if begins:
                if search is not None:
                    close()
                if len(out) >= 2_000:
                    yield rest()
                edits, conv, any_row, faults, illegal, before, turns = [], key, False, [0] * 4, 0, None, (None, None, 0)
                hashed, search = hashlib.sha256(), Search(emit)
            if gone:
                continue
            faults[fault] += 1
            illegal += before is not None and before + role[:1] not in LEGAL
            before = role[:1]
            if turn is not None and turn != turns[1]:
                turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
            search.row(role, text, fault in (1, 2), fault == 3)
        if search is not None:
            close()
        if out:
            yield rest()

    return _in_order(rows).mapInArrow(run, schema)
