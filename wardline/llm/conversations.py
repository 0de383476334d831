"""Conversation structure repair by a survivor-coalescence Viterbi.

A conversation's rows are edited (keep, rerole, delete, insert) at least cost into the form ``(s?(ua)+)?`` of role
initials.  The search keeps one survivor for each state in a backpointer tree with reference counts; as soon as all
survivors share an ancestor, the edits up to it are final and leave the tree.

On Spark, only a code of one byte per row is needed to find the edits.  Rows are dealt by ranges of (conversation, turn),
so a conversation with a third of all rows lies in many partitions; each partition condenses its part of a
conversation into least costs and ranks between entry and exit states, which are joined up along the few parts of a
conversation, and then every part finds its own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import attach
from wardline.llm.frames import SPACES
from wardline.session import cut_lineage

# Costs of the edits, and what a truncated row adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: nothing yet, after s, after u, after a; the form may end in NOTHING and AFTER_A.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, ACCEPT = 4, 4
FAR = 1 << 60
# A row's code is 3 * (s, u, a, other) + (sound, truncated, to be deleted).
SOUND, CUT_OFF, DOOMED = range(3)
INSERTS = {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}


def _moves() -> list[list[list[tuple[int, int, bytes]]]]:
    """For each code and state: the states it leads to, with cost and letter."""
    table = []
    for code in range(12):
        kind, extra = divmod(code, 3)
        row = []
        for state in range(STATES):
            ways = [(state, DELETE, b"D")]
            if extra != DOOMED:
                add = TRUNCATED if extra == CUT_OFF else 0
                if state == NOTHING and kind == 0:
                    ways.append((AFTER_S, KEEP + add, b"K"))
                then = INSERTS[state]
                fits = kind == (1 if then == AFTER_U else 2)
                ways.append((then, (KEEP if fits else REROLE) + add, b"K" if fits else b"R"))
            row.append(ways)
        table.append(row)
    return table


def _slack() -> list[list[int]]:
    """``[j][i]``: what any way on from state i costs more, at most, if begun in state j instead."""
    far = [[0 if i == j else FAR for i in range(STATES)] for j in range(STATES)]
    for j, i in INSERTS.items():
        far[j][i] = INSERT
    far[NOTHING][AFTER_S] = far[AFTER_A][AFTER_S] = 0  # both may go on as after s
    far[AFTER_A][NOTHING] = DELETE  # a kept s is deleted instead
    for k in range(STATES):
        for j in range(STATES):
            for i in range(STATES):
                far[j][i] = min(far[j][i], far[j][k] + far[k][i])
    return far


MOVES, SLACK = _moves(), _slack()


class Node:
    """A stretch of edits after ``parent``; ``refs`` counts the children or survivors that stand on it."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent: Node | None, edits: bytes):
        self.parent, self.edits, self.refs = parent, bytearray(edits), 1


class Survivors:
    """The best way into each state, rows taken one by one; final edits go to ``done``.

    A survivor that can be on no best way (it costs more than another one and the price of changing over) is dropped.
    Equal costs are decided by the whole unresolved edits, ASCII-least first.
    """

    def __init__(self, start: int):
        self.root = Node(None, b"")
        self.live: dict[int, tuple[int, Node]] = {start: (0, self.root)}
        self.done = bytearray()

    def _parts(self, node: Node, tail: bytes) -> list:
        parts = [tail]
        while node is not None:
            parts.append(node.edits)
            node = node.parent
        return parts[::-1]

    def _less(self, a: tuple[Node, bytes], b: tuple[Node, bytes]) -> bool:
        if a[0] is b[0]:
            return a[1] < b[1]
        p, q = self._parts(*a), self._parts(*b)
        while p and q and p[0] is q[0]:
            p, q = p[1:], q[1:]
        x, y = bytes(p[0][:64]), bytes(q[0][:64])
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x < y
        return b"".join(p) < b"".join(q)

    def _offer(self, best: dict, state: int, cost: int, node: Node, tail: bytes) -> None:
        held = best.get(state)
        if held is None or cost < held[0] or cost == held[0] and self._less((node, tail), held[1:]):
            best[state] = (cost, node, tail)

    def _with_inserts(self) -> dict[int, tuple[int, Node, bytes]]:
        best = {s: (c, n, b"") for s, (c, n) in self.live.items()}
        for _ in range(2):  # a third insert only comes back to a state at a higher cost
            for s, (c, n, tail) in list(best.items()):
                self._offer(best, INSERTS[s], c + INSERT, n, tail + b"I")
        return best

    def take(self, code: int) -> None:
        best: dict[int, tuple[int, Node, bytes]] = {}
        for s, (c, n, tail) in self._with_inserts().items():
            for then, cost, letter in MOVES[code][s]:
                self._offer(best, then, c + cost, n, tail + letter)
        self._stand(best)

    def _stand(self, best: dict[int, tuple[int, Node, bytes]]) -> None:
        best = {s: v for s, v in best.items() if not any(v[0] > w[0] + SLACK[r][s] for r, w in best.items())}
        used: dict[int, int] = {}
        for _, n, _ in best.values():
            used[id(n)] = used.get(id(n), 0) + 1
        old = [n for _, n in self.live.values()]
        self.live = {}
        for s, (c, n, tail) in best.items():
            if used[id(n)] == 1:
                n.edits += tail
                self.live[s] = (c, n)
            else:
                self.live[s] = (c, Node(n, tail))
        for n in old:
            n.refs = used.get(id(n), 0)
        for n in old:
            if not n.refs:
                self._release(n.parent)
        self._coalesce()

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs == 1 and node is not self.root:
                self._absorb(node)
            if node.refs:
                return
            node = node.parent

    def _absorb(self, node: Node) -> None:
        """A node left with one child takes over its edits and place, so the tree has fewer than eight nodes."""
        leaves = [n for _, n in self.live.values()]
        for n in leaves:
            while n is not None and n.parent is not node:
                n = n.parent
            if n is not None:
                break
        else:
            return
        node.edits += n.edits
        node.refs = n.refs
        for x in leaves:
            while x is not None:
                if x.parent is n:
                    x.parent = node
                x = x.parent
        self.live = {s: (c, node if m is n else m) for s, (c, m) in self.live.items()}

    def _coalesce(self) -> None:
        """What all survivors stand on is final."""
        while self.root.refs == 1 and all(n is not self.root for _, n in self.live.values()):
            n = next(iter(self.live.values()))[1]
            while n.parent is not self.root:
                n = n.parent
            self.done += self.root.edits
            self.root, n.parent = n, None
        if self.root.edits:
            self.done += self.root.edits
            self.root.edits = bytearray()

    def pending(self) -> int:
        """Edits that are not final yet, over all stretches."""
        seen = {}
        for _, n in self.live.values():
            while n is not None:
                seen[id(n)] = len(n.edits)
                n = n.parent
        return sum(seen.values())

    def ends(self) -> dict[int, tuple[int, bytes]]:
        """Cost and unresolved edits of each state that can be left, and of ``ACCEPT``, the end of a conversation."""
        out = {s: (c, b"".join(self._parts(n, b""))) for s, (c, n) in self.live.items()}
        last = {s: (c, b"".join(self._parts(n, t))) for s, (c, n, t) in self._with_inserts().items()}
        ways = [last[s] for s in (NOTHING, AFTER_A) if s in last]
        if ways:
            out[ACCEPT] = min(ways)
        return out


def survive(codes: bytes, start: int) -> tuple[bytes, dict[int, tuple[int, bytes]]]:
    """Final edits, and cost and further edits for each end, from one entry state."""
    run = Survivors(start)
    for code in codes:
        run.take(code)
    return bytes(run.done), run.ends()


def _edits(codes: bytes, start: int, end: int) -> tuple[int, str]:
    done, ends = survive(codes, start)
    cost, rest = ends[end]
    return cost, (done + rest).decode()


_short_edits = lru_cache(1 << 14)(_edits)


def edits(codes: bytes, start: int = NOTHING, end: int = ACCEPT) -> tuple[int, str]:
    """Cost and letters of the least way from ``start`` to ``end``."""
    return (_short_edits if len(codes) <= 64 else _edits)(codes, start, end)


def condensed(codes: bytes) -> tuple[list[int], list[int]]:
    """Least cost and rank of the edits from each entry state to each end (5 for each state).

    Edits of one part never end in an insert, so none is the beginning of another one and ranks decide ties.
    """
    costs, ways = [FAR] * 20, {}
    for start in range(STATES):
        done, ends = survive(codes, start)
        for end, (cost, rest) in ends.items():
            costs[5 * start + end] = cost
            ways[5 * start + end] = done + rest
    order = {w: i for i, w in enumerate(sorted(set(ways.values())))}
    return costs, [order[ways[k]] if k in ways else 0 for k in range(20)]


def route(parts: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """Entry and exit state of each part on the best way through all of them."""
    best = {ACCEPT: (0, ())}
    way: list[dict[int, int]] = []
    for i in reversed(range(len(parts))):
        costs, ranks = parts[i]
        now, step = {}, {}
        for s in range(STATES):
            found = [(costs[5 * s + e] + c, (ranks[5 * s + e], r), e) for e, (c, r) in best.items()
                     if costs[5 * s + e] < FAR]
            if found:
                cost, rank, e = min(found)
                now[s], step[s] = (cost, rank), e
        # ranks of what follows, made small again
        small = {r: k for k, r in enumerate(sorted({r for _, r in now.values()}))}
        best = {s: (c, small[r]) for s, (c, r) in now.items()}
        way.append(step)
    out, state = [], NOTHING
    for step in reversed(way):
        out.append((state, step[state]))
        state = step[state]
    return out


# --- on Spark -----------------------------------------------------------------------------------

def _rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    return rows.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("t"),
                       F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("r"), text.alias("x"))


ORDER = ("c", "t", "r", "h")


def _order() -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in ORDER]


def _coded(rows: DataFrame) -> DataFrame:
    """One row for equal rows: their number and the codes of the first and of the others.

    Equal (conversation, turn, role, text) meet in a combining aggregate; whether a text stood earlier is a minimum per
    (conversation, role, text), joined back for those that repeat.
    """
    bare = F.btrim("x", F.lit(SPACES))
    slim = rows.select("c", "t", "r", F.md5("x").alias("h"), (bare == "").alias("blank"),
                       (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    cells = slim.groupBy("c", "t", "r", "h").agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"),
                                                  F.max("open").alias("open"))
    conv = F.md5(F.coalesce(F.concat(F.lit("="), F.col("c").cast("string")), F.lit("")))
    cells = cells.withColumn("k", F.md5(F.concat(conv, "h", "r")))
    again = (cells.filter("not blank").groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("t").alias("t0"),
                                                        F.max(F.col("t").isNull()).alias("null0")).filter("m > 1"))
    met = attach(cells, again.drop("m"), "k", how="left")
    first = F.when(F.col("null0").isNull(), True).when(F.col("null0"), F.col("t").isNull()).otherwise(
        F.col("t") == F.col("t0"))
    kind = F.coalesce(F.when(F.substring("r", 1, 1) == "s", 0).when(F.substring("r", 1, 1) == "u", 1)
                      .when(F.substring("r", 1, 1) == "a", 2), F.lit(3))
    sound = F.when(F.col("blank") | ~first, DOOMED).when(F.col("open"), CUT_OFF).otherwise(SOUND)
    fresh = (first & ~F.col("blank")).cast("long")
    return met.select("c", "t", "r", "h", "n", (3 * kind + sound).cast("int").alias("code"),
                      F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
                      F.when(F.col("blank"), 0).otherwise(F.col("n") - fresh).alias("duplicate"),
                      F.when(F.col("open"), fresh).otherwise(0).alias("truncated"))


def _plain(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


_FITS = np.zeros((4, 4), bool)
_FITS[0, 1] = _FITS[1, 2] = _FITS[2, 1] = True


def _illegal(codes: bytes) -> int:
    kinds = np.frombuffer(codes, np.uint8) // 3
    return int((~_FITS[kinds[:-1], kinds[1:]]).sum())


def _condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per conversation's part in this partition; the first and the last may go on elsewhere."""
    part = TaskContext.get().partitionId()
    rows, held, first, kind = [], None, True, None

    def close(last: bool) -> None:
        codes = b"".join(held["codes"])
        turns = held["turns"]
        rows.append((held["c"], part, int(first) + 2 * int(last), codes, held["blank"], held["duplicate"], held["truncated"],
                     _illegal(codes), turns[0], turns[1], turns[2]))

    def taken() -> pa.RecordBatch:
        nonlocal rows
        kinds = (kind, pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 7)
        columns = list(zip(*rows)) or [()] * len(kinds)
        rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=PART_NAMES)

    for b in batches:
        kind = b.column(0).type
        for c, t, n, code, blank, duplicate, truncated in zip(*(b.column(i).to_pylist() for i in range(7))):
            if held is None or c != held["c"]:
                if held is not None:
                    close(False)
                    first = False
                held = {"c": c, "codes": [], "blank": 0, "duplicate": 0, "truncated": 0, "turns": [None, None, 0]}
            held["codes"].append(bytes([code]) + bytes([code // 3 * 3 + DOOMED]) * (n - 1))
            held["blank"] += blank
            held["duplicate"] += duplicate
            held["truncated"] += truncated
            turns = held["turns"]
            if t is not None and t != turns[1]:
                turns[0] = t if turns[0] is None else turns[0]
                turns[1] = t
                turns[2] += 1
            if len(held["codes"]) > 1 << 12:
                held["codes"] = [b"".join(held["codes"])]
        if rows:
            yield taken()
    if held is not None:
        close(True)
        yield taken()


PART_NAMES = ["c", "part", "edge", "codes", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]


def _condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [condensed(x) for x in b.column("codes").to_pylist()]
        ends = [(x[0] // 3, x[-1] // 3) for x in b.column("codes").to_pylist()]
        made = [pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64())),
                pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int32())]
        keep = [b.column(x) for x in ("c", "part", "edge", "low", "high")]
        yield pa.RecordBatch.from_arrays(keep + made, names=["c", "part", "edge", "low", "high", "costs", "ranks", "f", "l"])


def _joined_up(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one conversation, one for each partition at most: states, and what meets at their seams."""
    parts = parts.sort_values("part")
    ways = route([(list(c), list(r)) for c, r in zip(parts["costs"], parts["ranks"])])
    bad, same, before, high = [], [], None, None
    for f, last, low, top in zip(parts["f"], parts["l"], parts["low"], parts["high"]):
        bad.append(0 if before is None else int(not _FITS[before, f]))
        same.append(int(high is not None and not pd.isna(low) and low == high))
        before = last
        high = high if pd.isna(top) else top
    return pd.DataFrame({"p": parts["part"], "e": parts["edge"], "start": [w[0] for w in ways],
                         "end": [w[1] for w in ways], "bad": bad, "same": same})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [edits(c, s, e) for c, s, e in zip(*(b.column(x).to_pylist() for x in ("codes", "start", "end")))]
        names = [x for x in b.schema.names if x not in ("codes", "start", "end", "edge")]
        yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array([g[0] for g in got], pa.int64()),
                                          pa.array([g[1] for g in got], pa.string())], names=[*names, "cost", "letters"])


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation of ``rows``.

    Rows go by turn (nulls first), those of equal turn by role, then by the text's MD5.  Null role and text count as one
    space, a null conversation is one like any other, repeated rows are duplicates, an empty table gives an empty
    result, other columns are ignored.  A row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated (the last character is none of ``.!?``); blank and duplicate rows are deleted.  ``audit`` has the initials
    of the cheapest edits in order, ASCII-least where several cost the same.  Texts are not shuffled, only their MD5.
    """
    slim = _rows(rows, conv_col, turn_col, role_col, text_col)
    kind = dict(slim.dtypes)["c"]
    coded = _coded(slim).repartitionByRange(*_order()).sortWithinPartitions(*_order())
    fields = f"c {kind}, part int, edge int, codes binary, blank long, duplicate long, truncated long, illegal long, " \
             "low long, high long, turns long"
    parts = cut_lineage(coded.select("c", "t", "n", "code", "blank", "duplicate", "truncated").mapInArrow(_condense, fields))
    edge = parts.filter("edge > 0").mapInArrow(
        _condensed, f"c {kind}, part int, edge int, low long, high long, costs array<long>, ranks array<long>, f int, l int")
    ways = edge.groupBy("c").applyInPandas(_joined_up, "p int, e int, start int, end int, bad long, same long")
    a = parts.join(ways, (F.col("part") == F.col("p")) & (F.col("edge") == F.col("e")), "left").drop("p", "e")
    a = a.fillna({"start": NOTHING, "end": ACCEPT, "bad": 0, "same": 0})
    done = a.mapInArrow(_edited, f"c {kind}, part int, blank long, duplicate long, truncated long, illegal long, low long, "
                                 "high long, turns long, bad long, same long, cost long, letters string")
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "letters"))),
                                       lambda s: s["letters"]), "")
    whole = done.groupBy("c").agg(
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("bad")).alias("illegal"),
        F.sum("cost").alias("cost"), letters.alias("audit"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.col("turns") - F.col("same")).alias("turns"))
    gaps = F.expr("coalesce(try_cast(cast(high as decimal(20,0)) - low + 1 - turns as bigint), 0)")
    return whole.select(F.col("c").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
                        "audit")


def _apply(c, letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows; letters and rows are read side by side."""
    before = ""
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if before == "u" else "user"
        before = role[:1]
        yield role, text


def _streamed(rows: DataFrame, found: DataFrame, cols: tuple[str, str, str, str], emit, schema: str) -> DataFrame:
    """Rows of each conversation after its audit, in order, through ``emit``; no conversation is held in memory."""
    slim = _rows(rows, *cols).select("c", F.lit(1).alias("o"), "t", "r", F.md5("x").alias("h"), "x")
    heads = found.select(F.col("conv_id").alias("c"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("t"),
                         F.lit("").alias("r"), F.lit("").alias("h"), F.col("audit").alias("x"))
    both = heads.unionByName(slim).repartition("c").sortWithinPartitions(
        F.col("c").asc_nulls_first(), "o", F.col("t").asc_nulls_first(), "r", "h").select("c", "o", "r", "x")
    name = schema.replace("conv_id", f"conv_id {dict(slim.dtypes)['c']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def flat():
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                for a in range(0, b.num_rows, 512):
                    yield from zip(*(x.to_pylist() for x in b.slice(a, 512).columns))
        stream = flat()
        head = next(stream, None)
        while head is not None:
            c, _, _, letters = head
            head = None

            def own():
                nonlocal head
                for row in stream:
                    if row[1] == 0:
                        head = row
                        return
                    yield row[2], row[3]
            mine = own()
            yield from emit(c, kind, _apply(c, letters, mine))
            for _ in mine:  # rows after the last edit: none
                pass
    return both.mapInArrow(run, name)


def repaired(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``conv_id, position, role, text``: the conversations after the edits that ``audits`` of the same rows names."""
    def emit(c, kind, edited):
        out = []

        def batch() -> pa.RecordBatch:
            n, role, text = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array([c] * len(out), kind), pa.array(n, pa.int64()), pa.array(role),
                                               pa.array(text)], names=["conv_id", "position", "role", "text"])
        for i, (role, text) in enumerate(edited):
            out.append((i, role, text))
            if len(out) == 512:
                yield batch()
                out = []
        if out:
            yield batch()
    return _streamed(rows, found, (conv_col, turn_col, role_col, text_col), emit,
                     "conv_id, position long, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the repaired rows as ``role:text``, joined by newlines."""
    def emit(c, kind, edited):
        digest, sep = hashlib.sha256(), b""
        for role, text in edited:
            digest.update(sep + role.encode() + b":")
            digest.update(text.encode())
            sep = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([c], kind), pa.array([digest.hexdigest()])],
                                         names=["conv_id", "repaired_sha256"])
    return _streamed(rows, found, (conv_col, turn_col, role_col, text_col), emit, "conv_id, repaired_sha256 string")
