"""Conversation repair against exhaustive search, and the query against a plain version."""

import hashlib
import itertools
import random
import zlib

import pytest
from wardline.llm import conversations as cv
from wardline.llm.queries import QUERIES

FORM = {"": "su", "s": "u", "u": "a", "a": "u"}


def exhaustive(codes, inserts=1):
    """All edits of a few rows, with at most ``inserts`` inserts in a gap: least (cost, letters)."""
    best = [(1 << 40, "")]

    def go(i, last, cost, letters, room):
        if i == len(codes) and last in ("", "a"):
            best[0] = min(best[0], (cost, letters))
        if room:
            for unit in FORM[last]:
                if unit != "s":
                    go(i, unit, cost + 5, letters + "I", room - 1)
        if i == len(codes):
            return
        kind, fault = divmod(codes[i], 3)
        go(i + 1, last, cost + 2, letters + "D", inserts)
        if fault < 2:
            for unit in FORM[last]:
                if "sua-"[kind] == unit:
                    go(i + 1, unit, cost + 5 * fault, letters + "K", inserts)
                if unit != "s":
                    go(i + 1, unit, cost + 1 + 5 * fault, letters + "R", inserts)
    go(0, "", 0, "", inserts)
    return best[0]


def test_edits_equal_exhaustive_search():
    rng = random.Random(1)
    for n in range(4):
        for codes in itertools.product(range(12), repeat=n) if n < 3 else [[rng.randrange(12) for _ in range(n)] for _ in range(300)]:
            assert cv._edits(bytes(codes), 0, 4) == exhaustive(codes)
    for _ in range(150):
        codes = [rng.choice([0, 3, 6, 3, 6, 9, 4, 7, 5]) for _ in range(rng.randrange(4, 8))]
        assert cv._edits(bytes(codes), 0, 4) == exhaustive(codes, 0)


@pytest.mark.parametrize("kinds", [[3, 6], [0, 3, 6, 9], list(range(12)), [0], [9, 5], [0, 2, 9]])
def test_parts_joined_up_equal_the_whole(kinds):
    rng = random.Random(len(kinds))
    for _ in range(60):
        codes = bytes(rng.choice(kinds) for _ in range(rng.randrange(2, 40)))
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randrange(1, 5))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        ways = cv.route([cv.condensed(p) for p in parts])
        got = [cv._edits(p, s, e) for p, (s, e) in zip(parts, ways)]
        assert (sum(c for c, _ in got), "".join(x for _, x in got)) == cv._edits(codes, 0, 4)


def test_a_long_conversation_keeps_few_edits_unresolved():
    rng = random.Random(5)
    run, most = cv.Survivors(cv.NOTHING), 0
    for i in range(20_000):
        run.take(rng.choice([3, 6] * 4 + [0, 4, 5, 8, 9]) if rng.random() < 0.3 else (3, 6)[i % 2])
        most = max(most, run.pending())
        nodes = set()
        for _, n in run.live.values():
            while n is not None:
                nodes.add(id(n))
                n = n.parent
        assert len(nodes) < 8
    assert most < 500 and len(run.done) > 19_000


def plain(rows, every):
    """``audits`` and the digest by a straightforward dynamic program over whole strings."""
    out = {}
    for conv in every:
        mine = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv),
                      key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).hexdigest()))
        seen, codes, faults = set(), [], {0: 0, 1: 0, 2: 0}
        for t, r, x in mine:
            bare = x.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (r, x) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                faults[fault] += 1
            codes.append((r[:1], fault))
        ways = {"": (0, "", ())}
        for i, (kind, fault) in enumerate(codes):
            new = {}

            def offer(state, way):
                if state not in new or way < new[state]:
                    new[state] = way
            for state, (cost, letters, kept) in ways.items():
                offer(state, (cost + 2, letters + "D", kept))
                if fault in (0, 1):
                    continue
                for unit in FORM[state]:
                    add = 5 if fault == 2 else 0
                    if unit == kind:
                        offer(unit, (cost + add, letters + "K", (*kept, mine[i][1:])))
                    elif unit != "s":
                        role = "user" if unit == "u" else "assistant"
                        offer(unit, (cost + add + 1, letters + "R", (*kept, (role, mine[i][2]))))
            ways = new
        cost, letters, kept = min(ways[s] for s in ("", "a") if s in ways)
        turns = {t for t, _, _ in mine if t is not None}
        kinds = [k for k, _ in codes]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        body = "\n".join(f"{r}:{x}" for r, x in kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults[0], faults[1], faults[2], illegal, cost,
                     letters, hashlib.sha256(body.encode()).hexdigest(), kept)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, c string, r long, x int, h string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "h") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rng.randrange(0, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn - 1, None, turn * 3]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Yes.", "No!", "cut", "", "  \n", None, "What?", "é ü.", f"text {turn}.", f"other {turn}!"])))
    rows += rows[:7] + [(7, 3, "user", "x" * 300_000 + ".")]
    rows += [(99, t, ("user", "assistant")[t % 2] if t % 17 else "system", f"row {t}" + "." * (t % 13 > 0)) for t in range(3000)]
    return rows


def test_audits_and_repairs_equal_the_plain_version(spark, talk):
    rows = table(spark, talk).repartition(7)
    found = cv.audits(rows).cache()
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    want = plain(talk, {r[0] for r in talk})
    assert got == {c: w[:7] for c, w in want.items()}
    assert {r[0]: r[1] for r in cv.repaired_digests(rows, found).collect()} == {c: w[7] for c, w in want.items()}
    texts = {}
    for r in sorted(cv.repaired(rows, found).collect(), key=lambda r: r.position):
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    assert texts == {c: list(w[8]) for c, w in want.items() if w[8]}
    parts = {r.c: r.n for r in cv._coded(cv._rows(rows, "conv_id", "turn", "role", "text")).repartitionByRange(8, *cv._order())
             .selectExpr("c", "spark_partition_id() as p").distinct().groupBy("c").count().withColumnRenamed("count", "n").collect()}
    assert parts[99] > 2  # the long one was joined up from parts
    found.unpersist()


def test_empty_table(spark):
    rows = table(spark, [])
    found = cv.audits(rows)
    assert found.collect() == []
    assert cv.repaired_digests(rows, found).collect() == cv.repaired(rows, found).collect() == []


def test_query_on_damaged_rows(spark, talk, tmp_path):
    table(spark, [r for r in talk if r[0] != 99 or r[1] < 200]).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = []
    for c, t, r, x in [r for r in talk if r[0] != 99 or r[1] < 200]:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        x = "" if way == 1 else x.translate(str.maketrans("", "", ".!?")) if way == 2 else x
        rows += [(c, t, "user" if way == 4 else r, x)] * (0 if way == 0 else 2 if way == 3 else 1)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: w[:8] for c, w in plain(rows, {r[0] for r in talk}).items()}
