"""SimHash against brute force over all pairs, on texts and on crowded fingerprints."""

import random
from collections import Counter

import pytest
import xxhash
from wardline.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component int, key string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Of a list of (id, fingerprint): smallest id reachable, by comparing all pairs."""
    kinds = sorted({f for _, f in fps})
    group = {f: f for f in kinds}
    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {k: new if g == old else g for k, g in group.items()}
    least = {}
    for i, f in fps:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return {f: least.get(group[f]) for f in kinds}


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_texts(spark):
    rng = random.Random(4)
    base = [f"Word{rng.randrange(900)}" for _ in range(300)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", "a b c", "é ü\tx y", " ".join(base), " ".join(base).upper(), "x" * 200_000]
    texts += [" ".join(w if rng.random() > 0.01 else "changed" for w in base) for _ in range(40)]
    texts += [" ".join(rng.choice(base) for _ in range(60)) for _ in range(40)]
    rows = [(i if i != 12 else None, t, "f", 1, "k") for i, t in enumerate(texts)] + [(3, "other words here now", "f", 1, "k")] * 2
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    least = plain_components(fps)
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", least[f]) for i, f in fps)
    assert len(set(least.values())) < len(least)  # some texts that differ are linked


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("kind", ["spread", "crowded", "one half", "chains"])
def test_links_connect_all_near_fingerprints(spark, kind, monkeypatch):
    rng = random.Random(kind)
    if kind == "spread":
        centres = [rng.getrandbits(64) for _ in range(60)]
        fps = {near(rng, rng.choice(centres), rng.randrange(5)) for _ in range(200)}
    elif kind == "crowded":  # one key with far more than a group's fingerprints, through several cuts
        monkeypatch.setattr(simhash, "GROUP", 8)
        centre = rng.getrandbits(64)
        fps = {near(rng, centre, rng.randrange(7)) for _ in range(150)}
    elif kind == "one half":
        monkeypatch.setattr(simhash, "GROUP", 16)
        fps = {(0xABCDEF01 << 32) | rng.getrandbits(32) & 0xFF0F for _ in range(200)}
    else:
        fps, at = set(), rng.getrandbits(64)
        for _ in range(60):
            at = near(rng, at, 3)
            fps.add(at)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(frame).collect()]
    group = {signed(f): signed(f) for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
        group[root(a)] = root(b)
    want = plain_components([(f, f) for f in fps])
    parts, ours = {}, {}
    for f in fps:
        parts.setdefault(want[f], set()).add(f)
        ours.setdefault(root(signed(f)), set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, ours.values()))


def test_each_near_pair_shares_a_key(spark):
    rng = random.Random(2)
    pairs = [(f, near(rng, f, rng.randrange(4))) for f in (rng.getrandbits(64) for _ in range(100))]
    rows = spark.createDataFrame([(0, signed(f), 0, 64) for p in pairs for f in p], "key long, fp long, shift int, bits int")
    keys = {}
    for r in simhash.variants(rows).collect():
        keys.setdefault(r.fp, set()).add(r.key)
    assert all(keys[signed(a)] & keys[signed(b)] for a, b in pairs)
    assert {len(v) for v in keys.values()} == {64}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
