"""Operators on small tables against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from wardline.llm import (
    chunk_dedup,
    decontaminate,
    language_id,
    line_dedup,
    minhash,
    packing,
    personal_data,
    repetition,
    token_store,
    url_filter,
)
from wardline.llm.components import components
from wardline.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, n_dropped int"


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds):03d}x" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    edited = [" ".join(w if rng.random() > 0.02 else "zz" for w in base.split()) for _ in range(6)]
    line = "This line stands in many of the documents."
    out = [None, "", "   \n\t ", "one", base, base, *edited, words(rng, 4000), "x" * 50_000]
    out += [f"{words(rng, 60)}\n  {line.upper()}  \n{words(rng, 30)}" for _ in range(4)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "q", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty, texts):
    got = {r["doc_id"]: r for r in repetition.quality(docs).collect()}
    for i, t in texts:
        w = (t or "").encode().split()
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 500 else None
        assert got[i]["n_words"] == len(w)
        assert inside is None or got[i]["n_repeat_words"] == len(inside)
    assert not got[0]["kept"] and got[4]["kept"]
    assert repetition.keep_documents(docs).columns == docs.columns
    assert repetition.quality(empty).count() == 0


def test_line_dedup(docs, empty, texts):
    out = line_dedup.dedup_lines(docs)
    assert out.columns[-1] == "n_dropped_"
    got = {r["doc_id"]: r for r in out.collect()}
    last = texts[-1][0]
    assert [got[i]["n_dropped_"] for i in range(last - 3, last + 1)] == [1, 1, 1, 0]
    assert got[last]["text"] == texts[-1][1] and got[0]["text"] is None
    assert got[last - 1]["text"].count("\n") == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_near_duplicates(docs, empty, texts):
    got = {r[0]: r for r in minhash.near_duplicates(docs, size=4).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    sets = {i: shingles(t) for i, t in texts}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets} == {i: tuple(r)[1:] for i, r in got.items()}
    assert minhash.near_duplicates(empty).count() == 0


def test_block_links():
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    assert minhash.block_links(np.array([1, 2, 3]), np.array([1, 2, 3]), sets, 80) in ([(1, 2)], [(2, 1)])
    assert minhash.block_links(np.array([1, 2, 3]), np.array([1, 1, 3]), sets, 80) == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(40, 50), (50, 60), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40}
    named = dict(components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect())
    assert named == {"a": "a", "b": "a", "c": "a"}


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in mine) == np.array(ids, "<u4").tobytes()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in held.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_best_fill():
    assert packing.best_fill({1500: 2, 500: 1, 48: 1, 600: 3}, 2048) == {1500: 1, 500: 1, 48: 1}
    assert packing.best_fill({1500: 3}, 2048) == {1500: 1}


def test_ids_of_pieces_equal_those_of_whole_texts():
    import pyarrow as pa
    from wardline.llm.tokens import Encoder
    texts = ["", "a.", "a. b,", "don't. It's, we'll; x.. y., z! ", "\u00e9. \u00c9\u0301, \u00e9. o", "<|endoftext|>",
             "a<|endoftext|>b. c <|x", "\u0130. \u03a3. \u03c2,  \u01c5; q", "a\u0338. b", " . , ", "x\n\ny.\nz. \n",
             "a\u3000b. c", "\u00aba\u00bb. 1. 2, b3. ", "same. same. same, same", None]
    for name, keep in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        enc = Encoder(tokenizer(name), keep, limit=8)
        flat, counts = enc.encode(pa.array(texts))
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]


def test_token_store(spark, docs, empty, texts, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    path = token_store.write_store(docs, str(tmp_path / "a"), tokenizer("word_bpe_49k.json"), block_tokens=1000)
    got = {r["doc_id"]: r for r in token_store.read_store(spark, path).collect()}
    start = 0
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], zlib.crc32(bytes(got[i]["ids"]))) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.read_store(spark, token_store.write_store(empty, str(tmp_path / "b"), tokenizer("word_bpe_49k.json"))).count() == 0


def test_codes_random_access():
    ids = np.random.default_rng(1).choice([3, 200, 256, 65_535, 70_000, 2**31], 5000).astype(np.uint32)
    codes = token_store.Codes(token_store.encode_codes(ids))
    assert (codes.all() == ids).all() and [codes[i] for i in range(0, 5000, 7)] == ids[::7].tolist()
    assert len(token_store.Codes(token_store.encode_codes(ids[:0]))) == 0


def test_passages(spark, empty):
    rng = random.Random(5)
    passage = words(rng, 70, 9000)
    rows = [(i, f"{words(rng, 80, 9000)} {passage} {words(rng, 80, 9000)}") for i in range(3)]
    rows += [(i, words(rng, 200, 9000)) for i in range(3, 9)] + [(9, None), (None, passage)]
    got = {r["doc_id"]: r for r in chunk_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 2} and got[0]["n_removed_chars"] == 0 and got[2]["n_removed_chars"] > 200
    assert chunk_dedup.passages(empty).count() == 0


def test_passages_have_one_partner(spark):
    rng = random.Random(15)
    phrases = [" ".join(f"{rng.randrange(10**6):06d}" for _ in range(9)) + " " for _ in range(12)]
    long = [words(rng, 60, 9000) for _ in range(3)]
    rows = [(i, f"{words(rng, 40, 9000)} {p}{words(rng, 40, 9000)}") for i, p in enumerate(phrases)]
    rows += [(50, "".join(phrases))]
    # 60 to 64: a chain in which each has parts of the smaller ones, with edits
    rows += [(60, f"{words(rng, 50, 9000)} {long[0]} {words(rng, 9, 9000)}"), (61, f"{long[1]} {long[0]} {long[2]}"),
             (62, f"{long[0]} zz {long[1]}"), (63, f"{long[0]} zz {long[1]} {long[2]}"), (64, f"{long[1]} {long[0]} {long[2]}")]
    texts = dict(rows)
    got = {r["doc_id"]: r for r in chunk_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {60, 61, 62, 63, 64} and got[60]["n_removed_chars"] == 0
    kept = {i: got[i]["kept_text"] if i in got else t for i, t in texts.items()}
    for i, r in got.items():
        for a, b in (map(int, s.split(":")) for s in r["spans"].split(",")):
            parts = [texts[i][k:k + 120] for k in range(a, b - 119)]
            assert parts and any(parts[0] in t for j, t in texts.items() if j != i)
    # Every stretch of fifty words that several documents have is left whole in one of them.
    for x in long:
        w = x.split()
        assert any(" ".join(w[5:55]) in t for t in kept.values())


def test_windows_stand_whole_with_their_keepers():
    rng = random.Random(16)
    for _ in range(30):
        parts = [words(rng, rng.randrange(5, 60), 9000).encode() for _ in range(6)]
        texts = [b" ".join(rng.choice(parts) for _ in range(5)) for _ in range(6)]
        cells = [[*zip(*(x.tolist() for x in chunk_dedup.windows(t, 120)))] for t in texts]
        holders = {}
        for i, (t, c) in enumerate(zip(texts, cells)):
            for a, b in c:
                holders.setdefault(t[a:b], []).append(i)
        marks = [[(a, b, holders[t[a:b]][0]) for a, b in c if len(set(holders[t[a:b]])) > 1] for t, c in zip(texts, cells)]
        gone = [chunk_dedup.without(chunk_dedup.runs([m[:2] for m in x if m[2] != i]),
                                    chunk_dedup.runs([m[:2] for m in x if m[2] == i]), 120) for i, x in enumerate(marks)]
        for t, x in zip(texts, marks):
            for a, b, k in x:
                at = next(m for m in marks[k] if texts[k][m[0]:m[1]] == t[a:b])
                assert not any(p < at[1] and q > at[0] for p, q in gone[k])


def test_passages_without_white_space(spark):
    rng = random.Random(17)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    shared = han(400)
    rows = [(i, han(rng.randrange(50, 900)) + shared + han(rng.randrange(50, 900))) for i in range(4)] + [(4, han(900)), (5, "a" * 5000), (6, "b" * 7000)]
    got = {r["doc_id"]: r for r in chunk_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 3} and got[0]["n_removed_chars"] == 0
    texts = dict(rows)
    for r in got.values():
        a, b = map(int, r["spans"].split(":"))
        assert texts[r["doc_id"]][a:b] in shared and b - a > 340


def test_passages_against_all_windows(spark):
    """Marks, keepers and kept texts agree with a plain dictionary of every window's bytes."""
    rng = random.Random(18)
    parts = [words(rng, rng.randrange(12, 80), 9000) for _ in range(12)]
    rows = [(i % 37, "\t ".join(rng.choice(parts) if rng.random() < 0.4 else words(rng, rng.randrange(5, 60), 9000) for _ in range(6)))
            for i in range(40)]
    texts = [t.replace("\t", " ").encode() for _, t in rows]
    cells = [[*zip(*(x.tolist() for x in chunk_dedup.windows(t, 120)))] for t in texts]
    holders = {}
    for (i, _), t, c in zip(rows, texts, cells):
        for a, b in c:
            holders.setdefault(t[a:b], set()).add(i)
    want = []
    for (i, _), t, c in zip(rows, texts, cells):
        marked = sorted((a, b) for a, b in c if len(holders[t[a:b]]) > 1)
        if marked:
            lost, own = set(), set()
            for a, b in marked:
                (own if min(holders[t[a:b]]) == i else lost).update(range(a, b))
            spans = ",".join(f"{a}:{b}" for a, b in chunk_dedup.runs(marked))
            keepers = sorted({min(holders[t[a:b]]) for a, b in marked})
            want.append((i, spans, keepers, len(lost - own)))
    got = chunk_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["spans"], r["keepers"]) for r in got) == sorted(w[:3] for w in want) and len(want) > 20
    # what is lost goes in stretches of 120 bytes or more
    most = {}
    for i, _, _, n in want:
        most[i] = max(n, most.get(i, 0))
    assert all(r["n_removed_chars"] <= most[r["doc_id"]] for r in got)


def test_url_filter(spark):
    page = '<html><link rel="canonical" href="{}"><p>x</p>'
    pages = [(1, "http://bad.example.com/en/1", None), (2, "http://alias.test/1", page.format("http://bad.example.com/en/1")),
             (3, "http://other.test/", ""), (4, None, None), (5, "no host", page.format("http://bad.example.com/en/1")),
             (6, "https://www.example.com/en/9", page.format("http://bad.example.com/en/1")),
             (7, "http://far.test/2", '<meta http-equiv="refresh" content="0; url=http://alias.test/1">')]
    rules = spark.createDataFrame([("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")], "host string, path string, verdict string")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block"}
    assert url_filter.judge(frame, rules.filter("false")).filter("verdict = 'block'").count() == 0
    assert url_filter.judge(frame.filter("false"), rules).count() == 0


def test_personal_data(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 9)} a{i}@mail.example.com {words(rng, 5)} +1 (743) 555-{3000 + i} {words(rng, 4)} {i}.7 and 12 of them")
            for i in range(60)]
    rows += [(98, "mail b@c.example.com. See 555-3007 or +1 (743) 555-3007, 555-3007"), (99, None)]
    got = {r["doc_id"]: r for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_email"] == got[0]["n_phone"] == 1 and got[99]["spans"] == ""
    assert set(filter(None, got[98]["base"].split(","))) <= set(got[98]["spans"].split(","))
    assert all(got[i]["spans"] == got[i]["base"] for i in range(60))
    assert personal_data.personal_data(empty).count() == 0
    assert "[email]" in personal_data.redacted(spark.createDataFrame(rows, "doc_id long, text string")).first()["text"]


def test_labels_reach_all_repeats():
    text = "call (743) 555-3007, " + "or 555-3007 again " * 50
    n = personal_data.LABELS
    field = personal_data.Field(np.zeros((personal_data.FEATURES + 1, n)), np.array([np.zeros((n, n)), 8 * np.eye(n)]))
    field.nodes[zlib.crc32(b"b(93,)|93,-94,") % personal_data.FEATURES, 4] = 40
    got = personal_data.added_spans(text, field, [])
    assert {(k, text[a:b]) for k, a, b in got if "555" in text[a:b]} == {(3, "555-3007")} and len(got) >= 51
    # Recognised by a pattern, repeated bare.
    text = "call +1 (743) 555-3007 now " + "or 555-3007 again " * 50
    field.nodes[:] = 0
    got = personal_data.added_spans(text, field, personal_data.base_spans(text))
    assert len(got) == 50 and {k for k, _, _ in got} == {3}


def test_decontamination(spark, empty):
    rng = random.Random(4)
    item = words(rng, 30, 3000)
    bench = spark.createDataFrame([(1, item), (2, words(rng, 100, 3000)), (3, None), (4, "")], "item_id long, text string")
    changed = " ".join("zz" if k in (4, 11, 17) else w for k, w in enumerate(item.split()))
    rows = [(0, words(rng, 300, 3000)), (1, f"{words(rng, 90)} {item.upper()}, {words(rng, 90)}"), (2, f"{words(rng, 40)} {changed}"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS leak")
    assert {(r["doc_id"], r["items"]) for r in decontaminate.contaminated(frame, bench).collect()} == {(1, "1"), (2, "1")}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench).collect()) == [0, 3]
    assert decontaminate.contaminated(frame, bench.filter("false")).count() == 0
    assert decontaminate.contaminated(frame.filter("false"), bench).count() == 0


def test_decontamination_excerpts(spark):
    rng = random.Random(14)
    items = {i: words(rng, n, 3000).split() for i, n in enumerate((96, 58, 48, 200))}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    cuts = [(0, 30, 70), (1, 10, 48), (2, 0, 37), (3, 91, 109), (0, 17, 30), (1, 20, 32)]
    rows = [(k, f"{words(rng, 500, 3000)} {' '.join(items[i][a:b])} {words(rng, 150, 3000)}") for k, (i, a, b) in enumerate(cuts)]
    # 6: across the end of a block of windows; 7: the paraphrase of the second half, with the item's end; 8: the first one without.
    rows.append((6, f"{words(rng, 32 * 256 - 9, 3000)} {' '.join(items[3][50:70])}"))
    changed = [w if k % 3 else "zz" for k, w in enumerate(items[2])]
    rows += [(7, " ".join([*changed[:-12], *items[2][-12:-1]])), (8, " ".join(changed[:-12]))]
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {0: "0", 1: "1", 2: "2", 3: "3", 4: "0", 6: "3", 7: "2"}


def test_longest_common():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.longest_common(a, b) == table[-1][-1]


def test_language(spark, empty):
    rng = random.Random(8)
    parts = {"aa": ["ka", "tu", "mo", "re"], "bb": ["sch", "ung", "ein", "zu"], "cc": ["eau", "tion", "oui", "ch"]}
    rows = [(i, " ".join(rng.choice(p) + rng.choice(p) for _ in range(40)), k) for i in range(90) for k, p in [list(parts.items())[i % 3]]]
    frame = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 ..", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and got[500]["lang_pred"] == got[501]["lang_pred"] == "und"
    assert got[3]["held_out"] == (zlib.crc32(b"3") % 5 == 0)
    assert language_id.identify(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "start", "sequence_id"} <= set(out.columns)
    assert len(hashlib.sha256(b"").hexdigest()) == 64
