"""Decontamination of texts side by side, packing without ids on the way, passages with short keys and packed texts."""

import random
import zlib

import corpus_pipeline
from wardline.llm import chunk_dedup, decontaminate, packing
from wardline.llm.queries import tokenizer
from pyspark.sql import functions as F


def spaces_of(spark, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    blocks = list(decontaminate.benchmark_blocks(bench, "item_id", "text"))
    return [decontaminate.latent_space(spark, b, {}, 1) for b in blocks]


def test_texts_side_by_side_are_judged_each_by_itself(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(120)}"
    items = [" ".join(word() for _ in range(n)) for n in (5, 14, 30, 47, 48, 49, 90)]
    words = [decontaminate.words_of(t) for t in items]
    scan = decontaminate.Scan(spaces_of(spark, items))
    noise = lambda n: [word().encode() for _ in range(n)]
    texts = [[], noise(1), noise(31), noise(32), noise(33), noise(700), words[0], [], words[6], noise(40) + words[4] + noise(9),
             # An item that ends one text and goes on in the next is in neither; copies at step and block edges are found.
             noise(64) + words[4][:12], words[4][12:24] + noise(50), noise(decontaminate.STEP * decontaminate.WINDOWS - 20) + words[3] + noise(70)]
    texts += [noise(rng.randrange(300)) + words[rng.randrange(7)] for _ in range(30)]
    asked = []
    plain = decontaminate.found_in

    def found_in(passage, kinds, region, there, after):
        asked.append(len(passage.words) < decontaminate.SHORT
                     or len(passage.words) - len(kinds - there) >= decontaminate.PARAPHRASED * len(passage.words))
        return plain(passage, kinds, region, there, after)
    monkeypatch.setattr(decontaminate, "found_in", found_in)
    got = decontaminate.items_in(texts, scan, decontaminate.COSINE)
    assert asked and all(asked)
    assert got == [decontaminate.items_in([t], scan, decontaminate.COSINE)[0] for t in texts]
    # The same with every window and passage looked at by itself.
    for text, hits in zip(texts, got):
        want = {}
        for start in range(0, len(text), decontaminate.STEP):
            end = start + 2 * decontaminate.STEP + decontaminate.MARGIN
            region = text[max(0, start - decontaminate.MARGIN):end]
            for s, space in enumerate(scan.spaces):
                known = [space.words[w] for w in text[start:start + 2 * decontaminate.STEP] if w in space.words]
                sums = space.project[known].sum(axis=0)
                for j, p in enumerate(space.passages):
                    if known and sums @ space.targets[j] >= decontaminate.COSINE * (sums @ sums) ** 0.5:
                        share = plain(p, scan.kinds[s][j], region, set(region), text[end:end + p.rest])
                        if share:
                            want[p.item] = max(share, want.get(p.item, 0.0))
        assert all(hits.get(i, 0) >= v for i, v in want.items())
    assert "6" in got[8] and "4" in got[9] and "3" in got[12] and "4" not in got[10] and "4" not in got[11]


def test_the_pipeline_packs_without_sending_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, "more " * 3000)], "doc_id long, text string").coalesce(1)
    asked, plain = [], packing.pack

    def pack(*args, **options):
        asked.append(options.get("digest"))
        return plain(*args, **options)
    monkeypatch.setattr(packing, "pack", pack)
    got = corpus_pipeline.packed(spark, docs, "")
    assert asked == [True]
    full = {(r.doc_id, r.start): r for r in plain(docs, tokenizer("byte_bpe_50k.json")).collect()}
    rows = got.collect()
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"] and len(rows) == len(full)
    assert all(zlib.crc32(full[r.doc_id, r.start].ids) == r.ids_crc32 for r in rows)


def test_short_keys_and_packed_texts_give_the_same_passages(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    shared = [some(60) for _ in range(4)]
    rows = [(i, f"{some(80)} {shared[i % 4]} {some(rng.randrange(200))}") for i in range(20)]
    rows += [(3, shared[0]), (3, some(90)), (None, shared[1]), (40, None), (41, ""), (42, f"é{some(50)}\u2003 {shared[2]}"), (43, some(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    full = sorted(map(str, chunk_dedup.passages(docs).collect()))
    # Keys of two bits fall together for different windows; what they let through is still compared by the whole digest.
    monkeypatch.setattr(chunk_dedup, "KEY_BITS", 2)
    assert len(full) >= 20 and sorted(map(str, chunk_dedup.passages(docs).collect())) == full
    monkeypatch.undo()
    slim = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("body"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [r.key for r in chunk_dedup.cells_of(slim, 120, places=False).collect()]
    assert keys and 0 <= min(keys) and max(keys).bit_length() <= 40 < 2 + max(keys).bit_length()
    packed = chunk_dedup.packed_texts(slim).collect()
    assert sum(len(r.packed) for r in packed) < 0.6 * sum(len((t or "").encode()) for i, t in rows if i is not None)
