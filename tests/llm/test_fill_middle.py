"""Fill-in-the-middle against a plain version over whole texts."""

import hashlib
import random
import re

from wardline.llm import fill_middle as fm

SCHEMA = "doc_id long, text string, frames string, n int, form string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def made():
    rng = random.Random(8)
    words = ["a", "é", "words", "<", "<S", "P>", "日本語", "<M", "x" * 70, "\U0001f600", "tail>", " ", "\x00"]
    gaps = [" ", "\n", "\t ", "  ", "\x0b\x0c\r", " "]
    texts = [None, "", " ", "\n\n", "one", " one", "one ", "has <P> in it", "<M>", "x" * 100_000, "é" * 50_001 + " ", " " * 70_000]
    texts += ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(9_000)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here at all"), (5, "again"), (5, "again")]
    return rows


def test_outputs_and_digests(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame([(*r, "f", 1, "x") for r in rows], SCHEMA).repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted((plain(*r) for r in rows), key=order)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    for size in (7, 64, 1 << 15):
        path = f"{tmp_path}/{size}"
        fm.store_frames(docs, frame_bytes=size).write.option("compression", "uncompressed").parquet(path)
        store = spark.read.parquet(path)
        got = sorted(map(tuple, fm.fill_in_middle(store).collect()), key=order)
        assert got == want
        texts = {}
        for doc_id, t in rows:
            texts.setdefault(doc_id, set()).add(t or "")
        assert all(fm.restored(w[5], w[2]) in texts[w[0]] for w in want)
        digests = sorted(map(tuple, fm.output_digests(store).collect()), key=order)
        assert digests == sorted(((*w[:5], sha(w[5]), sha(fm.restored(w[5], w[2]))) for w in want), key=order)


def test_cut_reads_one_frame(monkeypatch):
    text = "".join(f"word{i} " for i in range(50_000)).encode()
    frames, sizes, units, chars = fm.cut_text(text, 1 << 12)
    seen = []
    monkeypatch.setattr(fm.Frames, "read", lambda self, i: seen.append(i) or fm._decompressor().decompress(self.frames[i]))
    whole = fm.Frames(frames, sizes)
    for k in (1, 17, 30_000, 50_000):
        seen.clear()
        at, n = whole.cut(units, chars, k)
        assert at == n == len("".join(f"word{i} " for i in range(k))) - 1
        assert len(seen) == 1
    assert units[-1] == 50_001 and len(frames) > 50


def test_empty(spark):
    store = fm.store_frames(spark.createDataFrame([], SCHEMA))
    assert fm.fill_in_middle(store).collect() == fm.output_digests(store).collect() == []
