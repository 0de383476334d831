"""Rows that share an id, benchmarks of several scans, relative links, packed digests."""

import zlib

import pytest
from urllib.parse import urldefrag, urljoin

from wardline.llm import decontaminate, line_dedup, minhash, packing, url_filter
from wardline.llm.queries import tokenizer
from pyspark.sql import functions as F


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    a = " ".join(f"word{i}" for i in range(40))
    b = " ".join(f"other{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, a), (3, None)], "doc_id long, text string")
    assert sorted(map(str, minhash.keep_one(docs).collect())) == sorted(map(str, docs.filter((F.col("doc_id").isNull())
                  | (F.col("doc_id") != 2) | (F.col("text") == b)).collect()))


@pytest.mark.parametrize("scans", ["one", "several"])
def test_benchmark_of_any_size_judges_rows_alike(spark, monkeypatch, scans):
    items = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(12)]
    if scans == "several":
        monkeypatch.setattr(decontaminate, "BLOCK", 2)
        monkeypatch.setattr(decontaminate, "SPACES_PER_SCAN", 2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, f"{items[2]} and {items[10]}"), (1, items[3]), (None, items[4]), (None, items[5]), (7, "clean text of no item")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((str(r.doc_id), r.n_items, r["items"]) for r in got) == [
        ("1", 1, "3"), ("1", 2, "2,10"), ("None", 1, "4"), ("None", 1, "5")]


def test_relative_links_resolve_as_in_a_browser(spark):
    base = "http://Ex.net/es/a/page.html?q=1#f"
    targets = ["/en/y", "//bad.net/es/1", "x.html", "../up.html", "./a/./b?z=1", "?only=query", "http://full.org/x", "sub/..", "../../../over",
               "a/../b/", "/login?next=http://other.org/"]
    rows = spark.createDataFrame([(t,) for t in targets], "t string").select("t", url_filter.resolved(F.col("t"), F.lit(base)).alias("u"))
    assert {r.t: r.u for r in rows.collect()} == {t: urljoin(urldefrag(base)[0], t) for t in targets}
    odd = spark.createDataFrame([("mailto:a@b.c",), ("javascript:x",), ("#top",), ("",)], "t string")
    assert odd.filter(url_filter.resolved(F.col("t"), F.lit(base)).isNotNull()).count() == 0
    assert odd.filter(url_filter.resolved(F.lit("x.html"), F.lit("no scheme")).isNotNull()).count() == 0


def test_relative_aliases_share_a_block(spark):
    pages = spark.createDataFrame([
        (1, "http://a.net/x/1", '<link rel="canonical" href="/es/1">'), (2, "http://b.org/2", '<link rel=canonical href="//bad.net/es/2">'),
        (3, "http://c.org/q/3", '<base href="http://z.net/es/"><meta http-equiv="refresh" content="0; url=3.html">'),
        (4, "http://d.org/4", None), (5, None, '<link rel="canonical" href="/es/1">')], "page_id long, url string, html string")
    rules = spark.createDataFrame([("net", "/es/", "block")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_digest_of_packed_ids(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, "more " * 3000)], "doc_id long, text string")
    path = tokenizer("byte_bpe_50k.json")
    ids = {(r.doc_id, r.start): r for r in packing.pack(docs.coalesce(1), path).collect()}
    for r in packing.pack(docs.coalesce(1), path, digest=True).collect():
        full = ids[r.doc_id, r.start]
        assert zlib.crc32(full.ids) == r.ids_crc32 and full.length == r.length and full.offset == r.offset


def test_line_dedup_counts_lines_and_code_points(spark):
    line = "é" * 20
    rows = [(i, f"{line}\n\n x{i}") for i in range(4)] + [(9, "é" * 19), (10, "é" * 19), (11, "é" * 19), (12, None), (13, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in df.select(line_dedup.count_lines(F.col("text"))).collect()] == [3] * 4 + [1] * 5
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got[3] == (rows[3][1], 0) and got[0] == ("\n x0", 1) and got[9] == ("é" * 19, 0) and got[12] == (None, 0)
