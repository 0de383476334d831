"""Queries of the operators over the supplied tables, with SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    chunk_dedup,
    conversations,
    decontaminate,
    fill_middle,
    language_id,
    line_dedup,
    minhash,
    packing,
    personal_data,
    repetition,
    simhash,
    token_store,
    url_filter,
)
from wardline.llm.frames import read
from wardline.session import cut_lineage, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digest=True)


@query
def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.passages(read(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(read(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs.withColumn("n_lines", line_dedup.count_lines(F.col("text"))))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# The rules of the url filter.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules).drop("component")


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(read(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=4)


@query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(read(spark, sf_dir, "documents"), scratch(spark, "tokens"), tokenizer("word_bpe_49k.json"))
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "frames")
    fill_middle.store_frames(read(spark, sf_dir, "documents")).write.option("compression", "uncompressed").parquet(path)
    return fill_middle.output_digests(spark.read.schema(fill_middle.STORE).parquet(path))


def damaged(talk: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults put in by the CRC of their key."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(way == 1, "").when(way == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(way == 4, "user").otherwise(shown("role"))
    copies = F.explode(F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return talk.filter(way != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations")
    rows = damaged(talk)
    found = cut_lineage(conversations.audits(rows))
    digests = conversations.repaired_digests(rows, found)
    every, both = talk.select("conv_id").distinct(), found.join(digests.withColumnRenamed("conv_id", "conv"),
                                                                F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    out = every.join(both.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
            "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.fillna(none)


ORACLES["op4_line_dedup"] = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rows AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keys AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM rows),
common AS (SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT r.doc_id, r.pos, r.line, c.k IS NOT NULL AND r.doc_id <> c.keeper AS gone
           FROM keys r LEFT JOIN common c ON r.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, coalesce(sum(gone::INT), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLES["op7_minhash"] = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
cells AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM cells a JOIN cells b ON a.x = b.x AND a.doc_id <> b.doc_id
           GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)"""

# The supplied pages have no canonical links or redirects; components are tested on small tables instead.
ORACLES["op5_url_filter"] = """
WITH RECURSIVE u AS (
    SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
p AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
         FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
             ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
             array_to_string(u[b + 1:n], '') AS suf,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                  THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""
