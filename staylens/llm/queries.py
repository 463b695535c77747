"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from staylens.llm import binpack, byte_bpe, fertility, fm_index, importance, line_dedup, pii_lstm, prefix_trie, simhash, substring_dedup, suffix_dedup, url_markov, warc
from staylens.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    done = suffix_dedup.removal(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    ids = byte_bpe.encode(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")
    done = byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_simhash")
def op3(spark, sf_dir):
    done = simhash.classes(documents(spark, sf_dir))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op7_fm_index")
def op7(spark, sf_dir):
    found = fm_index.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_count_min")
def op5(spark, sf_dir):
    done = substring_dedup.removal(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op2_fertility")
def op2(spark, sf_dir):
    found = fertility.verdicts(documents(spark, sf_dir, "doc_id", "text", "lang"), PIECES, RANKS, public_tokenizers.PATTERN)
    return found.select("doc_id", *fertility.COUNTS, "base_failed", "kept", *fertility.MEASURES)


@query("op10_binpack")
def op10(spark, sf_dir):
    done = binpack.shards(documents(spark, sf_dir), bins=16)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_line_dedup")
def op8(spark, sf_dir):
    done = line_dedup.removal(documents(spark, sf_dir), min_words=1, fuzzy_words=2)
    return done.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


URL_RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]


@query("op1_url_markov")
def op1(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_markov.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op9_pii_lstm")
def op9(spark, sf_dir):
    done = pii_lstm.found(documents(spark, sf_dir)).select("doc_id", "base", "spans")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return done.select("doc_id", *map(count, pii_lstm.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


# CRC-32 in SQL: features of one length side by side, one step a byte
ORACLE_11 = r"""
WITH RECURSIVE texts AS (SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
spelled AS (SELECT target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
placed AS (SELECT target, id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM spelled),
features AS (SELECT target, id, unnest(f) AS f FROM placed),
lookup AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(256))::BIGINT AS b)),
named AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
steps AS (
  SELECT f, h, 4294967295::BIGINT AS crc FROM named
  UNION ALL
  SELECT f, h[3:], xor(t[xor(crc & 255, ('0x' || h[1:2])::BIGINT) + 1], crc >> 8) FROM steps, lookup WHERE h <> ''),
bucketed AS (SELECT f, xor(crc, 4294967295) % 10000 AS bucket FROM steps WHERE h = ''),
counts AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM features JOIN bucketed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM features JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE target = 0 GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n, 0) AS n_features, n_words, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM placed LEFT JOIN weights USING (id) WHERE target = 0),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * fit // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""


@query("op11_importance", ORACLE_11)
def op11(spark, sf_dir):
    drawn = importance.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_12 = r"""
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(range(8 * length(conv_id::VARCHAR)), lambda i: (ascii((conv_id::VARCHAR)[i // 8 + 1]) >> (i % 8)) & 1),
    lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295) % 4 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
beginnings AS (SELECT conv_id, d, turns[1:d] AS node, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN len(regexp_extract_all(node[d].t, '[^ 	-
]+')) ELSE 0 END AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM beginnings GROUP BY node, d),
linked AS (SELECT n.*, p.conv_id AS parent, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.node[1:n.d] = n.node) AS children FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]),
above AS (SELECT l.d AS below, l.children, l.n_convs, l.words, unnest(range(l.d + 1)) AS d, l.node FROM linked l),
sums AS (SELECT node[1:d] AS node, d, count(*) FILTER (children = 0) AS leaves, sum((n_convs - 1) * words) AS saved FROM above GROUP BY 1, 2)
SELECT l.conv_id, l.d::BIGINT AS depth, l.parent AS parent_conv_id, l.n_convs, l.children AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN sums s ON s.d = l.d AND s.node = l.node
"""


@query("op12_prefix_trie", ORACLE_12)
def op12(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie.nodes(prefix_trie.branched(materialise(prefix_trie.sequences(rows))))


ORACLE_13 = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
last AS (SELECT payload, max(page_id) AS last FROM sized WHERE n >= 1000 GROUP BY payload)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM sized LEFT JOIN last USING (payload)
"""


@query("op13_warc", ORACLE_13)
def op13(spark, sf_dir):
    folder = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    found = warc.read(spark, folder, payloads=False).where("reason is null")
    return found.select(warc.number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.number(F.col("refers_to")).alias("refers_to"))
