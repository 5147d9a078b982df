"""The operators' queries over the intended tables, with their oracles where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, host_rules, langid, mixing, passages, pieces, simhash, tokens, toxicity, warc
from .common import read


def fold_of(key: str, folds: int):
    """crc32 of the key as text, modulo folds."""
    return F.crc32(F.col(key).cast("string")) % folds


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, from labels outside the held-out third."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold_of("doc_id", 3) != 1)
    out = toxicity.score(docs, toxicity.learn(docs, labels))
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"), F.size("passages").alias("n_passages"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all others."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 20 = 0"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and host verdicts for every document."""
    out = host_rules.judge(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes: sources weigh 1, 2, 3 in turn and share all words; at most 3 copies."""
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: each document's place, length and checksum."""
    import public_tokenizers

    folder = tokens.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    out = tokens.read_tokens(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", tokens.digest)
    return out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back."""
    return warc.pages_of(warc.read_warc(spark, warc.write_warc(read(spark, sf_dir, "pages"))))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from those outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs.select("doc_id", "text"), langid.learn(docs.where(fold_of("doc_id", 5) != 0)))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document: how many, their checksum, and whether decoding gives the text back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    same = pieces.decoded(F.col("pieces"), model).eqNullSafe(F.col("text"))
    return coded.select("doc_id", (F.octet_length("pieces") / 2).cast("long").alias("n_pieces"), F.crc32("pieces").alias("pieces_crc32"), same.alias("lossless"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words and more that an earlier document holds."""
    out = passages.repeated_passages(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("first_key").alias("first_doc_id"), F.col("first_start").alias("first_start_word"), F.col("first_end").alias("first_end_word"), F.col("matched").alias("matched_words"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_ann": op2_ann, "op3_host_rules": op3_host_rules, "op4_mix_sources": op4_mix_sources, "op5_pieces": op5_pieces, "op6_token_files": op6_token_files, "op7_simhash": op7_simhash, "op8_warc": op8_warc, "op9_langid": op9_langid, "op10_passages": op10_passages}

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, max(page_id) OVER (PARTITION BY sha256(payload)) AS top, sha1(payload) AS hexed FROM p),
a AS (SELECT *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters,
  list_transform(range(0, 20), lambda i: CAST('0x' || substr(hexed, CAST(2 * i + 1 AS INT), 2) AS INT)) AS b FROM d),
g AS (SELECT *, list_transform(range(0, 4), lambda q: b[5*q+1]::BIGINT * 4294967296 + b[5*q+2]::BIGINT * 16777216 + b[5*q+3]::BIGINT * 65536 + b[5*q+4]::BIGINT * 256 + b[5*q+5]::BIGINT) AS q5 FROM a)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr(letters, CAST((q5[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(5) q(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS k FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT *, least(greatest(f / n, 1e-6), 1 - 1e-6) AS m FROM (SELECT CAST(count(*) AS DOUBLE) AS c, sum(n) AS n, sum(k) AS f, sum(k * k / n) AS sq, sum(n * n) AS sp FROM h)),
e AS (SELECT *, CASE WHEN 1 - sp / (n * n) > 0 THEN (sq / n - m * m - m * (1 - m) * c / n * (1 - 1 / c)) / (1 - sp / (n * n)) ELSE 0 END AS x FROM p),
s AS (SELECT m, CASE WHEN x > 0 THEN greatest(2, m * (1 - m) / x - 1) ELSE n END AS strength FROM e),
v AS (SELECT source, (k + m * strength) / (n + strength) > 0.5 AS gone FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(gone, false) AS kept
FROM b LEFT JOIN v ON v.source = b.source
"""

ORACLES: dict[str, str] = {"op3_host_rules": OP3_SQL, "op8_warc": OP8_SQL}
