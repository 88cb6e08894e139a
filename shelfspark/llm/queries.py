"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, jaccard, katz, language_id, line_dedup, merkle, mixing, quality, secret_scan, token_scan, vector_codes
from .common import read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Half the way from the sources' own shares to equal weights.
MIX_TARGET = ("entropy_share", 0.5)


def byte_pattern() -> str:
    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), WORD_BPE)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(read(spark, sf_dir, "documents"), width=4, percent=85)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(read(spark, sf_dir, "documents"), BYTE_BPE, byte_pattern())


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(read(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"), MIX_TARGET)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(read(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.lm_scores(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_bpe,
        op3_ngram_join,
        op4_exact_dedup,
        op5_quality_rules,
        op6_token_counts,
        op7_html_extract,
        op8_line_dedup,
        op9_secret_scan,
        op10_source_mixing,
        op11_merkle_manifest,
        op12_lm_scoring,
        op13_vector_codes,
    )
}

def _vector_codes_sql() -> str:
    """Four rounds over distinct parts, one after another. Inner products of such integers are exact in doubles."""
    apart = "list_inner_product(d.v, d.v) - 2 * list_inner_product(d.v, c.v) + list_inner_product(c.v, c.v)"
    steps = [
        """
k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, i AS part, v[len(v) // 4 * i + 1 : len(v) // 4 * (i + 1)] AS v FROM k, range(4) AS r(i)),
d AS (SELECT part, v, count(*) AS n FROM p GROUP BY part, v),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"""
    ]
    for i in range(5):
        steps.append(f"a{i} AS (SELECT d.part, d.v, d.n, min({{'error': {apart}, 'e': c.e}}) AS best FROM d JOIN c{i} AS c ON d.part = c.part GROUP BY d.part, d.v, d.n)")
        if i < 4:
            steps.append(
                f"m{i} AS (SELECT part, e, list(mean ORDER BY j) AS v FROM (SELECT part, best.e AS e, j, floor(sum(n * v[j]) / sum(n)) AS mean FROM a{i}, range(1, len(v) + 1) AS r(j) GROUP BY part, best.e, j) GROUP BY part, e)"
            )
            steps.append(f"c{i + 1} AS (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m ON m.part = c.part AND m.e = c.e)")
    steps.append("own AS (SELECT p.vec_id, p.label, string_agg(printf('%02x', best.e), '' ORDER BY p.part) AS code, sum(best.error)::BIGINT AS error FROM p JOIN a4 ON a4.part = p.part AND a4.v = p.v GROUP BY p.vec_id, p.label)")
    steps.append("book AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, e, j)) AS digest FROM (SELECT part, e, j, v[j] AS x FROM c4, range(1, len(v) + 1) AS r(j)))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM own, book"


ORACLE = {
    "op3_ngram_join": r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sized AS (SELECT doc_id, s, n FROM sh JOIN n USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)
""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_source_mixing": r"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(source, '') AS s, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS n,
             CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS u FROM documents),
sh AS (SELECT s, sum(n) AS tok, sum(n) / sum(sum(n)) OVER () AS p, sum(sum(n)) OVER () AS total FROM d GROUP BY s),
ps AS (SELECT list(p) AS ps, ln(len(list(p))) AS equal, -list_sum(list_transform(list(p), lambda x: x * ln(x))) AS own FROM sh),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h <= want THEN lo ELSE mid END, CASE WHEN h <= want THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, own + 0.5 * (equal - own) AS want,
               ln(list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))))
               - (lo + hi) / 2 * list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) AS h
        FROM bis, ps WHERE i < 60)),
e AS (SELECT hi AS a FROM bis WHERE i = 60),
w AS (SELECT s, tok, total, pow(p, a) / sum(pow(p, a)) OVER () AS weight FROM sh, e),
q AS (SELECT *, floor(weight * total / tok + 1e-6) AS epochs FROM w),
r AS (SELECT d.doc_id, d.s AS source, CAST(d.n AS BIGINT) AS n_tokens, round(q.weight, 6) AS weight, epochs, greatest(0.0, weight * total - epochs * tok) AS rest,
             sum(d.n) OVER (PARTITION BY d.s ORDER BY d.u RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN q USING (s))
SELECT doc_id, source, n_tokens, weight, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE
f AS (SELECT *, coalesce('=' || lang, '') AS key,
        list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
          || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front FROM documents),
l AS (SELECT doc_id, key, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(front || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l),
nodes(key, lvl, pos, h, n) AS (
  SELECT key, 0, pos, leaf, n FROM r UNION ALL
  SELECT key, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY key, lvl, pos // 8, n),
subs AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM subs UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY lvl, pos // 8, n),
runs AS (SELECT key, lvl, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS s FROM nodes WHERE n > 1 GROUP BY key, lvl, pos // 8),
top_runs AS (SELECT lvl, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS s FROM tops WHERE n > 1 GROUP BY lvl, pos // 8),
steps AS (
  SELECT r.key, r.pos, lvl, r.pos // pow(8, lvl)::BIGINT % 8 AS i, s FROM r JOIN runs ON runs.key = r.key AND run = r.pos // pow(8, lvl + 1)::BIGINT UNION ALL
  SELECT r.key, r.pos, 1000 + lvl, subs.pos // pow(8, lvl)::BIGINT % 8, s FROM r JOIN subs ON subs.key = r.key JOIN top_runs ON run = subs.pos // pow(8, lvl + 1)::BIGINT),
paths AS (SELECT key, pos, string_agg(s[1:64 * i] || s[64 * i + 65:], '' ORDER BY lvl) AS sibs, list(i || s[1:64 * i] || s[64 * i + 65:] ORDER BY lvl) AS folds FROM steps GROUP BY key, pos),
o AS (SELECT r.doc_id, r.leaf, subs.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(sibs, '')) AS proof_sha256,
        list_reduce(list_prepend(coalesce(changed, leaf), coalesce(folds, [])), lambda a, x: sha256(x[2:1 + 64 * x[1]::INT] || a || x[2 + 64 * x[1]::INT:])) AS folded_root
      FROM r JOIN subs ON subs.key = r.key LEFT JOIN paths AS p ON p.key = r.key AND p.pos = r.pos)
SELECT *, folded_root = root AS verified FROM o
""",
    "op13_vector_codes": _vector_codes_sql(),
}
