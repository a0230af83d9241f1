"""The registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe_codec, cover_tree, exact_dedup, language_id, merkle, ngram_jaccard, packing, pii, span_dedup, suffix_dedup, token_align, token_counts, toxicity
from tillroll.llm.common import documents, fold

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.encode_decode(documents(spark, sf_dir), BYTE_BPE))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.suffix_dedup(documents(spark, sf_dir), width=50))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d)
), f AS (
  SELECT s, min(doc_id) AS m FROM w GROUP BY s
), k AS (
  SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.m < w.doc_id
), r AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM k
), i AS (
  SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM r
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, g
), segments AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS o FROM spans
), cut AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS e, list({'o': o, 'a': a} ORDER BY a) AS kept
  FROM segments GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE
         array_to_string(list_transform(kept, lambda x: substr(h, 2 * x.o + 1, 2 * (x.a - x.o))), '') || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir), BYTE_BPE))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs)).withColumn("held_out", fold() == 0)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.jaccard_components(documents(spark, sf_dir), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


OP6_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.doc_id
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir), BYTE_BPE, limit=512)
    stored = F.crc32("prefix_counts").alias("counts_crc32")
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within", stored)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cover_tree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, k=5)
    return best.withColumnRenamed("id", "vec_id")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = span_dedup.dedup_spans(documents(spark, sf_dir))
    return cut.select("doc_id", "n_sentences", "n_removed", "spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).withColumn("held_out", fold() == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    damaged = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    received = F.when(damaged, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    return merkle.manifest(docs, received)


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256({})".format(" || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars", "{text}")))
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="replace(text, chr(10), '')")} AS cut,
         coalesce(list_reduce(list_prepend(4294967295, list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))) % 2 = 1, false) AS damaged
  FROM documents
), a AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d
), up AS (
  SELECT source, 0 AS level, pos, n, leaf AS h FROM a
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, level, pos // 3, n
), s AS (
  SELECT source, h, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, h FROM s
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n
), one AS (
  SELECT h AS root FROM top WHERE n = 1
), inner_step AS (
  SELECT a.source, a.pos AS leaf_pos, up.level, coalesce(string_agg(up.h, '' ORDER BY up.pos) FILTER (WHERE up.pos < spot), '') AS before,
         coalesce(string_agg(up.h, '' ORDER BY up.pos) FILTER (WHERE up.pos > spot), '') AS behind
  FROM (SELECT source, pos, unnest(range(0, 40)) AS l, pos // CAST(pow(3, l) AS BIGINT) AS spot FROM a WHERE n > 1) a
  JOIN up ON up.source IS NOT DISTINCT FROM a.source AND up.level = a.l AND up.pos // 3 = spot // 3 AND up.n > 1 GROUP BY ALL
), outer_step AS (
  SELECT s.source, s.l + s.height AS level, coalesce(string_agg(top.h, '' ORDER BY top.pos) FILTER (WHERE top.pos < spot), '') AS before,
         coalesce(string_agg(top.h, '' ORDER BY top.pos) FILTER (WHERE top.pos > spot), '') AS behind
  FROM (SELECT source, height, unnest(range(0, 40)) AS l, pos // CAST(pow(3, l) AS BIGINT) AS spot FROM s) s
  JOIN top ON top.level = s.l AND top.pos // 3 = spot // 3 AND top.n > 1 GROUP BY ALL
), step AS (
  SELECT source, leaf_pos, level, before, behind FROM inner_step
  UNION ALL
  SELECT a.source, a.pos, o.level, before, behind FROM a JOIN outer_step o ON o.source IS NOT DISTINCT FROM a.source
), way AS (
  SELECT a.source, a.pos, coalesce(list({{'b': before, 'e': behind}} ORDER BY level) FILTER (WHERE level IS NOT NULL), []) AS steps
  FROM a LEFT JOIN step ON step.source IS NOT DISTINCT FROM a.source AND leaf_pos = a.pos GROUP BY ALL
)
SELECT doc_id, a.source, leaf, s.h AS subroot, root,
       sha256(array_to_string(list_transform(steps, lambda x: x.b || x.e), '')) AS proof_sha256,
       list_reduce(list_prepend({{'b': '', 'e': CASE WHEN damaged THEN cut ELSE leaf END}}, steps),
         lambda c, x: {{'b': '', 'e': sha256(x.b || c.e || x.e)}}).e AS folded_root, folded_root = root AS verified
FROM a JOIN way ON way.source IS NOT DISTINCT FROM a.source AND way.pos = a.pos JOIN s ON s.source IS NOT DISTINCT FROM a.source, one
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir)))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_align.align(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE, keep_groups=False)
    return found.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_exact_dedup, op2_bpe_codec, op3_suffix_dedup, op4_packing, op5_language_id, op6_ngram_jaccard, op7_token_counts, op8_topk_search, op9_span_dedup, op10_toxicity, op11_merkle_manifest, op12_pii, op13_token_align)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op3_suffix_dedup": OP3_SQL,
        "op6_ngram_jaccard": OP6_SQL,
        "op8_topk_search": OP8_SQL,
        "op11_merkle_manifest": OP11_SQL,
    }
