"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookglass.llm import bpe, centroids, chat, decontam, jaccard, linededup, manifest, quality, rules, sketch, toxicity, warc, wrapper
from bookglass.llm.common import crc32_mod, prepare, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text counts as empty, repeated rows get a row each."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document: 3-word shingles, likeness of 0.9; texts without words link with nothing."""
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90, count_links=True)
    return out.withColumnRenamed("doc", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document: lines of 40 code points in 5 documents stay in the largest doc_id alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, min_chars=40, min_docs=5))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, and one of control strings, what is read back from its formatted examples; null texts and roles are empty."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, read back from the archives that hold all pages; null html is an empty payload."""
    archives = written(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a lexicon of labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, lexicon, threshold=0.3)
    return out.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document."""
    return sketch.edit_likeness(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page, by templates of its host or domain."""
    return wrapper.extract_text(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    out = quality.score_documents(docs, model, threshold=0.5)
    return out.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, edits, item_chars of each region of a document that is a benchmark item within its edit budget."""
    return decontam.contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of every document."""
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector of embeddings: 16 centroids, 3 rounds."""
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, seed=1)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; a third of the leaves is tampered with."""
    return manifest.document_manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of what the five stages keep."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_bpe, op2_ngram_jaccard_join, op3_line_dedup, op4_chat_format, op5_warc, op6_toxicity, op7_fingerprints, op8_html_extraction, op9_quality, op10_decontamination, op11_quality_rules, op12_centroid_clustering, op13_merkle_manifest, pipeline]
    return {f.__name__: f for f in own}


ORACLE = {
    "op3_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key) FILTER (WHERE k.doc_id <> c.top)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL OR k.doc_id = c.top), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key
GROUP BY k.doc_id
""",
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + 2 * (length(text) - length(translate(text, '\#<', '')))
       - (length(text) - length(translate(text, '\#<', ''))) + 13 + length(role) AS chars,
    role = 'assistant' AS target, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY rn) AS prefix FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE target), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE target), '')) AS loss_sha256,
  sum(prefix) FILTER (WHERE target OR rn = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
""",
    "op5_warc": r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to, url
FROM m
""",
}


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Every round as two tables: assignments, then centroids."""
    steps = [
        """kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v FROM kept ORDER BY cluster LIMIT {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT kept.rid, kept.vec_id, kept.v, c{r}.cluster,
    list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
  FROM kept, c{r} QUALIFY row_number() OVER (PARTITION BY kept.rid ORDER BY distance, c{r}.cluster) = 1
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
  SELECT c{r}.cluster, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
      SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m ON m.cluster = c{r}.cluster
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
"""


def _levels_sql(name: str, levels: int) -> list[str]:
    """Of nodes {name}0 (tree, no, digest), the nodes of each level; {name}r<l>: the runs of level l, where more than one node is left."""
    steps = []
    for n in range(levels):
        steps.append(f"{name}r{n} AS (SELECT tree, no // 8 AS no, list(digest ORDER BY no) AS ds FROM {name}{n} WHERE tree IN (SELECT tree FROM {name}{n} WHERE no = 1) GROUP BY tree, no // 8)")
        steps.append(f"{name}{n + 1} AS (SELECT tree, no, sha256(array_to_string(ds, '')) AS digest FROM {name}r{n} UNION ALL SELECT tree, no, digest FROM {name}{n} WHERE tree NOT IN (SELECT tree FROM {name}{n} WHERE no = 1))")
    return steps


def _folds_sql(rows: str, start: str, name: str, levels: int) -> list[str]:
    """Rows (tree, no, folded, proof, ...) of {start}, folded up the levels of {name}; they end as {rows}<levels>."""
    steps = [f"{rows}0 AS ({start})"]
    for n in range(levels):
        before, after = "array_to_string(r.ds[1:f.no % 8], '')", "array_to_string(r.ds[f.no % 8 + 2:], '')"
        steps.append(f"""{rows}{n + 1} AS (SELECT f.* REPLACE (f.no // 8 AS no, CASE WHEN r.ds IS NULL THEN f.folded ELSE sha256({before} || f.folded || {after}) END AS folded,
  CASE WHEN r.ds IS NULL THEN f.proof ELSE f.proof || {before} || {after} END AS proof) FROM {rows}{n} f LEFT JOIN {name}r{n} r ON r.tree = f.tree AND r.no = f.no // 8)""")
    return steps


def _manifest_sql(levels: int = 7) -> str:
    """Levels as tables, enough for 8 ** levels documents of a language and as many languages."""
    bits = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: ord(d)::BIGINT)), lambda c, d: " + bits.format("xor(c, d)") + "), 4294967295)"
    own = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {own('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {own(lower)} ELSE {own('text')} END AS held FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS no FROM leaves)",
        "n0 AS (SELECT tree, no, leaf AS digest FROM placed)",
        *_levels_sql("n", levels),
        f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS no, digest, tree AS name FROM n{levels})",
        *_levels_sql("t", levels),
        *_folds_sql("f", "SELECT tree, no, held AS folded, '' AS proof, doc_id, leaf FROM placed", "n", levels),
        *_folds_sql("g", f"SELECT '' AS tree, t0.no, f.folded, f.proof, f.doc_id, f.leaf, t0.digest AS subroot FROM f{levels} f JOIN t0 ON t0.name = f.tree", "t", levels),
    ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT g.doc_id, g.leaf, g.subroot, r.digest AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = r.digest AS verified FROM g{levels} g, t{levels} r
"""


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op12_centroid_clustering": _clustering_sql(), "op13_merkle_manifest": _manifest_sql()}
