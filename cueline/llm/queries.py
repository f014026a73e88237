"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import ann, bpe, exact_top, filter_audit, html_extract, manifest, packing, piece_sampling, quality_rules, quality_vote, simhash, substring_dedup, token_counts, toxicity
from cueline.llm._common import crc32_mod, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substring_dedup.remove_repeats(docs, layout="words")
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_mod(F.col("doc_id"), 3) != 1)
    scored = toxicity.with_toxicity(docs, labels)
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_mod(F.col("doc_id"), 4) != 2)
    scored = quality_vote.with_quality(docs, labels)
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), added=bpe.added_tokens())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.with_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = piece_sampling.encode(docs)
    back = cut.withColumn("lossless", piece_sampling.decode(F.col("piece_ids")) == F.coalesce("text", F.lit("")))
    return back.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "lossless")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM words, unnest(range(1, len(w) - 48)) AS t(i)
), firsts AS (
  SELECT h, min(doc_id) AS lo FROM windows GROUP BY h
), hits AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE lo < doc_id
), singles AS (
  SELECT words.doc_id, j, w[j] AS word, hits.i FROM words CROSS JOIN unnest(range(1, len(w) + 1)) AS t(j)
  LEFT JOIN hits ON hits.doc_id = words.doc_id AND hits.i = j
), marked AS (
  SELECT doc_id, j, word,
    max(i) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM singles
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


#: A repeat of at least 10 words is made of repeated windows of 10, and one of over 100 holds a repeated window of 101.
OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS h
  FROM words, unnest([5, 10, 101]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)
), repeated AS (
  SELECT doc_id, k, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k, h) > 1
), spans AS (
  SELECT doc_id, k, i, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS following FROM repeated
), covered AS (
  SELECT doc_id, sum(least(k, coalesce(following - i, k))) FILTER (k = 5) AS five,
    sum(least(k, coalesce(following - i, k))) FILTER (k = 10) AS ten, count(*) FILTER (k = 101) AS long
  FROM spans GROUP BY doc_id
), lines AS (
  SELECT doc_id, line FROM words, unnest(string_split(t, chr(10))) AS l(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(five, 0)::BIGINT AS n_repeat_words, coalesce(ten, 0) AS ten, coalesce(long, 0) AS long
  FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND ten <= 0.2 * n_words AND long = 0 AS kept
FROM base
"""


#: Documents with equal flags and labels are counted together, and replayed once.
OP11_SQL = r"""
WITH letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM texts LEFT JOIN marks USING (doc_id)
), classes AS (
  SELECT part, good, toxic, failed, count(*) AS n FROM flagged GROUP BY ALL
), replayed AS (
  SELECT classes.*, filter_order, step, substr(filter_order, step, 1) AS letter, contains(failed, substr(filter_order, step, 1)) AS fails,
    coalesce(list_min(list_transform(string_split(nullif(failed, ''), ''), lambda l: instr(filter_order, l))), 6) AS first
  FROM classes, orders, unnest(range(1, 6)) AS s(step)
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND first < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND length(failed) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (first = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0)::BIGINT AS toxic_lost
  FROM replayed GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""


def _digest_sql(text: str) -> str:
    return "sha256(" + " || ".join(
        f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)
    ) + ")"


#: Levels are built by recursion; a path is the list of runs above a leaf, without the leaf's own node.
OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab
), hashed AS (
  SELECT doc_id, coalesce('/' || source, '') AS part, {_digest_sql("text")} AS leaf,
    {_digest_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
    xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS crc
  FROM documents, bits
), leaves AS (
  SELECT doc_id, part, leaf, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS now,
    row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY part) AS n
  FROM hashed
), levels AS (
  SELECT part, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT part, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM levels WHERE n > 1 GROUP BY part, level, i // 16, n
), sources AS (
  SELECT part, h, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, n, h FROM sources
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 16, n
), runs AS (
  SELECT part, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM levels WHERE n > 1 GROUP BY part, level, i // 16
), top_runs AS (
  SELECT level, i // 16 AS run, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY level, i // 16
), top_paths AS (
  SELECT sources.part, sources.h AS subroot, list({{'b': array_to_string(hs[:(sources.i // (16 ** level)::BIGINT) % 16], ''),
    'a': array_to_string(hs[(sources.i // (16 ** level)::BIGINT) % 16 + 2:], '')}} ORDER BY level) FILTER (hs IS NOT NULL) AS path
  FROM sources LEFT JOIN top_runs ON run = sources.i // (16 ** (level + 1))::BIGINT GROUP BY sources.part, sources.h
), paths AS (
  SELECT doc_id, leaves.part, leaf, now, leaves.i, list({{'b': array_to_string(hs[:(leaves.i // (16 ** level)::BIGINT) % 16], ''),
    'a': array_to_string(hs[(leaves.i // (16 ** level)::BIGINT) % 16 + 2:], '')}} ORDER BY level) FILTER (hs IS NOT NULL) AS path
  FROM leaves LEFT JOIN runs ON runs.part = leaves.part AND run = leaves.i // (16 ** (level + 1))::BIGINT GROUP BY doc_id, leaves.part, leaf, now, leaves.i
), whole AS (
  SELECT doc_id, leaf, now, subroot, (SELECT h FROM tops WHERE n = 1) AS root, list_concat(coalesce(paths.path, []), coalesce(top_paths.path, [])) AS path
  FROM paths JOIN top_paths USING (part)
), folded AS (
  SELECT *, list_reduce(list_concat([{{'b': now, 'a': ''}}], path), lambda acc, p: {{'b': sha256(p.b || acc.b || p.a), 'a': ''}}).b AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.b || p.a), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM folded
"""

OP13_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM whole q JOIN whole v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_html_extraction": op2_html_extraction,
        "op3_toxicity": op3_toxicity,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_quality_rules": op6_quality_rules,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_sentencepiece_sampling": op9_sentencepiece_sampling,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_filter_audit": op11_filter_audit,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_exact_top_k": op13_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL, "op6_quality_rules": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
        "op13_exact_top_k": OP13_SQL,
    }
