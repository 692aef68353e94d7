"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, fill_in_middle, html_text, language_model, merkle, near_dup, packing, pii, relative_lz, simple8b, toxicity, urls
from .common import spread

#: Stated in the open only because the driver's tables are made up; a real key is a secret.
PSEUDONYM_KEY = "key of the synthetic tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; one in fewer files than there are cores is dealt out to them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_files(spark, sf_dir):
    images = simple8b.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return simple8b.read_token_files(images, with_ids=False)


def op4_pseudonyms(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "n_pii", "text")


def op5_decontamination(spark, sf_dir):
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark, sf_dir):
    return language_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_duplicates(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


def op10_main_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_merkle_manifest(spark, sf_dir):
    # The later state of the table, in which some texts have lost their line ends.
    cut = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    later = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(*cut))
    proved = merkle.manifest(table(spark, sf_dir, "documents"), {"later": later})
    folded = merkle.fold(F.coalesce("later", "leaf"), F.col("path"))
    hexed = [merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    out = proved.select("doc_id", *hexed, F.sha2(merkle.hex_text(merkle.proof(F.col("path"))), 256).alias("proof_sha256"), merkle.hex_text(folded).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark, sf_dir):
    return relative_lz.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_duplicates, op2_packing, op3_token_files, op4_pseudonyms, op5_decontamination, op6_url_filter, op7_quality, op8_embedding_duplicates, op9_toxicity, op10_main_text,
              op11_merkle_manifest, op12_fill_in_middle, op13_substring_dedup)
}

ORACLE_SQL = {
    "op1_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM i),
g AS (
  SELECT doc_id, k, size, array_to_string(ws[k:k + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS k FROM d, sizes WHERE len(ws) >= size)),
h AS (SELECT g.doc_id, g.k, g.size, i.item_id FROM g JOIN i ON g.size = i.size AND g.gram = i.gram),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS pos FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_embedding_duplicates": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, x.vec_id) AS component_id, x.vec_id = coalesce(component_id, x.vec_id) AS kept
FROM embeddings x LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, coalesce('+' || source, '') AS grp, text,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head
  FROM documents),
l AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    xor(4294967295, list_reduce([4294967295] || [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')],
      lambda x, c: list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) AS sum32,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS later
  FROM f),
n0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS members FROM l),
t AS (
  SELECT grp, 0 AS level, idx, leaf AS node, members FROM n0
  UNION ALL
  SELECT grp, level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (members + 2) // 3 FROM t WHERE members > 1 GROUP BY grp, level, idx // 3, members),
h0 AS (SELECT grp AS of, node, level AS height, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS members FROM t WHERE members = 1),
u AS (
  SELECT 0 AS level, idx, node, members FROM h0
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (members + 2) // 3 FROM u WHERE members > 1 GROUP BY level, idx // 3, members),
s AS (
  SELECT a.grp, a.level, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM t a JOIN t b ON a.grp = b.grp AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.members > 1 GROUP BY a.grp, a.level, a.idx),
v AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM u a JOIN u b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.members > 1 GROUP BY a.level, a.idx),
steps AS (
  SELECT n0.grp, n0.idx, s.level AS step, lft, rgt FROM n0 JOIN s ON s.grp = n0.grp AND s.idx = n0.idx // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL
  SELECT n0.grp, n0.idx, h0.height + v.level, lft, rgt FROM n0 JOIN h0 ON h0.of = n0.grp JOIN v ON v.idx = h0.idx // CAST(pow(3, v.level) AS BIGINT)),
w AS (
  SELECT grp, idx, 0 AS step, CASE WHEN sum32 % 2 = 0 THEN later ELSE leaf END AS node FROM n0
  UNION ALL
  SELECT w.grp, w.idx, w.step + 1, sha256(steps.lft || w.node || steps.rgt) FROM w JOIN steps ON steps.grp = w.grp AND steps.idx = w.idx AND steps.step = w.step),
last AS (SELECT grp, idx, arg_max(node, step) AS folded FROM w GROUP BY grp, idx),
p AS (SELECT grp, idx, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof FROM steps GROUP BY grp, idx)
SELECT n0.doc_id, n0.leaf, h0.node AS subroot, u.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, last.folded AS folded_root, last.folded = u.node AS verified
FROM n0 JOIN h0 ON h0.of = n0.grp JOIN u ON u.members = 1 LEFT JOIN p ON p.grp = n0.grp AND p.idx = n0.idx JOIN last ON last.grp = n0.grp AND last.idx = n0.idx""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, length(t) AS n, [CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT) for k in [0, 1, 2, 3]] AS r FROM d),
f AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f""",
    "op13_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, k, md5(array_to_string(ws[k:k + 19], ' ')) AS window_md5 FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS k FROM d)),
r AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY window_md5 ORDER BY doc_id, k) > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 19)) AS k FROM r),
x AS (SELECT d.doc_id, k, word FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM d) d ANTI JOIN g USING (doc_id, k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM x GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, len(d.ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
