"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.llm import bpe, exact, fill_middle, html_gbt, langid, packing, ppm, quality, sharding, simhash, spelling, substrings, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_documents(spark, sf_dir))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_gbt.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components_of(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_documents(spark, sf_dir)))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(_documents(spark, sf_dir))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_documents(spark, sf_dir))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_substring_dedup,
        op3_language_id,
        op4_packing,
        op5_sharding,
        op6_bpe,
        op7_exact_dedup,
        op8_html_extraction,
        op9_token_counts,
        op10_simhash,
        op11_spelling_variants,
        op12_lm_scores,
        op13_fill_middle,
        pipeline,
    )
}


ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i+4]) AS c FROM p),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM g WHERE c > 1) GROUP BY rid),
t AS (SELECT rid, max(c) AS top FROM (SELECT rid, x, count(*) AS c FROM (SELECT rid, unnest(ws) AS x FROM w) GROUP BY rid, x) GROUP BY rid),
b AS (SELECT w.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(top, 0) AS top,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
    len(list_filter(ws, lambda x: regexp_matches(x, '(!!|\?\?|!\?|\?!)$'))) AS n_marks,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_plain
  FROM w LEFT JOIN r USING (rid) LEFT JOIN t USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 10 * top > 3 * n_words OR 2 * n_upper > n_words OR 10 * n_marks > 3 * n_words
    OR 2 * n_plain > n_words) AS kept
FROM f""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i+12], ' ')) AS k
  FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
g AS (SELECT rid, i, coalesce(doc_id, 9223372036854775807) AS id,
    min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY k) AS low FROM p),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j FROM g WHERE id > low),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS kept FROM w ANTI JOIN x USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid) = 1 AS kept, sha256(t) AS text_sha256
FROM d""",
    # crc32 of the bytes of <doc_id>:<run> by its table; words meet where one of their code points is replaced or left out.
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
o AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS x FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM o),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h FROM x, t),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
p AS (SELECT word, n, i, substring(word, 1, i) AS a, substring(word, i + 2) AS z FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT p.word, q.word AS other, q.n AS m FROM p JOIN p q ON p.i = q.i AND p.a = q.a AND p.z = q.z AND length(p.word) = length(q.word) AND p.word <> q.word
  UNION SELECT p.word, w.word, w.n FROM p JOIN w ON w.word = p.a || p.z UNION SELECT w.word, p.word, p.n FROM p JOIN w ON w.word = p.a || p.z),
b AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM e GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.onward)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.onward IS NULL""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, ('0x' || h[1:8])::UBIGINT AS h1,
    ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
k AS (SELECT *, array_to_string(us[1:lo], '') AS p, array_to_string(us[lo + 1:hi], '') AS m, array_to_string(us[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM k""",
}
