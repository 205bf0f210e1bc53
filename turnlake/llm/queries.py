"""The opN queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.ordinal_quality import grade

    return grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.token_rollup import documents_rollup

    return documents_rollup(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per),
sums AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM ranked),
levels AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(weight_from AS DOUBLE) AS lv FROM sums),
water AS (SELECT lv AS level FROM levels WHERE lv * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM water) * weight) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
needs AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS need FROM parts),
cum AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized)
SELECT c.doc_id, c.size, n.source_size, n.target,
  CAST(n.whole * c.size + greatest(0, least(c.size, n.need - c.before)) AS BIGINT) AS taken
FROM cum c JOIN needs n ON c.source IS NOT DISTINCT FROM n.source
"""


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.html_template import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents WHERE text IS NOT NULL)),
words AS (SELECT lang, id, unnest(w) AS w1, unnest(range(len(w))) AS pos FROM pieces),
runs AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY pos)),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w1 AS p, count(*) AS c FROM runs GROUP BY 1, 2),
f2 AS (SELECT lang, w1 || ' ' || w2 AS p, count(*) AS c FROM runs WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
f3 AS (SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS p, count(*) AS c FROM runs WHERE w3 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
two AS (
  SELECT f.lang, f.p AS phrase, f.c AS a, l.c AS l, r.c AS r, CAST(f.c AS HUGEINT) * f.c * 1000000 // (CAST(l.c AS HUGEINT) * r.c) AS score
  FROM f2 f JOIN f1 l ON l.lang = f.lang AND l.p = split_part(f.p, ' ', 1) JOIN f1 r ON r.lang = f.lang AND r.p = split_part(f.p, ' ', 2)
  WHERE f.c >= 10),
parts AS (
  SELECT lang, p, c, 1 AS k, split_part(p, ' ', 1) AS lp, split_part(p, ' ', 2) || ' ' || split_part(p, ' ', 3) AS rp FROM f3
  UNION ALL SELECT lang, p, c, 2, split_part(p, ' ', 1) || ' ' || split_part(p, ' ', 2), split_part(p, ' ', 3) FROM f3),
f12 AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
cuts AS (
  SELECT f.lang, f.p AS phrase, f.c AS a, f.k, l.c AS l, r.c AS r, CAST(f.c AS HUGEINT) * f.c * 1000000 // (CAST(l.c AS HUGEINT) * r.c) AS score
  FROM parts f JOIN f12 l ON l.lang = f.lang AND l.p = f.lp JOIN f12 r ON r.lang = f.lang AND r.p = f.rp),
three AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner2 AS (
  SELECT lang, p, max(c) AS longer FROM (
    SELECT lang, split_part(p, ' ', 1) || ' ' || split_part(p, ' ', 2) AS p, c FROM f3
    UNION ALL SELECT lang, split_part(p, ' ', 2) || ' ' || split_part(p, ' ', 3), c FROM f3) GROUP BY ALL),
kept AS (
  SELECT t.* FROM two t LEFT JOIN inner2 i ON i.lang = t.lang AND i.p = t.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * t.a
  UNION ALL SELECT * FROM three)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.conversation_repair import audit, damaged

    return audit(damaged(table(spark, sf_dir, "conversations")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


#: The checksum goes over half bytes; the 16 values are its table for them.
OP13_SQL = r"""
WITH draws AS (
  SELECT doc_id, coalesce(text, '') AS t, 'shard-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' AS k FROM documents),
best AS (
  SELECT *, list_max(list_transform(range(0, 16), lambda s: md5(k || CAST(s AS VARCHAR)) || printf('%06d', s))) AS b, md5(k || '16') || '000016' AS g FROM draws),
rows_ AS (
  SELECT doc_id, md5(k) AS h, CAST(strlen(t) + 1 AS BIGINT) AS size, CAST(right(b, 6) AS INTEGER) AS shard, CAST(right(greatest(b, g), 6) AS INTEGER) AS grown_shard,
    list_reduce(
      [CAST(4294967295 AS BIGINT)] || flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: [CAST(strpos('0123456789ABCDEF', b[2]) - 1 AS BIGINT), CAST(strpos('0123456789ABCDEF', b[1]) - 1 AS BIGINT)])),
      lambda c, x: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(c & 15, x) + 1], c >> 4)) AS c
  FROM best)
SELECT doc_id, size, xor(c, 4294967295) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32, grown_shard) - 1 AS slot, grown_shard
FROM rows_
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": OP5_SQL, "op11_collocations": OP11_SQL, "op13_sharding": OP13_SQL}
