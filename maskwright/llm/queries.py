"""Queries of the training-data operators over the project's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import copies, leakage, lookalikes, packing, personal, places, repetition, scans, variants
from maskwright.runtime import is_ascii, spread, table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "mappings").select(F.col("original").alias("name"), F.col("entity_type").alias("kind"))
    seen = table(spark, sf_dir, "detections").select(F.col("matched_text").alias("name"), F.col("entity_type").alias("kind"))
    return stored.unionByName(seen).where("kind IN ('PERSON', 'ORG')")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.name_pairs(_names(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.name_groups(_names(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "mappings").select(F.lit("mapping").alias("src"), F.col("mapping_id").alias("row_id"), F.col("entity_type").alias("etype"), F.col("original").alias("text"))
    b = table(spark, sf_dir, "ignored_entities").select(F.lit("ignored").alias("src"), F.col("ignore_id").alias("row_id"), F.col("entity_type").alias("etype"), "text")
    return a.unionByName(b).where(is_ascii("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_pairs(_records(spark, sf_dir))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_counts(_records(spark, sf_dir)).select("src", "etype", "first_id", "copies")


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, etype = (F.lit(None).cast("string").alias(c) for c in ("inside", "etype"))
    files = table(spark, sf_dir, "scan_results").select(F.lit("text").alias("src"), F.col("scan_id").alias("row_id"), "text", none, etype)
    det = table(spark, sf_dir, "detections")
    around = det.select(F.lit("context").alias("src"), F.col("det_id").alias("row_id"), F.col("context").alias("text"), F.col("matched_text").alias("inside"), F.col("entity_type").alias("etype"))
    lines = det.where("entity_type = 'FREE_TEXT'").select(F.lit("matched").alias("src"), F.col("det_id").alias("row_id"), F.col("matched_text").alias("text"), none, etype)
    return spread(files.unionByName(around).unionByName(lines))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_values(_free_texts(spark, sf_dir)).select("src", "row_id", "kind", F.col("value").alias("pii_text"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted_texts(_free_texts(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "scan_results")
    return files.where("page_count IS NOT NULL").select(F.col("scan_id").alias("doc_id"), "text"), table(spark, sf_dir, "ocr_words"), files.where("page_count IS NULL").select("text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_repairs(*_pages(spark, sf_dir))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_texts(*_pages(spark, sf_dir))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mappings").where("entity_type IN ('ADDRESS', 'USER')").select(F.col("mapping_id").alias("row_id"), F.col("original").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.place_pairs(_addresses(spark, sf_dir)).toDF("mapping_id_a", "mapping_id_b")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.place_links(_addresses(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mappings").select(F.lit("mapping").alias("src"), F.col("mapping_id").alias("row_id"), F.col("original").alias("value"))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "detections").select(F.lit("detection").alias("src"), F.col("det_id").alias("row_id"), F.col("matched_text").alias("value"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent_forms(_stored(spark, sf_dir).unionByName(_detected(spark, sf_dir)))


def p6_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.value_lookup(_detected(spark, sf_dir), _stored(spark, sf_dir)).withColumnRenamed("row_id", "det_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_containers(spark, sf_dir).where("pieces > 1 AND piece = 0").select("limit_id", "doc_id")


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_totals(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unused_room(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(_corpus(spark, sf_dir), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.leaked_passages(_corpus(spark, sf_dir), table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest_words"))


def p8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.refilled_templates(_corpus(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_share(_corpus(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_share(spark, sf_dir).where("share >= 0.3").select("doc_id")


def p9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.line_frequency(table(spark, sf_dir, "documents")).select("doc_id", "kept_chars", "all_chars", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_records, p3_found, p3_redacted, p4_found, p4_texts, p5_found, p5_links, p6_found, p6_lookup, p7_found, p7_containers, p7_totals, p7_unused, p8_found, p8_items, p8_templates, p9_found, p9_share, p9_lines)}


_UNITS = copies.UNIT_WORDS
_KEYED = rf"""
WITH rows AS (
  SELECT 'mapping' AS src, mapping_id AS row_id, coalesce(entity_type, '') AS etype, original AS text FROM mappings
  UNION ALL SELECT 'ignored', ignore_id, coalesce(entity_type, ''), text FROM ignored_entities),
low AS (SELECT *, trim(regexp_replace(lower(text), '[\s_]+', ' ', 'g')) AS l FROM rows WHERE NOT regexp_matches(text, '[^\x00-\x7F]')),
bound AS (SELECT *, regexp_replace(regexp_replace(l, '\b({_UNITS})\b[^a-z0-9#]*#?[^a-z0-9]*([0-9]+[a-z]?)\b', '\1=\2', 'g'), '#\s*([0-9]+[a-z]?)\b', 'no=\1', 'g') AS b FROM low),
keyed AS (SELECT src, row_id, etype, CASE
    WHEN regexp_matches(l, '^[^@ ]*[a-z0-9][^@ ]*@[^@ ]*[a-z0-9]') THEN regexp_replace(replace(l, ' ', ''), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')
    WHEN NOT regexp_matches(l, '[a-z]') AND regexp_matches(l, '[0-9]') THEN regexp_replace(l, '[^0-9]+', '', 'g')
    WHEN NOT regexp_matches(l, '[a-z0-9]') THEN l
    ELSE array_to_string(list_sort(string_split(trim(regexp_replace(b, '[^a-z0-9=]+', ' ', 'g')), ' ')), ' ') END AS k FROM bound)
"""


#: Code points without width, as numbers: a second statement of what ``lookalikes.INVISIBLE`` says.
_NO_WIDTH = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]


def _plain_sql(values: str) -> str:
    """The consistent form by joins: every value as rows of characters, each met by its plain form, and put together again.

    What characters become is derived here from the Unicode data; only the pairs of look-alikes are the operator's.
    """
    code = lambda chars: ", ".join(f"({ord(c)}, {lookalikes._quoted(p)})" for c, p in chars)
    compatible = []
    for n in range(0x80, 0x110000):
        c = chr(n)
        plain = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Zs":
            compatible.append((c, " "))
        elif c in lookalikes.HYPHENS:
            compatible.append((c, "-"))
        elif 0xFB00 <= n <= 0xFB06 or (plain.isascii() and len(plain) == 1 and unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<font>"))):
            compatible.append((c, plain))
    hidden = " OR ".join(f"code BETWEEN {a} AND {b}" for a, b in _NO_WIDTH)
    script = r"[\p{Greek}\p{Cyrillic}ıɑɡ]"
    return rf"""WITH v AS (SELECT DISTINCT value FROM ({values}) WHERE regexp_matches(value, '[^\x00-\x7F]')),
simple(code, plain) AS (VALUES {code(compatible)}), alike(code, plain) AS (VALUES {code(lookalikes.LOOKALIKES.items())}),
c AS (SELECT value, unnest(regexp_extract_all(value, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(value, '(?s).'), 1) AS i FROM v),
d AS (SELECT value, i, ch, unicode(ch) AS code FROM c),
s AS (SELECT value, nfc_normalize(coalesce(string_agg(coalesce(plain, ch), '' ORDER BY i) FILTER (WHERE NOT ({hidden})), '')) AS s FROM d LEFT JOIN simple USING (code) GROUP BY value),
w AS (SELECT value, s, unnest(regexp_extract_all(s, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+')) AS w, generate_subscripts(regexp_extract_all(s, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), 1) AS k FROM s),
x AS (SELECT value, w, k, regexp_matches(w, '{script}') AND (regexp_matches(w, '\p{{Latin}}') OR (length(w) = 1 AND regexp_matches(s, '\p{{Latin}}'))) AS mixed FROM w),
y AS (SELECT value, k, mixed, unnest(regexp_extract_all(w, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(w, '(?s).'), 1) AS i FROM x),
z AS (SELECT value, nfc_normalize(string_agg(CASE WHEN mixed THEN coalesce(plain, ch) ELSE ch END, '' ORDER BY k, i)) AS plain FROM y LEFT JOIN alike ON alike.code = unicode(y.ch) GROUP BY value),
p AS (SELECT s.value, CASE WHEN s.s = '' THEN '' ELSE z.plain END AS plain FROM s LEFT JOIN z ON s.value = z.value)
SELECT src, row_id, p.plain FROM ({values}) AS t JOIN p ON t.value = p.value WHERE p.plain <> t.value"""


def oracle_sql() -> dict[str, str]:
    run, share = repetition.RUN, 0.3
    words = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT doc_id, n, i, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {run - 1} FOLLOWING), ' ') AS gram FROM g),
s AS (SELECT doc_id, n, i, i + {run - 1} <= n AND row_number() OVER (PARTITION BY doc_id, i + {run - 1} <= n, gram ORDER BY i) > 1 AS again FROM r),
c AS (SELECT doc_id, n, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {run - 1} PRECEDING AND CURRENT ROW) AS covered FROM s),
t AS (SELECT doc_id, sum(covered)::BIGINT AS repeated_words, max(n)::BIGINT AS words FROM c GROUP BY doc_id)
"""
    lines = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, text, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, host, text, length(line) AS chars, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS plain FROM t),
c AS (SELECT host, plain FROM p WHERE plain <> '' GROUP BY host, plain HAVING count(DISTINCT text) > 3),
m AS (SELECT doc_id, chars, c.plain IS NOT NULL AS common FROM p LEFT JOIN c ON p.host = c.host AND p.plain = c.plain),
k AS (SELECT doc_id, sum(CASE WHEN common THEN 0 ELSE chars END)::BIGINT AS kept_chars, sum(chars)::BIGINT AS all_chars FROM m GROUP BY doc_id)
SELECT doc_id, kept_chars, all_chars, CASE WHEN all_chars > 0 THEN kept_chars / all_chars ELSE 1.0 END < 0.5 AS rejected FROM k
"""
    values = "SELECT 'mapping' AS src, mapping_id AS row_id, original AS value FROM mappings UNION ALL SELECT 'detection', det_id, matched_text FROM detections"
    return {
        "p2_found": _KEYED + "SELECT src, first_id, row_id AS copy_id FROM (SELECT src, row_id, min(row_id) OVER (PARTITION BY src, etype, k) AS first_id FROM keyed) WHERE row_id <> first_id",
        "p2_records": _KEYED + "SELECT src, etype, min(row_id) AS first_id, count(*) AS copies FROM keyed GROUP BY src, etype, k",
        "p6_found": _plain_sql(values),
        "p7_found": "SELECT limit_id, doc_id FROM documents, pack_limits WHERE strlen(text) + 1 > capacity",
        "p7_totals": "SELECT limit_id, count(*) AS documents, sum(ceil((strlen(text) + 1) / capacity))::BIGINT AS pieces, sum(strlen(text) + 1)::BIGINT AS tokens, 0::BIGINT AS overfull FROM documents, pack_limits WHERE text IS NOT NULL GROUP BY limit_id",
        "p9_found": words + f"SELECT doc_id FROM t WHERE repeated_words >= {share} * words",
        "p9_share": words + "SELECT d.doc_id, coalesce(t.repeated_words, 0) AS repeated_words, coalesce(t.words, 0) AS words, coalesce(t.repeated_words / t.words, 0.0) AS share FROM d LEFT JOIN t ON d.doc_id = t.doc_id",
        "p9_lines": lines,
    }
