"""The engine's queries over the project's tables, and the same in SQL where SQL can say it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import covers
from maskwright.functions.text import byte_offset, context_of, let, match_spans, utf16_offset
from maskwright.operators import names, pages, resolve, rules, spans, tables
from maskwright.plans import pipeline
from maskwright.runtime import exploded, spread, table
from maskwright.sources import files as sources

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["src", "id"]
NOW = "TIMESTAMP '2026-01-01 00:00:00'"
#: The pattern of the rule-test query and the phrase of the page-match query.
MEMBER = r"(?i)member\s*id\s*:?\s*(\w{6,12})"
PHRASE = "before the"
CELL_PAIRS = [("Customer#", "Client "), ("Client 0", "C"), ("BUILDING", "HOUSE")]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All long texts: documents and the text of files, as (src, id, text)."""
    a = table(spark, sf_dir, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "scan_results").select(F.lit("file").alias("src"), F.col("scan_id").alias("id"), "text")
    return spread(a.unionByName(b))


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a line of a form, for rules of which the texts have no case: dates of birth and routing numbers."""
    born = F.date_format("o_orderdate", "MM/dd/yyyy")
    line = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(", D.O.B. "), born, F.lit("; routing #"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" or birthday "), born)
    return table(spark, sf_dir, "orders").select(F.lit("order").alias("src"), F.col("o_orderkey").alias("id"), line.alias("text"))


#: Rules that no text of the corpus has a case of.
ON_ORDERS = ("Date of Birth", "Routing Number")


def _rule(rule: rules.Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = corpus(spark, sf_dir)
        if rule.name in ON_ORDERS:
            texts = texts.unionByName(labelled_orders(spark, sf_dir))
        found = exploded(texts, KEY, rules.rule_spans(F.col("text"), rule))
        return found.select(*KEY, "d.start", "d.end", "d.matched_text")

    return run


def _by_name(name: str) -> rules.Rule:
    return next(r for r in rules.BUILT_IN if r.name == name)


def phone_toll_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exploded(corpus(spark, sf_dir), KEY, match_spans(F.col("text"), _by_name("Phone (US)").pattern))
    return found.select(*KEY, "d.start", "d.matched_text", rules.is_toll_free(F.col("d.matched_text")).alias("toll_free"))


def address_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "detections").where("entity_type = 'ADDRESS'").select("det_id", rules.is_garbage_address(F.col("matched_text")).alias("garbage"))


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_frame(spark).select("name", "entity_type", "pattern", "enabled", "built_in")


def custom_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the rule table that are enabled and have a pattern, over all texts; empty matches are no detections."""
    held = table(spark, sf_dir, "rules").where("enabled AND pattern IS NOT NULL").orderBy("name").collect()
    own = [rules.Rule(r["name"], "CUSTOM", r["pattern"]) for r in held]
    found = exploded(corpus(spark, sf_dir), KEY, F.concat(*(rules.rule_spans(F.col("text"), r, i) for i, r in enumerate(own))))
    return found.select(*KEY, "d.rule_name", "d.start", "d.end", "d.matched_text")


def pattern_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exploded(corpus(spark, sf_dir), KEY, rules.test_pattern(F.col("text"), MEMBER))
    return found.select(*KEY, "d.entity_type", "d.start", "d.end", "d.matched_text")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(*KEY, "text", rules.scan_rules(F.col("text")).alias("detections"))


def detections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(_scanned(spark, sf_dir), [], F.col("detections"))
    return rows.groupBy("d.entity_type", "d.rule_name").agg(F.count("*").alias("detections"), F.countDistinct("d.matched_text").alias("values"))


def detections_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select(*KEY, F.coalesce(F.size("detections"), F.lit(0)).alias("detections"))


def texts_with_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).groupBy("src").agg(F.count("*").alias("texts"), F.count_if(F.size("detections") > 0).alias("with_pii"))


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = _by_name("Email")
    return exploded(corpus(spark, sf_dir), [*KEY, "text"], rules.rule_spans(F.col("text"), rule))


def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select(*KEY, "d.start", context_of(F.col("text"), F.col("d.start"), F.col("d.end")).alias("context"))


def offset_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("d.start")
    return _mails(spark, sf_dir).select(*KEY, at.alias("start"), byte_offset(F.col("text"), at).alias("start_byte"), utf16_offset(F.col("text"), at).alias("start_utf16"))


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = exploded(_scanned(spark, sf_dir), KEY, spans.merge_spans(F.col("detections")))
    return merged.select(*KEY, "d.start", "d.end", "d.rule_name", "d.matched_text")


def _originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mappings").select("mapping_id", "original", "entity_type")


def _cover(make: Callable, out: str) -> Query:
    return lambda spark, sf_dir: _originals(spark, sf_dir).select("mapping_id", make(F.col("original")).alias(out))


def cover_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _originals(spark, sf_dir).select("mapping_id", covers.cover_value(F.col("original"), F.col("entity_type")).alias("cover"))


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.drop_ignored(table(spark, sf_dir, "detections"), table(spark, sf_dir, "ignored_entities")).select("det_id", "matched_text")


def current_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.current_mappings(table(spark, sf_dir, "mappings"))


def resolve_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.resolve(table(spark, sf_dir, "detections").select("det_id", "matched_text", "entity_type"), resolve.current_mappings(table(spark, sf_dir, "mappings")))
    return found.select("det_id", "replacement", "accepted")


def resolve_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(table(spark, sf_dir, "detections").select("det_id", "matched_text", "entity_type")).select("det_id", "replacement", "accepted")


def mapping_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "mappings").groupBy("original").agg(F.min_by(F.struct("replacement", "entity_type", "created", "last_used"), "mapping_id").alias("m")).select("original", "m.*")
    used = table(spark, sf_dir, "detections").select(F.col("matched_text").alias("original"), F.col("rule_name").alias("replacement"), "entity_type", F.col("det_id").alias("ord"))
    return resolve.upsert_mappings(m, used, F.expr(NOW)).select("original", "replacement", "entity_type", F.unix_micros("created").cast("string").alias("created"), F.unix_micros("last_used").cast("string").alias("last_used"))


def mapping_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "ignored_entities").select(F.col("text").alias("original"))
    return resolve.remove_mappings(table(spark, sf_dir, "mappings"), gone).select("mapping_id")


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mappings").where("entity_type = 'ORG'").select(F.col("original").alias("text"), "entity_type", "created", F.lit("store").alias("reason"))


def ignore_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _companies(spark, sf_dir)
    return resolve.add_ignored(table(spark, sf_dir, "ignored_entities"), new).select(F.lower("text").alias("text"), "entity_type", "reason")


def ignore_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.remove_ignored(table(spark, sf_dir, "ignored_entities"), _companies(spark, sf_dir)).select("ignore_id")


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "detections").select(F.col("det_id").alias("det_key"), "matched_text", F.col("rule_name").alias("replacement"), "entity_type", F.lit(False).alias("accepted"))
    action = F.when(F.col("entity_type") == "PERSON", "accept").when(F.col("entity_type") == "ORG", "reject").when(F.col("entity_type") == "ADDRESS", "edit")
    said = d.select("det_key", action.alias("action"), F.lit("[place]").alias("replacement")).where("action IS NOT NULL")
    return resolve.decide(d, said).select("det_key", "replacement", "accepted")


def rewrite_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.rule_spans(F.col("text"), _by_name("Email"))
    taken = F.transform(found, lambda d: F.struct(d["start"], d["end"], F.lit("[mail]").alias("replacement"), F.lit(True).alias("accepted")))
    return corpus(spark, sf_dir).where("text IS NOT NULL").select(*KEY, spans.apply_replacements(F.col("text"), taken).alias("output_text"))


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = exploded(corpus(spark, sf_dir), KEY, names.name_words(F.col("text")), "w")
    return words.select(*KEY, "w.line", "w.word", "w.capitalised", "w.all_caps", "w.sentence_start")


def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.common_words_of(table(spark, sf_dir, "documents"))


def _detectors(texts: DataFrame) -> list[pipeline.Detector]:
    """The name detector with the ordinary words of the texts themselves."""
    return [names.dictionary_detector(names.fitted_words(texts))]


def names_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir)
    found = exploded(texts, KEY, _detectors(texts)[0](F.col("text")))
    return found.select(*KEY, "d.start", "d.end", "d.entity_type", "d.matched_text")


def detect_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir)
    return pipeline.detection_rows(pipeline.detect(texts, detectors=_detectors(texts)), KEY)


def person_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir)
    return pipeline.detection_rows(pipeline.detect(texts, detectors=_detectors(texts)), KEY, context=False).where("rule_name = 'Global match'")


def anonymise_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir)
    return pipeline.anonymise(texts, detectors=_detectors(texts)).select(*KEY, F.size("detections").alias("detections"), "output_text")


def anonymise_with_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = resolve.current_mappings(table(spark, sf_dir, "mappings"))
    return pipeline.anonymise_with_stores(docs, "doc_id", stored, table(spark, sf_dir, "ignored_entities"), detectors=_detectors(corpus(spark, sf_dir))).select("doc_id", "accepted", "output_text")


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.detect(table(spark, sf_dir, "scan_results").select("scan_id", "path", "text"), detectors=_detectors(corpus(spark, sf_dir)))
    with_context = F.transform("detections", lambda d: rules.with_context(d, F.col("text")))
    return found.select("scan_id", tables.report_json(F.col("path"), with_context).alias("report"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "scan_results").select("error", F.coalesce(F.size(spans.merge_spans(rules.scan_rules(F.col("text")))), F.lit(0)).alias("accepted"))
    return tables.batch_summary(f)


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_results").select("scan_id", pages.clean_extracted_text(F.col("text")).alias("text"))


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_results").select("scan_id", F.posexplode(pages.split_pages(F.col("text"))).alias("page", "page_text"))


def wrap_paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.wrap_and_paginate(table(spark, sf_dir, "documents"))


def cells_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.anonymise_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], CELL_PAIRS)


def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mappings").select("mapping_id", tables.row_text(["store", "original", "replacement"]).alias("line"))


def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words of the documents, put as token labels and decoded again."""
    big = lambda w: w["matched_text"].rlike("^[A-Z]")

    def decoded(words: F.Column) -> F.Column:
        after_big = F.concat(F.array(F.lit(False)), F.transform(words, big))
        labels = F.zip_with(words, F.slice(after_big, 1, F.size(words)), lambda w, after: F.when(big(w) & after, 2).when(big(w), 1).otherwise(0))
        return pages.decode_bio(F.col("text"), labels, F.transform(words, lambda w: F.struct(w["start"], w["end"])), F.array(F.lit("O"), F.lit("B-PER"), F.lit("I-PER")))

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return exploded(spread(docs.select("doc_id", "text")), ["doc_id"], let(match_spans(F.col("text"), r"[^ \n]+"), decoded)).select("doc_id", "d.start", "d.end", "d.entity_type", "d.matched_text")


def _hocr() -> F.Column:
    text = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    box = F.format_string("bbox %d %d %d %d; x_wconf 90", F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    return F.concat(F.lit("<span class='ocrx_word' title='"), box, F.lit("'>"), text, F.lit("</span>"))


def hocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "ocr_words").where("text IS NOT NULL")
    return exploded(w, ["word_id"], pages.parse_hocr(_hocr()), "p").select("word_id", "p.text", "p.x", "p.y", "p.w", "p.h")


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "ocr_words").where("text IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "word_id", "text", "w", "h")))
    return w.groupBy("scan_id", "page").agg(ordered.alias("words"))


def page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = pages.page_matches(F.col("words.text"), F.lit(PHRASE))
    n = F.lit(len(PHRASE.split()))
    found = exploded(_page_words(spark, sf_dir), ["scan_id", "page", "words"], at, "at")
    return found.select("scan_id", "page", "at", pages.redaction_box(F.col("words"), F.col("at"), n).alias("b")).select("scan_id", "page", "at", "b.x", "b.y", "b.w", "b.h")


def page_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_words(spark, sf_dir).select("scan_id", "page", pages.is_rotated(F.col("words")).alias("rotated"))


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf_dir, "scan_results").select("scan_id", sources.file_type(p).alias("file_type"), sources.is_supported(p).alias("supported"))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf_dir, "scan_results").select("scan_id", tables.output_path(p).alias("beside"), tables.output_path(p, "{name}.{ext}.txt", "/out").alias("elsewhere"))


def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "scan_results").select("path", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("length"))
    return tables.storage_usage(f)


def detections_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "detections")
    return d.groupBy(F.date_format(F.window("detected_at", "1 day").start, "yyyy-MM-dd").alias("day"), "entity_type").agg(F.count("*").alias("detections"))


def _slug(name: str) -> str:
    return "rule_" + "_".join("".join(c if c.isalnum() else " " for c in name.lower().replace("'", "")).split())


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {_slug(r.name): _rule(r) for r in rules.BUILT_IN}
    for f in (phone_toll_free, address_garbage, rule_table, custom_rule_scan, pattern_test, detections_by_type, detections_per_text, texts_with_pii, context_snippets, offset_units, merged_spans):
        found[f.__name__] = f
    found["fnv1a_hash"] = lambda spark, sf_dir: _originals(spark, sf_dir).select("mapping_id", covers.fnv1a(F.col("original")).cast("string").alias("hash"))
    for kind in ("name", "phone", "ssn", "email", "account", "address"):
        found[f"cover_{kind}"] = _cover(getattr(covers, f"cover_{kind}"), "cover")
    for f in (
        cover_value, ignore_filter, current_mappings, resolve_stored, resolve_generated, mapping_upsert, mapping_remove, ignore_add, ignore_remove, review_decisions, rewrite_mails, name_words, common_words,
        names_dictionary, detect_pii, person_propagation, anonymise_texts, anonymise_with_stores, scan_report, batch_summary, clean_text, page_split, wrap_paginate, cells_replaced, row_texts, bio_decode, hocr_words,
        page_matches, page_rotation, file_types, output_paths, storage_usage, detections_daily,
    ):
        found[f.__name__] = f
    return found


# ---- SQL ----------------------------------------------------------------------------------------------------------

_CORPUS = "corpus AS (SELECT 'document' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'file', scan_id, text FROM scan_results)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(pattern: str, source: str = "corpus", key: str = "src, id") -> str:
    """A select of key, start, end, matched_text, text of all matches."""
    return f"""
SELECT {key}, text, (off + before)::INT AS "start", (off + before + length(hit))::INT AS "end", hit AS matched_text FROM (
  SELECT {key}, text, ms[i] AS hit, list_sum(list_transform(gs[1:i], lambda x: length(x))) AS off, coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS before FROM (
    SELECT {key}, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT {key}, text, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gs FROM {source} WHERE text IS NOT NULL)))"""


_TOLL_FREE = "(CASE WHEN length(d) = 11 AND d[1] = '1' THEN d[2:4] WHEN length(d) >= 10 THEN d[1:3] ELSE '' END) IN (" + ", ".join(map(_q, rules.TOLL_FREE)) + ")"


def _toll_free_sql(value: str) -> str:
    return _TOLL_FREE.replace("(d)", "(regexp_replace(" + value + ", '[^0-9]', '', 'g'))").replace("d[", "(regexp_replace(" + value + ", '[^0-9]', '', 'g'))[")


def _garbage_sql(value: str) -> str:
    return f"(regexp_matches({value}, '[^\\x00-\\x7F]') OR 2 * length(regexp_replace({value}, '[-A-Za-z0-9 ,.#]', '', 'g')) > length({value}))"


_ORDERS = """orders_ AS (SELECT o_orderkey AS id, 'Customer ' || o_custkey::VARCHAR || ', D.O.B. ' || strftime(o_orderdate, '%m/%d/%Y') || '; routing #' || lpad(o_orderkey::VARCHAR, 9, '0') || ' or birthday ' || strftime(o_orderdate, '%m/%d/%Y') AS text FROM orders),
more AS (SELECT * FROM corpus UNION ALL SELECT 'order', id, text FROM orders_)"""


def _rule_sql(rule: rules.Rule, source: str = "corpus") -> str:
    inner = _spans_sql(_q(rule.pattern), source)
    keep = {"PHONE": f"WHERE NOT {_toll_free_sql('matched_text')}", "ADDRESS": f"WHERE NOT {_garbage_sql('matched_text')}"}.get(rule.entity_type, "")
    return f'SELECT src, id, "start", "end", matched_text FROM ({inner}) {keep}'


def _all_rules_sql() -> str:
    each = [f'SELECT *, {_q(r.entity_type)} AS entity_type, {_q(r.name)} AS rule_name, {i} AS ord FROM ({_rule_sql(r)})' for i, r in enumerate(rules.BUILT_IN)]
    return f"WITH {_CORPUS}, found AS (" + " UNION ALL ".join(each) + ") "


_HASH = """
h AS (SELECT mapping_id, original, entity_type, list_reduce(list_transform(regexp_extract_all(hex(encode(original)), '..'), lambda b: ((strpos('0123456789ABCDEF', b[1]) - 1) * 16 + strpos('0123456789ABCDEF', b[2]) - 1)::HUGEINT),
  lambda s, b: ((s - s % 256 + xor((s % 256)::INT, b::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM mappings WHERE original IS NOT NULL)
"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _cover_sqls() -> dict[str, str]:
    first, last = f"{_list(covers.FIRST_NAMES)}[(h % 50 + 1)::INT]", f"{_list(covers.LAST_NAMES)}[((h // 50) % 50 + 1)::INT]"
    pad = lambda x, n: f"lpad(({x})::VARCHAR, {n}, '0')"
    street = f"((h % 900) + 100)::VARCHAR || ' ' || {_list(covers.STREETS)}[((h // 1000) % 15 + 1)::INT] || ' ' || {_list(covers.STREET_TYPES)}[((h // 100000) % 9 + 1)::INT]"
    unit = "CASE WHEN regexp_matches(upper(original), 'APT|UNIT|STE') THEN ' Apt ' || ((h % 20) + 1)::VARCHAR ELSE '' END"
    city = f"{_list(covers.CITIES)}[(h % 15 + 1)::INT] || ', ' || {_list(covers.STATES)}[((h // 15) % 15 + 1)::INT] || ' ' || (((h // 100) % 90000) + 10000)::VARCHAR"
    placed = f"(regexp_matches(original, '{'|'.join(covers.STATES)}') OR length(regexp_replace(original, '[^0-9]', '', 'g')) >= 5) AND NOT regexp_matches(original, '^[\\s\\p{{Z}}]*[0-9]+([\\s\\p{{Z}}]|$)')"
    digit = "list_reduce(list_transform(string_split(original, ''), lambda c: {'c': c, 's': h, 'o': ''}), lambda a, b: CASE WHEN regexp_matches(b.c, '^[0-9]$') THEN {'c': '', 's': a.s // 10, 'o': a.o || (a.s % 10)::VARCHAR} ELSE {'c': '', 's': a.s, 'o': a.o || b.c} END, {'c': '', 's': h, 'o': ''}).o"
    return {
        "name": f"{first} || ' ' || {last}",
        "phone": "'(555) 555-' || " + pad("h % 10000", 4),
        "ssn": "'900-' || " + pad("h % 100", 2) + " || '-' || " + pad("(h // 100) % 10000", 4),
        "email": f"lower({first}) || '.' || lower({last}) || '@example.com'",
        "account": digit,
        "address": f"CASE WHEN {placed} THEN {city} ELSE {street} || {unit} END",
    }


_SPACE = r"[^\s\p{Z}\x{85}\x0B]+"


def _names_sql() -> str:
    """CTEs up to ``named(src, id, start, end, matched_text, entity_type, rule_name, ord)``: words as letters, shapes by folding."""
    listed = lambda words: "(" + ", ".join(map(_q, sorted(words))) + ")"
    lines = """lines_ AS (SELECT src, id, line, text, (sum(length(text) + 1) OVER (PARTITION BY src, id ORDER BY line) - length(text) - 1)::INT AS base
  FROM (SELECT src, id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM corpus WHERE text IS NOT NULL))"""
    return rf"""fitted AS (SELECT word FROM (SELECT lower(w) AS word, count(*) FILTER (WHERE w = lower(w)) AS low, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM corpus) GROUP BY 1) WHERE low >= 3 AND 2 * low > n AND n > low ORDER BY low DESC, word LIMIT {names.MAX_FITTED}),
{lines},
raw_ AS ({_spans_sql(_q(_SPACE), "lines_", "src, id, line, base")}),
word_ AS (SELECT src, id, line, base, text, "start" AS s, regexp_replace(matched_text, '[[:punct:]]+$', '') AS w, coalesce(regexp_matches(lag(matched_text) OVER (PARTITION BY src, id, line ORDER BY "start"), '[.!?]$'), true) AS fresh FROM raw_),
flag_ AS (SELECT *, lower(w) IN {listed(names.FUNCTION_WORDS)} OR lower(w) IN (SELECT word FROM fitted) AS known, lower(w) IN {listed(names.ORGANISATION_WORDS)} AS org, regexp_matches(w, '^\p{{Lu}}') AND strlen(w) > 1 AS big FROM word_ WHERE w <> ''),
letter_ AS (SELECT src, id, line, any_value(base) AS base, any_value(text) AS text, list(s ORDER BY s) AS ss, list(s + length(w) ORDER BY s) AS ee, count(*) AS n,
  string_agg(CASE WHEN big AND NOT known THEN CASE WHEN fresh THEN CASE WHEN org THEN 'O' ELSE 'C' END WHEN org THEN 'o' ELSE 'c' END ELSE '.' END, '' ORDER BY s) AS t,
  string_agg(CASE WHEN regexp_matches(w, '^[A-Z]{{2,}}$') AND regexp_matches(w, '[AEIOU]') THEN CASE WHEN known THEN CASE WHEN org THEN 'g' ELSE 'f' END WHEN org THEN 'o' ELSE 'x' END ELSE '.' END, '' ORDER BY s) AS k,
  string_agg(CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'd' WHEN big THEN 'C' ELSE '.' END, '' ORDER BY s) AS a FROM flag_ GROUP BY src, id, line),
size_ AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN regexp_matches(t[i:i+2], '^c[cC][cC]') THEN 3 WHEN regexp_matches(t[i:i+2], '^c[cC]($|[^cCoO])') THEN 2 WHEN regexp_matches(k[i:i+2], '^[xf]xx') THEN 3 WHEN regexp_matches(k[i:i+2], '^[xf]x($|[^xo])') THEN 2 ELSE 0 END) AS m,
  list_transform(range(1, n + 1), lambda i: CASE WHEN regexp_matches(a[i:i+1], '^dC') THEN 1 + length(regexp_extract(a[i+1:i+3], '^C+')) ELSE 0 END) AS d FROM letter_ WHERE n > 1),
shape_ AS (SELECT *, list_reduce(list_transform(range(1, n + 1), lambda i: {{'i': i, 'x': 1::BIGINT, 'o': []::BIGINT[]}}), lambda p, q: CASE WHEN q.i < p.x OR m[q.i] = 0 THEN {{'i': q.i, 'x': p.x, 'o': p.o}} ELSE {{'i': q.i, 'x': q.i + m[q.i], 'o': list_append(p.o, q.i)}} END, {{'i': 0::BIGINT, 'x': 1::BIGINT, 'o': []::BIGINT[]}}).o AS ni, list_filter(range(1, n + 1), lambda i: d[i] > 0) AS ai FROM size_),
place_ AS (SELECT src, id, line, base, text, 1 AS kind, i, ss[i] AS s, ee[i + m[i] - 1] AS e FROM (SELECT *, unnest(ni) AS i FROM shape_) UNION ALL SELECT src, id, line, base, text, 2, i, ss[i], ee[i + d[i] - 1] FROM (SELECT *, unnest(ai) AS i FROM shape_)),
kept_ AS (SELECT *, text[s + 1:e] AS v FROM place_ WHERE NOT regexp_matches(text[s + 1:e], CASE WHEN kind = 1 THEN '[^\x00-\x7F]|[.&]|XXXX|xxxx' ELSE '[^\x00-\x7F]|&' END)),
named AS (SELECT src, id, (base + s)::INT AS "start", (base + e)::INT AS "end", v AS matched_text, CASE kind WHEN 1 THEN 'PERSON' ELSE 'ADDRESS' END AS entity_type, {_q(names.RULE_NAME)} AS rule_name, {names.AFTER_RULES} + row_number() OVER (PARTITION BY src, id ORDER BY line, kind, i) AS ord FROM kept_)"""


def _merge_sql(source: str) -> str:
    return f"""SELECT src, id, u.s AS "start", u.e AS "end", u.m AS matched_text, u.t AS entity_type, u.r AS rule_name, u.o AS ord FROM (SELECT src, id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN x[1].s >= acc[-1].e THEN list_concat(acc, x) WHEN strlen(x[1].m) > strlen(acc[-1].m) THEN list_concat(acc[1:-2], x) ELSE acc END)) AS u
  FROM (SELECT src, id, list({{'s': "start", 'e': "end", 'm': matched_text, 't': entity_type, 'r': rule_name, 'o': ord}} ORDER BY "start", "end" DESC, ord) AS l FROM {source} GROUP BY src, id))"""


def _detected_sql() -> str:
    """The whole detection as CTEs up to ``detected``, the first of them opening the WITH."""
    every = _all_rules_sql().rstrip()
    pair = "(SELECT src, id, text, CASE WHEN length(lower(text)) = length(text) THEN lower(text) ELSE text END AS low, length(lower(text)) = length(text) AS same FROM corpus WHERE text IS NOT NULL)"
    return every + f""", {_names_sql()},
both_ AS (SELECT src, id, "start", "end", matched_text, entity_type, rule_name, ord FROM found UNION ALL SELECT src, id, "start", "end", matched_text, entity_type, rule_name, ord FROM named),
merged_ AS ({_merge_sql('both_')}),
person_ AS (SELECT DISTINCT c.src, c.id, c.text, c.low, CASE WHEN c.same THEN lower(m.matched_text) ELSE m.matched_text END AS name FROM merged_ m JOIN {pair} c ON m.src = c.src AND m.id = c.id WHERE m.entity_type = 'PERSON' AND m.matched_text <> ''),
cut_ AS (SELECT src, id, text, name, p, unnest(range(1, len(p))) AS k FROM (SELECT *, string_split(low, name) AS p FROM person_)),
at_ AS (SELECT src, id, text, name, (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(name))::INT AS s FROM cut_),
extra_ AS (SELECT src, id, s AS "start", (s + length(name))::INT AS "end", text[s + 1:s + length(name)] AS matched_text, 'PERSON' AS entity_type, 'Global match' AS rule_name, 1000 AS ord FROM at_ a WHERE NOT EXISTS (SELECT 1 FROM merged_ m WHERE m.src = a.src AND m.id = a.id AND m."start" <= a.s AND m."end" >= a.s + length(a.name))),
all_ AS (SELECT * FROM merged_ UNION ALL SELECT * FROM extra_),
detected AS ({_merge_sql('all_')})"""


def _rewritten_sql(made: str, source: str, key: str) -> str:
    """``out(key, n, output_text)`` of ``source(key, start, end, cover)``, as CTEs."""
    return f"""piece AS (SELECT d.{key}, d."start", d."end", c.text[coalesce(lag(d."end") OVER w, 0) + 1:d."start"] || d.cover AS p FROM {source} d JOIN {made} c ON d.{key} = c.{key} WINDOW w AS (PARTITION BY d.{key} ORDER BY d."start")),
out_ AS (SELECT {key}, string_agg(p, '' ORDER BY "start") AS p, max("end") AS e, count(*) AS n FROM piece GROUP BY {key}),
out AS (SELECT c.{key}, coalesce(o.n, 0)::INT AS n, CASE WHEN o.n IS NULL THEN c.text ELSE o.p || c.text[o.e + 1:] END AS output_text FROM {made} c LEFT JOIN out_ o ON c.{key} = o.{key})"""


def _page_sqls() -> dict[str, str]:
    goes = "(({0} = 1 OR c[{0} - 1] IN (' ', chr(9), chr(10), chr(13), chr(12))) AND regexp_matches(c[{0}], '^[A-Z0-9]$') AND c[{0} + 2] = c[{0}] AND ({0} + 2 = len(c) OR regexp_matches(c[{0} + 3], '^[A-Za-z0-9]$')))"
    here, before = goes.format("j"), goes.format("(j - 1)")
    clean = f"""WITH t AS (SELECT scan_id, text, string_split(text, '') AS c FROM scan_results)
SELECT scan_id, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN '' ELSE array_to_string(list_transform(range(1, len(c) + 1), lambda j: CASE WHEN {here} AND c[j + 1] IN (' ', chr(10)) THEN '' WHEN j > 1 AND c[j] = ' ' AND {before} THEN '' ELSE c[j] END), '') END AS text FROM t"""
    wrap = rf"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text[-1] = chr(10) THEN text[:-2] ELSE text END AS body FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS s, generate_subscripts(string_split(body, chr(10)), 1) AS ln FROM d),
w AS (SELECT doc_id, ln, 0 AS k, CASE WHEN s[-1] = chr(13) THEN s[:-2] ELSE s END AS rest, NULL::VARCHAR AS chunk FROM l
  UNION ALL SELECT doc_id, ln, k + 1, rest[a + 1:], regexp_replace(rest[1:a], '[\s\p{{Z}}]+$', '') FROM (SELECT *, CASE WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') + 1 ELSE length(h) END AS a
    FROM (SELECT *, rest[1:list_max(list_filter(range(1, {pages.LINE_BYTES} + 1), lambda j: strlen(rest[1:j]) <= {pages.LINE_BYTES}))] AS h FROM w WHERE strlen(rest) > {pages.LINE_BYTES}))),
c AS (SELECT doc_id, ln, k, chunk AS content FROM w WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, ln, k + 1, rest FROM w WHERE strlen(rest) <= {pages.LINE_BYTES} AND (rest <> '' OR k = 0)),
n AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1 AS i FROM c)
SELECT doc_id, (i // {pages.PAGE_LINES})::INT AS page, (i % {pages.PAGE_LINES})::INT AS line, content FROM n"""
    return {"clean_text": clean, "wrap_paginate": wrap}


def oracle_sql() -> dict[str, str]:
    sql = {_slug(r.name): f"WITH {_CORPUS}, {_ORDERS} {_rule_sql(r, 'more')}" if r.name in ON_ORDERS else f"WITH {_CORPUS} {_rule_sql(r)}" for r in rules.BUILT_IN}
    phone = _q(_by_name("Phone (US)").pattern)
    mail = _q(_by_name("Email").pattern)
    mails = f"WITH {_CORPUS}, m AS ({_spans_sql(mail)})"
    sql["phone_toll_free"] = f'WITH {_CORPUS} SELECT src, id, "start", matched_text, {_toll_free_sql("matched_text")} AS toll_free FROM ({_spans_sql(phone)})'
    sql["address_garbage"] = f"SELECT det_id, {_garbage_sql('matched_text')} AS garbage FROM detections WHERE entity_type = 'ADDRESS'"
    sql["rule_table"] = "SELECT * FROM (VALUES " + ", ".join(f"({_q(r.name)}, {_q(r.entity_type)}, {_q(r.pattern)}, true, true)" for r in rules.BUILT_IN) + ") AS t(name, entity_type, pattern, enabled, built_in)"
    # matches are marked in the text, as splitting by a pattern that can be empty would lose the places
    sql["custom_rule_scan"] = rf"""WITH {_CORPUS}, r AS (SELECT name, pattern FROM rules WHERE enabled AND pattern IS NOT NULL),
t AS (SELECT src, id, name, string_split(regexp_replace(text, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS p FROM corpus, r WHERE text IS NOT NULL),
m AS (SELECT src, id, name, p, unnest(range(2, len(p) + 1)) AS k FROM t),
f AS (SELECT src, id, name AS rule_name, (list_sum(list_transform(p[1:k-1], lambda x: length(x))) - (k - 2))::INT AS "start", string_split(p[k], chr(2))[1] AS matched_text FROM m)
SELECT src, id, rule_name, "start", ("start" + length(matched_text))::INT AS "end", matched_text FROM f WHERE matched_text <> ''"""
    sql["pattern_test"] = f"""WITH {_CORPUS} SELECT src, id, 'TEST' AS entity_type, "start", "end", matched_text FROM ({_spans_sql(_q(MEMBER))})"""
    every = _all_rules_sql()
    sql["detections_by_type"] = every + 'SELECT entity_type, rule_name, count(*) AS detections, count(DISTINCT matched_text) AS "values" FROM found GROUP BY 1, 2'
    sql["detections_per_text"] = every + "SELECT c.src, c.id, count(f.id)::INT AS detections FROM corpus c LEFT JOIN found f ON c.src = f.src AND c.id = f.id GROUP BY 1, 2"
    sql["texts_with_pii"] = every + "SELECT src, count(*) AS texts, count(n) AS with_pii FROM (SELECT c.src, c.id, f.n FROM corpus c LEFT JOIN (SELECT src, id, count(*) AS n FROM found GROUP BY 1, 2) f ON c.src = f.src AND c.id = f.id) GROUP BY 1"
    head = 'text[1:"start"]'
    tail = 'text["end" + 1:]'
    near = lambda side, right: f"coalesce(list_min(list_filter(range(1, 41), lambda k: strlen({'right' if right else 'left'}({side}, k)) >= 40)), length({side}))"
    sql["context_snippets"] = mails + f""", k AS (SELECT *, {head} AS a, {tail} AS b FROM m), n AS (SELECT *, {near('a', True)} AS ka, {near('b', False)} AS kb FROM k)
SELECT src, id, "start", CASE WHEN ka < length(a) THEN '...' ELSE '' END || right(a, ka) || matched_text || left(b, kb) || CASE WHEN kb < length(b) THEN '...' ELSE '' END AS context FROM n"""
    sql["offset_units"] = mails + f"""SELECT src, id, "start", strlen({head})::INT AS start_byte, ("start" + length(regexp_replace({head}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INT AS start_utf16 FROM m"""
    sql["merged_spans"] = every + """, l AS (SELECT src, id, list({'s': "start", 'e': "end", 'r': rule_name, 'm': matched_text} ORDER BY "start", "end" DESC, ord) AS l FROM found GROUP BY 1, 2),
g AS (SELECT src, id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN x[1].s >= acc[-1].e THEN list_concat(acc, x) WHEN strlen(x[1].m) > strlen(acc[-1].m) THEN list_concat(acc[1:-2], x) ELSE acc END) AS k FROM l)
SELECT src, id, u.s AS "start", u.e AS "end", u.r AS rule_name, u.m AS matched_text FROM (SELECT src, id, unnest(k) AS u FROM g)"""
    sql["fnv1a_hash"] = f"WITH {_HASH} SELECT mapping_id, h::VARCHAR AS hash FROM h"
    made = _cover_sqls()
    for kind, expr in made.items():
        sql[f"cover_{kind}"] = f"WITH {_HASH} SELECT mapping_id, {expr} AS cover FROM h"
    by_type = f"CASE entity_type WHEN 'PHONE' THEN {made['phone']} WHEN 'SSN' THEN {made['ssn']} WHEN 'EMAIL' THEN {made['email']} WHEN 'ACCOUNT_NUMBER' THEN {made['account']} WHEN 'CREDIT_CARD' THEN {made['account']} WHEN 'ADDRESS' THEN {made['address']} ELSE {made['name']} END"
    sql["cover_value"] = f"WITH {_HASH} SELECT mapping_id, {by_type} AS cover FROM h"
    sql["ignore_filter"] = "SELECT det_id, matched_text FROM detections WHERE NOT EXISTS (SELECT 1 FROM ignored_entities i WHERE lower(i.text) = lower(matched_text))"
    current = "c AS (SELECT original, replacement AS stored FROM (SELECT original, replacement, row_number() OVER (PARTITION BY original ORDER BY coalesce(last_used, created) DESC, created DESC, replacement DESC) AS n FROM mappings WHERE original IS NOT NULL AND replacement IS NOT NULL) WHERE n = 1)"
    sql["current_mappings"] = f"WITH {current} SELECT original, stored FROM c"
    texts = "d AS (SELECT DISTINCT matched_text AS original, entity_type FROM detections), "
    hashed = _HASH.replace("mapping_id, original, entity_type", "original, entity_type").replace("FROM mappings WHERE original IS NOT NULL", "FROM d WHERE original IS NOT NULL")
    covered = f"v AS (SELECT original, entity_type, {by_type} AS cover FROM h)"
    back = "LEFT JOIN v ON t.matched_text = v.original AND t.entity_type IS NOT DISTINCT FROM v.entity_type"
    sql["resolve_generated"] = f"WITH {texts}{hashed}, {covered} SELECT det_id, cover AS replacement, false AS accepted FROM detections t {back}"
    sql["resolve_stored"] = f"WITH {texts}{hashed}, {covered}, {current} SELECT det_id, coalesce(c.stored, cover) AS replacement, false AS accepted FROM detections t {back} LEFT JOIN c ON t.matched_text = c.original"
    sql["mapping_upsert"] = f"""WITH s AS (SELECT original, replacement, entity_type, created, last_used FROM mappings QUALIFY row_number() OVER (PARTITION BY original ORDER BY mapping_id) = 1),
u AS (SELECT matched_text AS original, rule_name AS replacement, entity_type FROM detections WHERE matched_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY matched_text ORDER BY det_id DESC) = 1)
SELECT coalesce(u.original, s.original) AS original, CASE WHEN u.original IS NOT NULL THEN u.replacement ELSE s.replacement END AS replacement, CASE WHEN u.original IS NOT NULL THEN u.entity_type ELSE s.entity_type END AS entity_type,
  epoch_us(coalesce(s.created, TIMESTAMPTZ '2026-01-01 00:00:00+00'))::VARCHAR AS created, epoch_us(CASE WHEN u.original IS NOT NULL THEN TIMESTAMPTZ '2026-01-01 00:00:00+00' ELSE s.last_used END)::VARCHAR AS last_used FROM s FULL JOIN u ON s.original = u.original"""
    sql["mapping_remove"] = "SELECT mapping_id FROM mappings WHERE NOT EXISTS (SELECT 1 FROM ignored_entities i WHERE i.text = original)"
    sql["ignore_add"] = """SELECT lower(text) AS text, entity_type, reason FROM ignored_entities UNION ALL
SELECT DISTINCT lower(original), 'ORG', 'store' FROM mappings WHERE entity_type = 'ORG' AND original IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ignored_entities i WHERE lower(i.text) = lower(original))"""
    sql["ignore_remove"] = "SELECT ignore_id FROM ignored_entities i WHERE NOT EXISTS (SELECT 1 FROM mappings m WHERE m.entity_type = 'ORG' AND lower(m.original) = lower(i.text))"
    sql["review_decisions"] = "SELECT det_id AS det_key, CASE WHEN entity_type = 'ADDRESS' THEN '[place]' ELSE rule_name END AS replacement, CASE WHEN entity_type IN ('PERSON', 'ADDRESS') THEN true WHEN entity_type = 'ORG' THEN false END AS accepted FROM detections"
    sql["rewrite_mails"] = f"WITH {_CORPUS} SELECT src, id, regexp_replace(text, {mail}, '[mail]', 'g') AS output_text FROM corpus WHERE text IS NOT NULL"
    space = r"[^\s\p{Z}\x{85}\x0B]+"
    sql["name_words"] = rf"""WITH {_CORPUS}, l AS (SELECT src, id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM corpus),
r AS (SELECT src, id, line, w, unnest(w) AS raw, generate_subscripts(w, 1) AS i FROM (SELECT src, id, line, regexp_extract_all(s, '{space}') AS w FROM l)),
p AS (SELECT src, id, line::INT AS line, regexp_replace(raw, '[[:punct:]]+$', '') AS word, CASE WHEN i = 1 THEN true ELSE regexp_matches(w[i-1], '[.!?]$') END AS sentence_start FROM r)
SELECT src, id, line, word, regexp_matches(word, '^\p{{Lu}}') AND strlen(word) > 1 AS capitalised, regexp_matches(word, '^[A-Z]{{2,}}$') AS all_caps, sentence_start FROM p WHERE word <> ''"""
    sql["common_words"] = r"WITH w AS (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) SELECT lower(w) AS word FROM w GROUP BY 1 HAVING count(*) FILTER (WHERE w = lower(w)) >= 3 AND 2 * count(*) FILTER (WHERE w = lower(w)) > count(*)"
    detected = _detected_sql()
    sql["names_dictionary"] = f'WITH {_CORPUS}, {_names_sql()} SELECT src, id, "start", "end", entity_type, matched_text FROM named'
    bytes_ = f', b AS (SELECT d.*, c.text, strlen(c.{head})::INT AS start_byte, (strlen(c.{head}) + strlen(d.matched_text))::INT AS end_byte FROM detected d JOIN corpus c ON d.src = c.src AND d.id = c.id)'
    framed = f""", k AS (SELECT *, {head} AS a, {tail} AS z FROM b), n AS (SELECT *, {near('a', True)} AS ka, {near('z', False)} AS kb FROM k),
r AS (SELECT *, CASE WHEN ka < length(a) THEN '...' ELSE '' END || right(a, ka) || matched_text || left(z, kb) || CASE WHEN kb < length(z) THEN '...' ELSE '' END AS context FROM n)"""
    cols = 'matched_text, entity_type, rule_name, "start", "end"'
    sql["detect_pii"] = f"{detected}{bytes_}{framed} SELECT src, id, {cols}, context, start_byte, end_byte FROM r"
    sql["person_propagation"] = f"{detected}{bytes_} SELECT src, id, {cols}, start_byte, end_byte FROM b WHERE rule_name = 'Global match'"
    item = """{'entity_type': entity_type, 'matched_text': matched_text, 'rule_name': rule_name, 'start': "start", 'end': "end", 'context': context}"""
    sql["scan_report"] = f"""{detected}{bytes_}{framed}, g AS (SELECT id, to_json(list({item} ORDER BY "start"))::VARCHAR AS j FROM r WHERE src = 'file' GROUP BY id)
SELECT scan_id, '{{"file":' || to_json(path)::VARCHAR || ',"detections":' || coalesce(j, '[]') || '}}' AS report FROM scan_results LEFT JOIN g ON g.id = scan_id"""
    valued = _HASH.replace("mapping_id, original, entity_type", "original, entity_type").replace("FROM mappings WHERE original IS NOT NULL", "FROM (SELECT DISTINCT matched_text AS original, entity_type FROM detected)")
    covered_ = f"{detected}, {valued}, v AS (SELECT original, entity_type, {by_type} AS cover FROM h)"
    keyed = "said AS (SELECT src || id::VARCHAR AS key, text FROM corpus)"
    inline = """, dc AS (SELECT d.src || d.id::VARCHAR AS key, d."start", d."end", v.cover FROM detected d JOIN v ON d.matched_text = v.original AND d.entity_type = v.entity_type)"""
    sql["anonymise_texts"] = f"{covered_}{inline}, {keyed}, {_rewritten_sql('said', 'dc', 'key')} SELECT c.src, c.id, o.n AS detections, o.output_text FROM corpus c JOIN out o ON c.src || c.id::VARCHAR = o.key"
    kept = """, dc AS (SELECT d.id AS key, d."start", d."end", coalesce(c.stored, v.cover) AS cover FROM detected d JOIN v ON d.matched_text = v.original AND d.entity_type = v.entity_type LEFT JOIN c ON c.original = d.matched_text
  WHERE d.src = 'document' AND NOT EXISTS (SELECT 1 FROM ignored_entities i WHERE lower(i.text) = lower(d.matched_text))), said AS (SELECT doc_id AS key, text FROM documents)"""
    sql["anonymise_with_stores"] = f"{covered_}, {current}{kept}, {_rewritten_sql('said', 'dc', 'key')} SELECT key AS doc_id, n AS accepted, output_text FROM out"
    sql |= _page_sqls()
    sql["batch_summary"] = every + f", s AS ({_merge_sql('found')}), q AS (SELECT id, count(*) AS n FROM s WHERE src = 'file' GROUP BY id) SELECT status, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS detections FROM (SELECT coalesce(n, 0) AS n, CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(n, 0) = 0 THEN 'skipped' ELSE 'success' END AS status FROM scan_results LEFT JOIN q ON q.id = scan_id) GROUP BY 1"
    sql["page_split"] = r"SELECT scan_id, unnest(p) AS page_text, (generate_subscripts(p, 1) - 1)::INT AS page FROM (SELECT scan_id, string_split(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10)) AS p FROM scan_results)"
    nested = lambda c: (e := c) and [e := f"replace({e}, {_q(a)}, {_q(b)})" for a, b in CELL_PAIRS][-1]
    sql["cells_replaced"] = f"SELECT c_custkey, {nested('c_name')} AS c_name, {nested('c_mktsegment')} AS c_mktsegment FROM customer"
    sql["row_texts"] = "SELECT mapping_id, coalesce(store, '') || chr(9) || coalesce(original, '') || chr(9) || coalesce(replacement, '') AS line FROM mappings"
    words = _spans_sql("'[^ \\n]+'", "documents", "doc_id")
    sql["bio_decode"] = rf"""WITH w AS ({words}), f AS (SELECT *, regexp_matches(matched_text, '^[A-Z]') AS big, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS i FROM w),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, big ORDER BY i) AS run FROM f),
e AS (SELECT doc_id, any_value(text) AS text, min("start") AS "start", max("end") AS "end" FROM g WHERE big GROUP BY doc_id, run),
m AS (SELECT doc_id, "start", "end", 'PERSON' AS entity_type, text["start" + 1:"end"] AS matched_text FROM e)
SELECT * FROM m WHERE strlen(regexp_replace(matched_text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) >= 5 AND (contains(matched_text, ' ') OR regexp_matches(matched_text, '^.\p{{Ll}}*$') OR NOT regexp_matches(matched_text, '\p{{Ll}}'))"""
    sql["hocr_words"] = "SELECT word_id, trim(text) AS text, x, y, w, h FROM ocr_words WHERE trim(text) <> ''"
    order = "(PARTITION BY scan_id, page ORDER BY y, x, word_id)"
    sql["page_matches"] = f"""WITH o AS (SELECT *, row_number() OVER {order} - 1 AS i, lead(text) OVER {order} AS t2, lead(x) OVER {order} AS x2, lead(y) OVER {order} AS y2, lead(w) OVER {order} AS w2, lead(h) OVER {order} AS h2 FROM ocr_words WHERE text IS NOT NULL),
b AS (SELECT scan_id, page, i::INT AS "at", greatest(least(x, x2) - 4, 0) AS l, greatest(least(y, y2) - 4, 0) AS t, greatest(x + w, x2 + w2) + 4 AS r, greatest(y + h, y2 + h2) + 4 AS d FROM o WHERE lower(text) || ' ' || lower(t2) = {_q(PHRASE)})
SELECT scan_id, page, "at", l AS x, t AS y, r - l AS w, d - t AS h FROM b"""
    sql["page_rotation"] = "SELECT scan_id, page, count(*) FILTER (WHERE h > 2 * w) * 3 > count(*) AS rotated FROM ocr_words WHERE text IS NOT NULL GROUP BY 1, 2"
    ext = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"
    sql["file_types"] = f"SELECT scan_id, CASE WHEN {ext} = 'pdf' THEN 'Pdf' WHEN {ext} IN ('xlsx', 'xls') THEN 'Xlsx' WHEN {ext} IN ('png', 'jpg', 'jpeg', 'tiff', 'tif', 'bmp') THEN 'Image' ELSE 'Text' END AS file_type, {ext} IN ({', '.join(map(_q, sources.SUPPORTED))}) AS supported FROM scan_results"
    stem = r"regexp_extract(path, '([^/]*)\.[^./]*$', 1)"
    raw_ext = r"regexp_extract(path, '\.([^./]*)$', 1)"
    sql["output_paths"] = rf"SELECT scan_id, regexp_extract(path, '^(.*/)', 1) || {stem} || '-covered.' || {raw_ext} AS beside, '/out/' || {stem} || '.' || {raw_ext} || '.txt' AS elsewhere FROM scan_results"
    sql["storage_usage"] = "SELECT CASE WHEN contains(path, '/models/') THEN 'models' WHEN contains(path, '/logs/') THEN 'logs' ELSE 'config' END AS category, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM scan_results GROUP BY 1"
    sql["detections_daily"] = "SELECT strftime(detected_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, entity_type, count(*) AS detections FROM detections GROUP BY 1, 2"
    return sql
