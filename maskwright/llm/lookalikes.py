"""Problem 6: text that looks the same brought to one form of characters.

The expressions run as SQL in an embedded DuckDB over the Arrow batches of each partition: invisible characters go,
compatibility forms and look-alikes are translated, accents are composed. Only values with a character outside ASCII
leave the JVM. No shuffle; one row in, at most one row out.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters without width (soft hyphen, zero-width spaces and joiners, direction marks, variation selectors).
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}"

#: Letters of other scripts and the Latin letter they look like.
LOOKALIKES = dict(
    zip(
        "АВЕЅЗІЈКМНОРСТУХЬԌԚԜаеѕіјкмнорсстухвһԁԛԝӏгɡ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχγ" + "ıɑ",
        "ABESZIJKMHOPCTYXbGQWaesijkmhopcctyxbhdqwlrg" + "ABEZHIKMNOPTYXaeikvoptuxy" + "ia",
    )
)

#: Hyphens and dashes written for the plain hyphen.
HYPHENS = "‐‑‒–—−﹘﹣－"


def _compatible() -> dict[str, str]:
    """By rule: wide, narrow and font forms of one ASCII character, and spaces of other widths."""
    table = {c: "-" for c in HYPHENS}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        plain = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Zs":
            table[c] = " "
        elif tag in ("<wide>", "<narrow>", "<font>") and len(plain) == 1 and plain.isascii():
            table[c] = plain
    return table


COMPATIBLE = _compatible()
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
OTHER = r"\p{Greek}\p{Cyrillic}ıɑɡ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain_sql(value: str) -> str:
    """DuckDB expression for the consistent form of ``value``.

    Look-alikes are translated only in words that also have Latin letters, or in single letters of a value that is
    otherwise Latin; a word wholly in another script stays as it is.
    """
    seen = f"regexp_replace({value}, '[{INVISIBLE}]', '', 'g')"
    for c, plain in LIGATURES.items():
        seen = f"replace({seen}, {_quoted(c)}, {_quoted(plain)})"
    seen = f"nfc_normalize(translate({seen}, {_quoted(''.join(COMPATIBLE))}, {_quoted(''.join(COMPATIBLE.values()))}))"
    latin = r"[\p{Latin}]"
    swap = f"translate(w, {_quoted(''.join(LOOKALIKES))}, {_quoted(''.join(LOOKALIKES.values()))})"
    mixed = f"regexp_matches(w, '[{OTHER}]') AND (regexp_matches(w, '{latin}') OR (length(w) = 1 AND regexp_matches(s, '{latin}')))"
    words = rf"list_transform(regexp_extract_all(s, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), lambda w: CASE WHEN {mixed} THEN {swap} ELSE w END)"
    return f"(SELECT CASE WHEN regexp_matches(s, '[{OTHER}]') THEN nfc_normalize(array_to_string({words}, '')) ELSE s END FROM (SELECT {seen} AS s))"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = duckdb.connect(":memory:", config={"threads": 1})
    query = f"SELECT src, row_id, plain FROM (SELECT src, row_id, value, {plain_sql('value')} AS plain FROM held) WHERE plain <> value"
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch])  # read by its name
        yield from con.sql(query).to_arrow_table().cast(OUT).to_batches()


OUT = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("plain", pa.string())])


def consistent_forms(rows: DataFrame) -> DataFrame:
    """``rows(src, row_id, value)`` to (src, row_id, plain) for the values that aren't in the consistent form.

    Null, empty and all-ASCII values are in it. Rows keep their number; repeated rows give repeated results.
    """
    held = rows.where(F.col("value").rlike(r"[^\x00-\x7F]")).select("src", F.col("row_id").cast("bigint").alias("row_id"), "value")
    return held.mapInArrow(_convert, "src string, row_id bigint, plain string")


def value_lookup(values: DataFrame, stored: DataFrame) -> DataFrame:
    """(row_id, mapping_id, stored_rows): rows of ``values(src, row_id, value)`` met by ``stored(src, row_id, value)`` in the consistent form.

    ``mapping_id`` is the smallest stored id. The stored side is reduced to one row per form before the join.
    """

    def plain(rows: DataFrame) -> DataFrame:
        changed = consistent_forms(rows)
        kept = rows.where("value IS NOT NULL").select("src", F.col("row_id").cast("bigint").alias("row_id"), "value")
        ascii_only = kept.where(~F.col("value").rlike(r"[^\x00-\x7F]")).withColumnRenamed("value", "plain")
        other = kept.where(F.col("value").rlike(r"[^\x00-\x7F]")).join(changed, ["src", "row_id"], "left").select("src", "row_id", F.coalesce("plain", "value").alias("plain"))
        return ascii_only.unionByName(other)

    one = plain(stored).groupBy("plain").agg(F.min("row_id").alias("mapping_id"), F.count("*").alias("stored_rows"))
    return plain(values).join(one, "plain").select("row_id", "mapping_id", "stored_rows")
