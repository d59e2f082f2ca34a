"""Text primitives shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points for which Python's ``str.isspace`` holds.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def pytrim(col: Column | str) -> Column:
    """Strip all Unicode white space off both ends (plain ``trim`` only strips the ASCII space)."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITESPACE))


def clean_id(col: Column | str) -> Column:
    """Trimmed id; null and blank ids become null."""
    trimmed = pytrim(col)
    return F.when(trimmed != "", trimmed)


def epoch_millis(col: Column | str, first_year: int = 2018, last_year: int = 2040) -> Column:
    """Instant of a loosely written timestamp in epoch milliseconds, null when it cannot be read.

    Read are, after trimming: a plain or decimal-tailed number (below 10**11 it means seconds, else milliseconds; fractions
    of a millisecond are cut off) and ISO 8601 date-times with ``Z`` or an offset. Instants outside
    ``first_year .. last_year`` count as unreadable, so that small numbers and zeros are not taken for 1970.
    """
    text = pytrim(col)
    number = F.when(text.rlike(r"^[0-9]{1,16}(\.[0-9]*)?$"), text.try_cast("decimal(28,6)"))
    from_number = F.when(number < F.lit(10**11), number * 1000).otherwise(number).cast("bigint")
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    from_iso = F.when(iso, F.unix_millis(text.try_cast("timestamp")))
    millis = F.coalesce(from_number, from_iso)
    low = F.unix_millis(F.lit(f"{first_year}-01-01T00:00:00Z").cast("timestamp"))
    high = F.unix_millis(F.lit(f"{last_year + 1}-01-01T00:00:00Z").cast("timestamp"))
    return F.when((millis >= low) & (millis < high), millis)


def _listed(col: Column | str, separator: str, most: int) -> Column:
    """The first ``most`` non-blank elements, trimmed and joined; null elements read as the text "None"."""
    elements = F.transform(col, lambda x: pytrim(F.coalesce(x, F.lit("None"))))
    return F.coalesce(F.array_join(F.slice(F.filter(elements, lambda x: x != ""), 1, most), separator), F.lit(""))


def item_text(item_id: Column | str = "parent_asin") -> Column:
    """Text of a metadata row: one labelled line per non-empty field, in fixed order.

    Reads title, store, main_category, categories (10 at most), features (8), description (4). Null and blank fields give no
    line; a row without any gives ``Item id: <id>``.
    """
    single = [("Title", "title"), ("Store", "store"), ("Main category", "main_category")]
    several = [("Categories", "categories", "; ", 10), ("Features", "features", "; ", 8), ("Description", "description", " ", 4)]
    values = [(label, F.coalesce(pytrim(c), F.lit(""))) for label, c in single]
    values += [(label, _listed(c, separator, most)) for label, c, separator, most in several]
    lines = F.concat_ws("\n", *(F.when(value != "", F.concat(F.lit(f"{label}: "), value)) for label, value in values))
    identity = F.col(item_id) if isinstance(item_id, str) else item_id
    return F.when(lines != "", lines).otherwise(F.concat(F.lit("Item id: "), F.coalesce(identity, F.lit(""))))


def strict_json(text: Column) -> Column:
    """Variant of a JSON text, null when the text is anything else; what follows a JSON value makes it something else."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant")
