"""Semantic id strings and code lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sidforge.functions.text import pytrim, strict_json

#: The markers around a semantic id, and of the end of a chat message.
SID_BEGIN, SID_END, MESSAGE_END = "<|sid_begin|>", "<|sid_end|>", "<|im_end|>"
MAX_LAYERS = 26


def layer_letter(layer: Column) -> Column:
    """a for layer 0, b for 1, ..."""
    return F.char(F.lit(97) + layer)


def sid_token(layer: Column, code: Column) -> Column:
    """Token of one code."""
    return F.concat(F.lit("<s_"), layer_letter(layer), F.lit("_"), code.cast("string"), F.lit(">"))


def sid_from_codes(codes: Column | str) -> Column:
    """Semantic id of a code list; null when the list is null or has a null, an error beyond 26 layers."""
    codes = F.col(codes) if isinstance(codes, str) else codes
    body = F.array_join(F.transform(codes, lambda c, i: sid_token(i, c)), "")
    sid = F.concat(F.lit(SID_BEGIN), body, F.lit(SID_END))
    whole = F.when(codes.isNotNull() & ~F.exists(codes, lambda c: c.isNull()), sid)
    return F.when(F.size(codes) > MAX_LAYERS, F.raise_error(F.lit(f"more than {MAX_LAYERS} layers"))).otherwise(whole)


def sid_from_exact(codes: Column | str, layers: int = 3) -> Column:
    """As :func:`sid_from_codes`, an error unless there are exactly ``layers`` codes."""
    return sid_from_codes(normalize_codes(codes, layers))


def normalize_codes(codes: Column | str, layers: int) -> Column:
    """Codes as bigint; an error when the list is null, has a null, or hasn't exactly ``layers`` elements."""
    codes = (F.col(codes) if isinstance(codes, str) else codes).cast("array<bigint>")
    good = codes.isNotNull() & (F.size(codes) == layers) & ~F.exists(codes, lambda c: c.isNull())
    return F.when(F.coalesce(good, F.lit(False)), codes).otherwise(F.raise_error(F.concat(F.lit(f"expected {layers} codes, got "), F.coalesce(codes.cast("string"), F.lit("null")))))


def parse_sid(sid: Column | str) -> Column:
    """Codes of the tokens in a text, in order of appearance; null when there are none."""
    codes = F.regexp_extract_all(sid, F.lit("<s_[a-z]_([0-9]+)>"), F.lit(1)).cast("array<bigint>")
    return F.when(F.size(codes) > 0, codes)


def parse_codes(text: Column | str) -> Column:
    """Codes of a JSON list or of a bracketed or bare comma list; null when it is neither.

    In JSON, numbers are truncated, strings must be whole numbers, booleans count as 0 and 1; any other element makes the
    whole value null, as does JSON that is no list. ``[]`` gives an empty list, blank text null. Elements of a comma list must
    be whole numbers; empty ones are skipped.
    """
    text = pytrim(text)
    parsed = strict_json(text)
    whole = r"^[+-]?[0-9]+$"

    def element(x: Column) -> Column:
        kind, written = F.schema_of_variant(x), pytrim(F.try_variant_get(x, "$", "string"))
        from_text = F.when(written.rlike(whole), written.try_cast("bigint"))
        return F.when(kind == "STRING", from_text).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("bigint")).otherwise(F.try_variant_get(x, "$", "bigint"))

    from_json = F.transform(parsed.try_cast("array<variant>"), element)
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), ","), pytrim), lambda x: x != "")
    from_list = F.transform(parts, lambda x: F.when(x.rlike(whole), x.try_cast("bigint")))
    values = F.when(text != "", F.when(parsed.isNotNull(), from_json).otherwise(from_list))
    return F.when(~F.exists(values, lambda x: x.isNull()), values)
