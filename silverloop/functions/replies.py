"""Model replies to typed columns: key-value lines, JSON, broken JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silverloop.functions.labels import strip

# Patterns and words of the reply formats.
LABEL_TOKEN = r'(?U)("label"\s*:\s*([01]))|(\b([01])\b)'
LABEL_FIELD = r'(?U)"label"\s*:\s*([01])'
CONFIDENCE_FIELD = r'(?U)"confidence"\s*:\s*"(low|medium|high)"'
RATIONALE_FIELD = r'(?U)"rationale"\s*:\s*"([^"]*)"'
CONFIDENCES = ["low", "medium", "high"]
NO_RATIONALE = "No rationale extracted."
FAILED_PREFIX = "PARSE FAILED. Raw: "
RAW_CHARS = 300

# Everything that ends a line, as the inside of a character class.
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_INTEGER = r"^[+-]?[0-9]+$"


def _first_block(reply: Column) -> Column:
    """From the first opening brace to the first closing one after it, else null.

    Two searches, so a reply of many lone braces takes no longer than its length.
    """
    begin = F.position(F.lit("{"), reply)
    end = F.position(F.lit("}"), reply, F.greatest(begin, F.lit(1)))
    return F.when((begin > 0) & (end > 0), F.substring(reply, begin, end - begin + 1))


def _empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _last_line_value(reply: Column, key: str) -> Column:
    """What follows ``key:`` on the last line that starts with it, or ``""``."""
    # The space before a key is that of its own line: over line breaks it would be gone through again from each.
    pattern = rf"(?is)^(?:.*[{_BREAKS}])?(?U:[\s&&[^{_BREAKS}]]*){key}:([^{_BREAKS}]*)"
    return strip(F.regexp_extract(reply, pattern, 1))


def kv_reply(reply: Column) -> Column:
    """Struct (label, confidence, rationale) of a ``label: …`` style reply."""
    text = F.coalesce(reply, F.lit(""))
    label = _last_line_value(text, "label")
    confidence = F.lower(_last_line_value(text, "confidence"))
    rationale = _last_line_value(text, "rationale")
    return F.struct(
        F.when(label.isin("0", "1"), label).otherwise("0").alias("label"),
        F.when(confidence.isin(CONFIDENCES), confidence).otherwise("low").alias("confidence"),
        F.when(rationale != "", rationale)
        .otherwise(F.substring(strip(text), 1, RAW_CHARS))
        .alias("rationale"),
    )


def _whole_json(text: Column) -> Column:
    """``VARIANT`` of a text that is one JSON value and nothing more.

    The parser stops at the end of the first value and ignores the rest. Text that
    is valid both as a list item and as a member of an object is a single value:
    what could close or continue the one breaks the other.
    """
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(item.isNotNull() & member.isNotNull(), F.try_variant_get(item, "$[0]", "variant"))


def first_json_object(reply: Column) -> Column:
    """``VARIANT`` of the first ``{…}``; failing that of the whole text in braces."""
    block = _first_block(reply)
    text = strip(reply)
    opened = F.when(text.startswith("{"), text).otherwise(F.concat(F.lit("{"), text))
    closed = F.when(opened.endswith("}"), opened).otherwise(F.concat(opened, F.lit("}")))
    # A block ends at its first closing brace, so nothing can follow its object.
    return F.coalesce(F.try_parse_json(block), F.when(text != "", _whole_json(closed)))


def label_token(reply: Column) -> Column:
    """The leftmost ``"label": 0/1`` or lone 0/1, else null."""
    keyed = _empty_to_null(F.regexp_extract(reply, LABEL_TOKEN, 2))
    lone = _empty_to_null(F.regexp_extract(reply, LABEL_TOKEN, 4))
    return F.coalesce(keyed, lone).cast("int")


def _member_type(obj: Column, name: str) -> Column:
    """Type name of a member: null when absent, VOID when JSON null."""
    return F.schema_of_variant(F.try_variant_get(obj, f"$.{name}", "variant"))


def member_as_int01(obj: Column, name: str = "label") -> Column:
    """A JSON member as 0/1 the way an integer conversion reads it.

    Numbers are cut towards zero, true and false count, text must be an
    integer. Other values, and integers but 0 and 1, are null.
    """
    kind = _member_type(obj, name)
    path = f"$.{name}"
    text = strip(F.try_variant_get(obj, path, "string"))
    whole = (
        F.when(kind == "BOOLEAN", F.try_variant_get(obj, path, "boolean").cast("int").cast("double"))
        .when(kind == "STRING", F.when(text.rlike(_INTEGER), text.try_cast("double")))
        .when(
            (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
            F.try_variant_get(obj, path, "double"),
        )
    )
    return F.when((whole > -1) & (whole < 1), 0).when((whole >= 1) & (whole < 2), 1).cast("int")


def member_as_text(obj: Column, name: str) -> Column:
    """A JSON member as text; ``True``/``False`` are capitalised, null stays null."""
    kind = _member_type(obj, name)
    value = F.try_variant_get(obj, f"$.{name}", "string")
    return F.when(kind == "BOOLEAN", F.initcap(value)).when(kind != "VOID", value)


def json_reply(reply: Column, obj: Column | None = None) -> Column:
    """Struct (label, rationale, ok): JSON first, then the label token.

    ``obj`` is a column that already holds ``first_json_object(reply)``.
    """
    obj = first_json_object(reply) if obj is None else obj
    label = member_as_int01(obj)
    return F.struct(
        F.coalesce(label, label_token(reply)).alias("label"),
        F.when(label.isNotNull(), member_as_text(obj, "rationale")).alias("rationale"),
        label.isNotNull().alias("ok"),
    )


def salvaged_json(reply: Column) -> Column:
    """``VARIANT`` of a judge reply, rebuilt from its fields where braces are missing."""
    block = _first_block(reply)
    label = _empty_to_null(F.regexp_extract(reply, LABEL_FIELD, 1))
    confidence = _empty_to_null(F.regexp_extract(reply, CONFIDENCE_FIELD, 1))
    rationale = F.when(reply.rlike(RATIONALE_FIELD), F.regexp_extract(reply, RATIONALE_FIELD, 1))
    rebuilt = F.to_json(
        F.struct(
            label.cast("int").alias("label"),
            F.coalesce(confidence, F.lit("low")).alias("confidence"),
            F.coalesce(rationale, F.lit(NO_RATIONALE)).alias("rationale"),
        )
    )
    object_text = F.coalesce(block, F.when(label.isNotNull(), rebuilt))
    return F.when(object_text.isNotNull(), F.try_parse_json(object_text)).otherwise(_whole_json(strip(reply)))


def judge_verdict(reply: Column, obj: Column | None = None) -> Column:
    """Struct (label, confidence, rationale, failed) of a judge reply.

    ``obj`` is a column that already holds ``salvaged_json(reply)``.
    """
    obj = salvaged_json(reply) if obj is None else obj
    parsed = F.coalesce(F.schema_of_variant(obj).startswith("OBJECT"), F.lit(False))
    label = member_as_int01(obj)
    confidence = F.try_variant_get(obj, "$.confidence", "string")
    kind = _member_type(obj, "rationale")
    rationale = (
        F.when(kind.isNull(), F.lit(""))
        .when(kind == "VOID", F.lit("None"))
        .otherwise(member_as_text(obj, "rationale"))
    )
    raw = F.concat(F.lit(FAILED_PREFIX), F.substring(F.coalesce(reply, F.lit("")), 1, RAW_CHARS))
    return F.struct(
        F.when(parsed, label).alias("label"),
        F.when(parsed & confidence.isin(CONFIDENCES), confidence).otherwise("low").alias("confidence"),
        F.when(parsed, rationale).otherwise(raw).alias("rationale"),
        (~parsed | label.isNull()).alias("failed"),
    )
