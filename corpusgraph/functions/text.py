"""Column functions over text and code elements."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two letters, digits or underscores at least.
TOKEN = r"([\p{L}\p{N}_]{2,})"
#: Namespace of name-based ids (URL names).
NAMESPACE = uuid.NAMESPACE_URL.hex


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)


def name_id(name: Column) -> Column:
    """Version-5 UUID of a name: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    # The variant keeps the two low bits of the digit and sets the high ones to 10.
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def element_id(kind: Column, name: Column, path: Column) -> Column:
    return name_id(F.concat_ws(":", kind, name, path))


def filled(c: Column) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def cost(tokens: Column, price_per_1k: float = 0.001) -> Column:
    return tokens / 1000 * F.lit(price_per_1k)


def format_parameters(params: Column) -> Column:
    """`name:type=default, …` of an array of structs; null for none."""
    one = lambda p: F.concat(
        F.coalesce(p["name"], F.lit("")),
        F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(F.lit(":"), p["type"])).otherwise(""),
        F.when(F.coalesce(p["default"], F.lit("")) != "", F.concat(F.lit("="), p["default"])).otherwise(""),
    )
    return filled(F.array_join(F.transform(params, one), ", "))


def text_representation(e: dict[str, Column]) -> Column:
    """Labelled sections of an element, joined by line ends; empty ones are left out, the first three always stay."""
    shown = lambda label, v: F.concat(F.lit(label), filled(v))  # noqa: E731  null if empty
    listed = lambda label, v: shown(label, F.array_join(v, ", "))
    text = lambda c: F.coalesce(e[c], F.lit(""))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), text("name")), F.concat(F.lit("Type: "), text("type")), F.concat(F.lit("File: "), text("file_path")),
        F.when(e["is_async"], F.lit("Async: True")),
        shown("Description: ", e["docstring"]), shown("Explanation: ", e["explanation"]), shown("\nCode:\n", e["code"]),
        listed("Decorators: ", e["decorators"]), shown("Parameters: ", format_parameters(e["parameters"])), shown("Return Type: ", e["return_type"]),
        listed("Dependencies: ", e["dependencies"]), listed("Base Classes: ", e["base_classes"]), listed("Function Calls: ", e["calls"]),
        listed("Methods: ", e["methods"]), listed("Assignments: ", e["assignments"]),
    )


LISTS = ("decorators", "dependencies", "base_classes", "methods", "assignments", "calls")


def element_document(e: dict[str, Column]) -> dict[str, Column]:
    """The sixteen fields of an element's document: missing lists are empty, missing texts too; its content is the code."""
    text = lambda c: F.coalesce(e[c], F.lit(""))
    lists = {c: F.coalesce(e[c], F.array().cast("array<string>")) for c in LISTS}
    params = F.coalesce(e["parameters"], F.array().cast("array<struct<name: string, type: string, default: string>>"))
    return {c: e[c] for c in ("id", "name", "type", "file_path", "docstring", "code", "is_async")} | lists | {"parameters": params, "return_type": text("return_type"), "explanation": text("explanation")}


def dedent(text: Column) -> Column:
    """The text without the white space that starts all its lines that are not blank."""
    lines = F.split(text, "\n")
    margin = F.array_min(F.transform(F.filter(lines, lambda x: F.length(F.trim(x)) > 0), lambda x: F.length(F.regexp_extract(x, "^[ \\t]*", 0))))
    return F.array_join(F.transform(lines, lambda x: F.when(F.length(F.trim(x)) == 0, "").otherwise(F.substr(x, F.coalesce(margin, F.lit(0)) + 1))), "\n")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def node_text(e: dict[str, Column]) -> Column:
    """`KIND: name`, the file and the code without its margin."""
    code = F.when(F.coalesce(e["code"], F.lit("")) == "", "No code available").otherwise(stripped(dedent(e["code"])))
    return stripped(F.concat(F.upper(e["type"]), F.lit(": "), e["name"], F.lit("\nFile: "), e["file_path"], F.lit("\n\n"), code))


def node_metadata(e: dict[str, Column]) -> Column:
    """A map of an element's fields, lists joined by commas; empty ones are left out."""
    values = {c: e[c] for c in ("id", "type", "name", "file_path", "return_type", "explanation")} | {"parameters": format_parameters(e["parameters"])}
    values |= {c: F.array_join(e[c], ",") for c in LISTS}
    pairs = F.map_from_entries(F.array(*(F.struct(F.lit(k), v.cast("string")) for k, v in sorted(values.items()))))
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def text_node(e: dict[str, Column]) -> Column:
    """A struct of the rendered text and the four fields kept beside it."""
    return F.struct(text_representation(e).alias("text"), *(e[c].alias(c) for c in ("id", "name", "type", "file_path")))


def without_keys(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def eval_name(name: Column, text: Column) -> Column:
    """An element's name, or what the text's first three lines say after `Name: `; null if neither tells."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 3), "\n")
    return F.coalesce(F.nullif(name, F.lit("unknown")), filled(F.regexp_extract(head, r"(?m)^Name: (.*)$", 1)))


def stamp(at: Column) -> Column:
    """A time as yyyymmdd_hhmmss."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def embed_signature(dimension: Column, metric: Column) -> Column:
    return F.concat_ws(":", dimension.cast("string"), metric)
