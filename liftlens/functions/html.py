"""HTML expressions: one pass splits a page into tokens, everything else reads the token list."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftlens.functions.binding import constant_map, let, record

ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
_RAW_TEXT = r"<{0}(?=[\s/>]){1}>[\s\S]*?(?:</{0}(?=[\s/>])[^>]*+>|\z)"
_TOKEN = "(?i)" + "|".join([
    r"<!--[\s\S]*?--!?>",
    _RAW_TEXT.format("script", ATTRIBUTES),
    _RAW_TEXT.format("style", ATTRIBUTES),
    r"</?[a-z][^\s/>]*+" + ATTRIBUTES + ">",
    r"<[!?/][^>]*+>",
    r"[^<]++",
    "<",
])
_ATTRIBUTE = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_TAG_NAME = r"^<([a-zA-Z][^\s/>]*)"
_SPACE_AROUND = r"(?U)^\s+|\s+$"
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?"
_ATTRIBUTE_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(?:;|(?![=a-zA-Z0-9]))"


def strip(text: Column) -> Column:
    """Drop white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(text, _SPACE_AROUND, "")


def tokens(html: Column) -> Column:
    """Comments, script and style blocks, tags and text runs in document order."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def is_comment(token: Column) -> Column:
    return token.startswith("<!") | token.startswith("<?")


def is_tag(token: Column, *names: str) -> Column:
    return token.startswith("<") & token.rlike("(?i)^<(?:" + "|".join(names) + r")(?=[\s/>])")


def is_end_tag(token: Column, name: str) -> Column:
    return token.startswith("</") & token.rlike(f"(?i)^</{name}" + r"(?=[\s/>])")


def start_tags(token_list: Column, *names: str) -> Column:
    return F.filter(token_list, lambda t: is_tag(t, *names))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, _TAG_NAME, 1))


def markup(token_list: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.array_join(F.filter(token_list, lambda t: ~is_comment(t) & ~is_tag(t, "script", "style")), "")


def without_tags(fragment: Column) -> Column:
    return F.regexp_replace(fragment, "(?i)</?[a-z][^\\s/>]*+" + ATTRIBUTES + ">", "")


def text_of(fragment: Column) -> Column:
    """Text of a markup fragment: tags removed, entities decoded, stripped."""
    return strip(decode_entities(without_tags(fragment)))


def _entity_names() -> Column:
    return constant_map({name: chr(code) for name, code in name2codepoint.items()})


def _code_point(digits: Column, base: int) -> Column:
    hexadecimal = F.conv(digits, base, 16)
    known = F.length(hexadecimal) <= 6
    return F.when(known, F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")).otherwise("�")


def decode_entities(text: Column, in_attribute: bool = False) -> Column:
    """Decode numeric and named character references; names that are not known stay as they are."""
    pattern = _ATTRIBUTE_ENTITY if in_attribute else _ENTITY
    names = _entity_names()

    def decoded(piece):
        body = F.regexp_extract(piece, "^&#?[xX]?([^;]*);?$", 1)
        return (F.when(~piece.startswith("&"), piece)
                .when(piece.rlike("^&#[xX][0-9a-fA-F]"), _code_point(body, 16))
                .when(piece.rlike("^&#[0-9]"), _code_point(body, 10))
                .otherwise(F.coalesce(F.try_element_at(names, F.regexp_extract(piece, "^&([^;]*);?$", 1)), piece)))

    def all_decoded(known):
        pieces = F.regexp_extract_all(known, F.lit(pattern + "|[^&]++|&"), F.lit(0))
        return F.when(known.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(known)

    return let(text, all_decoded)


def attributes(tag: Column) -> Column:
    """Array of (name, value) of the start tag a token begins with; an attribute without value has an
    empty one."""
    inside = F.regexp_extract(tag, r"^<[a-zA-Z][^\s/>]*+(" + ATTRIBUTES + ")>", 1)
    found = F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0))
    return F.transform(found, lambda a: record(
        name=F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)),
        value=F.regexp_replace(F.regexp_extract(a, r"^[^\s=]+\s*=\s*([\s\S]*)$", 1), r"""^(["'])([\s\S]*)\1$""", "$2")))


def attribute(attrs: Column, name: str) -> Column:
    """Raw value of the last attribute called ``name``; null when there is none."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def attribute_text(attrs: Column, name: str) -> Column:
    return decode_entities(attribute(attrs, name), in_attribute=True)


def tags_with_attributes(tag_list: Column) -> Column:
    return F.transform(tag_list, lambda t: record(tag=tag_name(t), attrs=attributes(t)))
