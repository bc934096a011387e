"""URL expressions: parts, normal form and resolution of a link against its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftlens.functions.binding import let, record

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_PLAIN_ROOTED_PATH = r"^(?:/[^/?#.\s\x00-\x20][^/?#\s\x00-\x20]*+)+/?$"


def _group(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def url_parts(url: Column) -> Column:
    """Struct (scheme, host, path, query) of a URL: scheme and host in lower case, no fragment."""
    def split(text):
        return let(F.regexp_replace(text, _SCHEME, ""), lambda rest: record(
            scheme=F.lower(_group(text, _SCHEME)),
            host=F.lower(_group(rest, r"^//([^/?#]*)")),
            path=_group(rest, r"^(?://[^/?#]*)?([^?#]*)"),
            query=_group(rest, r"^[^?#]*\?([^#]*)")))

    return let(F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]+", ""), split)


def page_base(url: Column) -> Column:
    """Parts of a page's own normalized url, the base its links are resolved against."""
    return let(url_parts(url), lambda u: record(
        scheme=u["scheme"], host=u["host"], path=F.when(u["path"] == "", "/").otherwise(u["path"]), query=u["query"]))


def build_url(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when((path == "") | ((host != "") & ~path.startswith("/")), F.concat(F.lit("/"), path)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, ``/`` for an empty path, query kept, fragment dropped."""
    return let(url_parts(url), lambda u: build_url(u["scheme"], u["host"], u["path"], u["query"]))


def _without_dot_segments(segments: Column) -> Column:
    walked = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done).otherwise(F.concat(done, F.array(part))))
    ends_open = F.element_at(segments, -1).isin(".", "..")
    return F.array_join(F.when(ends_open, F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/")


def _squeezed(segments: Column) -> Column:
    """Segments of a merged path without the empty ones in the middle."""
    middle = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))
    return F.concat(F.slice(segments, 1, 1), F.filter(middle, lambda s: s != ""), F.slice(segments, -1, 1))


def _merged_path(base: Column, path: Column) -> Column:
    rooted = F.startswith(path, F.lit("/"))
    folder = F.regexp_replace(base["path"], "[^/]*$", "")
    segments = F.when(rooted, F.split(path, "/")).otherwise(
        _squeezed(F.split(F.concat(F.when(folder == "", "/").otherwise(folder), path), "/")))
    return F.when(path == "", base["path"]).otherwise(let(segments, _without_dot_segments))


def _resolve_parts(base: Column, link: Column) -> Column:
    other_scheme = (link["scheme"] != "") & (link["scheme"] != base["scheme"])
    alone = other_scheme | (link["host"] != "")
    scheme = F.when(link["scheme"] != "", link["scheme"]).otherwise(base["scheme"])
    query = F.when((link["path"] == "") & (link["query"] == ""), base["query"]).otherwise(link["query"])
    return F.when(alone, record(
        host=link["host"], url=build_url(scheme, link["host"], link["path"], link["query"]))).otherwise(record(
            host=base["host"], url=let(_merged_path(base, link["path"]), lambda path: build_url(
                base["scheme"], base["host"], path, query))))


def resolve_link(base: Column, href: Column) -> Column:
    """Struct (host, url) of ``href`` as seen from the page with the parts ``base``, normalized.

    Another scheme or an explicit host stands for itself; anything else is merged with the page's
    path. The usual rooted path without query and dot segments needs no parsing.
    """
    plain = record(host=base["host"], url=F.concat(base["scheme"], F.lit("://"), base["host"], href))
    return F.when((base["host"] != "") & href.rlike(_PLAIN_ROOTED_PATH), plain).otherwise(
        let(url_parts(href), lambda link: _resolve_parts(base, link)))
