"""Addresses: resolution of relative ones by RFC 3986, as a fold over the segments of a path, and which pictures are content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import text_or_empty

# Fixed value: parts of the addresses of pictures that are no content.
NO_CONTENT = r"(?i)static/|funders|logo|glyph|smileybones|favicon|icon"
#: Scheme, authority, path, query and fragment, each with its delimiter, so that an empty one differs from none.
PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _parts(address: Column) -> list[Column]:
    return [F.regexp_extract(address, PARTS, k) for k in range(1, 6)]


def without_dots(path: Column) -> Column:
    """A path without `.` and `..`; more `..` than there are segments end at the root."""

    def step(kept: Column, segment: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.concat(kept, F.array(segment)))

    segments = F.split(path, "/")
    folded = F.aggregate(F.slice(segments, 2, F.size(segments)), F.slice(segments, 1, 1), step)
    # one that ends in dots names a folder
    return F.array_join(F.when(path.rlike(r"/\.\.?$"), F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference on a page means. Null references stay null; where neither has a scheme, the reference stays as it is."""
    (scheme, host, path, query, _), (own_scheme, own_host, own_path, own_query, own_fragment) = _parts(text_or_empty(base)), _parts(reference)
    merged = F.when((host != "") & (path == ""), F.concat(F.lit("/"), own_path)).otherwise(F.concat(F.regexp_extract(path, r"(?s)^(.*/)?", 0), own_path))
    rooted = lambda p: F.when(p.startswith("/"), without_dots(p)).otherwise(p)
    joined = lambda *parts: F.concat(*parts)
    inherited = F.when(own_path == "", joined(path, F.when(own_query != "", own_query).otherwise(query))).otherwise(joined(rooted(F.when(own_path.startswith("/"), own_path).otherwise(merged)), own_query))
    return (
        F.when(own_scheme != "", joined(own_scheme, own_host, rooted(own_path), own_query, own_fragment))
        .when(scheme == "", reference)
        .when(own_host != "", joined(scheme, own_host, rooted(own_path), own_query, own_fragment))
        .otherwise(joined(scheme, host, inherited, own_fragment))
    )


def is_picture(source: Column) -> Column:
    """Whether a picture's address is one of content: not empty, not inline data, and no logo or icon."""
    t = text_or_empty(source)
    return (t != "") & ~t.startswith("data:") & ~t.rlike(NO_CONTENT)
