"""URLs and links of pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import bound, contains_phrase, decoded, normalized, squeezed

_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)"
_LINK = r'(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]+)"|\'([^\']+)\'|([^\s>"\']+))[^>]*>(.*?)</a>'


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, a leading www aside, or one below the other."""
    a, b = (F.regexp_replace(host(x), "^www\\.", "") for x in (a, b))
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def absolute(href: Column, base: Column) -> Column:
    """href against the page it stands on, without its fragment; null unless http or https."""
    whole = bound(
        F.regexp_replace(href, "#.*$", ""),
        lambda h: (
            F.when(h.rlike("^(?i:https?)://"), h)
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
            .when(h.startswith("/"), F.concat(origin(base), h))
            .otherwise(F.concat(origin(base), F.regexp_replace(path(base), "[^/]*$", ""), h))
        ),
    )
    return bound(whole, lambda w: F.when(host(w) != "", w))


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, pos, href, text) of every anchor with an address, duplicates included."""
    found = [F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(k)) for k in (1, 2, 3, 4)]
    rows = pages.select(id_col, url_col, F.posexplode(F.arrays_zip(*(f.alias(f"g{k}") for k, f in enumerate(found)))).alias("pos", "g"))
    raw = F.concat(*(F.coalesce(F.col(f"g.{k}"), F.lit("")) for k in ("g0", "g1", "g2")))
    text = squeezed(decoded(F.regexp_replace(F.coalesce(F.col("g.g3"), F.lit("")), "<[^>]+>", " ")))
    return rows.select(id_col, url_col, "pos", absolute(decoded(raw), F.col(url_col)).alias("href"), text.alias("text")).filter("href is not null")


# Fixed value: words of links that lead to no product.
BAD_LINK = r"(?:^| )(?:login|register|signin|signup|account|cart|checkout|privacy|terms|contact|about|blog|news|help|faq)(?: |$)"


def link_score(text: Column, href: Column, home: Column, identity: Column) -> Column:
    """How much a link looks as if it led to the named thing: whole phrases first, then compact forms of strong names."""
    compact = F.replace(identity, F.lit(" "), F.lit(""))
    size = F.char_length(compact)
    strong = (F.size(F.split(identity, " ")) >= 2) | (size >= 4)
    inside = lambda x: F.contains(F.replace(x, F.lit(" "), F.lit("")), compact)

    def scored(t: Column, h: Column) -> Column:
        best = F.greatest(
            F.lit(0),
            F.when(contains_phrase(t, identity), F.when(strong, 130).otherwise(72) + size),
            F.when(contains_phrase(h, identity), F.when(strong, 112).otherwise(62) + size),
            F.when(strong & inside(t), size + 118),
            F.when(strong & inside(h), size + 100),
        )
        return best - F.when(F.concat_ws(" ", t, h).rlike(BAD_LINK), 100).otherwise(0)

    best = bound(normalized(text), lambda t: bound(normalized(href), lambda h: scored(t, h)))
    return best - F.when(origin(href) == origin(home), 0).otherwise(70)
