"""Parts of raw pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.text import DROPPED, END, decoded, normalized, squeezed

# Where bundles of a site's own code lie, and whose code is none of the site's.
BUNDLE = r"\.js(?:\?|$)|/_next/static/|/assets/|/build/|/static/"
TRACKER = "googletagmanager|google-analytics|gtag|facebook|doubleclick|hotjar|clarity|sentry"
#: Units that too many games share.
AMBIGUOUS = ["diamond", "diamonds", "coin", "coins", "crystal", "crystals", "point", "points", "cash", "gold"]


def stripped(html: Column) -> Column:
    """Text between tags, entities decoded, on one line."""
    return squeezed(decoded(F.regexp_replace(html, "<[^>]+>", " ")))


def tag_texts(html: Column, *tags: str) -> Column:
    """Array of the texts of all elements of some tags, empty ones left out."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{'|'.join(tags)}){END}[^>]*>(.*?)</(?:{'|'.join(tags)})>"), F.lit(1))
    return F.filter(F.transform(found, stripped), lambda x: x != "")


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)(?<![A-Za-z0-9_]){name}\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s>]+))"""
    return F.concat(*(F.regexp_extract(tag, value, k) for k in (1, 2, 3)))


def scripts(html: Column) -> Column:
    """Array of structs (type, id, body) of the script elements."""
    pattern = rf"(?is)<script{END}([^>]*)>(.*?)</script>"
    heads, bodies = (F.regexp_extract_all(html, F.lit(pattern), F.lit(k)) for k in (1, 2))
    both = F.arrays_zip(heads.alias("head"), bodies.alias("body"))
    return F.transform(both, lambda x: F.struct(F.lower(_attribute(x["head"], "type")).alias("type"), _attribute(x["head"], "id").alias("id"), F.btrim(x["body"], F.lit(" \t\r\n")).alias("body")))


def token_lines(html: Column) -> Column:
    """Array of the non-empty texts between any two tags."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}{END}[^>]*>.*?</{tag}>", " ")
    parts = F.split(decoded(F.regexp_replace(html, "<[^>]+>", "\n")), r"\r?\n")
    return F.filter(F.transform(parts, lambda x: squeezed(F.translate(x, "\u00a0", " "))), lambda x: x != "")


def phrase_count(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text; repeats that share a blank count once."""
    phrase = normalized(phrase)
    counted = F.regexp_count(F.concat(F.lit(" "), normalized(text), F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))
    return F.when(phrase == "", 0).otherwise(counted)


def is_bundle(url: Column) -> Column:
    """Whether a script is the site's own code and no tracker."""
    url = F.lower(url)
    return F.coalesce(url.rlike(BUNDLE) & ~url.rlike(TRACKER), F.lit(False))


def has_ambiguous_unit(units: Column) -> Column:
    """Whether a game is counted in a unit that other games have too."""
    return F.coalesce(F.arrays_overlap(F.transform(units, lambda u: F.lower(F.trim(u))), F.array(*map(F.lit, AMBIGUOUS))), F.lit(False))


def json_document(text: Column) -> Column:
    """A script's text as a JSON value, comment marks taken off; null where it is none."""
    text = F.regexp_replace(F.regexp_replace(decoded(text), r"^\ufeff?\s*<!--", ""), r"-->\s*$", "")
    return F.try_parse_json(F.nullif(F.btrim(text, F.lit(" \t\r\n\ufeff")), F.lit("")))


def abbreviation(name: Column) -> Column:
    """First letters of at most four words, in capitals."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.slice(F.transform(words, lambda w: F.substring(w, 1, 1)), 1, 4), ""))


def initials(name: Column) -> Column:
    """Two first letters in capitals, or what a store is known by."""
    # Stores that are known by letters of their own.
    known = F.create_map(*map(F.lit, ("codashop", "C", "unipin", "U", "lapakgaming", "L", "duniagames", "DG")))
    own = F.upper(F.substring(F.array_join(F.transform(F.split(F.coalesce(F.nullif(name, F.lit("")), F.lit("?")), r"\s+"), lambda w: F.substring(w, 1, 1)), ""), 1, 2))
    return F.coalesce(F.get(F.array(known[F.regexp_replace(F.lower(name), r"\s+", "")]), F.lit(0)), own)


def ago(then: Column, now: Column) -> Column:
    """How long ago, as users read it."""
    s = F.greatest(F.lit(0), F.floor((F.unix_millis(now) - F.unix_millis(then)) / 1000)).cast("bigint")
    return F.when(s < 8, "baru saja").when(s < 60, F.concat(s.cast("string"), F.lit(" detik lalu"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" menit lalu")))


def bounded(value: Column, fallback: float, least: float, most: float) -> Column:
    """A setting as a number within bounds; what is no number is the fallback."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), F.lit(fallback))))


def enabled(value: Column, fallback: bool) -> Column:
    """A switch: `true` in any case is on, nothing is the fallback, all else is off."""
    return F.when(value.isNull(), F.lit(fallback)).otherwise(F.lower(value) == "true")


def dynamic_signals(html: Column) -> Column:
    """Struct (frameworks, api_hints, empty_shell, product_words, likely_dynamic): whether a page is filled in by its scripts."""
    html = F.coalesce(html, F.lit(""))
    # Marks of frameworks, addresses of interfaces, words of product data.
    marks = [("nextjs", r"(?i)__next_data__|/_next/"), ("nuxt", r"(?i)__nuxt__|__nuxt_data__|/_nuxt/"), ("spa-root", r"""(?i)id=["']app["']|id=["']root["']""")]
    hints = [r"""(?i)["'`](/api/[a-z0-9_./?=&%-]{3,180})["'`]""", r"""(?i)["'`](/graphql(?:\?[a-z0-9_=&%-]+)?)["'`]""", r"""(?i)["'`]((?:https?://[^"'`\s]+)?/api/v\d+/[a-z0-9_./?=&%-]{2,180})["'`]"""]
    words = html.rlike("(?i)product|denomination|sellingPrice|selling_price|finalPrice|final_price|price")
    shell = html.rlike(r"""(?i)<(?:div|main)[^>]+id=["'](?:app|root|__next)["'][^>]*>\s*</(?:div|main)>""")
    frameworks = F.array_compact(F.array(*(F.when(html.rlike(p), F.lit(n)) for n, p in marks)))
    found = F.slice(F.array_distinct(F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in hints))), 1, 8)
    likely = (F.size(frameworks) > 0) & (shell | (F.size(found) > 0) | words)
    return F.struct(frameworks.alias("frameworks"), found.alias("api_hints"), shell.alias("empty_shell"), words.alias("product_words"), likely.alias("likely_dynamic"))


def parser_reason(found: Column, kept: Column, dynamic: Column, products: Column, prices: Column, documents: Column) -> Column:
    """Why a page gave no or not all offers: offers found and kept, whether scripts fill it, lines of products and prices, JSON documents."""
    return (
        F.when((found > 0) & (kept == 0), "PRODUCTS_REJECTED_BY_GAME_VALIDATION")
        .when(found > 0, "PARTIAL_MATCH_ONLY")
        .when(dynamic, "JS_RENDERED_CONTENT")
        .when((products > 0) & (prices == 0), "PRODUCT_FOUND_NO_PRICE")
        .when((products == 0) & (prices > 0), "PRICE_FOUND_NO_PRODUCT")
        .when(documents > 0, "JSON_DATA_FOUND_NO_MATCH")
        .when(products == 0, "HTML_NO_PRODUCT")
        .otherwise("UNSUPPORTED_STRUCTURE")
    )
