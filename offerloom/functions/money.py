"""Prices in rupiah, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.text import END, WORD, bound, speaks_of_rupiah

# How a price is marked, and the forms of its number (thousands by dots, thousands by commas, cents).
MARK = rf"(?:{WORD}idr{END}|{WORD}rp\s*\.?)"
NUMBER = "([0-9][0-9.,]*)"
BY_DOTS, BY_COMMAS, CENTS = r"^\d{1,3}(?:\.\d{3})+(?:,\d{2})?$", r"^\d{1,3}(?:,\d{3})+(?:\.\d{2})?$", r"^\d+[.,]\d{2}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "").try_cast("bigint")


def _rounded(text: Column) -> Column:
    return F.floor(F.replace(text, F.lit(","), F.lit(".")).try_cast("double") + 0.5).cast("bigint")


def _whole(text: Column) -> Column:
    """Digits of a number by thousands, its cents cut off."""
    return F.translate(F.regexp_replace(text, r"[.,]\d{2}$", ""), ".,", "").try_cast("bigint")


def token(text: Column) -> Column:
    """Whole rupiah of a number: thousands by dots or commas with cents cut off; else two decimals rounded; else all digits."""
    return bound(F.regexp_replace(text, r"\s+", ""), lambda t: F.when(t.rlike(BY_DOTS) | t.rlike(BY_COMMAS), _whole(t)).when(t.rlike(CENTS), _rounded(t)).otherwise(_digits(t)))


def cleaned(text: Column) -> Column:
    """Lower case, blanks of all kinds as one kind, none at the ends."""
    text = F.lower(F.translate(F.coalesce(text, F.lit("")), "\u00a0\u2007\u202f", "   "))
    return F.regexp_replace(text, r"^[\s\ufeff]+|[\s\ufeff]+$", "")


def _number(text: Column) -> Column:
    """The number of a cleaned price: behind its mark, before its currency, or the whole text; null if it has none."""
    said = lambda found: bound(found, lambda x: F.when(x != "", x))
    before = F.when(speaks_of_rupiah(text), said(F.regexp_extract(text, rf"{MARK}\s*[:=\-]?\s*{NUMBER}", 1)))
    after = F.when(F.contains(text, F.lit("idr")) | F.contains(text, F.lit("rupiah")), said(F.regexp_extract(text, rf"{NUMBER}\s*{WORD}(?:idr|rupiah){END}", 1)))
    return F.coalesce(before, after, F.when(text.rlike(r"^[0-9][0-9.,]*$"), text))


def rupiah(text: Column) -> Column:
    """Price marked before or after by its currency, or a text that is a number as a whole; else null, never part of a name."""
    return token(bound(cleaned(text), _number))


def bare_number(text: Column) -> Column:
    """The number of a lower-case text that is a marked price and nothing else, which is no product and no sentence; else empty."""
    return F.when(speaks_of_rupiah(text), F.regexp_extract(text, rf"^{MARK}\s*[:=\-]?\s*{NUMBER}$", 1)).otherwise(F.lit(""))


def _positive(price: Column) -> Column:
    return bound(price, lambda p: F.when(p > 0, p))


def structured(text: Column) -> Column:
    """Price of a structured record: marked, or else whatever digits there are; null unless above nothing."""

    def loose(bare: Column) -> Column:
        price = (
            F.when(bare.rlike(r"^\d{1,3}(?:\.\d{3})+$") | bare.rlike(r"^\d{1,3}(?:,\d{3})+$"), _digits(bare))
            .when(bare.rlike(r"^\d+[.,]\d{1,2}$"), _rounded(bare))
            .otherwise(_digits(bare))
        )
        return F.when(bare.rlike("[1-9]"), price)

    return bound(cleaned(text), lambda t: F.coalesce(_positive(token(_number(t))), bound(F.regexp_replace(t, "[^0-9.,]", ""), loose)))


def spaced(text: Column) -> Column:
    """A dot or colon after the mark as a blank: `Rp . 21.635`, `IDR: 25.000`."""
    text = F.regexp_replace(cleaned(text), rf"{WORD}rp\s*[.:]\s*", "rp ")
    return F.regexp_replace(text, rf"{WORD}idr\s*:\s*", "idr ")


def recovered(text: Column) -> Column:
    return rupiah(spaced(text))


def _first(text: Column, price) -> Column:
    """Price of the first marked number of a line that has one above nothing."""
    tokens = lambda t: F.when(speaks_of_rupiah(t), F.regexp_extract_all(t, F.lit(rf"{MARK}\s*[:=\-]?\s*[0-9][0-9.,]*"), F.lit(0)))
    return F.get(F.filter(F.transform(bound(F.lower(text), tokens), price), lambda p: p > 0), 0)


def first_of_line(text: Column) -> Column:
    """The first price of a line is what is asked; a later one is what was asked before."""
    return _first(text, recovered)


def strict(text: Column) -> Column:
    """Price with its currency in front, of 100 at least; cents are never rounded."""
    own = F.regexp_extract(spaced(text), rf"(?:{WORD}idr{END}|{WORD}rp{END})\s*{NUMBER}", 1)
    price = bound(own, lambda t: F.when(t.rlike(BY_DOTS) | t.rlike(BY_COMMAS), _whole(t)).otherwise(_digits(t)))
    return bound(price, lambda p: F.when(p >= 100, p))


def first_strict(text: Column) -> Column:
    return _first(text, strict)


def api_price(text: Column, scale: Column) -> Column:
    """Price of an interface's field in units of `scale`; null unless above nothing."""
    return bound(rupiah(text), lambda price: F.when(price > 0, F.when(scale > 0, F.floor(price * scale + 0.5).cast("bigint")).otherwise(price)))


def has_mark(text: Column) -> Column:
    """Whether a page speaks of rupiah at all."""
    return F.coalesce(F.lower(text).rlike(rf"{MARK}|{WORD}rupiah{END}"), F.lit(False))


def has_price(line: Column) -> Column:
    return F.coalesce(bound(F.lower(line), lambda t: speaks_of_rupiah(t) & t.rlike(rf"{MARK}\s*[1-9][0-9.,]*")), F.lit(False))


def is_start_price(line: Column) -> Column:
    """`Mulai Rp 15.000` is where prices begin and not a price."""
    return F.coalesce(bound(F.lower(line), lambda t: speaks_of_rupiah(t) & t.rlike(rf"(?:mulai|start(?:ing)?\s+from|from)\s*{MARK}")), F.lit(False))


def is_rupiah_code(currency: Column) -> Column:
    return F.coalesce(cleaned(currency).rlike("^(?:idr|rp|rupiah)$"), F.lit(False))
