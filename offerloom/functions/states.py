"""States in which a store's page offers nothing for sale, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions import money, urls
from offerloom.functions.text import END, WORD, contains_phrase, normalized

# What pages say that are being worked on, that have nothing, or whose prices come later.
MAINTENANCE = r"(?i)produk sedang maintenance|sedang maintenance|product maintenance|under maintenance|temporarily under maintenance|sedang dalam perbaikan"
GONE = r"(?i)produk tidak lagi tersedia|product is no longer available|product no longer available|produk tidak tersedia|product unavailable|this product is unavailable|item tidak tersedia"
VOUCHERS = r"(?i)voucher game|game voucher"
AMOUNT_GONE = r"(?i)tidak tersedia untuk jumlah ini|this amount is currently unavailable"
CHOOSE_NOMINAL = r"(?i)pilih nominal|select nominal|daftar nominal"
LOADING = r"(?i)memuat produk|loading products|loading product"
CHOOSE_SOON = r"(?i)(?:pilih|select|choose).{0,50}(?:nominal|denomination|produk|product)"
CHOOSE_ANY = r"(?i)(?:pilih|select|choose).{0,50}(?:nominal|denomination|jumlah|amount|produk|product)"
NOTHING = rf"(?i)(?:{WORD}IDR{END}|{WORD}Rp\s*\.?)\s*0(?:[.,]00)?{END}"
#: Stores whose pages are read by rules of their own.
BY_LOCALE, BY_VOUCHER, BY_AMOUNT, BY_NOMINAL = "codashop", "seagm", "unipin", "topupdeh"


def says_any(text: Column, phrases: Column) -> Column:
    """Whether one of the phrases (normalised, of three letters at least) stands in a text."""
    plain = normalized(text, "fold")
    return F.coalesce(F.exists(F.filter(phrases, lambda p: F.char_length(p) >= 3), lambda p: contains_phrase(plain, p)), F.lit(False))


def page_state(store_id: Column, text: Column, final_url: Column, names: Column, units: Column, locale: Column) -> Column:
    """Struct (code, reason) of a page that explains why it has no prices; null if it doesn't.

    names and units: what the game and its units are called, normalised; locale:
    the path that the store's pages must lie under, null if there is none. The
    first rule that fits decides; null texts are empty.
    """
    text = F.coalesce(text, F.lit(""))
    found, priced = says_any(text, names), money.has_price(text)
    state = lambda code, reason: F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
    path = F.nullif(urls.path(final_url), F.lit(""))
    moved = locale.isNotNull() & (urls.host(final_url) != "") & ~F.startswith(F.coalesce(path, F.lit("/")), locale)
    later = text.rlike(LOADING) | (text.rlike(NOTHING) & text.rlike(CHOOSE_ANY)) | (text.rlike(CHOOSE_SOON) & ~priced)
    return (
        F.when((store_id == BY_LOCALE) & F.coalesce(moved, F.lit(False)), state("REGION_UNAVAILABLE", "REGION_REDIRECT"))
        .when(text.rlike(MAINTENANCE), state("MAINTENANCE", "PRODUCT_MAINTENANCE"))
        .when(text.rlike(GONE), state("PRODUCT_UNAVAILABLE", "PRODUCT_UNAVAILABLE"))
        .when((store_id == BY_VOUCHER) & found & text.rlike(VOUCHERS) & ~says_any(text, units) & ~priced, state("PRODUCT_UNAVAILABLE", "DIRECT_TOPUP_NOT_AVAILABLE"))
        .when((store_id == BY_AMOUNT) & found & text.rlike(AMOUNT_GONE), state("DYNAMIC_PRICE_REQUIRED", "PAYMENT_STATE_REQUIRED"))
        .when((store_id == BY_NOMINAL) & found & text.rlike(CHOOSE_NOMINAL) & ~priced, state("DYNAMIC_PRICE_REQUIRED", "DYNAMIC_PRODUCT_DATA"))
        .when(found & later, state("DYNAMIC_PRICE_REQUIRED", "DYNAMIC_PRICE_REQUIRED"))
    )
