"""Failures of providers as states a user understands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.text import END, WORD

# Error codes of sockets and certificates, and words of their messages, in order of precedence.
NETWORK = [
    ("NETWORK_DNS_ERROR", "^(?:ENOTFOUND|EAI_AGAIN)$", rf"getaddrinfo|{WORD}dns{END}"),
    ("NETWORK_CONNECTION_ERROR", "^(?:ECONNRESET|ECONNREFUSED|EPIPE|UND_ERR_SOCKET)$", "connection reset|socket|econnreset|econnrefused"),
    ("NETWORK_TLS_ERROR", "^(?:CERT_.*|ERR_TLS_.*|UNABLE_TO_VERIFY_LEAF_SIGNATURE|DEPTH_ZERO_SELF_SIGNED_CERT)$", rf"certificate|{WORD}tls{END}|{WORD}ssl{END}"),
    ("NETWORK_CONNECT_TIMEOUT", "^(?:ETIMEDOUT|UND_ERR_CONNECT_TIMEOUT)$", "connect timeout|timed out"),
]
# States that a code alone proves.
PROVEN = ["REGION_UNAVAILABLE", "DYNAMIC_PRICE_REQUIRED", "PRODUCT_UNAVAILABLE", "MAINTENANCE"]
# Fixed values, in order of precedence: code, statuses, words of the message, state, detail, status if none is known, worth a retry.
LADDER = [
    ("CANDIDATE_BLOCKED", (), "", "CANDIDATE_BLOCKED", "", 403, False),
    ("DISCOVERY_BLOCKED", (), "", "DISCOVERY_BLOCKED", "", 403, False),
    ("ACCESS_BLOCKED", (401, 403, 451), rf"{WORD}forbidden{END}", "ACCESS_BLOCKED", "code or HTTP", None, False),
    ("RATE_LIMITED", (429,), "too many requests|rate.?limit", "RATE_LIMITED", "", 429, True),
    ("NETWORK_DNS_ERROR", (), rf"getaddrinfo|{WORD}dns{END}|enotfound|eai_again", "NETWORK_ERROR", "", None, True),
    ("NETWORK_TLS_ERROR", (), rf"certificate|{WORD}tls{END}|{WORD}ssl{END}", "NETWORK_ERROR", "", None, False),
    ("NETWORK_CONNECTION_ERROR", (), "econnreset|econnrefused|connection reset|socket", "NETWORK_ERROR", "", None, True),
    ("NETWORK_CONNECT_TIMEOUT", (), "connect timeout|etimedout|und_err_connect_timeout", "NETWORK_ERROR", "", None, True),
    ("TIMEOUT", (), "timeout", "TIMEOUT", "", None, True),
    ("PAGE_NOT_VERIFIED", (), "halaman tidak cocok|konten halaman tidak cukup membuktikan|homepage/katalog umum|halaman terdeteksi sebagai", "PAGE_NOT_VERIFIED", "", None, False),
    ("PARSER_FAILED", (), "harga/produk|harga tidak ditemukan|feed tidak mengembalikan produk|struktur halaman belum didukung|konten produk kemungkinan dimuat|produk berhasil dibaca|public api", "PARSER_FAILED", "reason", None, False),
    ("NOT_CONFIGURED", (), "url toko belum dikonfigurasi|url feed belum diatur|endpoint belum dikonfigurasi|method public api", "NOT_CONFIGURED", "", None, False),
    ("PAGE_NOT_FOUND", (404, 410), "", "PAGE_NOT_FOUND", "", None, False),
    ("UPSTREAM_ERROR", (), "", "UPSTREAM_ERROR", "code", None, True),
    ("NETWORK_FETCH_FAILED", (), "fetch failed|network", "NETWORK_ERROR", "", None, True),
]


def _upper(text: Column) -> Column:
    return F.upper(F.coalesce(text, F.lit("")))


def network_code(code: Column, message: Column) -> Column:
    """Which kind of network failure an error of a fetch is."""
    code, message = _upper(code), F.lower(F.coalesce(message, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, codes, words in NETWORK:
        out = out.when(code.rlike(codes) | message.rlike(words), F.lit(name))
    return out.otherwise("NETWORK_FETCH_FAILED")


def http_status(status: Column, message: Column) -> Column:
    """The status that an error carries, or that its message names."""
    return F.coalesce(F.when(status > 0, status.cast("int")), F.regexp_extract(F.coalesce(message, F.lit("")), r"(?i)HTTP\s+(\d{3})", 1).try_cast("int"))


def classified(code: Column, message: Column, status: Column, reason: Column) -> Column:
    """Struct (status_code, detail_code, http_status, retryable) of a failure; the first rule that fits decides."""
    code, text, given = _upper(code), F.lower(F.coalesce(message, F.lit(""))), F.nullif(_upper(reason), F.lit(""))
    http = http_status(status, message)

    def state(name: str, detail: Column, known: Column, retryable: bool) -> Column:
        return F.struct(F.lit(name).alias("status_code"), detail.alias("detail_code"), known.alias("http_status"), F.lit(retryable).alias("retryable"))

    out = F.when(F.lit(False), state("", F.lit(""), http, False))
    for name in PROVEN:
        out = out.when(code == name, state(name, F.coalesce(given, code), http, False))
    own = F.nullif(code, F.lit(""))
    for name, statuses, words, means, detail, known, retryable in LADDER:
        fits = code == name
        if statuses:
            fits |= F.coalesce(http.isin(*statuses), F.lit(False))
        if name == "UPSTREAM_ERROR":
            fits |= F.coalesce(http >= 500, F.lit(False))
        if words:
            fits |= text.rlike(words)
        says = {
            "": F.lit(name),
            "code or HTTP": F.coalesce(own, F.concat(F.lit("HTTP_"), F.coalesce(http.cast("string"), F.lit("null")))),
            "code": F.coalesce(own, F.lit(name)),
            "reason": F.coalesce(given, F.lit("UNSUPPORTED_STRUCTURE")),
        }[detail]
        out = out.when(fits, state(means, says, F.coalesce(http, F.lit(known).cast("int")), retryable))
    return out.otherwise(state("UNKNOWN_ERROR", F.coalesce(own, F.lit("UNKNOWN_ERROR")), http, False))


def converted(code: Column, phase: Column) -> Column:
    """A block met on a guessed address or on the home page says nothing of the store as a whole."""
    code = _upper(code)
    blocked = code == "ACCESS_BLOCKED"
    return F.when(blocked & (phase == "guessed"), "CANDIDATE_BLOCKED").when(blocked & (phase == "discovery"), "DISCOVERY_BLOCKED").otherwise(code)
