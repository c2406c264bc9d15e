"""Outcomes of fetches: codes, retries and priorities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much each code tells about a provider.
PRIORITY = {
    "REGION_UNAVAILABLE": 150,
    "MAINTENANCE": 148,
    "PRODUCT_UNAVAILABLE": 146,
    "DYNAMIC_PRICE_REQUIRED": 144,
    "PARSER_FAILED": 100,
    "PAGE_NOT_VERIFIED": 95,
    "ACCESS_BLOCKED": 90,
    "RATE_LIMITED": 88,
    "NETWORK_TLS_ERROR": 80,
    "NETWORK_CONNECTION_ERROR": 78,
    "NETWORK_DNS_ERROR": 76,
    "NETWORK_CONNECT_TIMEOUT": 74,
    "NETWORK_FETCH_FAILED": 72,
    "TIMEOUT": 70,
    "UPSTREAM_ERROR": 60,
    "HTTP_ERROR": 50,
    "DISCOVERY_BLOCKED": 40,
    "CANDIDATE_BLOCKED": 35,
    "PAGE_NOT_FOUND": 20,
    "NOT_CONFIGURED": 10,
}
TERMINAL = ["REGION_UNAVAILABLE", "MAINTENANCE", "PRODUCT_UNAVAILABLE", "DYNAMIC_PRICE_REQUIRED"]
RETRYABLE = ["NETWORK_DNS_ERROR", "NETWORK_CONNECTION_ERROR", "NETWORK_CONNECT_TIMEOUT", "NETWORK_FETCH_FAILED", "TIMEOUT", "RATE_LIMITED"]


def code_of_status(status: Column) -> Column:
    return (
        F.when(status.isin(401, 403, 451), "ACCESS_BLOCKED")
        .when(status.isin(404, 410), "PAGE_NOT_FOUND")
        .when(status.isin(408, 504), "TIMEOUT")
        .when(status == 429, "RATE_LIMITED")
        .when(status >= 500, "UPSTREAM_ERROR")
        .otherwise("HTTP_ERROR")
    )


def is_retryable(code: Column, status: Column) -> Column:
    return F.coalesce(F.upper(code).isin(RETRYABLE), F.lit(False)) | F.coalesce(status.isin(502, 503, 504), F.lit(False))


def retry_delay_ms(retry_after_s: Column, base_ms: Column) -> Column:
    asked = F.least(F.lit(1500.0), retry_after_s.cast("double") * 1000)
    return F.when(retry_after_s > 0, asked).otherwise(F.greatest(F.lit(150.0), F.least(F.lit(750.0), F.coalesce(F.nullif(base_ms.cast("double"), F.lit(0.0)), F.lit(350.0)))))


def priority(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])[F.upper(F.trim(code))], F.lit(0))


def stops_chain(strategy: Column, code: Column, api_stops: Column, goes_on: Column) -> Column:
    """Whether no later strategy of the store is tried: proven states, rate limits, and most blocks."""
    code = F.upper(F.trim(code))
    blocked = F.when(strategy == "public-api", api_stops).when(strategy == "dedicated", ~goes_on).otherwise(F.lit(True))
    return F.coalesce(code.isin([*TERMINAL, "RATE_LIMITED"]) | ((code == "ACCESS_BLOCKED") & blocked), F.lit(False))
