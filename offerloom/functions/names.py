"""Package names: special types, units, amounts, multipliers and canonical keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import normalized

# Special package types in order of precedence (type, pattern, label).
SPECIAL_TYPES = [
    ("weekly-pass", r"weekly\s+diamond\s+pass|weekly\s+pass|wdp", "Weekly Diamond Pass"),
    ("weekly-card-plus", r"weekly\s+card\s+plus", "Weekly Card Plus"),
    ("weekly-card", r"weekly\s+card", "Weekly Card"),
    ("welkin", r"welkin|blessing\s+of\s+the\s+welkin\s+moon", "Blessing of the Welkin Moon"),
    ("starlight", r"starlight", "Starlight Membership"),
    ("twilight", r"twilight\s+pass", "Twilight Pass"),
    ("elite-bundle", r"weekly\s+elite\s+bundle", "Weekly Elite Bundle"),
    ("epic-bundle", r"monthly\s+epic\s+bundle", "Monthly Epic Bundle"),
    ("battle-pass", r"battle\s+pass|royale\s+pass|honor\s+pass", "Battle Pass"),
    ("monthly-pass", r"monthly\s+pass|kafra\s+monthly", "Monthly Pass"),
    ("express-supply-pass", r"express\s+supply\s+pass", "Express Supply Pass"),
    ("inter-knot-membership", r"inter[-\s]*knot\s+membership", "Inter-Knot Membership"),
    ("coronomicon-monthly", r"coronomicon\s+monthly(?:\s+package)?", "Coronomicon Monthly Package"),
    ("special-data", r"(?:^|[^a-z0-9_])special\s+data(?:$|[^a-z0-9_])", "Special Data"),
    ("zero-data", r"(?:^|[^a-z0-9_])zero\s+data(?:$|[^a-z0-9_])", "Zero Data"),
    ("lunite-subscription", r"lunite\s+subscription", "Lunite Subscription"),
    ("membership", r"membership|member", "Membership"),
]
# Units in order of precedence (unit, pattern).
UNITS = [
    ("Lunar Crystals", r"lunar\s+crystals?"),
    ("Genesis Crystals", r"genesis\s+crystals?"),
    ("Oneiric Shards", r"oneiric\s+shards?"),
    ("Riftcrystals", r"rift\s*crystals?"),
    ("Origeometry", r"origeometry"),
    ("Starstones", r"starstones?"),
    ("Monochrome", r"monochrome"),
    ("Lunites", r"lunites?"),
    ("Opals", r"opals?"),
    ("Robux", r"robux"),
    ("Diamonds", r"diamonds?"),
    ("UC", r"(?:^|[^a-z0-9_])uc(?:$|[^a-z0-9_])"),
    ("CP", r"(?:^|[^a-z0-9_])cp(?:$|[^a-z0-9_])|call\s+of\s+duty\s+points?"),
    ("VP", r"(?:^|[^a-z0-9_])vp(?:$|[^a-z0-9_])|valorant\s+points?"),
    ("Crystals", r"crystals?"),
    ("Tokens", r"tokens?"),
    ("Points", r"points?"),
    ("Coins", r"coins?"),
    ("Vouchers", r"vouchers?"),
]
# Fixed value: units that a bare amount may stand before.
COUNTED = r"lunar\s+crystals?|genesis\s+crystals?|oneiric\s+shards?|rift\s*crystals?|origeometry|starstones?|monochrome|lunites?|opals?|robux|diamonds?|uc|cp|vp|valorant\s+points?|crystals?|tokens?|points?|coins?|vouchers?"
# Base and bonus amounts in order of precedence, then a single amount; names of conditional offers.
TWO_AMOUNTS = [
    r"\((\d[\d.]*)\s*\+\s*(\d[\d.]*)\s*(?:bonus)?\)",
    rf"(\d[\d.]*)\s*(?:{COUNTED})?\s*\+\s*(\d[\d.]*)\s*bonus",
    r"(?:^|\s)(\d[\d.]*)\s*\+\s*(\d[\d.]*)(?:\s|$)",
]
ONE_AMOUNT = rf"(\d[\d.]*)\s*(?:{COUNTED})"
CONDITIONAL = r"first\s*top\s*up|first\s*recharge|pengguna\s*baru|new\s*user|promo"




def _place(text: Column, table: list[tuple]) -> Column:
    """Place (from 0) of the first row whose pattern, its second member, is found in lower-case text; null if none is."""
    out = F.when(F.lit(False), F.lit(0))
    for k, row in enumerate(table):
        out = out.when(text.rlike(row[1]), F.lit(k))
    return out


def _named(place: Column, table: list[tuple], member: int) -> Column:
    return F.get(F.array(*(F.lit(row[member]) for row in table)), place)


def unit_of(name: Column) -> Column:
    """The unit that a name counts; null without one."""
    return _named(_place(F.lower(name), UNITS), UNITS, 0)


def multiplier(name: Column) -> Column:
    """First `x` or `×` before a number; 1 without one. Not anchored: `Max 5` counts 5."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(name, r"(?i)[x×]\s*(\d+)", 1).try_cast("bigint"), F.lit(1)))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit("")).try_cast("bigint")


def dotted(number: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.translate(F.format_number(number, 0), ",", ".")


#: What a name says about its package.
PACKAGE = ["package_type", "canonical_name", "canonical_key", "unit", "multiplier", "base_amount", "bonus_amount", "total_amount", "eligibility"]


def canonicalized(rows: DataFrame, name_col: str = "original_name") -> DataFrame:
    """Adds everything that decides which offers are one package.

    Many offers share a name, so the patterns are tried on the distinct names
    (which combine before their shuffle), and an equi-join brings the result
    back; where one name is hot, adaptive execution splits its rows.
    """
    own = packages(rows.select(F.col(name_col).alias("_name")).distinct(), "_name")
    return rows.join(own, rows[name_col].eqNullSafe(own["_name"])).select(*(rows[c] for c in rows.columns), *PACKAGE)


def packages(rows: DataFrame, name_col: str = "original_name") -> DataFrame:
    """Adds the columns of PACKAGE. Dots and commas of amounts part thousands.

    The patterns are long; steps that are used more than once are columns of
    their own, so that each pattern is tried once a row.
    """
    kept = rows.columns
    rows = rows.withColumn("_nm", F.trim(F.coalesce(F.col(name_col), F.lit(""))))
    rows = rows.withColumns({"_low": F.lower("_nm"), "_plain": F.lower(F.replace("_nm", F.lit(","), F.lit(".")))})
    rows = rows.withColumns({
        "_special": _place(F.col("_low"), SPECIAL_TYPES),
        "_unit": _place(F.col("_low"), UNITS),
        "multiplier": multiplier(F.col("_nm")),
        "base_amount": F.coalesce(*(_number(F.regexp_extract("_plain", p, 1)) for p in [*TWO_AMOUNTS, ONE_AMOUNT])),
        "_bonus": F.coalesce(*(_number(F.regexp_extract("_plain", p, 2)) for p in TWO_AMOUNTS)),
        "eligibility": F.when(F.col("_low").rlike(CONDITIONAL), F.lit("conditional")).otherwise(F.lit("all-users")),
    })
    rows = rows.withColumns({
        "package_type": _named(F.col("_special"), SPECIAL_TYPES, 0),
        "unit": F.coalesce(_named(F.col("_unit"), UNITS, 0), F.lit("Item")),
        "bonus_amount": F.coalesce("_bonus", F.when(F.col("base_amount").isNotNull(), F.lit(0)).cast("bigint")),
    })
    rows = rows.withColumn("total_amount", F.col("base_amount") + F.col("bonus_amount"))
    special, many, total = F.col("package_type"), F.col("multiplier").cast("string"), F.col("total_amount")
    counted = total > 0
    rows = rows.withColumns({
        "canonical_name": F.when(special.isNotNull(), F.concat(_named(F.col("_special"), SPECIAL_TYPES, 2), F.when(F.col("multiplier") > 1, F.concat(F.lit(" x"), many)).otherwise(F.lit("")))).when(counted, F.concat(dotted(total), F.lit(" "), "unit")).otherwise(F.col("_nm")),
        "canonical_key": F.when(special.isNotNull(), F.concat(special, F.lit(":"), many)).when(counted, F.concat(F.lit("currency:"), F.lower("unit"), F.lit(":"), total.cast("string"))).otherwise(F.concat(F.lit("other:"), normalized(F.col("_nm")))),
        "package_type": F.coalesce(special, F.when(counted, F.lit("currency")).otherwise(F.lit("other"))),
    })
    return rows.select(*kept, *PACKAGE)
