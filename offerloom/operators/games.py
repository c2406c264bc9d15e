"""Which game a page or an offer belongs to, and where its pages may lie.

Games are a table: game_id, place (order of the registry), name, short_name,
aliases and unit_aliases (arrays). Names in a text are found by joining its runs
of words with the names, so that no text is compared with every game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import pages, text, urls

# Words of packages, which name no game.
PACKAGE_ALIAS = rf"{text.WORD}(?:membership|subscription|pass|bundle|special data|zero data|welkin|starlight|voucher){text.END}"
# Packages that only one game has, in order of precedence, and words of packages that any game may have.
PACKAGE_GAME = [
    (rf"{text.WORD}welkin{text.END}|blessing of the welkin moon", "genshin-impact"),
    (rf"weekly diamond pass|{text.WORD}wdp{text.END}|starlight|twilight pass", "mobile-legends"),
    ("royale pass", "pubg-mobile"),
    ("honor pass", "honor-of-kings"),
    ("express supply pass", "honkai-star-rail"),
    ("inter knot membership", "zenless-zone-zero"),
    ("coronomicon monthly(?: package)?|^special data$|^zero data$", "chaos-zero-nightmare"),
    ("lunite subscription", "wuthering-waves"),
]
ANY_PACKAGE = rf"{text.WORD}(?:weekly|monthly|membership|member|subscription|battle pass|coupon pass|elite bundle|epic bundle|card){text.END}"
# What parts of a page prove, by where the name of a game stands.
TITLE, HEADING, META, STRUCTURED, SHORT_TITLE, SHORT_HEADING, UNIT, URL = 120, 110, 75, 70, 35, 30, 20, 100
BODY = [(3, 70), (2, 55), (1, 25)]
# Where shops keep the page of a game.
TEMPLATES = ["{homepage}/{gameSlug}", "{homepage}/games/{gameSlug}", "{homepage}/game/{gameSlug}", "{homepage}/topup/{gameSlug}", "{homepage}/top-up/{gameSlug}", "{homepage}/top-up-game/{gameSlug}", "{homepage}/product/{gameSlug}", "{homepage}/products/{gameSlug}"]


def _units() -> Column:
    return F.transform(F.coalesce(F.col("unit_aliases"), F.array().cast("array<string>")), lambda x: text.normalized(x))


def _aliases() -> Column:
    plain = F.transform(F.coalesce(F.col("aliases"), F.array().cast("array<string>")), lambda x: text.normalized(x))
    return F.filter(plain, lambda a: ~F.array_contains(_units(), a) & ~a.rlike(PACKAGE_ALIAS))


def _named() -> list[Column]:
    return [text.normalized(F.regexp_replace(F.col("game_id"), "-", " ")), text.normalized(F.col("name")), text.normalized(F.col("short_name"))]


def identities(games: DataFrame) -> DataFrame:
    """(game_id, place, identity, strong, size): names a game goes by, without those of its units and packages.

    A strong one has two words or four letters; size is its length without blanks.
    """
    every = F.filter(F.array_distinct(F.concat(F.array(*_named()), _aliases())), lambda x: x != "")
    size = F.char_length(F.replace("identity", F.lit(" "), F.lit("")))
    return games.select("game_id", "place", F.explode(every).alias("identity")).select("*", (F.contains("identity", F.lit(" ")) | (size >= 4)).alias("strong"), size.alias("size"))


def _runs(words: Column, longest: int) -> Column:
    """All runs of at most so many words."""
    runs = [F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")) for k in range(1, longest + 1)]  # noqa: B023
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(F.size(words) >= k, r).otherwise(none) for k, r in enumerate(runs, 1))))


def mentions(rows: DataFrame, key: list[str], column: str, names: DataFrame) -> DataFrame:
    """(key, place, mentioned, identity, strong, size): the names that stand in a text as whole phrases."""
    longest = names.agg(F.max(F.size(F.split("identity", " ")))).first()[0] or 1
    run = rows.select(*key, F.explode(_runs(F.split(text.normalized(F.col(column)), " "), longest)).alias("identity"))
    return run.join(F.broadcast(names.withColumnRenamed("game_id", "mentioned")), "identity")


def package_fits(name: Column, game_id: Column) -> Column:
    """Whether a package is the game's own, or one that any game may have."""
    plain, out = text.normalized(name), F.when(F.lit(False), F.lit(False))
    for pattern, owner in PACKAGE_GAME:
        out = out.when(plain.rlike(pattern), game_id == owner)
    return out.otherwise(plain.rlike(ANY_PACKAGE))


def offers_of_game(offers: DataFrame, games: DataFrame) -> DataFrame:
    """Offers (game_id, original_name, ...) whose name fits their game.

    One that names its game stays and one that names another goes; else it must
    count in a unit of the game or be a package of it, unless the game has no
    units. Names without letters go, games that are not registered have no units.
    """
    own = ["game_id", "original_name"]
    distinct = offers.select(*own).filter("trim(original_name) <> ''").distinct()
    named = mentions(distinct, own, "original_name", identities(games).filter("strong"))
    said = named.groupBy(*own).agg(F.bool_or(F.col("mentioned") == F.col("game_id")).alias("_own"))
    judged = distinct.join(said, own, "left").join(games.select("game_id", _units().alias("_units")), "game_id", "left")
    units = F.coalesce("_units", F.array().cast("array<string>"))
    counts = F.exists(units, lambda u: text.contains_phrase(text.normalized(F.col("original_name")), u))
    fits = F.coalesce(F.col("_own"), counts | package_fits(F.col("original_name"), F.col("game_id")) | (F.size(units) == 0))
    return offers.join(judged.filter(fits).select(*own), own, "left_semi")


def page_evidence(signals: DataFrame, games: DataFrame) -> DataFrame:
    """(page_id, game_id, ok, score, reason): whether a page is about the game it was fetched for.

    signals: page_id, game_id, title, heading, meta, structured, body, url, home.
    A page whose title and headings name only another game, or that is the home
    page again, proves nothing however much its body says; else a name in its
    title, headings, descriptions or data does, or twice in the body next to a
    unit. Of other games the one with the longest name is told, the first among
    equals. Games that are not registered give no row; null texts are empty.
    The registry goes to every executor: by game, all pages would land in as
    many tasks as there are games.
    """
    every = identities(games)
    own = every.groupBy("game_id").agg(F.collect_set(F.when(F.col("strong"), F.col("identity"))).alias("_strong"), F.collect_set(F.when(~F.col("strong"), F.col("identity"))).alias("_short"))
    rivals = mentions(signals.select("page_id", "game_id", F.concat_ws(" ", "title", "heading").alias("_t")), ["page_id", "game_id"], "_t", every.filter("strong")).filter("mentioned <> game_id")
    rival = rivals.groupBy("page_id", "game_id").agg(F.max_by("mentioned", F.struct("size", -F.col("place"))).alias("mentioned")).join(F.broadcast(games.select(F.col("game_id").alias("mentioned"), F.col("name").alias("_rival"))), "mentioned").drop("mentioned")
    rows = signals.join(F.broadcast(own.join(games.select("game_id", _units().alias("_units")), "game_id")), "game_id").join(rival, ["page_id", "game_id"], "left")

    def says(field: Column, names: str) -> Column:
        return F.exists(names, lambda n: text.contains_phrase(text.normalized(field), n))

    col = F.col
    title, heading, meta, structured = (says(col(c), "_strong") for c in ("title", "heading", "meta", "structured"))
    times = F.coalesce(F.array_max(F.transform("_strong", lambda n: pages.phrase_count(F.coalesce(col("body"), F.lit("")), n))), F.lit(0))
    unit = says(F.concat_ws(" ", "heading", "meta", "structured", "body"), "_units")
    body = F.when(F.lit(False), 0)
    for least, worth in BODY:
        body = body.when(times >= least, worth)
    worth = [(title, TITLE), (heading, HEADING), (meta, META), (structured, STRUCTURED), (says(col("title"), "_short"), SHORT_TITLE), (says(col("heading"), "_short"), SHORT_HEADING), (unit, UNIT), (says(col("url"), "_strong"), URL)]
    score = sum((F.when(c, w).otherwise(0) for c, w in worth), body.otherwise(0))
    clean = lambda c: F.regexp_replace(urls.path(col(c)), "^/+|/+$", "")
    home = F.coalesce((urls.host(col("home")) != "") & (urls.origin(col("url")) == urls.origin(col("home"))) & (clean("url") == clean("home")), F.lit(False))
    unproven = ~title & ~heading & ~structured
    proven = title | heading | meta | structured | ((times >= 2) & unit)
    reason = (
        F.when(col("_rival").isNotNull() & unproven, F.concat(F.lit("halaman terdeteksi sebagai "), "_rival"))
        .when(home & unproven, "URL mengarah kembali ke homepage/katalog umum")
        .when(proven, "halaman cocok dengan game")
        .otherwise("konten halaman tidak cukup membuktikan game yang dicari")
    )
    ok = ~((col("_rival").isNotNull() | home) & unproven) & proven
    return rows.select("page_id", "game_id", ok.alias("ok"), score.cast("int").alias("score"), reason.alias("reason"))


def slugs(games: DataFrame) -> DataFrame:
    """(game_id, slugs): at most four names of a game as they may stand in an address, its id always among them."""
    names = F.concat(F.array(text.normalized(F.col("game_id")), *_named()[1:]), _aliases())
    fit = F.filter(names, lambda n: (F.char_length(F.replace(n, F.lit(" "), F.lit(""))) >= 3) & ~F.array_contains(_units(), n) & ~n.rlike(PACKAGE_ALIAS))
    found = F.slice(F.array_distinct(F.transform(fit, lambda n: F.replace(n, F.lit(" "), F.lit("-")))), 1, 4)
    own = F.when(F.array_contains(found, F.col("game_id")), found).otherwise(F.concat(F.array("game_id"), found))
    return games.select("game_id", F.slice(own, 1, 4).alias("slugs"))


def guessed_urls(pairs: DataFrame, games: DataFrame) -> DataFrame:
    """(store_id, game_id, url, place): addresses at which a store may keep a game, its own templates before the common ones.

    pairs: store_id, game_id, homepage, templates (array, may be null).
    """
    every = F.concat(F.coalesce("templates", F.array().cast("array<string>")), F.array(*map(F.lit, TEMPLATES)))
    rows = pairs.join(slugs(games), "game_id")
    made = F.flatten(F.transform("slugs", lambda s: F.transform(every, lambda t: F.replace(F.replace(t, F.lit("{homepage}"), F.regexp_replace("homepage", "/$", "")), F.lit("{gameSlug}"), s))))
    whole = F.filter(F.array_distinct(F.transform(made, lambda u: urls.absolute(u, F.col("homepage")))), lambda u: u.isNotNull())
    return rows.select("store_id", "game_id", F.posexplode(whole).alias("place", "url"))
