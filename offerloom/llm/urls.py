"""URL filtering by given rules and by a tree of path templates, with DataFrame functions only.

1. A rule is a host and a path prefix. It fits its host and all subdomains, if
   the path of the URL starts with the rule's; the longest rule wins. URLs that
   a rule decides are the labelled ones.
2. Per host, the segments of the paths form a tree. A run of digits becomes
   `#`; below a node with many children among which none stands out, all
   children become `*`. Children are weighed by their distinct paths, so
   repeated URLs change nothing. This goes level by level, so that a node's
   children are counted below its own template, until no node has enough paths
   below it to have that many children; what is left of a path stays as it is.
3. A branch (host, template) is merged with its siblings below the same node as
   long as a two-proportion z-test doesn't tell their shares of blocked URLs
   apart; what differs stands alone. Branches without any label in what they
   are merged with take the labels of their template on all hosts.
4. A template is rejected if its share of blocked among labelled URLs, smoothed
   by SMOOTH URLs of the share of all, reaches REJECT.

Rows are aggregated to distinct branches before anything is joined, so a host
with a third of all URLs is as many rows as it has templates, and the joins back
to them and to the URLs are plain equi-joins which adaptive execution splits
where one host is large. Nothing is broadcast by hint.

Defined results: a null URL or one without `://` has an empty host and path and
is judged like any other URL of these; ties between rules of one length go to
the one given first; without any labelled URL nothing is rejected; repeated rows
are judged alike, each gives a row; an empty table gives an empty one; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.durable import durable

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MANY, EVEN = 8, 4  # a node is variable from so many children on, if none has EVEN times the mean of their paths
SMOOTH, REJECT, Z2 = 5, 0.5, 3.84  # pseudo-count, share from which a template goes, square of z at 95 %
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, _URL, 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = out.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def general(path: Column) -> Column:
    """A path without its first slash, runs of digits generalised."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#")


def templates(branches: DataFrame) -> DataFrame:
    """Adds the template and its parent's to distinct (host, general, labelled, blocked)."""
    now = branches.withColumns({"parts": F.split("general", "/"), "template": F.lit("")})
    level, done = 0, []
    while True:
        segment = F.get("parts", level)
        children = now.filter(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(F.count("*").alias("paths"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("paths").alias("below"), F.max("paths").alias("most")).filter(F.col("below") >= MANY)
        variable = (F.col("children") >= MANY) & (F.col("most") * F.col("children") < EVEN * F.col("below"))
        here = durable(now.join(nodes.select("host", "template", variable.alias("variable")), ["host", "template"], "left"))
        rest = F.concat("template", F.lit("/"), F.array_join(F.slice("parts", level + 1, F.size("parts")), "/"))
        ends = segment.isNull() | F.col("variable").isNull()
        done.append(here.filter(ends).withColumn("template", F.when(segment.isNull(), F.col("template")).otherwise(rest)).drop("variable", "parts"))
        now = here.filter(~ends).withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("variable"), "*").otherwise(segment))).drop("variable")
        level += 1
        if now.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))


def _apart(n1: Column, b1: Column, n2: Column, b2: Column) -> Column:
    """Whether two shares of blocked URLs differ."""
    n1, b1, n2, b2 = (c.cast("double") for c in (n1, b1, n2, b2))
    return (n1 > 0) & (n2 > 0) & ((b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) > Z2 * n1 * n2 * (b1 + b2) * (n1 + n2 - b1 - b2))


def judged(urls: DataFrame) -> DataFrame:
    """(host, general, template, purity) for each distinct generalised path of (host, general, verdict)."""
    branches = durable(urls.groupBy("host", "general").agg(F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked")))
    named = templates(branches)
    branch = named.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    siblings = branch.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    merged = branch.join(siblings, ["host", "parent"])
    apart = _apart(F.col("n"), F.col("b"), F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b"))
    merged = merged.select("host", "parent", "template", "n", "b", *(F.when(apart, F.col(own)).otherwise(F.col(pool)).alias(f"own_{own}") for own, pool in (("n", "all_n"), ("b", "all_b"))))
    pool = branch.groupBy("template").agg(F.sum("n").alias("pool_n"), F.sum("b").alias("pool_b"))
    whole = pool.agg(F.sum("pool_n").alias("sum_n"), F.sum("pool_b").alias("sum_b"))  # one row
    counts = merged.join(pool, "template").crossJoin(F.broadcast(whole))  # a single row of two sums
    n, b = (F.when(F.col("own_n") > 0, F.col(f"own_{c}")).otherwise(F.col(f"pool_{c}")).cast("double") for c in ("n", "b"))
    prior = F.when(F.col("sum_n") > 0, F.col("sum_b") / F.col("sum_n")).otherwise(F.lit(0.0))
    purity = F.round((b + SMOOTH * prior) / (n + SMOOTH), 9)
    return named.select("host", "parent", "general", "template").join(counts.select("host", "parent", "template", purity.alias("purity")), ["host", "parent", "template"]).select("host", "general", "template", "purity")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per URL: id, host, path, rule, template, purity and verdict."""
    url = F.col(url_col)
    urls = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    urls = urls.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"), general(F.col("path")).alias("general"))
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return urls.join(judged(urls), ["host", "general"], "left").select(id_col, "host", "path", "rule", "template", "purity", F.coalesce("verdict", own).alias("verdict"))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


SQL_LEVELS = 12  # the SQL is written out level by level, for paths of so many segments; the DataFrame goes on where paths do


def _level_sql(k: int) -> str:
    return f"""
t{k + 1} AS (SELECT t.* REPLACE (CASE WHEN len(parts) <= {k} THEN t.template ELSE t.template || '/' || CASE WHEN v.host IS NOT NULL THEN '*' ELSE parts[{k + 1}] END END AS template,
    CASE WHEN len(parts) <= {k} THEN t.parent ELSE t.template END AS parent)
  FROM t{k} t LEFT JOIN (SELECT host, template FROM (SELECT host, template, parts[{k + 1}] AS s, count(*) AS paths FROM t{k} WHERE len(parts) > {k} GROUP BY ALL)
    GROUP BY ALL HAVING count(*) >= {MANY} AND max(paths) * count(*) < {EVEN} * sum(paths)) v ON v.host = t.host AND v.template = t.template),"""


OP1_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
rules(v, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
r AS (SELECT u.page_id, u.host, u.path, any_value(f.rule) AS rule, any_value(f.v) AS verdict FROM u LEFT JOIN
  (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT host, path FROM u) x, rules
   WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL) f ON f.host = u.host AND f.path = u.path GROUP BY ALL),
g AS (SELECT *, regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g') AS general FROM r),
t0 AS (SELECT host, general, string_split(general, '/') AS parts, count(verdict) AS labelled, count(*) FILTER (verdict = 'block') AS blocked, '' AS template, '' AS parent FROM g GROUP BY ALL),
{"".join(_level_sql(k) for k in range(SQL_LEVELS))}
b AS (SELECT host, parent, template, sum(labelled)::DOUBLE AS n1, sum(blocked)::DOUBLE AS b1 FROM t{SQL_LEVELS} GROUP BY ALL),
z AS (SELECT *, sum(n1) OVER (PARTITION BY host, parent) AS an, sum(b1) OVER (PARTITION BY host, parent) AS ab, sum(n1) OVER (PARTITION BY template) AS pn, sum(b1) OVER (PARTITION BY template) AS pb FROM b),
y AS (SELECT *, an - n1 AS n2, ab - b1 AS b2 FROM z),
x AS (SELECT *, n1 > 0 AND n2 > 0 AND (b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) > {Z2} * n1 * n2 * (b1 + b2) * (n1 + n2 - b1 - b2) AS apart FROM y),
w AS (SELECT *, CASE WHEN apart THEN n1 ELSE an END AS mn, CASE WHEN apart THEN b1 ELSE ab END AS mb FROM x),
a AS (SELECT CASE WHEN sum(n1) > 0 THEN sum(b1) / sum(n1) ELSE 0 END AS prior FROM b),
q AS (SELECT host, parent, template, round((CASE WHEN mn > 0 THEN mb ELSE pb END + {SMOOTH} * prior) / (CASE WHEN mn > 0 THEN mn ELSE pn END + {SMOOTH}), 9) AS purity FROM w, a),
m AS (SELECT t.host, t.general, purity FROM t{SQL_LEVELS} t JOIN q ON q.host = t.host AND q.parent = t.parent AND q.template = t.template)
SELECT g.page_id, g.host, g.path, g.rule, coalesce(g.verdict, CASE WHEN m.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN m ON m.host = g.host AND m.general = g.general
"""
