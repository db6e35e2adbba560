"""URL filter: explicit rules first, then a tree of path templates judged by smoothed purity (DataFrame functions only).

Method.  Pages are reduced to (host, path) counts.  In each path, segments with digits become ``{n}`` (an extension
stays).  Each host's tree is then built level by level, and below every parent template

* branches of ``rare`` pages at most become ``{v}`` where there are ``many`` of them (a variable segment without digits);
* a labelled branch whose smoothed block rate differs by less than ``z`` standard errors from that of its labelled
  siblings together (smoothed too) is alike and merges with the others of that kind into ``*``;
* all other branches keep their segment: labels of one never speak for a sibling that has none.

Levels end with the longest path; segments beyond ``depth`` count as one last segment.  Labelled pages are those that a
rule decides.  A page with no rule gets the verdict of its template: block where its smoothed purity

    (blocked + weight * elsewhere) / (labelled + weight) >= ``purity``

where ``elsewhere`` is what rules say of the same template on other hosts: (blocked + weight * prior) / (labelled +
weight) over those hosts whose own block rate for it is alike to that of all others together, by the test above.  The
prior is the mean block rate of the host's labelled templates, each counting once, shrunk by ``weight`` to the mean of
all hosts' templates.  So a template without labels of its own is rejected where rules block nearly all pages of its kind
on other hosts, or most templates of its host; hosts that disagree about a template speak for none.

Results for odd input: a null url or one without ``://`` has empty host and path and is judged with all others of that
kind; repeated rows and null ids each get a row; very long urls are judged whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def segment_class(segment: Column) -> Column:
    """The segment with its variable part as a wildcard: 39547.html and 12.html become {n}.html."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]+$", "")
    return F.when(stem.rlike("[0-9]"), F.concat(F.lit("{n}"), ext)).otherwise(segment)


@dataclass(frozen=True)
class Tree:
    """How branches merge and templates are rejected."""

    depth: int = 16
    many: int = 10
    rare: int = 2
    z: float = 2.0
    weight: float = 4.0
    purity: float = 0.8


def judge_templates(paths: DataFrame, t: Tree) -> DataFrame:
    """``paths``: host, gpath, n, labelled, blocked (host and gpath together unique).  Adds template, score, blocks."""
    parts = F.split(F.regexp_replace("gpath", "^/", ""), "/")
    last = F.array_join(F.slice(parts, t.depth, F.greatest(F.size(parts) - (t.depth - 1), F.lit(0))), "/")
    cut = F.when(F.size(parts) > t.depth, F.concat(F.slice(parts, 1, t.depth - 1), F.array(last))).otherwise(parts)
    tree = saved(paths.select("*", cut.alias("parts"), F.lit("").alias("template")), "tree")
    levels = tree.agg(F.max(F.size("parts"))).first()[0] or 0  # ``depth`` at most
    parent = ["host", "template"]
    for i in range(1, levels + 1):
        open_ = F.size("parts") >= i
        rows = tree.withColumn("s", F.when(open_, F.get("parts", F.lit(i - 1))))
        own = rows.filter("s is not null").groupBy(*parent, "s").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        seldom = F.col("n") <= t.rare
        all_ = own.groupBy(*parent).agg(F.sum("l").alias("al"), F.sum("b").alias("ab"), F.count_if(seldom).alias("few"))
        ol, ob = F.col("al") - F.col("l"), F.col("ab") - F.col("b")
        p, q = (F.col("b") + 1) / (F.col("l") + 2), (ob + 1) / (ol + 2)
        alike = (F.col("l") > 0) & (ol > 0) & ((p - q) * (p - q) <= F.lit(t.z * t.z) * (p * (1 - p) / (F.col("l") + 2) + q * (1 - q) / (ol + 2)))
        kind = F.when(seldom & (F.col("few") >= t.many), "{v}").when(alike, "*").otherwise(F.col("s"))
        branch = own.join(all_, parent).select(*parent, "s", kind.alias("t"))
        # A level that a path does not have leaves its template as it is.
        grown = rows.join(branch, [*parent, "s"], "left").withColumn("template", F.when(F.col("t").isNotNull(), F.concat("template", F.lit("/"), "t")).otherwise(F.col("template")))
        tree = saved(grown.drop("s", "t"), "tree")  # the next level reads it twice
    judged = tree.groupBy(*parent).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    pure = F.when(F.col("l") > 0, F.round(F.col("b") / F.greatest("l", F.lit(1)), 9))
    judged = saved(judged.withColumn("pure", pure), "judged")
    base = judged.agg(F.coalesce(F.round(F.avg("pure"), 6), F.lit(0.5))).first()[0]
    prior = (F.coalesce(F.sum("pure"), F.lit(0.0)) + t.weight * base) / (F.count("pure") + t.weight)
    hosts = judged.groupBy("host").agg(F.round(prior, 6).alias("prior"))
    # What rules say of a template on all hosts whose rates for it are alike.
    rated = judged.filter("l > 0")
    shapes = rated.groupBy("template").agg(F.sum("l").alias("al"), F.sum("b").alias("ab"))
    ol, ob = F.col("al") - F.col("l"), F.col("ab") - F.col("b")
    p, q = (F.col("b") + 1) / (F.col("l") + 2), (ob + 1) / (ol + 2)
    alike = (ol == 0) | ((p - q) * (p - q) <= F.lit(t.z * t.z) * (p * (1 - p) / (F.col("l") + 2) + q * (1 - q) / (ol + 2)))
    pooled = saved(rated.join(shapes, "template").filter(alike).select(*parent, "l", "b"), "pooled")
    sums = pooled.groupBy("template").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    own = pooled.select(*parent, F.col("l").alias("ownl"), F.col("b").alias("ownb"))
    judged = judged.join(hosts, "host").join(sums, "template", "left").join(own, parent, "left")
    el, eb = (F.coalesce(F.col(f"p{k}"), F.lit(0)) - F.coalesce(F.col(f"own{k}"), F.lit(0)) for k in "lb")
    elsewhere = (eb + t.weight * F.col("prior")) / (el + t.weight)
    judged = judged.select(*parent, F.round((F.col("b") + t.weight * elsewhere) / (F.col("l") + t.weight), 9).alias("score"))
    return tree.join(judged, parent).select("host", "gpath", "template", "score", (F.col("score") >= t.purity).alias("blocks"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, template, score."""
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    generalised = F.array_join(F.transform(F.split("path", "/"), segment_class), "/")
    rows = rows.select("*", generalised.alias("gpath"), rule_of(F.col("host"), F.col("path"), rules).alias("hit"))
    blocked, labelled = F.col("hit.verdict") == "block", F.col("hit").isNotNull()
    paths = saved(rows.groupBy("host", "gpath").agg(F.count(F.lit(1)).alias("n"), F.count_if(labelled).alias("labelled"), F.count_if(F.coalesce(blocked, F.lit(False))).alias("blocked")), "paths")
    judged = saved(judge_templates(paths, tree), "templates")
    found = rows.join(judged, ["host", "gpath"])
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("blocks"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", "score")


def op3_sql(rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> str:
    """The same in DuckDB, as a statement of ``tree.depth`` levels."""
    t, cases = tree, {"rule": "", "verdict": ""}
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host))):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        cases["rule"] += f" WHEN {fits} THEN '{r.name}'"
        cases["verdict"] += f" WHEN {fits} THEN '{r.verdict}'"
    sql = f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS MATERIALIZED (
  SELECT *, CASE{cases["rule"]} END AS rule, CASE{cases["verdict"]} END AS hit,
         array_to_string(list_transform(string_split(path, '/'), lambda s:
           CASE WHEN regexp_matches(regexp_replace(s, '\\.[A-Za-z]+$', ''), '[0-9]')
                THEN '{{n}}' || regexp_extract(s, '(\\.[A-Za-z]+)$', 1) ELSE s END), '/') AS gpath
  FROM u
), l0 AS MATERIALIZED (
  SELECT *, '' AS template FROM (
    SELECT host, gpath, n, labelled, blocked,
           CASE WHEN len(parts) > {t.depth} THEN list_append(parts[:{t.depth - 1}], array_to_string(parts[{t.depth}:], '/')) ELSE parts END AS parts
    FROM (
      SELECT host, gpath, count(*) AS n, count(*) FILTER (hit IS NOT NULL) AS labelled, count(*) FILTER (hit = 'block') AS blocked,
             string_split(regexp_replace(gpath, '^/', ''), '/') AS parts
      FROM r GROUP BY host, gpath))
)"""
    for i in range(1, t.depth + 1):
        sql += f""", o{i} AS MATERIALIZED (
  SELECT host, template, parts[{i}] AS s, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b
  FROM l{i - 1} WHERE len(parts) >= {i} GROUP BY ALL
), b{i} AS MATERIALIZED (
  SELECT host, template, s,
         CASE WHEN n <= {t.rare} AND few >= {t.many} THEN '{{v}}'
              WHEN l > 0 AND ol > 0 AND power((b + 1) / (l + 2) - (ob + 1) / (ol + 2), 2) <= {t.z * t.z} * (
                (b + 1) / (l + 2) * (1 - (b + 1) / (l + 2)) / (l + 2) + (ob + 1) / (ol + 2) * (1 - (ob + 1) / (ol + 2)) / (ol + 2)) THEN '*'
              ELSE s END AS t
  FROM (SELECT *, sum(l) OVER w - l AS ol, sum(b) OVER w - b AS ob, count(*) FILTER (n <= {t.rare}) OVER w AS few
        FROM o{i} WINDOW w AS (PARTITION BY host, template))
), l{i} AS MATERIALIZED (
  SELECT a.* REPLACE (CASE WHEN b.t IS NULL THEN a.template ELSE a.template || '/' || b.t END AS template)
  FROM l{i - 1} a LEFT JOIN b{i} b ON a.host = b.host AND a.template = b.template AND a.parts[{i}] = b.s
)"""
    return sql + f""", j AS MATERIALIZED (
  SELECT host, template, sum(labelled) AS l, sum(blocked) AS b,
         CASE WHEN sum(labelled) > 0 THEN round(sum(blocked) / sum(labelled), 9) END AS pure
  FROM l{t.depth} GROUP BY host, template
), g AS (
  SELECT coalesce(round(avg(pure), 6), 0.5) AS base FROM j
), h AS (
  SELECT host, round((coalesce(sum(pure), 0) + {t.weight} * any_value(base)) / (count(pure) + {t.weight}), 6) AS prior FROM j, g GROUP BY host
), w AS (
  SELECT host, template, l, b, (b + 1) / (l + 2) AS p, (ab - b + 1) / (al - l + 2) AS q, al - l AS ol
  FROM (SELECT *, sum(l) OVER (PARTITION BY template) AS al, sum(b) OVER (PARTITION BY template) AS ab FROM j WHERE l > 0)
), own AS (
  SELECT host, template, l, b FROM w
  WHERE ol = 0 OR power(p - q, 2) <= {t.z * t.z} * (p * (1 - p) / (l + 2) + q * (1 - q) / (ol + 2))
), pooled AS (
  SELECT template, sum(l) AS pl, sum(b) AS pb FROM own GROUP BY template
), e AS (
  SELECT j.host, j.template, j.l, j.b,
         (coalesce(pb, 0) - coalesce(own.b, 0) + {t.weight} * prior) / (coalesce(pl, 0) - coalesce(own.l, 0) + {t.weight}) AS elsewhere
  FROM j JOIN h USING (host) LEFT JOIN pooled ON j.template = pooled.template
  LEFT JOIN own ON j.host = own.host AND j.template = own.template
), k AS (
  SELECT host, gpath, template, round((e.b + {t.weight} * elsewhere) / (e.l + {t.weight}), 9) AS score
  FROM l{t.depth} JOIN e USING (host, template)
)
SELECT page_id, host, path, rule, coalesce(hit, CASE WHEN score >= {t.purity} THEN 'block' ELSE 'allow' END) AS verdict, template, score
FROM r JOIN k USING (host, gpath)
"""
