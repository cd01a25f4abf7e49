"""URL filters: rules first, then a path-template tree with smoothed labelled purity (DataFrame operations only)."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.skew import join_hot
from cairn.session import materialize

#: Host suffix, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Children from which a node can have a wildcard; one with this many times the mean urls of its siblings is kept.
FANOUT = 8
STANDS_OUT = 4
#: Labels of one template count as at most 1 / ALIKE different ones (the correlation within a template).
ALIKE = 0.25
#: Labels that the purity of the parent counts as.
PRIOR_ROWS = 4.0
REJECT = 0.7
MERGE_Z = 1.96


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z lower-cased, and path of a url; both empty if it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or above it and whose path starts the url's, and its verdict; else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """All segments of a path."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def differs(good: Column, bad: Column, all_good: Column, all_bad: Column) -> Column:
    """Whether a branch's labelled share differs, by a z-test, from that of all others under its parent; both need labels."""
    n, rest = good + bad, all_good + all_bad - good - bad
    pooled = (all_bad + 1) / (n + rest + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    apart = F.abs(bad / F.greatest(n, F.lit(1)) - (all_bad - bad) / F.greatest(rest, F.lit(1)))
    return (n > 0) & (rest > 0) & (apart > MERGE_Z * error)


def templates(urls: DataFrame) -> DataFrame:
    """From (host, parts, good, bad, n), one row each: the same and template, its segments with wildcards.

    A level at a time: of a node's children those are kept that have STANDS_OUT times the mean number of urls, or whose
    labels differ from their siblings'; if FANOUT or more are left, these are one wildcard child. Only the test of
    labels depends on how many urls there are; the rest on shares. A path is done at its last segment, or where fewer than FANOUT paths
    are left under its node, as no wildcard can follow: rounds end where no node has that many, whatever the depth.
    """
    live = materialize(urls.withColumn("template", F.array().cast("array<string>")), "url-level")
    total = live.count()
    done = [live.where("size(parts) = 0")]
    node = ["host", "template"]
    level = 0
    while total:
        at = live.withColumn("seg", F.get("parts", F.lit(level)))
        child = materialize(at.groupBy(*node, "seg").agg(*[F.sum(k).alias(k) for k in ("n", "good", "bad")], F.count("*").alias("paths")), "url-children")
        sums = child.groupBy(*node).agg(*[F.sum(k).alias("all_" + k) for k in ("n", "good", "bad")], F.count("*").alias("children"))
        n_children = child.count()
        kept = (F.col("n") * F.col("children") >= STANDS_OUT * F.col("all_n")) | differs(F.col("good"), F.col("bad"), F.col("all_good"), F.col("all_bad"))
        marked = materialize(join_hot(child, sums.where(F.col("children") >= FANOUT), node, "children", n_children).select(*node, "seg", "children", kept.alias("kept")), "url-marked")
        wild = marked.groupBy(*node).agg(F.first("children").alias("children")).join(marked.where("NOT kept").groupBy(*node).agg(F.count("*").alias("rare")), node).where(F.col("rare") >= FANOUT)
        stars = join_hot(marked.where("NOT kept").select(*node, "seg"), wild, node, "rare", n_children).select(*node, "seg", F.lit(True).alias("star"))
        steps = child.select(*node, "seg", "paths").join(stars, [*node, "seg"], "left")
        grown = join_hot(at, steps, [*node, "seg"], "paths", total).withColumn("template", F.concat("template", F.array(F.when(F.col("star"), "*").otherwise(F.col("seg")))))
        level += 1
        ends = (F.size("parts") <= level) | (F.col("star").isNull() & (F.col("paths") < FANOUT))
        grown = materialize(grown.withColumn("ends", ends), "url-level")
        done.append(grown.where("ends").withColumn("template", F.concat("template", F.slice("parts", level + 1, F.greatest(F.size("parts") - level, F.lit(0))))).select(live.columns))
        live = grown.where("NOT ends").select(live.columns)
        total = live.count()
    return reduce(DataFrame.unionByName, done)


def template_tree(urls: DataFrame) -> DataFrame:
    """From (host, parts, good, bad, n), one row each: host, parts, n, template, purity.

    The tree's root is above all hosts; on the way to a template lie the host's domains, from the last on, and the
    template's segments. From the root (prior 0.5) down, a branch that differs from its siblings by a z-test has its own
    purity, (bad + PRIOR_ROWS * the parent's purity) / (labels + PRIOR_ROWS); one that doesn't differ, or has no labels,
    is merged with them and has the parent's. In these sums m labels of one template count as m / (1 + ALIKE (m - 1)):
    they say much about it and less about others.
    """
    t = materialize(templates(urls), "url-templates")
    leaf = t.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("paths"))
    m = F.col("good") + F.col("bad")
    leaf = materialize(leaf.withColumn("share", F.when(m > 0, 1 / (1 + ALIKE * (m - 1))).otherwise(0.0)).withColumn("way", F.concat(F.reverse(F.split("host", r"\.")), F.transform("template", lambda x: F.concat(F.lit("/"), x)))), "url-leaves")
    n = leaf.count()
    steps = leaf.select("host", "template", "good", "bad", "share", F.explode(F.transform(F.sequence(F.lit(0), F.size("way")), lambda d: F.struct(d.alias("depth"), F.slice("way", F.lit(1), d).alias("node")))).alias("s")).select("host", "template", "good", "bad", "share", "s.depth", "s.node")
    sums = steps.groupBy("node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum(F.col("good") * F.col("share")).alias("weigh_good"), F.sum(F.col("bad") * F.col("share")).alias("weigh_bad"), F.count("*").alias("leaves"))
    facts = join_hot(steps.select("host", "template", "depth", "node"), sums, ["node"], "leaves", n)
    line = facts.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("depth", "good", "bad", "weigh_good", "weigh_bad"))).alias("line"))

    def down(a: Column, x: Column) -> Column:
        own = (x["weigh_bad"] + PRIOR_ROWS * a["p"]) / (x["weigh_good"] + x["weigh_bad"] + PRIOR_ROWS)
        apart = (x["depth"] == 0) | differs(x["good"], x["bad"], a["good"], a["bad"])
        return F.struct(F.when(apart, own).otherwise(a["p"]).alias("p"), x["good"].alias("good"), x["bad"].alias("bad"))

    start = F.struct(F.lit(0.5).alias("p"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))
    purity = line.select("host", "template", F.round(F.aggregate("line", start, down, lambda a: a["p"]), 9).alias("purity"))
    purity = materialize(purity.join(leaf.select("host", "template", "paths"), ["host", "template"]), "url-purity")
    judged = join_hot(t.select("host", "parts", "n", "template"), purity, ["host", "template"], "paths", t.count())
    return judged.select("host", "parts", "n", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def filter_urls(pages: DataFrame, rules=RULES, label: str | None = None, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``.

    The longest fitting rule decides. Elsewhere the template tree does: a template whose purity, the smoothed share of
    bad labels, is over ``reject`` is blocked. A url's label is its rule's verdict or, if named, the 0/1 column
    ``label`` (1 bad); urls without labels get what is known of their host and its domains.

    The tree is built from counts of distinct (host, path), so a repeated url is counted in every task before any
    shuffle; joins on a host, branch or url that holds many rows are split (see join_hot). Null urls and urls without
    ``://`` have empty host and path and fall to the tree; very long or deep urls are read whole; repeated rows are
    judged alike; an empty table gives an empty result; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.lit(None).cast("int") if label is None else F.col(label).cast("int")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), own.alias("own")).withColumns({"rule": name, "ruled": verdict, "parts": segments(F.col("path"))})
    bad = F.coalesce(F.col("own"), F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    counts = urls.groupBy("host", "parts").agg(F.sum(F.when(bad == 0, 1).otherwise(0)).alias("good"), F.sum(F.when(bad == 1, 1).otherwise(0)).alias("bad"), F.count("*").alias("n"))
    tree = materialize(template_tree(counts), "url-tree")
    total = tree.agg(F.sum("n")).first()[0] or 0
    judged = join_hot(urls, tree, ["host", "parts"], "n", total)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") > reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def oracle_sql(rules=RULES, levels: int = 8) -> str:
    """The same in DuckDB, for paths of up to ``levels`` segments: one step of common tables for each level, and purity
    by recursion from the root."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p, _ in ordered]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    pooled = "((all_bad + 1)::DOUBLE / (all_good + all_bad + 2))"
    rest = "(all_good + all_bad - good - bad)"
    apart = f"""good + bad > 0 AND {rest} > 0 AND abs(bad::DOUBLE / greatest(good + bad, 1) - (all_bad - bad)::DOUBLE / greatest({rest}, 1))
  > {MERGE_Z} * sqrt({pooled} * (1 - {pooled}) * (1::DOUBLE / greatest(good + bad, 1) + 1::DOUBLE / greatest({rest}, 1)))"""
    steps = []
    for d in range(levels):
        steps.append(f"k{d} AS MATERIALIZED (SELECT host, t, parts[{d + 1}] AS seg, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM s{d} WHERE len(parts) > {d} GROUP BY ALL)")
        steps.append(f"a{d} AS (SELECT *, sum(n) OVER w AS all_n, sum(good) OVER w AS all_good, sum(bad) OVER w AS all_bad, count(*) OVER w AS children FROM k{d} WINDOW w AS (PARTITION BY host, t))")
        steps.append(f"m{d} AS (SELECT *, n * children >= {STANDS_OUT} * all_n OR ({apart}) AS kept FROM a{d})")
        steps.append(f"w{d} AS MATERIALIZED (SELECT host, t, seg, CASE WHEN NOT kept AND count(*) FILTER (WHERE NOT kept) OVER (PARTITION BY host, t) >= {FANOUT} THEN '*' ELSE seg END AS shown FROM m{d})")
        steps.append(f"s{d + 1} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN len(parts) <= {d} THEN s.t ELSE list_append(s.t, shown) END AS t) FROM s{d} s LEFT JOIN w{d} w ON s.host = w.host AND s.t = w.t AND s.parts[{d + 1}] = w.seg)")
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
p AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts, {case([h + p for h, p, _ in ordered])} AS rule, {case([v for _, _, v in ordered])} AS ruled FROM u),
s0 AS MATERIALIZED (SELECT host, parts, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad, count(*) AS n, []::VARCHAR[] AS t FROM p GROUP BY host, parts),
{", ".join(steps)},
leaf AS (SELECT host, t, sum(good) AS good, sum(bad) AS bad, list_concat(list_reverse(string_split(host, '.')), list_transform(t, lambda x: '/' || x)) AS way FROM s{levels} GROUP BY host, t),
shared AS (SELECT *, CASE WHEN good + bad > 0 THEN 1 / (1 + {ALIKE} * (good + bad - 1)) ELSE 0 END AS share FROM leaf),
nodes AS MATERIALIZED (SELECT depth, way[1:depth] AS node, sum(good) AS good, sum(bad) AS bad, sum(good * share) AS weigh_good, sum(bad * share) AS weigh_bad
  FROM (SELECT *, unnest(range(0, len(way) + 1)) AS depth FROM shared) GROUP BY 1, 2),
pure AS (
  SELECT depth, node, good, bad, (weigh_bad + {PRIOR_ROWS} * 0.5) / (weigh_good + weigh_bad + {PRIOR_ROWS}) AS p FROM nodes WHERE depth = 0
  UNION ALL
  SELECT depth, node, good, bad, CASE WHEN {apart} THEN (weigh_bad + {PRIOR_ROWS} * p) / (weigh_good + weigh_bad + {PRIOR_ROWS}) ELSE p END
  FROM (SELECT n.*, pure.p, pure.good AS all_good, pure.bad AS all_bad FROM nodes n JOIN pure ON n.depth = pure.depth + 1 AND n.node[1:n.depth - 1] = pure.node))
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN round(pure.p, 9) > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(s.t, '/') AS template, round(pure.p, 9) AS purity
FROM p JOIN s{levels} s ON p.host = s.host AND p.parts = s.parts JOIN leaf ON leaf.host = s.host AND leaf.t = s.t JOIN pure ON pure.node = leaf.way
"""
