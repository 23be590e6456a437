"""URL filters with a path-template tree (operator 9).

Explicit rules come first: a rule (host, path) fits its host and all
subdomains if the url's path starts with the rule's path; the longest wins.

Other urls are judged by their template. Per host, the paths form a tree. A
segment with digits is variable by its shape (runs of digits become ``*``);
other segments become ``*`` where a node has many different children that are
each rare. The templates of one node that differ in one last literal alone are
branches; a branch whose share of bad labels does not differ from that of all
its siblings together (a two-sided z test) is merged with them, so its
judgement rests on the siblings' labels too. A template is rejected if its
smoothed share of bad labels, (bad + strength * prior) / (labelled +
strength), reaches the threshold; the prior is the host's share, smoothed in
the same way by that of all hosts.

Everything is grouped counting: pages are reduced to (host, path shape)
counts first, which is combined map-side, so a host with a third of all pages
costs one row per task and path shape. The tree is written after every level,
and has only as many levels as a host has more than ``max_fan`` shapes that
reach them; below that no node can be variable, so a very long path costs none.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and belongs to the empty template of the empty host; pages without
label count for no purity; labels of repeated ids count once, as bad if any
of them is; repeated pages each get a row; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import materialize

#: (verdict, host, path): production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    fits = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        hit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(hit, value) if fits is None else fits.when(hit, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def path_shape(path: Column) -> Column:
    """The segments of a path, runs of digits as ``*``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "*"))


def templates(shapes: DataFrame, max_fan: int = 20, rare: float = 0.2) -> DataFrame:
    """(host, shape, template): literal segments of nodes with many rare children become ``*``, level by level.

    ``shapes`` has host, shape, n (pages), labelled and bad.
    """
    spark = shapes.sparkSession
    tree = materialize(spark, shapes.withColumn("template", F.array().cast("array<string>")), "url-tree")
    longest = Window.partitionBy("host").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sizes = tree.groupBy("host", F.size("shape").alias("k")).agg(F.count("*").alias("c")).withColumn("c", F.sum("c").over(longest))
    depth = sizes.where(F.col("c") > max_fan).agg(F.max("k")).first()[0] or 0
    for level in range(depth):
        seg = F.get("shape", F.lit(level))
        nodes = tree.where(F.size("shape") > level).groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("n"))
        wide = nodes.groupBy("host", "template").agg(F.count("*").alias("fan"), F.sum("n").alias("n"))
        wide = wide.where((F.col("fan") > max_fan) & (F.col("fan") >= rare * F.col("n"))).select(
            "host", "template", F.lit(True).alias("variable"))
        here = F.when(F.col("variable"), F.lit("*")).otherwise(seg)
        tree = materialize(spark, tree.join(wide, ["host", "template"], "left").select(
            "host", "shape", "n", "labelled", "bad",
            F.when(F.size("shape") > level, F.concat("template", F.array(here))).otherwise(F.col("template")).alias("template")), "url-tree")
    rest = F.slice("shape", depth + 1, F.greatest(F.size("shape"), F.lit(1)))
    return materialize(spark, tree.withColumn("template", F.concat("template", rest)), "url-tree")


def judged(tree: DataFrame, strength: float = 20.0, threshold: float = 0.5, z: float = 1.96) -> DataFrame:
    """(host, template, rejected, purity) by smoothed purity, similar branches merged."""
    leaf = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # The last literal segment is the one that tells a branch from its siblings.
    literal = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size("template"), F.lit(1)) - 1),
                                      lambda i: F.when(~F.coalesce(F.get("template", i), F.lit("*")).contains("*"), i)))
    starred = F.concat(F.slice("template", 1, F.col("literal")), F.array(F.lit("*")),
                       F.slice("template", F.col("literal") + 2, F.size("template")))
    leaf = leaf.withColumn("literal", literal).withColumn(
        "branch", F.when(F.col("literal").isNotNull(), starred).otherwise(F.col("template")))
    pool = leaf.groupBy("host", "branch").agg(F.sum("labelled").alias("pool_n"), F.sum("bad").alias("pool_bad"))
    hosts = leaf.groupBy("host").agg(F.sum("labelled").alias("host_n"), F.sum("bad").alias("host_bad"))
    n_all, bad_all = leaf.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = (bad_all or 0) / n_all if n_all else 0.0
    leaf = leaf.join(pool, ["host", "branch"]).join(hosts, "host")
    p = F.col("pool_bad") / F.greatest(F.col("pool_n"), F.lit(1))
    own = F.col("bad") / F.greatest(F.col("labelled"), F.lit(1))
    spread = F.sqrt(p * (1 - p) / F.greatest(F.col("labelled"), F.lit(1)))
    similar = (F.col("labelled") == 0) | (F.abs(own - p) <= z * spread)
    prior = (F.col("host_bad") + strength * overall) / (F.col("host_n") + strength)
    bad = F.when(similar, F.col("pool_bad")).otherwise(F.col("bad"))
    n = F.when(similar, F.col("pool_n")).otherwise(F.col("labelled"))
    purity = (bad + strength * prior) / (n + strength)
    return leaf.select("host", "template", purity.alias("purity"), (purity >= threshold).alias("rejected"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **method) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page. ``labels``: (page_id, bad boolean)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", path_shape(F.col("path")).alias("shape"),
                       rule_of(F.col("host"), F.col("path"), rules).alias("fit"))
    marks = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    ids = rows.select("page_id", "host", "shape").join(marks, "page_id", "left")
    shapes = ids.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"),
                                              F.count_if("bad").alias("bad"))
    tree = templates(shapes)
    verdicts = tree.select("host", "shape", "template").join(judged(tree, **method), ["host", "template"])
    return rows.join(verdicts, ["host", "shape"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
