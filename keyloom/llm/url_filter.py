"""URL verdicts from explicit rules and, where none fits, from a tree of path templates per host.

Parsing and rules are plain column expressions. A rule (host, path, verdict) fits its host and all subdomains when the
url's path starts with the rule's; the longest fitting rule wins. Urls that rules judge are the labelled ones; a table
of further labelled urls may be given as evidence (rules decide, labels only count).

Tree: a path's segments lose their variable parts by shape (digits, hexadecimal or long tokens become wildcards, a
file ending stays). Per host, a level whose children are many and none of them large becomes one wildcard child; then
sibling branches merge whose grandchildren are spread alike and whose labelled shares don't differ. Levels are taken
one after the other, down to the last at which any two urls of a host still share all that is above it: below that
there is nothing to merge. Each template's purity is its share of blocked labels, smoothed towards its host's share (of
all its urls, so that unlabelled ones count as not blocked) and that towards the whole table's; urls of a template that
has labels itself are blocked when its purity reaches `reject`. Distinct urls (host and path) are counted, so verdicts
don't change with the number of times that a table has its rows. They are added up by (host, shape) before any shuffle
by host; what is known of a parent goes to its children in SALTS copies, so that a parent with very many children is
no single task's work.

Cases: null urls and urls without "://" have empty host and path, no rule, and the verdict of the empty host's
template; paths may be of any length; rows of the table of labels that are null or say neither block nor allow are
left out, and of several for a url block wins; repeated rows each keep a row; an empty table gives an empty result;
other columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of what is known of a parent.
SALTS = 16
# The rules of the production query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The winning rule's text and verdict, or nulls: longest rule first."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Path segments with their variable parts by shape."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{2,5})$", 1)
        stem = F.substr(s, F.lit(1), F.length(s) - F.length(ending))
        varies = stem.rlike(r"\d") | stem.rlike(r"^[0-9a-fA-F-]{8,}$") | (F.length(stem) > 24)
        return F.when(varies, F.concat(F.lit("*"), ending)).otherwise(s)

    return F.transform(parts, shape)


def _at(tree: DataFrame, level: int) -> DataFrame:
    """Rows of the tree with the node above the segment at this level."""
    return tree.withColumn("up", F.array_join(F.slice("t", 1, level), "/")).withColumn("seg", F.get("t", F.lit(level)))


def _generalised(tree: DataFrame, level: int, many: int, large: float) -> DataFrame:
    """Children of a node become one wildcard where there are many and none is large; else those alike merge."""
    here = _at(tree, level)
    keys = ["host", "up", "seg"]
    child = here.where("seg is not null").groupBy(*keys).agg(F.sum("n").alias("cn"), F.sum("bad").alias("cb"), F.sum("known").alias("ck"))
    below = here.where("seg is not null").groupBy(*keys, F.coalesce(F.get("t", F.lit(level + 1)), F.lit("")).alias("next")).agg(F.sum("n").alias("gn"))
    # the spread of a child's own children, those of a twentieth and more, in quarters, as its signature
    told = F.when(F.col("gn") * 20 >= F.col("cn"), F.concat_ws("=", "next", F.round(F.col("gn") / F.col("cn") * 4).cast("int")))
    spread = below.join(child, keys).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(told)), "|").alias("spread"))
    labels = F.when(F.col("ck") == 0, F.lit("none")).otherwise(F.round(F.col("cb") / F.col("ck") * 4).cast("string"))
    kin = child.join(spread, keys).select("host", "up", "seg", "cn", F.concat(F.lit("~"), labels, F.lit(":"), F.substring(F.md5("spread"), 1, 8)).alias("kind"), F.pmod(F.xxhash64("seg"), F.lit(SALTS)).alias("salt"))
    wild = kin.groupBy("host", "up").agg(F.count("*").alias("kinds"), F.max("cn").alias("most"), F.sum("cn").alias("all")).where((F.col("kinds") >= many) & (F.col("most") <= F.col("all") * large))
    alike = kin.where(~F.col("seg").startswith("*")).groupBy("host", "up", "kind").agg(F.count("*").alias("times")).where("times > 1")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    to = kin.join(salted(wild.select("host", "up", F.lit(True).alias("wild"))), ["host", "up", "salt"], "left").join(salted(alike.select("host", "up", "kind", F.lit(True).alias("same"))), ["host", "up", "kind", "salt"], "left")
    name = F.when(F.col("wild"), F.lit("*")).when(F.col("same") & ~F.col("seg").startswith("*"), F.col("kind")).otherwise(F.col("seg"))
    to = to.select(*keys, name.alias("to")).where(F.col("to") != F.col("seg"))
    joined = here.join(to, keys, "left")
    return joined.withColumn("t", F.when(F.col("to").isNull(), F.col("t")).otherwise(F.concat(F.slice("t", 1, level), F.array("to"), F.slice("t", level + 2, 1 << 20)))).select("host", "shape", "t", "n", "bad", "known")


def templates(tree: DataFrame, many: int, large: float) -> DataFrame:
    """host, shape, n, bad, known and t, its template's segments."""
    level = 0
    while True:
        # a node with several shapes below it may still have children to merge
        shared = _at(tree, level).where("seg is not null").groupBy("host", "up").agg(F.count("*").alias("shapes")).where("shapes > 1")
        if shared.isEmpty():
            return tree
        tree = durable(_generalised(tree, level, many, large))
        level += 1


def judge(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, many: int = 20, large: float = 0.3, prior_rows: float = 10.0, reject: float = 0.9) -> DataFrame:
    """id, host, path, rule, verdict, template, purity of each url; labels (url, verdict) tell more than rules do."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("said"), F.array_join(shape_of(F.col("path")), "/").alias("shape"))
    urls = rows.select("host", "path", "shape", "said").distinct()
    if labels is not None:
        told = labels.where(F.col("verdict").isin("block", "allow") & F.col("url").isNotNull()).groupBy(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).agg(F.max("verdict").alias("told"))
        urls = urls.join(told, ["host", "path"], "left").withColumn("said", F.coalesce("said", "told"))
    tree = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(F.when(F.col("said") == "block", 1)).alias("bad"), F.count("said").alias("known"))
    tree = tree.withColumn("t", F.filter(F.split("shape", "/"), lambda s: s != ""))
    leaf = templates(durable(tree), many, large).withColumn("template", F.concat(F.lit("/"), F.array_join("t", "/")))
    bad, known = leaf.agg(F.sum("bad"), F.sum("known")).first()
    base = (bad or 0) / max(known or 0, 1)
    hosts = leaf.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("n").alias("hn"))
    kept = leaf.groupBy("host", "template").agg(F.sum("bad").alias("tb"), F.sum("known").alias("tk"))
    host_share = (F.col("hb") + prior_rows * base) / (F.col("hn") + prior_rows)
    purity = kept.join(hosts, "host").select("host", "template", "tk", ((F.col("tb") + prior_rows * host_share) / (F.col("tk") + prior_rows)).alias("purity"))
    judged = leaf.select("host", "shape", "template").join(purity, ["host", "template"])
    out = rows.join(judged, ["host", "shape"], "left")
    verdict = F.coalesce("said", F.when((F.col("tk") > 0) & (F.col("purity") >= reject), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
