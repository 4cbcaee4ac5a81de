"""URL filter: fixed rules, and path-template trees for all that no rule covers.

Rules label the urls they fit; the trees learn from those labels. Numbers and long keys in a path
become wildcards, which gives a url its shape. Each host has a tree of its shapes, and one tree holds those of all
hosts together. In each tree, level by level: a segment whose node has very many rare children is a wildcard; sibling
branches with the same shapes below and block rates that don't differ significantly become one. A template is
rejected if its block rate is over one half: the host's template, smoothed towards the template of all hosts, smoothed
towards the branches above it one after another, up to the rate of all urls. So a host or a template without labels is
judged by the branches merged over hosts.

All statistics are sums by (host, shape), so a hot host is summed up before it is shuffled. Rows of a branch, template or shape that
very many share stay where they are when its figures are joined; what a single tree's branches share is left to Spark's
splitting of skewed joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_heavy, materialise

#: (verdict, host and path) of each rule.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Children of a node that may vary, their least mean count, deviations that a branch may differ by, and labels that a prior weighs.
CHILDREN, RARE, DEVIATIONS, WEIGHT = 20, 5, 2.0, 2.0
#: The tree of all hosts; those of a host have ``host:`` and its name.
ALL = "all"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    plain = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(plain, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, under = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + under)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The segments, with wildcards for long keys and numbers."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "{x}"), "[0-9]+", "{n}"), "/")


def _with_prefixes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a hash of each prefix of a path in ``prefixes``: that of the first i + 1 segments is the exclusive or of a hash of
    each with its place, so all are had in one go, however long the path."""
    marked = df.withColumn("prefixes", F.transform(column, lambda x, i: F.xxhash64(i, x)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["prefixes"]
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            size = np.diff(offsets)
            along = np.r_[0, np.bitwise_xor.accumulate(flat)] if len(flat) else np.zeros(1, np.int64)
            found = along[1:] ^ np.repeat(along[offsets[:-1] - offsets[0]], size)
            column = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], batch.schema.names)

    return marked.mapInArrow(summed, marked.schema)


def _forks(shapes: DataFrame) -> list[int]:
    """Levels at which some node has more than one child; at others there is nothing to generalise."""
    lead = lambda i: F.coalesce(F.get("prefixes", i - 1), F.lit(0).cast("long"))
    steps = F.transform("shape", lambda x, i: F.struct(lead(i).alias("lead"), x.alias("seg")))
    nodes = _with_prefixes(shapes.select("tree", "shape"), "shape").select("tree", F.posexplode(steps).alias("level", "step")).groupBy("tree", "level", "step.lead").agg(F.min("step.seg").alias("one"), F.max("step.seg").alias("other"))
    return sorted(r["level"] for r in nodes.filter("one != other").select("level").distinct().collect())  # as many as a path has segments


def _generalised(shapes: DataFrame) -> DataFrame:
    """(tree, shape, n, labelled, blocked) with one more column: the template in that tree."""
    table = materialise(shapes.withColumn("template", F.col("shape")), "level")
    for level in _forks(table):
        here = F.get("template", F.lit(level))
        lead = F.xxhash64(F.slice("template", 1, level))
        tail = F.xxhash64(F.slice("template", F.lit(level + 2), F.size("template")))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        rows = table.filter(F.size("template") > level).select("tree", lead.alias("lead"), here.alias("seg"), tail.alias("tail"), "n", "labelled", "blocked")
        branches = rows.groupBy("tree", "lead", "seg", "tail").agg(*sums).groupBy("tree", "lead", "seg").agg(*sums, F.bit_xor("tail").alias("below"), F.max("tail").alias("most"))
        branches = materialise(branches, "branches")
        nodes = branches.groupBy("tree", "lead").agg(F.count("*").alias("children"), F.sum("n").alias("all")).filter((F.col("children") > CHILDREN) & (F.col("all") < RARE * F.col("children")))
        known = F.col("labelled") > 0
        groups = branches.groupBy("tree", "lead", "below", "most", known.alias("known")).agg(F.count("*").alias("siblings"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).filter("siblings > 1")
        rate = (F.col("b") + 1) / (F.col("l") + 2)
        apart = F.abs(F.try_divide(F.col("blocked"), F.col("labelled")) - rate) / F.sqrt(rate * (1 - rate) / F.greatest("labelled", F.lit(1)))
        alike = branches.withColumn("known", known).join(groups, ["tree", "lead", "below", "most", "known"]).filter(~F.col("known") | (apart < DEVIATIONS)).select("tree", "lead", "seg", F.lit(True).alias("alike"))
        marks = branches.select("tree", "lead", "seg").join(nodes.select("tree", "lead", F.lit(True).alias("varies")), ["tree", "lead"], "left").join(alike, ["tree", "lead", "seg"], "left")
        marks = marks.filter("varies OR alike").select("tree", "lead", "seg", F.lit(True).alias("wild"))
        changed = table.withColumns({"lead": lead, "seg": F.coalesce(here, F.lit(""))}).join(marks, ["tree", "lead", "seg"], "left")
        wild = F.transform("template", lambda x, i: F.when(i == level, F.lit("*")).otherwise(x))
        changed = changed.withColumn("template", F.when(F.col("wild") & (F.size("template") > level), wild).otherwise(F.col("template")))
        table = materialise(changed.select(*table.columns), "level")
    return table


def _smoothed(evidence: DataFrame, root: Column) -> DataFrame:
    """(template, l, b, n) of one tree to (template, abroad, n): from ``root`` down, each branch's rate smoothed towards that above it."""
    name = F.unhex(F.md5(F.array_join("template", "/").cast("binary")))  # a path is not repeated for each of its segments
    evidence = materialise(evidence.withColumn("name", name), "evidence")
    steps = _with_prefixes(evidence.select("name", "l", "b", "template"), "template").select("name", "l", "b", F.posexplode("prefixes").alias("level", "prefix"))
    steps = materialise(steps, "steps")
    branches = materialise(steps.groupBy("prefix").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("*").alias("below")), "branches")
    # all templates share their first branches
    way = join_heavy(steps.select("name", "level", "prefix"), branches, "prefix", "below", max(1, steps.count())).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("level", "l", "b"))).alias("way"))
    rate = lambda above, l, b: (b + WEIGHT * above) / (l + WEIGHT)
    down = F.aggregate("way", root.cast("double"), lambda above, x: rate(above, x["l"], x["b"]))  # one entry a segment
    return way.select("name", down.alias("down")).join(evidence, "name").select("template", rate(F.col("down"), F.col("l"), F.col("b")).alias("abroad"), "n")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, block_rate.

    A null url, and one without ``://``, has an empty host and path, like all such urls, and is judged as one
    template. Without any labels all rates are one half and nothing is rejected. Repeated rows count and
    are judged alike. An empty table gives an empty result. Only the two named columns are read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape"))
    rows = rows.withColumn("key", F.concat_ws("/", "host", F.array_join("shape", "/")))  # a host has no slash
    sums = materialise(rows.groupBy("host", "shape", "key").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")), "sums")
    trees = sums.select(F.concat(F.lit("host:"), "host").alias("tree"), "shape", "n", "labelled", "blocked")
    shapes = materialise(sums.groupBy("shape").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")), F.count("*").alias("hosts")), "shapes")
    over_all = shapes.select(F.lit(ALL).alias("tree"), "shape", "n", "labelled", "blocked")
    table = _generalised(trees.unionByName(over_all))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    every = F.lit((total["b"] + WEIGHT / 2) / (total["l"] + WEIGHT))
    evidence = table.groupBy("tree", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("n"))
    in_all, at_home = F.col("tree") == ALL, F.col("tree") != ALL
    smoothed = materialise(_smoothed(evidence.filter(in_all).drop("tree"), every), "smoothed")
    placed = table.filter(in_all).select("shape", "template")
    abroad = join_heavy(placed, smoothed, "template", "n", max(1, placed.count())).select("shape", "abroad").join(shapes.select("shape", "hosts"), "shape")
    at_home = table.filter(at_home).select("tree", "shape", "template").join(evidence, ["tree", "template"]).select(F.substring("tree", 6, 1 << 30).alias("host"), "shape", F.array_join("template", "/").alias("template"), "l", "b")
    own = materialise(sums.select("host", "shape", "key", "n").join(at_home, ["host", "shape"]), "own")
    rates = join_heavy(own, materialise(abroad, "abroad"), "shape", "hosts", max(1, own.count()))
    rates = materialise(rates.select("key", "n", "template", ((F.col("b") + WEIGHT * F.col("abroad")) / (F.col("l") + WEIGHT)).alias("block_rate")), "rates")
    out = join_heavy(rows.drop("shape"), rates, "key", "n", total["n"])
    chosen = F.coalesce("ruled", F.when(F.col("block_rate") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", chosen.alias("verdict"), "template", "block_rate")
