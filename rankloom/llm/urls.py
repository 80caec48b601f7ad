"""URL filters: longest-match rules over a path-template tree judged by labelled purity.

Each host has a tree of path templates. Segments that look generated (numbers,
hashes, long mixed tokens; extensions kept) become typed wildcards at once and stay
apart by their type. Then, level by level from the root, sibling branches are
merged by their labels alone, whatever their share of the pages:

* literal branches whose labelled bad rate doesn't differ significantly from their
  parent's, and those without labels, become one wildcard branch ``*``. The
  threshold is ``Z``, more where many siblings are tested (sqrt(2 ln(2 k)) for k),
  with a continuity correction, so chance alone singles out hardly any;
* of those that do differ, branches alike to each other become one branch
  ``{like:first of them}``: neighbours by rate are merged, the most alike first,
  until all that are left differ significantly.

A template whose smoothed purity, (good + ALPHA * prior) / (labelled + ALPHA) with
the corpus' own good rate as prior, is below ``PURITY`` is rejected: its pages are
blocked unless a rule says otherwise.

Everything is counts of templates, aggregated before any shuffle: a host with a
third of all pages is as many rows as it has distinct shapes, and its pages get
their verdict by a broadcast. The tree is as deep as the deepest path; what all
shapes of a branch share is walked at once, so jobs grow with the forks only.

Edge cases: a null url, or one without ``://``, has an empty host and path and is
judged like any template; unlabelled templates have the prior's purity. Null labels
and null label keys are left out; a key with several labels is bad if one of them
is. Repeated rows count as often as they occur and are returned as often. Urls of
any length and depth are judged whole; an empty table gives no rows. Only page_id
and url are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.lookups import fair_share, lookup
from rankloom.llm.work import drop, table

Z = 2.0
ALPHA, PURITY = 10.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The query's rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a url; both empty without a scheme."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shapes(path: Column) -> Column:
    """The path's segments with generated ones replaced by typed wildcards."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def shape(s: Column) -> Column:
        stem = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1)
        ending = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2)
        kind = (
            F.when(F.rlike(stem, F.lit("^[0-9]+$")), F.lit("{number}"))
            .when(F.rlike(stem, F.lit("^(?=.*[0-9])[0-9a-fA-F-]{8,}$")), F.lit("{hex}"))
            .when(F.rlike(stem, F.lit("[0-9]")) & (F.length(stem) >= 12), F.lit("{mixed}"))
            .when(F.length(stem) >= 40, F.lit("{long}"))
        )
        return F.coalesce(F.concat(kind, F.lower(ending)), s)

    return F.array_join(F.transform(segments, shape), "/")


def apart(labelled_a, bad_a, labelled_b, bad_b):
    """How significantly two bad rates differ, in standard deviations."""
    both = (bad_a + bad_b) / (labelled_a + labelled_b)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-4) * (1 / labelled_a + 1 / labelled_b))
    return np.abs(bad_a / labelled_a - bad_b / labelled_b) / spread


def merged(labelled: Sequence[int], bad: Sequence[int]) -> np.ndarray:
    """Cluster of each (labelled, bad): neighbours by rate are merged, the most alike first, until all differ."""
    order = sorted(range(len(labelled)), key=lambda i: (bad[i] / labelled[i], labelled[i]))
    parts = [[float(labelled[i]), float(bad[i]), [i]] for i in order]
    while len(parts) > 1:
        z = [float(apart(x[0], x[1], y[0], y[1])) for x, y in zip(parts, parts[1:])]
        k = int(np.argmin(z))
        if z[k] >= Z:
            break
        x, y = parts[k : k + 2]
        parts[k : k + 2] = [[x[0] + y[0], x[1] + y[1], x[2] + y[2]]]
    out = np.zeros(len(labelled), dtype=np.int64)
    for c, part in enumerate(parts):
        out[part[2]] = c
    return out


def alike(odd: DataFrame) -> DataFrame:
    """host, template, segment, cluster of branches (labelled, bad) that differ from their parent.

    Branches of equal counts are one row of a task's group, so a group grows far slower than a parent's branches.
    """
    by = ["host", "template", "labelled", "bad"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf["times"].to_numpy()
        return pdf[by].assign(cluster=merged((pdf["labelled"] * times).tolist(), (pdf["bad"] * times).tolist()))

    kinds = odd.groupBy(*by).agg(F.count("*").alias("times"))
    found = kinds.groupBy("host", "template").applyInPandas(run, "host string, template string, labelled long, bad long, cluster long")
    return odd.join(found, by).select("host", "template", "segment", "cluster")


def straight(alive: DataFrame) -> DataFrame:
    """The rows with the segments that all shapes of their template share moved to it; ``ended`` where none is left."""
    ends = alive.groupBy("host", "template").agg(F.min("segments").alias("low"), F.max("segments").alias("high"))
    differ = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shared = ends.select("host", "template", F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int").alias("shared"))
    met = alive.join(shared, ["host", "template"])
    left = F.slice("segments", F.col("shared") + 1, F.size("segments"))
    name = F.when(F.col("shared") > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("segments", F.lit(1), F.col("shared")), "/"))).otherwise(F.col("template"))
    return table(met.select("host", "shape", "n", "labelled", "bad", left.alias("segments"), name.alias("template"), (F.size(left) == 0).alias("ended")), "url-straight")


def named_branches(forked: DataFrame) -> DataFrame:
    """host, template, segment, name: the name of every branch below the templates."""
    counts = (F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    child = table(forked.select("host", "template", F.get("segments", F.lit(0)).alias("segment"), "n", "labelled", "bad").groupBy("host", "template", "segment").agg(*counts), "url-branches")
    parent = child.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count_if(F.col("labelled") > 0).alias("k"))
    rate = F.when(F.col("all_labelled") > 0, F.col("all_bad") / F.col("all_labelled")).otherwise(F.lit(0.0))
    spread = F.sqrt(F.col("labelled") * F.greatest(rate * (1 - rate), F.lit(1e-4)))
    limit = F.greatest(F.lit(Z), F.sqrt(2 * F.log(2.0 * F.greatest("k", F.lit(1)))))
    literal = ~F.startswith("segment", F.lit("{"))
    differs = (F.col("labelled") > 0) & (F.abs(F.col("bad") - F.col("labelled") * rate) - 0.5 >= limit * spread) & literal
    told = table(child.join(parent, ["host", "template"]).select("host", "template", "segment", "labelled", "bad", differs.alias("differs"), literal.alias("literal"), (F.col("n") == F.col("all_n")).alias("only")), "url-tests")
    # a branch that is all there is, or a typed wildcard, is told apart by its name at no cost
    name = F.when(F.col("only") | ~F.col("literal"), F.col("segment"))
    odd = told.where("differs AND NOT only")
    if not odd.groupBy("host", "template").count().where("count > 1").take(1):
        return told.select("host", "template", "segment", F.coalesce(name, F.when(F.col("differs"), F.col("segment")), F.lit("*")).alias("name"))
    found = alike(odd)
    first = found.groupBy("host", "template", "cluster").agg(F.min("segment").alias("first"), F.count("*").alias("members"))
    of = found.join(first, ["host", "template", "cluster"]).select("host", "template", "segment", F.when(F.col("members") == 1, F.col("segment")).otherwise(F.concat(F.lit("{like:"), "first", F.lit("}"))).alias("own"))
    both = told.join(of, ["host", "template", "segment"], "left")
    return both.select("host", "template", "segment", F.coalesce(name, "own", F.lit("*")).alias("name"))


def template_tree(shaped: DataFrame) -> DataFrame:
    """host, shape, template and purity counts from (host, shape, bad); ``bad`` is null where unlabelled."""
    leaves = shaped.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"))
    alive = table(leaves.withColumns({"segments": F.split("shape", "/"), "template": F.lit("")}), "url-shapes")
    done = []
    while True:
        at = straight(alive)
        done.append(at.where("ended"))
        forked = at.where("NOT ended").drop("ended")
        if not forked.take(1):
            break
        met = forked.withColumn("segment", F.get("segments", F.lit(0))).join(named_branches(forked), ["host", "template", "segment"])
        alive = table(met.select("host", "shape", "n", "labelled", "bad", F.slice("segments", 2, F.size("segments")).alias("segments"), F.concat("template", F.lit("/"), "name").alias("template")), "url-forks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("host", "shape", "template", "n", "labelled", "bad")


def judge(pages: DataFrame, bad_pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each page.

    ``pages``: page_id, url. ``bad_pages``: url_key, bad: labels by the number that ends a url's path.
    """
    host, path = split_url(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    key = F.expr("try_cast(regexp_extract(path, '/([0-9]+)(?:[.][A-Za-z]+)?/?$', 1) AS BIGINT)")
    shaped = parted.select("page_id", "host", "path", shapes(F.col("path")).alias("shape"), key.alias("url_key"))
    marks = bad_pages.where("url_key IS NOT NULL AND bad IS NOT NULL").groupBy("url_key").agg(F.bool_or("bad").alias("bad"))
    numbered = shaped.where("url_key IS NOT NULL").join(marks, "url_key", "left").select("host", "shape", "bad")
    tree = table(template_tree(numbered.unionByName(shaped.where("url_key IS NULL").select("host", "shape", F.lit(None).cast("boolean").alias("bad")))), "url-tree")
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    total = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    prior = 1 - (total.bad or 0) / total.labelled if total.labelled else 1.0
    purity = (F.col("labelled") - F.col("bad") + ALPHA * prior) / (F.col("labelled") + ALPHA)
    place = F.concat_ws("\0", "host", "shape")
    judged = table(tree.select("host", "shape", "template", "n").join(sums.select("host", "template", purity.alias("purity")), ["host", "template"]).select(place.alias("place"), "n", "template", "purity"), "url-templates")
    drop(tree)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    found = lookup(shaped.select("page_id", "host", "path", place.alias("place")), judged, "place", fair_share(total.n or 0, pages)).withColumn("found", rule)
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")


def labelled_urls(labels: DataFrame) -> DataFrame:
    """Labels by document number: bad where the quality is 0 or the document is toxic."""
    return labels.select(F.col("doc_id").alias("url_key"), F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
