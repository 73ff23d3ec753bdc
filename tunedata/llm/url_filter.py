"""URL filter: fixed host and path rules, then a path-template tree per host.

1. Host and path come from the url; the rule with the longest text that fits decides.
2. The rest is judged by templates.  A path becomes segments; segments that
   look like values (numbers, hex, dates, mixed ids) become ``*``.  Pages are counted by
   (host, segments) at once (pre-aggregated), so a host with a third of all pages
   is a few rows from here on.
3. Tree: at each depth a node with more than ``max_children`` distinct children has its
   children generalised to ``*`` as well.
4. Merge: branches of one node that have the same rest of the path form a family.  Branches
   whose share of labelled bad pages does not differ significantly from the rest of the
   family (two-proportion test) are merged and judged by their summed labels; branches without labels
   join them.  This goes node by node from the deepest to the host, so merged branches are one branch further up.
5. A template is rejected when its share of bad pages, smoothed towards the share of its
   parent node, reaches ``reject``.  A node's share (without the labels that lie further down the path) is smoothed
   towards that of its parent node, the first nodes' towards the share of the
   host (itself smoothed towards the share of the whole table).  Templates without labels get the share
   of the nodes above them.

Labels are the pages that a rule decides (block: bad); other labels may be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import ascii_lower, staged

#: (verdict, host, path): given rules of the production query, longest first wins
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: segments that are values by their form; the last form has two digits or more (written so that only one way of matching
#: exists, which keeps long segments linear)
VALUE = (r"^(?:[0-9]+|[0-9]+\.[A-Za-z]{1,5}|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F-]{32,36}"
         r"|[A-Za-z_-]*[0-9][A-Za-z_-]*[0-9][A-Za-z0-9_-]*(?:\.[A-Za-z]{1,5})?)$")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.  ``rules`` is a short list."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(kind))
    return rule, verdict


def shapes(pages: DataFrame, max_depth: int) -> Column:
    """Segments of ``_path`` with values as ``*``; what lies below ``max_depth`` is one ``**``."""
    parts = F.filter(F.split(F.col("_path"), "/", -1), lambda x: x != "")
    parts = F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(F.lit("**")))).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.rlike(VALUE), F.lit("*")).otherwise(x))


def template_tree(leaves: DataFrame, max_depth: int, max_children: int) -> DataFrame:
    """``leaves`` (host, shape, ...) with ``template``: crowded nodes generalised, depth by depth."""
    out = leaves.withColumn("template", F.col("shape"))
    deepest = out.agg(F.max(F.size("template"))).first()[0] or 0
    for d in range(1, min(deepest, max_depth) + 1):
        prefix, child = F.slice("template", 1, d - 1), F.get("template", F.lit(d - 1))
        nodes = out.select("host", prefix.alias("_node"), child.alias("_child")).where("_child is not null").distinct()
        crowded = nodes.groupBy("host", "_node").agg(F.count(F.lit(1)).alias("_children")).where(F.col("_children") > max_children)
        out = out.withColumn("_node", prefix).join(crowded, ["host", "_node"], "left")
        general = F.concat(F.slice("template", 1, d - 1), F.array(F.lit("*")), F.slice("template", d + 1, max_depth + 1))
        out = out.withColumn("template", F.when(F.col("_children").isNotNull() & (F.size("template") >= d), general)
                             .otherwise(F.col("template"))).drop("_node", "_children")
        out = staged(out, f"url-depth{d}")     # the next depth reads it twice
    return out


def merge_similar(templates: DataFrame, z_max: float) -> DataFrame:
    """``templates`` (stored: host, template, bad, labelled) with ``branch`` (its group: merged segments as ``+``) and ``name``.

    At each depth, from the deepest, the family of a branch is its host and the branch with that segment left open.
    A branch joins the family's group when its share of bad pages is within ``z_max`` standard errors of the
    rest of the family; one whose rest has no labels stays alone.  A branch without labels joins a
    group that others have formed, for its share; it adds no evidence, so its ``name`` keeps the segment.
    """
    out = templates.withColumns({"branch": F.col("template"), "name": F.col("template")})
    deepest = out.agg(F.max(F.size("template"))).first()[0] or 0
    for d in range(deepest, 0, -1):
        def opened(c: str) -> Column:
            return F.concat(F.slice(c, 1, d - 1), F.array(F.lit("+")), F.slice(c, d + 1, deepest + 1))
        t = out.where(F.size("branch") >= d).groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
        t = t.withColumn("family", opened("branch"))
        whole = t.groupBy("host", "family").agg(F.sum("bad").alias("_fb"), F.sum("labelled").alias("_fl"))
        t = t.join(whole, ["host", "family"])
        n, rest = F.col("labelled"), F.col("_fl") - F.col("labelled")
        pooled, one = F.try_divide(F.col("_fb"), F.col("_fl")), F.lit(1.0)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(one, n) + F.try_divide(one, rest)))
        gap = F.abs(F.try_divide(F.col("bad"), n) - F.try_divide(F.col("_fb") - F.col("bad"), rest))
        t = staged(t.withColumn("similar", (n > 0) & (rest > 0) & F.coalesce(gap <= z_max * error, F.lit(False))), f"url-family{d}")
        formed = t.where("similar").select("host", "family").distinct()
        joins = t.where("similar or labelled = 0").join(formed, ["host", "family"], "left_semi")
        out = out.join(joins.select("host", "branch", "family", "similar"), ["host", "branch"], "left")
        out = out.withColumns({"branch": F.coalesce("family", "branch"), "name": F.when(F.col("similar"), opened("name")).otherwise(F.col("name"))})
        out = out.drop("family", "similar")
        out = staged(out, f"url-merge{d}")
    return out


def branch_shares(merged: DataFrame, hosts: DataFrame, smoothing: float) -> DataFrame:
    """(host, branch, ``bad_share``) of the groups of ``merge_similar``; ``hosts``: (host, ``_hshare``).

    A group's parents are the nodes above its first merged segment (its last segment if none is).  Labels count
    once: those of the next node on the path, or of the group, are left out of a node's.
    """
    groups = merged.groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    first = F.array_position("branch", F.lit("+")).cast("int")
    groups = groups.withColumn("_q", F.when(first > 0, first - 1).otherwise(F.greatest(F.size("branch") - 1, F.lit(0))))
    deepest = merged.agg(F.max(F.size("template"))).first()[0] or 0
    for k in range(1, deepest):
        node = F.slice("template", 1, k)
        nodes = (merged.where(F.size("template") >= k).groupBy("host", node.alias("_node"))
                 .agg(F.sum("bad").alias(f"_b{k}"), F.sum("labelled").alias(f"_l{k}")))
        groups = groups.withColumn("_node", F.when(F.col("_q") >= k, F.slice("branch", 1, k)))
        groups = groups.join(nodes, ["host", "_node"], "left").drop("_node")
    out = groups.join(hosts, "host").withColumn("_share", F.col("_hshare"))
    for k in range(1, deepest):
        below = [F.col(own) if k + 1 == deepest else F.when(F.col("_q") == k, F.col(own)).otherwise(F.col(f"{c}{k + 1}"))
                 for own, c in (("bad", "_b"), ("labelled", "_l"))]
        share = (F.col(f"_b{k}") - below[0] + smoothing * F.col("_share")) / (F.col(f"_l{k}") - below[1] + smoothing)
        out = out.withColumn("_share", F.when(F.col("_q") >= k, share).otherwise(F.col("_share")))
    return out.select("host", "branch", ((F.col("bad") + smoothing * F.col("_share")) / (F.col("labelled") + smoothing)).alias("bad_share"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label_col: str | None = None,
               max_depth: int = 6, max_children: int = 50, z_max: float = 1.96, smoothing: float = 10.0, reject: float = 0.8) -> DataFrame:
    """Per input row: id, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``bad_share``.

    ``label_col`` (1 bad, 0 good, null none) replaces the labels from the rules.  A null url or
    one without ``://`` has empty host and path, no rule, and is judged with
    the others of that kind (no labels: the share of the whole table).  Repeated rows are judged each and count
    each.  A table without any label rejects nothing.  Other columns are not looked
    at.  An empty table gives an empty result.

    The join of the verdicts is by (host, segments); a hot pair is one row of a small
    table (broadcast when the planner sees its size) or is split by the skew join.
    """
    host, path = split_url(F.col(url_col))
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"), label.alias("_label"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict})
    if not label_col:
        rows = rows.withColumn("_label", (F.col("_verdict") == "block").cast("int"))
    rows = rows.withColumn("_shape", shapes(rows, max_depth))
    leaves = rows.groupBy(F.col("_host").alias("host"), F.col("_shape").alias("shape")).agg(
        F.sum("_label").alias("bad"), F.count("_label").alias("labelled"))
    leaves = staged(leaves.withColumn("bad", F.coalesce("bad", F.lit(0).cast("long"))), "url-shapes")
    tree = template_tree(leaves, max_depth, max_children)
    templates = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    merged = merge_similar(staged(templates, "url-templates"), z_max)

    total = leaves.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()      # two numbers
    base = total["bad"] / total["labelled"] if total["labelled"] else 0.0
    hosts = leaves.groupBy("host").agg(((F.sum("bad") + smoothing * base) / (F.sum("labelled") + smoothing)).alias("_hshare"))
    judged = merged.select("host", "template", "branch", "name").join(branch_shares(merged, hosts, smoothing), ["host", "branch"])
    by_shape = tree.select("host", "shape", "template").join(judged, ["host", "template"])
    name = F.concat(F.lit("/"), F.array_join("name", "/"))
    by_shape = staged(by_shape.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), name.alias("template"), "bad_share"), "url-verdicts")
    out = rows.join(by_shape, ["_host", "_shape"], "left")
    method = F.when(F.col("bad_share") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
                      F.coalesce("_verdict", method).alias("verdict"), "template", "bad_share")
