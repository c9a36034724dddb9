"""URL filter: host and path rules first, a path-template tree for the rest.

Under each host, paths are cut into segments. Segments that look variable (digits, long hexadecimal words) are
wildcards from the start; then, level by level, the labelled branches of a template are compared with their labelled
siblings together: a branch whose share of blocked pages doesn't differ significantly (two-proportion z under ``z``)
merges into the wildcard branch. A branch without labels gives no evidence and stays by itself. A template is rejected
when its purity, the share of blocked among its own labelled pages smoothed towards ``prior`` by ``strength`` pages, is
at least ``cut``; each label counts once, in the template where its page ends. A template without labels has the purity
of the nearest branch above it that differed significantly from its siblings, or else the prior. Labels are the verdicts
of the rules, so pages that no rule fits get what similar paths of their host got.

Everything is a DataFrame operation. Work after the first aggregate is on distinct (host, template) pairs, so a host
with a third of all pages is a few rows; the join back to pages is one that adaptive execution can split.

A null url or one without ``://`` has an empty host and path. Repeated rows get the same verdict each; a tie of two
shares is no difference. Without any labelled page the purity is ``prior``. An empty table gives an empty result. Only ``id_col`` and ``url_col`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules are part of the plan, so there may not be many.
MOST_RULES = 1000
#: Levels of templates that pages without labels get too.
USUAL = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column, depth: int | None) -> Column:
    """The first ``depth`` segments, or all of them, variable-looking ones as ``*``; what is deeper is one ``**``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9._-]*[0-9][0-9._-]*$|^[0-9a-fA-F-]{16,}$|[0-9]{5,}"), "*").otherwise(s))
    if depth is None:
        return general
    return F.when(F.size(general) > depth, F.concat(F.slice(general, 1, depth), F.array(F.lit("**")))).otherwise(general)


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, depth: int | None = None, cut: float = 0.5, strength: float = 2.0, prior: float = 0.0, z: float = 1.96, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``df``: id, host, path, rule, verdict, template, purity.

    The tree has as many levels as the longest labelled path has segments, and ``USUAL`` where paths are that long: below
    the last label nothing tells branches apart. ``depth`` keeps fewer segments.
    """
    s = Scratch(df.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "ruled": verdict, "shape": shape(F.col("path"), depth)})
    labelled, blocked = F.col("ruled").isNotNull().cast("long"), (F.coalesce(F.col("ruled"), F.lit("")) == "block").cast("long")
    tree = pages.groupBy("host", "shape").agg(F.sum(labelled).alias("nl"), F.sum(blocked).alias("nb"))
    tree = s.write(tree)
    total = tree.agg(F.max(F.when(F.col("nl") > 0, F.size("shape"))), F.max(F.size("shape"))).first()
    tree = tree.withColumns({"node": F.col("host"), "open": F.lit(True), "above": F.lit(float(prior))})
    for d in range(max(total[0] or 0, min(total[1] or 0, USUAL))):
        tree = tree.withColumn("seg", F.when(F.col("open"), F.get(F.col("shape"), d)))
        branches = tree.where("seg is not null").groupBy("node", "seg").agg(F.sum("nl").alias("cl"), F.sum("nb").alias("cb"))
        parents = branches.groupBy("node").agg(F.sum("cl").alias("pl"), F.sum("cb").alias("pb"))
        others_l, others_b = F.col("pl") - F.col("cl"), F.col("pb") - F.col("cb")
        pooled = F.try_divide("pb", "pl")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "cl") + F.try_divide(F.lit(1.0), others_l)))
        differs = (spread > 0) & (F.abs(F.try_divide("cb", "cl") - F.try_divide(others_b, others_l)) >= z * spread)
        apart = F.coalesce(differs, F.lit(False))
        own = F.when(apart, (F.col("cb") + strength * prior) / (F.col("cl") + strength))
        decided = branches.join(parents, "node").select("node", "seg", F.when(apart | (F.col("cl") == 0), F.col("seg")).otherwise("*").alias("to"), own.alias("own"))
        moved = tree.join(decided, ["node", "seg"], "left")
        tree = s.write(moved.withColumns({"node": F.when(F.col("to").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "to")), "open": F.col("to").isNotNull(), "above": F.coalesce("own", "above")}).drop("to", "seg", "own"))
    sums = tree.groupBy("node").agg(F.sum("nl").alias("__l"), F.sum("nb").alias("__b"))
    tree = tree.join(sums, "node").withColumn("purity", F.when(F.col("__l") > 0, (F.col("__b") + strength * prior) / (F.col("__l") + strength)).otherwise(F.col("above")))
    judged = tree.select(F.col("host").alias("__h"), F.col("shape").alias("__s"), F.col("node").alias("template"), "purity")
    out = pages.join(judged, (F.col("host") == F.col("__h")) & (F.col("shape") == F.col("__s")))
    method = F.when(F.col("purity") >= cut, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
