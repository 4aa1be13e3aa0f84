"""Verdicts on urls: listed rules first, else the labelled purity of the url's path template on its host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialised

LONG = 32  # a segment of more characters is variable as a whole
ALIKE = 1.96  # greatest z of two shares that count as similar
PURITY = 0.5
# Segments that are variable as a whole, by what they hold (fixed values): long hexadecimal ids, and titles of three words or more.
HEX_ID = "^[0-9a-fA-F-]{16,}/?$"
TITLE = "[-_+%][^-_+%]*[-_+%]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or
    the end. Both are empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def longest_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule (host and path) and verdict: the longest that fits columns host and path, else null.

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains of it, where the path starts with the
    rule's. Rules of one length rank by their text. The list is part of the program: it becomes an expression.
    """
    def fits(host: str, path: str) -> Column:
        return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))

    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        out = F.when(fits(host, path), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def template_of(path: Column) -> Column:
    """The segments of a path's template, each with the slash that ends it; a path without segments has one, the empty one.

    What a segment holds decides, never how many there are beside it: long hexadecimal ids, titles and segments of over
    ``LONG`` characters become ``*``, in others each run of digits becomes ``#``. A page ``/fr`` and a folder ``/fr/`` differ.
    """
    def general(s: Column) -> Column:
        whole = s.rlike(HEX_ID) | s.rlike(TITLE) | (F.length(F.rtrim(s, F.lit("/"))) > LONG)
        return F.when(whole, F.when(s.endswith("/"), "*/").otherwise("*")).otherwise(F.regexp_replace(s, "[0-9]+", "#"))

    parts = F.transform(F.regexp_extract_all(path, F.lit("[^/]+/?"), F.lit(0)), general)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))


def branches(templates: DataFrame) -> DataFrame:
    """host, template, level (from 1), node, parent, good, bad: a row for every node on the way to a template.

    ``templates`` has a row for each template of a host, so that what is unfolded grows with the tree and not with the
    pages. Nodes are md5 digests of the host and the segments so far.
    """
    def key(level: Column) -> Column:
        return F.md5(F.concat("host", F.lit("/"), F.array_join(F.slice("segments", F.lit(1), level), ""), F.lit("/"), level.cast("string")))

    steps = F.transform(F.sequence(F.lit(1), F.size("segments")), lambda k: F.struct(
        k.alias("level"), key(k).alias("node"), key(k - 1).alias("parent")))
    return templates.select("host", "template", "good", "bad", F.explode(steps).alias("step")).select("host", "template", "step.*", "good", "bad")


def alike_groups(nodes: DataFrame, alike: float = ALIKE) -> DataFrame:
    """parent, good, bad, group, all_good, all_bad: which labelled siblings of ``nodes`` (node, parent, good, bad) are merged.

    The labelled siblings below a parent start as one group. While one of a group differs from the others of the group
    together (two shares, z over ``alike``), the group is parted at its share of good urls. So branches that are
    all bad end up together whatever stands beside them, and a branch with few labels goes to the side it leans to.
    Siblings with the same counts can't be told apart: they are one row (``n_alike`` of them), so that a parent with very many
    branches is no large group. Rounds end when no group is parted; each round parts every group that still can be.
    """
    group = ["parent", "group"]
    kinds = nodes.groupBy("parent", "good", "bad").agg(F.count(F.lit(1)).alias("n_alike")).withColumn("group", F.lit(""))
    kinds = materialised(kinds, "url-kinds")
    while True:
        totals = kinds.groupBy(*group).agg(
            F.sum(F.col("good") * F.col("n_alike")).alias("all_good"), F.sum(F.col("bad") * F.col("n_alike")).alias("all_bad"))
        n = (F.col("good") + F.col("bad")).cast("double")
        rest = (F.col("all_good") + F.col("all_bad")).cast("double") - n
        share, other, pooled = F.col("good") / n, (F.col("all_good") - F.col("good")) / rest, F.col("all_good") / (n + rest)
        apart = (share - other) * (share - other) > alike * alike * (pooled * (1 - pooled)) * (1 / n + 1 / rest)
        tested = kinds.join(totals, group).withColumns({
            "apart": F.when(rest > 0, apart).otherwise(False), "low": share < pooled})
        tested = materialised(tested, "url-tested")
        parted = tested.where("apart").select(*group).distinct()
        if parted.isEmpty():
            return tested.drop("apart", "low", "n_alike")
        sides = tested.join(parted.withColumn("parted", F.lit(True)), group, "left")
        side = F.when(F.col("parted"), F.when(F.col("low"), "<").otherwise(">")).otherwise("")
        kinds = materialised(sides.select("parent", "good", "bad", "n_alike", F.concat("group", side).alias("group")), "url-kinds")


def purities(templates: DataFrame, alike: float = ALIKE) -> DataFrame:
    """host, template, purity of every row of ``templates`` (host, template, segments, good, bad).

    Purity is (good + 1) / (good + bad + 2) over the merged branches (``alike_groups``) of the deepest labelled node on the
    way to the template that was parted from a sibling, else of the first node: what is below a branch and does not differ there
    has the purity of the branch and of those merged with it. A host is no template: where not even the first segment has
    labels, purity is 0.5.
    """
    steps = branches(templates)
    nodes = materialised(steps.groupBy("parent", "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where("good + bad > 0"), "url-nodes")
    groups = alike_groups(nodes, alike).withColumn(
        "purity", (F.col("all_good") + 1) / (F.col("all_good") + F.col("all_bad") + 2)).select("parent", "good", "bad", "group", "purity")
    of_node = nodes.join(groups, ["parent", "good", "bad"]).select("node", "group", "purity")
    deepest = F.max(F.when((F.col("group") != "") | (F.col("purity").isNotNull() & (F.col("level") == 1)), F.struct("level", "purity")))["purity"]
    return steps.select("host", "template", "level", "node").join(of_node, "node", "left").groupBy("host", "template").agg(
        F.coalesce(deepest, F.lit(0.5)).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], least_purity: float = PURITY, label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of ``pages`` (page_id, url; others are ignored).

    The verdict is that of the longest rule that fits, else ``block`` where the purity of the url's template is under
    ``least_purity``, else ``allow``. Labels that templates are learned from are ``label`` (a boolean
    over the columns of ``pages``, null for unknown) if given, else the verdicts of the rules. A null url, or one without
    ``://``, has an empty host and path; repeated rows are judged alike and count as often as they occur. Paths of any depth
    are followed to their end.
    """
    host, path = host_and_path("url")
    given = label if label is not None else F.lit(None).cast("boolean")
    base = pages.select("page_id", host.alias("host"), path.alias("path"), given.alias("label")).withColumn("found", longest_rule(rules))
    good = F.col("label") if label is not None else F.col("found.verdict") == "allow"
    base = base.select("page_id", "host", "path", "found", good.alias("good"), template_of(F.col("path")).alias("segments"))
    base = base.withColumn("template", F.concat(F.lit("/"), F.array_join("segments", "")))
    templates = base.groupBy("host", "template").agg(
        F.first("segments").alias("segments"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    known = materialised(purities(materialised(templates, "url-templates")), "url-purities")
    out = base.drop("good", "segments").join(known, ["host", "template"])
    verdict = F.coalesce("found.verdict", F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
