"""Mix documents to target weights: budgets down a tree of domain, language and source, then token prefixes of leaves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialised

#: Documents in a piece of a leaf's order, on average.
PIECE = 1000
_HASH_BITS = 60


def word_count(text: str) -> Column:
    """Tokens of a text: words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def place(seed: int, epoch: Column, doc_id: str) -> Column:
    """Where a document stands in an epoch: 60 bits of an md5 of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _weight(weights: Mapping[str, int], name: Column) -> Column:
    out = F.lit(weights.get("*", 1))
    for key, value in sorted(weights.items()):
        out = F.when(name == key, value).otherwise(out) if key != "*" else out
    return out.cast("decimal(38,0)")


def share_out(nodes: DataFrame, parents: Sequence[str]) -> DataFrame:
    """Give each parent's ``budget`` to its children by ``weight``, none more than its ``capacity``.

    What a child can't take goes to its siblings by their weights, until the budget or all capacity is used up.
    ``nodes`` has the columns of ``parents``, name, weight, capacity, budget; budget is replaced by ``got``. Children
    fill up in the order of capacity over weight; the others share what is left, rounded down.
    """
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0).cast("decimal(38,0)"))
    ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double")).otherwise(-1.0)
    group = Window.partitionBy(*parents)
    before = group.orderBy(ratio, "name").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("decimal(38,0)"))
    out = out.withColumn("rest", (F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("decimal(38,0)"))
    fits = F.col("capacity").cast("double") * F.col("rest").cast("double") <= F.col("weight").cast("double") * (
        F.col("budget") - F.col("used")).cast("double")
    # once a child does not fill up, none after it does: it and they share by the state before the first of them
    out = out.withColumn("open_used", F.min(F.when(~fits, F.col("used"))).over(group))
    out = out.withColumn("open_rest", F.max(F.when(~fits, F.col("rest"))).over(group))
    part = F.floor((F.col("weight").cast("double") * (F.col("budget") - F.col("open_used")).cast("double")) / F.col("open_rest").cast("double"))
    got = F.when(fits, F.col("capacity")).otherwise(F.least(F.col("capacity"), F.greatest(part, F.lit(0)).cast("decimal(38,0)")))
    return out.withColumn("got", got.cast("bigint")).select(*parents, "name", "got")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, epochs: int) -> DataFrame:
    """The tokens each leaf (domain, lang, source) is to give, from its ``tokens``.

    The root's budget is ``share`` of all tokens, rounded down. A node can give the tokens of its leaves
    ``epochs`` times at most. Budgets go down level by level within what each subtree can give: so a shortage is
    made up by siblings first, and by other branches of an ancestor only where all siblings are used up.
    """
    levels = ["domain", "lang", "source"]
    caps = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("decimal(38,0)"))
    above: list[str] = []
    given = None
    for level in levels:
        nodes = caps.groupBy(*above, level).agg(
            F.sum("capacity").cast("decimal(38,0)").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumnRenamed(level, "name").withColumn("weight", _weight(weights.get(level, {}), F.col("name")))
        if above:
            parts = [F.col(f"u_{c}") == F.col(c) for c in above]
            given = given.select(*[F.col(c).alias(f"u_{c}") for c in above], "budget")
            nodes = nodes.join(given, parts).select(*above, "name", "weight", "capacity", "budget")
        else:
            everything = F.sum("tokens").over(Window.partitionBy()).cast("double")
            nodes = nodes.withColumn("budget", F.floor(everything * share).cast("decimal(38,0)")).drop("tokens")
        given = share_out(nodes, above).withColumnRenamed("name", level).withColumnRenamed("got", "budget")
        above.append(level)
    return given


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], share: float, epochs: int = 1, seed: int = 1,
) -> DataFrame:
    """Which documents to take, how often and how far, to meet the weights of the tree.

    ``docs`` has doc_id, text, lang, source; other columns are ignored. ``domain`` is an expression over them;
    ``weights`` has a whole number for names of each level ("domain", "lang", "source"; "*" for names not listed,
    else 1; 0 takes none). Null names count as the empty name. Each leaf's documents stand in an order of their own
    for each epoch, and the leaf gives the prefix of its epochs, one after the other, that makes up its budget; of the
    last document only the first tokens are taken. Returns a row for each document and epoch taken: domain, lang,
    source, doc_id, epoch (from 1), n_tokens, taken. Documents without tokens are not taken; a null doc_id counts as the
    empty id. Rows of a leaf that share a doc_id stand at the same place: each of them is taken up to the tokens
    that are left there, so that all are taken or none.

    The order is cut into pieces of about a thousand documents; budgets meet the sums of pieces first, and only
    documents of the same piece are numbered together, so that a leaf with most rows is no large task.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = ["domain", "lang", "source"]
    rows = docs.select(name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"),
                       F.col("doc_id"), word_count("text").alias("n_tokens")).where("n_tokens > 0")
    rows = materialised(rows, "mixing-rows")
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    leaves = materialised(leaves, "mixing-leaves")
    budgets = leaf_budgets(leaves, weights, share, epochs)
    # epochs that a leaf begins, and pieces of its order
    plan = leaves.join(budgets, leaf).where("budget > 0").select(
        *leaf, "budget", "tokens", F.ceil(F.col("n_docs") / PIECE).alias("pieces"))
    placed = rows.join(plan, leaf).withColumn("epoch", F.explode(F.expr("sequence(1, cast(ceil(budget / tokens) as int))")))
    placed = placed.withColumn("place", place(seed, F.col("epoch"), "doc_id"))
    placed = placed.withColumn("piece", F.floor(F.col("place").cast("double") / float(1 << _HASH_BITS) * F.col("pieces")))
    placed = placed.select(*leaf, "doc_id", "n_tokens", "epoch", "place", "piece", "budget")
    sums = placed.groupBy(*leaf, "epoch", "piece").agg(F.sum("n_tokens").alias("piece_tokens"))
    so_far = Window.partitionBy(*leaf).orderBy("epoch", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("piece_tokens").over(so_far), F.lit(0))).drop("piece_tokens")
    within = Window.partitionBy(*leaf, "epoch", "piece").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    out = placed.join(sums, [*leaf, "epoch", "piece"]).where("before < budget")
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    out = out.withColumn("left", left).where("left > 0")
    return out.select(*leaf, "doc_id", "epoch", "n_tokens", F.least("n_tokens", "left").alias("taken"))


def taken_texts(docs: DataFrame, domain: Column, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, once for each epoch that ``mixed`` takes them in, with the text cut to what is taken.

    A cut text ends with its last taken word; n_chars, where there is such a column, is set to its length.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = {"domain": name(domain), "lang": name(F.col("lang")), "source": name(F.col("source")), "doc_id": F.col("doc_id")}
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[v.alias(f"of_{k}") for k, v in keys.items()])
    # rows that share a doc_id are taken alike, so one line of ``mixed`` stands for them
    takes = mixed.groupBy(*keys, "epoch").agg(F.max("taken").alias("taken"), F.max("n_tokens").alias("n_tokens"))
    both = rows.join(takes, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("taken") < F.col("n_tokens"), F.array_join(F.slice(words, 1, F.col("taken").cast("int")), "")).otherwise(F.col("row.text"))
    new = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in docs.columns else {})
    return both.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
