"""A Merkle manifest of a table: leaves, subroots of groups, one root, and proofs found by pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.skew import running_total
from cohortloom.session import held, materialised

#: Levels that one grouping builds: blocks of 16 nodes.
STEP = 4
#: An entry of a proof: a mark (0 no sibling, 1 it stands on the left, 2 on the right) and the sibling's 32 bytes.
ENTRY = 33
_NONE = "X'30" + "00" * 32 + "'"


def leaf(fields: Sequence[Column]) -> Column:
    """Lowercase hex sha256 over the fields: ``-`` for null, else byte count, ``:`` and the value as text."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def tree_of(group: Column) -> Column:
    """The tree of a group as text that sorts like the groups: null first, then by UTF-8 bytes."""
    return F.when(group.isNull(), "n").otherwise(F.concat(F.lit("v"), group.cast("string")))


def _hex(binary: str) -> str:
    return f"lower(hex({binary}))"


def _levels(nodes: DataFrame, base: int) -> DataFrame:
    """Blocks of 2**STEP neighbours of level ``base`` as arrays ``a0``, ``a1``, ... of the hashes of each level above.

    ``nodes`` has tree, height, pos, hash, item; a tree of height h ends after h levels.
    """
    blocks = nodes.groupBy("tree", "height", F.shiftright("pos", STEP).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", "item"))).alias("own"))
    blocks = blocks.withColumn("a0", F.col("own.hash"))
    for k in range(STEP):
        pair = f"concat({_hex(f'a{k}[2 * i]')}, coalesce({_hex(f'get(a{k}, 2 * i + 1)')}, ''))"
        above = f"transform(sequence(0, (size(a{k}) + 1) div 2 - 1), i -> unhex(sha2({pair}, 256)))"
        blocks = blocks.withColumn(f"a{k + 1}", F.expr(above))
    reached = F.least(F.lit(STEP), F.col("height") - base)
    return blocks.withColumn("top", F.get(F.element_at(F.array(*[f"a{k}" for k in range(STEP + 1)]), reached + 1), F.lit(0)))


def _segment(base: int) -> str:
    """The siblings of member i of a block, from its own level up to the block's top."""
    parts = []
    for k in range(STEP):
        at = f"shiftright(i, {k})"
        sibling = f"get(a{k}, if({at} % 2 = 1, {at} - 1, {at} + 1))"
        parts.append(f"if(height > {base + k}, coalesce(concat(if({at} % 2 = 1, X'31', X'32'), {sibling}), {_NONE}), X'')")
    return f"concat({', '.join(parts)})"


def proofs(leaves: DataFrame, name: str = "merkle") -> DataFrame:
    """For each leaf the siblings on its way to the root of its tree: tree, hash, item, proof, top.

    ``leaves`` has tree (text), pos (from 0 within the tree, without gaps), hash (binary) and item (any column that
    rides along). Two neighbours make one node, a last node without neighbour is hashed alone, until one is left.

    Every node holds the segment of siblings between it and an ancestor ``STEP`` levels up. Self-joins then put the
    segment of that ancestor behind its own, which doubles the distance each time, until every leaf has reached
    the root. A node is looked up by its unique place, and only nodes at multiples of the distance are needed any more.
    """
    sizes = leaves.groupBy("tree").agg(F.max("pos").alias("last"))
    height = F.when(F.col("last") > 0, F.length(F.bin("last"))).otherwise(0).cast("int")
    sizes = materialised(sizes.select("tree", height.alias("height")), f"{name}-sizes")
    tallest = sizes.agg(F.max("height")).first()[0] or 0
    spark, schema = leaves.sparkSession, leaves.schema
    level, base, parts, roots = leaves.join(sizes, "tree"), 0, [], []
    while True:
        blocks = materialised(_levels(level, base), f"{name}-blocks")
        part = blocks.select("tree", "block", F.posexplode("own").alias("i", "node"), "height", *[f"a{k}" for k in range(STEP)])
        parts.append(part.select("tree", F.lit(base // STEP).alias("stage"), "node.*", F.expr(_segment(base)).alias("proof")))
        roots.append(blocks.where(F.col("height") <= base + STEP).select("tree", "top"))
        base += STEP
        if base >= tallest:
            break
        empty = F.lit(None).cast(schema["item"].dataType)
        level = blocks.where(F.col("height") > base).select("tree", "height", F.col("block").alias("pos"), F.col("top").alias("hash"), empty.alias("item"))
    nodes, stages, distance = parts[0], len(parts), 1
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    while distance < stages:
        up = nodes.where(F.col("stage") >= distance).select(
            F.col("tree").alias("up_tree"), F.col("stage").alias("up_stage"), F.col("pos").alias("up_pos"), F.col("proof").alias("rest"))
        near = nodes.where(F.col("stage") % (2 * distance) == 0)
        met = near.join(up, (F.col("tree") == F.col("up_tree")) & (F.col("stage") + distance == F.col("up_stage"))
                        & (F.shiftright("pos", STEP * distance) == F.col("up_pos")), "left")
        joined = F.concat("proof", F.coalesce("rest", F.expr("X''"))).alias("proof")
        nodes = materialised(met.select("tree", "stage", "pos", "hash", "item", joined), f"{name}-jumps")
        distance *= 2
    top = roots[0]
    for r in roots[1:]:
        top = top.unionByName(r)
    top = materialised(top, f"{name}-roots")  # one row a tree, so that its size is known to the join
    return nodes.where("stage = 0").join(top, "tree").select("tree", "hash", "item", "proof", "top")


def _entries(proof: str) -> str:
    return f"sequence(0, length({proof}) div {ENTRY} - 1)"


def proof_digest(proof: str) -> Column:
    """Lowercase hex sha256 over the hex siblings of a proof, in order; of nothing, where there are none."""
    sibling = _hex(f"substring({proof}, i * {ENTRY} + 2, 32)")
    each = f"transform({_entries(proof)}, i -> if(substring({proof}, i * {ENTRY} + 1, 1) = X'30', '', {sibling}))"
    return F.expr(f"sha2(if(length({proof}) = 0, '', array_join({each}, '')), 256)")


def fold(start: str, proof: str) -> Column:
    """The root as binary that follows from a leaf (binary) and the siblings of its proof."""
    mark, sibling = f"substring({proof}, i * {ENTRY} + 1, 1)", _hex(f"substring({proof}, i * {ENTRY} + 2, 32)")
    step = f"concat(if({mark} = X'31', {sibling}, ''), {_hex('x')}, if({mark} = X'32', {sibling}, ''))"
    return F.expr(f"if(length({proof}) = 0, {start}, aggregate({_entries(proof)}, {start}, (x, i) -> unhex(sha2({step}, 256))))")


def manifest(rows: DataFrame, key: Column, group: Column, hashed: Column, carried: Column | None = None) -> DataFrame:
    """Commit to the rows: key, leaf, carried, subroot, proof, root; digests and the proof as binary.

    Leaves of a group ascend by ``key`` (nulls last, equal keys by their leaf, so equal rows give equal results in
    any order) and make the group's subroot; subroots, ordered by group (null first, then bytewise), make the root in the
    same way. ``proof`` holds all siblings from leaf to root (``proof_digest``, ``fold``). An empty table gives no rows. Texts
    are hashed whole, one row at a time; no group is gathered: blocks of 16 nodes are the largest unit.
    """
    item = F.struct(key.alias("key"), (F.lit(None).cast("binary") if carried is None else F.unhex(carried)).alias("carried"))
    leaves = held(rows.select(tree_of(group).alias("tree"), F.unhex(hashed).alias("hash"), item.alias("item"), key.alias("key")), "merkle-leaves")
    placed = running_total(leaves, ["tree"], ["key", "hash"], "pos", start_at=0)
    placed = materialised(placed.select("tree", "pos", "hash", "item"), "merkle-places")
    own = materialised(proofs(placed), "merkle-proofs")
    groups = held(own.groupBy("tree").agg(F.first("top").alias("hash")), "merkle-trees")
    ranked = running_total(groups.withColumn("all", F.lit("t")), ["all"], ["tree"], "pos", start_at=0)
    ranked = materialised(ranked.select(F.col("all").alias("tree"), "pos", "hash", F.col("tree").alias("item")), "merkle-ranks")
    above = proofs(ranked, "merkle-groups")
    above = materialised(above.select(F.col("item").alias("tree"), F.col("proof").alias("rest"), F.col("top").alias("root")), "merkle-above")
    return own.join(above, "tree").select(
        "item.key", F.col("hash").alias("leaf"), "item.carried", F.col("top").alias("subroot"), F.concat("proof", "rest").alias("proof"), "root")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(docs: DataFrame, tampered: Column, fields: Sequence[str] = FIELDS, change: str = "n_chars") -> DataFrame:
    """Manifest of ``docs`` and what a check finds where ``tampered`` rows had 1 added to ``change``.

    Returns doc_id, leaf, subroot, root, proof_sha256 (lowercase hex, of the untouched table), folded_root (from the
    tampered leaf, else the own one, and the original siblings) and verified (equals the root). A null ``change`` stays
    null, so that its row still verifies. Columns other than ``fields`` are ignored.
    """
    own = [F.col(f) for f in fields]
    other = [F.when(tampered, F.col(f) + 1).otherwise(F.col(f)) if f == change else F.col(f) for f in fields]
    out = manifest(docs, F.col("doc_id"), F.col("lang"), leaf(own), F.when(tampered, leaf(other)))
    out = out.withColumn("start", F.coalesce("carried", "leaf"))
    folded = out.withColumn("folded", fold("start", "proof"))
    return folded.select(
        F.col("key").alias("doc_id"), *[F.expr(_hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        proof_digest("proof").alias("proof_sha256"), F.expr(_hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
