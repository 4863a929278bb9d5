"""Prefix trie of conversations with totals of every subtree.

A node is a distinct sequence of first turns; its members are the conversations that start with it.
Nodes are found without walking: a turn at depth d gets two hashes that depend on d, and their sums
over the first d turns name the prefix, so a conversation of any length is summed in pieces and
prefixes meet in one aggregation.

Totals over subtrees come from a centroid decomposition. Nodes with the same members form a chain;
chains are the nodes of a smaller forest, in which the conversations below a chain are known from
the start: its members. In a component of weight W the chains with more than W/2 conversations below
them are a path from the top, and the lowest of them is the centroid: below it and beside it at most
W/2 are left. A round takes the centroid out, adds the total of its subtree to the chains between it
and the top, and leaves the subtrees below it, and the rest, as new components. Components of at most
``task_weight`` conversations (so at most twice as many chains) are finished by one task each, in the
same way; larger ones take one round of joins, so there are log2(conversations / task_weight) rounds.

Every step over unbounded groups is cut: turns are range-partitioned within a conversation, children
of one node are joined in pieces, and the identifiers that end at a node are hashed block by block.

Defined results: rows without conv_id belong to no conversation. Turns are ordered with NULL first;
equal turns by role, then by the SHA-256 of the text; repeated rows are repeated turns. Other columns
are ignored. Identifiers below 0 share heads like the others (``conv_id - conv_id % 20`` keeps the
sign). An empty table has no conversations and so no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecast.llm.common import NOT_SPACE, mark, materialise, ready, release, text_of
from stagecast.operators.lookup import split_join

#: Conversations below a component that one task finishes.
TASK_WEIGHT = 20_000
#: Identifiers of one block of the digest of endings.
BLOCK = 256
#: Conversations per shared head, and turns of a head at most.
GROUP, HEAD = 20, 3


def ranged(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """``df`` as a written table with ``part``: its rows in ranges of ``by``, cut within keys too."""
    return materialise(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), label)


def totals_before(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (part, key) that continues a key of earlier parts: the sums over these.

    Ranges are in order, so such a key is the first of its part, and there is at most one row a part.
    """
    first = parts.groupBy("part").agg(F.min(F.struct(*keys)).alias("k")).select("part", "k.*")
    over = parts.join(F.broadcast(first.select(*keys).distinct()), keys, "left_semi")
    found = over.groupBy("part", *keys).agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("part", *keys, *[F.sum(n).over(before).alias(n) for n in sums]).where(F.col(next(iter(sums))).isNotNull())


def _decimal(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, words, k1, k2, p1, p2) with the names of prefix and parent; all conv_ids with their depth."""
    text = text_of("text")
    words = F.regexp_count(text, F.lit(f"{NOT_SPACE}+")).cast("long")
    role = text_of("role")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), words.alias("words")
    )
    turn = F.xxhash64(F.lit("turn"), "role", "digest"), F.xxhash64(F.lit("second"), "digest", "role")
    parts = ranged(turns.select("*", turn[0].alias("t1"), turn[1].alias("t2")), ["conv_id", "turn", "role", "digest"], "turns")
    in_order = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "digest")
    before = totals_before(parts, ["conv_id"], {"n_before": F.count(F.lit(1))})
    numbered = (
        parts.withColumn("p", F.row_number().over(in_order).cast("long"))
        .join(F.broadcast(before), ["part", "conv_id"], "left")
        .select("part", "conv_id", "words", "t1", "t2", (F.col("p") + F.coalesce("n_before", F.lit(0))).alias("p"))
    )
    numbered = materialise(numbered, "numbered-turns")
    # Groups of (part, conversation): a conversation of any size has one per part.
    shared = F.crc32(F.col("conv_id").cast("string")) % 4
    groups = numbered.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = groups.groupBy("conv_id").agg(F.sum("n").alias("n")).select(
        "conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    )
    heads = numbered.where((F.col("p") <= HEAD) & (F.col("conv_id") % GROUP == 0)).select(
        F.col("conv_id").alias("base"), F.col("p").alias("depth"), "words", "t1", "t2"
    )
    held = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n_head"))
    convs = materialise(
        convs.join(held, "base", "left").withColumn("h_used", F.least("h", F.coalesce("n_head", F.lit(0)))).select(
            "conv_id", "base", "h", "h_used", (F.col("h_used") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
        ), "conversations",
    )
    # Each of a conversation's groups gets its head's length; the rows join within their own part.
    sized = groups.select("part", "conv_id").join(convs.select("conv_id", "h", "h_used"), "conv_id")
    own = (
        numbered.join(sized.hint("merge"), ["part", "conv_id"]).where("p > h")
        .select("part", "conv_id", (F.col("p") - F.col("h") + F.col("h_used")).alias("depth"), "words", "t1", "t2")
    )
    lent = (
        convs.where("h_used > 0").join(heads, "base").where("depth <= h_used")
        .select(F.lit(-1).alias("part"), "conv_id", "depth", "words", "t1", "t2")
    )
    rebuilt = own.unionByName(lent).select(
        "part", "conv_id", "depth", "words",
        _decimal(F.xxhash64("depth", "t1")).alias("x1"), _decimal(F.xxhash64("t2", "depth")).alias("x2"),
    )
    rebuilt = materialise(rebuilt, "rebuilt-turns")
    # A head is a part of its own, before all others: whatever follows it needs its sums.
    heads_of = rebuilt.where("part = -1").groupBy("conv_id").agg(F.sum("x1").alias("h1"), F.sum("x2").alias("h2"))
    local = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    over_parts = totals_before(rebuilt.where("part >= 0"), ["conv_id"], {"b1": F.sum("x1"), "b2": F.sum("x2")})
    lead = sized.where("h_used > 0").join(heads_of, "conv_id").select("part", "conv_id", "h1", "h2")
    summed = (
        rebuilt.select("*", F.sum("x1").over(local).alias("s1"), F.sum("x2").over(local).alias("s2"))
        .join(lead.hint("merge"), ["part", "conv_id"], "left")
        .join(F.broadcast(over_parts), ["part", "conv_id"], "left")
    )
    zero = F.lit(0)
    s1 = F.col("s1") + F.coalesce("h1", zero) + F.coalesce("b1", zero)
    s2 = F.col("s2") + F.coalesce("h2", zero) + F.coalesce("b2", zero)
    rows = summed.select("conv_id", "depth", "words", s1.alias("s1"), s2.alias("s2"), (s1 - F.col("x1")).alias("q1"), (s2 - F.col("x2")).alias("q2"))

    here, above = _name(F.col("depth"), F.col("s1"), F.col("s2")), _name(F.col("depth") - 1, F.col("q1"), F.col("q2"))
    named = rows.select("conv_id", "depth", "words", here[0].alias("k1"), here[1].alias("k2"), above[0].alias("p1"), above[1].alias("p2"))
    return materialise(named, "prefixes"), convs


def _name(depth: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """128 bits that name a prefix."""
    values = [depth.cast("long"), first.cast("decimal(38,0)"), second.cast("decimal(38,0)")]
    return F.xxhash64(F.lit("first"), *values), F.xxhash64(*values, F.lit("second"))


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: name, smallest member, members, parent, children, words of the last turn."""
    found = materialise(rows.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.count(F.lit(1)).alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    ), "trie-nodes")
    children = found.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialise(
        found.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children"
    )
    inner = counted.where("n_children > 0")
    parents = inner.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    sizes = inner.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_children").alias("n"))
    joined = split_join(counted.where("depth > 1"), parents, ["p1", "p2"], sizes)
    # The root is one row, so its children take it from the driver.
    root = convs.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")).first()
    top = counted.where("depth = 1").select("*", F.lit(root["c"]).cast("long").alias("parent_conv_id"), F.lit(root["n"]).alias("parent_convs"))
    name, none = _root_name(), F.lit(None).cast("long")
    itself = (
        convs.sparkSession.range(1 if root["n"] else 0)
        .select(
            name[0].alias("k1"), name[1].alias("k2"), F.lit(root["c"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
            F.lit(0).cast("long").alias("words"), F.lit(root["n"]).cast("long").alias("n_convs"), none.alias("parent_conv_id"),
            none.alias("parent_convs"), F.lit(counted.where("depth = 1").count()).cast("long").alias("n_children"),
        )
    )
    return materialise(joined.select(*itself.columns).unionByName(top.select(*itself.columns)).unionByName(itself), "trie")


def _root_name() -> tuple[Column, Column]:
    return _name(F.lit(0), F.lit(0), F.lit(0))


def chain_forest(nodes: DataFrame) -> DataFrame:
    """Chains of nodes with the same members, named by smallest member and members (c, n).

    (pc, pn) is the parent chain, NULL at the top; leaves and saved are the sums of its nodes.
    """
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    above = F.struct(F.col("parent_conv_id").alias("pc"), F.col("parent_convs").alias("pn"))
    return nodes.groupBy(F.col("conv_id").alias("c"), F.col("n_convs").alias("n")).agg(
        F.min("depth").alias("d"), F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved"), F.min_by(above, "depth").alias("above"),
    ).select("c", "n", "d", "above.pc", "above.pn", "leaves", "saved")


def passed_chains(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """For smallest members of chains: the chains they pass, each with its parent (member, pc, pn, nc, nn)."""
    begins = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id")) | (F.col("parent_convs") != F.col("n_convs"))
    tops = nodes.where(begins & (F.col("depth") > 0)).select(
        "k1", "k2", F.col("parent_conv_id").alias("pc"), F.col("parent_convs").alias("pn"), F.col("conv_id").alias("nc"), F.col("n_convs").alias("nn")
    )
    members = rows.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi").select("k1", "k2", F.col("conv_id").alias("member"))
    sizes = nodes.select("k1", "k2", F.col("n_convs").alias("n"))
    return split_join(members, tops, ["k1", "k2"], sizes).select("member", "pc", "pn", "nc", "nn")


def finish(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of a tree whose parents precede their children (-1 at the top), by centroids."""
    result, stack = np.zeros_like(values), [np.arange(len(parent))]
    slot = np.full(len(parent) + 1, -1)
    up = parent.tolist()
    while stack:
        part = stack.pop()
        slot[part] = np.arange(len(part))
        above = [slot[up[u]] if up[u] >= 0 else -1 for u in part.tolist()]
        slot[part] = -1
        size, total = [1] * len(part), values[part].copy()
        for u in range(len(part) - 1, 0, -1):  # a component's first node is its top
            size[above[u]] += size[u]
            total[above[u]] += total[u]
        centroid = max(u for u in range(len(part)) if 2 * size[u] > len(part))  # the path, by depth
        result[part[centroid]] += total[centroid]
        u = above[centroid]
        while u >= 0:
            result[part[u]] += total[centroid]
            u = above[u]
        # 0: the rest; below the centroid every child begins a component of its own.
        label = [0] * len(part)
        label[centroid] = -1
        groups: list[list[int]] = [[]]
        for u in range(len(part)):
            if u == centroid:
                continue
            if u and above[u] == centroid:
                label[u] = len(groups)
                groups.append([])
            elif u:
                label[u] = label[above[u]]
            groups[label[u]].append(u)
        stack += [part[g] for g in groups if g]
    return result


_STATE = ("c", "n", "d", "w", "pc", "pn", "leaves", "saved", "tc", "tn", "up_leaves", "up_saved")
_COMPONENT, _OF_SUBTREE = ["tc", "tn"], ("leaves", "saved")


def chain_totals(chains: DataFrame, passed: Callable[[], DataFrame], task_weight: int = TASK_WEIGHT) -> DataFrame:
    """c, n, leaves, saved: the totals of the subtree of every chain of a tree.

    ``passed`` gives :func:`passed_chains`; it is needed only if a component is too large for a task.
    """
    spark = ready(chains.sparkSession)
    top = chains.where("pc IS NULL").first()
    nothing = F.lit(0).cast("long")
    # w: conversations below a chain within its component, which is named by its top (tc, tn).
    state = chains.select("*", F.col("n").alias("w"), F.lit(top and top["c"]).cast("long").alias("tc"), F.lit(top and top["n"]).cast("long").alias("tn"), nothing.alias("up_leaves"), nothing.alias("up_saved"))
    state = materialise(state.select(*_STATE), "components")
    done, small, passes = [], [], None
    while True:
        begun = mark() - 1  # the table of ``state``
        weights = state.groupBy(*_COMPONENT).agg(F.max("w").alias("whole"))
        # Every component above task_weight has as many conversations of its own: this table is
        # shorter than conversations / task_weight, and so are those made of it below.
        large = materialise(weights.where(F.col("whole") > task_weight), "large-components")
        if large.isEmpty():
            small.append(state)
            break
        small.append(materialise(state.join(F.broadcast(large), _COMPONENT, "left_anti"), "small-components"))
        kept = {mark() - 1}
        if passes is None:
            passes = materialise(passed(), "passed-chains")
            kept.add(mark() - 1)
        state, more = _divide(state, large, passes)
        done.append(more)
        kept |= {mark() - 2, mark() - 1}
        for k in range(begun, mark()):
            if k not in kept:
                release(spark, k, k + 1)
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    # Small components share groups of about task_weight conversations.
    heaviest = rows.groupBy(*_COMPONENT).agg(F.max("w").alias("w")).agg(F.sum("w")).first()[0] or 0
    groups = F.lit(max(1, -(-heaviest // task_weight)))
    totals = rows.groupBy(F.pmod(F.xxhash64(*_COMPONENT), groups).alias("g")).applyInPandas(_solve, "c long, n long, leaves long, saved long")
    for more in done:
        totals = totals.unionByName(more)
    return totals


def _divide(state: DataFrame, large: DataFrame, passes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over large components: what is left of them, and the totals of chains that are done."""
    inside = state.join(F.broadcast(large), _COMPONENT)
    on_path = 2 * F.col("w") > F.col("whole")
    centre = inside.where(on_path).groupBy(*_COMPONENT).agg(F.max(F.struct("d", "c", "n", "w")).alias("m")).select(
        *_COMPONENT, F.col("m.d").alias("md"), F.col("m.c").alias("mc"), F.col("m.n").alias("mn"), F.col("m.w").alias("mw")
    )
    # A deeper chain is below the centroid if its smallest member passes one of the centroid's children.
    via = passes.select(F.col("member").alias("c"), F.col("pc").alias("mc"), F.col("pn").alias("mn"), "nc", "nn")
    placed = materialise(inside.join(F.broadcast(materialise(centre, "centroids")), _COMPONENT).join(via, ["c", "mc", "mn"], "left"), "placed")
    below, centroid = F.col("nc").isNotNull() & (F.col("d") > F.col("md")), (F.col("c") == F.col("mc")) & (F.col("n") == F.col("mn"))
    subtree = placed.where(below | centroid).groupBy(*_COMPONENT).agg(*[F.sum(x).alias(f"s_{x}") for x in _OF_SUBTREE])
    plain = [x for x in _STATE if not x.startswith("up_") and x != "w"]
    rest = materialise(
        placed.where(~below).join(F.broadcast(subtree), _COMPONENT).select(
            *plain, "w", "mw", on_path.alias("on_path"), centroid.alias("centroid"),
            *[(F.col(f"up_{x}") + F.when(on_path, F.col(f"s_{x}")).otherwise(0)).alias(f"up_{x}") for x in _OF_SUBTREE],
        ), "beside-centroids",
    )
    # Chains on the path that lose all conversations form one line with the centroid: nothing else
    # hangs there, so their totals follow from the line.
    ends = F.col("on_path") & (F.col("w") == F.col("mw"))
    upwards = Window.partitionBy(*_COMPONENT).orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    left = rest.where(~ends).withColumn("w", F.when(F.col("on_path"), F.col("w") - F.col("mw")).otherwise(F.col("w")))
    fresh = placed.where(below).drop(*_COMPONENT).withColumnsRenamed({"nc": "tc", "nn": "tn"})
    done = rest.where(ends).select(
        "c", "n", *[(F.col(f"up_{x}") + F.sum(F.when(~F.col("centroid"), F.col(x)).otherwise(0)).over(upwards)).alias(x) for x in _OF_SUBTREE]
    )
    done = materialise(done, "line-totals")
    return materialise(left.select(*_STATE).unionByName(fresh.select(*_STATE)), "components"), done


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of all chains of some whole components."""
    rows = rows.sort_values(["tc", "tn", "d", "c"], ignore_index=True)
    names = list(zip(rows["c"], rows["n"]))
    number = {name: k for k, name in enumerate(names)}
    # The parent of a component's top is in another component, or nowhere.
    up = [number.get((c, n), -1) for c, n in zip(rows["pc"], rows["pn"])]
    tops = list(zip(rows["tc"], rows["tn"]))
    values, totals = rows[["leaves", "saved"]].to_numpy(np.int64), np.zeros((len(rows), 2), np.int64)
    begins = [k for k in range(len(rows)) if not k or tops[k] != tops[k - 1]]
    for a, b in zip(begins, [*begins[1:], len(rows)]):
        parent = np.array([p - a if a <= p < b else -1 for p in up[a:b]], np.int64)
        totals[a:b] = finish(parent, values[a:b])
    return pd.DataFrame({"c": rows["c"], "n": rows["n"], "leaves": totals[:, 0] + rows["up_leaves"], "saved": totals[:, 1] + rows["up_saved"]})


def endings(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of every node at which conversations end."""
    ready(convs.sparkSession)
    name = _root_name()
    ends = convs.select("conv_id", F.col("length").alias("depth"))
    last = rows.join(ends, ["conv_id", "depth"]).select("conv_id", "k1", "k2").unionByName(
        ends.where("depth = 0").select("conv_id", name[0].alias("k1"), name[1].alias("k2"))
    )
    # Identifiers are distinct, so a block holds at most BLOCK of them.
    blocks = materialise(
        last.groupBy("k1", "k2", F.floor(F.col("conv_id") / F.lit(BLOCK)).alias("block")).agg(
            F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
        ), "ending-blocks",
    )
    sized = blocks.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    alone = sized.where("n = 1").select("k1", "k2", F.sha2("ids", 256).alias("ends_sha256"))
    several = blocks.join(sized.where("n > 1").select("k1", "k2"), ["k1", "k2"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (a, b) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield from _rows(done)
        yield from _rows([] if key is None else [(*key, state.hexdigest())])

    def _rows(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["k1", "k2", "ends_sha256"])

    # A digest is one sequence by definition: the blocks of a node stream through it in order.
    streamed = several.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids")
    return alone.unionByName(streamed.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, task_weight: int = TASK_WEIGHT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with the totals of its subtree.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    rows, convs = prefixes(conversations)
    nodes = trie_nodes(rows, convs)
    chains = materialise(chain_forest(nodes), "chains")
    totals = materialise(chain_totals(chains, lambda: passed_chains(rows, nodes), task_weight), "chain-totals")
    # Within a chain a node's total lacks what the nodes above it save. A chain may be any length.
    parts = ranged(nodes, ["conv_id", "n_convs", "depth"], "trie-ranges")
    chain, own = ["conv_id", "n_convs"], (F.col("n_convs") - 1) * F.col("words")
    above = totals_before(parts, chain, {"b_saved": F.sum(own)})
    local = Window.partitionBy("part", *chain).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    of_chain = totals.select(F.col("c").alias("conv_id"), F.col("n").alias("n_convs"), "leaves", "saved")
    sized = parts.select("part", *chain).distinct().join(of_chain, chain)
    summed = (
        parts.withColumn("a_saved", F.coalesce(F.sum(own).over(local), F.lit(0)))
        .join(sized.hint("merge"), ["part", *chain])
        .join(F.broadcast(above), ["part", *chain], "left")
    )
    return summed.join(endings(convs, rows), ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("a_saved") - F.coalesce("b_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
