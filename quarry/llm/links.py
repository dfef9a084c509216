"""From shared signatures to verified links to components, as Spark jobs.

Input is a table of (sig, id, rep, many): the set ``id`` holds signature ``sig``.  A task
that meets a signature several times sends one row with ``rep`` null (its
smallest id) and the others with that id as ``rep``, so that a signature shared
by a third of all rows reaches the shuffle once a task.

Members of a signature are candidates of each other.  Each member is held against
its group's smallest id; ids in one component need no further comparison.  Before any set
is made or sent, the sketches of both sides bound their intersection from above, which
rules out most pairs; no similar one is lost.  Groups
that stay open (three or more members in several components) are compared whole if
they have at most ``FEW`` members, which makes at most FEW / 2 pairs a member;
the larger ones are joined to clusters, one for each component that is the
largest of a group:

* a cluster of up to ``SMALL`` members is compared in one bounded product of its sketches, one of up to
  ``WIDE`` times as many in a product for any two of its blocks of half that size;
  members that these can't tell apart form parts, of which equal ones of several clusters
  are one, and only the sets of a part meet in a product (of any two blocks if they hold more than ``ITEMS`` items),
  which gives back links only;
* in a larger one a set U of items is taken: the items of the cluster's smallest member, and
  of the earlier pivots that led to it.  Write n and l for the items that a set has beyond
  U and lacks of U.  Two sets that share no item beyond U differ in at least
  n + n' + |l - l'| items.  So similar sets either share an item beyond U, which makes
  the next groups (by the first of their items beyond U, as many as they can't all lack), or
  obey that bound, which few edited copies do: those pairs are found by ranges of
  l - n and verified.  As U keeps the items of earlier
  pivots, what most of a family holds is covered after a few rounds, and
  groups shrink to the sets that share an edit.

So a family of edited copies costs rows in proportion to its items, not to the
square of its members.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import discard, give_back, kept, store

#: Parts over which a task's surplus rows of one signature are spread.
SALTS = 64
#: Clusters of so many members are compared directly; after each round of pivots so many
#: times more, never beyond the last number.
SMALL, GROWTH, SMALL_MOST = 800, 1, 800
#: Clusters of up to so many times that number are dealt into blocks, of which any two are compared directly.
WIDE = 8
#: Groups of so many members are compared pair by pair.
FEW = 32
#: Edges that one task joins to components (two numbers each).
EDGES = 500_000
#: Items of one product of sets; a part with more is dealt into blocks, of which any two are compared.
ITEMS = 1_000_000
#: Items or cells that a product looks at at once, beside them.
STEP = 1 << 18
#: Cells of one numpy product.
CELLS = 4_000_000


def shared(sigs: DataFrame) -> DataFrame:
    """(sig, id, first): rows of signatures that more than one id holds, each once; ``first``
    is the group's smallest id, or for surplus rows their task's."""
    salt = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    w = Window.partitionBy("sig", "salt").orderBy("id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = (sigs.withColumn("salt", salt)
            .select("sig", "id", "rep", F.lag("id").over(w).alias("before"), F.first("id").over(whole).alias("least"),
                    F.last("id").over(whole).alias("most"), F.max("many").over(whole).alias("many")))
    alone = F.col("rep").isNull() & (F.col("least") == F.col("most")) & ~F.col("many")
    again = F.col("before").isNotNull() & (F.col("before") == F.col("id"))
    return seen.filter(~alone & ~again).select("sig", "id", F.coalesce("rep", "least").alias("first"))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function for all edges (a, b): (id, component) of every id but the smallest of its component."""
    kept("links")
    pairs = [np.stack([np.array(c, np.int64) for c in batch.columns]) for batch in batches]
    ids, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    del pairs, at
    root = np.arange(len(ids))
    while True:  # a larger root goes below the smallest that an edge joins it with
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (above := root[root]).tobytes() != root.tobytes():
            root = above
    below = root < np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(ids[root[below]])], ["id", "component"])
    del ids, root, a, b, below
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """Stored (id, component): the smallest id connected to each other id by edges (a, b).  Up to ``EDGES``
    are joined in one task; more in rounds of stars."""
    both = store(edges.filter("a <> b"), "cc")
    out = store(both.coalesce(1).mapInArrow(united, "id long, component long"), "components") if both.count() <= EDGES else stars(both)
    discard(both)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """``components`` by alternate large and small stars, each a map-side-combined minimum and a
    join, until the edges no longer change."""
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = store(both, "cc"), None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (sign["n"], sign["h"]) == mark or not sign["n"]:
            break
        mark = (sign["n"], sign["h"])
        # large star: larger neighbours of u move to the smallest id around u
        ends = now.union(now.select("v", "u"))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (ends.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.filter("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        then = store(small.filter("u <> v").distinct(), "cc")
        discard(now)
        now = then
    # every id points to its component's smallest
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def label(ids: DataFrame, comps: DataFrame, id_col: str = "id", out: str = "component") -> DataFrame:
    """Adds the component of ``id_col``, the id itself when it has no link."""
    c = comps.select(F.col("id").alias("__id"), F.col("component").alias("__c"))
    return (ids.join(c, F.col(id_col) == F.col("__id"), "left")
            .withColumn(out, F.coalesce("__c", id_col)).drop("__id", "__c"))


def similar(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sets (id, items) are similar."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(one, "a").join(two, "b")
    inter = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(similar(inter, F.size("items_a"), F.size("items_b"), percent)).select("a", "b")


def sketch(items: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each of 256 or more equal parts of their range, at
    most four a part on average; 255 stands for any number from there on."""
    bits = 8 + max(0, (len(items) - 1).bit_length() - 10)
    held = np.bincount((items >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(held, 255).astype(np.uint8).tobytes()


def counts(sketches: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches' numbers in ``width`` parts, and which sketches hold a 255."""
    out, full = np.empty((len(sketches), width), np.int32), np.zeros(len(sketches), bool)
    length = np.array([len(x) for x in sketches])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        held = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), width, n // width)
        out[at], full[at] = held.sum(2, dtype=np.int32), (held == 255).any((1, 2))
    return out, full


def may_link(percent: int):
    """Scalar UDF: sizes and sketches of two sets -> whether they may be similar.  An
    intersection is no larger than the sum of what both have in each part."""
    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for size_a, size_b, a, b in batches:
            most = np.minimum(size_a, size_b).to_numpy(np.int64, copy=True)
            width = np.minimum(a.str.len(), b.str.len()).to_numpy()
            for w in np.unique(width):
                alike, step = np.flatnonzero(width == w), max(1, STEP // int(w))
                for at in (alike[i:i + step] for i in range(0, len(alike), step)):
                    (x, full_x), (y, full_y) = (counts(s.iloc[at].tolist(), int(w)) for s in (a, b))
                    most[at] = np.where(full_x | full_y, most[at], np.minimum(x, y).sum(1))
            yield pd.Series(100 * most >= percent * (size_a.to_numpy() + size_b.to_numpy() - most))

    return run


def likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` that the sketches (id, size, sketch) don't rule out."""
    one, two = (marks.select(F.col("id").alias(e), F.col("size").alias(f"size_{e}"), F.col("sketch").alias(f"sketch_{e}")) for e in "ab")
    both = pairs.join(one, "a").join(two, "b")
    return both.filter(may_link(percent)("size_a", "size_b", "sketch_a", "sketch_b")).select("a", "b")


def checked(pairs: DataFrame, marks: DataFrame, sets_of, percent: int) -> DataFrame:
    """Stored links among ``pairs``."""
    left = store(likely(pairs, marks, percent), "likely_pairs")
    if left.isEmpty():
        return left
    sets = sets_of(ends(left).distinct())
    found = store(verify(left, sets, percent), "links")
    for done in (left, sets):
        discard(done)
    return found


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def link(members: DataFrame, marks: DataFrame, sets_of, percent: int) -> DataFrame:
    """(id, component) of sets linked by 100 * intersection >= percent * union, for
    stored tables ``members`` (sig, id, first) and ``marks`` (id, size, sketch).
    ``sets_of(ids)`` gives the stored sets (id, items) of some ids."""
    comps = components(checked(ordered(members.filter("id <> first"), "first", "id"), marks, sets_of, percent))
    groups, small = members.select("sig", "id").distinct(), SMALL
    covered = None
    while True:
        rows = label(groups, comps)
        still = store(rows.join(open_groups(rows), "sig"), "open_members")
        if still.isEmpty():
            return comps
        found, groups, covered, sets = compared(still, marks, sets_of, percent, small, covered)
        small = min(GROWTH * small, SMALL_MOST)
        if not found.isEmpty():
            comps = merged(comps, found)
        discard(still)
        if groups is None:
            return comps
        # the next groups: members against the smallest id of theirs
        rows = label(groups, comps)
        least = rows.groupBy("sig").agg(F.min_by("component", "id").alias("c"), F.min("id").alias("first"))
        star = rows.join(least, "sig").filter("component <> c")
        sets_of = taken_from(sets)  # what is still open was in a large cluster
        found = checked(ordered(star, "first", "id"), marks, sets_of, percent)
        if not found.isEmpty():
            comps = merged(comps, found)


def taken_from(sets: DataFrame):
    return lambda ids: store(sets.join(ids, "id", "left_semi"), "open_sets")


def ordered(df: DataFrame, one: str, other: str) -> DataFrame:
    """Different pairs (a, b) with a < b."""
    return df.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def bound(a: Column, b: Column, percent: int) -> Column:
    """Most items in which similar sets of these sizes differ."""
    return F.floor((100 - percent) * (a + b) / F.lit(100 + percent))


def compared(still: DataFrame, marks: DataFrame, sets_of, percent: int, small: int, covered: tuple[DataFrame, DataFrame] | None):
    """(links found, next groups or None, what their pivots cover, sets of the large clusters) for
    open groups (sig, id, component, n).  ``covered`` are two tables: (sig, cluster), the cluster that a large group
    comes from, and (cluster, items), what the pivots up to then cover."""
    pairs = store(likely(across(still.filter(F.col("n") <= FEW), "sig"), marks, percent), "likely_pairs")
    still = still.filter(F.col("n") > FEW)
    # clusters: open groups whose largest component is the same one; its smallest member is the pivot
    parts = still.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("n"))
    lead = parts.groupBy("sig").agg(F.max_by("component", F.struct("n", -F.col("component").cast("decimal(20,0)"))).alias("cluster"))
    who = still.select("sig", "id", "component").join(lead, "sig").select("cluster", "id", "component").distinct()
    sizes = who.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("pivot"))
    whole = who = store(who.join(sizes, "cluster"), "cluster_members")
    dealt = F.when(F.col("members") <= small, 1).otherwise(F.ceil(F.col("members") / F.lit(max(1, small // 2))))
    parts = (in_blocks(who.filter(F.col("members") <= WIDE * small), dealt).join(marks, "id")
             .select("cluster", "pair", "block", "id", "component", "size", "sketch")
             .groupBy("cluster", "pair").applyInArrow(likely_parts(percent), "part long, id long, component long"))
    parts = store(parts.distinct(), "likely_parts")
    who = who.filter(F.col("members") > WIDE * small)
    wanted = ends(pairs).union(parts.select("id")).union(who.select("id")).distinct()
    if wanted.isEmpty():
        return pairs, None, None, None
    sets = sets_of(wanted)
    direct = products(parts, marks, sets, percent)
    if who.isEmpty():
        found = store(verify(pairs, sets, percent).union(direct).distinct(), "links")
        for done in (pairs, parts, sets, whole):
            discard(done)
        return found, None, None, None
    pivots = who.select("cluster", "pivot").distinct()
    pivots = pivots.join(sets, pivots["pivot"] == sets["id"]).select("cluster", "pivot", F.col("items").alias("p_items"))
    none = F.array().cast("array<long>")
    if covered is None:
        pivots = pivots.withColumn("before", none)
    else:  # any earlier items will do: those of one of the cluster's groups
        came, items = covered
        one = (lead.groupBy("cluster").agg(F.min("sig").alias("sig")).join(came.withColumnRenamed("cluster", "old"), "sig")
               .join(items.withColumnRenamed("cluster", "old"), "old").select("cluster", F.col("items").alias("before")))
        pivots = pivots.join(one, "cluster", "left").withColumn("before", F.coalesce("before", none))
    pivots = store(pivots.withColumn("u_items", F.array_union("p_items", "before")).drop("before"), "pivots")
    near = who.join(sets, "id").join(pivots.drop("pivot"), "cluster")
    near = store(near.select("id", "component", "cluster", "pivot", F.size("items").alias("size"), F.size("p_items").alias("p_size"),
                             F.size(F.array_intersect("items", "p_items")).alias("inter"),
                             F.array_except("items", "u_items").alias("beyond"), F.array_except("u_items", "items").alias("lost"))
                 .withColumn("n", F.size("beyond")).withColumn("l", F.size("lost")), "beside_pivot")
    to_pivot = near.filter((F.col("id") != F.col("pivot")) & similar(F.col("inter"), F.col("size"), F.col("p_size"), percent))
    close = close_pairs(near.drop("beyond"), percent)
    close = likely(close, marks, percent)
    found = store(verify(pairs.union(close).distinct(), sets, percent).union(ordered(to_pivot, "pivot", "id")).union(direct).distinct(), "links")
    # sets of one cluster that share an item beyond what is covered: a partner of a set holds at least
    # ``least`` of these, so one of the others and the first of those, in an order common to all sets
    least = F.greatest(F.lit(1), F.ceil(percent * F.col("size") / F.lit(100)) - (F.col("size") - F.col("n"))).cast("int")
    near_items = near.filter("n > 0").withColumn("first", F.slice("beyond", 1, F.col("n") - least + 1))
    items = near_items.select("id", F.explode("first").alias("item"), "cluster").select(F.xxhash64("cluster", "item").alias("sig"), "id", "cluster")
    twice = items.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("sig")
    groups = store(items.join(twice, "sig", "left_semi").distinct(), "groups")
    # a group is looked up by its signature; only those too large to compare at once need it
    large = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("cluster")).filter(F.col("n") > FEW)
    came = store(large.select("sig", "cluster"), "came_from")
    for done in (near, whole, pairs, parts):
        discard(done)
    return found, groups.drop("cluster"), (came, pivots.select("cluster", F.col("u_items").alias("items"))), sets


def across(rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of ids with one key in different components, each once."""
    other = rows.select(key, F.col("id").alias("o"), F.col("component").alias("oc"))
    return ordered(rows.select(key, "id", "component").join(other, key).filter("id < o and component <> oc"), "id", "o")


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows (id ...) with one of so many ``block`` of their group and each ``pair`` of blocks, a block
    and itself among them, that they are compared in."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (rows.withColumn("blocks", blocks.cast("int")).withColumn("block", block).withColumn("other", other)
            .withColumn("pair", F.struct(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))).drop("blocks", "other"))


def across_blocks(group: pa.Table, order: np.ndarray) -> np.ndarray:
    """Which pairs of a group's rows, in this order, are to be compared: those of different components, and
    of different blocks if there are two."""
    comps, *block = (np.array(group.column(c), np.int64)[order] for c in ("component", "block") if c in group.column_names)
    pairs = comps[:, None] != comps[None]
    if block and (block[0] != block[0][:1]).any():
        pairs &= block[0][:, None] != block[0][None]
    return pairs


def products(parts: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (part, id, component) of parts, however many items these have."""
    many = parts.join(marks.select("id", "size"), "id").groupBy("part").agg(F.sum("size").alias("items"))
    dealt = F.when(F.col("items") <= ITEMS, 1).otherwise(F.ceil(2 * F.col("items") / F.lit(ITEMS)))
    return (in_blocks(parts.join(many, "part"), dealt).select("part", "pair", "block", "id", "component").join(sets, "id")
            .groupBy("part", "pair").applyInArrow(product_links(percent), "a long, b long"))


def likely_parts(percent: int):
    """applyInArrow function: one bounded cluster (id, component, size, sketch, perhaps of two blocks) ->
    (part, id, component) of the members that may be similar to one of another component, and of
    the other block if there are two.  A part holds those that are connected by such pairs and is named by them."""

    def run(cluster: pa.Table) -> pa.Table:
        order = np.argsort(np.array(cluster.column("id"), np.int64))
        ids, comps, size = (np.array(cluster.column(c), np.int64)[order] for c in ("id", "component", "size"))
        sketches = cluster.column("sketch").take(pa.array(order)).to_pylist()
        length = np.array([len(x) for x in sketches])
        may = np.zeros((len(ids), len(ids)), bool)
        for w in np.unique(length):  # similar sets' sketches are of like lengths
            at = np.flatnonzero((length >= w) & (percent * length <= 200 * w))
            held, full = counts([sketches[i] for i in at], int(w))
            inter, step = np.zeros((len(at), len(at))), max(1, CELLS // len(at))
            for first in range(0, int(w), step):
                part, least = held[:, first:first + step], 1
                while (more := (part >= least).sum(0) > 1).any():
                    part = part[:, more]
                    has = (part >= least).astype(np.float32)
                    inter += has @ has.T
                    least += 1
            inter = np.where(full[:, None] | full[None], np.minimum(size[at][:, None], size[at][None]), inter)
            like = 100 * inter >= percent * (size[at][:, None] + size[at][None] - inter)
            own = length[at] == w
            may[np.ix_(at, at)] |= like & (own[:, None] | own[None])
        may &= across_blocks(cluster, order)
        root = np.arange(len(ids))
        while True:
            least = np.minimum(root, np.where(may, root[None], len(ids)).min(1))
            if (least == root).all():
                break
            root = least
        some = may.any(1)
        names = {r: xxhash.xxh3_64_intdigest(ids[root == r].tobytes()) - (1 << 63) for r in np.unique(root[some])}
        return pa.table({"part": pa.array([names[r] for r in root[some]], pa.int64()), "id": ids[some], "component": comps[some]})

    return run


def product_links(percent: int):
    """applyInArrow function: one bounded part (id, component, items, perhaps of two blocks) ->
    links (a, b) between different components, by the product of its incidence
    matrix with itself, some range of items and some columns at a time."""

    def run(cluster: pa.Table) -> pa.Table:
        kept("links")
        ids = np.array(cluster.column("id"), np.int64)
        lists = [c for c in cluster.column("items").chunks if len(c)]
        size = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in lists)])
        begin = np.r_[0, np.cumsum([len(c) for c in lists])].astype(np.int64)
        inter = np.zeros((len(ids), len(ids)))
        bits = max(0, int(size.sum()) // STEP).bit_length()
        for reach in range(1 << bits):  # items are hashes: so many in each part of their range
            of, item = [], []
            for c, i in zip(lists, begin, strict=False):
                flat = c.flatten().to_numpy().view(np.uint64)
                ends = (c.offsets.to_numpy() - c.offsets[0].as_py()).astype(np.int64)
                at = np.flatnonzero(flat >> np.uint64(64 - bits) == reach) if bits else np.arange(len(flat))
                of.append(i + np.searchsorted(ends, at, "right") - 1)
                item.append(flat[at])
            add_products(inter, np.concatenate(of), np.concatenate(item)) if of else None
        like = 100 * inter >= percent * (size[:, None] + size[None] - inter)
        x, y = np.nonzero(np.triu(like, 1) & across_blocks(cluster, np.arange(len(ids))))
        return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])})

    return run


def add_products(inter: np.ndarray, of: np.ndarray, item: np.ndarray) -> None:
    """Adds to ``inter`` how many of these items two sets share; row i says that set ``of[i]`` holds ``item[i]``."""
    order = np.argsort(item)
    of, item = of[order], item[order]
    new = np.r_[True, item[1:] != item[:-1]] if len(item) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    again = np.bincount(run)[run] > 1 if len(run) else new  # an item of one set only is in no intersection
    of, item = of[again], (np.cumsum(new & again) - 1)[again]
    width = int(item[-1]) + 1 if len(item) else 0
    step = max(1, min(width, CELLS // len(inter)))
    for first in range(0, width, step):
        i, j = np.searchsorted(item, [first, first + step])
        has = np.zeros((len(inter), step), np.float32)
        has[of[i:j], item[i:j] - first] = 1
        inter += has @ has.T


def close_pairs(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a cluster in different components that are similar if they
    share no item beyond the pivot: n + n' + the items that only one of them lacks
    are within the bound.  With d = n + l and u = l - n it follows that
    u' >= d - k, so each set looks only into ranges of u from there up."""
    width = 4
    limit = F.floor((100 - percent) * F.col("size") / F.lit(percent))  # with the largest partner a set can have
    here = near.select("cluster", "id", "component", "size", "n", "l", "lost", F.floor((F.col("l") - F.col("n")) / width).alias("cell"),
                       F.floor((F.col("n") + F.col("l") - limit) / width).alias("from"))
    cells = here.select("cluster", "cell").distinct()
    seeks = (here.drop("cell").join(cells, "cluster").filter(F.col("cell") >= F.col("from"))
             .select("cluster", "cell", F.col("id").alias("x"), F.col("component").alias("xc"), F.col("size").alias("xs"),
                     F.col("n").alias("xn"), F.col("l").alias("xl"), F.col("lost").alias("xlost")))
    most = bound(F.col("size"), F.col("xs"), percent)
    least = F.col("n") + F.col("xn") + F.abs(F.col("l") - F.col("xl"))
    gap = F.col("n") + F.col("xn") + F.col("l") + F.col("xl") - 2 * F.size(F.array_intersect("lost", "xlost"))
    here = here.drop("from").withColumnsRenamed({"cluster": "hc", "cell": "hcell"})
    hits = seeks.join(here, (F.col("cluster") == F.col("hc")) & (F.col("cell") == F.col("hcell")) & (F.col("id") != F.col("x"))
                      & (F.col("component") != F.col("xc")) & (least <= most) & (gap <= most))
    return ordered(hits, "x", "id")


def open_groups(rows: DataFrame) -> DataFrame:
    """(sig, n) of groups with three or more members in several components."""
    return (rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
            .filter((F.col("lo") != F.col("hi")) & (F.col("n") > 2)).select("sig", "n"))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between them."""
    if comps.count() + links.count() <= EDGES:
        return components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))
    ends = label(label(links, comps, "a", "x"), comps, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    over = components(ends)
    known = comps.select("id").union(ends.select("a")).union(ends.select("b")).distinct()
    both = label(label(known, comps, "id", "component"), over, "component", "wider")
    return store(both.select("id", F.col("wider").alias("component")).filter("id <> component"), "components")
