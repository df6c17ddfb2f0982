"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Every class has a list of near ones, first from orders along random
hyperplanes cut into small leaves, then refined: the neighbours of one vector, in either direction,
are compared with one another, and what is nearer than the last of a list enters it. A list that is
full of links (saturated) says that there are more. Such families, the components that hold one, are
enlarged to all of their members: the angle to the family's head settles most pairs by the triangle
inequality, and the others are compared exactly in bounded tiles, which pass on counts. Families whose
heads lie near enough for a link between them are compared in the same tiles.

A sample of bounded size is compared with all vectors by brute force. While its recall is short of
what is asked for, the search goes on from new orders with lists twice as long.
"""

from __future__ import annotations

import math

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored
from barloom.llm.graph import components


@dataclass(frozen=True)
class NeighbourRule:
    """Vectors link from cosine ``threshold`` on. Lists of ``neighbours``; ``orders`` cut into leaves
    of ``leaf``; ``sample`` new and as many old members of a neighbourhood are compared in a step;
    steps end when less than ``still`` of the links are new. ``tile`` vectors of a family meet at a
    time. ``audit`` vectors are compared with all, ``rounds`` times at most, until ``recall`` of their
    links is found."""

    threshold: float = 0.95
    neighbours: int = 10
    orders: int = 8
    leaf: int = 256
    sample: int = 16
    steps: int = 12
    still: float = 0.002
    tile: int = 512
    audit: int = 1024
    recall: float = 0.99
    rounds: int = 4


#: What the sums of single precision may be off by, with room.
BLUR = 1e-5
BITS = 24


def vector_rows(rows: DataFrame) -> DataFrame:
    """``vec_id, h1, h2, embedding``: the hashes tell different vectors apart. They are null for a row
    that links with nothing: without an id, without a vector, with a component that is null or not
    finite, or with zeros only."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    whole = F.col("vec_id").isNotNull() & F.coalesce(~F.exists("embedding", bad), F.lit(False))
    fit = whole & F.exists("embedding", lambda x: x != 0)
    # Adding 0.0 makes one zero of both.
    vector = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(fit, F.xxhash64(vector)).alias("h1"),
        F.when(fit, F.xxhash64(F.lit(1), vector)).alias("h2"),
        F.when(fit, vector).alias("embedding"),
    )


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``h1, h2, first, n, v, short``: one row per class of equal vectors, with its smallest id, its
    number of rows and its unit vector in double and in single precision."""
    fit = rows.where("h1 is not null")
    width = fit.agg(F.max(F.size("embedding"))).first()[0] or 0
    classes = fit.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding")
    )

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("embedding")
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, width))
            x[np.arange(width) < sizes[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
            x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "h1": batch.column("h1"), "h2": batch.column("h2"),
                    "first": batch.column("first"), "n": batch.column("n"),
                    "v": pa.array([r.tobytes() for r in x], pa.binary()),
                    "short": pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()),
                }
            )

    return classes.mapInArrow(normalise, "h1 long, h2 long, first long, n long, v binary, short binary")


def stacked(column: pa.Array | list, kind: type = np.float32) -> np.ndarray:
    """Vectors kept as bytes, one per row."""
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


PROPOSAL = "node long, nbr long, sim float"


def proposals(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"node": pa.array(node, pa.int64()), "nbr": pa.array(nbr, pa.int64()), "sim": pa.array(sim, pa.float32())}
    )


def first_neighbours(units: DataFrame, rule: NeighbourRule, seed: int) -> DataFrame:
    """The nearest half a list of each vector within its leaf of each order."""
    count = max(1, rule.neighbours // 2)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = stacked(batch.column("short"))
            for n in range(rule.orders):
                planes = np.random.default_rng([seed, n]).standard_normal((x.shape[1], BITS)).astype(np.float32)
                code = (x @ planes > 0) @ (1 << np.arange(BITS)[::-1])
                yield pa.RecordBatch.from_pydict(
                    {"tree": pa.array(np.full(len(x), n), pa.int32()), "code": pa.array(code, pa.int64()),
                     "node": batch.column("node"), "short": batch.column("short")}
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = batch.column("tree").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(trees)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                for start in range(lo, hi, rule.leaf):
                    part = batch.slice(start, min(rule.leaf, hi - start))
                    x, ids = stacked(part.column("short")), part.column("node").to_numpy()
                    if len(ids) < 2:
                        continue
                    sims = x @ x.T
                    np.fill_diagonal(sims, -2)
                    k = min(count, len(ids) - 1)
                    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    yield proposals(
                        np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sims, best, axis=1).ravel()
                    )

    spread = units.select("node", "short").mapInArrow(codes, "tree int, code long, node long, short binary")
    order = ["tree", "code", "node"]
    return spread.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(leaves, PROPOSAL)


def best_of(found: DataFrame, old: DataFrame | None, count: int) -> DataFrame:
    """``node, nbr, sim, fresh``: the nearest of the old lists and of what was found."""
    every = found.withColumn("fresh", F.lit(True))
    if old is not None:
        every = every.unionByName(old.withColumn("fresh", F.lit(False)))
    each = every.repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.every("fresh").alias("fresh"))
    near = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    return each.withColumn("place", F.row_number().over(near)).where(F.col("place") <= count).drop("place")


def neighbours_of_neighbours(lists: DataFrame, units: DataFrame, rule: NeighbourRule, count: int, step: int) -> DataFrame:
    """Pairs that share a neighbour, at least one of the two links being new, where they are nearer
    than the last entry of a list. A neighbourhood is a sample in each step, another one each time."""
    turned = lists.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "fresh")
    around = lists.select("node", "nbr", "fresh").unionByName(turned)
    around = around.repartition("node").groupBy("node", "nbr").agg(F.bool_or("fresh").alias("fresh"))
    some = Window.partitionBy("node", "fresh").orderBy(F.xxhash64(F.lit(step), "nbr", "node"))
    around = around.withColumn("place", F.row_number().over(some)).where(F.col("place") <= rule.sample)
    last = lists.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("sim").alias("least"))
    last = last.select(F.col("node").alias("nbr"), F.when(F.col("size") >= count, F.col("least")).otherwise(-2.0).alias("least"))
    seen = units.select(F.col("node").alias("nbr"), "short").join(last, "nbr", "left")
    met = around.join(seen, "nbr").groupBy("node").agg(
        F.collect_list(F.struct("nbr", "fresh", "short", F.coalesce("least", F.lit(-2.0)).cast("float").alias("least"))).alias("met")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("met")
            if not len(lists):
                continue
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x, ids = stacked(flat.field("short")), flat.field("nbr").to_numpy()
            fresh, least = flat.field("fresh").to_numpy(zero_copy_only=False), flat.field("least").to_numpy()
            found = []
            for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
                own = slice(end - size, end)
                sims = x[own] @ x[own].T
                np.fill_diagonal(sims, -3)
                good = (sims > least[own][:, None]) & (fresh[own][:, None] | fresh[own])
                a, b = np.nonzero(good)
                found.append((ids[own][a], ids[own][b], sims[a, b]))
            yield proposals(*[np.concatenate(c) for c in zip(*found)])

    return met.select("met").mapInArrow(compare, PROPOSAL)


def neighbour_lists(units: DataFrame, rule: NeighbourRule, count: int, seed: int, old: DataFrame | None = None) -> DataFrame:
    """Lists of the ``count`` nearest, refined until next to no link is new. Old lists, which were
    shorter, are new to the search: what their neighbourhoods had no place for is tried again."""
    lists = best_of(first_neighbours(units, rule, seed), old, count)
    lists = stored(lists.withColumn("fresh", F.lit(True)))
    limit = rule.threshold - BLUR
    for step in range(rule.steps):
        found = neighbours_of_neighbours(lists, units, rule, count, step)
        lists = stored(best_of(found, lists.drop("fresh"), count))
        links = lists.where(F.col("sim") >= limit).agg(
            F.count(F.lit(1)).alias("links"), F.count_if("fresh").alias("fresh")
        ).first()
        if links.fresh <= rule.still * links.links:
            break
    return lists


LINK = "a long, b long, sim double"


def exact_links(lists: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b) of all listed pairs whose cosine in double precision reaches the threshold."""
    near = lists.where(F.col("sim") >= threshold - BLUR)
    pairs = near.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(units.select(F.col("node").alias(end), F.col("v").alias(f"v_{end}")), end)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (stacked(batch.column(c), np.float64) for c in ("v_a", "v_b"))
                sims = np.einsum("ij,ij->i", x, y)
                yield pa.RecordBatch.from_pydict(
                    {"a": batch.column("a"), "b": batch.column("b"), "sim": pa.array(sims, pa.float64())}
                )

    return pairs.mapInArrow(product, LINK).where(F.col("sim") >= threshold).select("a", "b")


def angles(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Members with the angle to the head of their family."""
    rows = members.join(heads.select("family", F.col("v").alias("head_v")), "family")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (stacked(batch.column(c), np.float64) for c in ("v", "head_v"))
                # By the distance, which keeps its digits where the cosine is close to 1.
                angle = 2 * np.arcsin(np.minimum(1.0, np.linalg.norm(x - y, axis=1) / 2))
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(c) for c in ("family", "node", "n", "v")} | {"angle": pa.array(angle, pa.float64())}
                )

    return rows.select("family", "node", "n", "v", "head_v").mapInArrow(
        measure, "family long, node long, n long, v binary, angle double"
    )


COUNTED = "node long, links long, other long"


def tile_counts(threshold: float):
    def of_cell(rows: pa.Table) -> pa.Table:
        """Links between the two sides of a cell, counted for each vector; ``other`` is one vector that
        it links with. A cell of one tile with itself has one side."""
        left, right = (rows.filter(pa.compute.equal(rows["side"], k)) for k in (0, 1))
        cell = rows.select(["f", "g", "x", "y"]).slice(0, 1).to_pylist()[0]
        if (cell["f"], cell["x"]) == (cell["g"], cell["y"]):
            right = left
        out = {"node": [], "links": [], "other": []}
        if left.num_rows:
            x, y = (stacked(t["v"].to_pylist(), np.float64) for t in (left, right))
            linked = x @ y.T >= threshold
            if left is right:
                np.fill_diagonal(linked, False)
            for own, far, hits in ((left, right, linked), (right, left, linked.T))[: 1 if left is right else 2]:
                some = hits.any(axis=1)
                out["node"].append(own["node"].to_numpy()[some])
                out["links"].append((hits @ far["n"].to_numpy())[some])
                out["other"].append(far["node"].to_numpy()[hits.argmax(axis=1)][some])
        return pa.table({c: pa.array(np.concatenate([np.empty(0, dtype=np.int64), *v]), pa.int64()) for c, v in out.items()})

    return of_cell


def tiled(rows: DataFrame, families: DataFrame, pairs: DataFrame, rule: NeighbourRule) -> DataFrame:
    """Link counts from the comparison of the families of each pair (``f``, ``g``), a family with
    itself included, in cells of ``tile`` vectors on either side. ``families`` has ``family, tiles``."""
    tile = F.pmod(F.xxhash64("node"), F.col("tiles"))
    own = rows.join(families, "family").select("family", "node", "n", "v", tile.alias("tile"))
    tiles = [families.select(F.col("family").alias(c), F.col("tiles").alias(f"tiles_{c}")) for c in ("f", "g")]
    wide = pairs.join(tiles[0], "f").join(tiles[1], "g")
    copies = []
    for side, (mine, far) in enumerate((("f", "g"), ("g", "f"))):
        mate = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"tiles_{far}") - 1)).alias("mate")
        mates = wide.select(F.col(mine).alias("family"), "f", "g", mate)
        met = own.join(mates, "family")
        places = ("tile", "mate") if side == 0 else ("mate", "tile")
        x, y = (F.col(c).alias(name) for c, name in zip(places, "xy"))
        met = met.select("f", "g", x, y, F.lit(side).alias("side"), "node", "n", "v")
        # A family with itself: every two tiles meet once, a tile with itself has one side.
        once = F.col("x") <= F.col("y") if side == 0 else F.col("x") < F.col("y")
        copies.append(met.where((F.col("f") != F.col("g")) | once))
    cells = copies[0].unionByName(copies[1]).groupBy("f", "g", "x", "y")
    counter = tile_counts(rule.threshold)
    return cells.applyInArrow(lambda t: counter(t), COUNTED)


def family_links(units: DataFrame, family: DataFrame, rule: NeighbourRule, seed: int) -> tuple[DataFrame, DataFrame]:
    """``node, links`` of every member of the families (``node, family``), and the links ``a, b``
    between families."""
    reach = math.acos(rule.threshold)
    members = stored(units.select("node", "n", "v", "short").join(family, "node"))
    # The head is the member nearest to the mean of a bounded number of members.
    some = Window.partitionBy("family").orderBy(F.xxhash64("node"))
    sample = members.withColumn("place", F.row_number().over(some)).where(F.col("place") <= 64)

    def head(rows: pa.Table) -> pa.Table:
        x = stacked(rows["v"].to_pylist(), np.float64)
        best = int(np.argmax(x @ x.sum(axis=0)))
        return rows.select(["family", "node", "v", "short"]).slice(best, 1)

    heads = sample.select("family", "node", "v", "short").groupBy("family").applyInArrow(
        head, "family long, node long, v binary, short binary"
    )
    heads = stored(heads)
    rows = stored(angles(members, heads))
    sums = stored(
        rows.groupBy("family").agg(
            F.max("angle").alias("radius"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("size")
        )
    )
    # Members within ``reach`` of the farthest one link with all; only the others are compared.
    rows = rows.join(sums, "family").withColumn("inner", F.col("angle") + F.col("radius") < reach - 1e-9)
    rows = stored(rows)
    certain = rows.groupBy("family").agg(
        F.sum(F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("sure"),
        F.count_if(~F.col("inner")).alias("outer"),
    )
    tiles = F.ceil(F.greatest(F.col("outer"), F.lit(1)) / rule.tile).cast("long")
    own = certain.where("outer > 0").select("family", tiles.alias("tiles"))
    twice = own.select(F.col("family").alias("f"), F.col("family").alias("g"))
    inside = tiled(rows.where(~F.col("inner")), own, twice, rule).select("node", "links")
    base = rows.join(certain, "family").select(
        "node", F.when(F.col("inner"), F.col("total") - F.col("n")).otherwise(F.col("sure")).alias("links")
    )
    # Families that may link: their heads are no farther apart than the threshold and both radii.
    across = None
    if sums.limit(2).count() > 1:
        widest = sums.agg(F.max("radius")).first()[0]
        lower = math.cos(min(math.pi, reach + 2 * widest))
        many = replace(rule, threshold=lower)
        near = neighbour_lists(heads.select("node", "short"), many, 4 * rule.neighbours, seed)
        ends = heads.join(sums, "family").select("node", "family", "radius")
        near = near.groupBy(F.least("node", "nbr").alias("f"), F.greatest("node", "nbr").alias("g")).agg(
            F.max("sim").cast("double").alias("sim")
        )
        for end in ("f", "g"):
            names = [F.col("node").alias(end), F.col("family").alias(f"family_{end}"), F.col("radius").alias(f"radius_{end}")]
            near = near.join(ends.select(*names), end)
        # In single precision a small angle is off by the root of what its cosine is off by.
        apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "sim")))
        close = apart <= F.col("radius_f") + F.col("radius_g") + reach + 0.01
        pairs = stored(near.where(close).select(F.col("family_f").alias("f"), F.col("family_g").alias("g")))
        if pairs.limit(1).count():
            all_tiles = sums.select("family", F.ceil(F.col("size") / rule.tile).cast("long").alias("tiles"))
            across = stored(tiled(rows, all_tiles, pairs, rule))
    counts = base.unionByName(inside)
    if across is not None:
        counts = counts.unionByName(across.select("node", "links"))
    links = counts.groupBy("node").agg(F.sum("links").alias("links"))
    if across is None:
        none = units.sparkSession.createDataFrame([], "a long, b long")
        return links, none
    return links, across.select(F.col("node").alias("a"), F.col("other").alias("b"))


def linked_nodes(units: DataFrame, lists: DataFrame, rule: NeighbourRule, count: int, seed: int) -> DataFrame:
    """``node, links, component`` of every class that links with another one."""
    links = stored(exact_links(lists, units, rule.threshold))
    found = components(links)
    full = lists.where(F.col("sim") >= rule.threshold - BLUR).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    full = full.where(F.col("size") >= count).select("node")
    crowded = stored(found.join(full, "node").select(F.col("component").alias("family")).distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = both.join(units.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    found = found.join(listed, "node")
    if not crowded.limit(1).count():
        return stored(found)
    family = stored(found.join(crowded, found["component"] == crowded["family"]).select("node", "family"))
    counted, across = family_links(units, family, rule, seed)
    found = found.join(counted.withColumnRenamed("links", "more"), "node", "left")
    found = stored(found.select("node", "component", F.coalesce("more", "links").alias("links")))
    if not across.limit(1).count():
        return found
    names = [found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("a", "b")]
    ends = across.join(names[0], "a").join(names[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    merged = components(ends).select(F.col("node").alias("component"), F.col("component").alias("top"))
    found = found.join(merged, "component", "left")
    return stored(found.select("node", "links", F.coalesce("top", "component").alias("component")))


def audited(units: DataFrame, found: DataFrame, rule: NeighbourRule) -> tuple[int, int]:
    """Links of a sample, ``audit`` vectors at most: how many were found, and how many there are by
    comparison with all vectors."""
    sample = units.select("node", "v").orderBy(F.xxhash64("node")).limit(rule.audit).collect()
    if not sample:
        return 0, 0
    ids, x = np.array([r.node for r in sample]), np.frombuffer(b"".join(r.v for r in sample)).reshape(len(sample), -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                y, names = stacked(batch.column("v"), np.float64), batch.column("node").to_numpy()
                linked = (x @ y.T >= rule.threshold) & (ids[:, None] != names)
                total += linked @ batch.column("n").to_numpy()
        some = total > 0
        yield pa.RecordBatch.from_pydict({"node": pa.array(ids[some], pa.int64()), "true": pa.array(total[some], pa.int64())})

    true = units.select("node", "n", "v").mapInArrow(count, "node long, true long")
    true = true.groupBy("node").agg(F.sum("true").alias("true"))
    sums = true.join(found, "node", "left").agg(F.sum("links"), F.sum("true")).first()
    return sums[0] or 0, sums[1] or 0


def near_duplicates(rows: DataFrame, rule: NeighbourRule = NeighbourRule()) -> DataFrame:
    """Per row of ``vec_id, embedding``: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows whose vectors have a cosine of ``threshold`` or more; of the
    links found every one is confirmed in double precision. The component is named by its smallest
    id, and the row of that id is kept. Rows are vectors of their own even if they share an id or are
    repeated; repeated rows of the kept id are all kept. A row without an id, or whose vector is
    null, zero, empty or not finite throughout, links with nothing and is kept. Vectors of different
    lengths are compared as if the shorter ended in zeros. An empty table gives no rows; other
    columns are not read.
    """
    every = stored(vector_rows(rows))
    # Numbers of their own, for different vectors may share an id.
    classes = stored(unit_vectors(every).withColumn("node", F.monotonically_increasing_id()))
    units = classes.select("node", "n", "v", "short")
    lists, count, found = None, rule.neighbours, None
    for turn in range(rule.rounds):
        lists = neighbour_lists(units, rule, count, turn, None if lists is None else lists.drop("fresh"))
        found = linked_nodes(units, lists, rule, count, turn)
        seen, true = audited(units, found, rule)
        if seen >= rule.recall * true:
            break
        count *= 2
    firsts = classes.select("h1", "h2", "node", "n", "first")
    names = found.join(firsts, "node").groupBy("component").agg(F.min("first").alias("name"))
    of_class = firsts.join(found.join(names, "component").select("node", "links", "name"), "node", "left").select(
        "h1",
        "h2",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("name", "first").alias("component_id"),
    )
    out = every.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
