"""Near-duplicate embeddings: a robust-pruned flat graph on overlapping clusters, searched by range.

Vectors that lie close together are gathered into balls first, so a group of
near copies, however large, is a few points of the graph and its links are
counted by geometry: in a ball every pair links. The graph is built for each
shard of an overlapping clustering, adjacency lists of a point are united over
its shards, and every ball searches its nearest shards from their medoids. A
search widens as long as it finds points in range, within a shard and into the
other shards that hold them. A bounded sample is compared with all points
(`audit`); below the wanted recall the search is repeated with twice the shards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofcast.llm.common import cut
from proofcast.llm.graph import components

#: Out-degree and slack of the robust pruning; points a search keeps open.
DEGREE, ALPHA, BEAM = 32, 1.2, 32
#: Points a shard has on average and at most, shards that hold a point, shards first asked.
SHARD, LARGEST, OVERLAP, PROBES = 512, 1024, 2, 4
#: Vectors gathered into balls together, searches of a shard that run together, searches in one array.
BLOCK, VISITS, STEP = 1024, 4096, 256
#: Centres at most, vectors in their sample for each of them, nearest centres kept with a point.
CENTRES, SAMPLE, WIDEST = 1 << 14, 8, 16
#: Balls that the audit compares with all others, and the recall it asks for.
AUDITED, RECALL = 128, 0.98
#: Angles (radians) within this of a border are decided by the members' own cosines.
MARGIN = 1e-6


def unit(values: object) -> tuple[bytes, np.ndarray] | None:
    """A digest of the vector and the vector at length one; None where it can't link."""
    if values is None or len(values) == 0:
        return None
    v = np.array(values, dtype=np.float64) + 0.0
    largest = np.abs(v).max()
    if not np.isfinite(largest) or largest == 0:
        return None
    scaled = v / largest
    return hashlib.blake2b(v.tobytes(), digest_size=16).digest(), scaled / np.linalg.norm(scaled)


def _unit(vector: Column) -> Column:
    @F.pandas_udf("key binary, unit array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [unit(v) or (None, None) for v in batch]
            yield pd.DataFrame({"key": pd.Series([f[0] for f in found], dtype=object), "unit": pd.Series([f[1] for f in found], dtype=object)})

    return of(vector)


def _matrix(units: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of one width: shorter vectors end in zeros."""
    width = width or max(map(len, units), default=1)
    out = np.zeros((len(units), width))
    for row, u in zip(out, units, strict=True):
        row[: len(u)] = u[:width]
    return out


def _lengths(units: pd.Series) -> np.ndarray:
    return np.fromiter(map(len, units), np.int64, len(units))


def fit_centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; the first k vectors of the sample are the start."""
    centres = sample[:k].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _nearest(spark, centres: np.ndarray, most: int) -> Column:
    """The `most` nearest centres of a point, nearest first. The table of centres has a fixed bound (CENTRES)."""
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def of(batch: pd.Series) -> pd.Series:
        table = shared.value
        out: list = []
        for i in range(0, len(batch), 1024):
            sims = _matrix(batch[i : i + 1024], table.shape[1]) @ table.T
            out += list(np.argsort(-sims, axis=1, kind="stable")[:, :most].astype(np.int32))
        return pd.Series(out, dtype=object)

    return of(F.col("unit"))


def gather(points: np.ndarray, lengths: np.ndarray, nodes: np.ndarray, reach: float) -> np.ndarray:
    """For every point the index of its ball's centre, at most `reach` (radians) away.

    Points with most neighbours are centres first, ties by node.
    """
    near = (points @ points.T >= math.cos(reach)) & (lengths[:, None] == lengths)
    np.fill_diagonal(near, True)
    owner = np.full(len(points), -1)
    for i in np.lexsort((nodes, -near.sum(1))):
        if owner[i] < 0:
            owner[near[i] & (owner < 0)] = i
    return owner


def robust_prune(dist: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every point (rows, -1 where there are fewer).

    The nearest candidate is taken and removes all candidates to which it is
    alpha times nearer than the point itself; again until none is left.
    """
    n = len(dist)
    left = dist.copy()
    np.fill_diagonal(left, np.inf)
    rows, chosen = np.arange(n), np.full((n, max(1, min(degree, n - 1))), -1)
    for k in range(chosen.shape[1]):
        best = left.argmin(1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        chosen[some, k] = best[some]
        left[(alpha * dist[best] <= dist) | ~some[:, None]] = np.inf
        left[rows, best] = np.inf
    return chosen


def flat_graph(points: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Medoid and adjacency lists: pruned links both ways, and every point can be reached from the medoid."""
    n = len(points)
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * points @ points.T))
    start = int(dist.sum(1).argmin())
    linked = np.zeros((n, n), bool)
    chosen = robust_prune(dist)
    rows, cols = np.nonzero(chosen >= 0)
    linked[rows, chosen[rows, cols]] = True
    back = linked.T & ~linked
    back[:, back.sum(0) == 0] = False
    room = linked.sum(1) + back.sum(1) <= 2 * DEGREE
    linked[room] |= back[room]
    seen = np.zeros(n, bool)
    frontier = np.zeros(n, bool)
    frontier[start] = True
    while True:
        while frontier.any():
            seen |= frontier
            frontier = linked[frontier].any(0) & ~seen
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return start, [np.flatnonzero(r) for r in linked]
        known = np.flatnonzero(seen)
        a, b = np.unravel_index(dist[np.ix_(known, lost)].argmin(), (len(known), len(lost)))
        linked[known[a], lost[b]] = True
        frontier[lost[b]] = True


def range_search(points: np.ndarray, radii: np.ndarray, near: np.ndarray, starts: np.ndarray, asked: np.ndarray, reach: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) of all points in range that the walks from `starts` come to.

    A point is in range within `reach` of the query and its own radius. Each query
    opens the best of its `beam` nearest points, and every point in range whatever
    their number, until none is left to open.
    """
    q, n = len(asked), len(points)
    sims = np.full((q, n), -np.inf)
    seen, shut, inside = np.zeros((q, n), bool), np.zeros((q, n), bool), np.zeros((q, n), bool)

    def visit(flat: np.ndarray) -> None:
        rows, cols = np.divmod(flat, n)
        s = np.einsum("ij,ij->i", asked[rows], points[cols])
        seen[rows, cols], sims[rows, cols] = True, s
        inside[rows, cols] = s >= np.cos(np.minimum(np.pi, reach[rows] + radii[cols]))

    visit((np.arange(q)[:, None] * n + starts[None, :]).ravel())
    rows = np.arange(q)
    while len(rows):
        s = sims[rows]
        least = np.partition(s, n - beam, axis=1)[:, n - beam] if n > beam else np.full(len(rows), -np.inf)
        todo = seen[rows] & ~shut[rows] & (inside[rows] | (s >= least[:, None]))
        some = todo.any(1)
        rows, s, todo = rows[some], s[some], todo[some]
        if not len(rows):
            break
        pick = todo & inside[rows]
        pick[np.arange(len(rows)), np.where(todo, s, -np.inf).argmax(1)] = True
        r, c = np.nonzero(pick)
        r = rows[r]
        shut[r, c] = True
        flat = (r[:, None] * n + near[c])[near[c] >= 0]
        flat = np.unique(flat)
        visit(flat[~seen.ravel()[flat]])
    r, c = np.nonzero(inside)
    return r, c, sims[r, c]


def _sizes(df: DataFrame, key: str | list[str], most: int, name: str) -> DataFrame:
    """In how many parts the rows of a key are to be dealt; one row for each key of a bounded clustering."""
    return df.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def _points(nodes: DataFrame, reach: float) -> DataFrame:
    """Nodes with the ball they belong to; a hot cell is dealt into blocks by hash."""
    sizes = _sizes(nodes.select(F.col("cells")[0].alias("home")), "home", BLOCK, "parts")
    dealt = (
        nodes.withColumn("home", F.col("cells")[0])
        .join(F.broadcast(sizes), "home")
        .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    )

    def balls(block: pd.DataFrame) -> pd.DataFrame:
        points, lengths = _matrix(block["unit"]), _lengths(block["unit"])
        owner = gather(points, lengths, block["node"].to_numpy(), reach)
        cosine = np.einsum("ij,ij->i", points, points[owner])
        angle = np.where(owner == np.arange(len(owner)), 0.0, np.arccos(np.clip(cosine, -1, 1)) + MARGIN / 4)
        radius, weight = np.zeros(len(owner)), np.zeros(len(owner), np.int64)
        np.maximum.at(radius, owner, angle)
        np.add.at(weight, owner, block["copies"].to_numpy())
        block["ball"] = block["node"].to_numpy()[owner]
        block["radius"], block["weight"] = radius[owner], weight[owner]
        return block[["node", "key", "unit", "cells", "copies", "first_id", "ball", "radius", "weight"]]

    schema = "node bigint, key binary, unit array<double>, cells array<int>, copies bigint, first_id bigint, ball bigint, radius double, weight bigint"
    return cut(dealt.groupBy("home", "part").applyInPandas(balls, schema), "balls")


def _index(points: DataFrame) -> DataFrame:
    """Residents of every shard (cell, sub) with their united adjacency list and all shards that hold them."""
    resident = points.select("ball", "unit", "radius", F.explode(F.slice("cells", 1, OVERLAP)).alias("cell"))
    sizes = _sizes(resident, "cell", LARGEST, "subs")
    resident = resident.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("ball"), F.col("subs")).cast("int"))

    def graph(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("ball", ignore_index=True)
        start, near = flat_graph(_matrix(shard["unit"]))
        balls = shard["ball"].to_numpy()
        shard["near"] = pd.Series([balls[x] for x in near], dtype=object)
        shard["start"] = np.arange(len(shard)) == start
        return shard[["cell", "sub", "ball", "unit", "radius", "near", "start"]]

    schema = "cell int, sub int, ball bigint, unit array<double>, radius double, near array<bigint>, start boolean"
    built = cut(resident.groupBy("cell", "sub").applyInPandas(graph, schema), "graphs")
    united = built.groupBy("ball").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list(F.struct("cell", "sub")).alias("homes")
    )
    return cut(built.drop("near").join(united, "ball"), "index")


def _walks(index: DataFrame, visits: DataFrame, theta: float, beam: int) -> DataFrame:
    """(u, v, cosine, whole) of balls that may hold links, and (u, null, null, null, cell, sub): shards to ask next."""
    sizes = cut(_sizes(visits, ["cell", "sub"], VISITS, "parts"), "walk-sizes")
    copies = sizes.select("cell", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = index.join(copies, ["cell", "sub"])
    dealt = visits.join(sizes.withColumnRenamed("parts", "of"), ["cell", "sub"])
    right = dealt.select("u", "unit", "radius", "cell", "sub", F.pmod(F.xxhash64("u"), F.col("of")).cast("int").alias("part"))

    def walk(key: tuple, shard: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        columns = ["u", "v", "cosine", "whole", "cell", "sub"]
        if not len(shard) or not len(asks):
            return pd.DataFrame({c: [] for c in columns})
        shard, asks = shard.sort_values("ball", ignore_index=True), asks.sort_values("u", ignore_index=True)
        balls, radii = shard["ball"].to_numpy(), shard["radius"].to_numpy()
        lengths, asked_lengths = _lengths(shard["unit"]), _lengths(asks["unit"])
        width = max(lengths.max(), asked_lengths.max())
        points, asked = _matrix(shard["unit"], width), _matrix(asks["unit"], width)
        lists = [np.searchsorted(balls, x[np.isin(x, balls)]) for x in shard["near"]]
        near = np.full((len(balls), max(1, max(map(len, lists)))), -1)
        for row, x in zip(near, lists, strict=True):
            row[: len(x)] = x
        starts, names, own = np.flatnonzero(shard["start"]), asks["u"].to_numpy(), asks["radius"].to_numpy()
        homes = [[(h["cell"], h["sub"]) for h in hs if (h["cell"], h["sub"]) != tuple(key[:2])] for hs in shard["homes"]]
        out, onward = [], set()
        for i in range(0, len(asked), STEP):
            r, c, cosine = range_search(points, radii, near, starts, asked[i : i + STEP], theta + MARGIN + own[i : i + STEP], beam)
            r = r + i
            other = (names[r] != balls[c]) & (asked_lengths[r] == lengths[c])
            r, c, cosine = r[other], c[other], cosine[other]
            both = own[r] + radii[c]
            # two single vectors are decided by their cosine alone, in `_linked`
            whole = (both > 0) & (np.arccos(np.clip(cosine, -1, 1)) + both <= theta - MARGIN)
            out.append(pd.DataFrame({"u": names[r], "v": balls[c], "cosine": cosine, "whole": np.where(both > 0, whole.astype(int), -1)}))
            onward |= {(names[a], *h) for a, b in zip(r, c, strict=True) for h in homes[b]}
        far = pd.DataFrame(sorted(onward), columns=["u", "cell", "sub"])
        return pd.concat([*out, far], ignore_index=True).reindex(columns=columns)

    schema = "u bigint, v bigint, cosine double, whole int, cell int, sub int"
    keys = ["cell", "sub", "part"]
    return cut(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(walk, schema), "walks")


def _found(points: DataFrame, index: DataFrame, probes: int, theta: float, beam: int) -> DataFrame:
    """Pairs u < v of balls in range, each once, found from either side."""
    subs = index.groupBy("cell").agg(F.max("sub").alias("last"))
    cells = F.slice("cells", 1, probes) if probes <= WIDEST else F.transform("cells", lambda c: c)
    visits = points.select(F.col("ball").alias("u"), "unit", "radius", F.explode(cells).alias("cell"))
    if probes > WIDEST:  # every shard
        visits = points.select(F.col("ball").alias("u"), "unit", "radius", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("cell"))
    visits = visits.join(F.broadcast(subs), "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    asked = cut(visits.select("u", "cell", "sub"), "asked")
    rounds = []
    while True:
        walks = _walks(index, visits, theta, beam)
        rounds.append(walks.where("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cosine", "whole"))
        onward = cut(walks.where("cell is not null").select("u", "cell", "sub").distinct().join(asked, ["u", "cell", "sub"], "left_anti"), "onward")
        if onward.isEmpty():
            break
        visits = onward.join(points.select(F.col("ball").alias("u"), "unit", "radius"), "u")
        asked = cut(asked.union(onward), "asked")
    pairs = rounds[0]
    for more in rounds[1:]:
        pairs = pairs.union(more)
    return cut(pairs.groupBy("u", "v").agg(F.max("cosine").alias("cosine"), F.max("whole").alias("whole")), "pairs")


def audit(points: DataFrame, pairs: DataFrame, theta: float, most: int = AUDITED) -> float:
    """Share of the pairs in range that `pairs` has, for about `most` balls drawn by hash, against all balls."""
    n = points.count()
    drawn = points.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit((1 << 40) * min(1.0, most / max(n, 1)))).select("ball", "unit", "radius").limit(4 * most).toPandas()
    if not len(drawn):
        return 1.0

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, radii, lengths = drawn["ball"].to_numpy(), drawn["radius"].to_numpy(), _lengths(drawn["unit"])
        for batch in batches:
            mine = _lengths(batch["unit"])
            width = max(lengths.max(), mine.max())
            sims = _matrix(drawn["unit"], width) @ _matrix(batch["unit"], width).T
            limit = np.cos(np.minimum(np.pi, theta + radii[:, None] + batch["radius"].to_numpy()[None, :]))
            r, c = np.nonzero((sims >= limit) & (lengths[:, None] == mine) & (names[:, None] != batch["ball"].to_numpy()))
            yield pd.DataFrame({"a": names[r], "b": batch["ball"].to_numpy()[c]})

    truth = points.select("ball", "unit", "radius").mapInPandas(compare, "a bigint, b bigint")
    truth = truth.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    got = truth.join(pairs.select("u", "v", F.lit(1).alias("hit")), ["u", "v"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return got["hits"] / got["n"] if got["n"] else 1.0


def _linked(members: DataFrame, pairs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Balls that link, as pairs with the flag `whole`, and members' links to members of partly linked balls (node, links)."""
    doubtful = pairs.where("whole = 0").select("u", "v")
    sides = doubtful.select("u", "v", F.explode(F.array("u", "v")).alias("ball"))
    both = sides.join(members.select("ball", "node", "unit", "copies"), "ball")

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        a, b = pair[pair["ball"] == pair["u"]], pair[pair["ball"] == pair["v"]]
        hits = _matrix(a["unit"]) @ _matrix(b["unit"]).T >= least
        links = np.concatenate([hits @ b["copies"].to_numpy(), a["copies"].to_numpy() @ hits])
        out = pd.DataFrame({"u": pair["u"].iloc[0], "v": pair["v"].iloc[0], "node": [*a["node"], *b["node"]], "links": links})
        return out[out["links"] > 0]

    parts = cut(both.groupBy("u", "v").applyInPandas(compare, "u bigint, v bigint, node bigint, links bigint"), "parts")
    whole = pairs.where((F.col("whole") == 1) | ((F.col("whole") == -1) & (F.col("cosine") >= least))).select("u", "v", F.lit(True).alias("whole"))
    some = parts.select("u", "v", F.lit(False).alias("whole")).distinct()
    return cut(whole.union(some), "linked"), parts.groupBy("node").agg(F.sum("links").alias("part_links"))


def embedding_classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95, probes: int = PROBES, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of the table.

    Two rows link if the cosine of their vectors, in double precision, is at
    least `least`; links below it are never made. n_links counts other rows,
    copies included. component_id is the smallest vec_id that links reach. Vectors
    that are null, empty, zero or hold a null or a component that is not finite
    link with nothing and are their own component; vectors of different lengths
    never link. A null vec_id stays null, names no component unless all its members
    lack one, and is kept only then. Repeated rows link as copies and give repeated
    rows; an empty table gives none; other columns are not read.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    spark, theta = vectors.sparkSession, math.acos(least)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), _unit(F.col(f"`{embedding}`").cast("array<double>")).alias("r"))
    rows = cut(rows.select("vec_id", "r.*"), "units")
    nodes = rows.where("key is not null").groupBy("key").agg(F.any_value("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    k = max(1, min(CENTRES, math.ceil(n * OVERLAP / SHARD)))
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit((1 << 40) * min(1.0, SAMPLE * k / max(n, 1)))
    sample = nodes.where(share).select("key", "unit").limit(2 * SAMPLE * k).toPandas().sort_values("key")
    k = max(1, min(k, len(sample)))
    centres = fit_centres(_matrix(sample["unit"]), k).astype(np.float32) if len(sample) else np.zeros((1, 1), np.float32)
    nodes = nodes.withColumn("cells", _nearest(spark, centres, min(k, WIDEST)))

    members = _points(nodes, theta / 2 - MARGIN)
    points = cut(members.where("node = ball").select("ball", "key", "unit", "cells", "radius", "weight"), "points")
    index = _index(points)
    while True:
        pairs = _found(points, index, min(probes, k), theta, beam)
        if probes >= k or audit(points, pairs, theta) >= recall:
            break
        probes = 2 * probes if 2 * probes <= WIDEST else k

    linked, parts = _linked(members, pairs, least)
    weights = points.select(F.col("ball").alias("other"), "weight")
    ways = linked.where("whole").select(F.explode(F.array(F.struct(F.col("u").alias("ball"), F.col("v").alias("other")), F.struct(F.col("v").alias("ball"), F.col("u").alias("other")))).alias("w")).select("w.*")
    beyond = cut(ways.join(weights, "other").groupBy("ball").agg(F.sum("weight").alias("ball_links")), "ball-links")
    roots = cut(components(linked.select("u", "v")), "roots")
    least_of = members.groupBy("ball").agg(F.min("first_id").alias("first_id")).join(roots, F.col("ball") == F.col("node"), "left")
    least_of = cut(least_of.select("ball", "first_id", F.coalesce("root", "ball").alias("root")), "rooted")
    named = cut(least_of.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    by_ball = cut(least_of.join(named, "root").join(beyond, "ball", "left").select("ball", "component_id", "ball_links"), "by-ball")
    info = members.select("key", "node", "ball", "weight").join(by_ball, "ball").join(parts, "node", "left")
    links = F.col("weight") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("part_links", F.lit(0))
    info = cut(info.select("key", links.alias("n_links"), "component_id"), "info")
    named_rows = rows.select("vec_id", "key").join(info, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return named_rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
