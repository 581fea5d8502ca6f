"""Near-duplicate vectors through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickertide.llm.components import connected_components
from tickertide.llm.tables import small, stage

BLOCK = 4096  # vectors of one side that a task holds against each other
SAMPLE = 20_000  # vectors that the codebooks are fitted on
PROBES = 2_000  # of them, queries against all points that the number of visited cells is learned from
MADE = 2_000  # made partners of either kind, at least
LEAST_CELLS = 16  # visited whatever the probes say


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Codewords by Lloyd's rounds from evenly spread starting rows."""
    unique = np.unique(x, axis=0)
    k = min(k, len(unique))
    centers = unique[np.linspace(0, len(unique) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centers).argmin(1)
        count = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, column, k) for column in x.T], 1)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1), 0)


def multi_sequence(first: np.ndarray, second: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """The ``cells`` pairs of codewords nearest to a query, nearest first.

    ``first`` and ``second`` are the query's distances to the codewords of either half. A
    pair enters the heap once both of its predecessors have been visited.
    """
    order = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    one, two = first[order[0]], second[order[1]]
    heap, seen, out = [(one[0] + two[0], 0, 0)], set(), []
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        seen.add((i, j))
        out.append((int(order[0][i]), int(order[1][j])))
        if i + 1 < len(one) and (not j or (i + 1, j - 1) in seen):
            heapq.heappush(heap, (one[i + 1] + two[j], i + 1, j))
        if j + 1 < len(two) and (not i or (i - 1, j + 1) in seen):
            heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
    return out


def _rows_by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in a list column without nulls: the rows, and their vectors."""
    lengths = column.value_lengths().to_numpy()
    flat, starts = column.flatten().to_numpy(), np.cumsum(lengths) - lengths
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows, neither zero nor infinite, scaled to length 1 in double precision.

    A power of two brings each row near 1 first, so that no square leaves the range of doubles.
    """
    x = vectors.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


class Index:
    """Codebooks of both halves, and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, codewords: int):
        self.half = sample.shape[1] // 2
        self.books = _kmeans(sample[:, : self.half], codewords), _kmeans(sample[:, self.half :], codewords)
        self.everything = len(self.books[0]) * len(self.books[1])
        self.cells = self.everything

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(x)
        return one.argmin(1) * len(self.books[1]) + two.argmin(1)

    def visits(self, x: np.ndarray, cells: int) -> list[list[int]]:
        one, two = self.distances(x)
        return [[i * len(self.books[1]) + j for i, j in multi_sequence(a, b, cells)] for a, b in zip(one, two)]

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of each row's cell in the order in which the row visits cells, ties last."""
        out = np.zeros(len(x), np.int64)
        for low in range(0, len(x), 512):
            one, two = self.distances(x[low : low + 512])
            sums = (one[:, :, None] + two[:, None, :]).reshape(len(one), -1)
            own = np.take_along_axis(sums, cells[low : low + 512, None], 1)
            out[low : low + 512] = (sums <= own).sum(1) - 1
        return out

    def fit(self, probes: np.ndarray, met: list[tuple[int, float, float]], recall: float, least: float) -> None:
        """Visit the fewest cells, LEAST_CELLS at least, in which ``recall`` lie of each of: all links
        of the probes, their mean share, and either kind of made partners at a cosine of ``least``.
        ``met`` are rows (rank of the visited cell, links, sum of the probes' shares of their links);
        the made partners need no link at all."""
        x = probes[np.arange(max(MADE, len(probes))) % len(probes)]
        needed = [min(self.everything, LEAST_CELLS)]
        for made in partners(x, least):
            reached = np.cumsum(np.bincount(self.ranks(x, self.home(made)), minlength=self.everything)) / len(x)
            needed.append(int(np.searchsorted(reached, recall) + 1))
        if met:
            rank, *weights = np.array(met, np.float64).T
            for weight in weights:
                reached = np.cumsum(np.bincount(rank.astype(np.int64), weight, self.everything))
                needed.append(int(np.searchsorted(reached / reached[-1], recall) + 1))
        self.cells = min(self.everything, max(needed))


class Probes:
    """Vectors of one length that are held against all points of it, and the index they fit."""

    def __init__(self, rows: pa.Table, vectors: np.ndarray, codewords: int):
        x = _unit(vectors)
        self.unit = x[:PROBES]
        self.numbers = rows["number"].to_numpy()[:PROBES]
        self.labels = np.array(rows["label"].to_pylist()[:PROBES], object)
        self.index = Index(x, codewords)


def partners(x: np.ndarray, least: float) -> list[np.ndarray]:
    """For each row a vector at a cosine of exactly ``least``, off in any direction, and off
    towards another row, as the data spreads."""
    rng = np.random.default_rng(9)
    out, spread = [], rng.normal(size=x.shape)
    for away in (spread, x[rng.permutation(len(x))]):
        side = away - (away * x).sum(1)[:, None] * x
        # Where the other row is this one or its opposite, any direction.
        same = (side * side).sum(1) < 1e-12
        side[same] = (spread - (spread * x).sum(1)[:, None] * x)[same]
        out.append(least * x + np.sqrt(max(0.0, 1 - least * least)) * side / np.sqrt((side * side).sum(1))[:, None])
    return out


def _links_of(points: DataFrame, probes: dict[int, Probes], least: float) -> dict[int, list[tuple]]:
    """How early a probe visits the cells that hold its links, from all points.

    For each length rows (rank, links, shares), at most one for each cell of its grid.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at, found in _rows_by_width(batch["embedding"]):
                width = found.shape[1]
                if width not in probes:
                    continue
                held, unit = probes[width], _unit(found)
                near = unit @ held.unit.T >= least
                near &= np.array(batch["label"].to_pylist(), object)[at][:, None] == held.labels
                near &= batch["number"].to_numpy()[at][:, None] != held.numbers
                row, probe = np.nonzero(near)
                cell = held.index.home(unit)[row]
                pairs, n = np.unique(np.stack((probe, cell), 1), axis=0, return_counts=True)
                rank = held.index.ranks(held.unit[pairs[:, 0]], pairs[:, 1])
                columns = [pa.array(np.full(len(n), width)), pa.array(pairs[:, 0]), pa.array(rank), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["width", "probe", "rank", "n"])

    rows = points.select("label", "number", "embedding").mapInArrow(run, "width long, probe long, rank long, n long")
    by_probe = rows.groupBy("width", "probe", "rank").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("width", "probe"))
    by_rank = by_probe.withColumn("share", share).groupBy("width", "rank").agg(F.sum("n"), F.sum("share"))
    out: dict[int, list[tuple]] = {}
    for width, *row in by_rank.collect():
        out.setdefault(width, []).append(tuple(row))
    return out


def near_vectors(
    vectors: DataFrame, least: float = 0.93, codewords: int = 32, recall: float = 0.995, sample_rows: int = SAMPLE
) -> DataFrame:
    """Link ``vectors`` (vec_id, embedding, label) of equal label and a cosine of ``least``.

    Equal vectors of a label are one point with a number of copies, all linked to each other.
    Vectors of each length have an index of their own, fitted on those of it among
    ``sample_rows`` points (the first by a hash; a length that is not among them is one cell): the two
    halves have a codebook each, and the pairs of codewords form a grid of cells. All points are filed
    by their cell and look up the cells nearest to them in multi-sequence order, as many as
    PROBES points, held against all, need for ``recall`` of their links, and for ``recall`` of made partners
    at a cosine of ``least``, so that it does not rest on how many links the probes have. What they
    meet there is verified by the cosine in double precision. A point carries the set of cells it visits, so
    a link that only one side finds is counted for both, and one that both find once. A full
    cell is split into blocks of BLOCK points, so hot cells are spread; a task counts links and
    keeps one link for each point and local group.

    Vectors that are null, empty, zero or hold a null, NaN or infinity, and those with no label,
    link with nothing, and no link joins vectors of two lengths. Rows that share a
    vec_id are one vector each, counted as copies. Rows without a vec_id get no component. Other
    columns are ignored.

    Returns vec_id, n_links, component_id, kept.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    number = "float" if kind.typeName() == "float" else "double"  # floats are kept as they are
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast(f"array<{number}>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    ).withColumn("point", F.when(F.col("embedding").isNotNull(), F.sha2(F.col("embedding").cast("string"), 256)))
    usable = (
        (F.size("embedding") > 0)
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    points = stage(
        rows.where(usable)
        .groupBy("label", "point")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("number", F.monotonically_increasing_id()),
        "vector-points",
    )
    sample = points.select("label", "number", "embedding").orderBy(F.xxhash64("point"), "point").limit(sample_rows)
    sample = sample.toArrow().combine_chunks()
    if not len(sample):
        return rows.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    probes = {
        found.shape[1]: Probes(sample.take(pa.array(at)), found, codewords)
        for at, found in _rows_by_width(sample["embedding"].combine_chunks())
        if found.shape[1] > 1
    }
    met = _links_of(points, probes, least)
    for width, held in probes.items():
        held.index.fit(held.unit, met.get(width, []), recall, least)
    indexes = {width: held.index for width, held in probes.items()}

    def file(batches: Iterator[pa.RecordBatch]):
        """Each point at home, as a candidate, and in the cells it visits, as a query."""
        for batch in batches:
            for at, found in _rows_by_width(batch["embedding"]):
                n, width = found.shape
                visits, home, everything = [[0]] * n, np.zeros(n, np.int64), 1
                if index := indexes.get(width):
                    unit, everything = _unit(found), index.everything
                    visits, home = index.visits(unit, index.cells), index.home(unit)
                row = np.concatenate((np.arange(n), np.repeat(np.arange(n), [len(v) for v in visits])))
                cell = np.concatenate((home, np.array([c for v in visits for c in v], np.int64)))
                seen = np.zeros((n, everything), bool)
                seen[row[n:], cell[n:]] = True
                seen = [bits.tobytes() for bits in np.packbits(seen, axis=1)]
                flat, ends = pa.array(found[row].ravel()), np.arange(len(row) + 1, dtype=np.int32) * width
                columns = {
                    "label": batch["label"].take(pa.array(at[row])),
                    "width": pa.array(np.full(len(row), width, np.int32)),
                    "cell": pa.array(cell),
                    "query": pa.array(np.arange(len(row)) >= n),
                    "number": batch["number"].take(pa.array(at[row])),
                    "copies": batch["copies"].take(pa.array(at[row])),
                    "home": pa.array(home[row]),
                    "visits": pa.array(seen + [None] * (len(row) - n), pa.binary()),
                    "vector": pa.ListArray.from_arrays(pa.array(ends), flat),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    filed = stage(
        points.select("label", "number", "copies", "embedding").mapInArrow(
            file,
            "label string, width int, cell long, query boolean, number long, copies long, home long, "
            f"visits binary, vector array<{number}>",
        ),
        "vector-cells",
    )
    sizes = filed.groupBy("label", "width", "cell").agg(
        *(
            F.ceil(F.count(F.when(F.col("query") == side, 1)) / BLOCK).cast("int").alias(name)
            for side, name in ((True, "q_blocks"), (False, "c_blocks"))
        )
    )
    sizes = stage(sizes.where("q_blocks > 0 and c_blocks > 0"), "vector-sizes")
    # A query goes to each block of candidates of its cell, and the other way round.
    own = F.pmod(F.xxhash64("number"), F.when(F.col("query"), F.col("q_blocks")).otherwise(F.col("c_blocks"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("c_blocks")).otherwise(F.col("q_blocks")) - 1))
    dealt = (
        filed.join(small(sizes, 1_000_000), ["label", "width", "cell"])
        .select("*", own.alias("own"), every.alias("other"))
        .select(
            "label", "width", "cell", "query", "number", "copies", "home", "visits", "vector",
            F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("q_block"),
            F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("c_block"),
        )
    )

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        query = group["query"].to_numpy(zero_copy_only=False).astype(bool)
        unit = _unit(group["vector"].combine_chunks().flatten().to_numpy().reshape(-1, key[1].as_py()))
        number, copies, home = (group[name].to_numpy() for name in ("number", "copies", "home"))
        q, c = np.flatnonzero(query), np.flatnonzero(~query)
        visits = b"".join(group["visits"].take(pa.array(c)).to_pylist())
        visits = np.unpackbits(np.frombuffer(visits, np.uint8).reshape(len(c), -1), axis=1).astype(bool)
        links, group_of = np.zeros(len(number), np.int64), np.arange(len(c))
        edges = []
        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            near = (unit[part] @ unit[c].T >= least) & (number[part][:, None] != number[c])
            links[part] = near @ copies[c]
            # A candidate that does not look where this query is at home can't count the link itself.
            links[c] += copies[part] @ (near & ~visits[:, home[part]].T)
            for row in np.flatnonzero(near.any(1)):
                met = number[c][near[row]]
                parts = np.unique(group_of[near[row]])
                if len(parts) > 1:  # candidates that this query joins
                    group_of[np.isin(group_of, parts)] = parts[0]
                edges.append((number[part[row]], met.min()))
        first = {g: number[c[i]] for i, g in reversed(list(enumerate(group_of)))}
        edges += [(number[c[i]], first[g]) for i, g in enumerate(group_of) if number[c[i]] != first[g]]
        found = links > 0
        n = int(found.sum())
        return pa.table(
            {
                "number": pa.array(np.concatenate((number[found], [e[0] for e in edges])).astype(np.int64)),
                "other": pa.array([None] * n + [int(e[1]) for e in edges], pa.int64()),
                "links": pa.array(np.concatenate((links[found], np.zeros(len(edges), np.int64))).astype(np.int64)),
            }
        )

    met = stage(
        dealt.groupBy("label", "width", "cell", "q_block", "c_block").applyInArrow(meet, "number long, other long, links long"),
        "vector-links",
    )
    links = met.where("other is null").groupBy("number").agg(F.sum("links").alias("links"))
    ids = points.select("number", "id")
    edges = (
        met.where("other is not null")
        .join(ids.withColumnRenamed("id", "u"), "number")
        .select("u", F.col("other").alias("number"))
        .join(ids.withColumnRenamed("id", "v"), "number")
        .select("u", "v")
    )
    components = connected_components(edges).withColumnRenamed("id", "c_id")
    known = (
        points.join(links, "number", "left")
        .join(components, F.col("id") == F.col("c_id"), "left")
        .select(
            "label",
            "point",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("component", "id").alias("part"),
        )
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("part", "vec_id"))
    return rows.select("vec_id", "label", "point").join(known, ["label", "point"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
