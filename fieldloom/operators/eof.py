"""Empirical orthogonal functions of one field or of many of its parts, from one reading of the field.

The field is read once: one shuffle brings the cells of a time together as a map, and the maps are kept. Groups are predicates over time and cell, such as
regions by seasons, and every pass over the maps serves all groups. A pass multiplies a few vectors a group by the covariance, adds up partial products in
blocks of cells, and a block Lanczos iteration with restarts on the driver, which holds a few vectors a group and as long as the grid, goes on until
residuals vanish. Neither a cell-by-cell nor a time-by-time matrix is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.session import cut_lineage

CELL = ("lat", "lon")

#: Cells of a partial product that travel as one row, and maps that are multiplied at once.
BLOCK, TOGETHER = 4096, 64
#: Residuals, against the largest eigenvalue, at which vectors count as found; passes after which the iteration gives up.
TOLERANCE, PASSES = 1e-8, 300
#: Vectors of a pass beside the wanted modes, and how many passes' vectors the basis holds before it is restarted.
BESIDE, HELD = 6, 5
#: Groups of one run over the maps; more are done in several.
GROUPS = 60


@dataclass
class EofResult:
    """Lazy tables of one decomposition; those of ``eof_by_group`` begin with a column ``group``.

    ``anomalies``: ``(time, lat, lon, value, x)`` with the weighted anomaly ``x``;
    ``patterns``: ``(mode, lat, lon, loading)``; ``pcs``: ``(mode, time, pc)``;
    ``modes``: ``(mode, eigenvalue, var_exp, north_error, cells, cells_left_out)``.
    """

    anomalies: DataFrame
    patterns: DataFrame
    pcs: DataFrame
    modes: DataFrame


@dataclass
class Part:
    """One group on the common axis: its cells, their means and weights, and what the iteration knows."""

    name: str
    cells: np.ndarray
    mean: np.ndarray
    weight: np.ndarray
    times: int
    left_out: int
    total: float = 0.0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None


class _Maps:
    """The kept maps and passes over them."""

    def __init__(self, df: DataFrame, groups: dict[str, Column], value: str, time: str):
        self.spark, self.time, self.names = df.sparkSession, time, list(groups)
        bits = sum((F.when(p, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(groups.values())), F.lit(0).cast("long"))
        rows = df.select(time, *[F.col(c).cast("double").alias(c) for c in CELL], F.col(value).cast("double").alias("value"), bits.alias("bits"))
        rows = rows.where((F.col("bits") != 0) & F.col(time).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        kind = rows.schema[time]
        numbers, long = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
        schema = T.StructType([kind, *[T.StructField(n, numbers) for n in (*CELL, "value")], T.StructField("bits", long)])
        self.maps = cut_lineage(rows.repartition(time).sortWithinPartitions(time).mapInArrow(_assembled(time), schema))
        pairs = self.maps.select(*CELL).mapInArrow(_cells, T.StructType([T.StructField(n, T.DoubleType()) for n in CELL]))
        axis = pairs.distinct().toPandas().sort_values(list(CELL))  # as many rows as the grid has cells
        self.lat, self.lon = axis["lat"].to_numpy(float), axis["lon"].to_numpy(float)

    def aligned(self) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
        """Turns a batch of maps into value and bit matrices on the common axis, a few maps at a time."""
        lats, lons = self.lat, self.lon
        rows_of = np.unique(lats, return_index=True)
        widest = len(lats)

        def matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                values, bits = np.full((part.num_rows, widest), np.nan), np.zeros((part.num_rows, widest), np.int64)
                for i in range(part.num_rows):
                    lat, lon, v, b = (part.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (*CELL, "value", "bits"))
                    if len(lat) == widest:
                        place = slice(None)
                    else:  # cells are sorted by latitude and longitude on both sides
                        place = _place(lats, lons, rows_of, lat, lon)
                    values[i, place], bits[i, place] = v, b
                yield part, values, bits

        return matrices

    def summed(self, make: Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """Sums over all maps of the matrices (cell, column) that ``make`` gives by group; partial sums meet by block of cells."""
        matrices = self.aligned()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for _, values, bits in matrices(batch):
                    for g, found in make(values, bits).items():
                        held[g] = held[g] + found if g in held else found
            for g, found in held.items():
                for b in range(0, len(found), BLOCK):
                    yield _block(g, b, found[b : b + BLOCK])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                for g, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                    found = np.frombuffer(data)
                    if at == (g, b):
                        held = held + found
                    else:
                        if at is not None:
                            yield _block(*at, held)
                        at, held = (g, b), found
            if at is not None:
                yield _block(*at, held)

        schema = "g int, b int, data binary"
        parts = self.maps.mapInArrow(partial, schema).repartition("g", "b").sortWithinPartitions("g", "b").mapInArrow(total, schema)
        blocks: dict[int, list] = {}
        for g, _, data in sorted((r.g, r.b, r.data) for r in parts.collect()):  # a few numbers per group and cell
            blocks.setdefault(g, []).append(np.frombuffer(data))
        return {g: np.concatenate(x) for g, x in blocks.items()}


def _block(g: int, b: int, found: np.ndarray) -> pa.RecordBatch:
    data = np.ascontiguousarray(found, float).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["g", "b", "data"])


def _place(lats: np.ndarray, lons: np.ndarray, rows_of: tuple[np.ndarray, np.ndarray], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Index on the axis of cells that are sorted like it."""
    names, starts = rows_of
    ends = np.append(starts[1:], len(lats))
    row = np.searchsorted(names, lat)
    out = np.empty(len(lat), np.int64)
    for r in np.unique(row):
        mine = row == r
        out[mine] = starts[r] + np.searchsorted(lons[starts[r] : ends[r]], lon[mine])
    return out


def _assembled(time: str):
    """Rows sorted by time to a map per time, its cells sorted; repeated cells are averaged, missing values are NaN."""

    def closed(key: pa.Scalar, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lat, lon, value, bits = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (*CELL, "value", "bits"))
        order = np.lexsort((lon, lat))
        lat, lon, value, bits = lat[order], lon[order], value[order].astype(float), bits[order]
        fresh = np.concatenate([[True], (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])])
        known = ~np.isnan(value)
        cell = np.cumsum(fresh) - 1
        n = np.bincount(cell, known)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.bincount(cell, np.where(known, value, 0.0)) / n
        member = np.bitwise_or.reduceat(bits, np.flatnonzero(fresh))
        lists = [pa.array([x.tolist()], pa.list_(kind)) for x, kind in ((lat[fresh], pa.float64()), (lon[fresh], pa.float64()), (mean, pa.float64()), (member, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.repeat(key, 1), *lists], [time, *CELL, "value", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pa.compute.run_end_encode(batch.column(time))
            start = 0
            for name, end in zip(runs.values, runs.run_ends.to_pylist()):
                if held and name != key:
                    yield closed(key, held)
                    held = []
                key = name
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield closed(key, held)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = np.zeros((0, 2))
    for batch in batches:
        pairs = np.stack([batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in CELL], 1)
        known = np.unique(np.concatenate([known, pairs]), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(known[:, 0]), pa.array(known[:, 1])], list(CELL))


def _parts(maps: _Maps) -> dict[int, Part]:
    """Cells, means and number of times of every group: the cells that have a value at the most times of any cell."""
    n_groups = len(maps.names)

    def counted(values: np.ndarray, bits: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for g in range(n_groups):
            member = (bits >> g) & 1 == 1
            if member.any():
                known = member & ~np.isnan(values)
                out[g] = np.stack([member.sum(0), known.sum(0), np.where(known, values, 0.0).sum(0)], 1).astype(float)
        return out

    out = {}
    for g, found in maps.summed(counted).items():
        member, n, total = found.reshape(-1, 3).T
        if n.max() > 0:
            cells = np.flatnonzero(n == n.max())
            weight = np.sqrt(np.maximum(np.cos(np.radians(maps.lat[cells])), 0.0))
            out[g] = Part(maps.names[g], cells, total[cells] / n[cells], weight, int(n.max()), int((member > 0).sum()) - len(cells))
    return out


def _anomalies_of(part: Part, g: int, values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maps that belong to a group, their weighted anomalies (a missing value counts as the mean), and which values are known."""
    mine = np.flatnonzero(((bits[:, part.cells] >> g) & 1).any(1))
    inside = values[np.ix_(mine, part.cells)]
    known = ((bits[np.ix_(mine, part.cells)] >> g) & 1 == 1) & ~np.isnan(inside)
    some = known.any(1)
    return mine[some], np.where(known, inside - part.mean, 0.0)[some] * part.weight, known[some]


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns of ``block`` made orthonormal, to each other and to ``basis``; what depends on others is left out."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    found = u[:, s > 1e-7]
    found = found - basis @ (basis.T @ found)
    return np.linalg.qr(found)[0]


def _solve(maps: _Maps, parts: dict[int, Part], n_modes: int) -> None:
    """Finds the leading eigenpairs of every group together: block Lanczos on the residuals, restarted before the basis is too long."""
    width = {g: min(n_modes + BESIDE, len(p.cells)) for g, p in parts.items()}
    wanted = {g: min(n_modes, len(p.cells), max(1, p.times - 1)) for g, p in parts.items()}
    draw = np.random.default_rng(7)
    basis = {g: np.zeros((len(p.cells), 0)) for g, p in parts.items()}
    image = {g: np.zeros((len(p.cells), 0)) for g, p in parts.items()}
    todo = {g: np.linalg.qr(draw.normal(size=(len(p.cells), width[g])))[0] for g, p in parts.items()}
    for _ in range(PASSES):
        if not todo:
            return
        now = {g: (parts[g], v) for g, v in todo.items()}

        def multiplied(values: np.ndarray, bits: np.ndarray, now=now) -> dict[int, np.ndarray]:
            out = {}
            for g, (part, vectors) in now.items():
                _, x, _ = _anomalies_of(part, g, values, bits)
                if len(x):
                    out[g] = np.concatenate([x.T @ (x @ vectors), (x * x).sum(0)[:, None]], 1)
            return out

        found, todo = maps.summed(multiplied), {}
        for g, (part, vectors) in now.items():
            product = found[g].reshape(len(part.cells), -1)
            part.total = float(product[:, -1].sum())
            basis[g], image[g] = np.concatenate([basis[g], vectors], 1), np.concatenate([image[g], product[:, :-1]], 1)
            small = basis[g].T @ image[g]
            theta, turn = np.linalg.eigh((small + small.T) / 2)
            theta, turn = theta[::-1], turn[:, ::-1]
            k = wanted[g]
            lead = turn[:, : width[g]]
            ritz = basis[g] @ lead
            rest = image[g] @ lead - ritz * theta[: lead.shape[1]]
            part.values, part.vectors = np.maximum(theta[:k], 0.0), ritz[:, :k]
            if np.linalg.norm(rest[:, :k], axis=0).max() <= TOLERANCE * max(theta[0], 1e-300) or basis[g].shape[1] >= len(part.cells):
                continue
            if basis[g].shape[1] >= HELD * width[g]:
                lead = turn[:, : 2 * width[g]]
                basis[g], image[g] = basis[g] @ lead, image[g] @ lead
            block = _orthonormal(rest, basis[g])
            if block.shape[1]:
                todo[g] = block
    raise ArithmeticError(f"the decomposition did not settle in {PASSES} passes")


def eof_by_group(df: DataFrame, groups: dict[str, Column], n_modes: int = 5, value: str = "value", time: str = "time") -> EofResult:
    """Leading EOFs of several parts of a field, such as regions by seasons; ``groups`` are predicates over time and cell.

    Each group has its own time means. A group uses the cells that have a value at the most times of any of its cells; ``cells_left_out`` counts the others.
    Repeated (time, cell) rows are averaged. Eigenvalues are divided by n-1; the largest loading of a mode is positive. A group without values has no rows.
    """
    names = list(groups)
    if len(names) > GROUPS:
        results = [eof_by_group(df, {n: groups[n] for n in names[i : i + GROUPS]}, n_modes, value, time) for i in range(0, len(names), GROUPS)]
        return EofResult(*[_union([getattr(r, f) for r in results]) for f in ("anomalies", "patterns", "pcs", "modes")])
    maps = _Maps(df, groups, value, time)
    parts = _parts(maps)
    _solve(maps, parts, n_modes)
    for part in parts.values():
        top = np.argmax(np.abs(part.vectors).round(12), axis=0)  # the first of equals by latitude and longitude
        part.vectors = part.vectors * np.sign(part.vectors[top, np.arange(part.vectors.shape[1])])
    return EofResult(_anomalies(maps, parts), _patterns(maps, parts), _pcs(maps, parts), _modes(maps, parts))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _modes(maps: _Maps, parts: dict[int, Part]) -> DataFrame:
    rows = []
    for p in parts.values():
        total = p.total / max(p.times - 1, 1)
        for m, square in enumerate(p.values, 1):
            eigenvalue = float(square) / max(p.times - 1, 1)
            share = eigenvalue / total if total else None
            rows.append((p.name, m, eigenvalue, share, share * (2.0 / p.times) ** 0.5 if total else None, len(p.cells), p.left_out))
    return maps.spark.createDataFrame(rows, "group string, mode int, eigenvalue double, var_exp double, north_error double, cells long, cells_left_out long")


def _patterns(maps: _Maps, parts: dict[int, Part]) -> DataFrame:
    """A row per group, mode and cell, made in as many tasks as there are groups."""
    found = {g: (p.name, maps.lat[p.cells], maps.lon[p.cells], p.vectors) for g, p in parts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                name, lat, lon, vectors = found[g]
                for m in range(vectors.shape[1]):
                    n = len(lat)
                    columns = [pa.repeat(name, n), pa.array(np.full(n, m + 1, np.int32)), pa.array(lat), pa.array(lon), pa.array(np.ascontiguousarray(vectors[:, m]))]
                    yield pa.RecordBatch.from_arrays(columns, ["group", "mode", *CELL, "loading"])

    chosen = maps.spark.createDataFrame([(g,) for g in found], "g int").repartition(max(1, len(found)), "g")
    return chosen.mapInArrow(run, "group string, mode int, lat double, lon double, loading double")


def _pcs(maps: _Maps, parts: dict[int, Part]) -> DataFrame:
    matrices, time = maps.aligned(), maps.time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, bits in matrices(batch):
                for g, part in parts.items():
                    mine, x, _ = _anomalies_of(part, g, values, bits)
                    scores = x @ part.vectors
                    k = scores.shape[1]
                    if len(mine):
                        times = rows.column(time).take(pa.array(np.repeat(mine, k)))
                        modes = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(mine)))
                        yield pa.RecordBatch.from_arrays([pa.repeat(part.name, len(modes)), modes, times, pa.array(scores.ravel())], ["group", "mode", time, "pc"])

    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("mode", T.IntegerType()), maps.maps.schema[time], T.StructField("pc", T.DoubleType())])
    return maps.maps.mapInArrow(run, schema)


def _anomalies(maps: _Maps, parts: dict[int, Part]) -> DataFrame:
    matrices, time, lat, lon = maps.aligned(), maps.time, maps.lat, maps.lon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, bits in matrices(batch):
                for g, part in parts.items():
                    mine, x, known = _anomalies_of(part, g, values, bits)
                    row, cell = np.nonzero(known)
                    if len(row):
                        place = part.cells[cell]
                        columns = [lat[place], lon[place], values[mine[row], place], x[row, cell]]
                        times = rows.column(time).take(pa.array(mine[row]))
                        yield pa.RecordBatch.from_arrays([pa.repeat(part.name, len(row)), times, *[pa.array(c) for c in columns]], ["group", time, *CELL, "value", "x"])

    numbers = [T.StructField(n, T.DoubleType()) for n in (*CELL, "value", "x")]
    return maps.maps.mapInArrow(run, T.StructType([T.StructField("group", T.StringType()), maps.maps.schema[time], *numbers]))


def eof(df: DataFrame, n_modes: int = 5, value: str = "value", time: str = "time") -> EofResult:
    """Leading EOFs of a whole field: ``eof_by_group`` with one group."""
    found = eof_by_group(df, {"all": F.lit(True)}, n_modes, value, time)
    return EofResult(*[getattr(found, f).drop("group") for f in ("anomalies", "patterns", "pcs", "modes")])


def _keys(df: DataFrame) -> list[str]:
    return ["group", "mode"] if "group" in df.columns else ["mode"]


def scale_patterns(result: EofResult, scaling: int = 0) -> DataFrame:
    """0 none, 1 divided and 2 multiplied by the root of the eigenvalue, 3 correlation of the PC with the field."""
    keys, root = _keys(result.patterns), F.sqrt("eigenvalue")
    if scaling == 0:
        return result.patterns
    if scaling in (1, 2):
        joined = result.patterns.join(F.broadcast(result.modes), keys, "inner")  # one row per group and mode
        scaled = F.col("loading") / root if scaling == 1 else F.col("loading") * root
        return joined.select(*keys, *CELL, scaled.alias("loading"))
    if scaling != 3:
        raise ValueError("scaling is 0, 1, 2 or 3")
    paired = result.anomalies.join(result.pcs, [*keys[:-1], "time"], "inner")
    return paired.groupBy(*keys, *CELL).agg(F.corr("pc", "value").alias("loading"))


def scale_pcs(result: EofResult, scaling: int = 0) -> DataFrame:
    """0 none, 1 unit variance, 2 multiplied by the root of the eigenvalue."""
    if scaling == 0:
        return result.pcs
    if scaling not in (1, 2):
        raise ValueError("scaling is 0, 1 or 2")
    keys, root = _keys(result.pcs), F.sqrt("eigenvalue")
    joined = result.pcs.join(F.broadcast(result.modes), keys, "inner")  # one row per group and mode
    scaled = F.col("pc") / root if scaling == 1 else F.col("pc") * root
    return joined.select(*keys, "time", scaled.alias("pc"))


def group_predicates(regions: Sequence[str], seasons: Sequence[str]) -> dict[str, Column]:
    from fieldloom.functions.regions import in_box
    from fieldloom.functions.scalars import SEASON_MONTHS

    out = {}
    for region in regions:
        for season in seasons:
            predicate = in_box(region, wrap=True)
            if season != "annual":
                predicate = predicate & F.month("time").isin(*SEASON_MONTHS[season])
            out[f"{region}_{season}"] = predicate
    return out
