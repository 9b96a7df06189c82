"""Wind quantities from spherical harmonics.

Two shuffles, whatever the size of the grid: one gathers each latitude circle into a row, whose Fourier part is cut to the truncation at once; the other
brings the circles of a time step together, in order of latitude, where Legendre analysis and synthesis are matrix products per wavenumber. The Legendre
functions are made once in a worker process. Wavenumbers and cells never become rows before the result does; a task holds the spectra of one time step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.legendre import legendre
from fieldloom.functions.scalars import EARTH_RADIUS, EARTH_ROTATION, planetary_vorticity
from fieldloom.operators.circles import gather, lists_of, transform


def global_grid_check(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row ``(lat_span, lon_span, strict, periodic)``.

    ``strict`` asks for more than 179 and 359 degrees between the first and last
    label; ``periodic`` adds one step, so a 0..359 axis of one degree passes.
    """
    lons = df.select(lon).distinct().agg(F.max(lon).alias("_hi"), F.min(lon).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    lats = df.agg((F.max(lat) - F.min(lat)).alias("lat_span"))
    both = lats.join(F.broadcast(lons), F.lit(True), "inner")  # one row each
    span = F.col("_hi") - F.col("_lo")
    step = span / (F.col("_n") - 1)
    return both.select(
        "lat_span",
        span.alias("lon_span"),
        ((F.col("lat_span") > 179) & (span > 359)).alias("strict"),
        ((F.col("lat_span") > 179) & (span + step >= 360)).alias("periodic"),
    )


@dataclass(frozen=True)
class Term:
    """A grid field made from coefficients: of vorticity (``z``), absolute vorticity (``eta``) or divergence (``d``), or of their inverse Laplacian; its
    value or its derivative to the east or north, times ``sign``."""

    of: str
    what: str = "value"
    inverse: bool = False
    sign: float = 1.0


class SphericalWind:
    """Quantities derived from a global wind field ``(others..., lat, lon, u, v)``.

    Latitudes run from -90 to 90 in ``n_lat`` equal steps, longitudes from 0 in
    ``n_lon``. Triangular truncation defaults to the largest that the latitude
    quadrature integrates exactly. A time step with a missing, repeated or null
    cell gives nulls at every cell.
    """

    def __init__(
        self,
        df: DataFrame,
        n_lat: int,
        n_lon: int,
        others: Sequence[str] = ("time",),
        truncation: int | None = None,
        radius: float = EARTH_RADIUS,
        omega: float = EARTH_ROTATION,
    ):
        self.df, self.n_lat, self.n_lon, self.others = df, n_lat, n_lon, list(others)
        self.truncation = truncation or min((n_lat - 1) // 2, (n_lon - 1) // 2)
        if 2 * self.truncation >= n_lon:
            raise ValueError("the truncation needs more longitudes")
        self.radius, self.omega = radius, omega

    def _lat_idx(self) -> Column:
        return F.round((F.col("lat") + 90.0) * ((self.n_lat - 1) / 180.0)).cast("int")

    def _steps(self) -> DataFrame:
        """A row per circle with the Fourier parts of u and v up to the truncation; those of a time step in order in one partition."""
        n_lon, top = self.n_lon, self.truncation

        def parts(matrices: list[np.ndarray]) -> list[np.ndarray]:
            u, v = (np.fft.rfft(m, axis=1)[:, : top + 1] / n_lon for m in matrices)
            return [u.real, u.imag, v.real, v.imag]

        circles = gather(self.df.withColumn("lat_idx", self._lat_idx()), [*self.others, "lat_idx"], ["u", "v"])
        spectra = transform(circles, 2, n_lon, 0.0, ["u_re", "u_im", "v_re", "v_im"], parts)
        return spectra.repartition(*self.others).sortWithinPartitions(*self.others, "lat_idx")

    def _per_step(self, schema: T.StructType, make: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
        """Rows of ``schema`` after the other dimensions, made for each time step from its vorticity and divergence coefficients (m, l); None if cells lack."""
        others, n_lat, top, radius = self.others, self.n_lat, self.truncation, self.radius
        steps = self._steps()
        kept = [steps.schema[c] for c in others]
        full = T.StructType([*kept, *schema])

        def coefficients(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            table = legendre(n_lat, top)
            z, d = (np.zeros((top + 1, top + 1), complex) for _ in range(2))
            u, v = u * (table.weight / radius)[:, None], v * (table.weight / radius)[:, None]
            for m in range(top + 1):
                slope, over = table.slope[m], 1j * table.over[m]
                z[m, m:] = slope @ u[:, m] + over @ v[:, m]
                d[m, m:] = over @ u[:, m] - slope @ v[:, m]
            return z, d

        def finished(rows: list[tuple], keys: list[pa.Scalar]) -> pa.RecordBatch:
            whole = [r[0] for r in rows] == list(range(n_lat)) and all(r[1] is not None for r in rows)
            z, d = coefficients(*(np.stack([r[i] for r in rows]) for i in (1, 2))) if whole else (None, None)
            made = make(z, d)
            n = len(made[0])
            return pa.RecordBatch.from_arrays([*[pa.repeat(k, n) for k in keys], *made], [f.name for f in full])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, keys, named = [], None, None
            for batch in batches:
                lists = [_matrix(batch.column(c), top + 1) for c in ("u_re", "u_im", "v_re", "v_im")]
                u, v = lists[0] + 1j * lists[1], lists[2] + 1j * lists[3]
                at = batch.column("lat_idx").to_pylist()
                names = list(zip(*(batch.column(c).to_pylist() for c in others))) if others else [()] * batch.num_rows
                for i, name in enumerate(names):
                    if rows and name != named:
                        yield finished(rows, keys)
                        rows = []
                    if not rows:
                        named, keys = name, [batch.column(c)[i] for c in others]
                    known = not np.isnan(u[i, 0].real)
                    rows.append((at[i], u[i] if known else None, v[i] if known else None))
            if rows:
                yield finished(rows, keys)

        return steps.mapInArrow(run, full)

    def coefficients(self) -> DataFrame:
        """Vorticity (``z``) and divergence (``d``) coefficients: ``(others..., l, m, z_re, z_im, d_re, d_im)``."""
        top = self.truncation
        m, l = np.triu_indices(top + 1)
        names = ["z_re", "z_im", "d_re", "d_im"]
        schema = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("l", "m")], *[T.StructField(n, T.DoubleType()) for n in names]])

        def make(z: np.ndarray | None, d: np.ndarray | None) -> list[pa.Array]:
            axes = [pa.array(l, pa.int32()), pa.array(m, pa.int32())]
            if z is None:
                return [*axes, *[pa.nulls(len(l), pa.float64())] * 4]
            return [*axes, *[pa.array(np.ascontiguousarray(x)) for c in (z[m, l], d[m, l]) for x in (c.real, c.imag)]]

        return self._per_step(schema, make)

    def _synthesise(self, fields: dict[str, Term]) -> DataFrame:
        """Grid values of several fields."""
        n_lat, n_lon, top, radius = self.n_lat, self.n_lon, self.truncation, self.radius
        planetary = 2.0 * self.omega * (2.0 / 3.0) ** 0.5  # 2 omega sin(lat) is this at l = 1, m = 0
        order = np.arange(top + 1, dtype=float)
        laplacian = order * (order + 1)
        inverse = np.where(laplacian > 0, -(radius**2) / np.maximum(laplacian, 1), 0.0)
        schema = T.StructType([T.StructField("lat_idx", T.IntegerType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in fields]])

        def grid(term: Term, z: np.ndarray, d: np.ndarray) -> np.ndarray:
            table = legendre(n_lat, top)
            c = (d if term.of == "d" else z) * term.sign
            if term.of == "eta":
                c = c.copy()
                c[0, 1] += planetary * term.sign
            if term.inverse:
                c = c * inverse
            functions = {"value": table.p, "east": table.over, "north": table.slope}[term.what]
            scale = {"value": 1.0, "east": 1j / radius, "north": 1.0 / radius}[term.what]
            circles = np.zeros((n_lat, n_lon // 2 + 1), complex)
            for m in range(top + 1):
                circles[:, m] = (scale * c[m, m:]) @ functions[m]
            return np.fft.irfft(circles * n_lon, n_lon, axis=1)

        def make(z: np.ndarray | None, d: np.ndarray | None) -> list[pa.Array]:
            lats = pa.array(np.arange(n_lat), pa.int32())
            none = np.zeros(n_lat, bool)
            return [lats, *[lists_of(np.zeros((n_lat, n_lon)), none) if z is None else lists_of(grid(t, z, d)) for t in fields.values()]]

        circles = self._per_step(schema, make)
        axis = F.transform(F.sequence(F.lit(0), F.lit(n_lon - 1)), lambda j: j * F.lit(360.0 / n_lon))
        lat = (F.col("lat_idx") * (180.0 / (n_lat - 1)) - 90.0).alias("lat")
        cells = circles.withColumn("lon", axis)
        return cells.select(*self.others, lat, F.inline(F.arrays_zip("lon", *fields)))

    def magnitude(self) -> DataFrame:
        speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
        return self.df.select(*self.others, "lat", "lon", speed.alias("spd"))

    def vorticity(self) -> DataFrame:
        """``vrt`` in 1/s."""
        return self._synthesise({"vrt": Term("z")})

    def divergence(self) -> DataFrame:
        """``div`` in 1e-6/s."""
        return self._synthesise({"div": Term("d")}).withColumn("div", F.col("div") / 1e-6)

    def absolute_vorticity(self) -> DataFrame:
        """``avrt`` in 1e-5/s."""
        eta = F.col("vrt") + planetary_vorticity("lat", self.omega)
        return self.vorticity().select(*self.others, "lat", "lon", (eta / 1e-5).alias("avrt"))

    def absolute_vorticity_gradient(self) -> DataFrame:
        """Magnitude ``avrtgrad`` in 1e-5/(s m)."""
        grid = self._synthesise({"ex": Term("eta", "east"), "ey": Term("eta", "north")})
        size = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")) / 1e-5
        return grid.select(*self.others, "lat", "lon", size.alias("avrtgrad"))

    def streamfunction(self) -> DataFrame:
        """``sf`` in 1e6 m2/s."""
        return self._synthesise({"sf": Term("z", inverse=True)}).withColumn("sf", F.col("sf") / 1e6)

    def velocity_potential(self) -> DataFrame:
        """``vp`` in 1e6 m2/s."""
        return self._synthesise({"vp": Term("d", inverse=True)}).withColumn("vp", F.col("vp") / 1e6)

    def irrotational_wind(self) -> DataFrame:
        """``uchi, vchi``: the gradient of the velocity potential."""
        return self._synthesise({"uchi": Term("d", "east", True), "vchi": Term("d", "north", True)})

    def nondivergent_wind(self) -> DataFrame:
        """``upsi, vpsi``: the streamfunction's gradient turned left."""
        return self._synthesise({"upsi": Term("z", "north", True, -1.0), "vpsi": Term("z", "east", True)})

    def rossby_wave_source(self) -> DataFrame:
        """``rws1`` (stretching), ``rws2`` (advection) and their sum ``rws`` in 1e-11/s2."""
        grid = self._synthesise(
            {
                "eta": Term("eta"),
                "div": Term("d"),
                "uchi": Term("d", "east", True),
                "vchi": Term("d", "north", True),
                "ex": Term("eta", "east"),
                "ey": Term("eta", "north"),
            }
        )
        stretching = -F.col("eta") * F.col("div") / 1e-11
        advection = -(F.col("uchi") * F.col("ex") + F.col("vchi") * F.col("ey")) / 1e-11
        terms = grid.withColumn("rws1", stretching).withColumn("rws2", advection)
        return terms.select(*self.others, "lat", "lon", "rws1", "rws2", (F.col("rws1") + F.col("rws2")).alias("rws"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of equal length as a matrix; nulls become NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
