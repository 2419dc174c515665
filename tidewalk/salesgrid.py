"""The grid that the registered queries run on; nothing else uses it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewalk.plans.grid import GridSpec
from tidewalk.sources.fields import mesh


@dataclass(frozen=True)
class SalesGrid:
    """A regular grid of 15 by 10 degrees, its fields summed up from the line items of a sales database."""

    spark: SparkSession
    sf_dir: str
    spec: GridSpec = GridSpec(nx=24, ny=16)
    lon0: float = 0.0  # of the first corner
    dlon: float = 15.0
    lat0: float = -80.0
    dlat: float = 10.0

    def _mesh(self, rows: int, columns: int, j: str, i: str, shift: float) -> DataFrame:
        lon, lat = self.dlon * (F.col(i) + shift) + self.lon0, self.dlat * (F.col(j) + shift) + self.lat0
        return mesh(self.spark, rows, columns, j, i).select(j, i, lon.alias("lon"), lat.alias("lat"))

    @property
    def corners(self) -> DataFrame:
        return self._mesh(self.spec.corners_y, self.spec.corners_x, "yq", "xq", 0.0)

    @property
    def centers(self) -> DataFrame:
        return self._mesh(16, 24, "yh", "xh", 0.5 if self.spec.symmetric else -0.5)

    @property
    def widths(self) -> tuple[DataFrame, DataFrame]:
        u = mesh(self.spark, 16, 25, "yh", "xq").withColumn("width", F.lit(6371000.0) * F.radians(F.lit(10.0)))
        v = mesh(self.spark, 17, 24, "yq", "xh").withColumn("width", F.lit(6371000.0) * F.radians(F.lit(15.0)) * F.cos(F.radians(10.0 * F.col("yq") - 80)))
        return u, v

    def _items(self) -> DataFrame:
        items = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        signed = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
        return items.select(F.year("l_shipdate").cast("long").alias("time"), F.col("l_linenumber").cast("long").alias("z_l"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), signed.alias("s"), F.col("l_quantity").alias("q"))

    def _sum(self, j, i, index: tuple[str, str], of: str, name: str) -> DataFrame:
        held = self._items().select("time", "z_l", F.pmod(*j).alias(index[0]), F.pmod(*i).alias(index[1]), of)
        return held.groupBy("time", "z_l", *index).agg(F.sum(of).alias(name))

    @property
    def umo(self) -> DataFrame:
        return self._sum((F.col("o"), F.lit(16)), (F.col("p"), F.lit(24)), ("yh", "xq"), "s", "umo")

    @property
    def vmo(self) -> DataFrame:
        return self._sum((F.col("o"), F.lit(17)), (F.col("o") + F.col("p"), F.lit(24)), ("yq", "xh"), "s", "vmo")

    @property
    def thetao(self) -> DataFrame:
        return self._sum((F.col("o"), F.lit(16)), (F.col("p"), F.lit(24)), ("yh", "xh"), "q", "thetao")

    def mask(self, condition) -> DataFrame:
        return self.centers.select("yh", "xh", condition.alias("inside"))
