"""What is made of transports: sums along and down a section, means over time, overturning, boundaries of masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewalk.plans.grid import GridSpec, check_mask

from .sampling import at_faces


def totals(transports: DataFrame, by: list[str], value: str = "conv_mass_transport", out: str = "total") -> DataFrame:
    """Sum over all faces, by the columns given."""
    return transports.groupBy(*by).agg(F.sum(value).alias(out))


def time_mean(df: DataFrame, value: str, time: str = "time", out: str | None = None) -> DataFrame:
    """Mean over time; missing values don't count."""
    return df.groupBy(*[c for c in df.columns if c not in (time, value)]).agg(F.avg(value).alias(out or value))


def cumulated(transports: DataFrame, value: str = "conv_mass_transport", layer: str = "z_l", others: tuple[str, ...] = ("section_id", "time"), out: str = "cumulated") -> DataFrame:
    """Sums along the section and down the layers: everything up to this face, in this layer and those before."""
    one = transports.groupBy(*others, layer, "sect").agg(F.sum(value).alias("_v"))
    one = one.withColumn("_v", F.sum("_v").over(W.partitionBy(*others, layer).orderBy("sect")))
    return one.withColumn(out, F.sum("_v").over(W.partitionBy(*others, "sect").orderBy(layer))).drop("_v")


def overturning(transports: DataFrame, value: str = "conv_mass_transport", layer: str = "z_l", others: tuple[str, ...] = ("section_id", "time"), from_top: bool = True, out: str = "psi") -> DataFrame:
    """Streamfunction at interfaces: the sum over all faces, cumulated over layers, 0 at the first interface.

    Column ``interface`` counts interfaces from 0.  From the bottom, what lies below an interface is summed instead.
    """
    sums = transports.groupBy(*others, layer).agg(F.sum(value).alias("_v"))
    by = W.partitionBy(*others).orderBy(layer if from_top else F.desc(layer))
    run = sums.select(*others, F.row_number().over(by).cast("long").alias("interface"), F.sum("_v").over(by).alias(out))
    edge = run.where("interface = 1").select(*others, F.lit(0).cast("long").alias("interface"), F.lit(0.0).alias(out))
    return run.unionByName(edge)


def layer_table(spark: SparkSession, layers: list[float], interfaces: list[float], layer: str = "z_l") -> DataFrame:
    """``(layer, top, bottom, thickness)`` from a layer axis and its interfaces, one more than layers."""
    if len(interfaces) != len(layers) + 1:
        raise ValueError("there is one interface more than layers")
    rows = [(float(c), float(a), float(b), abs(float(b) - float(a))) for c, a, b in zip(layers, interfaces, interfaces[1:])]
    return spark.createDataFrame(rows, f"{layer} double, top double, bottom double, thickness double")


def with_layers(transports: DataFrame, layers: DataFrame, layer: str = "z_l") -> DataFrame:
    """Transports with the interfaces of their layers; a layer that the table doesn't have gets nulls."""
    held = layers.withColumnRenamed(layer, "_layer")
    return transports.join(held, F.col(layer).cast("double") == F.col("_layer"), "left").drop("_layer")


def boundary_faces(mask: DataFrame, spec: GridSpec, inside: str = "inside") -> DataFrame:
    """Faces between cells in and out of a mask: ``(var, i, j, sign)``, sign 1 where the positive direction leads inside.

    ``i`` and ``j`` index the u or v table.  The edge of the grid is no boundary, but a periodic axis goes round.
    """
    check_mask(mask, spec, inside)
    cells = mask.select(F.col(spec.yh).cast("long").alias("j"), F.col(spec.xh).cast("long").alias("i"), F.col(inside).alias("m"))
    shift = 0 if spec.symmetric else -1
    steps = F.array(F.struct(F.lit("U").alias("var"), F.lit(0).alias("dj"), F.lit(1).alias("di")), F.struct(F.lit("V").alias("var"), F.lit(1).alias("dj"), F.lit(0).alias("di")))
    ahead = cells.select("i", "j", "m", F.explode(steps).alias("s")).select("*", "s.*")
    raw_i, raw_j = F.col("i") + F.col("di"), F.col("j") + F.col("dj")
    ahead = ahead.select("var", "m", raw_i.alias("fi"), raw_j.alias("fj"), (F.pmod(raw_i, F.lit(spec.nx)) if spec.periodic_x else raw_i).alias("ni"), (F.pmod(raw_j, F.lit(spec.ny)) if spec.periodic_y else raw_j).alias("nj"))
    other = cells.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("m").alias("m2"))
    held = ahead.join(other, ["ni", "nj"]).where(F.col("m") != F.col("m2"))
    place = lambda c, n, around: (F.pmod(F.col(c) + shift, F.lit(n)) if around else F.col(c) + shift).cast("long")
    return held.select("var", place("fi", spec.nx, spec.periodic_x).alias("i"), place("fj", spec.ny, spec.periodic_y).alias("j"), F.when(F.col("m2"), 1).otherwise(-1).alias("sign"))


def mask_transport(mask: DataFrame, spec: GridSpec, u: DataFrame, v: DataFrame, utr: str = "umo", vtr: str = "vmo", inside: str = "inside", out: str = "total") -> DataFrame:
    """Total transport into a mask by time and layer, without tracing its outline."""
    dims = [c for c in u.columns if c not in (spec.yh, spec.xq, utr)]
    held = boundary_faces(mask, spec, inside).withColumnRenamed("i", "fi").withColumnRenamed("j", "fj").persist()
    parts = [at_faces(held.where(F.col("var") == d), f, at, name) for d, f, at, name in (("U", u, (spec.yh, spec.xq), utr), ("V", v, (spec.yq, spec.xh), vtr))]
    return parts[0].unionByName(parts[1]).groupBy(*dims).agg(F.sum(F.col("_value") * F.col("sign")).alias(out))
