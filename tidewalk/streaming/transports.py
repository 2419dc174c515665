"""Transports of fields that arrive as a stream: the faces are fixed, so each batch is one stateless join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewalk.operators.sampling import MOST_FACES, number


def stream_transports(stream: DataFrame, faces: DataFrame, index: tuple[str, str], value: str, out: str = "conv_mass_transport") -> DataFrame:
    """``stream`` of a u or v field joined with its faces ``(section_id, sect, fj, fi, sign)``.

    The faces are counted first and broadcast if there are few enough.
    """
    few = faces.count() <= MOST_FACES
    dims = [c for c in stream.columns if c not in (*index, value)]
    held = stream.select(*dims, F.col(index[0]).alias("fj"), F.col(index[1]).alias("fi"), F.coalesce(number(value), F.lit(0.0)).alias("_value"))
    held = held.join(F.broadcast(faces) if few else faces, ["fj", "fi"])
    return held.select("section_id", *dims, "sect", (F.col("_value") * F.col("sign")).alias(out))


def stream_totals(transports: DataFrame, time: str, window: str, late: str, by: tuple[str, ...] = ("section_id",), value: str = "conv_mass_transport") -> DataFrame:
    """Totals in windows of event time, closed once the watermark has passed them."""
    return transports.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.sum(value).alias("total"))
