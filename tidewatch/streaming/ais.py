"""An extension: dark-vessel matching of a stream of detections against stored ship positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.operators.nearest import match_nearest


def match_stream(detections: DataFrame, ais: DataFrame, path: str, checkpoint: str, radius_km: float = P.AIS_RADIUS_KM, watermark: str = "1 hour"):
    """Starts a query that appends matched detections as Parquet, a micro-batch at a time.

    detections: a stream with det_id, ts, lat, lon; repeats within the watermark are dropped.  ais is static.
    """
    once = detections.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["det_id"])

    def batch(df: DataFrame, k: int) -> None:
        match_nearest(df, ais, radius_km).withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
