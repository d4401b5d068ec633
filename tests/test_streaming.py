from tidewatch.streaming.ais import match_stream


def test_stream_matches_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 5.0, 2.0), (1, "2024-01-01 00:00:00", 5.0, 2.0), (2, "2024-01-01 00:01:00", 8.0, 2.0)]
    spark.createDataFrame(rows, "det_id long, ts string, lat double, lon double").selectExpr("det_id", "cast(ts as timestamp) ts", "lat", "lon").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("det_id long, ts timestamp, lat double, lon double").parquet(str(tmp_path / "in"))
    ais = spark.createDataFrame([(1, 5.001, 2.001, "v", "", "")], "ais_seq long, lat double, lon double, vessel_id string, vessel_name string, flag string")
    match_stream(stream, ais, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["det_id"], r["dark_vessel"]) for r in spark.read.parquet(str(tmp_path / "out/batch=*")).collect()}
    assert got == {(1, False), (2, True)}
