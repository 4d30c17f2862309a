from trackloom.streaming.bouts import sessions, switch


def run(spark, df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_sessions_and_switch(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "source string, ID long, frame long, ts timestamp, prob double, prediction int"
    base = 1_700_000_000
    for k, frames in enumerate([range(0, 6), range(6, 12), range(600, 602)]):
        data = [("A", 1, f, base + f / 6, [0.9, 0.5, 0.5, 0.1, None, 0.95][f % 6], 1 if f % 100 < 9 else 0) for f in frames]
        spark.createDataFrame(data, "source string, ID long, frame long, t double, prob double, prediction int").selectExpr("source", "ID", "frame", "timestamp_millis(cast(t * 1000 as bigint)) AS ts", "prob", "prediction").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run(spark, sessions(stream(), late="1 second"), "s1").collect()
    assert [r["n"] for r in got][:1] == [9]
    states = {r["frame"]: r["state"] for r in run(spark, switch(stream(), 0.8, 0.2), "s2").collect()}
    assert len(states) == 14 and states[0] == 1 and states[2] == 1 and states[3] == 0 and states[4] == 0 and states[5] == 1
