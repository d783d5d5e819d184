import datetime

from hearsay.operators.facts import FACT
from hearsay.streaming import firsts

T0 = datetime.datetime(2026, 1, 1)


def test_first_carriers_match_batch(spark, tmp_path):
    rows = [(T0 + datetime.timedelta(minutes=7 * i % 50), f"a{i % 3}", "f", f"i{i % 4}", "v") for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, agent string, family string, item string, value_key string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = firsts.first_carriers(live, "agent").writeStream.outputMode("complete").format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    want = firsts.first_carriers(df, "agent")
    assert sorted(map(tuple, spark.table("firsts").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert FACT == ["family", "item", "value_key"]
