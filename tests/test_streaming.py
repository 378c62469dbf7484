"""A stream of pairs gives the counts of the table."""

from pyspark.sql import functions as F

from pairloom.operators import pairs
from pairloom.params import MapParams
from pairloom.streaming.contacts import running_contacts


def test_running_contacts(spark, tmp_path):
    params = MapParams(min_mapq=20, strong=None)
    rows = [(k, f"r{k // 2}", 65 if k % 2 == 0 else 129, k * 7 % 3, k, 20 + k % 5, []) for k in range(120)]
    al = spark.createDataFrame(rows, "rec_no bigint, qname string, flag int, refid int, pos int, mapq int, cigar array<struct<op:int,len:int>>")
    mates = pairs.mate_pairs(pairs.informative(al), params)
    mates.repartition(3).write.parquet(f"{tmp_path}/mates")
    dim = spark.createDataFrame([(r, r, 1000) for r in range(3)], "refid int, ix int, length int")
    stream = spark.readStream.schema(mates.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/mates")
    q = running_contacts(stream, dim, params).writeStream.outputMode("complete").format("memory").queryName("contacts").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = running_contacts(mates, dim, params)
    assert sorted(map(tuple, spark.table("contacts").collect())) == sorted(map(tuple, want.collect()))
    assert want.agg(F.sum("w")).first()[0] == 60
