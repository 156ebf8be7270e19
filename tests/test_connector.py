"""Sources read by position: in parts, and as streams that go on where they ended."""

from pyspark.sql import types as T

from corpusdetect.sources import connector
from corpusdetect.streaming import ingest


def counted():
    # Inside a function it travels to the workers by value.
    class Counted(connector.PositionedSource):
        tag = "counted"
        row_schema = T.StructType([T.StructField("position", T.LongType()), T.StructField("square", T.LongType())])
        stretch = 10
        batch = 25

        def reach(self):
            with open(self.options["file"]) as f:
                return int(f.read())

        def read(self, start, end):
            for i in range(start, end):
                yield i, i * i

    return Counted


def reach(file, n):
    file.write_text(str(n))


def test_batches_are_read_in_parts(spark, tmp_path):
    file = tmp_path / "reach"
    connector.register(spark, counted())
    for n in (0, 9, 10, 57):
        reach(file, n)
        df = connector.read_source(spark, "counted", file=str(file))
        assert sorted(tuple(r) for r in df.collect()) == [(i, i * i) for i in range(n)]
        assert df.rdd.getNumPartitions() == max(1, -(-n // 10))


def test_streams_go_on_where_they_ended(spark, tmp_path):
    file, target, position = tmp_path / "reach", str(tmp_path / "out"), str(tmp_path / "at")
    connector.register(spark, counted())
    for n in (30, 30, 90, 91):
        reach(file, n)
        stream = connector.stream_source(spark, "counted", file=str(file))
        ingest.ingest(stream, lambda rows: rows, target, position).awaitTermination()
        assert sorted(r.position for r in spark.read.parquet(target).collect()) == list(range(n))
