"""Lines of a file that Spark reads in several cuts."""

from kindred.operators import quality
from kindred.plans import files
from kindred.sources.fixtures import source_records

SF = "/root/testdata/sf0.001"
CUT = "spark.sql.files.maxPartitionBytes"


def test_lines_are_numbered_without_gaps(spark, tmp_path):
    before = spark.conf.get(CUT)
    spark.conf.set(CUT, "100")
    try:
        spark.createDataFrame([(f"line {i}",) for i in range(200)], "value string").coalesce(1).write.text(str(tmp_path / "lines"))
        lines = quality.read_lines(spark, str(tmp_path / "lines"))
        assert lines.rdd.getNumPartitions() > 1
        assert [(r["line"], r["value"]) for r in quality.numbered(lines).orderBy("line").collect()] == [(i, f"line {i}") for i in range(200)]
        assert quality.numbered(lines.limit(0)).isEmpty()
        ids = [r["entity_id"] for r in source_records(spark, SF).filter("source = 'S1'").orderBy("rid").collect()]
        assert [tuple(r) for r in files.id_list_order(spark, SF).orderBy("line").collect()] == [(i + 1, x) for i, x in enumerate(ids)]
    finally:
        spark.conf.set(CUT, before)
