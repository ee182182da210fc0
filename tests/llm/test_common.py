from pyspark.sql import functions as F

from marlstone.llm.common import join_classes


def test_rows_of_a_large_class_are_spread(spark):
    """A class of a third of all rows is not one task of the join, and every row gets the values of its class or null."""
    parts, total = 16, 48_000
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(parts),
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000)
        rows = spark.range(total).select("id", key.alias("key"))
        classes = rows.where("key < 19000").groupBy("key").agg(F.count("*").alias("n"), (F.first("key") * 2).alias("value"))
        out = join_classes(rows, classes, ["key"], "n", total)
        assert out.columns == ["id", "key", "value"]
        placed = out.withColumn("task", F.spark_partition_id())
        # the sum needs the joined value: without it the optimizer leaves the join out
        sizes = [r.n for r in placed.groupBy("task").agg(F.count("*").alias("n"), F.sum("value").alias("all")).collect()]
        assert len(sizes) == parts and max(sizes) < 2 * total / parts
        wrong = out.where("NOT value <=> IF(key < 19000, key * 2, NULL)").count()
        assert wrong == 0 and out.count() == total and out.select("id").distinct().count() == total
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
