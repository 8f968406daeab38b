from pyspark.sql import functions as F

from quarrylight.plans import audit


def test_late_sections_stay_in_the_report(spark):
    top = spark.range(2500).select(
        F.format_string("section%02d", (F.col("id") / 100).cast("int")).alias("section"), (F.col("id") % 100 + 1).alias("rank"),
        F.lit(100).alias("total"), F.lit("critical").alias("severity"), F.concat(F.lit("finding "), "id").alias("message"),
    )
    report = audit.render("p", top)
    assert report.count("\n## ") == 25 and report.count("- **critical**") == 2500 and "finding 2499\n" in report
