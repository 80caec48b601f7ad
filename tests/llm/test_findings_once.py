"""The fit works out each finding's features once, not once a pass."""

from pyspark.sql import functions as F

from rankloom.llm import secrets


def test_features_of_findings_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    findings = secrets.made_findings(spark, 400).localCheckpoint()
    n = findings.count()
    assert len(secrets.fit(findings.withColumn("after", counted("after")))) == secrets.TREES
    assert seen.value <= 2 * n
