import pytest

from oracle import connect, same
from rankloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_covers_its_table(spark, sf_dir, name):
    table = "pages" if name.startswith(("op1_", "op2_", "op8_")) else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    got = QUERIES[name](spark, sf_dir).count()
    assert got >= n if name.startswith("op4_") else got > 0 if name.startswith("op9_") else got == n
