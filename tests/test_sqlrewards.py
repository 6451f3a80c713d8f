import pytest
from pyspark.sql import functions as F

from velarium.operators import sqlrewards


def test_result_match(spark):
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "name string, age int").createOrReplaceTempView("singer")
    gold = "SELECT name, age FROM singer WHERE age > 1"
    assert sqlrewards.result_match(spark, "SELECT age, name FROM singer WHERE age >= 2", gold) == 2.0
    assert sqlrewards.result_match(spark, "SELECT DISTINCT name, age FROM singer WHERE age >= 2", gold) == -1.0
    assert sqlrewards.result_match(spark, "SELECT 'b' AS name, 2 AS age", gold) == -1.0
    assert sqlrewards.result_match(spark, "SELECT nothing FROM nowhere", gold) == -1.0
    assert sqlrewards.result_match(spark, "DROP TABLE singer", gold) == -1.0
    assert sqlrewards.result_match(spark, "SELECT 1", None) == 0.0
    assert sqlrewards.result_match(spark, "SELECT name FROM singer ORDER BY name DESC", "SELECT name FROM singer ORDER BY name", ordered=True) == -1.0


def test_forms(spark):
    df = spark.createDataFrame([([], False, False), (["select a from t where b"], False, True), (["select a from t limit 1"], True, False)], "q array<string>, f boolean, g boolean")
    assert [round(r[0], 2) for r in df.select(sqlrewards.query_form(F.col("q"), F.col("f"), F.col("g"))).collect()] == [-1.5, 2.4, -5.0]
    d = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (1, 1)], "c int, r int")
    assert [r[0] for r in d.select(sqlrewards.structure(F.col("c"), F.col("r"))).collect()] == [0.0, -0.15, 0.05, 0.1]


@pytest.mark.parametrize("sql, filters, sorts", [
    ("select * from t where 1 = 1", False, False), ("select * from t where 'a' = 'a' order by x", False, True), ("select * from t where a > 1 group by b", True, False), ("select * from t where true limit 1", False, False),
    ("select * from (select * from t order by a) x", False, False), ("select rank() over (order by a) from t", False, False), ("select 'order by' from t -- order by", False, False), (None, False, False), ("select * from t where 1=1 order by where_col", False, True),
])
def test_what_a_statement_does(sql, filters, sorts):
    assert (sqlrewards.filters_rows(sql), sqlrewards.sorts_rows(sql)) == (filters, sorts)
