"""The SQL table functions against the DataFrame operators."""

from cosecha.operators import prices, supply
from cosecha.plans.sql_surface import register_functions
from cosecha.plans.views import AS_OF, Views

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted((tuple(str(v) for v in r) for r in frame.collect()))


def test_functions_agree_with_operators(spark):
    assert len(register_functions(spark, SF)) == 8
    v = Views(spark, SF)
    found = rows(spark.sql("SELECT product_id, total_kg, product_name FROM market_top_products(1, 0, 5)"))
    assert found == rows(supply.top_products(v.supply, v.products, AS_OF, 0, 5, market=1).select("product_id", "total_kg", "product_name"))
    assert rows(spark.sql("SELECT * FROM prices_by_department(730)")) == rows(prices.by_department(v.prices, v.cities, AS_OF, 730))
    assert rows(spark.sql("SELECT * FROM supply_by_department(730)")) == rows(supply.by_department(v.supply, v.cities, AS_OF, 730))
    assert rows(spark.sql("SELECT * FROM supply_markets_for_product(1, 0)")) == rows(supply.markets_of(v.supply, "observation_date", AS_OF, 0, product_id=1))
    one = spark.sql("SELECT * FROM market_supply_summary(-1)").collect()
    assert [tuple(r) for r in one] == [(0.0, 0, None, None)]
    assert spark.sql("SELECT * FROM product_presentations(1, 0)").count() == prices.presentations(v.prices, 1, AS_OF, 0).count()
