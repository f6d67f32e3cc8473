"""Many categories, hot orders: nothing of them is gathered in one row."""

import numpy as np
import pytest

from cartlytics.operators import abtests, experiment
from cartlytics.sources.testdata import product_sets
from tests.conftest import rows


def test_contingency_of_many_categories(spark):
    """10000 x 50 categories, most cells empty."""
    df = spark.range(0, 30000).selectExpr("id % 10000 as r", "cast(pmod(hash(id), 50) as string) as c")
    cells = abtests.contingency(df, "r", "c").select("r", "c", "observed", "expected").toPandas()
    assert len(cells) == 500000 and cells["observed"].sum() == 30000
    pdf = df.toPandas()
    table = pdf.groupby(["r", "c"]).size()
    got = cells[cells["observed"] > 0].set_index(["r", "c"])["observed"].sort_index()
    assert (got == table.sort_index()).all() and len(got) == len(table)
    assert cells["expected"].sum() == pytest.approx(30000)
    nc = pdf.groupby("c").size()
    assert np.allclose(cells["expected"], 3 * cells["c"].map(nc) / 30000)


def test_contingency_keeps_null_categories(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (1, "a")], "r int, c string")
    assert rows(abtests.contingency(df, "r", "c")) == sorted([(1, "a", 2, 2.25), (1, None, 1, 0.75), (None, "a", 1, 0.75), (None, None, 0, 0.25)], key=repr)
    assert abtests.contingency(df.limit(0), "r", "c").count() == 0


def test_a_hot_order_is_several_sets(spark):
    li = spark.range(0, 5000).selectExpr("case when id % 3 = 0 then 1 else id end as l_orderkey", "id % 77 as l_partkey", "cast(id + 1 as int) as l_linenumber")
    sets = product_sets(li)
    assert sets.selectExpr("max(size(split(product_ids, ',')))").first()[0] <= 64
    assert rows(experiment.order_products(sets)) == rows(li.selectExpr("l_orderkey as order_id", "l_partkey as product_id"))
