"""The encounter stand-in: the skew-resistant plan equals the specification's windows."""

import pytest
from pyspark.sql import functions as F

from carescope.sources import fixtures


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_stretches_equals_spec(spark, sf):
    w = fixtures.encounters(spark, sf, "window")
    b = fixtures.encounters(spark, sf, "stretches")
    assert w.count() == b.count() and w.exceptAll(b).count() == 0 and b.exceptAll(w).count() == 0


def test_stretches_with_a_hot_customer(spark):
    # a third of the orders re-assigned to one customer: the per-customer windows of the
    # specification and the stretches must still agree row for row
    orders = fixtures.table(spark, "/root/testdata/sf0.01", "orders")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")))
    customer = fixtures.table(spark, "/root/testdata/sf0.01", "customer")
    spec_o, _ = fixtures._spec_parts()
    w = spark.sql("with " + spec_o + " select o_orderkey, nxt, prior_n from o",
                  orders=hot, customer=customer)
    joined = hot.join(customer.select("c_custkey", "c_mktsegment"), hot.o_custkey == customer.c_custkey) \
        .drop("c_custkey")
    b = fixtures._customer_windows(joined).select("o_orderkey", "nxt", "prior_n")
    assert w.count() == b.count() and w.exceptAll(b).count() == 0 and b.exceptAll(w).count() == 0
