import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm.packing import fill_report, pack, pack_items


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(2, 16))
def test_pack(sizes, classes):
    size = np.array(sizes, np.int64)
    bin_of, fills = pack(size, 50, classes)
    assert (bin_of >= 0).all()
    got = np.bincount(bin_of, weights=size, minlength=len(fills)) if len(size) else np.empty(0)
    assert (got == fills).all() and (fills <= 50).all()
    assert len(fills) <= 1.7 * -(-size.sum() // 50) + 2


def test_frame(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", int(n), "x") for i, n in enumerate(rng.integers(0, 700, 3000))]
    rows += [("hot", 300, "x")] * 1500 + [(None, 40, "x"), ("long", 5000, "x")]
    items = spark.createDataFrame(rows, "item_id string, n_tokens long, container string").cache()
    capacities = {"small": 256, "large": 4096}
    got = pack_items(items, capacities, worker_items=700).cache()
    wanted = sum(r[1] for r in rows)
    for kind, capacity in capacities.items():
        own = got.filter(F.col("container_kind") == kind)
        assert own.agg(F.sum("tokens")).first()[0] == wanted
        bins = own.groupBy("container").agg(F.sum("tokens").alias("n"))
        assert bins.agg(F.max("n")).first()[0] <= capacity
        assert own.filter(F.col("piece") > 0).join(items, "item_id").filter(F.col("n_tokens") <= capacity).isEmpty()
    for r in fill_report(got, capacities).collect():
        assert r.fill > (0.97 if r.container_kind == "large" else 0.85)
    assert pack_items(items.filter("false"), capacities).count() == 0
