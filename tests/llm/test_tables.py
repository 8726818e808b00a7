import pytest
from pyspark.sql import functions as F

from cosecha.llm import tables

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_sizes(df):
    import pyarrow as pa

    return df.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")


def test_batches_are_bounded_inside_a_block_only(spark):
    before = spark.conf.get(BOUND)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    with tables.scratch(spark) as keep:
        inside = keep(batch_sizes(texts), "sizes")
    sizes = [r["n"] for r in inside.collect()]
    assert sum(sizes) == 4000 and max(sizes) * 10_000 < 2 * tables.BATCH_BYTES
    assert spark.conf.get(BOUND) == before


def test_a_failed_block_gives_the_bound_back(spark):
    before = spark.conf.get(BOUND)
    with pytest.raises(ValueError), tables.scratch(spark):
        raise ValueError
    assert spark.conf.get(BOUND) == before
