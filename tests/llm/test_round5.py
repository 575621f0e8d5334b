"""Findings on the third round's check: memory of the pipeline's workers, how tokens of lines are sorted."""

import pyarrow as pa

from spreadloom.llm import line_dedup
from spreadloom.llm.common import BATCH, tidy


def test_workers_of_a_stage_get_small_batches(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    stage = tidy(lambda spark, docs, sf_dir: docs.mapInArrow(rows, "n long"))
    before = spark.conf.get(BATCH)
    try:
        for setting, most in (("10000", 1000), ("0", 1000), ("70", 70)):  # a smaller setting stays
            spark.conf.set(BATCH, setting)
            found = [r["n"] for r in stage(spark, spark.range(0, 5000, 1, 1), "").collect()]
            assert sum(found) == 5000 and max(found) == most
    finally:
        spark.conf.set(BATCH, before)


def test_tokens_of_lines_are_sorted_as_plain_numbers(spark):
    lines = spark.createDataFrame([(1, "b a\tB c"), (2, "  ")], "doc_id long, line string")
    levels, _ = line_dedup.rarity(lines)
    sets = line_dedup.token_sets(lines, levels)
    assert not sets.schema["tokens"].dataType.containsNull  # else Spark boxes and compares them
    (found,) = sets.collect()
    assert found["doc_id"] == 1 and len(found["tokens"]) == 3 and found["tokens"] == sorted(found["tokens"])
