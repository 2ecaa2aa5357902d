"""The batch that conflict_check stages grows with the log."""

from tempora.queries import QUERIES


def test_batch_grows_with_the_log(spark):
    small, large = (QUERIES["conflict_check"](spark, f"/root/testdata/{s}").count() for s in ("sf0.001", "sf0.01"))
    assert small > 101 and large > 5 * small
