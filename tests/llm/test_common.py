from types import SimpleNamespace

import pytest

from inkwell.llm.common import BATCH_BOUND, BATCH_BYTES, bound_batches, shared_folder


def session(master, folder=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)


def test_folder_of_the_session_counts():
    assert shared_folder(session("spark://a:1", "s3a://b/c")) == "s3a://b/c"


def test_own_folder_on_one_machine_only():
    one = session("local[2]")
    assert shared_folder(one) == shared_folder(one) and shared_folder(one).startswith("file:///")
    assert one.conf["spark.checkpoint.dir"] is None  # Spark refuses to change it
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://a:1"))


@pytest.mark.parametrize("bound, after", [("64m", str(BATCH_BYTES)), ("1m", "1m")])
def test_batches_are_bounded(spark, bound, after):
    before = spark.conf.get(BATCH_BOUND)
    try:
        spark.conf.set(BATCH_BOUND, bound)
        bound_batches(spark)
        assert spark.conf.get(BATCH_BOUND) in (after, f"{after}b")
    finally:
        spark.conf.set(BATCH_BOUND, before)
