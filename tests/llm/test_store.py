from tessera.llm import store
from tests.conftest import SF


def test_width_follows_bytes_not_splits(spark, tmp_path, monkeypatch):
    """One file of one split is dealt to tasks by its bytes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.rdd.getNumPartitions() == 1 and store.reduce_width(one) == 4
    monkeypatch.setattr(store, "TASK_BYTES", 10_000)
    assert store.reduce_width(one) == -(-store.input_bytes(one) // 10_000) > 20
    monkeypatch.setattr(store, "MOST_TASKS", 9)
    assert store.reduce_width(one) == 9
    assert store.reduce_width(spark.createDataFrame([], "a int")) >= 4
