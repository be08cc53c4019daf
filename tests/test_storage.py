"""Intermediates."""

from tessera import storage


def test_a_grown_driver_is_eased(spark, monkeypatch):
    """Between two intermediates, what nothing holds any more goes; a heap that has not grown is left alone."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = lambda: heap.totalMemory() - heap.freeMemory()
    monkeypatch.setattr(storage, "GROWN", 1.0)
    assert storage.ease_driver(spark) is False
    monkeypatch.setattr(storage, "GROWN", 0.0)
    monkeypatch.setattr(storage, "_after", 0)
    dropped = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.byte, 300_000_000)
    before = used()
    del dropped
    storage.discard(storage.materialize(spark.range(3), "eased"))
    assert used() < before - 250_000_000
