from glyphmill.llm import session
from glyphmill.llm.graph import components


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_steps_give_the_drivers_garbage_back(spark, monkeypatch):
    monkeypatch.setattr(session, "RELIEF_S", 0, raising=False)
    monkeypatch.setattr(session, "HEAP_SHARE", 0, raising=False)
    before = full_collections(spark)
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(1, 1), (2, 1), (3, 1)]
    assert full_collections(spark) >= before + 3  # one for each checkpoint at least


def test_a_small_heap_is_left_alone(spark, monkeypatch):
    monkeypatch.setattr(session, "RELIEF_S", 0)
    monkeypatch.setattr(session, "HEAP_SHARE", 1)
    before = full_collections(spark)
    assert session.checkpointed(spark.range(3)).count() == 3
    assert full_collections(spark) == before
