import threading

from ledgerloom.llm.scratch import mark, sweep, written


def test_a_sweep_leaves_other_threads_tables(spark):
    """Two queries at once: one sweeps all that it made while the other still needs its own."""
    made, swept, found = threading.Event(), threading.Event(), []

    def other():
        table = written(spark.range(10), "other")
        made.set()
        assert swept.wait(60)
        found.append(table.count())

    start = mark()
    mine = written(spark.range(3), "mine")
    thread = threading.Thread(target=other)
    thread.start()
    assert made.wait(60)
    kept = written(mine.filter("id > 0"), "kept")
    sweep(spark, start)
    swept.set()
    thread.join()
    assert found == [10] and kept.count() == 2 and mark() == start + 1
