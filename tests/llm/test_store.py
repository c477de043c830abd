import time

from strandline.llm.store import CLEAN_UP, written


def test_the_shuffles_of_a_write_go_with_it(spark):
    def shuffles():
        blocks = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}

    d = spark.range(1000).selectExpr("id % 7 as a", "id as b")
    d = d.repartition(5, "b").groupBy("a").count().join(d, "a")
    before, setting = shuffles(), spark.conf.get(CLEAN_UP, None)
    out = written(d, "store_test")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left, left
    assert spark.conf.get(CLEAN_UP, None) == setting
    assert out.count() == d.count() == 1000
