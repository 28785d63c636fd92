import glob
import time

import pytest

from panelforge.llm import common, phrases, substrings


@pytest.fixture
def rested(monkeypatch):
    monkeypatch.setattr(common, "_rested", [float("-inf")] * 2)


def test_a_cut_leaves_no_shuffle_files(spark, rested):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}

    before = files()
    out = common.durable(spark.range(1000).repartition(3, "id"))
    end = time.monotonic() + 10
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 1000


def test_executors_collect_too(spark, rested):
    def collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if b.getName() != "G1 Young Generation")

    before = collections()
    common.rest(spark)
    assert collections() - before > 1  # the tasks', then the driver's
    before = collections()
    common.rest(spark)
    assert collections() == before  # not again so soon


@pytest.mark.parametrize("remove", [phrases.remove_phrases, substrings.remove_substrings])
def test_regions_are_dealt_once(documents, monkeypatch, remove):
    plans, durable = [], common.durable

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df)

    monkeypatch.setattr(common, "durable", cut)
    text = " ".join(f"some{i} words{i}" for i in range(90))
    remove(documents([(1, text), (2, text), (3, text)]))
    regions = [p for p in plans if "region#" in p]
    assert len(regions) == 1 and regions[0].count("Exchange hashpartitioning(a#") == 1
