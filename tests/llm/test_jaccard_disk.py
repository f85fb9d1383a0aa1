"""What the Jaccard join sends and leaves on disk: texts of likely links only, no shuffle of a step that has ended."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from llm_samples import prose

from quarrylens.llm import jaccard
from quarrylens.llm.kernels import mixed


def _chance(n):
    """Texts of one small vocabulary, which share runs of words by chance, and three near pairs."""
    draw = random.Random(11)
    rows = [(k, " ".join(draw.choice("abcdefgh") for _ in range(150))) for k in range(n)]
    for k in range(3):
        rows += [(n + 2 * k, prose(50 + k, 200)), (n + 2 * k + 1, prose(50 + k, 200) + " and more")]
    return rows


def test_texts_that_share_shingles_by_chance_are_not_sent(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(jaccard, "region_members", lambda docs, places, *a, whole=jaccard.region_members: sent.append(places) or whole(docs, places, *a))
    rows = _chance(60)
    got = {r.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 60 + 2 * ((k - 60) // 2) if k >= 60 else k for k, _ in rows}
    texts = {r.doc_id for places in sent for r in places.select("doc_id").collect()}
    assert texts >= set(range(60, 66)) and len(texts) < 20


def test_texts_of_many_near_copies_travel_in_turns(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(jaccard, "region_members", lambda docs, places, *a, whole=jaccard.region_members: sent.append(places) or whole(docs, places, *a))
    rows = [(5 * k + j, prose(70 + k, 120) + " end" * j) for k in range(12) for j in range(5)]
    got = {r.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 5 * (k // 5) for k, _ in rows}
    sizes = [places.count() for places in sent]
    assert len(sizes) > 1 and max(sizes) < sum(sizes)
    regions = [r.region for places in sent for r in places.select("region").distinct().collect()]
    assert len(regions) == len({*regions})  # a region is joined whole


def test_shuffles_end_with_the_step_that_wrote_them(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        files = disk.getAllFiles()
        return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_") and name.endswith(".data")}

    before, name = left(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = spark.conf.get(name)
    found = jaccard.set_classes(spark.createDataFrame(_chance(20), "doc_id long, text string"))
    ends = time.time() + 20
    while left() - before and time.time() < ends:  # they go in the background
        time.sleep(0.2)
    assert not left() - before
    assert spark.conf.get(name) == conf
    assert found.count() == found.count() == 26  # the result can be computed again


@pytest.mark.parametrize("percent", [50, 85])
def test_sets_as_similar_as_asked_for_are_reachable(percent):
    draw = np.random.Generator(np.random.PCG64(percent))
    for n in (1, 3, 40, 256, 700, 9000):
        base = mixed(draw.integers(0, 2**63, 2 * n, dtype=np.uint64))
        sets = [np.unique(base[draw.random(2 * n) < share]) for share in (0.4, 0.6, 0.9, 0.95, 0.97, 1)]
        sets += [np.unique(mixed(draw.integers(0, 2**63, n, dtype=np.uint64))), np.arange(n, dtype=np.uint64) << np.uint64(40)]  # one bucket
        sets = [s for s in sets if len(s)]
        got = jaccard.reachable(np.array([len(s) for s in sets]), [jaccard._buckets(s) for s in sets], percent)
        for k, a in enumerate(sets):
            shared = [len(np.intersect1d(a, b)) for b in sets]
            linked = [100 * s >= percent * (len(a) + len(b) - s) for s, b in zip(shared, sets)]
            assert got[k] or sum(linked) == 1  # itself
        if n >= 256 and percent == 85:
            assert not got[-2]


def test_one_set_alone_is_not_reachable():
    assert jaccard.reachable(np.array([5]), [jaccard._buckets(np.arange(5, dtype=np.uint64))], 85).tolist() == [False]
