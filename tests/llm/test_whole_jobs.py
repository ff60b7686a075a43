"""Jobs that must be whole at every size and layout."""

import numpy as np
import pytest

from weftgraph.llm import lang_id, near_dup, url_filter


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_near_copies_meet_across_ranges(spark, many_partitions):
    """Twenty texts in 200 ranges: nearly every range has one row of the forest."""
    dice = np.random.RandomState(7)
    rows = []
    for k in range(10):
        words = [f"w{x}" for x in dice.randint(0, 10**6, 120)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, over=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: d - d % 2 for d, _ in rows}


def test_rules_use_every_part_of_a_url(spark):
    """A deep segment, a late query key, a value and a site name behind changing subdomains block."""
    dice = np.random.RandomState(9)
    bad = [
        lambda k: f"http://h{k}.com/a/b/c/spam/{k}",
        lambda k: f"http://h{k}.com/a?a=1&b=2&c=3&zz={k}",
        lambda k: f"http://h{k}.com/a?a=casino",
        lambda k: f"http://{'mw'[k % 2]}{k}.casino-win.example{k}.org/a",
    ]
    good = lambda k: f"http://h{k}.com/a/b/c/{'xyz'[k % 3]}?a={'opq'[k % 3]}&b=2&c=3"
    rows = [(dice.choice(bad)(k), True) if k % 4 == 0 else (good(k), False) for k in range(400)]
    rules = url_filter.mined(spark.createDataFrame(rows, "url string, blocked boolean"), support=0.02)
    urls = [f(k) for f in bad for k in (1001, 1002)] + [bad[1](1003).replace("?", "?0=1&1=1&2=1&")]
    fine = [good(1004), good(1005)]
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls + fine], "url string"), [("allow", "none.test/")], rules)
    assert {r["url"]: r["verdict"] for r in got.select("row.url", "verdict").collect()} == {u: "block" for u in urls} | {u: "allow" for u in fine}


def test_rare_languages_are_learned(spark):
    rows = [(k, f"common word{k % 7}", "aabb"[k % 2 * 2 :][:2]) for k in range(3000)]
    rows += [(5000 + k, f"rare term{k}", f"r{k % 3}") for k in range(9)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=50, each=10)
    assert model["languages"] == ["aa", "bb", "r0", "r1", "r2"]
