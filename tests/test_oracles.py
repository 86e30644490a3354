"""Every query that SQL can express equals its SQL; the others run and keep their invariants."""

import pytest
from oracle import agrees

from orrery.operators import rank
from orrery.registry import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    agrees(spark, QUERIES[name], ORACLE_SQL[name], D)


def test_every_sql_has_a_query():
    assert not set(ORACLE_SQL) - set(QUERIES)


def test_recalls(spark):
    for name in ("ivf_kmeans", "pq_knn", "lsh_knn", "graph_knn"):
        row = QUERIES[name](spark, D).first()
        assert 0 < row["recall"] <= 1 and row[1], name


def test_substring_dedupe_reads_whole_texts(spark, tmp_path):
    texts = {1: "\n".join(f"w{k} x." for k in range(40)) + "\nw39y z", 2: "Ab c. abc\n\n  bc d.ab", 3: None, 4: ""}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in texts.items():
        kept = []
        for p in sorted((p.strip() for p in (t or "").lower().replace("\n", ".").split(".")), key=len, reverse=True):
            if p and not any(p in q for q in kept):
                kept.append(p)
        if kept:
            want[i] = (len(kept), "|".join(kept))
    rows = rank.phrases_deduped(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert {r.doc_id: (r.kept, r.phrases) for r in rows} == want
    assert "w39y" in want[1][1]


def test_hit_rate_grows_with_tolerance(spark):
    rows = QUERIES["cache_tolerance_sweep"](spark, D).orderBy("tolerance").collect()
    assert [r["hits"] for r in rows] == sorted(r["hits"] for r in rows)


def test_of_pages_with_one_url_the_first_with_html_is_fetched(spark, tmp_path):
    pages = [(1, "u", None), (2, "u", "<p>two</p>"), (3, "u", "<p>three</p>"), (4, "v", None), (5, None, "<p>five</p>")]
    for name, rows in (("up", pages), ("down", pages[::-1])):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/{name}/pages.parquet")
    agrees(spark, QUERIES["page_fetch"], ORACLE_SQL["page_fetch"], f"{tmp_path}/up")
    both = [sorted(map(str, QUERIES["page_fetch"](spark, f"{tmp_path}/{name}").collect())) for name in ("up", "down")]
    assert both[0] == both[1]


def test_containment_searches_twice(spark):
    """A search is three maps: both sides packed, and the cells."""
    plan = QUERIES["containment_vs_m"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow run") == 6


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
