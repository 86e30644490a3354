"""Line dedup against brute force: edge rows, any batches and levels, ties, clashing names."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import lines
from test_llm_operators import D, edge_docs, empty_docs, prose

LONG = "This line is the license of many a document here."


def brute(rows):
    """(id, text) to the multiset of (id, n_lines, n_dropped, kept text)."""
    holders = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    order = lambda i: (i is not None, i or 0)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(order(i))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(holders[key(x)]) < 5 or max(holders[key(x)]) == order(i)]
        out.append((order(i), len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


def rows_of(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_lines"], r["n_dropped"], r["text"] or "") for r in df.collect())


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (6, 3), (9, 2)])
def test_equals_brute_force(spark, batches, fanout):
    more = [(k, f"{prose(k, 12)}\n {LONG.upper()}\t\n{LONG}\r\n{'é' * 39}\n{'é' * 40} {k % 2}\n{prose(k % 9, 14)}", "en", "s", 0) for k in range(20, 60)]
    more += [(59, LONG, None, None, 0), (None, LONG, None, None, 0), (None, LONG, None, None, 0), (-3, LONG + "\n" + LONG, None, None, 0)]
    docs = edge_docs(spark, *more)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[2] for r in want) > 100
    assert rows_of(lines.deduped(docs, batches=batches, fanout=fanout)) == want


def test_rows_without_id_are_one_document(spark):
    docs = spark.createDataFrame([*[(None, LONG)] * 9, *[(k, LONG) for k in range(3)]], "doc_id long, text string")
    assert sum(r["n_dropped"] for r in lines.deduped(docs).collect()) == 0
    docs = docs.union(spark.createDataFrame([(3, LONG)], "doc_id long, text string"))
    assert sorted((r["doc_id"] or -1, r["n_dropped"]) for r in lines.deduped(docs).collect() if r["n_dropped"] == 0) == [(3, 0)]


def test_settled_rows_are_not_written_again(spark):
    runs = lines.Runs(spark, fanout=4)
    for ids in (range(10, 20), range(10)):
        runs.add(spark.createDataFrame([(k, b"x") for k in ids], "doc long, line binary"))
    assert [t.count() for t in runs.tables()] == [1, 0]
    runs.add(spark.createDataFrame([(99, b"x")], "doc long, line binary"))  # larger than what settled it
    assert runs.repeated().collect() == [(b"x", 99)]
    runs.add(spark.createDataFrame([(1, b"y")], "doc long, line binary"))
    assert [len(x) for x in runs.levels] == [0, 1] and runs.repeated().count() == 1
    plan = runs.fresh(spark.createDataFrame([(b"x", 1, 2)], "line binary, docs long, last long"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(_line") == 0  # a run is not shuffled
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("orrery_run")]


def test_columns_pass_through(spark):
    docs = edge_docs(spark).withColumns({"n_lines": F.lit("mine"), "_gone": F.lit(1), "_doc": F.lit(2), "N_Dropped": F.lit("too")})
    out = lines.deduped(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped_"] and out.count() == docs.count()
    assert out.where("n_lines <> 'mine' or _gone <> 1").count() == 0
    assert out.where("doc_id = 1").first()["text"] is None


def test_empty_table(spark):
    assert lines.deduped(empty_docs(spark)).count() == 0


def test_settings_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "777")
    lines.op11_line_runs(spark, D).count()
    assert spark.conf.get(name) == "777"
    spark.conf.set(name, before)
