"""Bounded agent loops: search, read, follow, and stop at a cap, at a repeat, or when nothing new is found; and a tree of refined queries.

Nothing is searched ahead of time. A round searches from the places that its active items have just reached, each
place once over all rounds and items; what a search found is kept beside the state, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.vectors import IP, embeddings, top_k
from orrery.sources.scratch import Scratch
from orrery.sources.tables import table

#: Turns and searches of one item at most.
TURNS, SEARCHES = 10, 5

#: From rows (at) to (at, rank, doc_id, score): what a search from each place finds.
Search = Callable[[DataFrame], DataFrame]


class Searched:
    """The hits of all places that were asked for so far."""

    def __init__(self, scratch: Scratch, search: Search) -> None:
        self.scratch, self.search, self.hits, self.asked = scratch, search, None, None

    def of(self, places: DataFrame) -> DataFrame:
        """The hits, once those of ``places`` (at) are among them."""
        new = places.select("at").distinct()
        if self.asked is not None:
            new = new.join(self.asked, "at", "left_anti")
        new = self.scratch.stored(new, "places")
        if self.asked is None or not new.isEmpty():
            found = self.scratch.stored(self.search(new), "hits")
            self.hits = found if self.hits is None else self.hits.union(found)
            self.asked = new if self.asked is None else self.asked.union(new)
        return self.hits


def agent_loop(search: Search, items: DataFrame, searches: int = SEARCHES, turns: int = TURNS) -> DataFrame:
    """(qid, read, finish): what each item's agent read, in order.

    An agent searches from what it read last, reads the best hit that it has not read, and goes on. It ends at
    ``searches`` ("limit"), at ``turns`` ("turns"), or when every hit was read before ("repeat"). Only items that go
    on take part in a round, and only their places are searched from.
    """
    with Scratch(items.sparkSession) as s:
        searched = Searched(s, search)
        state = items.select("qid", F.col("qid").alias("at"), F.array("qid").alias("read"), F.lit(None).cast("string").alias("finish"))
        for turn in range(min(searches, turns)):
            going = state.where("finish is null")
            if going.isEmpty():
                break
            hits = searched.of(going)
            best = going.join(hits, "at").where(~F.array_contains("read", F.col("doc_id"))).groupBy("qid").agg(F.min_by("doc_id", "rank").alias("next"))
            last = "limit" if turn + 1 == searches else "turns" if turn + 1 == turns else None
            moved = going.join(best, "qid", "left").select(
                "qid", F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNull(), F.col("read")).otherwise(F.array_append("read", F.col("next"))).alias("read"),
                F.when(F.col("next").isNull(), F.lit("repeat")).otherwise(F.lit(last)).cast("string").alias("finish"),
            )
            state = s.stored(state.where("finish is not null").union(moved), "agents")
        return s.kept(state.select("qid", F.slice("read", 2, turns).alias("read"), F.coalesce("finish", F.lit("limit")).alias("finish")))


def refinement_tree(search: Search, items: DataFrame, expansions: int = 3, depth: int = 3) -> DataFrame:
    """(qid, answer, confidence): each item (qid) is refined ``expansions`` ways, ``depth`` times over; the answer with the best mean score along its path, smaller answers on ties.

    An item makes expansions ** depth paths at most, and one row of the result.
    """
    with Scratch(items.sparkSession) as s:
        searched = Searched(s, search)
        paths = items.select("qid", F.col("qid").alias("at"), F.lit(0.0).alias("total"), F.lit(0).alias("steps"))
        every = None
        for _ in range(depth):
            step = searched.of(paths).where(F.col("rank") <= expansions)
            paths = s.stored(paths.join(step, "at").select("qid", F.col("doc_id").alias("at"), (F.col("total") + F.col("score")).alias("total"), (F.col("steps") + 1).alias("steps")), "paths")
            every = paths if every is None else every.union(paths)
        every = every.withColumn("confidence", F.round(F.col("total") / F.col("steps"), 6))
        best = Window.partitionBy("qid").orderBy(F.desc("confidence"), "at")
        each = every.groupBy("qid", "at").agg(F.max("confidence").alias("confidence"))
        return s.kept(each.withColumn("r", F.row_number().over(best)).where("r = 1").select("qid", F.col("at").alias("answer"), "confidence"))


def vector_search(e: DataFrame, k: int) -> Search:
    """Exact search by inner product from the vectors (id, v) of the places; a vector does not find itself."""
    return lambda places: top_k(e.join(places.select(F.col("at").alias("id")), "id", "left_semi"), e, k, same=True).withColumnRenamed("qid", "at")


def q_agent_loop(spark, d):
    e = embeddings(spark, d).select("id", "v")
    r = agent_loop(vector_search(e, 5), e.select(F.col("id").alias("qid")))
    return r.select("qid", F.array_join(F.col("read").cast("array<string>"), ",").alias("read"), "finish")


def q_refinement_tree(spark, d):
    e = embeddings(spark, d).select("id", "v")
    return refinement_tree(vector_search(e, 3), e.select(F.col("id").alias("qid")))


def q_example_finder(spark, d):
    """Questions whose first answer asks for a search: here, whose first reply holds a given word."""
    c = table(spark, d, "conversations")
    asks = c.where((F.col("turn") == 1) & F.contains(F.lower("text"), F.lit("that")))
    return c.where("turn = 0").join(asks.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.md5("text").alias("question_md5"))


QUERIES = {"agent_loop": q_agent_loop, "refinement_tree": q_refinement_tree, "example_finder": q_example_finder}
ORACLE_SQL = {
    "agent_loop": IP.replace("with e", "with recursive e", 1) + """, h as (select qid as src, rank, doc_id from r where rank <= 5),
w as (select id as qid, id as at, [id] as seen, 0 as turn from e
      union all
      select qid, arg_min(doc_id, rank) as at, list_append(any_value(seen), arg_min(doc_id, rank)) as seen, any_value(turn) + 1 as turn
      from (select w.qid, w.seen, w.turn, h.doc_id, h.rank from w join h on h.src = w.at where w.turn < 5 and not list_contains(w.seen, h.doc_id)) group by qid)
select qid, array_to_string(arg_max(seen, turn)[2:], ',') as read, case when max(turn) = 5 then 'limit' else 'repeat' end as finish from w group by qid""",
    "refinement_tree": IP + """, h as (select qid as src, doc_id, round(s, 6) as score from r where rank <= 3),
p1 as (select src as qid, doc_id as node, score as total from h), p2 as (select qid, doc_id as node, total + score as total from p1 join h on h.src = p1.node), p3 as (select qid, doc_id as node, total + score as total from p2 join h on h.src = p2.node),
a as (select qid, node, round(total, 6) as c from p1 union all select qid, node, round(total / 2, 6) from p2 union all select qid, node, round(total / 3, 6) from p3)
select qid, node as answer, max(c) as confidence from a group by qid, node qualify row_number() over (partition by qid order by max(c) desc, node) = 1""",
    "example_finder": "select conv_id, md5(text) as question_md5 from conversations c where turn = 0 and exists (select 1 from conversations b where b.conv_id = c.conv_id and b.turn = 1 and contains(lower(b.text), 'that'))",
}
