"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training progress 0..1: knots (progress, weight), linear in
between. Its integral over the whole of training is the source's mean weight and decides its share of
the budget; its running integral says how much of that share has been asked for by any moment. A
document's words fill an interval of its source's cumulative demand, in an order given by a seeded
hash; inverting the running integral at the middle of that interval gives the training position, and
the mix is range-sorted by position.

Scale: cumulative sizes come from two levels. Documents fall into slices by hash, so that even the
hottest source spreads over all slices; slices are summed by partial aggregates, the sums are
accumulated over slices, and a window accumulates inside each (source, slice) only.

Null text or no words: size 0, nothing taken. Null source: a source of its own, last in order.
Null or repeated ids: ties in the order are broken by the text's hash; fully equal rows are
interchangeable. Sources without words get target 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import common

#: Documents of one (source, slice) window, on average at most.
SLICE_ROWS = 20_000

#: Fixed values of the contract: weights of sources in order, repeating; budget and ceiling in shares of size.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CEILING = 2

#: How a weight is spread over training, by the source's place in order, repeating: knots
#: (progress, factor); each has mean 1, so the schedule integrates to the weight itself.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def integral(knots: tuple[tuple[float, float], ...]) -> list[float]:
    """The schedule's integral from 0 to each knot."""
    total = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        total.append(total[-1] + (t1 - t0) * (w0 + w1) / 2)
    return total


def inverted(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The progress at which a schedule's running integral reaches ``share`` of the whole."""
    upto = integral(knots)
    need = share * F.lit(upto[-1])
    out = F.lit(knots[-1][0])
    for k in range(len(knots) - 2, -1, -1):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope = (w1 - w0) / (t1 - t0)
        rest = need - F.lit(upto[k])
        if slope:
            step = (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        else:
            step = rest / F.lit(w0)
        out = F.when(need <= F.lit(upto[k + 1]), F.lit(t0) + step).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str, source: str, key: str, seed: int) -> DataFrame:
    """_size, _src, and _h: the hash that orders documents in their source."""
    return docs.withColumns({"_size": n_words(text), "_src": F.col(source), "_h": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), "_t": F.xxhash64(F.col(text))})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """One row a source (_src, source_size) -> + place, weight, target. Excess over the ceiling goes to the others by weight.

    Filling all sources at the rate of their weights, those with the smallest ceiling * size / weight fill
    first; the level at which the budget is used up is found from running sums in that order.
    """
    order = Window.orderBy(F.col("_src").asc_nulls_last())
    fill = Window.orderBy("_ratio", F.col("_src").asc_nulls_last())
    every = Window.partitionBy()
    w = F.array(*map(F.lit, weights))
    t = sizes.withColumn("place", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.get(w, F.col("place") % len(weights)).cast("long")).withColumn("_ratio", F.lit(ceiling) * F.col("source_size") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_full", F.coalesce(F.sum(F.lit(ceiling) * F.col("source_size")).over(before), F.lit(0)))
    t = t.withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("_budget", F.lit(budget) * F.sum("source_size").over(every))
    t = t.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    level = F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "place"))).over(every)
    t = t.withColumn("target", F.least((F.lit(ceiling) * F.col("source_size")).cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return t.select("_src", "source_size", "place", "weight", "target")


def position(words: Column) -> Column:
    """Where in training a source's demand reaches ``words``; reads target and place."""
    share = F.least(words / F.greatest(F.floor("target"), F.lit(1)), F.lit(1.0))
    out = F.lit(None).cast("double")
    for k, knots in enumerate(SHAPES):
        out = F.when(F.col("place") % len(SHAPES) == k, inverted(share, knots)).otherwise(out)
    return out


def mixed(docs: DataFrame, passing: tuple[str, ...] = (), text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """One row a document: ``passing`` columns, size, source_size, target, place, taken, readings, demand, position.

    Every document is taken target // source_size times whole; the words that remain come from the
    documents first in hash order, the one at the edge in part. taken: words, repeats counted;
    readings: times it is read; demand: its source's words before it; position: where its first
    reading stands in training (null if nothing is taken). Input columns of these names are replaced.
    """
    made = ("size", "source_size", "target", "place", "taken", "readings", "demand", "position")
    keep = [c for c in passing if c not in made]
    spark = docs.sparkSession
    base = common.stored(sized(docs, text, source, key, seed).select(*keep, "_size", "_src", "_h", "_t"), "sized")
    per = base.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    n = base.count()
    slices = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE_ROWS))
    base = base.withColumn("_slice", F.expr(f"cast(conv(substr(_h, 1, 8), 16, 10) as bigint) * {slices} div 4294967296"))  # in the order of _h
    plan = common.stored(targets(per), "targets")
    sums = base.groupBy("_src", "_slice").agg(F.sum("_size").alias("_sum"))
    upto = Window.partitionBy("_src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).select("_src", "_slice", "_offset")
    offsets = common.stored(offsets.alias("o").join(plan.alias("p"), F.col("o._src").eqNullSafe(F.col("p._src"))).select("o.*", "source_size", "place", "target"), "offsets")
    inside = Window.partitionBy("_src", "_slice").orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    same = F.col("r._src").eqNullSafe(F.col("o._src")) & (F.col("r._slice") == F.col("o._slice"))
    rows = rows.alias("r").join(offsets.alias("o"), same).select("r.*", "_offset", "source_size", "place", "target")
    rows = rows.withColumn("demand", F.col("_before") + F.col("_offset"))
    rows = rows.withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)))
    left = F.floor("target") - F.col("_whole") * F.col("source_size")
    rows = rows.withColumn("_part", F.least(F.greatest(left - F.col("demand"), F.lit(0)), F.col("_size")))
    rows = rows.withColumn("taken", F.col("_whole") * F.col("_size") + F.col("_part"))
    rows = rows.withColumn("readings", F.when(F.col("taken") > 0, F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("long"))
    first = F.col("demand") + F.when(F.col("_whole") > 0, F.col("_size")).otherwise(F.col("_part")) / 2
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(first)))
    return rows.select(*keep, F.col("_size").alias("size"), "source_size", "target", "place", "taken", "readings", "demand", "position")


def by_position(rows: DataFrame) -> DataFrame:
    """Range-sorts by position; rows that are not taken come last, spread by their demand."""
    at = F.coalesce(F.col("position"), F.lit(2.0) + F.pmod(F.hash("demand", "size"), F.lit(100_003)))
    return rows.withColumn("_at", at).repartitionByRange("_at").sortWithinPartitions("_at", "demand").drop("_at")


def curriculum(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The mix itself: a row for each reading of a document, in training order, with the columns of ``docs``.

    Documents stay whole: the reading at a source's edge counts if at least half its words are in the mix.
    """
    keep = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    named = docs.withColumnsRenamed(keep)
    m = mixed(named, tuple(named.columns), keep[text], keep[source], keep[key], seed)
    whole = F.when(F.col("size") > 0, F.expr("taken div greatest(size, 1) + cast(2 * (taken % greatest(size, 1)) >= size as bigint)")).otherwise(F.lit(0))
    m = m.withColumn("_times", whole).where("_times > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    m = m.withColumn("position", position(F.col("demand") + F.col("_k") * F.col("source_size") + F.col("size") / 2))
    return by_position(m).select(*(F.col(new).alias(old) for old, new in keep.items()))


def op4_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = by_position(mixed(docs, ("doc_id",)))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


#: The same in DuckDB, for tables whose doc_id is unique.
MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  md5('42:' || doc_id) as h from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
placed as (select *, row_number() over (order by source nulls last) - 1 as place from per),
weighed as (select *, [3, 1, 2][1 + place % 3] as weight, 2 * source_size / [3, 1, 2][1 + place % 3]::double as ratio from placed),
filled as (select *, coalesce(sum(2 * source_size) over f, 0)::double as held, (sum(weight) over () - coalesce(sum(weight) over f, 0))::double as open,
                  1.5::double * (sum(source_size) over ())::double as budget
           from weighed window f as (order by ratio, place rows between unbounded preceding and 1 preceding)),
level as (select arg_min((budget - held) / open, struct_pack(r := ratio, p := place)) as level from filled where (budget - held) / open <= ratio),
plan as (select source, source_size, place, least((2 * source_size)::double, coalesce(level, 'inf'::double) * weight) as target from filled, level),
ordered as (select d.*, source_size, place, target, coalesce(sum(size) over (partition by d.source order by h rows between unbounded preceding and 1 preceding), 0)::bigint as demand
            from d join plan on d.source is not distinct from plan.source),
whole as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as whole from ordered),
parts as (select *, least(greatest(floor(target)::bigint - whole * source_size - demand, 0), size) as part from whole),
taken as (select *, whole * size + part as taken, least((demand + case when whole > 0 then size else part end / 2.0::double) / greatest(floor(target), 1), 1.0::double) as share from parts)
select doc_id, size, source_size, target, taken::bigint as taken,
       round(case when taken > 0 then least(greatest(case place % 3
           when 0 then (sqrt(greatest(2.25::double - 2.0::double * share, 0.0)) - 1.5::double) / -1.0::double
           when 1 then share
           else (sqrt(greatest(0.25::double + 2.0::double * share, 0.0)) - 0.5::double) / 1.0::double end, 0.0), 1.0) end, 6) as position
from taken"""

QUERIES = {"op4_curriculum_mix": op4_curriculum_mix}
ORACLE_SQL = {"op4_curriculum_mix": MIX_SQL}
