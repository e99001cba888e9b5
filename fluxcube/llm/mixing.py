"""Mixing sources to target weights along a curriculum.

Every source has a target of words, shared out by weight and capped at a multiple of its size, and a schedule: how its
weight changes over the training run. The integral of the schedule is the cumulative demand for its words; a document
stands in its source's stream at some cumulative word, and the inverse of the demand turns that into its position in
training. Sorting all copies by position, by range, gives the mix. Streams run in the order of a hash of the id, and
are summed up by hash bucket first, so that no task meets a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxcube.llm.common import materialize

#: Weights by the rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Relative weight of a source at the start and at the end of training, by the rank of the source, repeating; linear between.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 4  # hexadecimal digits of the hash: 65536 buckets for each source


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES) -> DataFrame:
    """`sizes(source, size)` -> `source, source_size, weight, target, rate0, rate1`, a row for each source.

    The sum of all targets is `share` of all sizes. A source's target is level * weight, but `cap` times its size at most;
    the level is found by ordering sources by where they hit their cap, which is what resharing the excess until
    nobody is above comes to. The windows here run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", pick(weights).alias("weight"), pick([s[0] for s in schedules]).alias("rate0"), pick([s[1] for s in schedules]).alias("rate1"))
    hit = F.col("source_size") * F.lit(float(cap)) / F.col("weight")
    order = Window.orderBy("hit", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cut = ranked.withColumn("hit", hit).select(
        "*",
        F.row_number().over(order).alias("k"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * F.lit(float(cap))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("free"),
    )
    level = (F.col("total") - F.col("capped")) / F.col("free")
    cut = cut.withColumn("level", level).withColumn("first", F.min(F.when(F.col("level") <= F.col("hit"), F.struct("k", "level"))).over(everything))
    target = F.least(F.coalesce(F.col("first.level"), F.lit(float("inf"))) * F.col("weight"), F.col("source_size") * F.lit(float(cap)))
    return cut.select("source", "source_size", "weight", target.alias("target"), "rate0", "rate1")


def position(done: Column, rate0: Column, rate1: Column) -> Column:
    """When a linear schedule has met the share `done` of its demand: the inverse of its integral, 0 to 1."""
    need = done * (rate0 + rate1) / 2
    slope = rate1 - rate0
    return F.when(slope == 0, need / rate0).otherwise((F.sqrt(rate0 * rate0 + 2 * slope * need) - rate0) / slope)


def plan_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each row of `docs(doc_id, source, text, ...)`: what the mix takes of it, and when.

    `row` (the row of `docs` as a struct), `doc_id, size, source_size, target, taken, copies`; `copies` is an array of
    `(epoch, words, position)`. All words of a source are taken as often as its target holds its size; of the rest,
    documents are taken in the order of the hash of their ids (without an id: of their texts), the last one cropped so that
    the target is met to the word. Null sources form a source of their own, null texts have size 0 and are taken 0 words; ties of the hash go by
    id and size. An empty table gives an empty result. Reruns agree.
    """
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # so that a null source joins like any other
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), mark.alias("mark"), F.substring(mark, 1, BUCKET_DIGITS).alias("bucket"))
    buckets = materialize(rows.groupBy("source", "key", "bucket").agg(F.sum("size").alias("size")), "mix_buckets")
    targets = source_targets(buckets, share, cap)
    # sums of sums: first over groups of buckets, then within a group, so that no task meets all buckets of a source
    so_far = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = buckets.select("source", "key", "bucket", "size", F.substring("bucket", 1, BUCKET_DIGITS // 2).alias("group"))
    groups = grouped.groupBy("key", "group").agg(F.sum("size").alias("sum")).withColumn("order", F.col("group")).select("key", "group", so_far("sum", "key").alias("group_start"))
    inside = grouped.withColumn("order", F.col("bucket")).select("source", "key", "bucket", "group", so_far("size", "key", "group").alias("in_group"))
    starts = inside.join(groups.hint("merge"), ["key", "group"]).select("source", "key", "bucket", (F.col("group_start") + F.col("in_group")).alias("bucket_start"))
    starts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.key", "b.bucket", "bucket_start", "source_size", "target", "rate0", "rate1")
    starts = materialize(starts, "mix_starts")
    within = Window.partitionBy("key", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # the window's partitioning serves the join; its other side grows with sources, so it isn't broadcast
    placed = placed.join(starts.hint("merge"), ["key", "bucket"])
    goal = F.floor(F.col("target") + 0.5).cast("long")
    begin = F.col("bucket_start") + F.col("in_bucket")
    full = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("full") * F.col("source_size") - F.col("begin")))
    placed = placed.withColumns({"goal": goal, "begin": begin, "full": full}).withColumn("rest", rest)
    when = lambda epoch: position((epoch * F.col("source_size") + F.col("begin")).cast("double") / F.col("goal"), F.col("rate0"), F.col("rate1"))
    copy = lambda epoch, words: F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), when(epoch).alias("position"))
    epochs = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0), F.col("full") - 1), lambda e: copy(e, F.col("size")))).otherwise(F.array().cast("array<struct<epoch:int,words:bigint,position:double>>"))
    copies = F.when(F.col("size") == 0, F.array().cast("array<struct<epoch:int,words:bigint,position:double>>")).otherwise(
        F.when(F.col("rest") > 0, F.concat(epochs, F.array(copy(F.col("full"), F.col("rest"))))).otherwise(epochs)
    )
    return placed.select("row", "doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("rest")).alias("taken"), copies.alias("copies"))


#: How copies stand in training: by position, ties by id and epoch.
ORDER = ("position", "doc_id", "epoch")


def in_order(copies: DataFrame) -> DataFrame:
    """`copies` range-sorted by their training position: every task gets a stretch of it, sorted."""
    return copies.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def ranked(plan: DataFrame) -> DataFrame:
    """The copies of a plan, numbered in training order from 1: `rank, position, epoch, words` and the plan's other columns.

    Stretches number their own rows; how many rows stand before a stretch is summed over one row for each stretch.
    """
    others = [c for c in plan.columns if c != "copies"]
    copies = plan.select(*others, F.explode("copies").alias("c")).select(*others, "c.epoch", "c.words", "c.position")
    own = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(in_order(copies).select("*", F.spark_partition_id().alias("stretch"), own.alias("place")), "mix_order")
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("stretch").agg(F.count("*").alias("n")).select("stretch", before.alias("before"))
    # broadcast: as many rows as the sort has partitions
    return placed.join(F.broadcast(starts), "stretch").select(*others, "epoch", "words", "position", (F.col("before") + F.col("place") + 1).alias("rank"))


def source_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each row of `docs`: `doc_id, size, source_size, target, taken, n_copies, first_position, first_rank`, where
    nothing is taken null and 0; counted from the copies as they stand in training order."""
    plan = plan_mix(docs, share, cap).select(F.monotonically_increasing_id().alias("id"), "doc_id", "size", "source_size", "target", "copies")
    plan = materialize(plan, "mix_plan")  # without texts
    first = F.min_by(F.struct("position", "rank"), "epoch")
    taken = ranked(plan.select("id", "doc_id", "copies")).groupBy("id").agg(F.sum("words").alias("taken"), F.count("*").alias("n_copies"), first.alias("first"))
    found = plan.select("id", "doc_id", "size", "source_size", "target").join(taken.hint("merge"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("doc_id", "size", "source_size", "target", zero("taken"), zero("n_copies"), F.col("first.position").alias("first_position"), F.coalesce("first.rank", F.lit(0)).cast("long").alias("first_rank"))


def digest(found: DataFrame) -> DataFrame:
    return found.withColumns({"target": F.round("target", 6), "first_position": F.round("first_position", 6)})


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, position: str | None = None) -> DataFrame:
    """The mixed documents, with the columns of `docs`, sorted by training position: a row for each copy taken.

    Row order doesn't outlive a shuffle; with `position` the training position is added as a last column of that name.
    A cropped copy holds its first words, joined by single spaces, and its number of characters in `n_chars` if there is
    such a column.
    """
    out = plan_mix(docs, share, cap).select("row", "size", "doc_id", F.explode("copies").alias("copy")).select("row", "size", "doc_id", "copy.*")
    cropped = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    partial = F.col("words") < F.col("size")
    columns = {c: F.col("row")[c] for c in docs.columns}
    columns["text"] = F.when(partial, cropped).otherwise(F.col("row.text"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(partial, F.length(cropped).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    if position:
        columns[position] = F.col("position")
    return in_order(out).select(*[c.alias(k) for k, c in columns.items()])


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), "text", '')) as mark from documents
), s as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as r from d group by source
), w as (
  select source, cast(source_size as double) as z, (case r % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end)::double as weight,
    (case r % 3 when 0 then 1.5 when 1 then 1.0 else 0.5 end)::double as rate0, (case r % 3 when 0 then 0.5 when 1 then 1.0 else 1.5 end)::double as rate1 from s
), h as (select *, z * 2.0::double / weight as hit from w
), c as (
  select *, row_number() over o as k, sum(z) over () * 1.5::double as total, coalesce(sum(z * 2.0::double) over (o rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (o rows between current row and unbounded following) as free
  from h window o as (order by hit, source nulls last)
), l as (select arg_min((total - capped) / free, k) as level from c where (total - capped) / free <= hit
), t as (select source, cast(z as bigint) as source_size, least(level * weight, z * 2.0::double) as target, rate0, rate1 from c, l
), p as (
  select d.*, t.source_size, t.target, t.rate0, t.rate1, cast(floor(t.target + 0.5) as bigint) as goal,
    coalesce(sum(size) over (partition by d.source order by mark, doc_id, size rows between unbounded preceding and 1 preceding), 0) as begin_
  from d join t on d.source is not distinct from t.source
), q as (select *, case when source_size > 0 then goal // source_size else 0 end as full_ from p
), x as (select *, greatest(0, least(size, goal - full_ * source_size - begin_)) as rest from q
), y as (
  select *, case when size = 0 then 0 else full_ + (rest > 0)::int end as n_copies, row_number() over () as id from x
), e as (
  select id, doc_id, epoch, case when epoch < full_ then size else rest end as words, rate0, rate1 - rate0 as slope,
    cast(epoch * source_size + begin_ as double) / nullif(goal, 0) * (rate0 + rate1) / 2 as need
  from (select *, unnest(range(cast(n_copies as bigint))) as epoch from y)
), o as (select *, case when slope = 0 then need / rate0 else (sqrt(rate0 * rate0 + 2 * slope * need) - rate0) / slope end as position from e
), r as (select *, row_number() over (order by position, doc_id, epoch) as rank from o
), m as (select id, cast(sum(words) as bigint) as taken, count(*) as n_copies, arg_min(position, epoch) as position, arg_min(rank, epoch) as rank from r group by id
)
select doc_id, size, source_size, round(target, 6) as target, coalesce(taken, 0) as taken, coalesce(m.n_copies, 0) as n_copies, round(position, 6) + 0.0 as first_position, coalesce(rank, 0) as first_rank
from y left join m using (id)
"""
