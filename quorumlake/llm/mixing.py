"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import documents, dropped, partition_keys, shuffle_partitions, spare, written

#: ``[^\x20\x09-\x0D]+`` as Java reads it.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK_WORDS = 256
#: Hex digits of a document's hash that make its shuffle bucket: a source is ordered by (bucket, hash, doc_id), so no
#: task sorts a whole one.
BUCKET_DIGITS = 3
SLOT_BLOCK = 1 << 14
GRID = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target): water-filling of the total under ``max_epochs`` times each source's size.

    ``sizes`` has (source, size). Sources go by code point, null last, and weigh ``weights`` in turn. Capped sources'
    excess is shared again by weight until none is above: with sources by cap/weight, the level is the first that the
    next cap does not undercut. The table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    per = per.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    per = per.withColumn("free_level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything).getField("level"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("free_level"), F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, slot, rank, need): slots of the mix in order, each a block of ``block_words`` words of one source.

    Slot i is the van der Corput point of i (its bits mirrored), mapped through the sources' cumulative targets; a
    source's slots are ranked, and ranks that its whole target does not need are dropped; ranks that the points leave
    open by their discrepancy (a few per source) are appended. Points meet sources over a grid of GRID cells by an
    equi-join; ranks come from counts per (source, slot block), so no task ranks a whole source.
    """
    spark = targets.sparkSession
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = targets.where("target > 0").withColumn("words", F.round("target").cast("long")).where("words > 0")
    t = t.withColumn("need", F.ceil(F.col("words") / block_words).cast("long")).withColumn("high", F.sum("target").over(order) / F.sum("target").over(everything))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    t = t.withColumn("low", F.coalesce(F.lag("high").over(in_order), F.lit(0.0))).withColumn("last", F.lead("high").over(in_order).isNull())
    t = written(t.select("source", "source_size", "words", "need", "low", F.when(F.col("last"), F.lit(2.0)).otherwise(F.col("high")).alias("high")), "targets")
    n = t.agg(F.sum("need")).first()[0] or 0
    bits = F.bin("slot")
    point = F.conv(F.reverse(bits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(bits))
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * GRID).cast("long"))
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * GRID).cast("long") - 1, F.least(F.floor(F.col("high") * GRID).cast("long"), F.lit(GRID)) + 1)))
    hit = points.join(cells, "cell").where("point >= low and point < high").select("source", "slot", "need", F.floor(F.col("slot") / SLOT_BLOCK).alias("sb"))
    counts = hit.groupBy("source", "sb").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("sb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("source", "sb").orderBy("slot")) - 1)
    ranked = ranked.join(base.select(F.col("source").alias("s2"), F.col("sb").alias("b2"), "base"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("sb") == F.col("b2")))
    ranked = ranked.withColumn("rank", F.col("r") + F.col("base")).where("rank < need").select("source", "slot", "rank")
    got = base.groupBy("source").agg(F.sum("n").alias("got"))
    open_ = t.join(got.withColumnRenamed("source", "s2"), t["source"].eqNullSafe(F.col("s2")), "left").where("coalesce(got, 0) < need")
    rest = open_.select("source", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("need") - 1)).alias("rank"))
    rest = rest.select("source", (F.lit(n) + F.col("rank")).alias("slot"), "rank")
    info = t.select(F.col("source").alias("s3"), "source_size", "words")
    slots = ranked.union(rest)
    return slots.join(info, slots["source"].eqNullSafe(F.col("s3"))).drop("s3")


def tape(docs: DataFrame, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Adds ``tape_from`` to (doc_id, name, source, size): words of the source's documents, shuffled by the hash of doc_id
    (of ``name`` where there is none), before this one."""
    d = docs.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("name").cast("string"))))).withColumn("bucket", F.substring("h", 1, digits))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "name").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base")
    d = d.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    return d.withColumn("tape_from", F.col("inner") + F.col("base")).drop("s2", "b2", "base", "inner", "h", "bucket")


def row_name() -> Column:
    """A hash that equal (doc_id, text, source) share."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")), "source")


def laps(docs: DataFrame, block_words: int, weights: tuple[float, ...], max_epochs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the schedule's blocks read, as (laps, rows, targets).

    A source's documents, shuffled by hash, form a tape of words; scheduled slot r of the source reads the tape's words
    [r * block, (r + 1) * block), cyclically; its last slot is cut so that each source gives its rounded target. ``laps``
    (source, tape_from, lap, words, slot) has, for each document and round of the tape, the words that blocks read there
    and the slot of the first of these blocks; ``rows`` (doc_id, name, source, size, tape_from) all documents, those of
    no words without a place on the tape.
    """
    sized = docs.select("doc_id", row_name().alias("name"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "sizes")
    targets = written(source_targets(sized, weights, max_epochs), "mix-targets")
    slots = schedule(targets, block_words)
    start = F.col("rank") * block_words
    end = F.least((F.col("rank") + 1) * block_words, F.col("words"))
    turns = F.sequence(F.floor(start / F.col("source_size")).cast("long"), F.floor((end - 1) / F.col("source_size")).cast("long"))
    piece = slots.withColumn("lap", F.explode(turns)).select(
        "source", "slot", "lap", F.greatest(start - F.col("lap") * F.col("source_size"), F.lit(0)).alias("p0"), F.least(end - F.col("lap") * F.col("source_size"), F.col("source_size")).alias("p1")
    )
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block_words).cast("long"), F.floor((F.col(b) - 1) / block_words).cast("long")))
    piece = piece.withColumn("cell", cells("p0", "p1")).withColumnRenamed("source", "s2").withColumnRenamed("cell", "c2")
    rows = written(tape(sized.where("size > 0")).union(sized.where("size = 0").withColumn("tape_from", F.lit(None).cast("long"))), "tape")
    dropped(sized)
    on_tape = rows.where("tape_from is not null").withColumn("tape_to", F.col("tape_from") + F.col("size"))
    spread = on_tape.select("source", "tape_from", "tape_to", cells("tape_from", "tape_to").alias("cell"))
    met = spread.join(piece, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2")))
    low, high = F.greatest("tape_from", "p0", F.col("cell") * block_words), F.least("tape_to", "p1", (F.col("cell") + 1) * block_words)
    met = met.withColumn("words", high - low).where("words > 0")
    return met.groupBy("source", "tape_from", "lap").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")), rows, targets


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot): one row per row of ``docs`` (doc_id, text, source).

    ``taken`` counts the document's words in all blocks of its source, ``first_slot`` is the slot of the mix in which the
    first of them stands (null if none does); see ``laps``. A null or empty text has size 0 and gives nothing; a null
    source is a source of its own; an empty table gives an empty result; repeated rows are rows of their own.
    """
    took, rows, targets = laps(docs, block_words, weights, max_epochs)
    took = took.groupBy(F.col("source").alias("s2"), F.col("tape_from").alias("t2")).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    full = rows.join(took, F.col("source").eqNullSafe(F.col("s2")) & (F.col("tape_from") == F.col("t2")), "left").drop("s2")
    info = targets.select(F.col("source").alias("s2"), "source_size", "target")
    out = full.join(info, F.col("source").eqNullSafe(F.col("s2")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix as documents, in its order, with the columns of ``docs``: a copy of a row for each round of the tape in
    which blocks read half of it at least, sorted by the slot of its first block (files in order, rows in order inside).

    Rows that the mix takes less of go, empty texts among them. Only a source's last block can cut a document, so that a
    source's copies miss its target by half of one of its documents, and a word, at most. Rows that are equal in id,
    text and source stand for each other: one of them gives the copies of all.
    """
    took, rows, _ = laps(docs, block_words, weights, max_epochs)
    named = rows.select("doc_id", "name", "source", "size", "tape_from").withColumnRenamed("source", "s2").withColumnRenamed("tape_from", "t2")
    own, ident, name, source, slot, part = (spare(docs.columns, "_mix") + c for c in ("own", "id", "name", "source", "slot", "part"))
    copies = took.join(named, F.col("source").eqNullSafe(F.col("s2")) & (F.col("tape_from") == F.col("t2"))).where("2 * words >= size")
    copies = written(copies.select(F.col("doc_id").alias(ident), F.col("name").alias(name), F.col("s2").alias(source), F.col("slot").alias(slot)), "copies")
    several = written(rows.where("size > 0").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("name").alias(own)).coalesce(1), "several")
    texts = docs.withColumn(own, row_name())
    if not several.isEmpty():
        twins = texts.join(several, own, "left_semi").dropDuplicates(["doc_id", "text", "source"])
        texts = texts.join(several, own, "left_anti").select(*texts.columns).union(twins.select(*texts.columns))
    found = texts.join(copies, (F.col(own) == F.col(name)) & F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source)))
    last = copies.agg(F.max(slot)).first()[0] or 0
    n = shuffle_partitions(docs.sparkSession)
    key = F.element_at(F.array(*map(F.lit, partition_keys(docs.sparkSession, n))).cast("array<bigint>"), F.floor(F.col(slot) * n / (last + 1)).cast("int") + 1)
    return found.withColumn(part, key).repartition(n, part).sortWithinPartitions(slot, name).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot), a row for each row; see ``mix``. The windows over sources have
    a row for each source, a table that is small by definition."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: Blocks together read a source's first round(target) words of the cyclic tape; block r of the tape has the slot of the
#: source's r-th van der Corput point, those that the points leave open follow.
OP10_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight, 3 * source_size as cap from s),
l as (select *, ((select sum(source_size) from s) - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following))::double as level from w),
f as (select (select level from l where level * weight <= cap order by cap / weight, level limit 1) as free),
t as (select source, source_size, least(cap::double, coalesce(f.free, 'infinity'::double) * weight) as target from l, f),
p as (select d.*, t.source_size, t.target, round(t.target)::bigint as words, coalesce(sum(size) over (partition by d.source order by md5(doc_id::varchar), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as a
  from d join t on d.source is not distinct from t.source),
q as (select source, ceil(round(target) / 256)::bigint as need, sum(target) over (order by source is null, source) / sum(target) over () as high from t where round(target) > 0),
b as (select source, need, coalesce(lag(high) over (order by source is null, source), 0) as low, case when lead(high) over (order by source is null, source) is null then 2 else high end as high from q),
c as (select i as slot, list_sum(list_transform(range(0, 40), lambda k: ((i >> k) & 1) * pow(0.5, k + 1))) as x from range(0, coalesce((select sum(need) from q), 0)::bigint) r(i)),
h as (select b.source, b.need, slot, row_number() over (partition by b.source order by slot) - 1 as r from c join b on x >= low and x < high),
k as (select source, r, slot from h where r < need
  union all select b.source, x.r, (select sum(need) from q)::bigint + x.r from b left join (select source, count(*) as got from h group by 1) g on g.source is not distinct from b.source, lateral (select unnest(range(coalesce(got, 0), b.need)) as r) x)
select doc_id, size, source_size, target, case when size = 0 then 0 else words // source_size * size + greatest(0, least(a + size, words % source_size) - least(a, words % source_size)) end::bigint as taken, k.slot::bigint as first_slot
from p left join k on k.source is not distinct from p.source and k.r = p.a // 256 and p.size > 0 and p.a < p.words
"""
