"""Transactions of an interleaved log: which changes survive savepoints and aborts, by minima of blocks; the store by epochs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import counted, documents, dropped, written

#: A block has 2^BITS places, as has a block of blocks: no window and no group of a search is longer (but for records
#: that share an id).
BITS = 8
COMMITS_PER_EPOCH = 64
KEYS = 30_000
#: The height of a record that ends its transaction: every change dips there.
GROUND = -(1 << 62)
COMMIT, ABORT, SAVEPOINT, ROLLBACK, CHANGE = range(5)
#: What the remainder of a record's hash by 17 means.
ACTS = [COMMIT, COMMIT, ABORT, SAVEPOINT, SAVEPOINT, ROLLBACK, ROLLBACK, *[CHANGE] * 10]
#: A key without a value.
GONE = -1


def hashed(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def act(doc_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTS)), (hashed(doc_id) % 17 + 1).cast("int"))


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, src, tie, act, key, value) of ``docs`` (doc_id, text, source) and ``labels`` (doc_id, toxic): the log.
    ``value`` is the crc32 of the stored ``key:text``, GONE where the key is deleted."""
    key = (F.floor(hashed(F.col("doc_id")) / 100) % KEYS).cast("int")
    value = F.coalesce(F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text"))), F.lit(GONE))
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    log = docs.where("doc_id is not null").select("doc_id", src.alias("src"), F.xxhash64("text").alias("tie"), act(F.col("doc_id")).alias("act"), key.alias("key"), value.alias("value"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("bad")).distinct()
    log = log.join(toxic, F.col("doc_id") == F.col("bad"), "left")
    return log.withColumn("value", F.when(F.col("bad").isNotNull(), F.lit(GONE)).otherwise(F.col("value"))).drop("bad")


def before(rows: DataFrame, keys: list[str], at: str, span: tuple[int, int], sums: tuple[str, ...] = (), lasts: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<name>_before``: the sum (for ``lasts``: the last value, null if there is none) over the rows of ``keys`` that
    are earlier by (``at``, ``order``). All of ``at`` is in ``span``.

    A window reaches over a block of 2^BITS values of ``at``; what is before a block comes from the blocks' totals in the
    same way, level by level, until one block holds all. So no task sees more than a block of a key, whatever its share.
    """
    low, high = span
    whole = high - low < 1 << BITS
    block = F.shiftright(at, BITS)
    inside = Window.partitionBy(*keys, *([] if whole else [block])).orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    inner = {c: F.sum(c).over(inside) for c in sums} | {c: F.last(c, ignorenulls=True).over(inside) for c in lasts}
    out = rows.withColumns({f"{c}_before": F.coalesce(w, F.lit(0).cast("long")) if c in sums else w for c, w in inner.items()})
    if whole:
        return out
    totals = rows.groupBy(*keys, block.alias(at)).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, at).alias(c) for c in lasts])
    upper = before(totals, keys, at, (low >> BITS, high >> BITS), sums, lasts).select(*keys, F.col(at).alias("_block"), *[F.col(f"{c}_before").alias(f"_{c}") for c in (*sums, *lasts)])
    out = out.withColumn("_block", block).join(upper, [*keys, "_block"])
    out = out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in sums} | {f"{c}_before": F.coalesce(f"{c}_before", f"_{c}") for c in lasts})
    return out.select(*rows.columns, *[f"{c}_before" for c in (*sums, *lasts)])


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, in tables that hold all rows of each of their groups."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = None
        for k in keys:
            same = pc.equal(table[k], table[k][-1])
            last = same if last is None else pc.and_(last, same)
        cut = pc.index(last, True).as_py()
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _first_below(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``hit`` to the rows that ask: the tag of the first later row of the group (src, grp) that is lower."""
    top = np.iinfo(np.int64).max
    for table in whole_groups(batches, ["src", "grp"]):
        n, ask, h = len(table), table["ask"].to_numpy(), table["low"].to_numpy()
        src = table["src"].combine_chunks().dictionary_encode().indices.to_numpy()
        grp = table["grp"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (grp[1:] != grp[:-1])])
        sizes = np.diff(np.r_[starts, n])
        ends = np.repeat(starts + sizes, sizes)
        least = [np.where(ask == 1, top, h)]
        while 1 << len(least) <= sizes.max():
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        i = np.flatnonzero(ask > 0)
        j, end, h = i + 1, ends[i], h[i]
        for k in range(len(least) - 1, -1, -1):
            fits = j + (1 << k) <= end
            step = fits & (least[k][np.where(fits, j, 0)] >= h)
            j = j + (step << k)
        found = j < end
        hit = table["tag"].combine_chunks().take(pa.array(np.where(found, np.minimum(j, n - 1), 0), mask=~found))
        yield from table.take(pa.array(i)).append_column("hit", hit).combine_chunks().to_batches()


def first_below(rows: DataFrame) -> DataFrame:
    """The rows of (src, grp, at, low, tag, ask, ...) with ``ask`` > 0, and ``hit``: the tag of the first row after them by
    ``at`` in (src, grp), ``ask`` not 1, with a lower ``low``. Rows with ``ask`` 2 can be found themselves."""
    placed = rows.repartition("src", "grp").sortWithinPartitions("src", "grp", "at", "ask")
    return placed.mapInArrow(_first_below, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", hit long")


def dips(placed: DataFrame, last: int) -> DataFrame:
    """Adds ``hit`` to the changes of (src, pos, low, doc_id, act, ...): the doc_id of the first later record of their
    source that is lower than they (null: none). Places of a source run from 0 to ``last`` at most.

    A change looks through its own block first. Then each block asks once for each height that it left open: of its
    siblings' minima, the first that dips below; if none does, of its parent's siblings; from the block of blocks that
    is found the search goes down to a block and to a record.
    """
    asks = F.when(F.col("act") == CHANGE, 2).otherwise(0)
    ground = placed.withColumns({"grp": F.shiftright("pos", BITS), "at": F.col("pos"), "tag": F.col("doc_id"), "ask": asks})
    near = written(first_below(ground).drop("at", "tag", "ask"), "near")
    shape = ["src", "at", "low", "tag", "ask", "blk"]
    node = lambda t: t.select("src", "at", "low", F.col("at").alias("tag"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("blk"))
    levels = [ground.select(*shape[:4], F.lit(0).alias("ask"), F.lit(None).cast("long").alias("blk"))]
    while last >> BITS * len(levels):
        up = levels[-1].groupBy("src", F.shiftright("at", BITS).alias("at")).agg(F.min("low").alias("low"))
        levels.append(node(written(up, "minima")))
    open_ = near.where("hit is null").groupBy("src", "grp", "low").agg(F.lit(1).alias("ask"))
    open_ = open_.select("src", F.col("grp").alias("at"), "low", F.lit(None).cast("long").alias("tag"), "ask", F.col("grp").alias("blk"))
    found: list[DataFrame] = []
    for nodes in levels[1:]:  # up: the first sibling that dips
        told = written(first_below(nodes.union(open_).withColumn("grp", F.shiftright("at", BITS))), "up")
        found.append(told.where("hit is not null"))
        open_ = told.where("hit is null").withColumn("at", F.col("grp")).select(*shape)
    for nodes in levels[-2::-1]:  # down: its first child that dips
        ask = found.pop().withColumns({"grp": F.col("hit"), "at": F.shiftleft("hit", BITS) - 1}).select(*shape, "grp")
        told = first_below(nodes.withColumn("grp", F.shiftright("at", BITS)).unionByName(ask))
        if found:
            found[-1] = found[-1].unionByName(told)
        else:
            found = [told]
            break
    if len(levels) == 1:
        return near.drop("grp")
    answers = written(found[0].select("src", F.col("blk").alias("grp"), "low", F.col("hit").alias("far")), "dips")
    late = near.where("hit is null").join(answers, ["src", "grp", "low"], "left").withColumn("hit", F.col("far")).select(*near.columns)
    return near.where("hit is not null").union(late).drop("grp")


def reassemble(docs: DataFrame, labels: DataFrame, per_epoch: int = COMMITS_PER_EPOCH) -> DataFrame:
    """(kind, id, n, value): the store after each epoch of ``per_epoch`` commits, and each undone change.

    ``docs`` (doc_id, text, source) is a log in ascending order of doc_id. A source's heights rise by one with a
    savepoint and fall by one with a rollback, below 0 if need be: a change is undone, or committed, by the first later
    record of its source that is lower, where ends of transactions are lowest of all. Of a commit's changes of a key, and
    of an epoch's, the last one counts; an epoch's difference to each key's value before it is summed up over epochs.

    Rows without a doc_id have no place in the log and are left out, as are labels without one; a null source is a source
    of its own; a null text deletes the key, an empty one is stored. Of rows that share a doc_id (all are of one act and
    key) those of the lesser source come first, a null source first of all, then the order is that of a hash of their
    texts; all are records. An id labelled twice is toxic if any label says so. An empty log, or one without commits,
    has no states. Other columns are not read.
    """
    log, seen = counted(records(docs, labels), "log", low=F.min("doc_id"), high=F.max("doc_id"), commits=F.count_if(F.col("act") == COMMIT))
    span = (seen["low"] or 0, seen["high"] or 0)
    step = F.when(F.col("act") == SAVEPOINT, 1).when(F.col("act") == ROLLBACK, -1).otherwise(0)
    walk = before(log.withColumns({"step": step.cast("long"), "one": F.lit(1).cast("long")}), ["src"], "doc_id", span, ("step", "one"), order=("tie",))
    low = F.when(F.col("act") <= ABORT, F.lit(GROUND)).otherwise(F.col("step_before") + F.col("step"))
    placed, most = counted(walk.select("doc_id", "src", "act", "key", "value", F.col("one_before").alias("pos"), low.alias("low")), "placed", last=F.max("pos"))
    fates = written(dips(placed, most["last"] or 0).select("doc_id", "src", "pos", "key", "value", "hit"), "fates")
    kind = F.when(F.col("hit").isNull(), "abort").when(act(F.col("hit")) == ROLLBACK, "rollback").when(act(F.col("hit")) == ABORT, "abort")
    undone = fates.withColumn("kind", kind).where("kind is not null").select("kind", F.col("doc_id").alias("id"), F.col("hit").alias("n"), F.col("key").cast("long").alias("value"))
    ranked = before(log.where(F.col("act") == COMMIT).select("doc_id", "src", "tie", F.lit(1).cast("long").alias("one")), [], "doc_id", span, ("one",), order=("src", "tie"))
    commits, count = counted(ranked.select("src", "doc_id", F.col("one_before").alias("rank"), (F.floor(F.col("one_before") / per_epoch) + 1).alias("epoch")), "commits", last=F.max("epoch"))
    epochs = (1, count["last"] or 1)
    ends = commits.groupBy("src", F.col("doc_id").alias("hit")).agg(F.min_by("epoch", "rank").alias("epoch"), F.min("rank").alias("rank"))
    applied = fates.where(act(F.col("hit")) == COMMIT).groupBy("src", "hit", "key").agg(F.max_by("value", "pos").alias("value"))
    puts = written(applied.join(ends, ["src", "hit"]).groupBy("key", "epoch").agg(F.max_by("value", "rank").alias("value")), "puts")
    held = lambda c: F.coalesce((F.col(c) != GONE).cast("long"), F.lit(0))
    worth = lambda c: F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0))
    change = before(puts, ["key"], "epoch", epochs, lasts=("value",)).groupBy("epoch").agg(
        F.sum(held("value") - held("value_before")).alias("n"), F.sum(worth("value") - worth("value_before")).alias("value")
    )
    change = commits.groupBy("epoch").agg(F.count(F.lit(1)).alias("_commits")).join(change, "epoch", "left").select("epoch", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0)).alias("value"))
    change = written(change, "changes")
    states = before(change, [], "epoch", epochs, ("n", "value"))
    states = states.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), (F.col("n_before") + F.col("n")).alias("n"), (F.col("value_before") + F.col("value")).alias("value"))
    dropped(placed)
    return states.union(undone)


def op11_log_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, n, value); see ``reassemble``. Whole texts are hashed where they are read and go no further."""
    return reassemble(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = """
with t as (select list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
r as (select doc_id, source, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h from documents, t where doc_id is not null),
g as (select r.*, (h // 100) % 30000 as key, case when h % 17 <= 1 then 'commit' when h % 17 = 2 then 'abort' when h % 17 <= 4 then 'savepoint' when h % 17 <= 6 then 'rollback' else 'change' end as act,
  text is null or doc_id in (select doc_id from labels where toxic = 1) as gone from r),
w as (select *, case when act in ('commit', 'abort') then -1000000000 else sum(case act when 'savepoint' then 1 when 'rollback' then -1 else 0 end) over (partition by source order by doc_id) end as low from g),
f as (select doc_id, source, key, gone, text, (select min(j.doc_id) from w j where j.source is not distinct from i.source and j.doc_id > i.doc_id and j.low < i.low) as hit from w i where act = 'change'),
k as (select f.*, coalesce(w.act, 'abort') as fate from f left join w on w.doc_id = f.hit),
c as (select doc_id, (row_number() over (order by doc_id) - 1) // 64 + 1 as epoch from w where act = 'commit'),
b as (select k.doc_id, key, epoch, gone, case when gone then 0 else xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(key || ':' || text)), '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) end as v,
  lead(epoch) over (partition by key order by k.hit, k.doc_id) as until from k join c on c.doc_id = k.hit, t where fate = 'commit')
select 'state' as kind, e.epoch::bigint as id, count(b.key)::bigint as n, coalesce(sum(v), 0)::bigint as value
from (select distinct epoch from c) e left join b on not gone and b.epoch <= e.epoch and (until is null or until > e.epoch) group by e.epoch
union all select fate, doc_id, hit, key::bigint from k where fate <> 'commit'
"""
