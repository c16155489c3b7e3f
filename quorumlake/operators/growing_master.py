"""Fusion into a master list that grows while sources are read: who becomes a master, what each row resolves to, what changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.operators.fusion import authority_changes
from quorumlake.operators.fuzzy_join import Listed, compared, scored_pairs, scored_within
from quorumlake.operators.ordered import Ordered
from quorumlake.sources.tables import dropped, written

# Fixed value: the likeness of sorted words from which a name is that of a master.
SAME_NAME = 72.0
#: Names that are compared with each other at first, and how many times as many each further block reaches to.
FIRST, GROWTH = 1 << 14, 4


def masters(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """The names of ``firsts`` (name, first) that become masters: those that no earlier master is linked with by ``links``
    (name, other).

    In rounds: a name all of whose earlier neighbours are known not to be masters is one, and its later neighbours are
    none. Each round is written, and settles the earliest open name of every cluster at least; rounds end when none is
    open. Only whether one is open reaches the driver.
    """
    both = links.union(links.select("other", "name"))
    at = lambda c, p: firsts.select(F.col("name").alias(c), F.col("first").alias(p))
    later = written(both.join(at("name", "_n"), "name").join(at("other", "_o"), "other").where("_o < _n").select("name", F.col("other").alias("earlier")), "earlier")
    open_ = written(firsts.select("name"), "open")
    found: list[DataFrame] = []
    while not open_.isEmpty():
        waits = later.join(open_, "name", "left_semi").join(open_.select(F.col("name").alias("earlier")), "earlier", "left_semi")
        new = written(open_.join(waits.select("name").distinct(), "name", "left_anti"), "masters")
        gone = later.join(new.select(F.col("name").alias("earlier")), "earlier", "left_semi").select("name").distinct()
        rest = written(open_.join(new, "name", "left_anti").join(gone, "name", "left_anti"), "open")
        dropped(open_)
        open_ = rest
        found.append(new)
    out = firsts.limit(0).select("name")
    for new in found:
        out = out.union(new)
    return out.join(firsts, "name")


def met_masters(firsts: DataFrame, kind: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The masters (id) among names (name, id, first, last), whose ids are their places in order of ``first``; and (a, b, score):
    names a and masters b that they are alike with, where no earlier master is as alike or more.

    Names are read block by block, in order, each block reaching GROWTH times as far as the one before. A block meets the
    masters of earlier blocks; only names that none of these is alike with are compared with each other, and masters found
    among them meet the names that have rows after them. So names meet masters, not each other, and links of names that
    are no masters are never told.
    """
    text = F.col("name").alias("raw"), compared(kind, F.col("name")).alias("text"), "id", "first", "last"
    firsts = written(firsts.select(*text), "names")
    names = lambda rows: Listed(rows.select("raw", "text", "id"))
    heads, links = firsts.select("id").limit(0), firsts.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("score")).limit(0)
    count, low, high = firsts.count(), 0, FIRST
    while low < count:
        block = firsts.where(f"id > {low} and id <= {high}")
        open_ = block
        if low:
            met = written(scored_pairs(names(block), names(firsts.join(heads, "id", "left_semi")), kind, least, rising=True).select("a", "b", "score"), "met")
            links = links.union(met)
            open_ = written(block.join(met.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "left")
        pairs = written(scored_within(names(open_), kind, least).select(F.col("a").alias("name"), F.col("b").alias("other")), "links")
        new = written(masters(open_.select(F.col("id").alias("name"), F.col("id").alias("first")), pairs).select(F.col("name").alias("id")), "heads")
        dropped(pairs)
        began = block.agg(F.min("first").alias("_began"))
        later = written(firsts.where(f"id <= {high}").crossJoin(F.broadcast(began)).where((F.col("id") > low) | (F.col("last") >= F.col("_began"))).drop("_began"), "later")
        links = links.union(written(scored_pairs(names(later), names(written(open_.join(new, "id", "left_semi"), "new")), kind, least, rising=True).select("a", "b", "score"), "met"))
        heads = heads.union(new)
        low, high = high, GROWTH * high
    return heads, links


def resolved(rows: DataFrame, source: str, order: str, name: str, least: float = SAME_NAME) -> DataFrame:
    """Adds ``_seq``, the row's place in (``source``, ``order``), ``master`` and ``master_name``: the master's place and name, and
    ``added``: whether the row begins it. Rows with a blank name are left out.

    Names are compared in lower case and without diacritics, on sorted words. A row takes the earlier master that is most
    alike, ``least`` or more, the earliest of equals; without one, it is a master from there on. Equal names share their
    fate but for what became a master between them: a name carries the masters that it may take, in order, each more alike
    than those before it, so at most one for each likeness there is.
    """
    plain = F.lower(F.trim(tx.fold(F.col(name), stroke=False)))
    known = rows.where(F.coalesce(F.trim(F.col(name)) != "", F.lit(False))).withColumn("_name", plain).withColumn("_seq", F.struct(source, order))
    known = written(known, "named")
    firsts = known.groupBy("_name").agg(F.min("_seq").alias("first"), F.max("_seq").alias("last")).withColumnRenamed("_name", "name")
    firsts = written(Ordered(firsts, [], ["first"]).place("id").done(), "firsts")
    heads, links = met_masters(firsts, "token_sort_ratio", least)
    own = heads.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("score"))
    first = links.union(own).groupBy("a", "score").agg(F.min("b").alias("b"))
    told = first.join(firsts.join(heads, "id", "left_semi").select(F.col("id").alias("b"), F.col("first").alias("m")), "b")
    choices = told.groupBy("a").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "m")).alias("_choices"))
    choices = choices.join(firsts.select(F.col("id").alias("a"), F.col("name").alias("_name")), "a").drop("a")
    best = F.array_min(F.filter("_choices", lambda x: x["m"] <= F.col("_seq")))["m"]
    return known.join(choices, "_name").withColumn("master", best).withColumn("added", F.col("master") == F.col("_seq")).drop("_choices", "_name")


def incremental_fusion(rows: DataFrame, source: str, order: str, name: str, fields: list[str], tier: str, year: str, least: float = SAME_NAME) -> tuple[DataFrame, DataFrame]:
    """(what each source does, the fused masters), as if each source in turn were fused into one growing list.

    First (source, added, field_updates, unchanged): rows that begin a master; values set or replaced by other rows; and
    other rows that change nothing. Then (master, name, fields): the values that stand at the end, by ``authority_changes``
    with the rows' ``tier`` and ``year``. ``order`` is unique within a source. Rows of a blank name count nowhere.
    """
    placed = written(resolved(rows, source, order, name, least).select("_seq", F.col(source).alias("_source"), "master", "added", F.col(name).alias("_title"), *fields, F.col(tier).alias("_tier"), F.col(year).alias("_year")), "placed")
    facts = placed.select("_seq", "_source", "added", "master", "_tier", "_year", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("_f")).select("*", "_f.*")
    changes = written(authority_changes(facts, "master", "field", "value", "_tier", "_year", "_seq"), "changes")
    taken = changes.where("change in ('set', 'replaced')")
    per_row = placed.join(taken.groupBy("_seq").agg(F.count(F.lit(1)).alias("n")), "_seq", "left").na.fill(0, ["n"])
    other = ~F.col("added")
    steps = per_row.groupBy(F.col("_source").alias(source)).agg(F.count_if("added").alias("added"), F.sum(F.when(other, F.col("n")).otherwise(0)).alias("field_updates"), F.count_if(other & (F.col("n") == 0)).alias("unchanged"))
    last = taken.groupBy("master", "field").agg(F.max_by("value", "_seq").alias("value"))
    wide = placed.where("added").select("master", F.col("_title").alias(name))
    for f in fields:
        wide = wide.join(last.where(F.col("field") == f).select("master", F.col("value").alias(f)), "master", "left")
    return steps, wide
