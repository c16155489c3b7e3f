"""Pairs of alike texts by an inverted index of character grams, exact at any threshold, without a product of the lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.similarity import WORD, similarity_from, tile_scores
from quorumlake.operators.ordered import Ordered
from quorumlake.sources.tables import written

#: Lengths of grams; a text is looked up by those that promise the fewest candidates.
GRAMS = (1, 2, 3)
#: Texts that hold a gram and meet in one task at most: a more frequent gram is dealt to several.
POSTINGS = 4096
#: Characters by which a needle and a text meet.
GRAM = 6
#: A threshold below which grams rule out too little, so that texts of up to WORD characters are compared tile by tile.
LOW = 80.0
#: Texts of a side of a tile at least and at most, tiles that are aimed at in between, and pairs of a task.
SIDE, TILES, PAIRS = (512, 4096), 2048, 1 << 26
#: Thresholds that a search for the nearest goes down by; the last one takes any text with a character in common.
DESCENT = (75.0, 40.0, 1e-6)


def compared(kind: str, text: Column) -> Column:
    """What ``kind`` compares: the text, or its words in order, where words are what Python's ``split`` makes of it."""
    if kind != "token_sort_ratio":
        return text
    return F.array_join(F.array_sort(F.filter(F.split(text, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")), " ")


def most_missing(kind: str, n: Column, q: Column, least: float) -> Column:
    """How many of the q-grams of a text of ``n`` characters a longer one of score ``least`` may lack, at most.

    With L common characters the score is 2 L / (n + w), w the other length (that of the best window, n at most, for
    partial_ratio). A character of the text that is left out takes q of its grams along, one that comes in between takes
    q - 1; with L at its least, that is linear in w, so that one end of w's range is the worst.
    """
    t = least / 100
    share = (2 - t) / t
    ends = (n / share, n) if kind == "partial_ratio" else (n, n * share)
    return F.floor(F.greatest(*(q * n + (q - 1) * w - (2 * q - 1) * t * (n + w) / 2 for w in ends)) + 1e-6)


def gram_table(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, n, q, gram): the grams of each text, the k-th equal one with its number, so that a text has each once."""
    rows = texts.select(F.col(ident), F.length(text).alias("n"), F.col(text).alias("_x"), F.explode(F.array(*map(F.lit, GRAMS))).alias("q")).where("n >= q")
    each = rows.select(ident, "n", "q", F.explode(F.expr("transform(sequence(1, n - q + 1), i -> substring(_x, i, q))")).alias("g"))
    counts = each.groupBy(ident, "n", "q", "g").agg(F.count(F.lit(1)).cast("int").alias("c"))
    return counts.select(ident, "n", "q", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("k"), "g").select(ident, "n", "q", F.concat("g", F.lit("#"), F.col("k").cast("string")).alias("gram"))


@dataclass
class Listed:
    """Distinct texts: ``texts`` (raw, text, id), ``text`` being what is compared, and their ``grams`` (id, n, q, gram), which are
    written when they are first asked for."""

    texts: DataFrame
    own_grams: DataFrame | None = None

    @property
    def grams(self) -> DataFrame:
        if self.own_grams is None:
            self.own_grams = written(gram_table(self.texts, "id", "text"), "grams")
        return self.own_grams

    def counts(self) -> DataFrame:
        """(q, gram, df, parts): how many texts hold a gram, and the tasks that its texts are dealt to."""
        return self.grams.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("df")).withColumn("parts", F.ceil(F.col("df") / POSTINGS).cast("int"))

    def longer(self) -> Listed:
        """The texts of more than WORD characters, which no tile takes."""
        return Listed(self.texts.where(F.length("text") > WORD))

    def shorter(self) -> Listed:
        return Listed(self.texts.where(F.length("text") <= WORD))

    def raw(self, ident: str, name: str) -> DataFrame:
        return self.texts.select(F.col("id").alias(ident), F.col("raw").alias(name))


def listed(rows: DataFrame, text: str, kind: str) -> Listed:
    rows = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("raw"), compared(kind, F.col(text)).alias("text")).distinct()
    return Listed(written(rows.withColumn("id", F.monotonically_increasing_id()), "texts"))


def candidates(short: Listed, long: Listed, kind: str, least: float, strict: bool = False) -> DataFrame:
    """(a, b): ids of pairs that may be ``least`` alike, of ``short`` (a) and ``long`` (b), where b's text is no shorter
    (``strict``: longer). No pair that is so alike is left out.

    A text may lack m of its grams in the other one at most, so that the other has one of any m + 1 of them: the rarest
    are asked for, of the gram length for which they are rarest. No more than POSTINGS texts of a gram meet in one task.
    """
    known = long.counts()
    asked = short.grams.withColumnRenamed("id", "a").withColumn("m", most_missing(kind, F.col("n"), F.col("q"), least))
    asked = asked.where(F.col("m") < F.col("n") - F.col("q") + 1).join(known, ["q", "gram"], "left").na.fill(0, ["df", "parts"])
    lists = asked.groupBy("a", "n", "q", "m").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "parts"))).alias("all"))
    lists = lists.withColumn("rarest", F.slice("all", 1, F.col("m").cast("int") + 1))
    cost = F.aggregate("rarest", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    best = lists.groupBy("a", "n").agg(F.min_by(F.struct("q", "rarest"), F.struct(cost, "q")).alias("x"))
    probes = best.select("a", F.col("n").alias("n_a"), "x.q", F.explode("x.rarest").alias("g")).where("g.parts > 0")
    probes = probes.select("a", "n_a", "q", F.col("g.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.col("g.parts") - 1)).alias("part"))
    held = long.grams.withColumnRenamed("id", "b").join(known, ["q", "gram"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    fits = F.col("n") > F.col("n_a") if strict else F.col("n") >= F.col("n_a")
    if kind != "partial_ratio":
        fits = fits & (F.col("n") <= F.col("n_a") * ((200 - least) / least) + 1e-6)
    return probes.join(held, ["q", "gram", "part"]).where(fits).select("a", "b").distinct()


def scored_pairs(x: Listed, y: Listed, kind: str, least: float, rising: bool = False) -> DataFrame:
    """(a, b, score) of two lists: the shorter text of a pair looks up the longer one, in either direction; equal texts are
    joined, two empty ones among them; candidates are scored. Texts are carried to their pairs last. Below LOW, short texts
    are compared by tiles, and only what has a longer one is looked up.

    ``rising``: a pair may be left out if a is as alike to a b of a smaller id or more, so that what a first b, or the most
    alike of the first so many, need stays, and the pairs of a don't grow with the list."""
    if not least > 0:
        raise ValueError("a threshold above 0 is needed; see nearest")
    if by_tiles(kind, least):
        near = tiled(x, y, least, rising=rising)
        mixed = [(p, q) for p, q in ((x.longer(), y), (x.shorter(), y.longer())) if not p.texts.isEmpty() and not q.texts.isEmpty()]
        for p, q in mixed:
            near = near.union(looked_up(p, q, kind, least).select(near.columns))
        return near
    return looked_up(x, y, kind, least)


def looked_up(x: Listed, y: Listed, kind: str, least: float) -> DataFrame:
    """``scored_pairs`` by the index of grams."""
    turned = candidates(y, x, kind, least, strict=kind != "partial_ratio").select(F.col("b").alias("a"), F.col("a").alias("b"))
    equal = x.texts.select("text", F.col("id").alias("a")).join(y.texts.select("text", F.col("id").alias("b")), "text").select("a", "b")
    pairs = candidates(x, y, kind, least).union(turned).union(equal).distinct()
    full = pairs.join(x.raw("a", "_a"), "a").join(y.raw("b", "_b"), "b")
    return full.withColumn("score", similarity_from(kind, F.col("_a"), F.col("_b"), least)).where(F.col("score") >= least)


def _tile_pairs(least: float, within: bool, rising: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (batch.column(c)[r].values for c in ("xs", "ys"))
                if rising:
                    y = y.take(pa.array(np.argsort(y.field("id").to_numpy())))
                for i, j, score in tile_scores(x.field("text").to_pylist(), y.field("text").to_pylist(), least):
                    if rising and len(i):  # scores of a row of the tile are above those of the rows before it
                        height = score + 1000.0 * i
                        up = np.append(True, height[1:] > np.maximum.accumulate(height)[:-1])
                        i, j, score = i[up], j[up], score[up]
                    a, b = x.field("id").take(pa.array(i)), y.field("id").take(pa.array(j))
                    out = pa.RecordBatch.from_arrays([a, b, x.field("raw").take(pa.array(i)), y.field("raw").take(pa.array(j)), pa.array(score)], ["a", "b", "_a", "_b", "score"])
                    # a tile of a block with itself has each pair twice
                    yield out.filter(pa.array(a.to_numpy() < b.to_numpy())) if within and batch.column("same")[r].as_py() else out

    return run


def tiled(x: Listed, y: Listed, least: float, within: bool = False, rising: bool = False) -> DataFrame:
    """(a, b, _a, _b, score): the pairs of texts of up to WORD characters whose ratio is ``least`` or more; ``within``: of one
    list, each pair once; ``rising``: of a tile, those more alike than all of a with a smaller b.

    Both lists are cut into blocks by length, and blocks whose lengths allow it meet. A block's side grows with the lists, so
    that what is moved grows no faster than the pairs; a task holds one tile at a time, and tasks grow with the pairs.
    """
    spark = x.texts.sparkSession
    short = lambda z: z.texts.where(F.length("text") <= WORD)
    many = short(x).count() * short(y).count()
    side = min(max(isqrt(many // TILES), SIDE[0]), SIDE[1])

    def blocks(z: Listed) -> DataFrame:
        rows = Ordered(short(z).withColumn("n", F.length("text")), [], ["n", "id"]).place("_k").done()
        block = F.floor((F.col("_k") - 1) / side)
        return written(rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "raw", "text")).alias("s"), F.min("n").alias("lo"), F.max("n").alias("hi")), "blocks")

    left = blocks(x)
    right = left if within else blocks(y)
    of = lambda z, p: z.select(F.col("block").alias(p), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
    share = (200 - least) / least
    meet = (F.col("i_lo") <= F.col("j_hi") * share + 1e-6) & (F.col("j_lo") <= F.col("i_hi") * share + 1e-6)
    tiles = of(left, "i").crossJoin(of(right, "j")).where(meet & (F.col("i") <= F.col("j")) if within else meet)
    tiles = written(tiles.select("i", "j", F.monotonically_increasing_id().alias("tile")), "tiles")
    parts = max(tiles.count() * side * side // PAIRS, 4 * spark.sparkContext.defaultParallelism)
    a = left.select(F.col("block").alias("i"), F.col("s").alias("xs")).join(F.broadcast(tiles.select("tile", "i", (F.col("i") == F.col("j")).alias("same"))), "i")
    b = right.select(F.col("block").alias("j"), F.col("s").alias("ys")).join(F.broadcast(tiles.select("tile", "j")), "j")
    both = a.select("tile", "same", "xs").repartition(parts, "tile").join(b.select("tile", "ys").repartition(parts, "tile").hint("shuffle_hash"), "tile")
    kind = x.texts.schema["raw"].dataType.simpleString()
    return both.mapInArrow(_tile_pairs(least, within, rising), f"a long, b long, _a {kind}, _b {kind}, score double")


def by_tiles(kind: str, least: float) -> bool:
    return kind != "partial_ratio" and 0 < least < LOW


def alike(left: DataFrame, right: DataFrame, a: str, b: str, kind: str, least: float) -> DataFrame:
    """(a, b, score): the distinct texts of ``left`` and of ``right`` whose similarity ``kind`` is ``least`` or more, above
    0. Nulls are alike to nothing; equal texts have score 100."""
    return scored_pairs(listed(left, a, kind), listed(right, b, kind), kind, least).select(F.col("_a").alias(a), F.col("_b").alias(b), "score")


def scored_within(x: Listed, kind: str, least: float) -> DataFrame:
    """(a, b, _a, _b, score): each pair of texts of one list that are ``least`` alike or more, by ids a < b."""
    if by_tiles(kind, least):
        near = tiled(x, x, least, within=True)
        if not (long := x.longer()).texts.isEmpty():
            pairs = looked_up(long, x, kind, least).where(F.col("a") != F.col("b"))
            turned = F.col("a") > F.col("b")
            ends = [F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("_a", "_b"), ("_b", "_a"))]
            near = near.union(pairs.select(*ends, "score").distinct())
        return near
    pairs = candidates(x, x, kind, least)
    if kind == "token_sort_ratio":  # texts that differ in the order of their words alone, or have none
        same = x.texts.select("text", F.col("id").alias("a"))
        pairs = pairs.union(same.join(same.withColumnRenamed("a", "b"), "text").select("a", "b"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = pairs.join(x.raw("a", "_a"), "a").join(x.raw("b", "_b"), "b").select("a", "b", "_a", "_b")
    return full.withColumn("score", similarity_from(kind, F.least("_a", "_b"), F.greatest("_a", "_b"), least)).where(F.col("score") >= least)


def alike_within(names: DataFrame, name: str, kind: str, least: float) -> DataFrame:
    """(a, b, score): distinct texts a < b of one list that are ``least`` alike or more."""
    return scored_within(listed(names, name, kind), kind, least).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "score")


def nearest(queries: DataFrame, candidates: DataFrame, query: str, name: str, kind: str = "partial_ratio", least: float = 0.0) -> DataFrame:
    """(query, name, score): the best candidate of each distinct query text by ``kind``, the first by name on ties, from
    ``least`` on. Without a ``least``, a search for all that are 75 alike, then for what is left over at 40, and so on;
    what has no character in common with any candidate gets the first of them, with score 0. Nulls are left out.
    """
    x, y = listed(queries, query, kind), listed(candidates, name, kind)

    def best(left: Listed, at: float) -> DataFrame:
        found = scored_pairs(left, y, kind, at).groupBy("a", F.col("_a").alias("_q")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_b").alias("c"))).alias("m"))
        return found.select("a", "_q", F.col("m.c").alias("_c"), (-F.col("m.s")).alias("score"))

    if least > 0:
        return best(x, least).drop("a").toDF(query, name, "score")
    found = None
    for at in DESCENT:
        near = written(best(x, at), "nearest")
        found = near if found is None else found.union(near)
        x = Listed(x.texts.join(near.select(F.col("a").alias("id")), "id", "left_anti"), x.grams.join(near.select(F.col("a").alias("id")), "id", "left_anti"))
        if x.texts.isEmpty():
            return found.drop("a").toDF(query, name, "score")
    first = y.texts.agg(F.min("raw").alias("_c")).where("_c is not null")
    rest = x.texts.crossJoin(F.broadcast(first)).select("id", F.col("raw").alias("_q"), "_c", F.lit(0.0).alias("score"))
    return found.union(rest).drop("a").toDF(query, name, "score")


def holders(texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle: str) -> DataFrame:
    """(text_id, needle): texts that hold a distinct needle as it is. Both meet on a needle's first characters, GRAM of
    them or all; what meets is checked. Empty needles, which any text holds, are left out, as are nulls."""
    asked = needles.select(F.col(needle).alias("_needle")).where("_needle <> ''").distinct()
    asked = asked.withColumn("_l", F.least(F.length("_needle"), F.lit(GRAM))).withColumn("_g", F.expr("substring(_needle, 1, _l)"))
    sizes = sorted(r[0] for r in asked.select("_l").distinct().collect())
    rows = texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text"), F.explode(F.array(*map(F.lit, sizes or [GRAM]))).alias("_l")).where("length(_text) >= _l")
    each = rows.select("_id", "_text", F.explode(F.expr("array_distinct(transform(sequence(1, length(_text) - _l + 1), i -> substring(_text, i, _l)))")).alias("_g"))
    met = each.join(asked, "_g").where(F.contains("_text", F.col("_needle")))
    return met.select(F.col("_id").alias(text_id), F.col("_needle").alias(needle)).distinct()

