"""From a reply's text to its inventory: every candidate table, the best one, its canonical rows, and why there is none."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.operators import extract
from quorumlake.sources.tables import written

#: A candidate is (key, order, kind, block): its text as delimited lines, best score first, the first of equals.
KINDS = ("fenced", "pipe", "merged", "fragments", "inline")
#: Texts whose cells are Python objects at once.
TEXTS = 32
#: Kinds of errors of an inventory, in the order in which they are looked for.
ERRORS = ("no_text", "no_table", "parse_failed", "no_name_column")


def parsed(block: Column) -> Column:
    """A delimited text's rows as arrays of cells, without empty rows. A ``sep=`` line is left out; the delimiter of
    , ; tab and | is the one that splits the first lines alike, else the comma."""
    kind = pa.list_(pa.list_(pa.string()))

    @F.arrow_udf("array<array<string>>")
    def cells(blocks: pa.Array) -> pa.Array:
        def one(text: str | None) -> list[list[str]]:
            text = (text or "").strip()
            if text.lower().startswith("sep="):
                text = "\n".join(text.splitlines()[1:]).lstrip()
            try:
                dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
            except csv.Error:
                dialect = csv.excel
            try:
                return [row for row in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in row)]
            except csv.Error:
                return []

        # some texts at a time: cells are many times their size as Python's objects
        parts = [pa.array([one(b) for b in blocks.slice(at, TEXTS).to_pylist()], kind) for at in range(0, len(blocks), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return cells(block)


def quoted_row(cells: Column) -> Column:
    return F.concat(F.lit('"'), F.array_join(cells, '","'), F.lit('"'))


def _block(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, block): rows of cells as quoted lines, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), quoted_row(F.col("cells")).alias("l")))), lambda x: x["l"])
    return rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("block"), F.count(F.lit(1)).alias("n_lines"), F.min(order).alias("at"))


def headers_fit(a: Column, b: Column) -> Column:
    """Whether two headers (arrays of canonical names, null where a cell names nothing) share two names or more."""
    return F.size(F.array_intersect(F.filter(a, lambda x: x.isNotNull()), F.filter(b, lambda x: x.isNotNull()))) >= 2


def clustered(tables: DataFrame, key: str) -> DataFrame:
    """(key, table_no, cluster) of tables (key, table_no, at, n_lines, width, names): by their first lines, a table goes to
    the first cluster whose own first table is as wide and fits in its header, and whose last line is FRAGMENT_GAP lines
    away at most; else it begins one. A fold over the tables of a text, which one row holds."""
    kind = "array<struct<width:int,names:array<string>,end:bigint,tables:array<bigint>>>"
    takes = lambda c, t: (c["width"] == t["width"]) & (t["at"] - c["end"] <= extract.FRAGMENT_GAP) & headers_fit(c["names"], t["names"])

    def step(clusters: Column, t: Column) -> Column:
        first = F.array_min(F.transform(clusters, lambda c, i: F.when(takes(c, t), i)))
        stop = t["at"] + t["n_lines"]
        grown = lambda c, i: F.when(i == first, F.struct(c["width"].alias("width"), c["names"].alias("names"), F.greatest(c["end"], stop).alias("end"), F.concat(c["tables"], F.array(t["table_no"])).alias("tables"))).otherwise(c)
        new = F.struct(t["width"].alias("width"), t["names"].alias("names"), stop.alias("end"), F.array(t["table_no"]).alias("tables"))
        return F.when(first.isNull(), F.concat(clusters, F.array(new))).otherwise(F.transform(clusters, grown))

    each = F.struct("at", F.col("table_no").cast("long").alias("table_no"), F.col("n_lines").cast("long").alias("n_lines"), F.col("width").cast("int").alias("width"), "names")
    folded = tables.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("_t")).select(key, F.aggregate("_t", F.expr(f"cast(array() as {kind})"), step).alias("_c"))
    return folded.select(key, F.posexplode("_c").alias("cluster", "_one")).select(key, F.explode("_one.tables").alias("table_no"), F.col("cluster").cast("long").alias("cluster"))


def merged_fragments(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, cells) of fragments put together: inventory tables of a text that are near each other, equally wide
    and fit in their headers, as one; its first row is the header of the longest. Of rows with one folded name the first
    stays; of a text's clusters of several tables, the one with most rows. Fewer than two rows are none."""
    heads = rows.where("row_no = 0").select(key, "table_no", F.col("cells").alias("head"), F.transform("cells", tx.canonical_header).alias("names"))
    tables = rows.groupBy(key, "table_no").agg(F.min("line_no").cast("long").alias("at"), F.count(F.lit(1)).alias("n_lines"), F.max(F.size("cells")).alias("width")).join(heads, [key, "table_no"])
    known = F.array_intersect("names", F.array(*map(F.lit, extract.ATTRIBUTES)))
    tables = tables.where(F.coalesce(F.array_contains("names", "name"), F.lit(False)) & (F.size(known) >= 2))
    told = clustered(tables, key)
    placed = tables.join(told, [key, "table_no"])
    sizes = placed.groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("tables"), F.sum(F.col("n_lines") - 1).alias("total"), F.max_by("head", F.struct("n_lines", -F.col("at"))).alias("head"), F.min("at").alias("first"))
    best = sizes.where("tables > 1").withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), "cluster"))).where("_rn = 1").select(key, "cluster", "head", "first")
    body = rows.where("row_no > 0").join(placed.select(key, "table_no", "cluster", "names"), [key, "table_no"]).join(best.select(key, "cluster"), [key, "cluster"])
    name = F.get("cells", F.array_position("names", "name").cast("int") - 1)
    folded = F.coalesce(F.nullif(tx.fold(F.lower(F.trim(name)), stroke=False), F.lit("")), quoted_row(F.col("cells")))
    first = body.withColumn("_rn", F.row_number().over(Window.partitionBy(key, folded).orderBy("line_no"))).where("_rn = 1")
    kept = first.select(key, "line_no", "cells", F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n")).where("_n >= 2").select(key, "line_no", "cells")
    return kept.union(best.join(kept.select(key).distinct(), key, "left_semi").select(key, (F.col("first") - 1).cast("int").alias("line_no"), F.col("head").alias("cells")))


def inline_block(text: Column) -> Column:
    """The part of a text that looks delimited: from the first line with two delimiters of a kind and a header word (else
    the first with two delimiters) up to two empty lines in a row, without empty lines. Null if there is none."""
    count = lambda x, d: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))
    split = lambda x: F.greatest(count(x, ","), count(x, ";"), count(x, "\t")) >= 2
    worded = lambda x: F.greatest(*(F.contains(x, F.lit(w)) for w in extract.HEADER_WORDS))
    trimmed = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("t"), x.alias("raw")))
    # what a line's tests need is told once for each line, and where the part starts once for each text
    low = F.transform(trimmed, lambda x, i: F.struct(x["t"].alias("t"), x["raw"].alias("raw"), i.alias("i"), F.when(split(x["t"]), F.lower(x["t"])).alias("low")))

    def started(lines: Column) -> Column:
        first = lambda test: F.array_min(F.transform(F.filter(lines, test), lambda x: x["i"]))
        start = F.coalesce(first(lambda x: x["low"].isNotNull() & worded(x["low"])), first(lambda x: x["low"].isNotNull()))
        return F.struct(start.alias("start"), lines.alias("lines"))

    def cut(told: Column) -> Column:
        rest = F.slice(told["lines"], told["start"] + 1, F.size(told["lines"]))
        joined = F.array_join(F.transform(rest, lambda x: F.when(x["t"] == "", "").otherwise(x["raw"])), "\n")
        part = F.element_at(F.split(joined, "\n\n\n"), 1)
        return F.when(told["start"].isNotNull(), F.trim(F.regexp_replace(part, "\n+", "\n")))

    return F.element_at(F.transform(F.transform(F.array(low), started), cut), 1)


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, nr, block, score): fenced blocks, pipe tables, those with equal headers as one, fragments as one; and,
    where there is none of these, the part of the text that looks delimited. Null texts have none."""
    out = lambda df, kind: df.select(key, F.lit(kind).alias("kind"), F.col("nr").cast("long").alias("nr"), "block")
    fenced = out(docs.select(key, F.posexplode(extract.fenced_blocks(F.col(text))).alias("nr", "block")), "fenced")
    rows = written(extract.pipe_table_rows(docs, key, text), "pipe-rows")  # three kinds of candidates read them
    pipe = out(_block(rows, [key, "table_no"], "line_no").withColumnRenamed("table_no", "nr"), "pipe")
    merged = extract.merged_tables(rows, key)
    head = merged.groupBy(key, "head").agg((F.min("line_no") - 1).alias("line_no")).select(key, "line_no", F.split("head", "\u001f").alias("cells"))
    merged = out(_block(merged.select(key, "line_no", "cells").union(head), [key], "line_no").withColumn("nr", F.lit(0)), "merged")
    fragments = out(_block(merged_fragments(rows, key), [key], "line_no").withColumn("nr", F.lit(0)), "fragments")
    found = fenced.union(pipe).union(merged).union(fragments)
    # generated, as a filter on the part would cut each text twice, once before the join
    part = F.filter(F.array(inline_block(F.col(text))), lambda x: x.isNotNull())
    rest = docs.join(found.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("nr"), F.explode(part).alias("block"))
    return found.union(out(rest, "inline")).withColumn("score", extract.block_score(F.col("block")))


def best_block(found: DataFrame, key: str) -> DataFrame:
    """The candidate of each text with the highest score, the first of equals in the order of KINDS."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return extract.best_candidate(found.withColumn("_order", rank * 1_000_000 + F.col("nr")), key, "score", "_order").drop("_order")


def canonical_rows(blocks: DataFrame, key: str) -> DataFrame:
    """(key, row_no, CANONICAL) of each text's block: the first column that names a canonical one gives it, capacities as
    numbers ("0" for none), cells trimmed, missing ones empty, rows without a name left out. A block without two rows or
    without a column of names gives none."""
    tables = blocks.select(key, parsed(F.col("block")).alias("_rows")).withColumn("_names", F.transform(F.get("_rows", F.lit(0)), tx.canonical_header))
    # no filter on what is parsed: the plan would parse it once more for that
    body = F.when(F.array_contains("_names", "name"), F.slice("_rows", 2, 1 << 30))
    rows = tables.select(key, "_names", F.posexplode(body).alias("row_no", "_cells"))
    cell = lambda name: F.trim(F.coalesce(F.when(F.array_position("_names", name) > 0, F.get("_cells", F.array_position("_names", name).cast("int") - 1)), F.lit("")))
    values = {c: tx.capacity_text(cell(c)) if c == "capacity_mwe" else cell(c) for c in tx.CANONICAL}
    return rows.select(key, "row_no", *(v.alias(c) for c, v in values.items())).where("name <> ''")


def ingested(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, (key, kind, n_rows, error)): each text's best inventory, its number of rows, and what is wrong
    where it has none (one of ERRORS)."""
    best = written(best_block(candidates(docs, key, text), key), "best-blocks")
    rows = canonical_rows(best, key)
    shape = best.select(key, "kind", parsed(F.col("block")).alias("_rows")).withColumn("_names", F.transform(F.get("_rows", F.lit(0)), tx.canonical_header))
    at = F.array_position("_names", "name").cast("int") - 1
    filled = F.filter(F.slice("_rows", 2, 1 << 30), lambda cells: F.trim(F.coalesce(F.get(cells, at), F.lit(""))) != "")
    named = F.coalesce(F.array_contains("_names", "name"), F.lit(False))
    # the canonical rows are counted where the text is parsed
    shape = shape.select(key, "kind", (F.size("_rows") < 2).alias("_short"), F.when(F.size("_rows") >= 1, named).alias("_named"), F.when(named, F.size(filled).cast("long")).alias("n_rows"))
    told = docs.select(key, (F.trim(F.coalesce(text, F.lit(""))) == "").alias("_empty")).join(shape, key, "left")
    error = F.when(F.col("_empty"), "no_text").when(F.col("kind").isNull(), "no_table").when(F.col("_short"), "parse_failed").when(~F.col("_named"), "no_name_column")
    return rows, told.select(key, "kind", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), error.alias("error"))


def row_parity(expected: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """(key, expected_rows, observed_rows, matches, error): declared numbers of rows against those found; a text that is
    declared and was never read is ``run_not_found``, one that is read more than once ``ambiguous_run``."""
    seen = told.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("n_rows").alias("_rows"), F.first("error").alias("_error"))
    out = expected.join(seen, key, "left")
    error = F.when(F.col("_n").isNull(), "run_not_found").when(F.col("_n") > 1, "ambiguous_run").otherwise(F.col("_error"))
    observed = F.when(error.isNull(), F.col("_rows")).otherwise(F.lit(0))
    return out.select(key, "expected_rows", observed.alias("observed_rows"), (error.isNull() & (observed == F.col("expected_rows"))).alias("matches"), error.alias("error"))


def text_of_turn(turns: DataFrame, key: str, turn: str, role: str, text: str, siblings: DataFrame, sibling_text: str, who: str = "assistant") -> DataFrame:
    """The newest turn of ``who`` with text; where a dialogue has none, the text that its sibling record has (null if
    neither)."""
    own = extract.last_turn(turns, key, turn, role, text, who)
    keys = turns.select(key).union(siblings.select(key)).distinct()
    spare = siblings.where(F.trim(F.coalesce(sibling_text, F.lit(""))) != "").groupBy(key).agg(F.min(sibling_text).alias("_spare"))
    out = keys.join(own, key, "left").join(spare, key, "left")
    return out.select(key, "last_turn", F.coalesce("text", "_spare").alias("text"), F.when(F.col("text").isNotNull(), "turn").when(F.col("_spare").isNotNull(), "sibling").alias("origin"))


def flattened(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, turn, role, text, is_last): nested dialogues (turns: array of role and content; else a single response) as
    flat rows, in order; a record with neither gives none."""
    single = F.when(F.trim(F.coalesce("response", F.lit(""))) != "", F.array(F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"))))
    turns = F.coalesce(single, F.when(F.size("turns") > 0, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))))
    flat = records.where(turns.isNotNull()).select(*keys, F.size(turns).alias("_n"), F.posexplode(turns).alias("turn", "_t"))
    return flat.select(*keys, "turn", F.col("_t.role").alias("role"), F.col("_t.content").alias("text"), (F.col("turn") == F.col("_n") - 1).alias("is_last"))


def paged_sections(docs: DataFrame, key: str, text: str, page: str = r"^\s*(?:<!--\s*)?[Pp]age\s+(\d+)(?:\s*-->)?\s*$", heading: str = r"^#{1,6}\s+(.*)$") -> DataFrame:
    """(key, section, page, title, text): a converted document's sections, a new one at each heading or page marker; the
    page is the last marker's number."""
    lines = extract.lines_of(docs, key, text)
    at, title = F.regexp_extract("line", page, 1).try_cast("int"), F.nullif(F.regexp_extract("line", heading, 1), F.lit(""))
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumns({"_page": at, "title": title}).withColumn("section", F.sum((F.col("_page").isNotNull() | F.col("title").isNotNull()).cast("int")).over(order))
    lines = lines.withColumn("page", F.last("_page", ignorenulls=True).over(order))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("_page").isNull() & F.col("title").isNull(), F.struct("line_no", "line")))), lambda x: x["line"])
    return lines.groupBy(key, "section").agg(F.max("page").alias("page"), F.max("title").alias("title"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("text"))


def markdown_counters(text: Column) -> dict[str, Column]:
    """Markup of Markdown documents, and whether words with Vietnamese diacritics came through."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {"n_headings": count(r"(?m)^#{1,6}\s"), "n_pipe_rows": count(r"(?m)^\s*\|.*\|\s*$"), "n_items": count(r"(?m)^\s*(?:[-*+]|\d+\.)\s"), "n_links": count(r"\[[^\]]*\]\([^)]*\)"), "n_lines": count("\n"), "n_diacritics": count(r"[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")}


def diacritics_kept(text: Column, samples: tuple[str, ...]) -> Column:
    """The share of sample words that a text holds with their diacritics, of those that it holds with or without."""
    plain = tx.fold(F.lower(text))
    kept = sum((F.contains(F.lower(text), F.lit(w.lower())).cast("int") for w in samples), F.lit(0))
    held = sum((F.contains(plain, tx.fold(F.lit(w.lower()))).cast("int") for w in samples), F.lit(0))
    return F.try_divide(kept, held)
