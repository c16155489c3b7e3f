"""Tables out of texts: fenced blocks, pipe tables, turns, bibliographies, sections, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.text import canonical_header, host, in_domains, urls
from quorumlake.operators.fuzzy_join import holders
from quorumlake.operators.provenance import tier

ATTRIBUTES = ("fuel", "status", "cod", "province", "capacity_mwe")
HEADER_WORDS = ("name", "fuel", "status", "province", "capacity")
#: Lines between fragments of one table.
FRAGMENT_GAP = 50


def fenced_blocks(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, "\r", ""), F.lit(r"(?is)```(?:csv)?[ \t]*\n(.*?)```"), F.lit(1))


def block_score(block: Column) -> Column:
    """Share of lines with a delimiter, header words and length; -1 for nothing, or a pipe table near the top."""

    def scored(lines: Column) -> Column:
        top = F.slice(lines, 1, 5)
        delimited = F.size(F.filter(lines, lambda x: x.rlike("[,;\t]"))) / F.size(lines)
        words = sum((F.contains(F.lower(F.element_at(lines, 1)), F.lit(w)).cast("double") for w in HEADER_WORDS), F.lit(0.0))
        piped = F.exists(top, lambda x: F.ltrim(x).startswith("|"))
        return F.when(F.size(lines) == 0, -1.0).when(piped, -1.0).otherwise(delimited + 0.2 * words + F.least(F.size(lines) / 50, F.lit(1.0)))

    # an array of one, so that the lines are told once
    return F.element_at(F.transform(F.array(F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")), scored), 1)


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def pipe_table_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, cells): rows of pipe tables. A table is a run of rows with three pipes or more; rules and
    section rows (two pipes) inside it are passed over, rows of another width than the first are left out, and tables of
    one row are none. A text's lines are an array until those without two pipes are gone: only the others are rows.
    """
    candidates = docs.where(F.col(text).rlike(r"\|[^\n|]*\|[^\n|]*\|"))
    at = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x, i: F.struct(i.alias("line_no"), F.trim(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))).alias("pipes")))
    lines = candidates.select(key, F.inline(F.filter(at, lambda x: x["pipes"] >= 2)))
    glued = F.col("line").endswith("|") & ~F.col("line").startswith("|") & (F.col("pipes") >= 3)
    lines = lines.withColumn("line", F.when(glued, F.expr("substring(line, locate('|', line))")).otherwise(F.col("line")))
    # of a run of such lines, the line number less the number of such lines before is the same: the breaks before
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("table_no", (F.col("line_no") - F.row_number().over(order) + 1).cast("long"))
    rule = F.col("line").rlike(r"^[\s\-:|]+$")
    rows = lines.where((F.col("pipes") >= 3) & ~rule).withColumn("cells", F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)))
    in_table = Window.partitionBy(key, "table_no").orderBy("line_no")
    rows = rows.withColumn("width", F.first(F.size("cells")).over(in_table)).where("size(cells) = width")
    rows = rows.withColumn("row_no", F.row_number().over(in_table) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "table_no"))).where("n >= 2")
    return rows.select(key, "table_no", "row_no", "line_no", "cells")


def canonical_cells(rows: DataFrame, key: str) -> DataFrame:
    """Adds to each body row the canonical columns as a map (the first header that names a column wins), and whether its
    table's header is an inventory's: a name and two attributes or more."""
    heads = rows.where("row_no = 0").select(key, "table_no", F.transform("cells", canonical_header).alias("names"))
    body = rows.where("row_no > 0").join(heads, [key, "table_no"])
    pairs = F.filter(F.arrays_zip("names", "cells"), lambda x: x["names"].isNotNull())
    first = F.filter(F.transform(pairs, lambda x, i: F.struct(x["names"].alias("k"), x["cells"].alias("v"), i.alias("i"))), lambda x: F.array_position(F.transform(pairs, lambda y: y["names"]), x["k"]) == x["i"] + 1)
    values = F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"])))
    attributes = F.size(F.array_intersect("names", F.array(*map(F.lit, ATTRIBUTES))))
    return body.withColumn("is_inventory", F.array_contains("names", "name") & (attributes >= 2)).withColumn("values", values)


def merged_tables(rows: DataFrame, key: str) -> DataFrame:
    """Tables of one text with equal headers as one: distinct rows in first order, the largest group of each text."""
    heads = rows.where("row_no = 0").select(key, "table_no", F.array_join("cells", "\u001f").alias("head"))
    body = rows.where("row_no > 0").join(heads, [key, "table_no"]).groupBy(key, "head", "cells").agg(F.min("line_no").alias("line_no"))
    sizes = body.groupBy(key, "head").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    best = sizes.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where("_rn = 1 and n >= 2").select(key, "head")
    return body.join(best, [key, "head"])


def delimiter(block: Column) -> Column:
    """The most frequent of , ; tab and | (in that order on ties), or what a ``sep=`` line says."""
    hint = F.regexp_extract(block, r"^\s*sep=(.)", 1)
    n = {d: F.regexp_count(block, F.lit(p)) for d, p in ((",", ","), (";", ";"), ("\t", "\t"), ("|", r"\|"))}
    most = F.greatest(*n.values())
    out = F.lit("|")
    for d in ("\t", ";", ","):
        out = F.when(n[d] == most, F.lit(d)).otherwise(out)
    return F.when(hint != "", hint).otherwise(out)


def best_candidate(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order))).where("_rn = 1").drop("_rn")


def last_turn(turns: DataFrame, key: str, turn: str, role: str, text: str, who: str = "assistant") -> DataFrame:
    """The newest turn of ``who`` that has text."""
    said = turns.where((F.col(role) == who) & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return said.groupBy(key).agg(F.max(turn).alias("last_turn"), F.max_by(text, turn).alias("text"))


def joined_turns(turns: DataFrame, key: str, turn: str, role: str, text: str, who: str = "assistant") -> DataFrame:
    """All turns of ``who``, in order, a line between them."""
    said = turns.where(F.col(role) == who).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("_k"), F.coalesce(text, F.lit("")).alias("_v")))).alias("_t"))
    return said.select(key, F.size("_t").alias("n_turns"), F.array_join(F.transform("_t", lambda x: x["_v"]), "\n").alias("text"))


def sections(docs: DataFrame, key: str, text: str, heading: str = r"^#{1,6}\s+(.*)$") -> DataFrame:
    """(key, section, title, n_lines, n_chars): lines between headings; section 0 is what comes before the first."""
    lines = lines_of(docs, key, text)
    title = F.regexp_extract(F.trim("line"), heading, 1)
    lines = lines.withColumn("title", F.nullif(title, F.lit(""))).withColumn("section", F.sum(F.col("title").isNotNull().cast("int")).over(Window.partitionBy(key).orderBy("line_no")))
    return lines.groupBy(key, "section").agg(F.max("title").alias("title"), F.count_if(F.col("title").isNull()).alias("n_lines"), F.coalesce(F.sum(F.when(F.col("title").isNull(), F.length("line"))), F.lit(0)).alias("n_chars"))


def bibliography(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, entry): numbered entries "[n] ..." or "n. ..." below a bibliography heading."""
    part = F.regexp_extract(text, r"(?is)(?:^|\n)#*\s*(?:bibliography|references|sources)\s*:?\s*\n(.*)$", 1)
    lines = docs.select(key, F.explode(F.split(part, "\n")).alias("line"))
    number, entry = F.regexp_extract("line", r"^\s*\[?(\d+)[\].]\s+(.*\S)\s*$", 1), F.regexp_extract("line", r"^\s*\[?(\d+)[\].]\s+(.*\S)\s*$", 2)
    return lines.select(key, number.try_cast("int").alias("number"), entry.alias("entry")).where("number is not null")


def bibliography_counts(docs: DataFrame, key: str, text: str, primary: str, secondary: str) -> DataFrame:
    """(key, form, n_entries, n_primary) of each text's section below a bibliography heading ("#" to "####"), which ends
    at the next heading of its level or a higher one.

    Entries are rows of a pipe table whose first filled cell is a code like S1 or [S01] (``table``); where there is none,
    lines "1. **..." (``numbered``); where there is none either, lines "**[S01]..." (``bold``). ``n_primary`` counts table
    rows of primary tier (patterns as in ``provenance.tier``), whatever their first cell is; without any, the entries of
    both other forms, each with the lines that follow it up to the next. A text without a section, an empty or a null one
    has no form and counts of 0. All of it happens inside the row.
    """
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\x01", " "), "\n"), lambda x: F.trim(x))
    heading = F.transform("_lines", lambda x, i: F.when(x.rlike(r"(?i)^#{1,4}\s+.*(?:bibliography|references)"), i))
    first = F.array_min(heading)
    rank = lambda x: F.length(F.regexp_extract(x, r"^(#\S*)", 1))
    ends = F.array_min(F.transform("_lines", lambda x, i: F.when((i > F.col("_at")) & x.startswith("#") & (rank(x) <= F.col("_rank")), i)))
    section = F.when(F.col("_at").isNull(), F.array().cast("array<string>")).otherwise(F.slice("_lines", F.col("_at") + 1, F.coalesce(ends, F.size("_lines")) - F.col("_at")))
    found = docs.select(key, lines.alias("_lines")).withColumn("_at", first).withColumn("_rank", rank(F.get("_lines", F.col("_at")))).select(key, section.alias("_s"))

    begins = lambda x: x.rlike(r"^\d+\.\s+\*\*|^\*\*\[?[A-Z]\d{1,3}\]?")
    filled_rows = F.filter("_s", lambda x: x.startswith("|") & x.endswith("|") & ~x.rlike(r"^[\s|:\-]+$"))
    counts = {
        "table": F.size(F.filter(filled_rows, lambda x: x.rlike(r"^[|\s]*\[?[A-Z]\d{1,3}\]?\s*\|"))),
        "numbered": F.size(F.filter("_s", lambda x: x.rlike(r"^\d+\.\s+\*\*"))),
        "bold": F.size(F.filter("_s", lambda x: x.rlike(r"^\*\*\[?[A-Z]\d{1,3}\]?"))),
    }
    joined = F.array_join(F.transform(F.filter("_s", lambda x: x != ""), lambda x: F.when(begins(x), F.concat(F.lit("\x01"), x)).otherwise(x)), " ")
    entries = F.transform(F.slice(F.split(joined, "\x01"), 2, 2**30), lambda x: F.rtrim(x))
    told = found.withColumns({"_rows": filled_rows, "_entries": entries, **{f"_{f}": n for f, n in counts.items()}})
    of = lambda c: F.size(F.filter(c, lambda x: tier(x, primary, secondary) == "primary"))
    form = F.coalesce(*[F.when(F.col(f"_{f}") > 0, f) for f in counts])
    n = F.coalesce(*[F.when(F.col(f"_{f}") > 0, F.col(f"_{f}")) for f in counts], F.lit(0))
    return told.select(key, form.alias("form"), n.cast("long").alias("n_entries"), F.when(of("_rows") > 0, of("_rows")).otherwise(of("_entries")).cast("long").alias("n_primary"))


def url_domains(docs: DataFrame, key: str, text: str, banned: tuple[str, ...]) -> DataFrame:
    """(host, n, n_docs, banned): URLs of texts by host."""
    found = docs.select(key, F.explode(urls(F.col(text))).alias("url")).withColumn("host", host(F.col("url")))
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_docs")).withColumn("banned", in_domains(F.col("host"), banned))


def source_cells(rows: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """Empty, not-found, present and linked cells of each source column, by key."""
    long = rows.unpivot([key], cells, "cell", "value").withColumn("v", F.lower(F.trim(F.coalesce("value", F.lit("")))))
    missing = F.col("v").isin("not found", "n/a", "unknown", "none", "-")
    return long.groupBy(key, "cell").agg(F.count_if(F.col("v") == "").alias("n_empty"), F.count_if(missing).alias("n_not_found"), F.count_if((F.col("v") != "") & ~missing).alias("n_present"), F.count_if(F.col("v").rlike(r"https?://")).alias("n_linked"))


def citation_style(rows: DataFrame, key: str, cell: str) -> DataFrame:
    """key_ref where more than half of the filled cells are codes like [3] or S3, else free."""
    cell_ = F.trim(F.coalesce(cell, F.lit("")))
    share = F.count_if(cell_.rlike(r"^\[?[A-Z]{0,3}\d{1,3}\]?$")) / F.nullif(F.count_if(cell_ != ""), F.lit(0))
    return rows.groupBy(key).agg(share.alias("share")).withColumn("style", F.when(F.col("share") > 0.5, "key_ref").otherwise("free"))


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str, needle_id: str, text_id: str, words: int = 8) -> DataFrame:
    """(needle_id, text_id): texts that hold a needle as it is.

    Both sides meet on words inside the needle (its first and last one may be parts of a text's words): on the first
    ``words`` of them, or for a needle of fewer on the longest one; the hits are then checked. A text's words are split
    once and hashed as they stand. Needles of one or two words, which hold no whole word for certain, meet texts on
    their first characters (``holders``). Null and empty needles are held by no text.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    # an array of one, so that the words are split once and not again for each of them
    bound = lambda c, f: F.element_at(F.transform(F.array(split(c)), f), 1)
    joined = lambda w, i, k: F.xxhash64(F.array_join(F.slice(w, i, k), " "))
    asked = needles.where(F.col(needle).isNotNull()).select(F.col(needle_id), F.col(needle).alias("_needle"), split(F.col(needle)).alias("_w")).withColumn("_n", F.size("_w"))
    rows = texts.select(F.col(text_id), F.col(text).alias("_text")).where("_text is not null")
    grams = bound(F.col("_text"), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: joined(w, i, words))))
    keyed = asked.where(F.col("_n") >= words + 2).withColumn("_g", joined(F.col("_w"), 2, words))
    hits = rows.withColumn("_g", F.explode(grams)).join(keyed.select(needle_id, "_needle", "_g"), "_g")
    found = hits.where(F.contains("_text", F.col("_needle"))).select(needle_id, text_id)
    few = asked.where((F.col("_n") >= 3) & (F.col("_n") < words + 2))
    if not few.isEmpty():
        inner = F.slice("_w", 2, F.col("_n") - 2)
        longest = F.reduce(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
        each = rows.withColumn("_g", F.explode(F.array_distinct(split(F.col("_text")))))
        hits = each.join(few.select(needle_id, "_needle", longest.alias("_g")), "_g")
        found = found.union(hits.where(F.contains("_text", F.col("_needle"))).select(needle_id, text_id))
    short = asked.where(F.col("_n") < 3)
    if not short.isEmpty():
        found = found.union(holders(rows, short, text_id, "_text", "_needle").join(short.select(needle_id, "_needle"), "_needle").select(needle_id, text_id))
    return found.distinct()


def counters(text: Column) -> dict[str, Column]:
    """Markup of converted documents."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {"n_tables": count(r"(?i)<table"), "n_rows": count(r"(?i)<tr"), "n_items": count(r"(?i)<li"), "n_links": count(r"(?i)<a\s"), "n_headings": count(r"(?i)<h[1-6]"), "n_lines": count("\n")}
