"""Sources of rows and records: references, tiers, links, names against files, atomic names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import MERGED_NAME
from quorumlake.operators.fuzzy_join import alike

CITATION_LEAST, LINE_LEAST = 70.0, 60.0
# What a note says that admits doubt.
HONEST = ("uncertain", "conflicting", "no data", "unclear", "estimated", "approximate", "planned but", "discrepancy", "unconfirmed")

# Cells that hold nothing, and what a cell says whose source was not found.
EMPTY_CELLS = ("", "—", "–", "-", "n/a", "na", "none")
NOT_FOUND = ("not found", "url not verified", "not verified", "not available", "unable to verify", "could not verify", "no source", "unverified")
KEY_CELL = r"^\s*\[?[A-Z]\d{1,3}\]?(?:\(https?://[^)]*\))?\s*$"


def tier(reference: Column, primary: str, secondary: str) -> Column:
    """primary, secondary or tertiary by patterns; an empty reference is tertiary."""
    text = F.coalesce(reference, F.lit(""))
    return F.when(F.lower(F.trim(text)).isin("", "none", "n/a", "not found", "-"), "tertiary").when(text.rlike(primary), "primary").when(text.rlike(secondary), "secondary").otherwise("tertiary")


def atomic(name: Column) -> Column:
    """Whether a name holds one entity (no joined or ranged numbers)."""
    return ~F.coalesce(name.rlike(MERGED_NAME), F.lit(False))


def level_consistent(name: Column, level: Column) -> Column:
    """Null where the name or level says nothing; else false for a unit whose name joins or numbers several, a unit named
    as site and number, and a unit or plant named as a bare site."""
    text, lv = F.trim(name), F.lower(level)
    bare = ~text.rlike(r"\d|\b[IVX]+\b")
    numbered = text.rlike(r"(?:\d+|\b[IVX]+)$") & ~text.rlike(r"(?i)\b(?:unit|tổ máy|s)\s*\d+$")
    bad = ((lv == "unit") & (~atomic(text) | numbered)) | (lv.isin("unit", "plant") & bare)
    return F.when((text != "") & lv.isin("unit", "block", "plant", "complex"), ~bad)


def honest(note: Column) -> Column:
    """Whether a note holds one of HONEST, in any case; a null note holds none."""
    return F.coalesce(note.rlike("(?i)" + "|".join(HONEST)), F.lit(False))


def linked_cells(rows: DataFrame, key: str, cell: str, bibliography: DataFrame) -> DataFrame:
    """Adds ``links``: a cell's codes [n] as the URLs of its text's numbered bibliography (key, number, entry)."""
    urls = bibliography.select(key, "number", F.regexp_extract("entry", r"https?://[^\s)\]>]+", 0).alias("url")).where("url <> ''")
    codes = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_n", F.explode_outer(F.regexp_extract_all(cell, F.lit(r"\[(\d{1,4})\]"), F.lit(1))))
    found = codes.join(urls.withColumnRenamed("number", "_number"), (codes[key] == urls[key]) & (F.col("_n").cast("int") == F.col("_number")), "left").drop(urls[key])
    return found.groupBy("_row", *[F.col(c) for c in rows.columns]).agg(F.array_sort(F.collect_set("url")).alias("links")).drop("_row")


def resolved_keys(rows: DataFrame, key: str, code: str, bibliography: DataFrame, number: str) -> DataFrame:
    """Rows whose code occurs in their text's bibliography."""
    known = bibliography.select(F.col(key), F.col(number).alias(code)).distinct()
    return rows.join(known.withColumn("resolved", F.lit(True)), [key, code], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def wiki_names(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, name): the first cell of each row of a text's first wiki table, without markup."""
    table = F.regexp_extract(text, r"(?s)\{\|(.*?)\n\|\}", 1)
    rows = texts.select(key, F.posexplode(F.split(table, r"\n\|-[^\n]*")).alias("row_no", "row")).where("row_no > 0")
    first = F.regexp_extract("row", r"(?s)^\s*[|!]\s*(?:[^|\n\[\]]*\|(?!\|))?(.*?)(?:\|\||\n|$)", 1)
    plain = F.regexp_replace(F.regexp_replace(first, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), r"'{2,}|<[^>]*>|\{\{[^}]*\}\}", "")
    return rows.select(key, "row_no", F.trim(plain).alias("name")).where("name <> ''")


def citation_files(citations: DataFrame, files: DataFrame, citation: str, file: str, least: float = CITATION_LEAST) -> DataFrame:
    """The file of each distinct citation whose name is nearest on sorted tokens, the first of equals."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)|\bpp?\.\s*\d+(?:-\d+)?|\.md$", " "), r"[^a-z0-9]+", " "))
    asked = citations.select(citation, norm(F.col(citation)).alias("_asked")).distinct()
    known = files.select(file, norm(F.col(file)).alias("_known")).distinct()
    scored = alike(asked, known, "_asked", "_known", "token_sort_ratio", least).join(asked, "_asked").join(known, "_known")
    return scored.groupBy(citation).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(file).alias("f"))).alias("_m")).select(citation, F.col("_m.f").alias(file), (-F.col("_m.s")).alias("score"))


def json_array(text: Column, schema: str) -> Column:
    """An array of records in a reply: fences are dropped, and the widest bracketed part is tried where the whole is not
    JSON. Null if neither parses."""
    bare = F.trim(F.regexp_replace(text, r"(?m)^```[a-z]*\s*$", ""))
    whole, part = F.from_json(bare, f"array<{schema}>"), F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), f"array<{schema}>")
    return F.coalesce(F.when(bare.startswith("["), whole), part)


def verdict_rate(rows: DataFrame, key: str, verdict: str) -> DataFrame:
    """Share of supported among the verdicts that are no errors; null where there is none."""
    told = F.col(verdict) != "error"
    return rows.groupBy(key).agg(F.avg(F.when(told, (F.col(verdict) == "supported").cast("double"))).alias("rate"), F.count_if(told).alias("n"))


def coded_bibliography(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, url): entries ``**[N]** ... URL: `...` `` below a bibliography heading; the last of a number counts, those
    without a URL are left out."""
    part = F.regexp_extract(text, r"(?is)(?:^|\n)#{1,4}\s+[^\n]*(?:bibliography|references)[^\n]*\n(.*)$", 1)
    lines = docs.select(key, F.posexplode(F.split(part, "\n")).alias("_at", "_line"))
    found = lines.select(key, "_at", F.regexp_extract(F.trim("_line"), r"^\*{0,2}\[(\d+)\]", 1).alias("code"), F.regexp_extract("_line", r"URL:\s+`(https?://[^`]+)`", 1).alias("url"))
    return found.where("code <> '' and url <> ''").groupBy(key, "code").agg(F.max_by("url", "_at").alias("url"))


def source_tables(rows: DataFrame, key: str, least: int = 8) -> DataFrame:
    """(key, row_no, head, cells): the body rows of each text's first table (of ``extract.pipe_table_rows``) with ``least``
    columns and one named Source 1; repeated headers are left out."""
    named = lambda c: F.exists(c, lambda x: F.lower(x).isin("source 1", "src 1"))
    heads = rows.where((F.col("row_no") == 0) & (F.size("cells") >= least) & named(F.col("cells")))
    first = heads.groupBy(key).agg(F.min_by("table_no", "line_no").alias("table_no"), F.min_by("cells", "line_no").alias("head"))
    again = F.exists("cells", lambda x: F.lower(x).isin("source 1", "source 2", "src 1", "src 2"))
    return rows.where("row_no > 0").join(first, [key, "table_no"]).where(~again).select(key, "row_no", "head", "cells")


def source_urls(cells: DataFrame, key: str, cell: str, entries: DataFrame) -> DataFrame:
    """Adds ``url``: of a cell that is a code [N], its entry's (key, code, url); else the first URL in the cell; else null."""
    code = F.regexp_extract(F.coalesce(cell, F.lit("")), r"^\s*\[(\d+)\]\s*$", 1)
    rows = cells.withColumn("code", code).join(entries.withColumnRenamed("url", "_entry"), [key, "code"], "left")
    inline = F.nullif(F.regexp_extract(F.coalesce(cell, F.lit("")), r"https?://[^\s)>\]]+", 0), F.lit(""))
    return rows.withColumn("url", F.when(F.col("code") != "", F.col("_entry")).otherwise(inline)).drop("code", "_entry")


def source_cell_quality(rows: DataFrame, key: str, sources: list[str], bibliography: DataFrame, section: str, primary: str, secondary: str) -> DataFrame:
    """(key, cell, style, n_empty, n_not_found, n_present, n_valid, n_primary) for each source column of each text.

    A text's style is key_ref where more than half of its filled source cells are codes like S01 or [S01](url), else
    inline. Of the present cells (neither empty nor saying that nothing was found) ``n_valid`` counts those whose code is in
    the text's bibliography (key, ``section``; one a text), null for inline ones; ``n_primary``
    those of primary tier: of the first line of the bibliography that has the code, or of the cell itself if inline.
    """
    long = rows.unpivot([key], sources, "cell", "_v").withColumn("_v", F.coalesce("_v", F.lit("")))
    low = F.lower(F.trim("_v"))
    long = long.withColumn("_empty", low.isin(*EMPTY_CELLS)).withColumn("_lost", ~F.col("_empty") & low.rlike("|".join(NOT_FOUND)))
    share = F.try_divide(F.count_if(~F.col("_empty") & F.col("_v").rlike(KEY_CELL)), F.count_if(~F.col("_empty")))
    styles = long.groupBy(key).agg(F.when(share > 0.5, "key_ref").otherwise("inline").alias("style"))
    told = long.join(styles, key).join(bibliography.select(key, F.col(section).alias("_b")), key, "left")
    code = F.regexp_extract("_v", r"\[?([A-Z]\d{1,3})\]?", 1)
    word = F.concat(F.lit(r"\b"), code, F.lit(r"\b"))
    line = F.get(F.filter(F.split("_b", "\n"), lambda x: F.rlike(x, word)), F.lit(0))
    known = (code != "") & line.isNotNull()
    first = F.when(F.col("style") == "key_ref", F.when(known, line)).otherwise(F.col("_v"))
    present = ~F.col("_empty") & ~F.col("_lost")
    valid = F.when(F.first("style") == "key_ref", F.count_if(present & known))
    return told.groupBy(key, "cell").agg(F.first("style").alias("style"), F.count_if("_empty").alias("n_empty"), F.count_if("_lost").alias("n_not_found"), F.count_if(present).alias("n_present"), valid.alias("n_valid"), F.count_if(present & (tier(first, primary, secondary) == "primary")).alias("n_primary"))
