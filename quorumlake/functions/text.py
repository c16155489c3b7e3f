"""Column builders for names, numbers, categories and sources. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and their synonyms, as the results need them.
FUELS = {
    "coal": "coal",
    "gas": "gas",
    "natural gas": "gas",
    "local gas": "gas",
    "local natural gas": "gas",
    "lng": "imported lng",
    "imported lng": "imported lng",
    "imported gas": "imported lng",
    "oil": "oil",
}
STATUSES = {
    "operational": "operational",
    "operating": "operational",
    "retired": "retired",
    "constructing": "constructing",
    "construction": "constructing",
    "under construction": "constructing",
    "planned": "planned",
    "proposed": "proposed",
    "announced": "proposed",
    "cancelled": "cancelled",
    "canceled": "cancelled",
    "shelved": "cancelled",
}
STATUS_BANDS = ((0, 2, "proposed"), (3, 4, "planned"), (5, 5, "constructing"), (6, 6, "operational"), (9, 9, "cancelled"), (10, 10, "retired"))
LIFECYCLE = {"proposed": 0, "planned": 1, "constructing": 2, "operational": 3, "retired": 4}
CANONICAL = ("name", "fuel", "status", "status_as_of", "cod", "province", "capacity_mwe", "confidence", "source_1", "source_2", "note")
HEADERS = {
    "name": "name name_vi name_en plant plant_name plantname power_plant power_plant_name project project_name plant_name_project asset asset_name assetname",
    "fuel": "fuel fuel_type fueltype fuel_source source_fuel",
    "status": "status current_status current_status_resolution status_resolution construction_stage stage constructionstage cod_status status_cod cod_or_status",
    "status_as_of": "status_as_of status_as_of_date as_of as_of_date freshness_date",
    "cod": "cod connection_date date connectiondate",
    "province": "province location",
    "capacity_mwe": "orig_cap orig_capacity original_cap original_capacity generation_capacity installed_capacity installed_capacity_mwe total_mw total_mwe net_mw net_mwe gross_mw gross_mwe",
    "confidence": "confidence confidence_level evidence_confidence conf_provenance confidence_provenance",
    "source_1": "source_1 source reference citation",
    "source_2": "source_2 reference_2 citation_2",
    "note": "note notes comment comments",
}
PRIMARY_DOMAINS = ("gov.vn", "chinhphu.vn", "moit.gov.vn", "evn.com.vn", "globalenergymonitor.org", "gem.wiki", "platts.com", "iea.org", "irena.org")
SECONDARY_DOMAINS = ("wikipedia.org", "en.m.wikipedia.org", "bbc.com", "reuters.com", "bloomberg.com", "nikkei.com")
PRIMARY_CITATIONS = (
    r"(?iu)decision\s+(?:No\.?\s*)?\d+/(?:QD|QĐ)",
    r"(?iu)(?:PDP|quy\s+hoạch)\s*[78]",
    r"(?iu)EVN\s+(?:annual|báo\s+cáo)",
    r"(?iu)(?:annual\s+report|prospectus|10-K|10-Q)",
    r"(?iu)satellite\s+imag",
    r"(?iu)(?:MOIT|BCT|Bộ\s+Công\s+Thương)",
)
UNIT_CAP, PLANT_CAP, BLOCK_LEAST = 1350, 3200, 1300
REFUSAL = r"(?i)^\s*(?:[⚠*#]+\s*)?(?:\*+)?\s*(?:I (?:cannot|can(?:'|’)t|am unable to|won(?:'|’)t|will not|do not have|don(?:'|’)t have)|Critical Limitation|Per (?:your|my) (?:constraints?|operational constraints))"
MERGED_NAME = r"\d\s*&\s*\d|[ivxIVX]+\s*&\s*[ivxIVX]+|[ivxIVX0-9]\s*\+\s*[ivxIVX0-9]|\d\s*và\s*\d|\d\s*[-–]\s*\d"
TRUNCATING = ("length", "content_filter", "error")
CONTEXT_SHARE, SHORT_STOP = 0.9, 200


def _fold_table() -> tuple[str, str]:
    """Latin letters whose decomposition is a base letter and marks, with their base."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0xC0, 0x1F00)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def fold(c: Column, stroke: bool = True) -> Column:
    """Without diacritics (precomposed or combining); ``stroke`` also turns đ into d."""
    out = F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")
    return F.translate(out, "đĐ", "dD") if stroke else out


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean(c: Column, drops: tuple[str, ...] = (), substitutions: tuple[tuple[str, str], ...] = ()) -> Column:
    """Lower case, no diacritics, without ``drops`` and with ``substitutions`` (patterns, in order), spaces squeezed."""
    out = fold(F.trim(F.lower(c)))
    for pattern in drops:
        out = F.regexp_replace(out, pattern, " ")
    for pattern, to in substitutions:
        out = F.regexp_replace(out, pattern, to)
    return squeezed(out)


def clean_name(c: Column, drops: tuple[str, ...] = (), substitutions: tuple[tuple[str, str], ...] = ()) -> Column:
    """``clean``, or the name without drops where they leave nothing."""
    return F.coalesce(F.nullif(clean(c, drops, substitutions), F.lit("")), clean(c, (), substitutions))


def clean_fuel(c: Column) -> Column:
    """Parts of a mixed fuel, sorted."""
    return F.array_join(F.array_sort(F.transform(F.split(clean(c), "/"), lambda x: F.trim(x))), "/")


def clean_capacity(c: Column) -> Column:
    """The first number of a text as double; null if there is none."""
    return F.regexp_extract(c, r"(\d*\.?\d+)", 1).try_cast("double")


def number(c: Column, integer_expected: bool = False) -> Column:
    """A number with either culture's separators: the last of two kinds is the decimal one, commas before groups of
    three are thousands, and so are lone dots if an integer is expected. Null if it is no number."""
    raw = F.regexp_replace(c, r"[\s ]", "")
    comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    last_comma = F.length(raw) - F.locate(",", F.reverse(raw)) > F.length(raw) - F.locate(".", F.reverse(raw))
    point = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")
    plain = lambda x: F.regexp_replace(x, ",", "")
    out = F.when(comma & dot, F.when(last_comma, point(raw)).otherwise(plain(raw)))
    out = out.when(comma, F.when(raw.rlike(r"^[^,]*(,[^,]{3})+$"), plain(raw)).otherwise(F.regexp_replace(raw, ",", ".")))
    if integer_expected:
        out = out.when(dot & raw.rlike(r"^[^.]*(\.[^.]{3})+$"), F.regexp_replace(raw, r"\.", ""))
    return out.otherwise(raw).try_cast("double")


def capacity_text(c: Column) -> Column:
    """The number of a capacity cell, whole or its first run of digits after ~ ≈ ≤ ≥ < >; "0" if there is none."""
    stripped = F.regexp_replace(c, "[~≈≤≥<>]", "")
    run = F.regexp_extract(stripped, r"(\d[\d.,  ]*)", 1)
    run = F.regexp_replace(run, r"[.,\s]+$", "")
    value = F.coalesce(number(c, True), number(run, True), F.lit(0.0))
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def fuel(c: Column) -> Column:
    return F.coalesce(F.element_at(_map(FUELS), F.lower(F.trim(c))), F.lit("unknown"))


def status(c: Column) -> Column:
    """A leading ordinal's band, or else a synonym's status."""
    text = F.lower(F.trim(c))
    ordinal = F.regexp_extract(text, r"^(\d+)(?:\s|$)", 1).try_cast("int")
    band = F.lit(None).cast("string")
    for low, high, name in STATUS_BANDS:
        band = F.when(ordinal.between(low, high), F.lit(name)).otherwise(band)
    return F.coalesce(F.when(ordinal.isNotNull(), F.coalesce(band, F.lit("unknown"))), F.element_at(_map(STATUSES), text), F.lit("unknown"))


def header_key(c: Column) -> Column:
    out = F.regexp_replace(fold(F.lower(F.trim(c)), stroke=False), r"\([^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_header(c: Column) -> Column:
    """The canonical column that a header names, or null."""
    key = header_key(c)
    out = F.element_at(_map({word: name for name, words in HEADERS.items() for word in words.split()}), key)
    return F.coalesce(out, F.when(key.startswith("capacity"), F.lit("capacity_mwe")))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def source_by_url(c: Column) -> Column:
    low = F.lower(c)
    has = lambda domains: F.greatest(*[F.contains(low, F.lit(d)) for d in domains])
    return F.when(has(PRIMARY_DOMAINS), "primary").when(has(SECONDARY_DOMAINS), "secondary").otherwise("unknown")


def source_by_text(c: Column) -> Column:
    text = F.coalesce(F.trim(c), F.lit(""))
    primary = text.rlike(PRIMARY_CITATIONS[0])
    for pattern in PRIMARY_CITATIONS[1:]:
        primary = primary | text.rlike(pattern)
    url = F.regexp_extract(text, r"https?://[^\s]+", 0)
    return F.when((text == "") | (F.lower(text) == "none"), "none").when(primary, "primary").when(url != "", source_by_url(url)).when(text.rlike(r"\d") | (F.length(text) > 30), "secondary").otherwise("none")


def evidence_score(types: Column) -> Column:
    """0 to 4 from an array of source types: any hallucinated 0, none 1, secondary 2, one primary 3, several 4."""
    of = lambda name: F.size(F.filter(types, lambda t: t == name))
    return F.when(of("hallucinated") > 0, 0).when(of("primary") >= 2, 4).when(of("primary") == 1, 3).when(of("secondary") >= 1, 2).otherwise(1)


def refusal(c: Column) -> Column:
    return F.substring(F.ltrim(c), 1, 400).rlike(REFUSAL)


def run_category(error: Column, text: Column, finish: Column, prompt_tokens: Column, window: Column) -> Column:
    """The first failing check of a run, or ok."""
    return (
        F.when(F.coalesce(error, F.lit(False)), "provider_error")
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty")
        .when(F.coalesce(finish.isin(*TRUNCATING), F.lit(False)), "truncated_output")
        .when(F.coalesce(prompt_tokens > CONTEXT_SHARE * window, F.lit(False)), "truncated_input")
        .otherwise("ok")
    )


def short_stop(text: Column, finish: Column) -> Column:
    return (finish == "stop") & (F.length(F.trim(text)) < SHORT_STOP)


def capacity_plausible(level: Column, capacity: Column) -> Column:
    lv = F.lower(level)
    return F.when(capacity.isNull(), None).when(lv == "unit", capacity <= UNIT_CAP).when(lv == "plant", capacity <= PLANT_CAP).when(lv == "block", capacity >= BLOCK_LEAST).when(lv == "complex", capacity > 0)


def level_of_address(complex_: Column, plant: Column, unit: Column) -> Column:
    """The finest part of an address that is filled."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(has(unit), "unit").when(has(plant), "plant").when(has(complex_), "complex").otherwise("unknown")


def name_of_address(complex_: Column, plant: Column, unit: Column) -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.when(filled(unit).isNotNull(), F.concat_ws(" ", filled(plant), filled(unit))), filled(plant), filled(complex_))


def lifecycle_compatible(asserted: Column, reference: Column, vintage: Column, year: Column) -> Column:
    """Equal, or an earlier stage seen no later than the reference's year."""
    rank = _map({k: str(v) for k, v in LIFECYCLE.items()})
    a, r = F.element_at(rank, asserted).cast("int"), F.element_at(rank, reference).cast("int")
    return (asserted == reference) | F.coalesce((a <= r) & (vintage <= year), F.lit(False))


def passes_gate(tau: Column | float, *dimensions: Column) -> Column:
    """No dimension that is there is at or below ``tau``."""
    return F.coalesce((F.least(*dimensions) if len(dimensions) > 1 else dimensions[0]) > tau, F.lit(True))


def job_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12)


def without_provider(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def without_run(c: Column) -> Column:
    return F.regexp_replace(c, r"-run\d+$", "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s)\]>\"']+"), F.lit(0))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1)


def in_domains(host_: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of ``domains`` or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host_ == d) | host_.endswith(f".{d}")
    return out
