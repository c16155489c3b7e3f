"""PII by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import documents, dropped, spare, written
from quorumlake.llm.spans import SPAN_TYPE, quoted, spans

#: Base kinds in their order, as Java patterns. Possessive loops match what the plain ones match here (what follows a
#: loop is never in its class) and need neither backtracking nor stack on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain to be searched for a kind.
NEEDS = {"email": "contains({t}, '@')", "phone": "contains({t}, '+')", "ip": "{t} rlike '[0-9]'", "card": "{t} rlike '[0-9]{{2}}|[0-9][ -][0-9]'"}
#: Candidates that the method may add, as Java patterns.
MORE = {
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}+(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,64}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,64}+)+",
    "titled_name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?",
}
#: Given names, country codes of IBANs and mail hosts of the gazetteer.
GAZETTEER = {
    "name": "Alice Ana Andreas Anna Anne Antonio Carlos Carmen Charles David Elena Emma Francisco Hans Isabel James Jean John Jose Juan Julia Karl Klaus Laura Louis Lucia Luis Marie Maria Mark Martin Mary Michael Miguel Paul Pedro Peter Pierre Robert Sarah Sofia Stefan Susan Thomas William Wolfgang",
    "country": "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE",
    "host": "gmail yahoo hotmail outlook example proton icloud gmx web orange",
}
#: Words near a span that speak for and against personal data, in four languages.
FOR_WORDS = "account address anruf bank call card carte contact correo cuenta email iban kontakt llame mail mobile name nom phone reach security social ssn tarjeta tel teléfono telefon téléphone"
AGAINST_WORDS = "article build chapter code commit example figure invoice isbn item model order page part product ref reference release section serial sku table ticket version"
EM_ROUNDS, SMOOTHING = 50, 1.0
VOTERS = ("regex", "gazetteer", "near", "against", "shape")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    """Whether the digits of SQL string ``v`` pass Luhn: every second one from the right is doubled."""
    d, c = f"reverse({_digits(v)})", "cast(substr(d, i, 1) as bigint)"
    one = f"case when i % 2 = 1 then {c} else (2 * {c}) div 10 + (2 * {c}) % 10 end"
    return f"transform(array({d}), d -> aggregate(transform(sequence(1, length(d)), i -> {one}), 0L, (a, b) -> a + b) % 10 = 0)[0]"


def _valid(kind: str, v: str) -> str:
    if kind == "ip":
        return f"forall(split({v}, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and cast(right(p, 3) as int) <= 255)"
    if kind == "card":
        return f"case when length({_digits(v)}) between 12 and 19 then {_luhn(v)} else false end"
    return f"length({_digits(v)}) between 9 and 15" if kind == "phone" else "true"


def _search(df: DataFrame, text: str, kinds: dict[str, str], mark: str) -> DataFrame:
    """Adds <mark><kind>, the kind's spans."""
    for kind, pattern in kinds.items():
        need = NEEDS.get(kind, "{t} rlike '[0-9]'" if kind in ("ssn", "local_phone", "iban") else "true").format(t=text)
        df = df.withColumn(f"{mark}{kind}", F.when(F.expr(need), spans(text, pattern)).otherwise(F.expr(f"cast(array() as {SPAN_TYPE})")))
    return df


def base_spans(docs: DataFrame, text: str, mark: str) -> DataFrame:
    """Adds <mark>email, ip, card and phone: the valid matches of each base kind (failing ones are dropped, with no retry)."""
    df = _search(docs, text, BASE, mark)
    for kind in ("ip", "card", "phone"):
        df = df.withColumn(f"{mark}{kind}", F.expr(f"filter({mark}{kind}, x -> {_valid(kind, 'x.value')})"))
    return df


def _words(list_: str) -> str:
    return "(?iu)(?<!\\p{L})(?:" + "|".join(sorted(list_.split())) + ")(?!\\p{L})"


def _votes(kind: str, x: str) -> dict[str, str]:
    """SQL of each voter on span ``x``: 1 for, -1 against, 0 abstains."""
    v = f"{x}.value"
    strict = {
        "ssn": f"case when {v} rlike '^(000|666|9)|-00-|-0000$' then -1 else 1 end",
        "local_phone": f"case when {_digits(v)} rlike '^[2-9][0-9]{{2}}[2-9]' then 1 else -1 end",
        "iban": f"case when length(replace({v}, ' ', '')) between 15 and 34 and {v} rlike '[0-9]{{4}}' then 1 else -1 end",
        "spelled_email": f"case when {v} rlike '[A-Za-z]{{2,}}$' then 1 else -1 end",
        "titled_name": "0",
    }[kind]
    names = {"titled_name": _words(GAZETTEER["name"]), "iban": "^(" + "|".join(GAZETTEER["country"].split()) + ")", "spelled_email": _words(GAZETTEER["host"])}.get(kind)
    listed = f"case when {v} rlike {quoted(names)} then 1 else {0 if kind == 'spelled_email' else -1} end" if names else "0"
    near = f"concat({x}.before, ' | ', {x}.after)"
    return {
        "regex": strict,
        "gazetteer": listed,
        "near": f"case when {near} rlike {quoted(_words(FOR_WORDS))} then 1 else 0 end",
        "against": f"case when {near} rlike {quoted(_words(AGAINST_WORDS))} then -1 else 0 end",
        "shape": f"case when {_digits(v)} rlike '([0-9])\\\\1{{4}}|^0?123456' then -1 else 0 end",
    }


def _features(kind: str, x: str) -> list[str]:
    """SQL of the final classifier's features of a span; the same for all kinds, so that one model serves them."""
    v = _votes(kind, x)
    size = f"{x}.stop - {x}.start"
    return [*(f"cast(({k} = '{kind}') as double)" for k in (f"'{m}'" for m in MORE)), *(f"cast(({v[n]}) as double)" for n in VOTERS), f"({size}) / 40D", f"length({_digits(x + '.value')}) / double({size})"]


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, the voters' votes, features), a row for each candidate span; none for null and empty texts."""
    df = _search(docs.select(text), text, MORE, "_")
    each = [F.expr(f"transform(_{k}, x -> named_struct('kind', '{k}', 'votes', array({', '.join(_votes(k, 'x').values())}), 'features', array({', '.join(_features(k, 'x'))})))") for k in MORE]
    return df.select(F.explode(F.concat(*each)).alias("c")).select("c.*")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]]]:
    """EM over vote patterns and their counts: the share of true spans and each voter's vote probabilities for true and
    false ones. Starts from the majority vote; SMOOTHING counts are added to each vote."""
    post = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns]
    prior, voters = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = (sum(p * n for p, (_, n) in zip(post, patterns, strict=True)) + SMOOTHING) / (total + 2 * SMOOTHING)
        voters = []
        for j in range(len(VOTERS)):
            table = ({-1: SMOOTHING, 0: SMOOTHING, 1: SMOOTHING}, {-1: SMOOTHING, 0: SMOOTHING, 1: SMOOTHING})
            # a vote for says at least as much for truth as a vote against: one pseudo-count leans that way
            table[0][1] += SMOOTHING
            table[1][-1] += SMOOTHING
            for p, (v, n) in zip(post, patterns, strict=True):
                table[0][v[j]] += p * n
                table[1][v[j]] += (1 - p) * n
            voters.append(tuple({k: c / sum(t.values()) for k, c in t.items()} for t in table))
        post = [posterior(v, prior, voters) for v, _ in patterns]
    return prior, voters


def posterior(votes: tuple[int, ...], prior: float, voters: list) -> float:
    odds = math.log(prior) - math.log(1 - prior) + sum(math.log(a[v]) - math.log(b[v]) for v, (a, b) in zip(votes, voters, strict=True))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def fit(docs: DataFrame, text: str = "text") -> list[float] | None:
    """Weights of the final classifier (intercept first), or None if the corpus has no candidate.

    The driver gets at most 3 ** len(VOTERS) vote patterns with their counts; the classifier is a logistic regression
    over all candidates, each weighed by the posterior of being true and of being false.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = written(candidates(docs, text).groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "pii-candidates")
    counts = [(tuple(r["votes"]), r["n"]) for r in rows.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()]
    if not counts:
        return None
    prior, voters = reliabilities(counts)
    true = F.lit(math.log(prior) - math.log(1 - prior))
    for j, (a, b) in enumerate(voters):
        table = F.create_map(*[y for v in (-1, 0, 1) for y in (F.lit(v), F.lit(math.log(a[v]) - math.log(b[v])))])
        true = true + F.element_at(table, F.element_at("votes", j + 1))
    p = 1 / (1 + F.exp(-true))
    both = rows.select(array_to_vector("features").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (p * F.col("n")).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - p) * F.col("n")).alias("weight")))).alias("y")).select("features", "y.*")
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=50).fit(both)
    dropped(rows)
    return [float(model.intercept), *(float(x) for x in model.coefficients)]


def find(docs: DataFrame, weights: list[float] | None, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_spans and all_spans (arrays of (start, rank, kind, stop), by start and
    then kind) to ``docs``; columns of these names give way, all others stay. Spans that the method adds overlap no base
    span. A null or empty text has no spans."""
    names, mark = [*BASE, *MORE], spare(docs.columns, "_")
    own = ["base_spans", *(f"n_{k}" for k in BASE), "all_spans"]
    df = base_spans(docs, text, mark)
    shape = lambda kind: f"transform({mark}{kind}, x -> named_struct('start', x.start, 'rank', {names.index(kind)}, 'kind', '{kind}', 'stop', x.stop))"
    df = df.withColumn("base_spans", F.expr(f"array_sort(concat({', '.join(shape(k) for k in BASE)}))"))
    for kind in BASE:
        df = df.withColumn(f"n_{kind}", F.size(f"{mark}{kind}").cast("long"))
    if weights is None:
        df = df.withColumn("all_spans", F.col("base_spans"))
    else:
        df = _search(df, text, MORE, mark)
        for kind in MORE:
            score = " + ".join([f"({weights[0]!r}D)", *(f"({w!r}D) * {f}" for w, f in zip(weights[1:], _features(kind, "x"), strict=True))])
            df = df.withColumn(f"{mark}{kind}", F.expr(f"filter({mark}{kind}, x -> not exists(base_spans, b -> b.start < x.stop and x.start < b.stop) and ({score}) > 0)"))
        df = df.withColumn("all_spans", F.expr(f"array_sort(concat(base_spans, {', '.join(shape(k) for k in MORE)}))"))
    return df.select(*(c for c in docs.columns if c not in own), *own)


def told(spans_: str) -> Column:
    return F.expr(f"array_join(transform({spans_}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row, repeated ones and those without a
    doc_id included. Whole texts are searched (null: empty, no spans: the digest of no bytes); a table without any
    candidate gives the base spans alone, an empty one an empty result. Columns but doc_id and text are not read."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(told("base_spans"), 256).alias("base_sha256"), told("all_spans").alias("spans"))
