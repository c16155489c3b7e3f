"""Secret scan: regex candidates, and a random forest trained on labelled findings that removes false positives.

Everything on the executors is DataFrame expressions and Spark ML's JVM trees; no Python runs there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import documents, dropped, spare, table_path
from quorumlake.llm.spans import quoted, spans

#: Names of settings whose values are secrets.
KEY_NAMES = "access_key access_token api_key apikey auth_token client_secret passwd password private_key pwd secret secret_key token"
#: A setting whose name holds one of these, up to its value: the rest of the name, a sign, quotes.
SETTING = "(?i:" + "|".join(sorted(KEY_NAMES.split(), key=len, reverse=True)) + r")[A-Za-z0-9_]*+[\"']?\s{0,2}[:=]\s{0,2}[\"']?"
#: Candidates: a provider's form, the value of a setting, or a run of 16 characters or more with a digit that is not
#: itself a setting's name.
CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
    "|" + SETTING + r"[^\s\"'<>,;]{8,}"
    r"|(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{16,}+={0,2}+(?![\"']?\s{0,2}[:=]\s{0,2}[\"']?[^\s\"'<>,;]{8})"
)
#: Common words and parts of words of prose and of identifiers, which random strings rarely hold.
DICTIONARY = (
    "able access action admin align and app are auf base build cach char check class client code com common config const content context core count create data date default demo dev dis doc edit en ent er event example ez file "
    "final find for form from func gener get group handle heit help home html http icon image index info ing input int ion ist item java key keit lang layout level lib license line link list load local log main man map ment "
    "message meta method model module name net new not null num object option order org out over page param part pass path per port pre process product project public query que read ref release report request result row run "
    "sample sch select service session set size source spec start state status string sub sum system table task temp template test text the tion title tool type ung update url user util value var ver version view web width with word work www your"
)
NEAR_FOR = "access api auth aws bearer credential key login passwd password private pwd secret token"
NEAR_AGAINST = "article build checksum commit digest dummy etag example fingerprint hash id image invoice isbn item md5 model number order part placeholder reference release revision sample serial sha sha1 sha256 test ticket uuid version"
FEATURES = ("length", "digits", "upper", "distinct", "transitions", "vowels", "covered", "path", "assigned", "provider", "hex", "near_for", "near_against", "repeats")
#: Labelled findings that the default training set has; trees and their depth; the score from which a finding counts.
FINDINGS, TREES, DEPTH, THRESHOLD = 6000, 24, 8, 0.5


def _any(words: str) -> str:
    return "(?i)(?<![a-z0-9])(?:" + "|".join(sorted(words.split())) + ")(?![a-z0-9])"


def secret_part(value: Column | str = "value") -> Column:
    """The value of a candidate without its setting's name."""
    return F.regexp_replace(value, "^" + SETTING, "")


def features(body: Column, value: Column, before: Column, after: Column) -> Column:
    """An array of FEATURES, as doubles: length, shares of digits, capitals, distinct characters and vowels, transitions
    between character classes, dictionary coverage, path marks, the setting and words around the value."""
    size = F.greatest(F.length(body), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(body, F.lit(pattern)) / size
    words = "|".join(sorted((w for w in DICTIONARY.split() if len(w) > 2), key=lambda w: (-len(w), w)))
    near = F.concat_ws(" ", F.right(before, F.lit(32)), F.left(after, F.lit(16)))
    flag = lambda c: c.cast("double")
    columns = {
        "length": F.least(size, F.lit(128.0)),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(body, ""))) / F.least(size, F.lit(64.0)),
        "transitions": share("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        "vowels": share("[aeiouAEIOU]"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(body), words, "")) / size,
        "path": flag(body.rlike(r"^[./~]|/.*/|\.[a-z]{2,4}$|^www|://")) + flag(before.rlike(r"(://|[/\\])\S*$")),
        "assigned": flag(value.rlike("^" + SETTING)),
        "provider": flag(body.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^sk-|^xox[abp]-|^eyJ")),
        "hex": flag(body.rlike("^[0-9a-f]{16,}$|^[0-9A-F]{16,}$")),
        "near_for": flag(near.rlike(_any(NEAR_FOR))),
        "near_against": flag(near.rlike(_any(NEAR_AGAINST))),
        "repeats": share(r"(.)\1\1|0123|1234|abcd|xxx"),
    }
    return F.array(*[columns[c].cast("double") for c in FEATURES])


def with_features(findings: DataFrame) -> DataFrame:
    """Adds ``features`` to (value, before, after), none of them null."""
    parts = F.col("_body"), F.col("value"), F.col("before"), F.col("after")
    return findings.withColumn("_body", secret_part()).withColumn("features", array_to_vector(features(*parts))).drop("_body")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(value, before, after, label): a labelled set made by rule, n rows. Secrets are keys of several forms, bare or
    set to a name; the others are what such scans find wrongly: ids, digests, versions, paths, numbers, placeholders
    and identifiers of words. Pass a team's own labelled findings in its place."""
    words = F.split(F.lit(DICTIONARY), " ")
    h = lambda salt: F.sha2(F.concat(F.col("id"), F.lit(salt)), 256)
    pick = lambda salt, of: F.element_at(of, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(of)) + 1).cast("int"))
    upper = lambda salt: F.substring(F.translate(F.upper(F.base64(F.unhex(h(salt)))), "+/=018", "XYZABC"), 1, 16)
    base = lambda salt, k: F.substring(F.translate(F.base64(F.unhex(h(salt))), "+/=", "AbC"), 1, k)
    w = [pick(f"w{k}", words) for k in range(8)]
    prose = F.concat_ws(" ", w[0], w[1], w[2], F.lit(""))
    name = pick("name", F.split(F.lit(KEY_NAMES), " "))
    name = F.when(F.xxhash64("id", F.lit("case")) % 2 == 0, name).otherwise(F.upper(name))
    setting = F.concat(name, pick("rest", F.array(*map(F.lit, ("", "", "_ID", "_prod", "2")))), pick("sign", F.array(*map(F.lit, ("=", ": ", " = \"", "=\"")))))
    named = F.concat(prose, pick("start", F.array(*map(F.lit, ("", "", "MY_", "AWS_", "db_")))))  # a setting's name may begin before what is listed
    digits = lambda salt, k: F.substring(F.translate(h(salt), "abcdef", "123456"), 1, k)
    uuid = F.concat_ws("-", *[F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    near = F.concat(pick("bad", F.split(F.lit(NEAR_AGAINST), " ")), pick("colon", F.array(*map(F.lit, (" ", ": ", "=")))))
    yes = [
        (F.concat(pick("aws", F.array(F.lit("AKIA"), F.lit("ASIA"))), upper("k")), prose),
        (F.concat(setting, F.substring(h("s"), 1, 40)), named),
        (F.concat(setting, F.substring(h("s"), 1, 18)), named),
        (F.concat(setting, base("s", 24)), named),
        (F.concat(setting, pick("aws", F.array(F.lit("AKIA"), F.lit("ASIA"))), upper("k")), named),
        (F.concat(F.lit("ghp_"), base("g", 36)), prose),
        (base("b", 40), F.concat(prose, pick("good", F.split(F.lit(NEAR_FOR), " ")), F.lit(" "))),
    ]
    no = [
        (uuid, prose),
        (F.substring(h("c"), 1, 40), F.concat(prose, near)),
        (h("d"), F.concat(prose, near)),
        (digits("n", 18), prose),
        (F.concat(w[3], w[4], w[5], digits("v", 3), w[6]), prose),
        (F.concat_ws("/", F.lit("src"), w[3], w[4], F.concat(w[5], digits("v", 2), F.lit(".java"))), prose),
        (F.concat(setting, F.concat_ws("_", F.lit("your"), w[3], w[4], digits("v", 2))), named),
        (F.concat(F.repeat(F.lit("x"), 14), digits("v", 4)), prose),
        (F.concat_ws("-", w[3], w[4], digits("v", 4), w[5], w[6]), prose),
        (F.concat_ws(".", w[3], digits("a", 2), digits("b", 2), w[4], w[5]), prose),
        (F.concat(w[3], F.initcap(w[4]), F.initcap(w[5]), digits("v", 1), F.initcap(w[6])), prose),
    ]
    kinds = F.array(*[F.struct(v.alias("value"), b.alias("before"), F.lit(label).alias("label")) for label, rows in ((1.0, yes), (0.0, no)) for v, b in rows])
    kind = F.when(F.col("id") % 2 == 0, F.col("id") / 2 % len(yes)).otherwise(len(yes) + (F.col("id") - 1) / 2 % len(no)).cast("int")
    rows = spark.range(0, n, 1, 4).withColumn("x", F.element_at(kinds, kind + 1))
    return rows.select("x.value", "x.before", F.concat(F.lit(" "), w[7]).alias("after"), "x.label")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest over (value, before, after, label); equal rows in equal order give an equal forest."""
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label").fit(with_features(labelled).select("features", "label"))
    return model.copy()  # without the training summary, which holds the session and can't always go to executors


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text") -> DataFrame:
    """(doc_id, start, stop, value, score): each candidate of whole texts with the forest's probability of a secret.

    Offsets are code points of the whole match; ``value`` is the secret alone. Null and empty texts have no candidates;
    a row that occurs twice is scanned twice; other columns give way. Nothing is shuffled.
    """
    kept = docs.select("doc_id", F.col(text).alias("text")).where(f"text rlike {quoted(CANDIDATE)}")
    found = kept.select("doc_id", F.explode(spans("text", CANDIDATE)).alias("x")).select("doc_id", "x.*")
    scored = model.transform(with_features(found))
    return scored.select("doc_id", "start", "stop", secret_part().alias("value"), vector_to_array("probability")[1].alias("score"))


def forest_score(spark: SparkSession, model: RandomForestClassificationModel) -> Callable[[Column], Column]:
    """The forest as an expression over an array of features: the mean over trees of the share of secrets in the leaf that
    is reached. The nodes, at most 2^(DEPTH + 1) a tree, are read from the saved model and stand in the plan as one array,
    so that candidates can be scored where they are, inside a row."""
    path = table_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    rows = sorted(saved.select("treeID", "id", "leftChild", "rightChild", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", 0).alias("t"), "impurityStats").collect(), key=lambda r: (r["treeID"], r["id"]))
    dropped(saved)
    at = {(r["treeID"], r["id"]): k for k, r in enumerate(rows)}
    node = lambda r: {"f": max(r["featureIndex"], 0), "t": r["t"] or 0.0, "l": at.get((r["treeID"], r["leftChild"]), -1), "r": at.get((r["treeID"], r["rightChild"]), -1), "p": r["impurityStats"][1] / sum(r["impurityStats"])}
    nodes = F.from_json(F.lit(json.dumps([node(r) for r in rows])), "array<struct<f:int,t:double,l:int,r:int,p:double>>")
    roots = [at[t, 0] for t in sorted({r["treeID"] for r in rows})]

    def leaf(x: Column, root: Column) -> Column:
        step = lambda i, _: F.transform(F.array(F.get(nodes, i)), lambda n: F.when(n["l"] < 0, i).when(F.get(x, n["f"]) <= n["t"], n["l"]).otherwise(n["r"]))[0]
        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(model.getMaxDepth())), root, step))["p"]

    return lambda x: F.aggregate(F.array(*map(F.lit, roots)), F.lit(0.0), lambda s, root: s + leaf(x, root)) / len(roots)


def redact(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with each found secret replaced by ``[SECRET]`` in ``text``; other rows and columns stay as they are.

    Each row is scanned, scored and rewritten by itself, wherever in its text a secret of it stands, longest first;
    nothing is gathered, shuffled or joined. Null and empty texts stay as they are.
    """
    score = forest_score(docs.sparkSession, model)
    own = spare(docs.columns, "_text")

    def judged(x: Column) -> Column:
        body = F.array(F.struct(secret_part(x["value"]).alias("b"), x["value"].alias("v"), x["before"].alias("p"), x["after"].alias("q")))
        parts = F.transform(body, lambda y: F.struct(y["b"].alias("b"), features(y["b"], y["v"], y["p"], y["q"]).alias("x")))
        return F.transform(parts, lambda y: F.struct(y["b"].alias("secret"), score(y["x"]).alias("score")))[0]

    found = F.filter(F.transform(spans(own, CANDIDATE), judged), lambda x: (x["score"] >= threshold) & (x["secret"] != ""))
    values = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct((-F.length(x["secret"])).alias("n"), x["secret"].alias("secret")))))
    clean = F.reduce(values, F.col(own), lambda t, v: F.replace(t, v["secret"], F.lit("[SECRET]")))
    clean = F.when(F.col(own).rlike(CANDIDATE), clean).otherwise(F.col(own))
    return docs.withColumnRenamed(text, own).select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, stop, kind, value_sha256, score, is_secret), a row for each candidate of each row's whole text (none
    for a null or empty one); a null doc_id stays null; an empty table gives an empty result. Columns but doc_id and
    text are not read; the values themselves don't leave ``scan``."""
    found = scan(documents(spark, sf_dir), fit(labelled_findings(spark)))
    kind = F.when(F.col("value").rlike("^(?:AKIA|ASIA)"), "aws_key").when(F.col("value").rlike("^gh[pousr]_"), "github_token").otherwise("generic")
    return found.select("doc_id", "start", "stop", kind.alias("kind"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("is_secret"))
