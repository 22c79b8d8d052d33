"""Secret scans: candidates by pattern, false positives removed by a random forest
over features of the candidate, its path and its neighbouring words.

Everything runs as DataFrame expressions and Spark ML inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The candidates. A private key block, a signed token of three parts, a
#: run of at least 16 characters of keys that holds a digit or begins like a known kind of
#: key, the password of an address, or a quoted value of at least 8 characters after = or :.
_RUN = "A-Za-z0-9+/_=-"
PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-)"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,30}PRIVATE KEY-----"
    rf"|(?<![{_RUN}])(?:eyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+"
    rf"|(?=[A-Za-z+/_=-]*+[0-9])[{_RUN}]{{16,}}+|{PREFIX}[{_RUN}]{{12,}}+)"
    r"""|(?<=:)(?<=://[^\s:@/"']{1,64}:)[^\s:@/"']{4,}+(?=@)"""
    r"""|(?<=[=:] ?["'])[^\s"']{8,}+(?=["'])"""
)
#: Words that secrets seldom hold, those beside secrets and beside decoys.
DICTIONARY = (
    "secret token password passwd example sample test demo dummy fake placeholder change changeme your here insert value "
    "string key api user name admin root default config setting local host server client access private public data file "
    "path http https www com org net html index image version release build debug error status message content type text "
    "date time number order item list page title state none null true false this that with from have".split()
)
NEAR_SECRET = r"token|secret|passw|pwd|api.?key|auth|bearer|credential|private|access|signing"
NEAR_DECOY = r"sha-?\d|commit|hash|checksum|digest|integrity|md5|uuid|guid|revision|card|iban|phone|isbn|order|serial|blob|etag"
PATH_DECOY = r"test|example|sample|fixture|mock|doc|lock|vendor|node_modules"
PATH_SECRET = r"\.env|\.pem|\.key|credential|secret|\.ya?ml|\.ini|\.conf|\.properties|config"
#: Characters of context on each side of a candidate.
LEFT, RIGHT = 48, 16
FEATURES = [
    "length", "entropy", "distinct", "digits", "uppers", "lowers", "symbols", "hex_only", "digits_only", "to_digit", "from_digit",
    "case_changes", "vowels", "repeats", "dictionary", "block", "assigned", "quoted", "near_secret", "near_decoy", "path_secret",
    "path_decoy", "prefixed", "signed", "in_address",
]
MASK = "<SECRET>"


def candidates(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", path: str = "source") -> DataFrame:
    """``(*keep, text_key, path, value, start, before, after)``: one row for every
    candidate of every row's whole text; ``start`` counts characters from 0."""
    held = docs.where(F.col(text).rlike(CANDIDATE)).select(
        *[F.col(c).alias(f"__{c}") for c in keep],
        F.md5(F.col(text).cast("binary")).alias("text_key"),
        F.col(path).cast("string").alias("path"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("values"),
        F.split(text, CANDIDATE, -1).alias("gaps"),
    )
    gap, following = F.get("gaps", F.col("n")), F.get("gaps", F.col("n") + 1)
    own = [f"__{c}" for c in keep]
    rows = held.select(*own, "text_key", "path", "row", "gaps", F.posexplode("values").alias("n", "value")).select(
        *own, "text_key", "path", "row", "n", "value", F.length(gap).alias("gap"),
        F.substring(gap, -LEFT, LEFT).alias("before"), F.substring(following, 1, RIGHT).alias("after"),
    )
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        *[F.col(f"__{c}").alias(c) for c in keep], "text_key", "path", "value", (upto - F.length("value")).cast("bigint").alias("start"), "before", "after"
    )


def with_features(found: DataFrame) -> DataFrame:
    """Numbers for ``value``, ``before``, ``after`` and ``path``."""
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    is_like = lambda column, pattern: F.coalesce(F.lower(column).rlike(pattern), F.lit(False)).cast("double")
    each = F.array_distinct(F.split(value, ""))
    shares = F.transform(each, lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    rest = F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    columns = {
        "length": F.log2(n),
        "entropy": entropy,
        "distinct": F.size(each) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "hex_only": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "digits_only": value.rlike("^[0-9]+$").cast("double"),
        "to_digit": share("(?<=[A-Za-z])(?=[0-9])"),
        "from_digit": share("(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowels": share("(?i)(?<=[b-df-hj-np-tv-z])[aeiou]"),
        "repeats": share(r"(.)(?=\1)"),
        "dictionary": 1 - F.length(rest) / n,
        "block": value.startswith("-----BEGIN").cast("double"),
        "assigned": F.col("before").rlike(r"""[=:]\s?["']?$""").cast("double"),
        "quoted": (F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")).cast("double"),
        "near_secret": is_like("before", NEAR_SECRET),
        "near_decoy": is_like("before", NEAR_DECOY),
        "path_secret": is_like("path", PATH_SECRET),
        "path_decoy": is_like("path", PATH_DECOY),
        "prefixed": value.rlike(f"^{PREFIX}").cast("double"),
        "signed": value.rlike(r"^eyJ[^.]*+\.[^.]++\.[^.]++$").cast("double"),
        "in_address": (F.col("before").rlike("://[^/@]*:$") & F.col("after").startswith("@")).cast("double"),
    }
    return found.withColumns({f"f_{name}": F.coalesce(column.cast("double"), F.lit(0.0)) for name, column in columns.items()})


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """``(path, value, before, after, label)``: findings made by rule, because the
    tables label none. True ones are random keys of several alphabets that are
    assigned to a credential's name, passwords of addresses and signed tokens; false ones
    are card numbers, digests and ids beside words that name them, placeholders, also in
    addresses and behind the prefixes of keys, names, long words and versions."""
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda salt, *options: F.get(F.array(*[F.lit(o) for o in options]), draw(salt, len(options)).cast("int"))
    digest = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")).cast("binary"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    safe = F.translate(coded, "+/", "-_")
    letters = F.translate(coded, "0123456789+/", "qzXkVwJyGbRt")
    digits = F.concat(*[F.lpad(draw(f"d{i}", 10**8).cast("string"), 8, "0") for i in range(3)])
    word = F.concat(*[pick(f"w{i}", "tion", "er", "ing", "the", "ver", "ment", "ado", "heit", "ou", "re", "an", "ble") for i in range(7)])
    size = lambda salt, low, high: (draw(salt, high - low + 1) + low).cast("int")
    cut = lambda c, salt, low, high: F.substring(c, F.lit(1), size(salt, low, high))
    named = F.concat(pick("v", "your", "example", "test", "my", "insert"), pick("s", "_", "-"), pick("u", "api_key", "token", "secret", "password"), pick("t", "_here", "_value", "123456", "-placeholder-1", "_0000000000"))
    secret = F.array(
        cut(digest, "a", 20, 64), F.upper(cut(digest, "a", 20, 64)), cut(coded, "b", 16, 43), F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)),
        F.concat(F.lit("AKIA"), F.upper(F.regexp_replace(F.substring(coded, 1, 16), "[^A-Za-z0-9]", "Q"))),
        F.concat(F.lit("ghp_"), F.regexp_replace(F.substring(coded, 1, 36), "[^A-Za-z0-9]", "x")), F.concat(F.lit("sk-"), cut(coded, "c", 24, 40)),
        F.concat(pick("aws", "AKIA", "ASIA"), F.substring(F.upper(letters), 1, 16)), F.concat(pick("xo", "xoxb-", "xoxp-", "ghp_", "sk-"), cut(letters, "l", 20, 40)),
        F.concat(F.lit("eyJ"), cut(safe, "j", 14, 30), F.lit("."), F.lit("eyJ"), cut(letters, "i", 12, 38), F.lit("."), cut(safe, "h", 20, 43)), cut(safe, "r", 8, 24),
    )
    decoy = F.array(
        F.substring(digits, 1, 16), cut(digits, "e", 16, 24), cut(digest, "f", 32, 64), F.substring(digest, 1, 40), F.concat(word, draw("g", 100).cast("string")),
        named, F.concat(pick("p", "release", "version", "build", "image"), F.lit("-2024-"), F.substring(digits, 1, 8)), F.repeat(F.lit("x0"), 12),
        F.concat(pick("ws", "AKIA", "ASIA"), pick("we", "EXAMPLEEXAMPLEKEY", "YOURACCESSKEYHERE", "XXXXXXXXXXXXXXXX")), F.concat(F.lit("sk-"), word, F.lit("-"), pick("sl", "tutorial", "guide", "model", "notes")),
        F.concat(pick("yo", "xoxb-", "ghp_"), pick("ym", "your-", "example-", "insert-"), pick("yt", "token-here", "api-token", "secret-value")),
        pick("ph", "password", "changeme", "secret", "user", "example", "your_password", "xxxxxx", "placeholder"),
    )
    good = (F.col("id") % 2 == 0)
    kind = draw("kind", 12).cast("int")
    credential = F.concat(pick("k", "token", "TOKEN", "api_key", "apiKey", "secret", "password", "auth_token", "access_key"), pick("o", " = ", "=", ": ", " := "))
    prose = F.concat(word, F.lit(" "), pick("x", "of", "the", "and", "de", "der"), F.lit(" "))
    by_digest = F.concat(pick("y", "commit", "sha256", "md5", "checksum", "digest", "revision", "etag"), pick("z", " ", ": ", "="))
    by_card = F.concat(pick("h", "card ", "order ", "phone ", "", "", ""))
    quote = F.when(draw("q", 4) < 3, F.lit('"')).otherwise(F.lit(""))
    address = F.concat(pick("db", "postgres", "mysql", "amqp", "https", "redis"), F.lit("://"), pick("dbu", "admin", "root", "service", "app"), F.lit(":"))
    bearer, named_kind = pick("br", "Authorization: Bearer ", "bearer "), (kind == 5) | (kind == 10)
    before = F.when(kind == 11, F.concat(prose, address)).when(good & (kind == 10) & (draw("bq", 2) == 0), F.concat(prose, bearer)).when(
        good, F.concat(prose, credential, quote)
    ).otherwise(F.concat(prose, F.when(kind < 2, by_card).when(kind < 4, by_digest).when(named_kind, F.concat(credential, quote)).otherwise(F.lit(""))))
    after = F.when(kind == 11, F.lit("@db.host/main")).when(good | named_kind, F.concat(quote, F.lit(" "))).otherwise(F.lit(" "))
    path = pick("path", "src1", "src2", "app/main.py", "deploy/.env", "tests/test_api.py", "docs/readme.md", "web/config.yml", "")
    return spark.range(0, rows, 1, 1).select(
        path.alias("path"), F.when(good, F.get(secret, kind)).otherwise(F.get(decoy, kind)).alias("value"), before.alias("before"), after.alias("after"),
        good.cast("double").alias("label"),
    )


def _vectors(found: DataFrame) -> DataFrame:
    names = [f"f_{f}" for f in FEATURES]
    return VectorAssembler(inputCols=names, outputCol="__features").transform(with_features(found)).drop(*names)


#: A forest, or the one chance of every candidate where there was nothing to tell apart.
Model = RandomForestClassificationModel | float


def fit(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 42) -> Model:
    """A forest from ``(path, value, before, after, label)``. Private key blocks
    need no forest and are left out; a null label teaches nothing. Findings of one label
    only give every candidate that label's chance, no findings one half."""
    findings = findings.where(F.col("label").isNotNull() & ~F.coalesce(F.col("value"), F.lit("")).startswith("-----BEGIN"))
    known = sorted(r["label"] for r in findings.select(F.col("label").cast("double").alias("label")).distinct().collect())
    if len(known) < 2:
        return known[0] if known else 0.5
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", probabilityCol="__chance", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(_vectors(findings))


def scan(
    docs: DataFrame,
    model: Model,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    path: str = "source",
    threshold: float = 0.5,
) -> DataFrame:
    """``(*keep, text_key, path, value, start, before, after, score, is_secret)`` of
    every candidate. Null and empty texts have none; a null path is like an empty
    one; repeated rows are listed as often as they are given; an empty table gives
    none; further columns are not read."""
    found = candidates(docs, keep, text, path)
    if isinstance(model, float):
        judged = F.lit(model)
    else:
        found, judged = model.transform(_vectors(found)), vector_to_array("__chance")[1]
    chance = F.when(F.col("value").startswith("-----BEGIN"), F.lit(1.0)).otherwise(judged)
    scored = found.withColumn("score", chance).withColumn("is_secret", F.col("score") >= threshold)
    return scored.select(*keep, "text_key", "path", "value", "start", "before", "after", "score", "is_secret")


def _masked(text: Column, spans: Column) -> Column:
    """The text with each of the sorted, disjoint spans ``struct<start, size>`` replaced."""

    def end(i: Column) -> Column:
        return F.when(i < 0, F.lit(0)).otherwise(F.get(spans, i)["start"] + F.get(spans, i)["size"]).cast("int")

    def piece(span: Column, i: Column) -> Column:
        return F.concat(F.substring(text, end(i - 1) + 1, span["start"].cast("int") - end(i - 1)), F.lit(MASK))

    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, end(F.size(spans) - 1) + 1, F.length(text)))


def mask(docs: DataFrame, model: Model, text: str = "text", path: str = "source") -> DataFrame:
    """All rows with all their columns, every secret in the text replaced where it
    stands: candidates with a value that is a secret at one place of the text are replaced
    at all places, parts of longer runs that only begin like it are not. Texts without a
    candidate, nearly all, are passed on as they are; the others are joined with the
    secrets of equal texts at equal paths."""
    has_candidate = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    span = F.struct("start", F.length("value").alias("size"))
    secrets = (
        scan(docs, model, (), text, path)
        .groupBy(F.col("text_key").alias("__key"), F.coalesce("path", F.lit("")).alias("__path"), "value")
        .agg(F.max("is_secret").alias("judged"), F.collect_set(span).alias("spans")).where("judged")
        .groupBy("__key", "__path").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("__spans"))
    )
    rows = docs.where(has_candidate).withColumns(
        {"__key": F.md5(F.col(text).cast("binary")), "__path": F.coalesce(F.col(path).cast("string"), F.lit(""))}
    )
    cleaned = rows.join(secrets, ["__key", "__path"], "left").withColumn(
        text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(_masked(F.col(text), F.col("__spans")))
    )
    same = [F.col(f"`{c}`") for c in docs.columns]
    return docs.where(~has_candidate).unionByName(cleaned.select(*same))
