"""Secrets in text: candidates by shape, false positives removed by a random forest, in DataFrame operations only.

A candidate is a run of 16 or more key-like characters, or of any length and with any marks what is assigned to a name
that says secret, or the password of a URL. The forest sees its length, the changes
between kinds of characters, how much of it frequent words cover, whether it stands in a path, and the
words beside it. It learns from labelled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.tables import keep

SPACE = r"[\x20\x09-\x0D]+"
RUN = r"([A-Za-z0-9+/_-]{16,}={0,2})"
NEAR = r"(?i)token|secret|passw|pwd|key|auth|credential"
# a value: in quotes up to the closing one, else without the marks that end a phrase or the next of several settings
NEXT = r"[&;,][\w.-]+="
VALUE = (r"""(?:"([^"]+)|'([^']+)|`([^`]+)|((?![=:"'`])(?:(?!NEXT)[^"'`])+?)(?=[,;.)\]}>]*(?:$|["'`])|NEXT))"""
         .replace("NEXT", NEXT))
NAME = rf"(?:{NEAR[4:]})[\w.-]*[\"'`\)\]]*"
SETS = "(?::=|=>|={1,3}|:)"
OWN = f"(?i){NAME}{SETS}{VALUE}"  # name and value in one word
NAMED, SETTER = f"(?i){NAME}$", f"^{SETS}$"
NAMED_SETTER = f"(?i){NAME}{SETS}$"
LEAD = f"(?i)^{SETS}?{VALUE}"  # the value of a name in the words before
USERINFO = r"://[^\s/:@]*:((?![0-9]+/)(?:(?!://)\S)+)@"
DICTIONARY = 200  # frequent words that coverage counts
SAMPLE = 5000  # labelled findings of either label to learn from
TREES, DEPTH = 24, 6
THRESHOLD = 0.5
# tokens that say by their prefix and length whose they are; a JSON web token is seen by its parts that begin with {"
VENDOR = "^(" + "|".join([
    "(AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}", "gh[opsru]_[A-Za-z0-9]{36,}", "github_pat_[A-Za-z0-9_]{40,}",
    "glpat-[A-Za-z0-9_-]{20,}", "[sr]k_(live|test)_[A-Za-z0-9]{10,}", "whsec_[A-Za-z0-9+/]{24,}={0,2}",
    "AIza[A-Za-z0-9_-]{35}", "ya29[.][A-Za-z0-9_-]{20,}", "xox[abeoprs]-[A-Za-z0-9-]{10,}", "xapp-[A-Za-z0-9-]{20,}",
    "sk-[A-Za-z0-9_-]{20,}", "hf_[A-Za-z0-9]{30,}", "npm_[A-Za-z0-9]{36}", "pypi-[A-Za-z0-9_-]{50,}",
    "do[opr]_v1_[0-9a-f]{64}", "shp(at|ca|pa|ss)_[0-9A-Fa-f]{32}", "sq0(atp|csp)-[A-Za-z0-9_-]{22,}", "key-[0-9a-f]{32}",
    "SK[0-9a-f]{32}", "SG[.][A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{16,}", "hv[bsr][.][A-Za-z0-9_-]{20,}",
    "eyJ[A-Za-z0-9_-]{12,}={0,2}([.][A-Za-z0-9_-]*={0,2}){0,2}"]) + ")$"
LONG_HEX = "^([0-9a-f]{32,}|[0-9A-F]{32,})$"
ENTROPY, LEAST = 2.75, 8  # bits per character and characters of a value that is a secret if its name says so
PLACEHOLDER = r"(?i)^([$%]?[{(<\[].*|[$%][a-z_]+%?|[*x.#-]+|null|none|nil|true|false|undefined|(os|process)[.]env.*)$"
# what people write: numbers and marks, or words of one case or with a capital each, also several with marks between
# (possessive: loops that never give back need no stack, however long the word)
PLAIN = (r"^(?:[0-9/_+=-]+|[/_+-]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[/_+-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))*+[/_+=-]*"
         r"|(?:[A-Z]?[a-z]{3,}+)++)$")
FEATURES = ["length", "transitions", "digits", "upper", "distinct", "hex", "coverage", "path", "near", "assigned",
            "quoted", "prose", "userinfo"]


def frequent_words(docs: DataFrame, top: int = DICTIONARY, text_col: str = "text") -> list[str]:
    """The most frequent words of 2 to 5 letters, counted over all documents; at most `top` come to the driver."""
    words = docs.select(F.explode(F.split(F.col(text_col), SPACE)).alias("word")).where(
        F.col("word").rlike("^[A-Za-z]{2,5}[.,]?$"))
    counts = words.groupBy(F.lower(F.rtrim("word", F.lit(".,"))).alias("word")).count()
    return [r.word for r in counts.orderBy(F.desc("count"), "word").limit(top).collect()]


def candidates(docs: DataFrame, dictionary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, word_no, part, candidate and the features."""
    words = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.split(F.col(text_col), SPACE).alias("words"))

    def at(i):
        return F.coalesce(F.get("words", i), F.lit(""))

    def follows(second, before, word):
        """Whether the words before a word give it to a name."""
        return (before.rlike("[=:>]$") & (before.rlike(NAMED_SETTER) | (before.rlike(SETTER) & second.rlike(NAMED)))) | (
            word.rlike("^[=:].") & before.rlike(NAMED))

    def place(i):
        word = F.get("words", i)
        return ((F.length(word) >= 16) & word.rlike(RUN)) | (word.rlike("[=:]") & (
            word.rlike(OWN) | word.rlike(USERINFO))) | follows(at(i - 2), at(i - 1), word)

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), place)
    around = F.transform(places, lambda i: F.struct(
        i.alias("word_no"), F.get("words", i).alias("word"), at(i - 2).alias("second"), at(i - 1).alias("before"),
        at(i + 1).alias("after")))

    def values(pattern, groups=4):
        return F.concat(*(F.regexp_extract_all("word", F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)))

    runs = F.regexp_extract_all("word", F.lit(RUN), F.lit(1))
    given = F.when(follows(F.col("second"), F.col("before"), F.col("word")), values(LEAD)).otherwise(F.array())
    others = F.filter(F.concat(given, values(OWN), values(USERINFO, 1)), lambda v: v != "")
    rows = words.select("doc_id", F.explode(around).alias("w")).select("doc_id", "w.*").select(
        "*", runs.alias("runs"), others.alias("others")).select(
        "*", F.posexplode(F.concat("runs", F.filter("others", lambda v: ~F.array_contains("runs", v)))).alias(
            "part", "candidate"))
    c, n, head = F.col("candidate"), F.length("candidate"), F.expr("substring_index(word, candidate, 1)")
    # longer words first, so that a word isn't left half covered by a shorter one
    cover = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))

    def share(pattern):
        return F.regexp_count(c, F.lit(pattern)) / n

    def flag(condition):
        return condition.cast("double")

    features = {
        "length": n.cast("double"),
        "transitions": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(c), cover, "")) / n if cover else F.lit(0.0),
        "path": flag(F.col("word").rlike("[a-z]+://|^/|/.*/|[.][a-z]{2,4}$")),
        "near": flag(F.concat_ws(" ", "second", "before", head).rlike(NEAR)),
        "assigned": flag(F.col("before").rlike("[=:]>?$") | head.rlike("[=:]>?[\"'`]?$")),
        "quoted": flag(head.rlike("[\"'`]$")),
        "prose": (flag(F.col("before").rlike("^[a-z]+[.,]?$")) + flag(F.col("after").rlike("^[a-z]+[.,]?$"))) / 2,
        "userinfo": flag(head.rlike("://[^/:@]*:$") & F.startswith(
            F.expr("substr(word, length(substring_index(word, candidate, 1)) + length(candidate) + 1)"), F.lit("@"))),
    }
    return rows.select("doc_id", "word_no", "part", "candidate", *(v.cast("double").alias(k) for k, v in features.items()))


def entropy(text):
    """Shannon entropy of the characters of a column, in bits per character."""
    n = F.length(text)

    def bits(total, c):
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), bits)


def format_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where no table of them is given; what no format decides has no label and is left out.

    1: vendor formats; passwords of URLs; long digests in hex of either case and other values of high entropy that are
    assigned to a name that says secret. 0: numbers, plain words and placeholders, the former two unless they are
    assigned to such a name.
    """
    c = F.col("candidate")
    named = (F.col("assigned") == 1) & (F.col("near") == 1)
    empty = c.rlike(PLACEHOLDER)
    dense = (F.length(c) >= LEAST) & c.rlike("[0-9]") & c.rlike("[A-Za-z]") & ~c.rlike(PLAIN) & (entropy(c) >= ENTROPY)
    url = F.col("userinfo") == 1
    label = F.when(c.rlike(VENDOR) | (~empty & (url | (named & (c.rlike(LONG_HEX) | dense)))), 1.0).when(
        empty | (c.rlike(PLAIN) & ~named), 0.0)
    return found.select(*FEATURES, "candidate", label.alias("label")).where(F.col("label").isNotNull())


@dataclass
class Forest:
    """A learned forest; without findings of both labels every candidate gets the one score there is."""

    model: object | None
    constant: float = 0.0

    def score(self, found: DataFrame) -> DataFrame:
        if self.model is None:
            return found.withColumn("score", F.lit(self.constant))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)
        scored = self.model.transform(vectors)
        return scored.withColumn("score", vector_to_array("_probability")[1]).drop(
            "_features", "_probability", "_raw", "_prediction")


def learn_forest(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Forest:
    """A forest from at most `sample` findings of either label, those with the smallest hashes."""
    columns = [*FEATURES, "candidate", "label"]
    order = [F.xxhash64("candidate"), F.col("candidate"), *map(F.col, FEATURES)]
    parts = [labelled.select(*columns).where(F.col("label") == label).orderBy(*order).limit(sample) for label in (0, 1)]
    chosen = keep(parts[0].unionByName(parts[1]).coalesce(1), "findings")
    seen = {r.label for r in chosen.select("label").distinct().collect()}
    if len(seen) < 2:
        return Forest(None, max(seen, default=0.0))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(chosen)
    return Forest(RandomForestClassifier(
        featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_prediction", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(vectors))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate: doc_id, word_no, part, candidate, score, is_secret.

    `labelled` has the features and a label (0, 1) per finding; without it the findings of `docs` are labelled by format,
    as far as a format decides.
    Null and empty texts have no candidates; null and repeated ids are returned as they come; other columns are
    ignored; an empty table gives no rows. Scoring is one pass without a shuffle.
    """
    found = keep(candidates(docs, frequent_words(docs, text_col=text_col), id_col, text_col), "candidates")
    forest = learn_forest(format_labels(found) if labelled is None else labelled)
    return forest.score(found).select(
        "doc_id", "word_no", "part", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
