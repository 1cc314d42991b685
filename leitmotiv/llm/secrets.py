"""Secret scan: a random forest decides which candidates are findings and which are false positives.

Candidates are runs of at least 16 characters of [A-Za-z0-9+/_=-] with a digit in them. What the forest sees of each: its length, how often
neighbouring characters change class, shares of character classes, common letter pairs, how much of it dictionary words
cover, what the words before it and the characters around it say, and whether the path looks like tests or documentation.
It is trained on labelled findings: the caller's, or else the ones labelled_findings() makes, some thousands of rows whatever
the corpus.

Extraction, features and scoring are SQL functions and the JVM's own forest: no Python runs on the executors. Nothing is shuffled
but the training rows.

Defined results: null and empty texts have no candidates. Each place of a candidate is a row, also where a text or a row is repeated. A
null path says nothing. Texts of any length are read whole, and so are candidates; of what stands around one, CONTEXT characters on either side. Shorter secrets and
those without a digit are no candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}"
#: How many characters on either side of a candidate the features look at.
CONTEXT = 48
RUN = 64

#: Words that speak against a secret where they make up a candidate.
DICTIONARY = (
    "example", "sample", "test", "dummy", "fake", "foo", "bar", "placeholder", "changeme", "default", "your", "here", "version", "release",
    "build", "index", "image", "file", "page", "user", "name", "data", "table", "value", "class", "function", "object", "string", "number",
    "http", "https", "www", "html", "json", "api", "the", "and", "for", "with", "from", "this", "that", "abcdef", "1234567890", "123456",
)
KEYWORDS = r"(?i)(token|secret|passw(or)?d|passwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|auth)[\w-]*[\"']?\s*(=>|:=|=|:|\s)\s*[\"']?$"
PAIRS = r"(?i)(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng)"
PATHS = r"(?i)(test|example|sample|fixture|mock|doc|readme)"

FEATURES = ["length", "changes", "digits", "lowers", "uppers", "hexes", "distinct", "pairs", "covered", "keyword", "assigned", "quoted", "testpath"]


def _candidates(df: DataFrame, keep: list[Column], text: Column, path: Column) -> DataFrame:
    """keep, start (from 0, in characters), candidate, before, after, path: a row for each place."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    rows = df.select(*keep, path.cast("string").alias("__path"), found.alias("__found"), text.alias("__text")).where(F.size("__found") > 0)
    # What lies between the candidates: part k stands before candidate k.
    parts = F.split("__text", CANDIDATE, -1)
    rows = rows.withColumn("__parts", parts)
    steps = F.zip_with("__found", F.slice("__parts", 1, F.size("__found")), lambda f, p: F.length(p) + F.length(f))
    rows = rows.withColumn("__steps", steps)
    # Where each candidate ends: sums of runs of RUN steps, the sums before each run, and those within a run. Linear but for one list of the runs.
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    run_sums = F.transform(F.sequence(F.lit(0), F.floor((F.size("__steps") - 1) / RUN).cast("int")), lambda c: total(F.slice("__steps", c * RUN + 1, RUN)))
    before = F.aggregate(run_sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumn("__before", before)

    def place(f: Column, k: Column) -> Column:
        run = F.floor(k / RUN).cast("int")
        end = F.get("__before", run) + total(F.slice("__steps", run * RUN + 1, k - run * RUN + 1))
        return F.struct(
            (end - F.length(f)).alias("start"), f.alias("candidate"),
            F.right(F.get("__parts", k), F.lit(CONTEXT)).alias("before"), F.left(F.get("__parts", k + 1), F.lit(CONTEXT)).alias("after"),
        )

    placed = F.transform("__found", place)
    names = [c for c in rows.columns if not c.startswith("__")]
    rows = rows.select(*names, "__path", F.explode(placed).alias("__c"))
    return rows.select(*names, "__path", F.col("__c.start").cast("long").alias("start"), F.col("__c.candidate").alias("candidate"), F.col("__c.before").alias("before"), F.col("__c.after").alias("after"))


def features(df: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of candidate, before, after, __path."""
    c = F.col("candidate")
    n = F.length(c)
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    change = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return df.withColumns({
        "length": n.cast("double"),
        "changes": F.regexp_count(c, F.lit(change)) / n,
        "digits": share("[0-9]"), "lowers": share("[a-z]"), "uppers": share("[A-Z]"), "hexes": share("[0-9a-fA-F]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(128)),
        "pairs": F.regexp_count(c, F.lit(PAIRS)) / n,
        "covered": 1 - F.length(F.regexp_replace(c, words, "")) / n,
        "keyword": flag(F.regexp_like(F.col("before"), F.lit(KEYWORDS))),
        "assigned": flag(F.regexp_like(F.col("before"), F.lit(r"(=|:)\s*[\"']?$"))),
        "quoted": flag(F.regexp_like(F.col("before"), F.lit(r"[\"']$")) & F.regexp_like(F.col("after"), F.lit(r"^[\"']"))),
        "testpath": flag(F.regexp_like(F.col("__path"), F.lit(PATHS))),
    })


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """text, path, label: reviewed-style findings made by rules from md5 digits, half of them secrets (label 1).

    Secrets: random hexadecimal, base64 and prefixed keys, most beside a keyword, some bare but mixed-case. Others: account and card
    numbers, ids in paths, hashes named as checksums, placeholders, words with numbers, versions.
    """
    h = lambda k: F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{k}")))
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(values))).cast("int") + 1)
    b64 = lambda k, n: F.regexp_replace(F.substring(F.base64(F.unhex(F.concat(h(k), h(k + 1)))), 1, n), "=", "A")
    digits = F.substring(F.regexp_replace(F.concat(h(20), h(21), h(22)), "[a-f]", ""), 1, 16)
    key = pick("key", ["token", "secret", "password", "api_key", "access_key", "auth_token"])
    good = [
        F.concat(key, F.lit(' = "'), F.substring(F.concat(h(1), h(2)), 1, 40), F.lit('"')),
        F.concat(key, F.lit(": "), h(3)),
        F.concat(key, F.lit("='"), b64(4, 36), F.lit("'")),
        F.concat(F.lit("use sk_live_"), b64(6, 24), F.lit(" now")),
        F.concat(F.lit("AKIA"), F.upper(F.substring(h(8), 1, 16)), F.lit(" is set")),
        F.concat(F.lit("bearer "), b64(9, 40)),
    ]
    word = pick("word", ["data", "image", "table", "release", "build", "function", "user"])
    bad = [
        F.concat(F.lit("of the "), digits, F.lit(" and")),
        F.concat(F.lit("card "), digits, F.lit(", ok")),
        F.concat(F.lit("checksum md5 "), h(11), F.lit(" of file")),
        F.concat(key, F.lit(' = "your-example-token-'), F.substring(digits, 1, 3), F.lit('"')),
        F.concat(F.lit("see /"), word, F.lit("/index/"), word, F.lit("-page-"), F.substring(digits, 1, 4)),
        F.concat(word, F.lit("_version_"), word, F.lit("_"), F.substring(digits, 1, 2)),
        F.concat(F.lit("id "), F.substring(h(12), 1, 8), F.lit("-"), F.substring(h(12), 9, 4), F.lit("-"), F.substring(h(12), 13, 4), F.lit("-"), F.substring(h(12), 17, 12)),
        F.concat(F.lit("called at "), digits, F.lit(" was a")),
    ]
    label = (F.col("id") % 2).cast("double")
    kind = F.pmod(F.xxhash64("id"), F.when(label == 1, F.lit(len(good))).otherwise(F.lit(len(bad)))).cast("int") + 1
    around = pick("around", ["the thing ", "note: ", "", "and of ", "for the ", "x = 1; "])
    text = F.concat(around, F.when(label == 1, F.element_at(F.array(*good), kind)).otherwise(F.element_at(F.array(*bad), kind)), F.lit(" "), pick("end", ["", "the end", "of that", "\n"]))
    path = pick("path", ["src/main", "src7", "lib/core", "src0", "app"])
    return spark.range(rows).select(text.alias("text"), path.alias("path"), label.alias("label"))


def train(findings: DataFrame, trees: int = 20, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """findings: text, path, label (1 secret, 0 not); each candidate in the text has the row's label."""
    rows = features(_candidates(findings, [F.col("label").cast("double").alias("label")], F.col("text"), F.col("path")))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.where("label is not null")).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan_secrets(
    docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source"
) -> DataFrame:
    """id_col, start, length, finding_sha256, score, secret: a row for each candidate. The candidate itself isn't returned."""
    model = model or train(labelled_findings(docs.sparkSession))
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    rows = features(_candidates(docs, [F.col(id_col).alias("id")], F.col(text_col), path)).withColumn("finding_sha256", F.sha2("candidate", 256))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    from pyspark.ml.functions import vector_to_array

    score = F.round(vector_to_array("probability")[1], 9)
    return scored.select(F.col("id").alias(id_col), "start", F.length("candidate").cast("long").alias("length"), "finding_sha256", score.alias("score"), (score >= threshold).alias("secret"))
