"""Secret scans: candidates by pattern, false positives removed by a random forest, in column expressions only.

A candidate is a long token with a digit in it.  What tells secrets from serial numbers, identifiers and long words
is learned: length, changes of character class, shares of classes, distinct characters, how much of its letters
dictionary words cover, the path, and the neighbouring words.  The forest is fitted by Spark's library on a bounded
sample of labelled findings (``PER_LABEL`` of each label, chosen by hash) and written out as one column expression,
so a text is scored and redacted in a single pass without a shuffle.

The dictionary is the ``DICTIONARY`` most frequent words of all texts, so it has a fixed size.

No table here says which findings are secrets, so unless the caller has labelled findings, they get their label from a
published rule (``rule_label``), and ``EXAMPLES`` made-up findings of each form are added.

Defined results: null and empty texts have no findings; several findings of a text are numbered from left to right;
repeated rows are scanned one by one; without both labels in the sample every candidate gets the share of label 1
there (0 if the sample is empty); a null path counts as an ordinary one; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeframe.llm.exact import first_rows
from tapeframe.runtime import stage

CANDIDATE = r"(?<![A-Za-z0-9_+/\-])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9_+/\-])|(?=[A-Za-z_+/\-]{0,63}[0-9])[A-Za-z0-9_+/\-]{12,})"
CONTEXT = 60
DICTIONARY = 5_000
EXAMPLES = 60
PER_LABEL = 10_000
TREES, DEPTH, SEED = 20, 5, 7
KEYWORD = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
PLACEHOLDER = r"(?i)(example|dummy|sample|test|fake|changeme|placeholder)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|docs?)"
# Fixed value: the published form of one provider's key ids.
PROVIDER = r"^AKIA[A-Z0-9]{16}$"
FEATURES = ["length", "changes", "digits", "upper", "lower", "distinct", "dictionary", "test_path", "keyword_before", "assigned", "quoted",
            "placeholder_near", "hex_only", "digits_only"]


def candidates(text: Column) -> Column:
    """Array of (value, before, after), from left to right."""
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    around = F.split(text, CANDIDATE)
    return F.zip_with(values, F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))), lambda value, i: F.when(value.isNotNull(), F.struct(
        value.alias("value"), F.right(F.element_at(around, i), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(around, i + 1), F.lit(CONTEXT)).alias("after"))))


def found_in(text: Column) -> Column:
    """As ``candidates``, and an empty array without cutting anything where there is none."""
    kind = "array<struct<value:string,before:string,after:string>>"
    return F.when(text.rlike(CANDIDATE), F.filter(candidates(text), lambda c: c.isNotNull())).otherwise(F.array().cast(kind))


def frequent_words(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of 4 to 12 letters over all texts, ties by the word."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(4, 12))
    counts = stage(words.groupBy("word").count(), "words")
    # How often each count occurs says from which count on there are enough words; only those are put in order.
    falling = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.groupBy("count").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(falling), F.lit(0)))
    least = levels.where(F.col("above") < size).agg(F.min("count")).first()[0]
    order = [F.desc("count"), F.col("word")]
    return [r.word for r in first_rows(counts.where(F.col("count") >= F.lit(least)), order, size, "frequent_words")]


def features(value: Column, before: Column, after: Column, path: Column, dictionary: list[str]) -> list[Column]:
    length = F.length(value).cast("double")
    classes = value
    for pattern, letter in (("[a-z]", "l"), ("[A-Z]", "u"), ("[0-9]", "d"), ("[^lud]", "s")):
        classes = F.regexp_replace(classes, pattern, letter)
    runs = F.length(F.regexp_replace(classes, r"(.)(?=\1)", ""))
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / length
    stretches = F.regexp_extract_all(F.lower(value), F.lit("[a-z]{4,}"), F.lit(0))
    known = F.filter(stretches, lambda w: w.isin(dictionary) if dictionary else F.lit(False))
    number = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    made = {
        "length": length, "changes": (runs - 1) / length, "digits": share("[^0-9]"), "upper": share("[^A-Z]"), "lower": share("[^a-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
        "dictionary": F.length(F.array_join(known, "")) / length,
        "test_path": number(path.rlike(TEST_PATH)), "keyword_before": number(before.rlike(KEYWORD + r"\W{0,6}$")),
        "assigned": number(before.rlike(r"[=:]\s*[\"']?$")), "quoted": number(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "placeholder_near": number(F.concat(before, value, after).rlike(PLACEHOLDER)), "hex_only": number(value.rlike("^[0-9a-f]+$")),
        "digits_only": number(value.rlike("^[0-9]+$")),
    }
    return [made[name].cast("double").alias(name) for name in FEATURES]


def findings(docs: DataFrame, dictionary: list[str], key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, number, value, before, after and the features; one row for each candidate."""
    place = F.col(path) if path else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), place.alias("path"), F.posexplode(found_in(F.col(text))).alias("number", "found"))
    return rows.select("key", "number", "found.*", *features(F.col("found.value"), F.col("found.before"), F.col("found.after"), F.col("path"), dictionary)
                       ).withColumnRenamed("key", key)


def rule_label(value: Column, before: Column, after: Column) -> Column:
    """Label of a finding where no reviewer gave one: a provider's published form, or a value assigned to a keyword."""
    named = before.rlike(KEYWORD + r"[A-Za-z0-9_\-]{0,20}[\"']?\s{0,2}[=:]\s{0,2}[\"']?$")
    return ((value.rlike(PROVIDER) | named) & ~F.concat(before, after).rlike(PLACEHOLDER)).cast("int")


class Forest:
    """Trees as nested (feature, threshold, left, right); leaves hold the share of label 1 among their training rows."""

    def __init__(self, trees: list):
        self.trees = trees

    def column(self, field) -> Column:
        """Mean of the trees; ``field`` gives the column of a feature."""
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + self.branch(tree, field)
        return total / float(len(self.trees))

    def branch(self, node, field) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(field(name) <= threshold, self.branch(left, field)).otherwise(self.branch(right, field))


def unpacked(node):
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return float(stats[1] / sum(stats))
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), unpacked(node.leftChild()), unpacked(node.rightChild())


def fit(labelled: DataFrame, label: str = "label", per_label: int = PER_LABEL, seed: int = SEED) -> Forest:
    """Forest over at most 2 * per_label labelled findings."""
    order = (F.xxhash64("value", "before"), F.col("value"), F.col("before"))
    rows = labelled.select("value", "before", *FEATURES, F.col(label).cast("double").alias("label"))
    part = [rows.where(F.col("label") == y).orderBy(*order).limit(per_label) for y in (0, 1)]
    sample = stage(part[0].union(part[1]), "findings")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Forest([float(1.0 in sizes)])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
    # The sample is bounded; one partition in a fixed order makes the fit repeatable.
    model = forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.coalesce(1).sortWithinPartitions(*order)))
    return Forest([unpacked(tree._java_obj.rootNode()) for tree in model.trees])


def label_findings(found: DataFrame) -> DataFrame:
    return found.withColumn("label", rule_label(F.col("value"), F.col("before"), F.col("after")))


def example_findings(spark: SparkSession, dictionary: list[str], each: int = EXAMPLES) -> DataFrame:
    """A few made-up findings of known label, so that a form which a small corpus lacks is still learned."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.translate(digest, "0123456789abcdef", "AKZ2QW5XMN7RTYPL")
    forms = F.array(F.concat(F.lit("see AKIA"), F.substring(mixed, 1, 16), F.lit(" here")),
                    F.concat(F.lit("with password="), F.substring(digest, 1, 18), F.lit(" and")),
                    F.concat(F.lit("set token = \""), F.substring(digest, 1, 40), F.lit("\" in")),
                    F.concat(F.lit("call "), F.lpad(F.abs(F.xxhash64("id")).cast("string"), 16, "4"), F.lit(" now")),
                    F.concat(F.lit("the commit "), F.substring(digest, 1, 40), F.lit(" of")),
                    F.concat(F.lit("page_section_"), (F.col("id") % 90).cast("string"), F.lit(" of")))
    texts = spark.range(each).select(F.col("id").alias("doc_id"), F.explode(forms).alias("text"))
    return label_findings(findings(texts, dictionary))


class Scanner:
    """Dictionary and forest of a corpus, ready to score and redact texts."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, labelled: DataFrame | None = None,
                 threshold: float = 0.5):
        self.key, self.text, self.path, self.threshold = key, text, path, threshold
        self.dictionary = frequent_words(docs, text)
        self.found = stage(findings(docs, self.dictionary, key, text, path), "candidates")
        if labelled is None:
            columns = ["value", "before", *FEATURES, "label"]
            labelled = label_findings(self.found).select(columns).union(example_findings(docs.sparkSession, self.dictionary).select(columns))
        self.forest = fit(labelled)

    def report(self) -> DataFrame:
        """key, number, value, score, is_secret: every candidate of every text."""
        scored = self.found.withColumn("score", self.forest.column(F.col))
        return scored.select(self.key, "number", "value", "score", (F.col("score") >= self.threshold).alias("is_secret"))

    def redact(self, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
        """docs with every value that the forest takes for a secret replaced in the text; all columns and rows stay."""
        text, path = F.col(self.text), F.col(self.path) if self.path else F.lit(None).cast("string")
        described = F.transform(found_in(text), lambda c: F.struct(
            c["value"].alias("value"), *features(c["value"], c["before"], c["after"], path, self.dictionary)))
        kept = F.transform(described, lambda f: F.when(self.forest.column(lambda name: f[name]) >= self.threshold, F.lit(mark)).otherwise(f["value"]))
        pieces = F.split(text, CANDIDATE)
        whole = F.array_join(F.zip_with(pieces, kept, lambda piece, value: F.concat(piece, F.coalesce(value, F.lit("")))), "")
        return docs.withColumn(self.text, F.when(text.rlike(CANDIDATE), whole).otherwise(text))
