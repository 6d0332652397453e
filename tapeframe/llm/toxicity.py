"""Toxicity scores of texts after undoing simple disguises.

Noisy channel: a writer disguises a word by digits and signs for letters, by repeated letters, and by spaces or
points between letters.  For each suspicious token a lattice holds what every observed character can stand for, and
Viterbi decoding picks the reading that a character trigram model of the corpus and the costs of the channel make
likeliest.  Tokens of plain letters have one reading and pass as they are.  The restored words are scored.

* The character model is counted over all texts (``character_counts``); its size is bounded by the alphabet.
* The word weights are fitted on labelled rows (``fit``): a bounded sample, at most ``PER_CLASS`` rows of each label,
  chosen by a hash of the key.  Features are words and their first 4 to 6 letters; those with a clear excess among
  label 1 are kept.  A logistic curve over the strongest weight and the number of hits gives the score.

Defined results: null and empty texts get the score of a text without hits; labels that are null or belong to no
text are ignored; without both labels in the sample every score is the share of label 1 there (0 if none); repeated
rows are scored one by one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.runtime import stage

PER_CLASS = 10_000
MAX_FEATURES = 50_000
PREFIXES = (4, 5, 6)
CACHED_TOKENS = 200_000
CACHED_LENGTH = 40
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = len(LETTERS) + 2  # 0 is a boundary, the last code any other letter
CODE_OF = {c: i + 1 for i, c in enumerate(LETTERS)}
# What a sign may stand for inside a word.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "×": "x"}
SEPARATORS = set(".-_*~'`,:;/\\ ")
LEET_COST, SPLIT_COST, SIGN_SPLIT_COST, DROP_COST, SQUEEZE_COST = 1.0, 3.0, 9.0, 0.7, 0.5
EDGE = ".,;:!?\"'()[]{}<>*#%&$~`|/\\-_=+«»“”„’…"
PLAIN = re.compile(r"[^\W\d_]+")
RUN_OF_THREE = re.compile(r"([^\W\d_])\1\1")


def code_table() -> np.ndarray:
    """Code of every code point below 0x3000; letters outside the alphabet share one code."""
    return np.array([CODE_OF.get(chr(i), SIZE - 1 if chr(i).isalpha() else 0) for i in range(0x3000)], dtype=np.int32)


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram (three codes as one number), n: character trigrams over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = code_table(), np.zeros(SIZE**3, dtype=np.int64)

        def add(parts: list[str]) -> None:
            points = np.frombuffer(" ".join(parts).lower().encode("utf-32-le", "replace"), dtype=np.uint32)
            c = codes[np.minimum(points, len(codes) - 1)]
            if len(c) > 2:
                total[:] += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)

        for batch in batches:
            held, length = [], 0
            for value in batch.column(0):
                held.append(value.as_py() or "")
                length += len(held[-1])
                if length > 1 << 18:
                    add(held)
                    held, length = [], 0
            add(held)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], names=["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Interpolated log-probabilities of a character after two others."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        three = np.zeros(SIZE**3)
        three[grams] = counts
        three = three.reshape(SIZE, SIZE, SIZE)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text") -> CharacterModel:
        """At most SIZE ** 3 rows come back, whatever the corpus."""
        rows = character_counts(docs, text).collect()
        return cls(np.array([r.gram for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.float64))


def readings(char: str, length: int) -> list[tuple[str, float]]:
    """What a run of one observed character can stand for, with the cost of the disguise; a space ends a word."""
    if char in SEPARATORS:
        return [("", DROP_COST), (" ", SPLIT_COST)]
    out = []
    if char.isalpha():
        if length == 1:
            return [(char, 0.0)]
        out = [(char * 2, 0.0 if length == 2 else SQUEEZE_COST), (char, SPLIT_COST if length == 2 else SQUEEZE_COST)]
    for letter in STANDS_FOR.get(char, ""):
        out += [(letter, LEET_COST)] + ([(letter * 2, 2 * LEET_COST)] if length > 1 else [])
    return out + ([] if char.isalpha() else [(" ", SIGN_SPLIT_COST)])


def restore(token: str, model: CharacterModel) -> str:
    """Viterbi decoding of the token's lattice; states are the last two characters written."""
    states: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(0, 0): (0.0, None, "")}

    def step(states, options):
        after: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
        for (first, second), entry in states.items():
            for written, cost in options:
                a, b, total = first, second, entry[0] - cost
                for c in written:
                    code = CODE_OF.get(c, SIZE - 1) if c != " " else 0
                    if code or b:
                        total += model.log[a, b, code]
                        a, b = b, code
                if (a, b) not in after or after[a, b][0] < total:
                    after[a, b] = (total, entry, written)
        return after

    for run in re.finditer(r"(.)\1*", token, re.DOTALL):
        states = step(states, readings(run[1], len(run[0])))
    entry = max(step(states, [(" ", 0.0)]).values(), key=lambda e: e[0])
    parts = []
    while entry[1] is not None:
        parts.append(entry[2])
        entry = entry[1]
    return "".join(reversed(parts)).strip()


def token_words(token: str, model: CharacterModel) -> list[str]:
    """Words of one lower-case token: as they stand if it is of plain letters, else as decoded.

    Letters parted by points, hyphens or the like are read both apart and together; a single ``$`` or ``@`` before a
    letter is a letter.
    """
    bare = token.strip(EDGE)
    if not bare:
        return []
    at = token.index(bare)
    sign = token[at - 1] if at and token[at - 1] in "$@" and (at == 1 or token[at - 2] != token[at - 1]) and bare[0].isalpha() else ""
    if not sign and not RUN_OF_THREE.search(bare):
        if PLAIN.fullmatch(bare):
            return [bare]
        parts = PLAIN.findall(bare)
        if all(c.isalpha() or c in SEPARATORS for c in bare) and max(map(len, parts), default=0) > 2:
            return [*parts, "".join(parts)]
    if not any(c.isalpha() or c in STANDS_FOR for c in bare):
        return []
    return restore(sign + bare, model).split()


def spaced_words(tokens: list[str]) -> list[str]:
    """Runs of four or more single characters, joined by spaces for decoding."""
    out, run = [], []
    for token in (*tokens, ".."):
        if len(token) == 1:
            run.append(token)
        else:
            if len(run) >= 4:
                out.append(" ".join(run))
            run = []
    return out


class Reader(dict):
    """Bounded memo from token to what ``of_words`` says of its restored words."""

    def __init__(self, model: CharacterModel, of_words):
        super().__init__()
        self.model, self.of_words = model, of_words

    def __missing__(self, token: str):
        value = self.of_words(token_words(token, self.model))
        if len(token) <= CACHED_LENGTH:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = value
        return value

    def read(self, text: str) -> list:
        tokens = text.lower().split()
        values = list(map(self.__getitem__, tokens))
        if sum(map((1).__eq__, map(len, tokens))) >= 4:
            values += [self.of_words(restore(run, self.model).split()) for run in spaced_words(tokens)]
        return values


def word_features(words: list[str]) -> list[str]:
    """The words, and their beginnings marked by a star."""
    return [f for w in words for f in (w, *(w[:n] + "*" for n in PREFIXES if len(w) >= n))]


def labelled_sample(labels: DataFrame, key: str, label: str, per_class: int, allowed: Column) -> DataFrame:
    """At most ``per_class`` rows of each label, by a hash of the key."""
    rows = labels.where(allowed & F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    order = (F.xxhash64("__key"), F.col("__key"))
    return rows.where("__label = 1").orderBy(*order).limit(per_class).union(rows.where("__label = 0").orderBy(*order).limit(per_class))


class Scorer:
    """Weights of features and the curve over (strongest weight, log of 1 + hits)."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float]):
        self.weights, self.curve = weights, curve

    def of_words(self, words: list[str]) -> float:
        return max((self.weights.get(f, 0.0) for f in word_features(words)), default=0.0)

    def inputs(self, values: list[float]) -> tuple[float, float]:
        hits = [v for v in values if v]
        return max(hits, default=0.0), math.log1p(len(hits))

    def score(self, values: list[float]) -> float:
        strongest, hits = self.inputs(values)
        z = self.curve[0] + self.curve[1] * strongest + self.curve[2] * hits
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def feature_counts(sample: DataFrame, model: CharacterModel) -> DataFrame:
    """feature, label, n: sampled texts of a label that hold the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, word_features)
        for batch in batches:
            counts: Counter = Counter()
            for text, label in zip(batch.column(0), batch.column(1)):
                counts.update((f, label.as_py()) for f in {f for fs in reader.read(text.as_py() or "") for f in fs})
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()),
                                              pa.array(list(counts.values()), pa.int64())], names=["feature", "label", "n"])

    return sample.select("text", F.col("label").cast("int")).mapInArrow(run, "feature string, label int, n bigint")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton steps for a ridge logistic regression with an intercept; both labels weigh the same in sum."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * len(y) * np.array([0, *beta[1:]]) * 0.01
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * 0.01 * len(y) * np.eye(x.shape[1])
        move = np.linalg.solve(curve, gradient)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, model: CharacterModel, allowed: Column, key: str = "doc_id", text: str = "text",
        label: str = "toxic", per_class: int = PER_CLASS, least_rows: int = 5, least_z: float = 4.0, least_weight: float = 2.0) -> Scorer:
    """Weights and curve from at most 2 * per_class labelled rows; ``allowed`` says which labels may be seen."""
    chosen = stage(labelled_sample(labels, key, label, per_class, allowed).distinct(), "labels")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    # The sample has at most 2 * per_class narrow rows, so it can be sent to every task.
    sample = stage(texts.join(F.broadcast(chosen), "__key").select("text", F.col("__label").alias("label")), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        share = ones / max(1, ones + zeros)
        return Scorer({}, (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    with_1, with_0 = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0))
    share_1, share_0 = (F.col("n1") + 0.5) / (ones + 1), (F.col("n0") + 0.5) / (zeros + 1)
    spread = F.sqrt(share_1 * (1 - share_1) / ones + share_0 * (1 - share_0) / zeros)
    kept = (feature_counts(sample, model).groupBy("feature").agg(with_1.alias("n1"), with_0.alias("n0"))
            .where(F.col("n1") >= least_rows)
            .select("feature", F.log(share_1 / share_0).alias("weight"), ((share_1 - share_0) / spread).alias("z"))
            .where((F.col("z") >= least_z) & (F.col("weight") >= least_weight))
            .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect())
    scorer = Scorer({r.feature: r.weight for r in kept}, (0.0, 0.0, 0.0))
    points = sample.mapInArrow(inputs_of(scorer, model), "strongest double, hits double, label int").collect()
    beta = logistic(np.array([(p.strongest, p.hits) for p in points]), np.array([p.label for p in points], dtype=float))
    scorer.curve = tuple(map(float, beta))
    return scorer


def inputs_of(scorer: Scorer, model: CharacterModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, scorer.of_words)
        for batch in batches:
            made = [scorer.inputs(reader.read(t.as_py() or "")) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.float64()),
                                              batch.column(1).cast(pa.int32())], names=["strongest", "hits", "label"])

    return run


def score(docs: DataFrame, scorer: Scorer, model: CharacterModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with one more column, the score of the whole restored text between 0 and 1."""
    schema = docs.select(F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, scorer.of_words)
        for batch in batches:
            made = [scorer.score(reader.read(t.as_py() or "")) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.float64())], names=["row", "score"])

    row = schema.schema["row"].dataType.simpleString()
    scored = schema.mapInArrow(run, f"row {row}, score double")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != out]
    return scored.select(*kept, F.col("score").alias(out))


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """One fold of the rows by the CRC-32 of the key's text; a null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))
