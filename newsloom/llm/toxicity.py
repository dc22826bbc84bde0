"""Operator 4: toxicity of documents after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship_package, slices_by_bytes, text_of

BATCH_BYTES = 8 << 20
FOLDS = 5
#: Labelled rows of each label that the model is fitted on at most, chosen by a hash of their ids.
TRAINING_ROWS = 10_000
#: Words and prefixes in the model at most, and the toxic training rows that one must be in at least.
MODEL_FEATURES = 20_000
LEAST_ROWS = 5
LEAST_WEIGHT = 2.0
PREFIXES = (4, 5, 6)
STRONGEST = 8

# What a character may stand for in obfuscated words, and what may be strewn into them.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou", "#": "aeiou", "(": "c", "<": "c"}
STREWN = set(" .-_*'~,")
STAND_COST, MASK_COST, STREWN_COST, REPEAT_COST = 1.0, 3.0, 0.4, 0.2
#: Observed words of up to so many characters are kept with what they stand for; longer ones are decoded in windows.
LONGEST_WORD, WINDOW = 48, 1024
#: Tokens, and obfuscated words, that a task remembers at most; it only saves work.
CACHED, NOTHING = 100_000, {}
#: Spaced letters of more than so many may be several words.
ONE_WORD, WORD_END_COST = 12, 1.0

SYMBOLS, SEPARATORS = r"0-9@$!|+*€#(<", r".\-_~"
SPACED = re.compile(rf"(?<![^\W_])[^\W\d_](?:[ *{SEPARATORS}]{{1,2}}(?:[0-9@$!|+*€]?[^\W\d_]|[0-9@$!|+€])){{3,}}(?![^\W_])")
REPLACED = rf"[^\W\d_][{SYMBOLS}{SEPARATORS}]*[{SYMBOLS}][{SYMBOLS}{SEPARATORS}]*[^\W\d_]|(?P<c>[^\W\d_])(?P=c)(?P=c)"
LEET = re.compile(rf"{REPLACED}|^[$@0134578][^\W\d_]{{2}}")
#: Plain words look like this as well (well-known, mp3), so what these may stand for is added to them.
MAYBE = re.compile(rf"[^\W\d_][{SEPARATORS}]+[^\W\d_]|[^\W\d_][{SYMBOLS}]+$")
#: What stands between two spaces has to match this for one of the above to be found in it.
MARKED = re.compile(rf"{REPLACED}|[$@0134578][^\W\d_]{{2}}|[^\W\d_][{SEPARATORS}]+[^\W\d_]|[^\W\d_][{SYMBOLS}]")
TOKEN, REPEATED = re.compile(r"\S+"), re.compile(r"(.)\1\1")
WORD = re.compile(r"[^\W\d_]+")
AROUND = ".,;:!?\"'()[]{}|&%#*=<>~-_"

LETTERS = 64


def letter(c: str) -> int:
    """Its number in the language model: 0 ends a word, a to z and the lower-case letters of Latin-1 have their own."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if "ß" <= c <= "ÿ" and c != "÷":
        return 27 + ord(c) - 0xDF
    return 60 if c.isalpha() else 0


NUMBERS = np.array([letter(chr(i)) for i in range(0x250)], dtype=np.int64)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of three numbers in a row over all texts; each text stands between word ends."""
    joined = "  ".join(["", *texts, ""]).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    numbers = np.where(points < len(NUMBERS), NUMBERS[np.minimum(points, len(NUMBERS) - 1)], 60)
    if len(numbers) < 3:
        return np.zeros(LETTERS**3, dtype=np.int64)
    return np.bincount((numbers[:-2] * LETTERS + numbers[1:-1]) * LETTERS + numbers[2:], minlength=LETTERS**3)


@dataclass(frozen=True)
class LanguageModel:
    """Costs (negative logs) of a character after two others, interpolated with the shorter contexts."""

    costs: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> LanguageModel:
        three = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + LETTERS)
        p2 = (two + 10 * p1) / (two.sum(1, keepdims=True) + 10)
        p3 = (three + 10 * p2[None]) / (three.sum(2, keepdims=True) + 10)
        return LanguageModel(-np.log(p3))


def decode(observed: str, model: LanguageModel, several: bool = False) -> str:
    """The likeliest word behind the observed characters: Viterbi over the lattice of what each may stand for.

    A state is the last two letters, with the way to it as nested pairs. A character is itself, another one that it stands
    for, strewn in (dropped), or the repetition of the letter before it (dropped); with several, a space may end a word. After
    each WINDOW characters only the likeliest state goes on.
    """
    costs = model.costs
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {("", ""): (0.0, None)}
    before, done = "", []

    def letters(way: tuple | None) -> str:
        out = []
        while way:
            way, x = way
            out.append(x)
        return "".join(reversed(out))

    for at, c in enumerate(observed.lower(), 1):
        options = [(c, 0.0)] if c.isalpha() else [(x, MASK_COST if c in "*#" else STAND_COST) for x in STANDS_FOR.get(c, "")]
        if several and c == " ":
            options = [(c, WORD_END_COST)]
        drop = STREWN_COST if c in STREWN else 2 * STAND_COST if c in STANDS_FOR else 2.0
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (cost, way) in states.items():
            if not c.isalpha():
                if (known := new.get((a, b))) is None or cost + drop < known[0]:
                    new[a, b] = cost + drop, way
            elif c == b and c == before:
                if (known := new.get((a, b))) is None or cost + REPEAT_COST < known[0]:
                    new[a, b] = cost + REPEAT_COST, way
            row = costs[letter(a) if a else 0, letter(b) if b else 0]
            for x, extra in options:
                total = cost + extra + row[letter(x)]
                if (known := new.get((b, x))) is None or total < known[0]:
                    new[b, x] = total, (way, x)
        states, before = new or states, c
        if at % WINDOW == 0:
            state = min(states, key=lambda k: states[k][0])
            done.append(letters(states[state][1]))
            states = {state: (0.0, None)}
    ends = [(cost + costs[letter(a) if a else 0, letter(b) if b else 0, 0], way) for (a, b), (cost, way) in states.items()]
    least = min(cost for cost, _ in ends)
    return "".join([*done, min(letters(way) for cost, way in ends if cost == least)])


def _decoded(observed: str, model: LanguageModel, known: dict[str, str], several: bool = False) -> str:
    word = known.get(observed)
    if word is None:
        word = decode(observed, model, several)
        if len(observed) <= LONGEST_WORD:
            if len(known) > CACHED:
                known.clear()
            known[observed] = word
    return word


def closed_up(text: str, model: LanguageModel, known: dict[str, str]) -> str:
    """The text with runs of spaced-out letters replaced by the words that they are. Wider gaps are between words if there are narrow ones as well."""

    def spaced(m: re.Match) -> str:
        run = m[0]
        if sum(map(str.isalpha, run)) < 3:
            return run
        narrow = re.search(r"[^ ] [^ ]", run)
        return " ".join(_decoded(x, model, known, sum(c not in STREWN for c in x) > ONE_WORD) for x in (run.split("  ") if narrow else [re.sub(" +", " ", run)]))

    return SPACED.sub(spaced, text)


def restored(token: str, model: LanguageModel, known: dict[str, str]) -> str:
    """What stands between two spaces, with an obfuscated word replaced by what it stands for. It depends on nothing around it.

    Words that plain text has as well (split by . - _ ~ alone, or with digits or symbols at the end) stay and are followed
    by what they may stand for.
    """
    if not MARKED.search(token):
        return token
    core = token.strip(AROUND)
    if token[0] in "$@" and token[1:2].isalpha():
        core = token[0] + core.lstrip("$@")
    if len(core) < 3 or "://" in core or re.search(r"@[\w-]+\.", core):
        return token
    n = sum(map(str.isalpha, core))
    if n >= 2 and LEET.search(core):
        return token.replace(core, _decoded(core, model, known), 1)
    if MAYBE.search(core) and (n >= 2 or re.search(r"[@$!|+€]$", core)):
        return f"{token} {_decoded(core, model, known)}"
    return token


def restore(text: str, model: LanguageModel, known: dict[str, str]) -> str:
    """The text with obfuscated words replaced by what they stand for; other words stay as they are."""
    return TOKEN.sub(lambda m: restored(m[0], model, known), closed_up(text, model, known))


def restored_words(token: str, model: LanguageModel, known: dict[str, str]) -> list[str]:
    """The lower-case words of a restored token."""
    return WORD.findall((token if token.isalpha() and not REPEATED.search(token) else restored(token, model, known)).lower())


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Scorer:
    """Weights of words and prefixes, and the logistic function of a document's evidence."""

    language: LanguageModel
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)

    def word_weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0)

    def evidence(self, texts: list[str], known: dict[str, str], cache: dict[str, dict[str, float]]) -> np.ndarray:
        """For each text, over its distinct words: the sum of the strongest weights, the strongest, and the number of words with one.

        The cache has the words with a weight of each token between spaces.
        """
        out = np.zeros((len(texts), 3))
        for r, text in enumerate(texts):
            words: dict[str, float] = {}
            for token in set(closed_up(text, self.language, known).split()):
                own = cache.get(token)
                if own is None:
                    own = {w: weight for w in restored_words(token, self.language, known) if (weight := self.word_weight(w)) > 0}
                    if len(token) <= LONGEST_WORD:
                        if len(cache) > CACHED:
                            cache.clear()
                        cache[token] = own or NOTHING
                if own:
                    words |= own
            if words:
                found = sorted(words.values(), reverse=True)
                out[r] = sum(found[:STRONGEST]), found[0], math.log1p(len(found))
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + evidence @ np.array(self.slopes), -30, 30)))


def fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def language_model(docs: DataFrame, text_col: str = "text") -> LanguageModel:
    """The character model of all texts: counts are added up in each task, then over tasks; their table has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES // 2):
                total += trigram_counts(part.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    counts = np.zeros(LETTERS**3, dtype=np.int64)
    for r in docs.select(text_of(text_col).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["code"]] = r["n"]
    return LanguageModel.of(counts)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last one the bias, by Newton's steps with a small penalty."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(len(w)), x.T @ (p - y) + 0.05 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training_rows: int = TRAINING_ROWS) -> Scorer:
    """A scorer from all texts (the language model) and a bounded sample of labelled rows outside fold 0 (the rest).

    Of copies and near copies in the sample, told by the smallest hash of five words in a row, one counts. Weights of words
    come from folds 1 to 3, the logistic function from fold 4. Without rows of both labels, the scorer finds nothing toxic.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scorer = Scorer(language_model(docs, text_col))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), fold_of(id_col).alias("fold")).where("fold <> 0")
    known = known.groupBy("id").agg(F.max("label").alias("label"), F.first("fold").alias("fold"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return scorer
    share = F.when(F.col("label") == 1, F.lit(max(1, training_rows * 1_000_000 // sizes[1]))).otherwise(F.lit(max(1, training_rows * 1_000_000 // sizes[0])))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    shared = spark.sparkContext.broadcast(scorer.language)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Restored words of each row, each once, and the sketch that tells near copies."""
        known: dict[str, str] = {}
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES):
                sketch, listed = [], []
                for text in part.column("text").to_pylist():
                    words = [w for t in closed_up(text, shared.value, known).split() for w in restored_words(t, shared.value, known)]
                    sketch.append(min((hash5(words[i : i + 5]) for i in range(max(1, len(words) - 4))), default=0))
                    listed.append(sorted(set(words)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "fold")), pa.array(sketch, pa.int64()), pa.array(listed, pa.list_(pa.string()))], names=["id", "label", "fold", "sketch", "words"])

    # The drawn ids are bounded by the parameter (beyond 10^10 labelled rows one of a million is drawn), so they are broadcast.
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(drawn), "id")
    rows = checkpoint(sample.mapInArrow(read, f"id {docs.schema[id_col].dataType.simpleString()}, label int, fold long, sketch long, words array<string>"))
    rows = rows.join(rows.groupBy("sketch", "label").agg(F.min("id").alias("id")), ["sketch", "label", "id"]).dropDuplicates(["sketch", "label", "id"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for label, words in zip(batch.column("label").to_pylist(), batch.column("words").to_pylist()):
                seen[label].update({f for w in words for f in features_of(w)})
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)], names=["feature", "clean", "toxic"])

    learn = rows.where("fold < 4")
    n = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    if len(n) < 2:
        return scorer
    tables = learn.select("label", "words").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    best = tables.where(F.col("toxic") >= min(LEAST_ROWS, max(1, n[1] // 20))).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), "feature").limit(MODEL_FEATURES)
    scorer.weights = {r["feature"]: r["weight"] for r in best.collect()}
    model = spark.sparkContext.broadcast(scorer)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.value.evidence([" ".join(w) for w in batch.column("words").to_pylist()], {}, {})
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x[:, k]) for k in range(3))], names=["label", "a", "b", "c"])

    fitted = rows.where("fold = 4").select("label", "words").mapInArrow(weigh, "label int, a double, b double, c double").toPandas()
    if fitted["label"].nunique() == 2:
        *slopes, bias = _logistic(fitted[["a", "b", "c"]].to_numpy(), fitted["label"].to_numpy())
        scorer.slopes, scorer.bias = tuple(float(s) for s in slopes), float(bias)
    else:
        scorer.slopes, scorer.bias = (1.0, 0.0, 0.0), -LEAST_WEIGHT * 2
    return scorer


def hash5(words: list[str]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(" ".join(words).encode("utf-8", "replace")) >> 1


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """id and score (0 to 1) of every row; or, where keep names a column that docs don't have, all columns and the score under that name.

    Whole texts are restored and read. Null and empty texts have no evidence and so the smallest score. Rows of one text have
    one score.
    """
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        cache: dict[str, dict[str, float]] = {}
        for batch in batches:
            for part in slices_by_bytes(batch, text_col if keep else "text", BATCH_BYTES):
                texts = [t or "" for t in part.column(text_col if keep else "text").to_pylist()]
                scores = pa.array(model.value.scores(model.value.evidence(texts, known, cache)), pa.float64())
                if keep:
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], scores], names=[*names, keep])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("id"), scores], names=["id", "score"])

    if keep:
        return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{keep}` double")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
