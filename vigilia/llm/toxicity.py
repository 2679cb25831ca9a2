"""Toxicity of text after noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Words that look disguised (look-alike digits and symbols among
letters, stretched letters, letters set apart by separators or spaces) become lattices: each position may stand for several
letters, a run for one or two of its letter, a separator between single letters for nothing. At least three one-character words
(letters or look-alikes, one of them a letter) of one text side by side are one lattice, in which each space may be a word boundary
or nothing; four characters of context, counted over the whole corpus too, decide there. The Viterbi path through the lattice under the model and the channel's costs is the restored word, or words. Plain
words are lattices with one path and stay.

The restored text is scored by a lexicon of words and word beginnings whose log-odds between toxic and other documents are
surely positive, learned from labelled rows, and a logistic function of its hits. ``held_out`` rows are never learned from.
The classifier is fitted on at most ``SAMPLE`` labelled rows (distinct texts, in the order of a hash of ``doc_id``); the
character model is counted over all documents.

Null and empty texts have no hits and get the base score; without toxic and other labels every score is 0. Every row gets a score, with a
null or repeated id too; of a document's repeated labels the largest counts; other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .textvec import BYTE_CODE, STEP, Spans, hashes, mixed, raw, slices, words

SAMPLE, THRESHOLD, FOLDS, HELD_FOLD = 20_000, 0.3, 4, 2
PREFIXES = (4, 5, 6)
LEAST_DOCS, LEAST_SHARE, SURE, LEAST_ODDS, RIDGE = 3, 0.005, 2.5, 1.0, 1.0
CACHE = 100_000
SCHEMA = "doc_id long, score double, n_restored long"

# Symbols of the character model: boundary, a-z, other ASCII, other letters.
BOUNDARY, OTHER, BEYOND, N_SYMBOLS = 0, 27, 28, 29
SYMBOL = np.full(256, OTHER, np.int64)
SYMBOL[[9, 10, 11, 12, 13, 32]] = BOUNDARY
SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
SYMBOL[ord("A") : ord("Z") + 1] = np.arange(1, 27)
SYMBOL[0x80:] = BEYOND

# Letters that a look-alike character may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "*": "aeiouy",
}
SEPARATORS = ".-_*~"
#: Channel costs: log-probabilities of a look-alike, a stretched letter, a dropped separator, a character kept as it is not a letter.
SWAPPED, STRETCHED, SET_APART, KEPT = math.log(0.2), math.log(0.5), math.log(0.5), math.log(0.02)
#: Log-probabilities of a boundary and of nothing at a space between one-character words; the fewest of them that make a lattice.
PARTED, UNPARTED, LEAST_RUN = math.log(1 / 6), math.log(5 / 6), 3
#: Words of one letter, and the least share of words that each is given where spaces are read, whatever the corpus holds.
ALONE, ALONE_SHARE = "ai", 0.01


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


OPENING, CLOSING = _table("\"'([{<*#&%|"), _table(".,;:!?\"')]}%*&#|>")
LETTER = (SYMBOL >= 1) & (SYMBOL <= 26) | (SYMBOL == BEYOND)
DISGUISE = _table("".join(LOOK_ALIKES))
APART = _table(SEPARATORS)


# -- character model ------------------------------------------------------------------------------------------------------------


def _gram_task(sizes: tuple[int, ...]):
    """Counts of all runs of so many symbols; the codes of each size follow those of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(N_SYMBOLS**k, np.int64) for k in sizes]
        for _, texts in slices(batches):
            data, offsets = raw(texts)
            symbol = SYMBOL[data]
            for k, total in zip(sizes, totals):
                n = len(symbol) - k + 1
                if n < 1:
                    continue
                code = np.zeros(n, np.int64)
                for j in range(k):
                    code = code * N_SYMBOLS + symbol[j : j + n]
                inside = np.ones(n, bool)
                for back in range(1, k):
                    at = offsets[1:-1] - back
                    inside[at[(at >= 0) & (at < n)]] = False
                total += np.bincount(code[inside], minlength=len(total))
        every = np.concatenate(totals)
        some = np.flatnonzero(every)
        yield pa.record_batch([pa.array(some), pa.array(every[some])], ["trigram", "n"])

    return run


def trigram_counts(docs: DataFrame, sizes: tuple[int, ...] = (3,)) -> DataFrame:
    """Counts of all character trigrams of ``docs`` (``text``), at most ``N_SYMBOLS ** 3`` rows; or of runs of the given ``sizes``."""
    return docs.select("text").mapInArrow(_gram_task(sizes), "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


class CharModel:
    """Log-probability of a symbol after two others, from trigram, bigram and single counts; and after three, for ``spaced`` words."""

    def __init__(self, counts: np.ndarray, longer: np.ndarray) -> None:
        tri = counts.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS).astype(float)
        self.log = np.log(self._after_two(tri)).reshape(-1).tolist()
        four = longer.reshape([N_SYMBOLS] * 4).astype(float)
        self._alone(four)
        four = (four + 5 * self._after_two(four.sum(0))) / (four.sum(3, keepdims=True) + 5)
        self.spaced = array("f", np.log(four).astype(np.float32).tobytes())

    @staticmethod
    def _after_two(tri: np.ndarray) -> np.ndarray:
        bi, uni = tri.sum(0), tri.sum((0, 1))
        one = (uni + 1) / (uni.sum() + N_SYMBOLS)
        two = (bi + 5 * one) / (bi.sum(1, keepdims=True) + 5)
        return (tri + 5 * two) / (tri.sum(2, keepdims=True) + 5)

    @staticmethod
    def _alone(four: np.ndarray) -> None:
        """Adds the words of one letter to the counts, before and after what other words stand beside."""
        before, after = four[:, :, BOUNDARY].sum(2), four[:, BOUNDARY].sum(0)
        extra = ALONE_SHARE * after.sum()
        for letter in ALONE if extra else "":
            z = symbol_of(letter)
            four[:, :, BOUNDARY, z] += ALONE_SHARE * before
            four[:, BOUNDARY, z, BOUNDARY] += ALONE_SHARE * before.sum(0)
            four[BOUNDARY, z, BOUNDARY] += extra * after.sum(1) / after.sum()
            four[z, BOUNDARY] += extra * after / after.sum()


def char_model(docs: DataFrame) -> CharModel:
    sizes = 3, 4
    counts = np.zeros(sum(N_SYMBOLS**k for k in sizes), np.int64)
    rows = trigram_counts(docs, sizes).toPandas()
    counts[rows["trigram"]] = rows["n"]
    return CharModel(*np.split(counts, [N_SYMBOLS**3]))


# -- restoring ------------------------------------------------------------------------------------------------------------------


def symbol_of(char: str) -> int:
    code = ord(char)
    return int(SYMBOL[code]) if code < 0x80 else BEYOND


def stretches(noisy: str) -> tuple[list[int], list[int]]:
    """For each position where the stretch of its character ends, and how often the character stands in it; spaces between are passed over."""
    n = len(noisy)
    end, size = list(range(1, n + 1)), [1] * n
    for i in range(n - 2, -1, -1):
        k = i + 2 if noisy[i + 1] == " " else i + 1
        if k < n and noisy[k] == noisy[i] != " ":
            end[i], size[i] = end[k], size[k] + 1
    return end, size


def lattice(noisy: str) -> list[list[tuple[int, str, float]]]:
    """Arcs from each position: the next position, the letters read on the way and the channel's log-probability."""
    n = len(noisy)
    end, size = stretches(noisy)
    arcs: list[list[tuple[int, str, float]]] = []
    for i, char in enumerate(noisy):
        found = []
        if char == " ":
            found += [(i + 1, " ", PARTED), (i + 1, "", UNPARTED)]
        elif char.isalpha():
            found.append((i + 1, char, 0.0))
            if size[i] > 2:
                found += [(end[i], char, STRETCHED), (end[i], char * 2, STRETCHED)]
        else:
            found.append((i + 1, char, KEPT))
            found += [(i + 1, c, SWAPPED) for c in LOOK_ALIKES.get(char, "")]
            if size[i] > 2:
                found += [(end[i], c, SWAPPED + STRETCHED) for c in LOOK_ALIKES.get(char, "")]
            alone = 0 < i < n - 1 and (i < 2 or not noisy[i - 2].isalnum()) and (i + 2 >= n or not noisy[i + 2].isalnum())
            if char in SEPARATORS and alone:
                found.append((i + 1, "", SET_APART))
        arcs.append(found)
    return arcs


def restore(noisy: str, model: CharModel) -> str:
    """The most probable word or words behind ``noisy``: Viterbi over (position, last two symbols), or three where spaces are read."""
    noisy = noisy.lower()
    arcs, n = lattice(noisy), len(noisy)
    log, size = (model.spaced, N_SYMBOLS**3) if " " in noisy else (model.log, N_SYMBOLS**2)
    best: list[dict[int, tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0][BOUNDARY] = (0.0, None)
    for i in range(n):
        for state, (score, path) in best[i].items():
            for to, read, cost in arcs[i]:
                x, total = state, score + cost
                for char in read:
                    x = x * N_SYMBOLS + symbol_of(char)
                    total += log[x]
                    x %= size
                held = best[to].get(x)
                if held is None or held[0] < total:
                    best[to][x] = (total, (read, path))
        best[i] = {}
    last = max(best[n].items(), key=lambda s: s[1][0] + log[s[0] * N_SYMBOLS + BOUNDARY])[1][1]
    out = []
    while last is not None:
        out.append(last[0])
        last = last[1]
    return "".join(reversed(out))


class Restorer(dict):
    """Restored forms of the noisy words a process has met."""

    def __init__(self, model: CharModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, noisy: str) -> str:
        word = restore(noisy, self.model)
        if len(self) < CACHE and len(noisy) <= 64:
            self[noisy] = word
        return word


def cores(word: Spans) -> Spans:
    """Words without opening and closing marks; three or more ``$`` at the end are marks too."""
    begin, end, data = word.begin.copy(), word.end.copy(), word.data
    left = np.arange(len(begin))
    while len(left := left[(begin[left] < end[left])]) and len(left := left[OPENING[data[begin[left]]]]):
        begin[left] += 1
    right = np.arange(len(begin))
    while len(right := right[begin[right] < end[right]]):
        dollars = (end[right] - begin[right] > 2) & (data[end[right] - 1] == 36)
        dollars[dollars] = (data[end[right[dollars]] - 2] == 36) & (data[end[right[dollars]] - 3] == 36)
        end[right[dollars]] -= 2
        right = right[dollars | CLOSING[data[end[right] - 1]]]
        if not len(right):
            break
        end[right] -= 1
    return word._replace(begin=begin, end=end)


class Reading(NamedTuple):
    """The restored words of a slice: plain ones as spans, noisy ones as strings, each with its text."""

    plain: Spans
    noisy: list[str]
    owner: np.ndarray


def spaced(word: Spans, core: Spans) -> list[tuple[int, int]]:
    """Runs of one-character words of one text, marks at either end left out, that are long enough and have a letter."""
    one, bare = core.end - core.begin == 1, word.end - word.begin == 1
    first = np.minimum(np.where(one, core.begin, word.begin), len(word.data) - 1)
    char = core.data[first]
    letter = one & (SYMBOL[char] >= 1) & (SYMBOL[char] <= 26)
    single = letter | (one | bare) & DISGUISE[char]
    new = np.ones(len(single), bool)
    new[1:] = core.text[1:] != core.text[:-1]
    before = np.concatenate([[False], single[:-1]]) & ~new
    begin = np.flatnonzero(single & ~before)
    after = np.concatenate([before[1:], [False]])
    end = np.flatnonzero(single & ~(after & np.concatenate([single[1:], [False]]))) + 1
    letters = np.concatenate([[0], np.cumsum(letter)])
    some = (end - begin >= LEAST_RUN) & (letters[end] > letters[begin])
    out = []
    for a, b in zip(begin[some].tolist(), end[some].tolist()):
        while not one[a] and OPENING[char[a]]:
            a += 1
        while not one[b - 1] and CLOSING[char[b - 1]]:
            b -= 1
        if b - a >= LEAST_RUN:
            out.append((a, b))
    return out


def read(texts: pa.Array) -> Reading:
    word = words(texts, lower=True)
    core = cores(word)
    data, begin, end = core.data, core.begin, core.end

    def within(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[end] - upto[begin]

    letters = within(LETTER[data])
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (SYMBOL[data[2:]] >= 1) & (SYMBOL[data[2:]] <= 26)
    upto = np.concatenate([[0], np.cumsum(same)])
    stretched = (end - begin > 2) & (upto[end] > upto[np.minimum(begin + 2, end)])
    odd = (letters > 0) & ((within(DISGUISE[data]) > 0) | stretched | (within(APART[data]) > 1))
    joined = np.zeros(len(begin), bool)
    noisy, owner = [], []
    text = data.tobytes()
    for a, b in spaced(word, core) if len(begin) else []:
        joined[a:b] = True
        noisy.append(" ".join(chr(data[begin[k] if end[k] > begin[k] else word.begin[k]]) for k in range(a, b)))
        owner.append(core.text[a])
    for k in np.flatnonzero(odd).tolist():
        noisy.append(text[begin[k] : end[k]].decode("utf-8", "replace"))
        owner.append(core.text[k])
    keep = ~odd & ~joined & (end > begin)
    return Reading(core._replace(begin=begin[keep], end=end[keep], text=core.text[keep]), noisy, np.array(owner, np.int64))


# -- features and scores --------------------------------------------------------------------------------------------------------


def features(word: Spans) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, feature) for the whole word and each beginning that is shorter than it."""
    size = word.end - word.begin
    out = [(np.arange(len(size)), hashes(word))]
    some, total = np.arange(len(size)), np.zeros(len(size), np.uint64)
    for k, power in enumerate(np.cumprod(np.full(max(PREFIXES), STEP, np.uint64))):
        keep = size[some] > k
        some, total = some[keep], total[keep] + BYTE_CODE[word.data[word.begin[some[keep]] + k]] * power
        if k + 1 in PREFIXES:
            longer = size[some] > k + 1
            out.append((some[longer], mixed(total[longer] + np.uint64(k + 1))))
    return out


def _read_words(texts: pa.Array, restorer: Restorer) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, np.ndarray]:
    """(word, text, feature) parts of a slice and the number of noisy words of each text."""
    got = read(texts)
    found = [(w, got.plain.text[w], f) for w, f in features(got.plain)]
    count = len(got.plain.begin)
    if got.noisy:
        again = words(pa.array([restorer[x] for x in got.noisy], pa.string()), lower=True)
        found += [(count + w, got.owner[again.text[w]], f) for w, f in features(again)]
        count += len(again.begin)
    return found, count, np.bincount(got.owner, minlength=len(texts)) if got.noisy else np.zeros(len(texts), np.int64)


class Lexicon:
    """Sorted features with weights; a small table settles most look-ups."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(feature)
        self.feature, self.weight = feature[order], weight[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.feature & np.uint64(0xFFFF)] = True

    def find(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the features that are in the lexicon, and their places there."""
        at = np.flatnonzero(self.maybe[feature & np.uint64(0xFFFF)])
        if not len(at) or not len(self.feature):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.feature, feature[at]), len(self.feature) - 1)
        hit = self.feature[place] == feature[at]
        return at[hit], place[hit]


def signals(texts: pa.Array, restorer: Restorer, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """For each text the largest weight of a word and the logarithm of the sum of weights; and the number of noisy words."""
    found, count, noisy = _read_words(texts, restorer)
    weight, text = np.zeros(count), np.zeros(count, np.int64)
    for w, owner, f in found:
        at, place = lexicon.find(f)
        np.maximum.at(weight, w[at], lexicon.weight[place])
        text[w[at]] = owner[at]
    hit = np.flatnonzero(weight)
    most, total = np.zeros(len(texts)), np.zeros(len(texts))
    np.maximum.at(most, text[hit], weight[hit])
    np.add.at(total, text[hit], weight[hit])
    return np.stack([most, np.log1p(total)], 1), noisy


def _feature_task(shared, candidates: np.ndarray | None):
    """Documents by feature and label; of toxic documents only, or of the candidate features only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        known = None if candidates is None else Lexicon(candidates, np.zeros(len(candidates)))
        for rows, texts in slices(batches):
            label = np.array(rows.column("toxic").to_pylist(), np.int64)
            text, feature = [], []
            for _, owner, f in _read_words(texts, restorer)[0]:
                at = np.arange(len(f)) if known is None else known.find(f)[0]
                text.append(owner[at])
                feature.append(f[at])
            text, feature = np.concatenate(text), np.concatenate(feature)
            order = np.lexsort((feature, text))
            text, feature = text[order], feature[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
            values, place = np.unique(feature[new], return_inverse=True)
            toxic = np.bincount(place, label[text[new]], len(values)).astype(np.int64)
            yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(toxic), pa.array(np.bincount(place, minlength=len(values)) - toxic)], ["feature", "toxic", "other"])

    return run


def _signal_task(shared, lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for rows, texts in slices(batches):
            x, _ = signals(texts, restorer, lexicon)
            yield pa.record_batch([rows.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "most", "total"])

    return run


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge on the slopes, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6, *[RIDGE] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    chars: CharModel
    lexicon: Lexicon
    weights: np.ndarray | None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The character model of all ``docs`` and a classifier from at most ``sample`` labelled rows that are not held out."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = char_model(docs)
    shared = spark.sparkContext.broadcast(chars)
    once = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("long").alias("toxic"), "text").dropDuplicates(["text", "toxic"])
    counts = "feature long, toxic long, other long"
    sums = [F.sum("toxic").alias("toxic"), F.sum("other").alias("other")]
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = classes.get(1, 0), classes.get(0, 0)
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if not n_toxic or not n_other:
        return Model(chars, empty, None)
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n_toxic))
    seen = rows.where("toxic = 1").mapInArrow(_feature_task(shared, None), counts).groupBy("feature").agg(*sums).where(F.col("toxic") >= least)
    candidates = np.sort(np.array([r["feature"] for r in seen.select("feature").collect()], np.int64).view(np.uint64))
    table = rows.mapInArrow(_feature_task(shared, candidates), counts).groupBy("feature").agg(*sums).toPandas()
    a, b = table["toxic"].to_numpy(float) + 0.5, table["other"].to_numpy(float) + 0.5
    odds = np.log(a / (n_toxic - a + 1)) - np.log(b / (n_other - b + 1))
    sure = odds - SURE * np.sqrt(1 / a + 1 / b) > LEAST_ODDS
    lexicon = Lexicon(table["feature"].to_numpy(np.int64).view(np.uint64)[sure], odds[sure])
    x = rows.mapInArrow(_signal_task(shared, lexicon), "toxic long, most double, total double").toPandas()
    x = x.sort_values(["toxic", "most", "total"])
    return Model(chars, lexicon, fitted(x[["most", "total"]].to_numpy(), x["toxic"].to_numpy(float)))


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = Restorer(model.chars)
        for rows, texts in slices(batches):
            x, noisy = signals(texts, restorer, model.lexicon)
            w = model.weights
            score = np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.record_batch([rows.column("doc_id"), pa.array(score), pa.array(noisy.astype(np.int64))], ["doc_id", "score", "n_restored"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and the number of noisy words of every row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score_task(shared), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned from labels that are not held out."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_restored")
