"""Phrase collocations per language by mergeable Misra-Gries summaries and an exact second pass.

Texts are packed into blocks of one language. The first pass hashes all n-grams of a block, occurrence counts cut at the threshold, and deals
them by hash to partitions, packed: fingerprints of ``PRINT_BITS``, sorted, as differences. A partition merges its blocks into a Misra-Gries
summary: counters are added up, and where there are more than its capacity, the largest one too many is taken from all and what is not positive
goes. The capacity exceeds the partition's mass divided by the threshold, so all such cuts together are below the threshold, and every n-gram
that reaches the threshold still has a counter; counters that cannot reach it with the cuts added back are left out. (A count cut at the
threshold in some block reaches it all the same, and fingerprints that meet only add up.) Each block then learns which of its n-grams survive.

The second pass goes over the blocks again and counts the survivors by their words, exactly, and deals the counts, packed, to the same
partitions; their sums and the threshold leave the frequent phrases. Every part of a frequent phrase is frequent itself, so all counts that scores ask for are there.
Scores are exact: products in decimals of 38 digits, divided as integers.

A task holds a block (a text is cut where a piece ends, so only a piece beyond ``BLOCK_BYTES`` makes a larger one), or a partition's packed
fingerprints and summary; the number of partitions follows the bytes of text. Frequent words are one entry a block; what is hot in the joins on
parts of phrases is split by adaptive execution. The first ranks of a language are taken from the first ranks of ``SALTS`` shares of it.

A null text is empty and gives nothing; a null language counts as ``und``; equal rows count each; a language without phrases has no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import configure, materialize
from .textvec import LOWER, Spans, hashes, mixed, strings, windows

LONGEST, THRESHOLD, CONTAINED, TOP, SALTS = 3, 10, 50, 2000, 32
BLOCK_BYTES, SLICE_BYTES, HELD_BYTES, PART_MASS, FOLD = 8 << 20, 1 << 20, 32 << 20, 1 << 23, 1 << 21
#: What ends a piece, and what stands between words.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
#: A partition has some 2^23 n-grams: with so many bits one in a thousand that is not frequent meets a frequent one.
PRINT_BITS = 26
WIDTH, LOW = np.uint64(PRINT_BITS), np.uint64((1 << PRINT_BITS) - 1)
BLOCKS = "block long, lang string, size long, body binary"
ENTRIES = "part int, block long, mass long, body binary"
TALLIES = "part int, lang string, phrases binary, counts binary"
COUNTS = "lang string, words int, phrase string, count long"


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in spec.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _squeezed(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _opened(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def pieces(data: bytes, limit: int) -> Iterator[bytes]:
    """Stretches of about ``limit`` bytes, cut only after a byte that ends a piece."""
    at = 0
    kinds = KIND[np.frombuffer(data, np.uint8)] if len(data) > limit else None
    while len(data) - at > limit:
        ends = np.flatnonzero(kinds[at : at + limit] == 2)
        if not len(ends):
            ends = np.flatnonzero(kinds[at + limit :] == 2) + limit
            if not len(ends):
                break
            ends = ends[:1]
        yield data[at : at + int(ends[-1]) + 1]
        at += int(ends[-1]) + 1
    if at < len(data):
        yield data[at:]


def _blocks_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a language joined by line feeds, which end a piece anyway."""
    block = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def packed(lang: str) -> pa.RecordBatch:
        nonlocal block
        data = b"\n".join(held.pop(lang))
        block += 1
        return _batch([(block, lang, sizes.pop(lang), _squeezed(data, 4))], BLOCKS)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
            for part in pieces(text.as_buffer().to_pybytes(), BLOCK_BYTES):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] >= BLOCK_BYTES:
                    yield packed(lang)
            if sum(sizes.values()) >= HELD_BYTES:
                yield from map(packed, list(held))
    yield from map(packed, list(held))


class Grams:
    """The n-grams of a stretch of text: normal words (each followed by a space), and for each n the first words and hashes."""

    def __init__(self, data: bytes, lang: str, longest: int) -> None:
        raw = LOWER[np.frombuffer(data, np.uint8)]
        kind = KIND[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = kind == 0
        begin, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        piece = np.cumsum(kind == 2)[begin]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(begin)]]) if len(begin) else np.zeros(1, np.int64)
        hashed = hashes(Spans(raw, begin, end, np.zeros(len(begin), np.int64), np.array([0, len(raw)])))
        self.raw, self.begin, self.end = raw, begin, end
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        self.grams = []
        for n in range(1, longest + 1):
            found, first = windows(hashed, bounds, n)
            self.grams.append((first, mixed(found ^ seed)))

    def keys(self, parts: int) -> list[np.ndarray]:
        """Partition and fingerprint of every n-gram, in one number."""
        place = lambda h: ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) << WIDTH | (h & LOW)
        return [place(h) for _, h in self.grams]

    def phrases(self, n: int, first: np.ndarray) -> pa.Array:
        """The phrases of ``n`` words that begin at these words, words joined by one space."""
        size = self.end - self.begin + 1
        offset = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(offset[-1]) - np.repeat(offset[:-1] - self.begin, size)
        spaced = np.where(np.arange(offset[-1]) == np.repeat(offset[1:] - 1, size), np.uint8(32), self.raw[np.minimum(at, len(self.raw) - 1)])
        lengths = offset[first + n] - 1 - offset[first]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        body = spaced[np.arange(ends[-1]) - np.repeat(ends[:-1] - offset[first], lengths)]
        # Offsets of 64 bits: a frequent phrase may stand often in a stretch.
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body.tobytes()))


def packed(prints: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted fingerprints as differences and their counts, each byte of the numbers apart."""
    steps = np.diff(prints, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return _squeezed(np.concatenate([steps.T.reshape(-1), counts.astype("<u2").view(np.uint8).reshape(-1, 2).T.reshape(-1)]).tobytes())


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(_opened(body), np.uint8)
    n = len(data) // 6
    steps = np.ascontiguousarray(data[: 4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=np.uint32), np.ascontiguousarray(data[4 * n :].reshape(2, n).T).view("<u2").reshape(-1)


def _entries_task(parts: int, longest: int, threshold: int):
    def rows(row: dict) -> Iterator[tuple]:
        found = [np.concatenate(Grams(part, row["lang"], longest).keys(parts)) for part in pieces(_opened(row["body"]), SLICE_BYTES)]
        keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counts = np.minimum(counts, threshold)
        edges = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << WIDTH)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            mine = slice(edges[p], edges[p + 1])
            yield p, row["block"], int(counts[mine].sum()), packed((keys[mine] & LOW).astype(np.uint32), counts[mine])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if out := list(rows(row)):
                    yield _batch(out, ENTRIES)

    return run


class Summary:
    """A Misra-Gries summary over fingerprints; ``taken`` is the most that any counter has lost."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.prints, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, prints: np.ndarray, counts: np.ndarray) -> None:
        prints, counts = np.concatenate([self.prints, prints]), np.concatenate([self.counts, counts.astype(np.int64)])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
        self.prints, self.counts = prints[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.prints) > self.capacity:
            cut = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            stays = self.counts > cut
            self.prints, self.counts, self.taken = self.prints[stays], self.counts[stays] - cut, self.taken + cut

    def reaching(self, threshold: int) -> np.ndarray:
        """Sorted fingerprints that may have the threshold: all that have it are among them."""
        return self.prints[self.counts + self.taken >= threshold]


def _survivors_task(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        summary = Summary(pc.sum(table["mass"]).as_py() // threshold + 1)
        held, size = [], 0
        for body in table["body"]:
            held.append(unpacked(body.as_py()))
            size += len(held[-1][0])
            if size >= FOLD:
                summary.merge(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            summary.merge(*map(np.concatenate, zip(*held)))
        reach = summary.reaching(threshold)
        out = []
        for part, block, body in zip(table["part"], table["block"], table["body"]):
            prints, _ = unpacked(body.as_py())
            at = np.searchsorted(reach, prints)
            stay = prints[(at < len(reach)) & (reach[np.minimum(at, max(len(reach) - 1, 0))] == prints)] if len(reach) else prints[:0]
            if len(stay):
                out.append((part.as_py(), block.as_py(), len(stay), packed(stay, np.zeros(len(stay)))))
        return pa.Table.from_batches([_batch(out, ENTRIES)] if out else [], _batch([(0, 0, 0, b"")], ENTRIES).schema)

    return run


def _tally_task(parts: int, longest: int):
    def found(row: dict, alive: np.ndarray) -> Iterator[pa.Table]:
        """Survivors of each stretch with their partitions, and its words under the empty phrase of the first partition."""
        for data in pieces(_opened(row["body"]), SLICE_BYTES):
            grams = Grams(data, row["lang"], longest)
            yield pa.table({"part": pa.array([0], pa.int64()), "phrase": pa.array([""], pa.large_string()), "count": pa.array([len(grams.begin)], pa.int64())})
            for n, ((first, _), keys) in enumerate(zip(grams.grams, grams.keys(parts)), 1):
                if len(alive) and len(keys):
                    hit = alive[np.minimum(np.searchsorted(alive, keys), len(alive) - 1)] == keys
                    each = pa.table({"part": (keys[hit] >> WIDTH).astype(np.int64), "phrase": grams.phrases(n, first[hit])})
                    yield each.group_by(["part", "phrase"]).aggregate([([], "count_all")]).rename_columns(["part", "phrase", "count"])

    def rows(row: dict) -> Iterator[tuple]:
        kept = [(np.uint64(s["part"]) << WIDTH) | unpacked(s["body"])[0].astype(np.uint64) for s in sorted(row["survivors"] or [], key=lambda s: s["part"])]
        tables = list(found(row, np.concatenate(kept) if kept else np.zeros(0, np.uint64)))
        whole = pa.concat_tables(tables).group_by(["part", "phrase"]).aggregate([("count", "sum")]).sort_by([("part", "ascending"), ("phrase", "ascending")])
        part, phrases, counts = whole["part"].to_numpy(), whole["phrase"].to_pylist(), whole["count_sum"].to_numpy().astype("<u8")
        edges = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            mine = slice(edges[p], edges[p + 1])
            planes = counts[mine].view(np.uint8).reshape(-1, 8).T
            yield p, row["lang"], _squeezed("\n".join(phrases[mine]).encode(), 3), _squeezed(planes.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if out := list(rows(row)):
                    yield _batch(out, TALLIES)

    return run


def _sums_task(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """Sums of a partition's counts; sorted out block by block, summed whenever many have come together."""
        summed, held, size = [], [], 0

        def fold() -> list[pa.Table]:
            whole = pa.concat_tables([*summed, *held]).group_by(["lang", "phrase"]).aggregate([("count", "sum")])
            return [whole.rename_columns(["lang", "phrase", "count"])]

        for row in table.to_batches(max_chunksize=1):
            lang, phrases, counts = (row.column(c)[0].as_py() for c in ("lang", "phrases", "counts"))
            phrases, planes = _opened(phrases).decode().split("\n"), np.frombuffer(_opened(counts), np.uint8).reshape(8, -1)
            held.append(pa.table({"lang": pa.array([lang] * len(phrases), pa.large_string()), "phrase": pa.array(phrases, pa.large_string()),
                                  "count": np.ascontiguousarray(planes.T).view("<i8").reshape(-1)}))
            size += len(phrases)
            if size >= FOLD:
                summed, held, size = fold(), [], 0
        whole = fold()[0]
        spaces = pc.count_substring(whole["phrase"], " ").to_numpy()
        words = np.where(pc.equal(whole["phrase"], "").to_numpy(zero_copy_only=False), 0, spaces + 1).astype(np.int32)
        whole = whole.append_column("words", pa.array(words))
        whole = whole.filter(pc.or_(pc.equal(whole["words"], 0), pc.greater_equal(whole["count"], threshold)))
        return whole.select(["lang", "words", "phrase", "count"]).cast(pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("count", pa.int64())]))

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, part_mass: int = PART_MASS) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``count``: all phrases of up to ``longest`` words found at least ``threshold`` times in their language.

    A row with ``words`` 0 has the number of all words of the language.
    """
    if not 1 <= threshold < 2**16:
        raise ValueError("threshold must be from 1 to 65535")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''")
    blocks = materialize(texts.mapInArrow(_blocks_task, BLOCKS), "phrase-blocks")
    # An n-gram for each three bytes at most where words have two letters or more; more only makes a partition larger.
    size = blocks.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-longest * size // (6 * part_mass)))
    entries = blocks.mapInArrow(_entries_task(parts, longest, threshold), ENTRIES)
    survivors = entries.groupBy("part").applyInArrow(_survivors_task(threshold), ENTRIES)
    replies = survivors.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("survivors"))  # of one block's n-grams
    tallies = blocks.join(replies, "block", "left").select("lang", "body", "survivors").mapInArrow(_tally_task(parts, longest), TALLIES)
    return tallies.groupBy("part").applyInArrow(_sums_task(threshold), COUNTS)


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(18,0)")


def ranked(counts: DataFrame, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language, from what ``phrase_counts`` gives (read several times): ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words; the score is
    ``floor(1000000 a a / (l r))``. Phrases inside a longer one that has at least ``contained`` hundredths of their count are left out.
    """
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("count").alias("a"))
    known = counts.where("words >= 1").select("lang", "phrase", "count")
    parted = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    first = F.array_join(F.slice(F.split("phrase", " "), 1, F.col("cut")), " ")
    parted = parted.withColumn("left", first).withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    for side, name in (("left", "l"), ("right", "r")):
        parted = parted.join(known.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    parted = parted.withColumn("_num", F.lit(1000000).cast("decimal(7,0)") * _exact("a") * _exact("a")).withColumn("_den", _exact("l") * _exact("r"))
    lowest = F.min(F.struct(F.expr("_num div _den").alias("score"), "cut", "l", "r")).alias("low")
    scored = parted.groupBy("lang", "phrase", "a").agg(lowest)
    spans = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))")
    inner = phrases.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    free = scored.join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < contained * F.col("a")))
    rows = free.select("lang", "phrase", "a", "low.l", "low.r", "low.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("_salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "_salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("count").alias("n"))
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocations(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """The collocations of ``docs`` (``lang``, ``text``), as ``ranked`` gives them."""
    return ranked(materialize(phrase_counts(docs, longest, threshold), "phrase-counts"), contained, top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two or three words in the documents of each language."""
    return collocations(configure(spark).read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE_SQL = f"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, i, unnest([1, 2, 3]) AS k FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM piece)) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM grams WHERE k >= 2 AND f >= {THRESHOLD}),
parted AS (SELECT *, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate)),
cut AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, 1000000 * c.a::HUGEINT * c.a // (l.f::HUGEINT * r.f) AS score
  FROM parted c JOIN grams l ON l.lang = c.lang AND l.phrase = head JOIN grams r ON r.lang = c.lang AND r.phrase = tail),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_part AS (SELECT lang, array_to_string(ws[i : i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM candidate WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM low LEFT JOIN inner_part USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {CONTAINED} * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
