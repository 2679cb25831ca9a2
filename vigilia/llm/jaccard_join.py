"""N-gram Jaccard join with a size-aware split into light and heavy sets, and the components of its links.

A text is the set of its distinct five-word shingles, as 64-bit hashes; equal sets are one node. Two nodes link when their
Jaccard similarity is at least ``PERCENT`` percent, which for sizes a and b means ``need(a, b)`` common shingles or more.

*Light* sets (size up to a boundary) emit all their subsets of the sizes that ``need`` can take; two light sets link exactly
if they have a subset of that size in common. All sets that share a subset are linked to the smallest of them, which keeps
the components whole without emitting pairs.

*Heavy* sets are found by scanning inverted lists. Shingles are counted over all nodes: those of one node cannot be shared and
need no list. The others are ordered from rare to frequent, and only so many of a set's rarest are listed as any partner has to
meet. In a list every set is first compared with one hub, the set with the fewest unshared shingles; then sets that did not
join the same hub are paired, if size and position in the list leave room for ``need``. Candidates are verified with their
whole sets. No list is cut, whatever its length.

The boundary is the one with the least estimated cost, subsets against list entries, for the sizes seen in a sample. The
sample also names up to ``HOT`` very frequent shingles, which are ordered last without being counted, so that a passage which
a third of all documents share is no task's burden. Both choices change the cost only, never the links.

Shingles travel packed: a task sends each bucket of hashes one binary block a slice, and gets back blocks of shared shingles
for each range of nodes. Hashes, not texts, are compared; two shingles or sets with equal 64-bit hashes count as equal.

Texts without words have no shingles and link with nothing; fewer than five words make one shingle. Rows without ``doc_id``
take part, but name no component: theirs is null unless they link with a row that has an id. Repeated rows link with each
other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import configure, materialize
from .components import components
from .textvec import STEP, hashes, mixed, slices, windows, words

WORDS, PERCENT = 5, 80
SAMPLE, HOT, HOT_DOCS, HOT_SHARE, LONGEST_LIGHT = 64, 4096, 8, 256, 14
#: Cost of a subset row, an exchanged shingle and a list entry, in rows.
SUBSET_COST, SHINGLE_COST, ENTRY_COST = 1.0, 0.15, 2.0
MOST_SEEN = 65_535


def need(a: int, b: int) -> int:
    """Common shingles that sets of sizes ``a`` and ``b`` must have: the least x with ``100 x >= PERCENT (a + b - x)``."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def least_need(n):
    """The least ``need`` with any partner: one of ``PERCENT`` percent of the size."""
    return -(-PERCENT * n // 100)


def _need_column(a, b):
    return F.ceil((F.lit(PERCENT) * (a + b)) / F.lit(100 + PERCENT) - F.lit(1e-9))


# -- sets ---------------------------------------------------------------------------------------------------------------------


class Sets:
    """The shingle sets of one slice: sorted distinct hashes of each text, one after the other."""

    def __init__(self, texts: pa.Array, k: int = WORDS) -> None:
        word = words(texts, lower=True)
        hashed, bounds, count = hashes(word), word.bounds(), word.per_text()
        found, first = windows(hashed, bounds, k)
        owner = word.text[first]
        few = np.flatnonzero((count > 0) & (count < k))
        whole = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            there = count[few] > j
            whole[there] = whole[there] * STEP + hashed[bounds[few[there]] + j]
        found = np.concatenate([found, mixed(whole ^ count[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = found[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(texts))
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        total = np.zeros(len(texts), np.uint64)
        np.add.at(total, self.owner, mixed(self.hashes ^ STEP))
        self.node = mixed(total + self.size.astype(np.uint64) * STEP).view(np.int64)


def _set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        sets = Sets(texts)
        node = pa.array(sets.node, mask=sets.size == 0)
        small = [sets.hashes[a:b].view(np.int64) if b - a <= LONGEST_LIGHT else None for a, b in zip(sets.bounds, sets.bounds[1:])]
        columns = [rows.column("doc_id"), rows.column("text_hash"), pa.array(sets.size.astype(np.int64)), node, pa.array(small, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["doc_id", "text_hash", "n_shingles", "node", "small"])


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text, the size of the set, its node (null if empty) and, of sets that may be light, the shingles; for every row."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _set_task, "doc_id long, text_hash long, n_shingles long, node long, small array<long>")


# -- choices made on a sample ---------------------------------------------------------------------------------------------------


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        values, count = np.unique(Sets(texts).hashes, return_counts=True)
        yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(count)], ["h", "n"])


def hot_shingles(docs: DataFrame, rows: int) -> np.ndarray:
    """Shingles in more than one of ``HOT_SHARE`` documents of the sample, the most frequent ``HOT`` of them."""
    sampled = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    seen = sampled.mapInArrow(_sample_task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(HOT_DOCS, rows // SAMPLE // HOT_SHARE)
    top = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(HOT).collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a light set of ``n`` shingles emits: ``need`` with each light partner it could link with."""
    return sorted({c for m in range(1, boundary + 1) if (c := need(n, m)) <= min(n, m)})


def choose_boundary(count_by_size: dict[int, int]) -> int:
    """The light sizes with the least total cost."""

    def cost(boundary: int) -> float:
        light = sum(n * sum(comb(s, c) for c in subset_sizes(s, boundary)) for s, n in count_by_size.items() if s <= boundary)
        heavy = sum(n * (SHINGLE_COST * s + ENTRY_COST * (s - least_need(s) + 1)) for s, n in count_by_size.items() if s >= least_need(boundary + 1))
        return SUBSET_COST * light + heavy

    return min(range(LONGEST_LIGHT + 1), key=cost)


# -- light sets -----------------------------------------------------------------------------------------------------------------


def _subset_task(boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, own in zip(batch.column("node").to_pylist(), batch.column("small").to_pylist()):
                own, n = np.array(own, np.int64).view(np.uint64), len(own)
                for c in subset_sizes(n, boundary):
                    subsets = np.array(list(combinations(range(n), c)))
                    key = np.zeros(len(subsets), np.uint64)
                    for j in range(c):
                        key = key * STEP + own[subsets[:, j]]
                    out += [(c, k, n, node) for k in mixed(key).view(np.int64).tolist()]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["c", "subset", "n", "node"])

    return run


def light_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links between sets of up to ``boundary`` shingles, each with the smallest set that has the subset too."""
    once = sets.where(F.col("n_shingles").between(1, boundary)).select("node", "small").dropDuplicates(["node"])
    rows = once.mapInArrow(_subset_task(boundary), "c long, subset long, n long, node long")
    least = rows.groupBy("c", "subset").agg(F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("sets")).where("sets > 1")
    met = rows.join(least, ["c", "subset"]).where(F.col("node") != F.col("hub.node"))
    return met.where(_need_column(F.col("n"), F.col("hub.n")) <= F.col("c")).select(F.col("node").alias("u"), F.col("hub.node").alias("v"))


# -- heavy sets -----------------------------------------------------------------------------------------------------------------

BLOCK = "part int, nodes binary, sizes binary, counts binary, hashes binary, seen binary"


def _blocks(part: np.ndarray, node: np.ndarray, size: np.ndarray, hashed: np.ndarray, seen: np.ndarray | None) -> Iterator[tuple]:
    """One block for each part: its hashes ordered by node, with the nodes, their sizes and their counts of hashes."""
    order = np.lexsort((node, part))
    part, node, size, hashed = part[order], node[order], size[order], hashed[order]
    seen = None if seen is None else seen[order]
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, len(part)]):
        if a < b:
            new = np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))
            counts = np.diff(np.concatenate([new, [b - a]])).astype("<u4")
            yield (int(part[a]), node[a:b][new].astype("<i8").tobytes(), size[a:b][new].astype("<u4").tobytes(), counts.tobytes(),
                   hashed[a:b].astype("<u8").tobytes(), b"" if seen is None else seen[a:b].astype("<u2").tobytes())


def _block_batch(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*blocks)) if blocks else [[]] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "nodes", "sizes", "counts", "hashes", "seen"])


class Gathered:
    """All blocks that came to a task: each node once, with its hashes."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        read: dict[str, list[np.ndarray]] = {c: [np.zeros(0, k)] for c, k in (("nodes", "<i8"), ("sizes", "<u4"), ("counts", "<u4"), ("hashes", "<u8"), ("seen", "<u2"))}
        for batch in batches:
            for name, parts in read.items():
                parts += [np.frombuffer(b, parts[0].dtype) for b in batch.column(name).to_pylist()]
        self.nodes, self.sizes, self.counts, self.hashes, self.seen = (np.concatenate(p) for p in read.values())

    def once(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, size and hash of every entry, of one block for each node: equal sets sent equal entries."""
        first = np.zeros(len(self.nodes), bool)
        first[np.unique(self.nodes, return_index=True)[1]] = True
        entry = np.repeat(first, self.counts)
        return np.repeat(self.nodes, self.counts)[entry], np.repeat(self.sizes, self.counts)[entry], self.hashes[entry]


def _scatter_task(parts: int, hot: np.ndarray, smallest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            sets = Sets(texts)
            once = np.zeros(len(sets.size), bool)
            once[np.unique(sets.node, return_index=True)[1]] = True
            entry = (once & (sets.size >= smallest))[sets.owner]
            hashed, owner = sets.hashes[entry], sets.owner[entry]
            node = sets.node[owner]
            # A frequent shingle is not counted, so its entries go wherever their nodes do.
            by = np.where(np.isin(hashed, hot), mixed(node.view(np.uint64)), hashed)
            part = ((by >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            yield _block_batch(list(_blocks(part, node, sets.size[owner], hashed, None)))

    return run


def _count_task(parts: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, size, hashed = Gathered(batches).once()
        if not len(node):
            return
        order = np.argsort(hashed, kind="stable")
        ordered = hashed[order]
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        seen = np.empty(len(hashed), np.int64)
        seen[order] = np.repeat(np.diff(np.concatenate([begin, [len(ordered)]])), np.diff(np.concatenate([begin, [len(ordered)]])))
        seen = np.minimum(seen, MOST_SEEN - 1)
        seen[np.isin(hashed, hot)] = MOST_SEEN
        shared = seen > 1
        node, size, hashed, seen = node[shared], size[shared], hashed[shared], seen[shared]
        part = (mixed(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        blocks = list(_blocks(part, node, size, hashed, seen))
        for at in range(0, len(blocks), 64):
            yield _block_batch(blocks[at : at + 64])

    return run


def _order_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's shared shingles from rare to frequent, if they are enough to link with anything."""
    got = Gathered(batches)
    node, size = np.repeat(got.nodes, got.counts), np.repeat(got.sizes, got.counts).astype(np.int64)
    order = np.lexsort((got.hashes, got.seen, node))
    node, size, hashed = node[order], size[order], got.hashes[order]
    if not len(node):
        return
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    end = np.concatenate([begin[1:], [len(node)]])
    enough = np.flatnonzero(end - begin >= least_need(size[begin]))
    for at in range(0, len(enough), 2000):
        some = enough[at : at + 2000]
        counts = end[some] - begin[some]
        flat = np.concatenate([hashed[a:b] for a, b in zip(begin[some], end[some])]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
        yield pa.record_batch([pa.array(node[begin[some]]), pa.array(size[begin[some]]), lists], ["node", "n", "shared"])


def shared_shingles(docs: DataFrame, parts: int, hot: np.ndarray, smallest: int) -> DataFrame:
    """``node``, size ``n`` and its ``shared`` shingles in list order, of the nodes that could link with another."""
    sent = docs.select("text").mapInArrow(_scatter_task(parts, hot, smallest), BLOCK).repartitionById(parts, "part")
    counted = sent.mapInArrow(_count_task(parts, hot), BLOCK).repartitionById(parts, "part")
    return counted.mapInArrow(_order_task, "node long, n long, shared array<long>")


def _fits(a: str, b: str):
    """Whether two entries of a list leave room for enough common shingles; ``rest``: a set's shingles from the entry on."""
    left, right = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _need_column(left, right) <= F.least(f"{a}.rest", f"{b}.rest")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("shared").alias("shared_u"))
    two = sets.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("shared").alias("shared_v"))
    both = pairs.join(one, "u").join(two, "v")
    common = F.size(F.array_intersect("shared_u", "shared_v"))
    return both.where(F.lit(100) * common >= F.lit(PERCENT) * (F.col("n_u") + F.col("n_v") - common)).select("u", "v")


def heavy_links(sets: DataFrame) -> DataFrame:
    """Links found by scanning the inverted lists of ``sets`` (stored: ``node``, ``n``, ``shared``)."""
    listed = F.slice("shared", F.lit(1), F.size("shared") - F.ceil(F.lit(PERCENT / 100) * F.col("n") - F.lit(1e-9)).cast("int") + 1)
    score = (F.size("shared") / F.col("n")).alias("score")
    entries = sets.select("node", "n", score, F.size("shared").alias("e"), F.posexplode(listed).alias("k", "h"))
    entries = entries.select("h", "node", "n", "score", (F.col("e") - F.col("k")).alias("rest"))
    # One hub a list, found by partial aggregation; a list of one entry links nothing.
    lists = entries.groupBy("h").agg(F.max(F.struct("score", "node", "n", "rest")).alias("hub"), F.count("*").alias("sets")).where("sets > 1")
    entries = materialize(entries.join(lists, "h").select("h", "node", "n", "rest", "score", "hub"), "list-entries")
    toward = entries.where((F.col("node") != F.col("hub.node"))).where(
        _need_column(F.col("n"), F.col("hub.n")) <= F.least("rest", "hub.rest"))
    stars = materialize(_verified(toward.select(F.col("node").alias("u"), F.col("hub.node").alias("v"), "hub.score").distinct().select("u", "v"), sets), "hub-links")
    # Sets that joined the same hub, or are the hub, need no further comparison.
    scores = sets.select(F.col("node").alias("v"), score)
    joined = stars.join(scores, "v").groupBy(F.col("u").alias("node")).agg(F.max(F.struct("score", "v")).alias("best"))
    hub = F.coalesce(F.col("best.v"), F.col("node")).alias("hub")
    rows = entries.drop("hub").join(joined, "node", "left").select("h", "node", "n", "rest", hub)
    a, b = rows.alias("a"), rows.alias("b")
    across = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.hub") != F.col("b.hub")) & _fits("a", "b"))
    pairs = across.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    return stars.unionByName(_verified(pairs, sets))


# -- the whole job --------------------------------------------------------------------------------------------------------------


def component_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles`` and ``root`` (a node that names the component; null without shingles) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = materialize(shingle_sets(docs), "shingle-sets")
    sizes = sets.groupBy(F.least("n_shingles", F.lit(4 * LONGEST_LIGHT)).alias("n")).agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("all")).collect()
    boundary = choose_boundary({r["n"]: r["rows"] for r in sizes if r["n"]})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["all"] for r in sizes) // 4_000_000)
    hot = hot_shingles(docs, sum(r["rows"] for r in sizes))
    heavy = materialize(shared_shingles(docs, parts, hot, least_need(boundary + 1)), "shared-shingles")
    links = heavy_links(heavy)
    if boundary:
        links = links.unionByName(light_links(sets, boundary))
    roots = components(links)
    return sets.drop("small").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest ``doc_id`` reachable by links) of every row of ``docs`` (``doc_id``, ``text``)."""
    rows = component_rows(docs)
    # Stored, so that the join below deals its rows out anew and a component of many rows can be split.
    first = materialize(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least_id")), "component-ids")
    return rows.join(first, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all columns, and every row that links with nothing.

    The row that stays has the smallest ``doc_id`` (none comes last), then the smallest hash of its text; where rows are equal in
    both, one of them, by a hash of all columns. The choice is a minimum per component, which partial aggregation finds; rows that go are
    named by ``doc_id`` and hash of the text, and only rows equal to one that stays are ranked, a row a task and key.
    """
    rows = component_rows(docs).where("root IS NOT NULL").select("root", "doc_id", "text_hash")
    counted = materialize(rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies")), "component-rows")
    chosen = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best")
    best = materialize(counted.groupBy("root").agg(chosen, F.sum("copies").alias("rows")).where("rows > 1"), "component-choices")
    ranked = counted.join(best, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    gone_id, gone_hash, own_hash, place = (_free(n, docs.columns) for n in ("_gone_id", "_gone_hash", "_text_hash", "_place"))
    named = [F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)]
    gone = materialize(ranked.where(~stays).select(*named), "component-gone")
    again = materialize(ranked.where(stays & (F.col("copies") > 1)).select(*named), "component-copies")
    hashed = docs.withColumn(own_hash, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own_hash) == F.col(gone_hash))
    left = hashed.join(gone, same, "left_anti")
    first = Window.partitionBy("doc_id", own_hash).orderBy(F.xxhash64(*docs.columns))
    one = left.join(again, same, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return left.join(again, same, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard_components(configure(spark).read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
placed AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {WORDS - 1}, 1))) AS i FROM texts WHERE len(ws) > 0),
shingle AS (SELECT DISTINCT doc_id, ws[i:i + {WORDS - 1}] AS s FROM placed),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM texts UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN size z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""
