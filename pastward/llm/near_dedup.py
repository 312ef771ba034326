"""Groups of near-duplicate texts by one-permutation hashing.

A text's set of word shingles is hashed once; its ``BINS`` bins keep the smallest hash that falls into each, and an empty
bin takes the value of a filled one that the bin's own random order names first (optimal densification), so that two sets
agree in a bin with the probability of their similarity. Runs of bins are the buckets: the longest runs by which a pair
right at the limit is missed with a probability of ``MISS`` at most.

Texts with equal sets are one node. In a bucket nodes are compared with a centre, so candidate edges form stars. A bucket
whose nodes are not yet in one component goes on with further centres, the best linked node first, then more each round,
until every node of it is linked or has been a centre; so no link between two nodes of a bucket is lost, and no size is
capped. A candidate becomes a row only if a bound allows the link: a set's bit map flips one bit for each shingle, so two
maps differ in at most as many bits as the sets in shingles. What is left is confirmed on the full sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm import wordhash as wh
from pastward.llm.components import connected
from pastward.llm.work import Work, text_mark

WIDTH = 5
BINS = 320
MISS = 1e-6
FEW = 48
MAP_WORDS = 8  # of 64 bits
FASTER = 64  # times as many centres each round
MAP = [f"map{k}" for k in range(MAP_WORDS)]


def shingle_sets(words: wh.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within each, and where each text's begin.

    A text of fewer words than ``width`` has its whole sequence as its only shingle.
    """
    hashes = wh.word_hashes(words, 11)
    windows = wh.window_hashes(hashes, width, 12)[ok := wh.inside_texts(words, width)]
    text = words.text_of()[: len(ok)][ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = [wh.window_hashes(hashes[words.first[i] : words.first[i + 1]], int(words.counts[i]), 12)[0] for i in short]
        windows, text = np.concatenate([windows, np.array(whole, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((windows, text))
    windows, text = windows[order], text[order]
    if len(windows):
        new = np.concatenate([[True], (windows[1:] != windows[:-1]) | (text[1:] != text[:-1])])
        windows, text = windows[new], text[new]
    return windows, np.searchsorted(text, np.arange(len(words.counts) + 1))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of ``BINS`` values for each text; a text without shingles has zeros."""
    texts = len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    # the high part of a hash names its bin and the whole its rank, so a text's sorted hashes begin a bin with its smallest
    bins = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    cell = text * BINS + bins
    out, filled = np.zeros(texts * BINS, np.uint64), np.zeros(texts * BINS, bool)
    if len(cell):
        begin = np.concatenate([[True], cell[1:] != cell[:-1]])
        out[cell[begin]], filled[cell[begin]] = values[begin], True
    out, filled = out.reshape(texts, BINS), filled.reshape(texts, BINS)
    count = filled.sum(1)
    for i in np.flatnonzero((count > 0) & (count <= FEW)):  # many of the asked bins are empty: ask the filled ones alone
        own, empty = np.flatnonzero(filled[i]), np.flatnonzero(~filled[i])
        out[i, empty] = out[i, own[np.argmin(_turns()[np.ix_(own, empty)], axis=0)]]
    row, at = np.nonzero(~filled & (count > FEW)[:, None])
    for asked in _orders():
        if not len(row):
            break
        donor = asked[at]
        hit = filled[row, donor]
        out[row[hit], at[hit]] = out[row[hit], donor[hit]]
        row, at = row[~hit], at[~hit]
    return out


def rows_of_bucket(percent: int) -> int:
    """The most bins in a bucket for which a pair at ``percent`` shares no bucket with probability ``MISS`` at most."""
    alike = percent / 100
    return next((r for r in range(16, 1, -1) if (1 - alike**r) ** (BINS // r) <= MISS), 1)


_known: dict[str, np.ndarray] = {}


def _turns() -> np.ndarray:
    """For donor d and bin b, when b asks d: a random order of all donors for each bin."""
    if "turns" not in _known:
        _known["turns"] = np.argsort(np.argsort(wh.seeded(BINS * BINS, 13).reshape(BINS, BINS), axis=0), axis=0)
    return _known["turns"]


def _orders() -> np.ndarray:
    """The donors of each bin in the order in which it asks them."""
    if "orders" not in _known:
        _known["orders"] = np.argsort(_turns(), axis=0)
    return _known["orders"]


def bucket_ids(signature: np.ndarray, rows: int) -> np.ndarray:
    """The bucket ids of each text, one for each run of ``rows`` bins."""
    bands = BINS // rows
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    return wh.mix((wh.mix(parts) * (wh.seeded(rows, 14) | np.uint64(1))).sum(axis=2, dtype=np.uint64) + wh.seeded(bands, 15))


def _sketch_rows(width: int, percent: int):
    in_bucket = rows_of_bucket(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in wh.chunks(batches):
            values, first = shingle_sets(wh.split_words(data, offsets, lower=True), width)
            size = np.diff(first)
            sums = []
            for seed in (16, 17):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wh.mix(values ^ wh.seeded(1, seed)), dtype=np.uint64)])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            buckets = bucket_ids(signatures(values, first), in_bucket).view(np.int64)
            bit = wh.mix(values ^ wh.seeded(1, 18)) % np.uint64(64 * MAP_WORDS)
            cell = np.repeat(np.arange(len(size)), size) * MAP_WORDS + (bit >> np.uint64(6)).astype(np.int64)
            maps = np.zeros(len(size) * MAP_WORDS, np.uint64)
            np.bitwise_xor.at(maps, cell, np.uint64(1) << (bit & np.uint64(63)))
            maps = maps.view(np.int64).reshape(-1, MAP_WORDS)
            kept = size > 0
            offsets_out = np.concatenate([[0], np.cumsum(np.where(kept, buckets.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"),
                    "mark": rows.column("mark"),
                    "n_shingles": pa.array(size, pa.int64()),
                    "print1": pa.array(sums[0]),
                    "print2": pa.array(sums[1]),
                    **{name: pa.array(np.ascontiguousarray(maps[:, k])) for k, name in enumerate(MAP)},
                    "buckets": pa.ListArray.from_arrays(pa.array(offsets_out), pa.array(buckets[kept].reshape(-1))),
                }
            )

    return run


def _compare_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets(node: pa.Array, column: pa.Array) -> list[np.ndarray]:
            ids, out = node.to_pylist(), []
            for at, i in enumerate(ids):
                if i not in known:
                    data, offsets = wh.text_buffers(column.slice(at, 1))
                    known[i] = shingle_sets(wh.split_words(data, offsets, lower=True), width)[0]
                known.move_to_end(i)
                out.append(known[i])
                while len(known) > 64:
                    known.popitem(last=False)
            return out

        for batch in batches:
            for rows in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                linked = []
                for x, y in zip(sets(rows.column("a"), rows.column("text_a")), sets(rows.column("b"), rows.column("text_b"))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                keep = pa.array(linked)
                yield pa.RecordBatch.from_arrays([rows.column("a").filter(keep), rows.column("b").filter(keep)], ["a", "b"])

    return run


def _confirmed(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""

    def of(side: str) -> DataFrame:
        return texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_compare_rows(width, percent), "a long, b long")


def _possible(percent: int) -> Column:
    """Whether the maps and sizes of a node and a centre allow a link: their sets differ in ``apart`` shingles at least."""
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"c_{m}"))) for m in MAP), F.lit(0))
    apart = F.greatest(apart, F.abs(F.col("n_shingles") - F.col("c_n_shingles")))
    total = F.col("n_shingles") + F.col("c_n_shingles")
    return (total - apart) * (100 + percent) >= 2 * percent * total


def _merged(work: Work, roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links (a, b); only the roots that the links join are contracted."""
    if roots is None:
        return connected(work, links)

    def at(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    edges = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    moved = connected(work, edges.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = moved.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return work.put(known.union(new))


def _links(work: Work, texts: DataFrame, info: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, root) of the nodes that confirmed links connect, among those of ``members`` (bucket, node); None without any.

    ``info`` has n_shingles and the map of each node, ``texts`` a text.
    """
    step, left = 0, members.withColumn("used", F.lit(False))
    tested = found = roots = past = None
    while True:
        state = left.withColumn("root", F.col("node")).withColumn("links", F.lit(0).cast("long"))
        if found is not None:
            degree = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
            state = left.join(roots, "node", "left").join(degree, "node", "left")
            state = state.select("bucket", "node", "used", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("links"))
        free = ~F.col("used")
        buckets = state.groupBy("bucket").agg(
            F.count("*").alias("n"),
            F.sum(free.cast("long")).alias("free"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.max(F.when(free, F.struct("links", (-F.col("node")).alias("less")))).alias("best"),
        )
        # the last free node has met all others of its bucket
        open_ = buckets.where("low != high and free > 1").select("bucket", "n", (-F.col("best.less")).alias("best"))
        # beside the best, a node is a centre with this share of the bucket's, so all are in the end
        share = FASTER**step if step else 0
        drawn = F.xxhash64(F.lit(step), "node").bitwiseAND(F.lit((1 << 40) - 1)).cast("double") * F.col("n")
        chosen = free & ((F.col("node") == F.col("best")) | (drawn < float(share << 40)))
        now = state.join(open_, "bucket").withColumn("centre", chosen).join(info, "node")
        now = work.put(now.select("bucket", "node", (F.col("used") | F.col("centre")).alias("used"), "centre", "root", "n_shingles", *MAP))
        work.drop(past)
        if now.isEmpty():
            work.drop(now)
            return roots
        centres = now.where("centre").select(*[F.col(c).alias(f"c_{c}") for c in now.columns])
        meet = (F.col("bucket") == F.col("c_bucket")) & (F.col("root") != F.col("c_root")) & _possible(percent)
        pairs = now.join(centres, meet)
        pairs = pairs.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()
        pairs = work.put(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        links = work.put(_confirmed(texts, pairs, width, percent))
        tested = pairs if tested is None else tested.union(pairs)
        if not links.isEmpty():
            roots = _merged(work, roots, links)
            found = links if found is None else found.union(links)
        left, past = now.select("bucket", "node", "used").distinct(), now
        step += 1


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """Groups of texts linked by ``100 * common shingles >= percent * all shingles``, links chained.

    Words are runs without white space, A-Z in lower case; shingles are ``width`` words. Returns doc_id, mark (which tells
    apart different texts with one id), n_shingles, component_id (the smallest id reachable) and kept (this is that id);
    one row for each row of ``docs``. A null or empty text has no shingles and is linked with nothing. Rows without an id
    take part; a group of such rows alone has a null component, and its rows are kept. Rows that share an id count as one
    document. Other columns are not read.
    """
    work = Work(docs.sparkSession)
    texts = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), "text")
    kind = "doc_id long, mark int, n_shingles long, print1 long, print2 long, " + "".join(f"{m} long, " for m in MAP) + "buckets array<long>"
    sketches = work.put(texts.mapInArrow(_sketch_rows(width, percent), kind))
    keys = ["print1", "print2", "n_shingles"]
    sets = sketches.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("least"))
    nodes = work.put(sets.withColumn("node", F.coalesce("least", F.xxhash64("print1", "print2"))))

    own = [sketches[k] == nodes[k] for k in keys] + [sketches["doc_id"].eqNullSafe(nodes["least"])]
    firsts = sketches.join(nodes, own).select(nodes["node"], sketches["doc_id"], sketches["mark"], nodes["print1"], nodes["print2"], sketches["n_shingles"], *MAP, "buckets")
    firsts = work.put(firsts.dropDuplicates(["node", "print1", "print2"]))
    spread = firsts.select("node", F.explode("buckets").alias("bucket")).distinct()
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = work.put(spread.join(shared, "bucket"))
    asked = firsts.join(members.select("node").distinct(), "node")
    asked = asked.select("node", F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"))
    match = texts["doc_id"].eqNullSafe(asked["of_id"]) & (texts["mark"] == asked["of_mark"])
    # rows may be repeated: each text of a node is compared once
    asked_texts = work.put(texts.join(asked, match).select("node", "mark", "text").dropDuplicates(["node", "mark"]).select("node", "text"))
    info = firsts.select("node", "n_shingles", *MAP)
    roots = _links(work, asked_texts, info, members, width, percent)
    work.drop(firsts, members)
    work.drop(asked_texts)

    groups = nodes.withColumn("root", F.col("node")) if roots is None else nodes.join(roots, "node", "left")
    groups = groups.withColumn("root", F.coalesce("root", "node"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = work.put(groups.join(least, "root").select(*keys, "component_id"))
    work.drop(nodes, roots)
    out = sketches.select("doc_id", "mark", *keys).join(placed, keys, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "mark", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id; all columns are carried, whatever their names.

    Repeated rows (same id and text) stay once. Texts without words are never duplicates of each other.
    """
    keys = ["id", "no_id", "mark"]

    def keyed(df: DataFrame, mark, *more) -> DataFrame:
        return df.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), mark.alias("mark"), *more)

    rows = keyed(docs, text_mark(F.col("text")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = keyed(near_duplicates(docs, percent=percent).where("kept"), F.col("mark")).distinct()
    return rows.join(kept, keys).dropDuplicates(keys).select("row.*")


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, x
  FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common.n >= 85 * (s.n + t.n - common.n)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""
