"""Near-duplicate classes by DartMinHash signatures and banded joining.

The weight of a shingle is how often its text holds it, and texts are alike if the sum of
the smaller weights is at least ``similarity`` times the sum of the larger ones (weighted
Jaccard; without repeated shingles this is the usual one). Every unit of weight of every
shingle is a region at which darts arrive over time at rate one, by hash: the k-th arrival
is the same for all texts that hold the region. A text watches until about k(ln k + 4)
darts have come, each dart names a coordinate, and the earliest per coordinate makes the
signature. Two signatures agree in a coordinate with a probability equal to the similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bandwalk.llm.components import components
from bandwalk.llm.texts import Words, mix, occurrences, shingles, slices
from bandwalk.session import settled, wide

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIDE = np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Near:
    """25 bands of 5 coordinates find a pair at similarity 0.8 but for 5 in 100,000."""

    words: int = 5
    similarity: float = 0.8
    coordinates: int = 128
    bands: int = 25
    rows: int = 5
    # pairs whose signatures agree less are not compared exactly (3.4 deviations below 0.8)
    plausible: float = 0.68
    # spanning forests of plausible pairs that a bucket hands to the exact comparison
    forests: int = 3
    # rows of a bucket compared at a time; larger buckets are dealt anew in every band
    block: int = 2048
    # rows and text bytes of a block in the exact comparison between classes; rows grow with large groups
    exact_rows: int = 256
    exact_bytes: int = 8 << 20


def signatures(text: np.ndarray, value: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """DartMinHash values (n_texts x k) of weighted sets given as (text, element) with repeats as weight.

    Rows of texts without elements are zero.
    """
    text, value, nth = occurrences(text, value)
    region = mix(value + nth.astype(np.uint64) * _SIDE)
    size = np.bincount(text, minlength=n_texts)
    best = np.full(n_texts * k, np.inf)
    out = np.zeros(n_texts * k, np.uint64)
    todo, darts = size > 0, k * (np.log(k) + 4)
    while todo.any():
        chosen = todo[text]
        owner, at = text[chosen], region[chosen]
        until = darts / np.maximum(size, 1)
        time = np.zeros(len(at))
        seed = at.copy()
        while len(at):
            seed = seed + _STEP
            dart = mix(seed)
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)
            hit = time <= until[owner]
            owner, at, seed, time, dart = owner[hit], at[hit], seed[hit], time[hit], dart[hit]
            name = mix(dart ^ _SIDE)
            slot = owner * k + (name % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, time)
            first = best[slot] == time
            out[slot[first]] = mix(name + _STEP)[first]
        # a coordinate that no dart named: watch twice as long (1 text in 60)
        todo = todo & np.isinf(best).reshape(n_texts, k).any(axis=1)
        darts *= 2
    return out.reshape(n_texts, k)


def sketched(docs: DataFrame, cfg: Near, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, bands, sketch): node is a 128-bit hash of the words, null if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, cfg.bands + 1, dtype=np.uint64))
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            n = part.num_rows
            hashes = words.hashes()
            text, value = shingles(words, cfg.words, hashes)
            sign = signatures(text, value, n, cfg.coordinates)
            keys = np.zeros((n, cfg.bands), np.uint64)
            for j in range(cfg.rows):
                keys = mix(keys + _STEP ^ sign[:, j : cfg.bands * cfg.rows : cfg.rows])
            keys = mix(keys ^ salt).view(np.int64)
            sketch = (sign & np.uint64(0xFF)).astype(np.uint8)
            has = words.count > 0
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(has * cfg.bands)]).astype(np.int32)), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), node_names(words, hashes), bands,
                 pa.array([s.tobytes() for s in sketch], pa.binary())],
                ["doc_id", "node", "bands", "sketch"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, node binary, bands array<bigint>, sketch binary")


def node_names(words: Words, hashes: np.ndarray) -> pa.Array:
    """A 128-bit hash of each text's words; null without words."""
    return pa.array([hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None
                     for a, b in zip(words.of, words.of[1:])], pa.binary())


def with_nodes(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) to (row, doc_id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), node_names(words, words.hashes())], ["row", "doc_id", "node"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, rows.select("row", "doc_id").schema.add("node", "binary"))


def forests(sketch: np.ndarray, plausible: float, rounds: int) -> list[tuple[int, int]]:
    """Edge-disjoint maximum spanning forests of a bucket, by share of agreeing coordinates (Prim).

    A forest links whatever the plausible pairs link, with fewer pairs than rows.
    """
    n = len(sketch)
    if n == 2:
        return [(0, 1)] if (sketch[0] == sketch[1]).mean() >= plausible else []
    used: list[set[int]] = [set() for _ in range(n)]
    out = []
    for _ in range(rounds):
        best, parent = np.full(n, -1.0), np.zeros(n, np.int64)
        outside = np.ones(n, bool)
        at, found = 0, False
        for _ in range(n):
            outside[at] = False
            near = (sketch == sketch[at]).mean(axis=1)
            if used[at]:
                near[list(used[at])] = -1
            better = outside & (near > best)
            best[better], parent[better] = near[better], at
            left = np.where(outside, best, -2.0)
            at = int(left.argmax())
            if left[at] >= plausible:
                a, b = int(parent[at]), at
                used[a].add(b)
                used[b].add(a)
                out.append((a, b))
                found = True
            elif left[at] == -2.0:
                break
        if not found:
            break
    return out


def plausible_pairs(nodes: DataFrame, cfg: Near) -> DataFrame:
    """Distinct (a, b), a < b, that share a band key and whose signatures agree enough.

    Rows of buckets of one are dropped before sketches travel. A bucket is compared in
    memory; one of more than ``block`` rows is dealt into groups at random, anew in each
    band. That is a first pass: ``open_pairs`` examines what the groups and forests leave.
    """
    spark = nodes.sparkSession
    keys = nodes.select("node", F.explode("bands").alias("key"))
    size = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    rows = (
        keys.join(size, "key")
        .join(nodes.select("node", "sketch"), "node")
        .withColumn("salt", F.expr(f"pmod(xxhash64(node, key), cast(ceil(size / {cfg.block}) as bigint))"))
        .select("key", "salt", "node", "sketch")
    )
    dealt = rows.repartition(wide(spark), "key", "salt").sortWithinPartitions("key", "salt", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(node: list[bytes], sketch: list[bytes]) -> list[tuple[bytes, bytes]]:
            if len(node) < 2:
                return []
            grid = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(node), -1)
            return [(node[min(e)], node[max(e)]) for e in forests(grid, cfg.plausible, cfg.forests)]

        group, node, sketch = None, [], []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            key = batch.column("key").to_pylist()
            salt = batch.column("salt").to_pylist()
            for k, s, v, x in zip(key, salt, batch.column("node").to_pylist(), batch.column("sketch").to_pylist()):
                if (k, s) != group:
                    found += pairs(node, sketch)
                    group, node, sketch = (k, s), [], []
                node.append(v)
                sketch.append(x)
            yield _pairs_batch(found)
        yield _pairs_batch(pairs(node, sketch))

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def open_pairs(nodes: DataFrame, classes: DataFrame, cfg: Near) -> DataFrame:
    """Distinct (a, b), plausible pairs of a bucket whose ends are in different classes: a spanning
    forest of all such pairs, per bucket. ``classes``: (node, component).

    Up to forests + 1 rows a bucket's forests hold all its plausible pairs, so only larger ones are read,
    or any that is dealt into groups. A bucket of more than ``block`` rows is cut into blocks,
    each pair of blocks in a task of its own: every pair of a bucket is examined, whatever its size.
    """
    spark = nodes.sparkSession
    placed = nodes.join(classes, "node", "left").select(
        "node", "bands", "sketch", F.coalesce("component", "node").alias("class"))
    keys = placed.select("node", "class", F.explode("bands").alias("key"))
    size = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high")).filter(
        (F.col("size") > min(cfg.forests + 1, cfg.block)) & (F.col("low") != F.col("high"))).select("key", "size")
    rows = (
        keys.join(size, "key")
        .withColumn("blocks", F.expr(f"cast(ceil(size / {cfg.block}) as bigint)"))
        .withColumn("own", F.expr("pmod(xxhash64(node, key), blocks)"))
        .join(placed.select("node", "sketch"), "node")
    )
    dealt = _block_pairs(rows, "key", "node", "class", "sketch").repartition(wide(spark), "key", "i", "j").sortWithinPartitions(
        "key", "i", "j", "own", "node")

    def found(rows: pa.Table) -> pa.RecordBatch:
        node, own = rows.column("node").to_pylist(), rows.column("own").to_numpy()
        label, grid = _labels(rows.column("class")), _grid(rows.column("sketch"))
        first, out = own == own[0], []
        across = not first.all()
        todo = np.ones(len(node), bool)
        for root in range(len(node)):
            queue = [root] if todo[root] else []
            todo[root] = False
            while queue:
                x = queue.pop()
                near = todo & (label != label[x]) & ((first != first[x]) if across else True)
                near[near] = (grid[near] == grid[x]).mean(axis=1) >= cfg.plausible
                todo &= ~near
                queue += (more := np.flatnonzero(near).tolist())
                out += [(min(node[x], node[y]), max(node[x], node[y])) for y in more]
        return _pairs_batch(out)

    return dealt.mapInArrow(_grouped(found, "key", "i", "j"), "a binary, b binary").distinct()


def _block_pairs(rows: DataFrame, group: str, *carried: str) -> DataFrame:
    """(group, i, j, own, ...): every row of a group with ``blocks`` blocks in each pair of blocks i <= j that holds its own."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return rows.withColumn("other", every).select(
        group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *carried)


def _grouped(found, *by: str):
    """For mapInArrow: calls ``found`` with the rows of each run of equal ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in by)))
            cuts = [0, *(n for n in range(1, len(names)) if names[n] != names[n - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if held and names[a] != last:
                    yield found(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = names[a]
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _grid(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def links_between(pairs: DataFrame, nodes: DataFrame, classes: DataFrame, texts: DataFrame, cfg: Near) -> DataFrame:
    """(a, b): classes that hold texts at or above the threshold, enough of them to join all such classes.

    ``pairs`` from ``open_pairs`` tie its nodes into groups. Within a group, all plausible pairs
    between classes are compared exactly, block against block, each pair of blocks in a
    task of its own. Only links that pass leave a task, fewer than it has rows.
    """
    spark = nodes.sparkSession
    grouped = components(pairs, "a", "b").withColumnRenamed("component", "grp")
    full = settled(
        grouped.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
        .join(nodes.select("node", "sketch"), "node").join(texts, "node")
    )
    size = full.groupBy("grp").agg(F.count("*").alias("size"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = (f"cast(greatest(least(ceil(size / {cfg.exact_rows}), 32), ceil(size / {16 * cfg.exact_rows}), "
              f"ceil(bytes / {cfg.exact_bytes})) as bigint)")
    rows = full.join(size, "grp").withColumn("blocks", F.expr(blocks)).withColumn("own", F.expr("pmod(xxhash64(node, grp), blocks)"))
    dealt = _block_pairs(rows, "grp", "node", "class", "sketch", "text").repartition(wide(spark), "grp", "i", "j").sortWithinPartitions(
        "grp", "i", "j", "own", "node")
    level = round(cfg.similarity * 1000)

    def found(rows: pa.Table) -> pa.RecordBatch:
        own, grid = rows.column("own").to_numpy(), _grid(rows.column("sketch"))
        name, label = rows.column("class").to_pylist(), _labels(rows.column("class")).copy()
        first, n, out = own == own[0], rows.num_rows, []
        across = not first.all()
        if rows.column("i")[0] != rows.column("j")[0] and not across:
            return _pairs_batch([])
        owner, region, at = [], [], 0
        for part in slices(iter(rows.select(["text"]).to_batches()), "text"):
            words = Words(part.column("text"))
            text, value, nth = occurrences(*shingles(words, cfg.words, words.hashes()))
            owner.append(text + at)
            region.append(mix(value + nth.astype(np.uint64) * _SIDE))
            at += part.num_rows
        owner, region = np.concatenate(owner), np.concatenate(region)
        order = np.argsort(owner, kind="stable")
        size = np.bincount(owner, minlength=n)
        kinds, region = np.unique(region[order], return_inverse=True)
        bound = np.concatenate([[0], np.cumsum(size)])
        present = np.zeros(len(kinds), bool)
        for x in np.flatnonzero(first) if across else range(n - 1):
            other = ~first if across else np.arange(n) > x
            near = other & (label != label[x]) & (1000 * np.minimum(size, size[x]) >= level * np.maximum(size, size[x]))
            near[near] = (grid[near] == grid[x]).mean(axis=1) >= cfg.plausible
            if not near.any():
                continue
            mine = region[bound[x] : bound[x + 1]]
            present[mine] = True
            hits = np.concatenate([[0], np.cumsum(present[region])])
            present[mine] = False
            common = hits[bound[1:]] - hits[bound[:-1]]
            near &= common * 1000 >= level * (size + size[x] - common)
            for y in np.flatnonzero(near):
                if label[y] != label[x]:
                    out.append((name[x], name[y]))
                    label[label == label[y]] = label[x]
        return _pairs_batch(out)

    return dealt.mapInArrow(_grouped(found, "grp", "i", "j"), "a binary, b binary").distinct()


def _pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, cfg: Near) -> DataFrame:
    """Pairs whose exact weighted Jaccard similarity reaches the threshold. ``texts``: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(iter([whole]), "text_a"):
                sides = []
                for side in ("text_a", "text_b"):
                    words = Words(part.column(side))
                    text, value = shingles(words, cfg.words, words.hashes())
                    text, value, nth = occurrences(text, value)
                    sides.append((text, mix(value + nth.astype(np.uint64) * _SIDE)))
                # regions of both sides: a pair's common regions occur twice
                text = np.concatenate([s[0] for s in sides])
                region = np.concatenate([s[1] for s in sides])
                _, _, nth = occurrences(text, region)
                owner = occurrences(text, region)[0]
                common = np.bincount(owner[nth == 1], minlength=part.num_rows)
                both = np.bincount(text, minlength=part.num_rows)
                # common / (both - common) >= similarity, in whole numbers of a thousandth
                level = round(cfg.similarity * 1000)
                keep = common * 1000 >= level * (both - common)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))], ["a", "b"])

    joined = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame, cfg: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, class_node, class_id) per row of ``docs``; rows of one class are alike, directly or in a chain.

    Texts with equal words fall together first, so signatures, buckets and comparisons are
    per distinct text. Buckets yield forests of plausible pairs, an exact comparison keeps
    those at or above the threshold, and connected components give the first classes. Plausible
    pairs of a bucket whose ends are still apart are then all compared exactly on the workers.

    ``class_id`` is the smallest id in the class (null if all are null). Texts without words
    (null, empty, blank) are alike to nothing: node and class_node are null, class_id is
    their own id. Texts of fewer than ``words`` words are one shingle. Repeated rows share a
    class. Long texts are read whole. Every input row gives one row, an empty table none; other
    columns are ignored.
    """
    sketches = settled(sketched(docs, cfg, id_col, text_col))
    nodes = settled(
        sketches.filter("node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    pairs = settled(plausible_pairs(nodes, cfg))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # a row with the text of each wanted node is found by the smallest id of the node
    holders = nodes.select("node", "doc_id").join(wanted, "node", "left_semi")
    texts = settled(_texts(docs, holders, cfg, id_col, text_col))
    links = settled(verified(pairs, texts, cfg))
    classes = settled(components(links, "a", "b"))
    rest = settled(open_pairs(nodes, classes, cfg))
    if not rest.isEmpty():
        ends = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        lacking = nodes.select("node", "doc_id").join(ends, "node", "left_semi").join(wanted, "node", "left_anti")
        if not lacking.isEmpty():
            texts = texts.unionByName(settled(_texts(docs, settled(lacking), cfg, id_col, text_col)))
        more = components(links_between(rest, nodes, classes, texts, cfg), "a", "b")
        classes = (
            nodes.select("node").join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("first"))
            .join(more.select(F.col("node").alias("first"), F.col("component").alias("last")), "first", "left")
            .select("node", F.coalesce("last", "first").alias("component"))
        )
    # everything about classes is settled per distinct text, so that copies, which may be many,
    # meet it in a single join that adaptive execution can split
    placed = nodes.select("node", F.col("doc_id").alias("least")).join(classes, "node", "left").withColumn(
        "class_node", F.coalesce("component", "node"))
    smallest = placed.groupBy("class_node").agg(F.min("least").alias("class_id"))
    named = settled(placed.select("node", "class_node").join(smallest, "class_node"))
    return (
        sketches.select("doc_id", "node")
        .join(named, "node", "left")
        .select("doc_id", "node", "class_node",
                F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    )


def _texts(docs: DataFrame, holders: DataFrame, cfg: Near, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes; the node is computed again, as ids may repeat or be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            yield pa.RecordBatch.from_arrays([node_names(words, words.hashes()), part.column("text")], ["node", "text"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = holders.select("doc_id").distinct()
    some = narrow.join(ids, narrow["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    hashed = some.mapInArrow(run, "node binary, text string")
    return hashed.join(holders.select("node"), "node", "left_semi").dropDuplicates(["node"])
