"""Near-duplicates by 64-bit SimHash fingerprints and anchor points.

Anchors are the codewords of a covering code: two binary Golay codes of length 23 over bits
0-22 and 23-45. The Golay code is perfect, so every 23-bit word has one codeword within 3
bits, its home. If two fingerprints differ in d bits of a half, the one lies within 3 + d of
the other's home there. So every fingerprint goes to its home anchor and to all anchors
within 3 bits of each half plus ``threshold`` bits shared out over the halves (62 of 2^24 on average
for a threshold of 2), and pairs are compared per anchor, homes against visitors: no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from bandwalk.llm.components import components
from bandwalk.llm.texts import raw, slices
from bandwalk.session import settled, wide

HALF = 23
RADIUS = 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BLOCK = 1024  # homes or visitors of an anchor compared at a time
# one hexadecimal digit as four 16-bit lanes, one per bit
LANES = np.array([sum((d >> b & 1) << (16 * b) for b in range(4)) for d in range(16)], np.uint64)
LANE_LIMIT = 60_000  # hashes that a lane can count


def fingerprint_values(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each run hashes[bounds[i]:bounds[i + 1]]: the bits set in over half of it; 0 for an empty run."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    # runs longer than a lane counts are summed in parts
    pieces = np.maximum(-(-size // LANE_LIMIT), 0)
    owner = np.repeat(np.arange(n), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = bounds[:-1][owner] + nth * LANE_LIMIT
    first = np.flatnonzero(nth == 0)
    some = owner[first]
    for digit in range(16):
        lanes = np.add.reduceat(LANES[(hashes >> np.uint64(4 * digit)) & np.uint64(15)], starts)
        for bit in range(4):
            ones = np.add.reduceat(((lanes >> np.uint64(16 * bit)) & np.uint64(0xFFFF)).astype(np.int64), first)
            out[some] |= (2 * ones > size[some]).astype(np.uint64) << np.uint64(4 * digit + bit)
    return out


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of ``words`` words joined by spaces, or of all words if there are fewer."""
    parts = text.split()
    if not parts:
        return []
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, seed)]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size)
    starts, ends = (end - size)[: len(parts) - words + 1].tolist(), (end - 1)[words - 1 :].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends)]


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row: A-Z lower-cased, shingles of ``words`` words with repeats; no words give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, bounds = raw(pc.ascii_lower(part.column("text")))
            whole = data.tobytes()
            hashes = [np.array(shingle_hashes(whole[a:b], words, seed), np.uint64)
                      for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            value = fingerprint_values(np.concatenate(hashes), np.cumsum([0, *map(len, hashes)]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def syndromes(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    word = word.copy()
    for bit in range(HALF - 1, HALF - 13, -1):
        word ^= ((word >> bit) & 1) * (GENERATOR << (bit - 11))
    return word


@lru_cache(maxsize=4)
def patterns(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(errors, upto): error patterns of at most RADIUS + threshold bits ordered by syndrome and excess.

    The excess of a pattern is its bits above RADIUS. Patterns of syndrome s with excess at
    most e are errors[upto[s, 0]:upto[s, e + 1]]; xor with any of them leads to a codeword.
    """
    made = [(sum(1 << b for b in bits), max(0, n - RADIUS))
            for n in range(RADIUS + threshold + 1) for bits in combinations(range(HALF), n)]
    error, excess = np.array([m[0] for m in made], np.int64), np.array([m[1] for m in made], np.int64)
    key = syndromes(error) * (threshold + 1) + excess
    order = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(2048 * (threshold + 1) + 1))
    upto = np.column_stack([cuts[: -1 : threshold + 1], *(cuts[e + 1 :: threshold + 1] for e in range(threshold + 1))])
    return error[order], upto


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every index in starts[i] to ends[i]."""
    size = ends - starts
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) + np.repeat(starts - (np.cumsum(size) - size), size)


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home): all anchors of each fingerprint and whether it is at home there."""
    mask = (1 << HALF) - 1
    low, high = fp & mask, (fp >> HALF) & mask
    errors, upto = patterns(threshold)
    s_low, s_high = syndromes(low), syndromes(high)
    row, at = _spread(upto[s_low, 0], upto[s_low, -1])
    excess = np.zeros(len(at), np.int64)
    for e in range(1, threshold + 1):
        excess += at >= upto[s_low[row], e]
    pair, other = _spread(upto[s_high[row], 0], upto[s_high[row], threshold + 1 - excess])
    home = (excess[pair] == 0) & (other < upto[s_high[row[pair]], 1])
    row, at = row[pair], at[pair]
    return row, ((high[row] ^ errors[other]) << HALF) | (low[row] ^ errors[at]), home


def visits(nodes: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp, home): every fingerprint at each of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for a in range(0, len(fp), 10_000):
                part = fp[a : a + 10_000]
                row, anchor, home = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], ["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def forest(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links at ``threshold`` or fewer bits that join whatever all such links between the two sides join."""
    # unsigned: numpy counts the bits of a negative number's absolute value
    near = np.bitwise_count(homes.view(np.uint64)[:, None] ^ visitors.view(np.uint64)[None, :]) <= threshold
    open_home, open_visitor = np.ones(len(homes), bool), np.ones(len(visitors), bool)
    out = []
    for root in range(len(homes)):
        queue = [root] if open_home[root] else []
        open_home[root] = False
        while queue:
            x = queue.pop()
            for v in np.flatnonzero(near[x] & open_visitor).tolist():
                open_visitor[v] = False
                out.append((int(homes[x]), int(visitors[v])))
                more = np.flatnonzero(near[:, v] & open_home).tolist()
                open_home[more] = False
                out += [(int(homes[y]), int(visitors[v])) for y in more]
                queue += more
    return out


def links(nodes: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: fingerprints that differ in at most ``threshold`` bits, enough of them to join all such.

    ``nodes``: distinct ``fp``. Visitors go on only where someone is at home. Homes and
    visitors of an anchor are dealt into blocks, each pair of blocks a group of its own, so
    a crowded anchor is spread; a group hands on a forest, fewer links than it has rows.
    """
    spark = nodes.sparkSession
    went = visits(nodes, threshold)
    homes = went.filter("home").select("anchor").distinct()
    met = settled(went.join(homes, "anchor", "left_semi"))
    size = met.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).filter("all > 1")
    blocks = size.select("anchor", *(F.expr(f"cast(ceil({c} / {block}) as int)").alias(n) for c, n in (("homes", "hs"), ("all", "vs"))))
    every = lambda n: f"sequence(0, {n} - 1)"
    own = lambda n: f"array(cast(pmod(xxhash64(fp, anchor), {n}) as int))"
    placed = met.join(blocks, "anchor")
    dealt = placed.select("anchor", "fp", F.lit(False).alias("home"), F.expr(every("hs")).alias("i"), F.expr(own("vs")).alias("j")).unionByName(
        placed.filter("home").select("anchor", "fp", F.lit(True).alias("home"), F.expr(own("hs")).alias("i"), F.expr(every("vs")).alias("j")))
    rows = dealt.select("anchor", F.explode("i").alias("i"), "j", "fp", "home").select("anchor", "i", F.explode("j").alias("j"), "fp", "home")
    grouped = rows.repartition(wide(spark), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "home", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("anchor", "i", "j", "fp", "home")
        held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            rows = [np.concatenate(x) for x in zip(held, new)]
            edge = np.ones(len(rows[0]), bool)
            edge[1:] = np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)
            cuts = np.flatnonzero(edge)
            # the last group may go on in the next batch
            yield _compared(rows[3], rows[4], cuts, threshold)
            held = [x[cuts[-1] :] for x in rows] if len(cuts) else rows
        yield _compared(held[3], held[4], np.array([0, len(held[3])]), threshold)

    return grouped.mapInArrow(run, "a bigint, b bigint").distinct()


def _compared(fp: np.ndarray, home: np.ndarray, cuts: np.ndarray, threshold: int) -> pa.RecordBatch:
    """Links of the groups fp[cuts[i]:cuts[i + 1]], each visitors first and then homes."""
    found: list[tuple[int, int]] = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        at_home = home[a:b]
        if at_home.any():
            found += forest(fp[a:b][at_home], fp[a:b][~at_home], threshold)
    pairs = np.array([p for p in found if p[0] != p[1]], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])


def near_components(docs: DataFrame, threshold: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Fingerprints are linked at ``threshold`` or fewer differing bits; ``component_id`` is the
    smallest id reachable over links (null if all are null), ``fingerprint`` 16 hexadecimal digits.

    Rows with equal fingerprints, such as copies, fall together first, so everything between
    is per distinct fingerprint. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Long texts are read whole. Ids may be null or repeated: every row
    gives one row, an empty table none. Other columns are ignored.
    """
    rows = settled(fingerprints(docs, words, seed, id_col, text_col))
    nodes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = components(links(nodes, threshold, block), "a", "b")
    named = nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = settled(named.select("fp", "root").join(smallest, "root").select("fp", "component_id"))
    return rows.join(placed, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
