"""Byte-pair encoding of many texts at once on ragged numpy arrays.

Texts are cut at spaces, equal pieces of a slice are encoded once, pieces are cut into
pre-tokens, and equal pre-tokens are merged once. ``Merger.run`` holds all pre-tokens
as one array of symbols with row bounds and, in each round, merges the lowest-ranked
pair of every row at the same time. Merging one pair never creates a pair of lower
rank than itself, so a round settles all its places; rows without a mergeable pair leave.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from bandwalk.llm.texts import raw

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
NONE = np.iinfo(np.int32).max
RANGE = 0x800  # code points looked at together; divides the surrogates' bounds
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def code_point_kinds() -> np.ndarray:
    """Letter, number, blank or other for every code point, as the tokenizer library's own expressions have it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    kinds = np.zeros(0x110000, np.uint8)
    rules = [(kind, Split(Regex(x), "removed", invert=True)) for kind, x in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s"))]
    # a small range at a time: the matches of all code points at once would take hundreds of MB on the driver
    for low in range(0, 0x110000, RANGE):
        if 0xD800 <= low < 0xE000:
            continue
        text = np.arange(low, low + RANGE, dtype="<u4").tobytes().decode("utf-32-le")
        for kind, rule in rules:
            for _, (at, _) in rule.pre_tokenize_str(text):
                kinds[low + at] = kind
    return kinds


class Merger:
    """Merge rules of a vocabulary file of the ``tokenizers`` library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        spec = json.loads(self.text)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path}: plain byte-level BPE is expected")
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        rules = {}
        self.width = np.int64(max(vocab.values()) + 1)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            rules[int(vocab[a]) * int(self.width) + vocab[b]] = (rank, vocab[a + b])
        ranked = sorted(rules.items(), key=lambda r: r[1][0])
        # open addressing: the place of a pair is looked up for whole arrays, mostly in one step
        self.bits = max(4, (4 * len(rules)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = np.array([r[0] for r in ranked], np.int64)
        ranks = np.array([r[1][0] for r in ranked], np.int32)
        self.results = np.zeros(len(model["merges"]), np.int32)
        self.results[ranks] = [r[1][1] for r in ranked]
        slot = self.slot_of(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.ranks[slot[placed]] = ranks[placed]
            keys, ranks = keys[~placed], ranks[~placed]
            slot = (slot[~placed] + 1) & (len(self.keys) - 1)
        self.kinds = code_point_kinds()

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        product = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (product >> np.uint64(64 - self.bits)).view(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if no rule merges it."""
        key = left.astype(np.int64) * self.width + right
        slot = self.slot_of(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        left_over = np.flatnonzero((found != key) & (found != -1))
        while len(left_over):
            slot[left_over] = (slot[left_over] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.ranks[slot[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        return out

    def run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, bounds) after all merges of the rows data[bounds[i]:bounds[i + 1]], none empty."""
        rows = len(bounds) - 1
        symbols = self.inner[data]
        symbols[bounds[1:] - 1] = self.last[data[bounds[1:] - 1]]
        size = np.diff(bounds)
        final = size.copy()
        row = np.arange(rows)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their sizes, their symbols
        # rank of the pair that starts at each symbol; NONE at the end of a row
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        if rows:
            rank[np.cumsum(size) - 1] = NONE
        while len(row):
            starts = np.cumsum(size) - size
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NONE
            if over.any():
                spread = np.repeat(over, size)
                done.append((row[over], size[over], symbols[spread]))
                symbols, rank = symbols[~spread], rank[~spread]
                row, size, lowest = row[~over], size[~over], lowest[~over]
                if not len(row):
                    break
            hit = rank == np.repeat(lowest, size)
            # equal neighbours (as in "aaa") overlap: take every second of a run
            clash = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(clash):
                at = np.flatnonzero(hit)
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1] + 1
                first = np.flatnonzero(new)
                nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                hit[at[nth % 2 == 1]] = False
            place = np.flatnonzero(hit)
            owner = np.repeat(np.arange(len(row)), size)
            symbols[place] = self.results[rank[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            size = size - np.bincount(owner[place], minlength=len(row))
            # the pairs that begin at a merged symbol or just before it are new
            fresh = np.zeros(len(symbols), bool)
            fresh[place] = True
            symbols, rank, fresh = symbols[keep], rank[keep], fresh[keep]
            ends = np.cumsum(size) - 1
            before = np.flatnonzero(fresh) - 1
            fresh[before[before >= 0]] = True
            fresh[ends] = False
            rank[ends] = NONE
            at = np.flatnonzero(fresh)
            rank[at] = self.rank_of(symbols[at], symbols[at + 1])
        if done:
            rows_done = np.concatenate([d[0] for d in done])
            sizes_done = np.concatenate([d[1] for d in done])
            flat = np.concatenate([d[2] for d in done])
            final[rows_done] = sizes_done
            out_bounds = np.concatenate([[0], np.cumsum(final)])
            out = np.empty(len(flat), np.int32)
            out[ranges(out_bounds[:-1][rows_done], sizes_done)] = flat
            return out, out_bounds
        return symbols, np.zeros(1, np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def gather(flat: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``index`` of a ragged array, as a ragged array."""
    sizes = np.diff(bounds)[index]
    return flat[ranges(bounds[:-1][index], sizes)], np.concatenate([[0], np.cumsum(sizes)])


def encode_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points and the number of bytes of each."""
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint8)
    for w, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        chosen = width == w
        if not chosen.any():
            continue
        p, a = points[chosen], at[chosen]
        out[a] = lead | (p >> (6 * (w - 1)))
        for j in range(1, w):
            out[a + j] = 0x80 | ((p >> (6 * (w - 1 - j))) & 0x3F)
    return out, width


def decode_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 rows, and the bounds of the rows in them."""
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(lead)])[bounds]


class Encoder:
    """Encodes slices of texts; holds what depends on the vocabulary file only."""

    def __init__(self, merger: Merger):
        self.merger = merger
        self.library = None
        self.small = np.array([ord(chr(p).lower()) if len(chr(p).lower()) == 1 else p for p in range(0x300)], np.int64)
        self.spaced = regex.compile(CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.specials = regex.compile("|".join(map(regex.escape, merger.special)) or r"(?!)")

    def starts_of(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """First code points of pre-tokens (the byte-level rule), apostrophes aside."""
        kind = self.merger.kinds[points]
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True  # no row is empty
        change = edge[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        # a blank before a word: the last one of its run stands alone or, if a space, joins the word
        last = blank.copy()
        last[:-1] &= ~blank[1:]
        last &= ~edge[1:]
        start = change | last
        joined = np.flatnonzero(last & (points == 32)) + 1
        start[joined[joined < n]] = False
        return start

    def pre_tokens(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, bounds, pre-tokens per piece) of distinct pieces without special strings."""
        data, bounds = raw(pieces)
        quoted = np.zeros(len(pieces) + 1, np.int64)
        np.add.at(quoted, np.searchsorted(bounds, np.flatnonzero(data == 39), "right") - 1, 1)
        slow = np.flatnonzero(quoted[:-1] > 0)
        fast = np.flatnonzero((quoted[:-1] == 0) & (np.diff(bounds) > 0))
        count = np.zeros(len(pieces), np.int64)
        own, own_bounds = gather(data, bounds, fast)
        points, rows = decode_points(own, own_bounds)
        start = self.starts_of(points, rows) if len(points) else np.zeros(0, bool)
        lead = np.flatnonzero((own & 0xC0) != 0x80)
        cuts = [lead[start]]
        count[fast] = np.add.reduceat(start, rows[:-1]) if len(fast) else 0
        if not len(slow):
            return own, np.append(cuts[0], len(own)), count
        texts = [self.spaced.findall(pieces[int(i)].as_py()) for i in slow]
        count[slow] = [len(t) for t in texts]
        extra = [p.encode() for t in texts for p in t]
        cuts = np.concatenate([cuts[0], len(own) + np.cumsum([0, *map(len, extra)])]).astype(np.int64)
        flat = np.concatenate([own, np.frombuffer(b"".join(extra), np.uint8)])
        # back into the order of the pieces
        order = np.concatenate([fast, slow])
        first = np.cumsum(count[order]) - count[order]
        at = np.empty(len(pieces), np.int64)
        at[order] = first
        flat, cuts = gather(flat, cuts, ranges(at, count))
        return flat, cuts, count

    def merged(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the pre-tokens; equal pre-tokens are merged once."""
        column = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                       [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        _, offsets, blob = coded.dictionary.buffers()
        n = len(coded.dictionary)
        own = np.frombuffer(offsets, np.int64, n + 1)
        flat, out = self.merger.run(np.frombuffer(blob, np.uint8)[: own[-1]] if n else np.zeros(0, np.uint8), own)
        return gather(flat, out, coded.indices.to_numpy(zero_copy_only=False))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text under the byte-level rule; special strings count one each."""
        texts = texts.fill_null("") if texts.null_count else texts
        pieces = pc.split_pattern(texts, " ")
        rows = np.asarray(pieces.offsets.to_numpy(), np.int64)
        rows = rows - rows[0]
        coded = pieces.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary
        spaced = pc.binary_join_element_wise(pa.scalar(" ", distinct.type), distinct, pa.scalar("", distinct.type))
        first = np.zeros(len(code), bool)
        first[rows[:-1]] = True
        # a space between two blanks belongs to a longer run: such texts, and those
        # with special strings, are encoded whole
        ends = pc.match_substring_regex(distinct, r"^$|[\s\v\x{85}\p{Z}\x1c-\x1f]$").to_numpy(zero_copy_only=False)
        begins = pc.match_substring_regex(distinct, r"^$|^[\s\v\x{85}\p{Z}\x1c-\x1f]").to_numpy(zero_copy_only=False)
        odd = np.zeros(len(distinct), bool)
        for s in self.merger.special:
            odd |= pc.match_substring(distinct, s.split(" ")[0]).to_numpy(zero_copy_only=False)
        before = np.zeros(len(code), bool)
        before[1:] = ends[code[:-1]] & ~(first[:-1] & (pc.binary_length(distinct).to_numpy()[code[:-1]] == 0))
        before[first] = False
        bad = (before & begins[code]) | odd[code]
        whole = np.add.reduceat(bad, rows[:-1]) > 0 if len(code) else np.zeros(len(texts), bool)
        out = np.zeros(len(texts), np.int64)
        used = ~np.repeat(whole, np.diff(rows))
        plain = self.count_pieces(distinct, code[used & first])
        joined = self.count_pieces(spaced, code[used & ~first])
        per = np.zeros(len(code), np.int64)
        per[used & first], per[used & ~first] = plain, joined
        out += np.add.reduceat(per, rows[:-1]) if len(code) else 0
        for i in np.flatnonzero(whole):
            out[i] = self.count_whole(texts[int(i)].as_py())
        return out

    def count_pieces(self, distinct: pa.Array, code: np.ndarray) -> np.ndarray:
        """Tokens of the pieces distinct[code]; only pieces that occur are encoded."""
        there, index = np.unique(code, return_inverse=True)
        data, bounds, count = self.pre_tokens(distinct.take(pa.array(there)))
        _, out = self.merged(data, bounds)
        total = np.concatenate([[0], np.cumsum(np.diff(out))])
        upto = np.concatenate([[0], np.cumsum(count)])
        return np.diff(total[upto])[index]

    def count_whole(self, text: str) -> int:
        parts = self.specials.split(text)
        tokens = [t.encode() for part in parts for t in self.spaced.findall(part)]
        _, out = self.merged(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)]))
        return int(out[-1]) + len(parts) - 1

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds per text) under a lower-casing word rule that drops blanks.

        A blank separates whatever stands beside it, so pieces are independent. Pieces
        within the first 0x300 code points (stable under NFC) are encoded here, any
        others, and those with apostrophes or special strings, by the library.
        """
        texts = texts.fill_null("") if texts.null_count else texts
        pieces = pc.split_pattern(texts, " ")
        rows = np.asarray(pieces.offsets.to_numpy(), np.int64)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary
        data, bounds = raw(distinct)
        strange = np.zeros(len(distinct) + 1, np.int64)
        # lead bytes above 0xCB begin code points from 0x300; 0x130 is C4 B0
        hard = (data == 39) | (data > 0xCB)
        hard[1:] |= (data[1:] == 0xB0) & (data[:-1] == 0xC4)
        np.add.at(strange, np.searchsorted(bounds, np.flatnonzero(hard), "right") - 1, 1)
        slow = strange[:-1] > 0
        for s in self.merger.special:
            slow |= pc.match_substring(distinct, s).to_numpy(zero_copy_only=False)
        fast = np.flatnonzero(~slow & (np.diff(bounds) > 0))
        slow = np.flatnonzero(slow)
        points, at = decode_points(*gather(data, bounds, fast))
        points = self.small[points]
        kind = self.merger.kinds[points]
        start = kind == NUMBER
        start[1:] |= kind[1:] != kind[:-1]
        start[at[:-1]] = True
        token = np.cumsum(start) - 1
        used = kind != BLANK
        body, width = encode_points(points[used])
        total = int(token[-1]) + 1 if len(token) else 0
        size = np.zeros(total, np.int64)
        np.add.at(size, token[used], width)
        owner = np.repeat(np.arange(len(fast)), np.diff(at))[start]
        size, owner = size[size > 0], owner[size > 0]
        flat, out = self.merged(body, np.concatenate([[0], np.cumsum(size)]))
        count = np.zeros(len(distinct), np.int64)
        count[fast] = np.bincount(owner, weights=np.diff(out), minlength=len(fast)).astype(np.int64)
        first = np.zeros(len(distinct), np.int64)
        first[fast] = np.cumsum(count[fast]) - count[fast]
        if len(slow):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.merger.text)
            found = [self.library.encode(distinct[int(i)].as_py(), add_special_tokens=False).ids for i in slow]
            count[slow] = [len(f) for f in found]
            first[slow] = len(flat) + np.cumsum(count[slow]) - count[slow]
            flat = np.concatenate([flat, np.array([x for f in found for x in f], np.int32)])
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = count[code]
        out = flat[ranges(first[code], size)]
        return out, np.concatenate([[0], np.cumsum(size)])[rows - rows[0]]
