"""Problem 1: groups of near-duplicate texts by a size-aware heavy-light set join.

A text is the set of its words in their visible form (problem 7), case folded. Two sets are linked if
their Jaccard similarity is at least ``similarity``. All words stand in one order, rare ones first; two
sets that share ``o`` of their ``n`` words share at least ``k`` of the first ``n - o + k`` ones. So

* heavy sets (more than ``boundary`` words) scan the inverted lists of the single words of it (``k`` = 1);
* light sets enumerate subsets of it: where the list of a word is longer than ``LEAF`` rows, its sets are told apart by the
  next word of the beginning, and so on up to ``DEPTH`` words, so the lists that are compared stay short while the table grows.

Both ways are exact: a pair meets where the first words that it shares lead. The shorter set of a pair needs the smaller
beginning, the longer one the larger. The boundary is where the rows of both ways, from the histogram of sizes, are least.
Only the inverted lists of single words are shuffled; their rows carry the next words of the beginning, so subsets are made where
a list is read. Keys that hold many sets are split by salts. Every row carries 128 parities of its set's words: two
sets differ by at least as many words as parities, so most candidates fall where they meet. The rest are verified exactly.

Defined results: null texts and texts of fewer than ``min_words`` words link to nothing; equal texts
link; repeated rows are collapsed before the join and expanded after it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.lookalike import Lookalikes
from civicflow.session import materialize

_WORD = re.compile(r"[^\W_]+")
#: Words are ordered by the uses of their bucket, so the table that every worker holds has a fixed size.
BUCKETS = 1 << 20
LEAF = 1_000  # rows that are compared with one another; more are told apart by a further word, which costs about as much
DEPTH = 6  # words of a subset at most
ALIKE = 2.0  # a list is told apart no further if that leaves more than so many times the pairs to compare
TURNS = 2  # parts of the lists that are on disk one after the other
CHUNK = 200_000  # rows of whole lists that a worker holds
HOT_ROWS = 200_000  # rows of one key that one task takes; a key of more is split
HOT_SAMPLE = 5_000  # sets looked at to find keys to split; only the balance of tasks depends on it


def word_sets(texts: DataFrame, key: str, column: str, min_words: int) -> DataFrame:
    """(id, words): sorted 64-bit hashes of the different words of each text with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = Lookalikes(), {}
        for batch in batches:
            ids, offsets, flat = [], [0], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _WORD.findall(model.text(text).lower())
                if len(found) < min_words:
                    continue
                for w in set(found):
                    code = codes.get(w)
                    if code is None:
                        if len(codes) > 1_000_000:
                            codes.clear()
                        code = codes[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                    flat.append(code)
                ids.append(i)
                offsets.append(len(flat))
            values = np.array(flat, dtype=np.int64)
            if len(ids):
                owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
                values = values[np.lexsort((values, owner))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), lists], names=["id", "words"])

    rows = texts.select(F.col(key).alias("id"), F.col(column).alias("t")).where(F.length("t") >= 2 * min_words - 1)
    return rows.mapInArrow(run, "id bigint, words array<bigint>")


def beginnings(n: int, similarity: float, k: int) -> tuple[int, int]:
    """How many first words of a set of ``n`` hold ``k`` shared ones: as the shorter of a pair, as the longer."""
    shorter = n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + k
    longer = n - math.ceil(similarity * n - 1e-9) + k
    return min(shorter, n), min(longer, n)


def plan_join(sizes: dict[int, int], vocabulary: int, similarity: float) -> int:
    """The boundary with the least expected number of rows moved."""
    best = None
    for x in [0, *sorted(sizes)]:
        light = sum(c * math.comb(beginnings(n, similarity, 2)[1], 2) for n, c in sizes.items() if n <= x)
        lists = sum(c * beginnings(n, similarity, 1)[0] for n, c in sizes.items() if n >= similarity * x)
        probes = sum(c * beginnings(n, similarity, 1)[1] for n, c in sizes.items() if n > x)
        rows = light + (lists + probes * (1 + lists / max(vocabulary, 1)) if probes else 0)
        if best is None or rows <= best[0]:
            best = (rows, x)
    return best[1] if best else 0


def _mix(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    x = (x ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: ``role`` holds the size of the set, the place of the word in it, and whether the row meets others as the shorter and as the longer
#: set; ``rest`` the following words of the beginning, 16 bits each, if the list may be too long to be scanned.
_ROWS = "key bigint, set_id bigint, parity bigint, other bigint, role bigint, rest binary"
_SIZE = 30  # bits of each number in ``role``


def _parities(flat: np.ndarray, start: np.ndarray, bit: int) -> np.ndarray:
    return np.bitwise_xor.reduceat(np.uint64(1) << (flat >> np.uint64(bit) & np.uint64(63)), start).view(np.int64) if len(flat) else np.zeros(0, dtype=np.int64)


def _lists(sets: DataFrame, uses, similarity: float, boundary: int, leaf: int, salts: dict[int, int], turn: int, turns: int) -> DataFrame:
    """The rows of the inverted lists whose keys have their ``turn``."""
    salted = np.array(sorted(salts), dtype=np.int64)
    parts = np.array([salts[k] for k in sorted(salts)], dtype=np.int64)
    salt = lambda k, p: _mix(k.view(np.uint64), p.astype(np.uint64) + np.uint64(5)).view(np.int64)

    def split(keys: np.ndarray, ids: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, ...]:
        """(rows, keys, short, long), the keys of many sets in parts: as the longer set a row of such a key goes
        to one part, as the shorter one to all parts."""
        at = np.minimum(np.searchsorted(salted, keys), len(salted) - 1)
        hot = salted[at] == keys
        cool, once, many = np.flatnonzero(~hot), np.flatnonzero(hot), np.flatnonzero(hot & short)
        part = _mix(ids[once].view(np.uint64), np.uint64(3)) % parts[at[once]].astype(np.uint64)
        times = parts[at[many]]
        every = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows = np.concatenate([cool, once, np.repeat(many, times)])
        return (
            rows, np.concatenate([keys[cool], salt(keys[once], part), salt(np.repeat(keys[many], times), every)]),
            np.concatenate([short[cool], np.zeros(len(once), dtype=bool), np.ones(len(every), dtype=bool)]),
            np.concatenate([np.ones(len(cool) + len(once), dtype=bool), np.zeros(len(every), dtype=bool)]),
        )

    def of_size(n: int, words: np.ndarray, used: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(rows, keys, roles, lengths and codes of the rest) of sets of one size, whose words are in order."""
        shorter, longer = beginnings(n, similarity, 1)
        end = min(beginnings(n, similarity, DEPTH)[1], n) if n <= boundary else 0
        codes = (words[:, :end] >> np.uint64(36)).astype(np.uint16)
        for j in range(longer):
            keys = _mix(words[:, j], np.uint64(1))
            rows = np.flatnonzero((used[:, j] > 1) & ((keys >> np.uint64(32)) % np.uint64(turns) == turn))
            keys, short = keys[rows].view(np.int64), np.full(len(rows), j < shorter)
            long = np.ones(len(rows), dtype=bool)
            if len(salted):
                own, keys, short, long = split(keys, ids[rows], short)
                rows = rows[own]
            deep = used[rows, j] > leaf if end > j + 1 else np.zeros(len(rows), dtype=bool)
            yield rows, keys, (n << _SIZE + 2) + (j << 2) + 2 * short + long, np.where(deep, 2 * (end - j - 1), 0), codes[rows[deep], j + 1 : end].ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = uses.value
        for whole in batches:
            lengths = np.asarray(pa.compute.list_value_length(whole.column(1)))
            step = max(1, int(400_000 // max(1, np.percentile(lengths, 99) if len(lengths) else 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                n = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
                owner = np.repeat(np.arange(batch.num_rows), n)
                used = counts[(flat % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.lexsort((flat, used, owner))
                flat, used = flat[order], used[order]
                start = np.cumsum(n) - n
                ids, parity, other = batch.column(0).to_numpy(), _parities(flat, start, 58), _parities(flat, start, 52)
                found, held = [], 0
                for size in np.unique(n):
                    rows = np.flatnonzero(n == size)
                    # Long sets, whose rows are long too, are taken a few at a time.
                    few = max(1, 4_000_000 // (int(size) * int(size)))
                    for s in range(0, len(rows), few):
                        part = rows[s : s + few]
                        places = start[part][:, None] + np.arange(size)
                        for own, *columns in of_size(int(size), flat[places], used[places], ids[part]):
                            if len(own):
                                found.append((part[own], *columns))
                                held += len(own) * 40 + 2 * len(columns[3])
                                if held > 20_000_000:
                                    yield batch_of(found, ids, parity, other)
                                    found, held = [], 0
                if found:
                    yield batch_of(found, ids, parity, other)

    def batch_of(found: list[tuple[np.ndarray, ...]], ids: np.ndarray, parity: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        rows, keys, roles, lengths, codes = (np.concatenate(c) for c in zip(*found, strict=True))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        rest = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
        columns = [pa.array(c) for c in (keys, ids[rows], parity[rows], other[rows], roles.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, rest], names=["key", "set_id", "parity", "other", "role", "rest"])

    return sets.select("set_id", "words").mapInArrow(run, _ROWS)


class _Meeting:
    """Whole inverted lists, where candidates meet. An element is a word of a row that the subset of its node of the tree ends with."""

    BLOCK, WIDE, FEW, GROW = 64, 4_096, 128, 1_500_000

    def __init__(self, rows: pa.Table, similarity: float, boundary: int, leaf: int):
        role = rows.column("role").to_numpy()
        n, pos = role >> _SIZE + 2, (role >> 2) & ((1 << _SIZE) - 1)
        # The shorter set of a pair comes first; of two of one size, one that may be it.
        order = np.argsort(2 * n + 1 - (role >> 1 & 1), kind="stable")
        rest = rows.column("rest").combine_chunks()
        rest = pa.concat_arrays(rest.chunks) if isinstance(rest, pa.ChunkedArray) else rest
        offsets = np.frombuffer(rest.buffers()[1], dtype=np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64) // 2
        codes = np.frombuffer(rest.buffers()[2], dtype=np.uint16) if rest.buffers()[2] is not None and rest.buffers()[2].size else np.zeros(0, dtype=np.uint16)
        self.boundary, self.leaf = boundary, leaf
        self.n, self.pos, role = n[order], pos[order], role[order]
        self.short, self.long = (role & 2) > 0, (role & 1) > 0
        key, self.ids, self.parity, self.other = (rows.column(c).to_numpy()[order] for c in ("key", "set_id", "parity", "other"))
        self.parity, self.other = self.parity.view(np.uint64), self.other.view(np.uint64)
        length = np.diff(offsets)[order]
        self.start = np.cumsum(length + 1) - (length + 1)
        self.owner = np.repeat(np.arange(len(order)), length + 1)
        place = np.arange(len(self.owner)) - self.start[self.owner]
        self.codes = np.zeros(len(self.owner), dtype=np.uint64)
        inner = place > 0
        self.codes[inner] = codes[(offsets[:-1][order][self.owner] + place - 1)[inner]]
        sizes, at = np.unique(self.n, return_inverse=True)
        of = lambda f: np.array([f(int(x)) for x in sizes], dtype=np.int64)[at]
        self.shorter, self.longer = of(lambda x: beginnings(x, similarity, 0)[0]), of(lambda x: beginnings(x, similarity, 0)[1])
        self.least = of(lambda x: x - beginnings(x, similarity, 0)[0])  # words shared with a set that is not shorter
        self.most = of(lambda x: math.floor(x / similarity + 1e-9))
        #: Two sets differ in at most this share of the words of both.
        self.share = (1 - similarity) / (1 + similarity)
        self.limit = np.minimum(2 * self.n * self.share + 1e-6, 64).astype(np.uint8)
        self.bits = np.uint64(len(self.owner).bit_length() + 1)
        self.seen: list[np.ndarray] = []
        self.compared = 0
        self._visit(self._sorted(key.view(np.uint64), self.start, self.short), 1)

    def _sorted(self, word: np.ndarray, element: np.ndarray, short: np.ndarray, parent: np.ndarray | None = None, parents: int = 0) -> np.ndarray:
        """The elements by their node, which is a word below a parent, and there by the sizes of their sets."""
        mixed = _mix(word, np.uint64(7)) >> self.bits
        if parents:
            width = np.uint64(parents.bit_length())
            mixed = (mixed >> width) | (parent.astype(np.uint64) << np.uint64(64) - width - self.bits)
        return np.sort((mixed << self.bits) | (element.astype(np.uint64) << np.uint64(1)) | short.astype(np.uint64))

    def pairs(self) -> pa.RecordBatch:
        """(a, b) of the sets that may be linked, each pair once."""
        i, j = (np.concatenate([x[k] for x in self.seen]) if self.seen else np.zeros(0, dtype=np.int64) for k in (0, 1))
        ids, code = np.unique(self.ids, return_inverse=True)
        both = np.unique(np.minimum(code[i], code[j]) * len(ids) + np.maximum(code[i], code[j]))
        return pa.RecordBatch.from_arrays([pa.array(ids[both // max(1, len(ids))]), pa.array(ids[both % max(1, len(ids))])], names=["a", "b"])

    def _visit(self, elements: np.ndarray, k: int) -> None:
        """``elements``: those of whole nodes at depth ``k``, in order."""
        node = elements >> self.bits
        cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(cuts, len(node)))
        short = (elements & np.uint64(1)) > 0
        alive = (count > 1) & (np.add.reduceat(short, cuts, dtype=np.int64) > 0) if len(cuts) else count > 1
        element = ((elements & ((np.uint64(1) << self.bits) - np.uint64(1))) >> np.uint64(1)).astype(np.int64)
        row = self.owner[element]
        large = alive & (count > min(self.FEW, self.leaf))
        self._few(row, short, cuts[alive & ~large], count[alive & ~large])
        deeper = large & (count > self.leaf) if k < DEPTH else np.zeros(len(cuts), dtype=bool)
        parity, limit, size = self.parity[row], self.limit[row], self.n[row]
        for g in np.flatnonzero(large):
            lo, hi = int(cuts[g]), int(cuts[g] + count[g])
            if not deeper[g]:
                self._blocks(row, short, parity, limit, size, lo, hi, hi, lo)
                continue
            light = lo + int(np.searchsorted(size[lo:hi], self.boundary, "right")) if k == 1 else hi
            if light < hi:  # heavy sets meet all others here
                self._blocks(row, short, parity, limit, size, lo, hi, hi, light)
            brief = lo + int(np.searchsorted(self.least[row[lo:light]], k, "right"))
            if brief > lo:  # sets that may share no more words than these
                self._blocks(row, short, parity, limit, size, lo, light, brief, lo)
        self._deeper(row, element, short, cuts[deeper], count[deeper], k)

    def _deeper(self, row: np.ndarray, element: np.ndarray, short: np.ndarray, cuts: np.ndarray, count: np.ndarray, k: int) -> None:
        if not len(cuts):
            return
        group = np.repeat(np.arange(len(cuts)), count)
        at = np.arange(count.sum()) + np.repeat(cuts - np.cumsum(count) + count, count)
        row, element, short = row[at], element[at], short[at]
        reach = np.where(self.long[row], self.longer[row], self.shorter[row]) + k + 1
        times = np.maximum(0, self.start[row] + np.minimum(reach, self.n[row]) - self.pos[row] - element - 1)
        times[self.n[row] > self.boundary] = 0
        grown = np.cumsum(np.bincount(group, weights=times, minlength=len(cuts)))
        turn = (grown // self.GROW).astype(np.int64)[group]
        ends = np.append(np.flatnonzero(turn[1:] != turn[:-1]) + 1, len(turn))
        for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
            t = times[lo:hi]
            which = np.repeat(np.arange(lo, hi), t)
            following = element[which] + 1 + np.arange(len(which)) - np.repeat(np.cumsum(t) - t, t)
            owner = row[which]
            also = short[which] & (self.pos[owner] + following - self.start[owner] < self.shorter[owner] + k + 1)
            first, parents = int(group[lo]), int(group[hi - 1] - group[lo]) + 1
            grown = self._sorted(self.codes[following], following, also, group[which] - first, parents)
            # Sets that are alike stay together whatever word follows; they are compared here.
            top = np.uint64(64 - parents.bit_length())
            new = np.flatnonzero(np.concatenate([[True], grown[1:] >> self.bits != grown[:-1] >> self.bits])) if len(grown) else np.zeros(0, dtype=np.int64)
            below = np.bincount((grown[new] >> top).astype(np.int64), weights=np.diff(np.append(new, len(grown))).astype(float) ** 2, minlength=parents)
            alike = np.flatnonzero(below > ALIKE * count[first : first + parents].astype(float) ** 2)
            if len(alike):
                begin = np.cumsum(count) - count
                for g in alike + first:
                    x, y = int(begin[g]), int(begin[g] + count[g])
                    r = row[x:y]
                    self._blocks(r, short[x:y], self.parity[r], self.limit[r], self.n[r], 0, y - x, y - x, 0)
                grown = grown[~np.isin(grown >> top, alike.astype(np.uint64))]
            self._visit(grown, k + 1)

    def _few(self, row: np.ndarray, short: np.ndarray, cuts: np.ndarray, count: np.ndarray) -> None:
        """Pairs of small nodes: all elements and those a few places on."""
        if not len(cuts):
            return
        order = np.argsort(-count, kind="stable")
        cuts, count = cuts[order], count[order]
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(cuts - ends + count, count)
        row, short, last = row[at], short[at], np.repeat(ends, count)
        parity, limit = self.parity[row], self.limit[row]
        for d in range(1, int(count[0])):
            m = int(ends[np.searchsorted(-count, -d, "left") - 1])
            self.compared += m - d
            i = np.flatnonzero(np.bitwise_count(parity[: m - d] ^ parity[d:m]) <= limit[d:m])
            self._keep(row, short, i[i + d < last[i]], d)

    def _blocks(self, row, short, parity, limit, size, lo: int, hi: int, rows_end: int, columns_from: int) -> None:
        """Pairs of the node between ``lo`` and ``hi``, the shorter set before ``rows_end`` and the longer one from ``columns_from`` on."""
        shorts = lo + np.flatnonzero(short[lo:rows_end])
        for s in range(0, len(shorts), self.BLOCK):
            a = shorts[s : s + self.BLOCK]
            end = lo + int(np.searchsorted(size[lo:hi], self.most[row[a[-1]]], "right"))
            own = parity[a][:, None]
            for b in range(max(int(a[0]) + 1, columns_from), end, self.WIDE):
                c = min(end, b + self.WIDE)
                self.compared += len(a) * (c - b)
                i, j = np.divmod(np.flatnonzero(np.bitwise_count(own ^ parity[None, b:c]) <= limit[None, b:c]), c - b)
                i, j = a[i], b + j
                later = j > i
                self._keep(row, short, i[later], (j - i)[later])

    def _keep(self, row: np.ndarray, short: np.ndarray, i: np.ndarray, distance) -> None:
        """Of the pairs of elements, those that no size or parity rules out."""
        i, j = i[short[i]], row[(i + distance)[short[i]]]
        i = row[i]
        both = (self.n[i] + self.n[j]) * self.share + 1e-6
        good = self.long[j] & (self.n[j] <= self.most[i]) & (self.ids[i] != self.ids[j])
        good &= (np.bitwise_count(self.parity[i] ^ self.parity[j]) <= both) & (np.bitwise_count(self.other[i] ^ self.other[j]) <= both)
        if good.any():
            self.seen.append(np.stack([i[good], j[good]]))


def _met(rows: DataFrame, similarity: float, boundary: int, leaf: int) -> DataFrame:
    """(a, b): the pairs that meet in the lists, which are read whole, some at a time."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # where the last list begins, which may go on
            if size + cut >= chunk and (cut or held and held[-1].column(0)[-1].as_py() != keys[0]):
                yield _Meeting(pa.Table.from_batches([*held, batch.slice(0, cut)]), similarity, boundary, leaf).pairs()
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if size:
            yield _Meeting(pa.Table.from_batches(held), similarity, boundary, leaf).pairs()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _uses(sets: DataFrame) -> np.ndarray:
    """How often the words of each bucket are used; words of one bucket count together."""
    bucket = F.expr(f"cast(pmod(w, {BUCKETS}) as int)").alias("bucket")
    rows = sets.select(F.explode("words").alias("w")).select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _hot_keys(sets: DataFrame, total: int, uses, similarity: float, boundary: int, leaf: int) -> dict[int, int]:
    """The number of parts of each key that many sets have, estimated on a sample of sets."""
    share = max(1, total // HOT_SAMPLE)
    some = _lists(sets.where(F.pmod(F.xxhash64("set_id"), F.lit(share)) == 0), uses, similarity, boundary, leaf, {}, 0, 1)
    counts = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") * share > HOT_ROWS) & (F.col("n") >= 10))
    return {r.key: math.ceil(r.n * share / HOT_ROWS) for r in counts.collect()}


def near_duplicate_sets(
    texts: DataFrame, key: str = "message_id", column: str = "text", similarity: float = 0.7, min_words: int = 12, boundary: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b) between different word sets, members (set_id, id) of every set."""
    rows = materialize(
        word_sets(texts, key, column, min_words).withColumn("code", F.xxhash64("words", F.size("words"))), "word-sets"
    )
    first = rows.groupBy("code").agg(F.min("id").alias("set_id"))
    members = materialize(rows.select("id", "code").join(first, "code").select("set_id", "id"), "set-members")
    sets = materialize(
        rows.join(members.where("set_id = id").select("id"), "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("set_id"), "words"), "sets"
    )
    sizes = {r.n: r.c for r in sets.groupBy(F.size("words").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    counts = _uses(sets)
    if boundary is None:
        boundary = plan_join(sizes, int((counts > 1).sum()), similarity)
    uses = texts.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max() < 1 << 31 else counts)
    total = sum(sizes.values())
    leaf = LEAF
    salts = _hot_keys(sets, total, uses, similarity, boundary, leaf)
    # The lists are made and joined in turns, so that only a part of them is on disk at a time.
    met = [materialize(_met(_lists(sets, uses, similarity, boundary, leaf, salts, turn, TURNS), similarity, boundary, leaf), "met") for turn in range(TURNS)]
    found = reduce(DataFrame.unionByName, met)
    n = F.size("words")
    # Candidates meet first on 16 bits of each word, which can only make sets look more alike, but for the
    # words of one set that coincide: a pair loses at most as many shared words as the lesser number of
    # them in its two sets. The few that pass are verified on the whole words.
    brief = sets.select("set_id", F.expr("transform(words, w -> cast((w & 65535) - 32768 as smallint))").alias("s"), n.alias("n")).withColumn("c", F.col("n") - F.size(F.array_distinct("s")))
    near = found.distinct().join(brief.select(F.col("set_id").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"), F.col("c").alias("ca")), "a")
    near = near.join(brief.select(F.col("set_id").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"), F.col("c").alias("cb")), "b")
    enough = (F.size(F.array_intersect("sa", "sb")) + F.least("ca", "cb")) * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-6
    pairs = materialize(near.where(enough).select("a", "b"), "set-pairs")
    sets = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id", "left_semi")
    left = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(sets.select(F.col("set_id").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    links = both.where(shared >= similarity * (F.size("wa") + F.size("wb") - shared) - 1e-9).select("a", "b")
    return links, members


def near_duplicate_pairs(texts: DataFrame, key: str = "message_id", column: str = "text", **options) -> DataFrame:
    """All pairs of rows whose word sets are linked or equal; (key_a, key_b) with key_a < key_b."""
    links, members = near_duplicate_sets(texts, key, column, **options)
    x, y = members.alias("x"), members.alias("y")
    copies = x.join(y, F.expr("x.set_id = y.set_id AND x.id < y.id")).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    edited = (
        links.join(members.select(F.col("set_id").alias("a"), F.col("id").alias("i")), "a")
        .join(members.select(F.col("set_id").alias("b"), F.col("id").alias("j")), "b")
        .select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    )
    return copies.unionByName(edited).select(F.col("i").alias(f"{key}_a"), F.col("j").alias(f"{key}_b"))


def near_duplicate_degrees(texts: DataFrame, key: str = "message_id", column: str = "text", **options) -> DataFrame:
    """One row per text with enough words: its set's id, the set's copies and its links to other sets."""
    links, members = near_duplicate_sets(texts, key, column, **options)
    degree = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))
    return (
        members.join(copies.join(degree, "set_id", "left"), "set_id")
        .select(F.col("id").alias(key), F.col("set_id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )
