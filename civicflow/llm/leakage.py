"""Problem 9: evaluation texts leaking into documents, by greedy string tiling.

Seeds are runs of ``min_words`` words that a document and an item share: the rolling (Karp-Rabin)
hashes of all runs of a document are joined with those of the items. For every seeded pair, running
Karp-Rabin string tiling marks the longest common runs first, never twice the same word, until no
unmarked run of ``min_words`` is left, so reordered passages are all found. The item leaked if a tile
exists; the coverage of the item by its tiles is reported.

Defined results: null and empty texts on either side leak nothing, nor do items shorter than a seed;
an item that is there twice is reported under each id; repeated documents are reported each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_PRIME = (1 << 61) - 1
#: Up to so many item words are sent to every worker; beyond it seeds meet by a shuffled join.
BROADCAST_WORDS = 2_000_000


class Roller:
    """Hashes of all runs of ``width`` words over the concatenated words of many texts."""

    def __init__(self, width: int):
        self.width, self.codes = width, {}
        self.powers = self.backs = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            one = np.ones(1, dtype=np.uint64)
            self.powers = np.concatenate([one, np.cumprod(np.full(size, _BASE, dtype=np.uint64))])
            self.backs = np.concatenate([one, np.cumprod(np.full(size, _BACK, dtype=np.uint64))])

    def code(self, word: str) -> int:
        code = self.codes.get(word)
        if code is None:
            if len(self.codes) > 1_000_000:
                self.codes.clear()
            code = self.codes[word] = xxhash.xxh64_intdigest(word)
        return code

    def runs(self, words: list[int]) -> np.ndarray:
        """The hash of the run that starts at each word; meaningless over the last ``width`` - 1 words."""
        x = np.array(words, dtype=np.uint64)
        self._grow(len(x) + 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * self.powers[: len(x)])])
        n = max(0, len(x) - self.width + 1)
        return (total[self.width : self.width + n] - total[:n]) * self.backs[:n]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def tiles(a: list, b: list, min_length: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word lists by running Karp-Rabin: (start in a, start in b, length).

    Each pass hashes the unmarked runs of ``min_length`` words, extends the runs that meet and marks the
    longest matches first; matches that a longer one took words from are looked for in the next pass."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    codes: dict = {}
    first = pow(_BASE, min_length, _PRIME)

    def runs(words: list, free: list[bool]) -> Iterator[tuple[int, int]]:
        """(hash, start) of each unmarked run; the hash rolls on word by word and starts anew after a marked one."""
        since = total = 0
        for k, ok in enumerate(free):
            if not ok:
                since = total = 0
                continue
            since += 1
            total = (total * _BASE + codes.setdefault(words[k], len(codes) + 1)) % _PRIME
            if since > min_length:
                total = (total - codes[words[k - min_length]] * first) % _PRIME
            if since >= min_length:
                yield total, k - min_length + 1

    while True:
        index: dict[int, list[int]] = defaultdict(list)
        for run, j in runs(b, free_b):
            index[run].append(j)
        matches = []
        for run, i in runs(a, free_a):
            for j in index.get(run, ()):
                if i and j and a[i - 1] == b[j - 1] and free_a[i - 1] and free_b[j - 1]:
                    continue  # part of a longer match that starts earlier
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= min_length:  # runs that differ may share a hash
                    matches.append((n, i, j))
        if not matches:
            return out
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
                out.append((i, j, n))


SCHEMA = "{key} {kind}, item_id bigint, tiles int, longest int, covered int, coverage double"


def leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", min_words: int = 12, broadcast_words: int = BROADCAST_WORDS, coverage: float = 0.0
) -> DataFrame:
    """One row for each document and item with at least one tile of ``min_words`` words whose tiles cover
    at least the share ``coverage`` of the item's words."""
    docs = documents.select(F.col(key), F.col(column).alias("t")).where(F.length("t") >= 2 * min_words - 1)
    tests = items.select(F.col("item_id").cast("bigint"), F.col("text").alias("it")).where(F.length("it") >= 2 * min_words - 1)
    size = tests.agg(F.sum(F.length("it"))).first()[0] or 0
    kind = dict(docs.dtypes)[key]
    if size <= 2 * broadcast_words:
        held = [(r.item_id, r.it) for r in tests.distinct().collect()]
        pairs = docs.mapInArrow(_seed(min_words, key, docs.sparkSession.sparkContext.broadcast(held)), f"`{key}` {kind}, t string, item_id bigint, it string")
    else:
        seeds = tests.mapInArrow(_all_runs(min_words, "item_id"), "run bigint, item_id bigint").distinct()
        runs = docs.select(F.xxhash64(key, "t").alias("code"), "t").mapInArrow(_all_runs(min_words, "code"), "run bigint, code bigint")
        hits = runs.join(seeds, "run").select("code", "item_id").distinct()
        pairs = hits.join(tests.distinct(), "item_id").join(docs.withColumn("code", F.xxhash64(key, "t")), "code").select(key, "t", "item_id", "it")
    found = pairs.mapInArrow(_tile(min_words, key), SCHEMA.format(key=f"`{key}`", kind=kind))
    return found.where(F.col("coverage") >= coverage) if coverage > 0 else found


def _all_runs(width: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(width)
        for batch in batches:
            hashes, owners = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(roller.runs([roller.code(w) for w in words_of(text)])).view(np.int64)
                hashes.append(found)
                owners.append(np.full(len(found), owner, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(owners))], names=["run", name])

    return run


def _seed(width: int, key: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(width)
        items: dict[int, set[int]] = defaultdict(set)
        texts = held.value
        for k, (_, text) in enumerate(texts):
            for h in roller.runs([roller.code(w) for w in words_of(text)]).tolist():
                items[h].add(k)
        known = np.array(sorted(items), dtype=np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                docs = batch.column(1).to_pylist()
                flat: list[int] = []
                ends = [0]
                codes = roller.codes
                for text in docs:
                    found = words_of(text)
                    try:
                        flat += [codes[w] for w in found]
                    except KeyError:
                        del flat[ends[-1] :]
                        flat += [roller.code(w) for w in found]
                    ends.append(len(flat))
                hashes = roller.runs(flat)
                rows: list[tuple[int, int]] = []
                if len(known) and len(hashes):
                    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = np.flatnonzero(known[place] == hashes)
                    owner = np.searchsorted(np.array(ends), hit, side="right") - 1
                    inside = hit + width <= np.array(ends)[owner + 1]
                    rows = sorted({(int(o), k) for o, h in zip(owner[inside], hashes[hit[inside]].tolist(), strict=True) for k in items[h]})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([o for o, _ in rows], pa.int64())),
                        pa.array([docs[o] for o, _ in rows], pa.string()),
                        pa.array([texts[k][0] for _, k in rows], pa.int64()),
                        pa.array([texts[k][1] for _, k in rows], pa.string()),
                    ],
                    names=[key, "t", "item_id", "it"],
                )

    return run


def _tile(width: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, (text, item) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                test = words_of(item)
                found = tiles(test, words_of(text), width)
                if found:
                    covered = sum(n for _, _, n in found)
                    keep.append(k)
                    out.append((len(found), max(n for _, _, n in found), covered, covered / len(test)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64()))]
                + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)],
                names=[key, "item_id", "tiles", "longest", "covered", "coverage"],
            )

    return run
