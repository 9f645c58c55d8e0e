"""Problem 8: ids of all texts under a public byte-level BPE vocabulary through a table of distinct words.

Spark splits every text into the words of the public pattern, counts the distinct words of the whole
corpus and encodes each of them once. The ids then go back to the texts by position: a dictionary of the
most frequent short words, bounded in words and bytes, is on every worker; all other words of a text come
by a join on the word. Byte-level BPE never merges across words, so the result is that of encoding whole
texts.

Defined results: null and empty texts have no ids; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.session import materialize

TOKENIZERS = os.environ.get("CIVICFLOW_TOKENIZERS", "/opt/tokenizers")
#: The public pattern of byte-level BPE: contractions, words, numbers, signs, spaces (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The dictionary on the workers holds at most so many words of at most so many bytes.
HEAD_WORDS, HEAD_BYTES = 20_000, 64


def vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f)}


@cache
def _encoder(folder: str, name: str):
    """Loaded once a worker, not once a task."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=vocabulary(folder, name), special_tokens={})


def distinct_words(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): each word of the corpus with its number of uses; counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(split(text))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    rows = texts.select(column).where(F.length(column) > 0)
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, folder: str, name: str) -> DataFrame:
    """(word, n, ids), each word encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(folder, name)
        for batch in batches:
            ids = [bpe.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n bigint, ids array<int>")


def encode_texts(
    texts: DataFrame, key: str = "doc_id", column: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", head_words: int = HEAD_WORDS
) -> DataFrame:
    spark = texts.sparkSession
    rows = texts.select(F.col(key), F.col(column).alias("t"))
    words = materialize(encode_words(distinct_words(rows, "t"), folder, name), "word-ids")
    packed = words.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(head_words).select("word", "ids").toArrow()
    lists = packed.column("ids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    lengths = np.asarray(lists.value_lengths(), dtype=np.int32)
    sent = spark.sparkContext.broadcast((packed.column("word").to_pylist(), lengths, flat))
    loaded: dict[str, tuple] = {}

    def head_table() -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        if "head" not in loaded:
            names, lengths, flat = sent.value
            loaded["head"] = ({w: k for k, w in enumerate(names)}, np.cumsum(lengths, dtype=np.int64) - lengths, lengths.astype(np.int64), flat)
        return loaded["head"]

    kind = dict(rows.dtypes)[key]
    rows = _with_tail(rows, words, head_table, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        index, starts, lengths, flat = head_table()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                places, ends, extra, extra_ids = [], [0], {}, []
                for text, tail in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    for x in tail or ():
                        if x["word"] not in extra:
                            extra[x["word"]] = len(starts) + len(extra)
                            extra_ids.append(x["ids"])
                    if text:
                        found = split(text)
                        try:
                            places += [index[w] for w in found]
                        except KeyError:
                            del places[ends[-1] :]
                            places += [index[w] if w in index else extra[w] for w in found]
                    ends.append(len(places))
                more = np.array([len(x) for x in extra_ids], dtype=np.int64)
                at_start = np.concatenate([starts, len(flat) + np.cumsum(more) - more])
                at_length = np.concatenate([lengths, more])
                values = np.concatenate([flat, np.array([i for x in extra_ids for i in x], dtype=np.int32)])
                place = np.array(places, dtype=np.int64)
                n = at_length[place]
                out_end = np.cumsum(n)
                taken = np.arange(out_end[-1] if len(n) else 0) + np.repeat(at_start[place] - (out_end - n), n)
                offsets = np.concatenate([[0], out_end])[ends]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[taken], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return rows.select(key, "t", "tail").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _with_tail(rows: DataFrame, words: DataFrame, head_table, key: str) -> DataFrame:
    """Adds to each text the ids of those of its words that the dictionary lacks, by a join on the word.

    A hot word is joined to the one row of its ids, and words that many texts have are in the dictionary."""

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        index = head_table()[0]
        for batch in batches:
            code, word = [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rare = {w for w in split(text) if w not in index}
                code += [c] * len(rare)
                word += rare
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(word, pa.string())], names=["code", "word"])

    rows = rows.withColumn("code", F.xxhash64("t", key))
    rare = rows.where(F.length("t") > 0).select("code", "t").mapInArrow(missing, "code bigint, word string").distinct()
    tails = rare.join(words.select("word", "ids"), "word").groupBy("code").agg(F.collect_list(F.struct("word", "ids")).alias("tail"))
    return rows.join(tails, "code", "left").drop("code")


def pieces(spark: SparkSession, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, piece): the vocabulary as a table."""
    return spark.createDataFrame([(i, p) for p, i in vocabulary(folder, name).items()], "id int, piece binary")


def decode_ids(encoded: DataFrame, vocabulary_table: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids) by a join of each id with its piece; empty lists give empty texts."""
    placed = encoded.select(F.xxhash64("ids", key).alias("code"), F.posexplode("ids").alias("pos", "id"))
    joined = placed.dropDuplicates(["code", "pos"]).join(F.broadcast(vocabulary_table), "id").groupBy("code").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("ps"))
    text = F.expr("decode(unhex(array_join(transform(ps, x -> hex(x.piece)), '')), 'UTF-8')")
    return encoded.withColumn("code", F.xxhash64("ids", key)).join(joined, "code", "left").select(key, F.coalesce(text, F.lit("")).alias("text"))
