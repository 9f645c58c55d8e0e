"""Text steps that need Python: markup, compatibility forms, 64-bit similarity hashes, keyed pseudonyms.

They run on Arrow batches and only where a column function cannot express them."""

from __future__ import annotations

import hashlib
import hmac
import html
import re
import unicodedata
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from civicflow.functions import text as T

#: Elements whose text is dropped, and elements that end a line.
SILENT = frozenset({"script", "style", "noscript", "template"})
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_TAG = re.compile(r"<[A-Za-z/!][^>]*>")
_TOKENS = re.compile(r"[\w-]+")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.quotes: list[str] = []
        self.silent = self.quoting = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT
        self.quoting += tag == "blockquote"
        if tag in BLOCKS:
            self.write("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.write("\n")
        self.silent = max(0, self.silent - (tag in SILENT))
        self.quoting = max(0, self.quoting - (tag == "blockquote"))

    def handle_data(self, data: str) -> None:
        self.write(data)

    def write(self, data: str) -> None:
        if not self.silent:
            (self.quotes if self.quoting else self.out).append(data)


def markup_to_text(value: str) -> tuple[str, str]:
    """(text, quoted text); a value without a tag only has its entities resolved."""
    if not _TAG.search(value):
        return html.unescape(value), ""
    parser = _Text()
    parser.feed(value)
    parser.close()
    return "".join(parser.out), "".join(parser.quotes).strip()


@pandas_udf(StructType([StructField("text", StringType()), StructField("quote", StringType())]))
def html_text(values: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if v is None else markup_to_text(v) for v in values]
    return pd.DataFrame(rows, columns=["text", "quote"])


@pandas_udf(StructType([StructField(n, StringType()) for n in ("text", "form", "quote")]))
def text_and_form(values: pd.Series) -> pd.DataFrame:
    """Both Python steps of the chain in one batch call."""
    rows = [(None, None) if v is None else markup_to_text(v) for v in values]
    return pd.DataFrame([(t, None if t is None else unicodedata.normalize("NFKC", t), q) for t, q in rows], columns=["text", "form", "quote"])


@pandas_udf(StringType())
def compatibility_form(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def simhash(value: str) -> int:
    """Signed 64-bit similarity hash of three-word shingles (words, or characters, of shorter texts)."""
    return int(simhashes([value])[0])


def simhashes(values: list[str], least: int = 50_000) -> np.ndarray:
    """The hash of each text; the votes of texts with so many features together are counted at once."""
    out, digests, starts, done = np.empty(len(values), np.int64), [], [], 0
    for n, value in enumerate(values):
        starts.append(len(digests))
        digests += [hashlib.blake2b(f.encode(), digest_size=8).digest() for f in _features(value)]
        if len(digests) >= least or n == len(values) - 1:
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
            yes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            all_ = np.diff([*starts, len(digests)])[:, None]
            out[done : n + 1] = np.packbits(2 * yes >= all_, axis=1).view(">i8").ravel()
            digests, starts, done = [], [], n + 1
    return out


def _features(value: str) -> list[str]:
    folded = value.casefold()
    if len(folded) == len(value) and "\u0345" not in value:  # each character stays one and in or out of words
        words = [w for w in _TOKENS.findall(folded) if w.strip("-_")]
    else:
        words = [w.casefold() for w in _TOKENS.findall(value) if w.strip("-_")]
    if len(words) >= 3:
        return list(map(" ".join, zip(words, words[1:], words[2:])))
    if words:
        return words
    flat = " ".join(value.casefold().split())
    return [flat[k : k + 3] for k in range(max(1, len(flat) - 2))]


@pandas_udf(LongType())
def simhash64(values: pd.Series) -> pd.Series:
    known = values.notna()
    out = pd.Series(pd.NA, index=values.index, dtype="Int64")
    out[known] = simhashes(values[known].tolist())
    return out


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x.casefold(), y.casefold()).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])


def similarity_from(least: float):
    """Column function (a, b, other): the greater of sequence_ratio and another similarity, exact from ``least`` on; below it the other
    alone may come. The letters in common bound the ratio, so most pairs that are not alike need no matching."""

    def one(x: str | None, y: str | None, other: float) -> float:
        if x is None or y is None or other >= 1:
            return max(0.0, other)
        x, y = x.casefold(), y.casefold()
        need = max(least, other)
        if 2 * min(len(x), len(y)) < need * (len(x) + len(y)) - 1e-9:
            return other
        match = SequenceMatcher(None, x, y)
        return other if match.quick_ratio() < need else max(other, match.ratio())

    @pandas_udf(DoubleType())
    def similarity(a: pd.Series, b: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([one(x, y, z) for x, y, z in zip(a, b, other, strict=True)], dtype=float)

    return similarity


def pseudonym(secret: str, source: Column, author: Column) -> Column:
    """Keyed digest of an author within a source; null stays null."""

    @pandas_udf(StringType())
    def keyed(s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else "author_" + hmac.new(secret.encode(), f"{x}\0{y}".encode(), hashlib.sha256).hexdigest() for x, y in zip(s, a, strict=True)])

    return keyed(source, author)


def preprocess(messages: DataFrame, *also: str) -> DataFrame:
    """The chain markup, compatibility form, controls, whitespace, technical lines, quotes; with the
    digest of every step, so each step's input digest is the one before it. ``also`` names further columns to keep."""
    steps = messages.withColumn("h", text_and_form("text")).withColumn("s1", F.col("h.text"))
    steps = steps.withColumn("s2", F.col("h.form")).withColumn("s3", T.remove_controls(F.col("s2")))
    steps = steps.withColumn("s4", T.normalize_whitespace(F.col("s3"))).withColumn("s5", T.drop_technical_lines(F.col("s4")))
    steps = steps.withColumn("q", T.without_quotes(F.col("s5")))
    steps = steps.withColumn("s6", F.when(F.col("q") == F.col("s4"), F.col("s4")).otherwise(T.normalize_whitespace(F.col("q"))))
    names = ("html", "unicode", "controls", "whitespace", "technical_lines", "quotes")
    digest = [F.sha2(F.coalesce(c, F.lit("")), 256) for c in ("text", "s1", "s2", "s3", "s4", "s5", "s6")]
    trace = F.array(*(F.struct(F.lit(n).alias("step"), digest[k].alias("input_sha256"), digest[k + 1].alias("output_sha256")) for k, n in enumerate(names)))
    return steps.select(
        "message_id", "source", "external_id", F.col("s5").alias("normalized_text"), F.col("s6").alias("model_text"), F.col("h.quote").alias("quote_text"),
        T.script_language(F.col("s6")).alias("language"), T.rejections(F.col("s6"), T.has_offset(F.col("published_at_raw"))).alias("rejection_reasons"), trace.alias("transformations"), *also,
    )
