"""Problem 10: texts read in a wrong character encoding, found and restored by mappings learned from twins.

Suspicious documents are picked in the JVM by characters and letter orders that clean text lacks. Their
clauses are joined with the clean clauses of all documents on the text that is left once everything but
ASCII is stripped, and on the lengths of the words (a garbled character may have become two). Of these
only true twins go on: clauses whose other characters follow one another in the same pattern of repeats,
which a change of encoding keeps. Aligning the characters of twins gives the mapping of each clean character.
Alignments that a pair of encodings explains as a whole make that pair a learned table and complete it;
alignments that none explains are one more table, character by character.

Only learned tables are applied to the suspicious segments of all records, those with more aligned
characters first: multi-byte ones to every run of non-ASCII characters that decodes without an error,
single-byte ones to segments whose letters make common bigrams of the corpus after them and not before.
This repeats, so texts garbled twice are restored too. Replacement characters, and words of question
marks, stand for lost text; they, and segments full of characters no clean text has that no learned table
restores, are found and stay as they are.

Defined results: null, empty and clean texts are not found; repeated rows are each found; a corpus without
twins teaches no table, so there only lost and unrestored texts are found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.lookalike import bigram_counts
from civicflow.session import materialize

#: The encodings a text may have been written and read in: the space of tables that alignments may confirm.
WRITTEN = ("utf-8", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
READ = ("cp1251", "cp1252", "latin-1", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "cp437", "mac-roman", "cp1250", "iso8859-15")
PAIRS = tuple((w, r) for w in WRITTEN for r in READ if w != r)
ALIGNED = "aligned"  # the table of alignments that no pair of encodings explains
MIN_ALIGNED = 12  # characters that a clause must have for its pattern of repeats to tell twins
MIN_FREE = 16  # characters that make the free alignments a table
COMMON_BIGRAMS = 80  # the commonest Russian bigrams of the corpus, about three of five uses
SUSPICIOUS = (
    "[\\x{80}-\\x{9F}\\x{AD}\\x{FFFD}]"
    "|[\\x{C0}-\\x{FF}\\x{A8}\\x{B8}]{3}"
    "|[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї╔-╬░-▓]"
    "|[ÂÃÐÑâð][\\x{80}-\\x{BF}ŒœŠšŸŽžƒˆ˜–-›€™]"
    "|[ВГв][‚„†‡€‰‹’“”•™›\\x{A0}¤¦§©«¬®°±µ¶·»]"
    "|[а-яё][А-ЯЁ]{2}|[А-ЯЁ]{4} ?[А-ЯЁ]{3,}"
)
#: One of these, or a run of Russian capitals, is in every garbled text: one character class, as the JVM reads all texts.
MAY_BE_GARBLED = "[\\x{80}-\\x{9F}\\x{AD}\\x{FFFD}ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї©╔-╬░-▓ÀÁÂÃÅÆÌÍÐÑÒÓÕØÝÞâãåæìíðñòóõøýþÿ]"
_SUSPICIOUS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SUSPICIOUS))
_PLAIN = re.compile(r"[А-яЁё]*")
_INVERTED = re.compile(r"[а-яё][А-ЯЁ]")
#: Characters that neither Russian or Latin text nor text garbled twice has.
_FOREIGN = re.compile(r"[^\x00-\xffЀ-џҐґ–-›€™№₽≈ŒœŠšŸŽžƒˆ˜☀-➿️‍\U0001F000-\U0001FAFF]")
_SEGMENT = re.compile(r"(?<=[.!?]) |\n")
_CLAUSE = re.compile(r"(?<=[.!?,]) |\n")  # twins are looked for clause by clause, so that more have one
_RUN = re.compile(r"[^\x00-\x7f]+")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+|\?")
_CYR = re.compile(r"[а-яё]{2,}")
#: Words of question marks: at least two in a row, or a long one, that follow no word.
_LOST = re.compile(r"(?<![\w?!.,;:)»])\?{2,}(?:[ \n«»,.:;()-]+\?+)+|(?<![\w?!.,;:)»])\?{5,}")
MAY_BE_LOST = r"(?:^|[\s(«-])\?\?"
#: Characters of garbled text that clean text hardly has, for segments that no learned table restores.
_STRANGE = re.compile(r"[\x80-\x9f\xadЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї╔-╬░-▓]|[ÂÃÐÑâð][\x80-\xbfŒœŠšŸŽžƒˆ˜–-›€™]")


def to_bytes(text: str, codec: str) -> bytes:
    """Bytes that ``codec`` read as this text; bytes it leaves undefined had been passed through."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(codec)
            except UnicodeEncodeError:
                if not "\x80" <= ch <= "\x9f":
                    raise
                out.append(ord(ch))
        return bytes(out)


def russian(text: str, common: frozenset[str]) -> tuple[float, int]:
    """Share of the common bigrams among the Cyrillic ones, and the number of these."""
    hits = total = 0
    for word in _CYR.findall(text.lower()):
        total += len(word) - 1
        hits += sum(word[k : k + 2] in common for k in range(len(word) - 1))
    return (hits / total if total else 0.0), total


def _undo_runs(segment: str, read: str) -> tuple[str, int, int]:
    """The segment with all runs decoded that decode to plain characters; their number, and that of all runs."""
    done = seen = 0

    def one(m: re.Match) -> str:
        nonlocal done, seen
        run = m[0]
        if _PLAIN.fullmatch(run):
            return run
        seen += 1
        try:
            text = to_bytes(run, read).decode("utf-8")
        except UnicodeError:
            return run
        if len(text) < len(run) and not _FOREIGN.search(text):
            done += 1
            return text
        return run

    return _RUN.sub(one, segment), done, seen


def _byte_table(written: str, read: str) -> dict[int, str]:
    table = {}
    for code in range(128, 256):
        byte = bytes([code])
        try:
            table[ord(byte.decode(read))] = byte.decode(written)
        except UnicodeError:
            continue
    return table


@dataclass(frozen=True)
class Learned:
    """What the twins taught: pairs of encodings, best first, the free table, and the corpus' common bigrams."""

    pairs: tuple[tuple[str, str], ...]
    free: dict[int, str]
    common: frozenset[str]

    def tables(self) -> list[tuple[str, str, dict[int, str] | None]]:
        """(kind, encoding read, byte table or None for multi-byte) of each learned transformation."""
        out = [(f"{w}>{r}", r, None if w == "utf-8" else _byte_table(w, r)) for w, r in self.pairs]
        return out + ([(ALIGNED, "", self.free)] if self.free else [])


def restore_segment(segment: str, tables: list, common: frozenset[str], known: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """The segment with its encoding errors undone, and the transformations that were undone; those
    ``known`` from other segments of the text need no clear gain."""
    undone: list[str] = []
    for _ in range(3):
        if not _SUSPICIOUS.search(segment):
            break
        before, n = russian(segment, common)
        best: tuple | None = None
        for rank, (kind, read, table) in enumerate(tables):
            if table is None:
                text, done, seen = _undo_runs(segment, read)
                if done and (best is None or best[0] < (done, 0, 0, -rank)):
                    best = ((done, 0, 0, -rank), text, kind)
                    if done == seen:
                        break
            elif best is None or best[0][0] == 0:
                text = segment.translate(table)
                after, m = russian(text, common)
                if text == segment or _INVERTED.search(text):
                    continue
                clear = m >= 14 and after >= 0.4 and (m >= 2 * n or before < 0.4 and after - before >= 0.15)
                if clear or (kind in known and m and after >= before):
                    gain = (0, round(after * m), m, -rank)
                    if best is None or gain > best[0]:
                        best = (gain, text, kind)
        if best is None:
            break
        segment = best[1]
        undone.append(best[2])
    return segment, undone


def restore(text: str, tables: list, common: frozenset[str]) -> tuple[str, list[str], int, int]:
    """(restored text, transformations undone, characters lost, strange characters left)."""
    kinds: frozenset[str] = frozenset()
    pieces = re.split(r"((?<=[.!?]) |\n)", text)
    for _ in range(2):  # the second time with what the first has found
        found = []
        for k in range(0, len(pieces), 2):
            pieces[k], undone = restore_segment(pieces[k], tables, common, kinds)
            found += undone
        if not found:
            break
        kinds |= frozenset(found)
    strange = max((len(_STRANGE.findall(p)) for p in pieces[::2]), default=0)
    out = "".join(pieces)
    return out, sorted(kinds), out.count("\ufffd") + sum(m[0].count("?") for m in _LOST.finditer(out)), strange


def repeats(units: Sequence[str]) -> str:
    """The pattern of repeats: for each unit the place of its first use. A one-to-one mapping keeps it."""
    first: dict[str, int] = {}
    return " ".join(str(first.setdefault(u, len(first))) for u in units)


def units_of(clause: str, width: int) -> list[str] | None:
    """The non-ASCII characters of a clause, ``width`` at a time; None if a run of them is no multiple."""
    runs = _RUN.findall(clause)
    if any(len(r) % width for r in runs):
        return None
    return [r[k : k + width] for r in runs for k in range(0, len(r), width)]


def align(garbled: str, clean: str) -> list[tuple[str, str, str]]:
    """(transformation, clean character, its garbled characters): for each pair of encodings that explains
    every word that differs, else, where no character is as it was, for the characters side by side."""
    words = list(zip(garbled.replace("?", "").split(" "), clean.replace("?", "").split(" "), strict=False))
    changed = [(g, c) for g, c in words if g != c]
    out = []
    for written, read in PAIRS:
        found = []
        try:
            for g, c in changed:
                pieces = [ch if ch < "\x80" else _read(ch.encode(written), read) for ch in c]
                if "".join(pieces) != g:
                    break
                found += [(f"{written}>{read}", ch, p) for ch, p in zip(c, pieces, strict=True) if ch >= "\x80"]
            else:
                out += found
        except UnicodeError:
            continue
    if not out and len(garbled) == len(clean) and garbled.lower() != clean.lower():
        sides = [(c, g) for g, c in zip(garbled, clean, strict=True) if c >= "\x80"]
        out = [(ALIGNED, c, g) for c, g in sides] if all(c != g for c, g in sides) else []
    return out


def _read(data: bytes, codec: str) -> str:
    """The bytes as ``codec`` reads them; those it leaves undefined are passed through."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data)


_TWIN = "twin bigint, pattern string, clause string"


def _twins(batches: Iterator[pa.RecordBatch], garbled: bool) -> Iterator[pa.RecordBatch]:
    """(twin, pattern, clause) of the (twin, clause) rows with enough characters: clean clauses once, garbled
    ones by single and by double characters."""
    for batch in batches:
        rows = []
        for twin, clause in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not garbled and _SUSPICIOUS.search(clause):
                continue
            for width in (1, 2) if garbled else (1,):
                units = units_of(clause, width)
                if units is not None and len(units) >= MIN_ALIGNED:
                    rows.append((twin, repeats(units), clause))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        kinds = (pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["twin", "pattern", "clause"])


def learn(documents: DataFrame, suspects: DataFrame, column: str = "text") -> DataFrame:
    """(kind, clean, garbled, n): how often twins align a clean character with garbled ones."""

    def clauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                for clause in _CLAUSE.split(text):
                    if not _SUSPICIOUS.search(clause):
                        continue
                    words = clause.split(" ")
                    ascii_only = [len(_RUN.sub("", w)) for w in words]
                    for width in (1, 2):
                        more = [len(w) - n for w, n in zip(words, ascii_only, strict=True)]
                        if not any(m % width for m in more):
                            rows.append((_NOT_ASCII.sub("", clause), [n + m // width for n, m in zip(ascii_only, more, strict=True)], clause))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = (pa.string(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rest", "lengths", "clause"])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter = Counter()
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                votes.update(align(g, c))
            keys = list(zip(*votes, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(votes.values(), pa.int64())], names=["kind", "clean", "garbled", "n"])

    garbled = suspects.select(column).mapInArrow(clauses, "rest string, lengths array<int>, clause string").select(F.xxhash64("rest", "lengths").alias("twin"), "clause").distinct()
    garbled = materialize(garbled, "garbled-clauses")
    pieces = documents.select(F.explode(F.split(column, _CLAUSE.pattern)).alias("c")).where((F.length("c") >= MIN_ALIGNED) & (F.octet_length("c") >= F.length("c") + MIN_ALIGNED))
    rest = F.regexp_replace("c", r"[^\x00-\x7F]+|\?", "")
    lengths = F.expr("transform(split(c, ' '), w -> length(w))")
    # A twin key holds many texts where clauses follow a template; only distinct ones with the same pattern meet.
    clean = pieces.select(F.xxhash64(rest, lengths).alias("twin"), "c").join(garbled.select("twin").distinct(), "twin", "left_semi").distinct()
    left = garbled.mapInArrow(lambda b: _twins(b, True), _TWIN).withColumnRenamed("clause", "g").distinct()
    right = clean.mapInArrow(lambda b: _twins(b, False), _TWIN).withColumnRenamed("clause", "c")
    pairs = left.join(right, ["twin", "pattern"]).where("g <> c").select("g", "c")
    return pairs.mapInArrow(vote, "kind string, clean string, garbled string, n bigint").groupBy("kind", "clean", "garbled").agg(F.sum("n").alias("n"))


def _suspects(rows: DataFrame, column: str) -> DataFrame:
    gate = F.col(column).rlike(MAY_BE_GARBLED) | F.col(column).rlike("[А-ЯЁ]{4}") | (F.col(column).contains("??") & F.col(column).rlike(MAY_BE_LOST))
    return materialize(rows.where(gate), "garbled-suspects")


def common_bigrams(rows: DataFrame, column: str) -> frozenset[str]:
    counts = {g: n for g, n in bigram_counts(rows, column).items() if _CYR.fullmatch(g)}
    return frozenset(sorted(counts, key=lambda g: (-counts[g], g))[:COMMON_BIGRAMS])


def taught(votes: list[tuple[str, str, str, int]], common: frozenset[str]) -> Learned:
    """The tables of (kind, clean, garbled, n) votes: every pair of encodings with a vote, and of the free
    alignments the characters that twice or more, and in four of five cases, stand for one and the same."""
    total: Counter = Counter()
    free: dict[str, Counter] = defaultdict(Counter)
    for kind, clean, garbled, n in votes:
        total[kind] += n
        if kind == ALIGNED:
            free[garbled][clean] += n
    pairs = sorted((k for k in total if k != ALIGNED), key=lambda k: (-total[k], k))
    learned = tuple((w, r) for w, r in (k.split(">") for k in pairs))
    told = {(chr(g), c) for w, r in learned if w != "utf-8" for g, c in _byte_table(w, r).items()}
    table = {}
    for g, cleans in free.items():
        clean, n = max(cleans.items(), key=lambda x: (x[1], x[0]))
        if n >= 2 and n >= 0.8 * sum(cleans.values()) and (g, clean) not in told:
            table[ord(g)] = clean
    # Most of an alphabet makes a table; less is left over from twins that differ in a letter.
    return Learned(learned, table if len(table) >= MIN_FREE else {}, common)


def learned_mappings(documents: DataFrame, column: str = "text") -> DataFrame:
    """(kind, clean, garbled, n): the character mappings that twins taught."""
    rows = documents.select(column)
    return learn(rows, _suspects(rows, column), column)


def restored_documents(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, restored, kinds, lost, strange) of every document with garbled text."""
    rows = documents.select(F.col(key), F.col(column).alias("text"))
    suspects = _suspects(rows, "text")
    # At most one row for each pair of encodings and two characters of the alphabets.
    votes = [(r.kind, r.clean, r.garbled, r.n) for r in learn(rows, suspects).collect()]
    learned = taught(votes, common_bigrams(rows, "text"))
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = learned.tables()
        for batch in batches:
            keep, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                fixed, kinds, lost, strange = restore(text, tables, learned.common)
                if kinds or lost or strange >= 3:
                    keep.append(k)
                    out.append((fixed, kinds, lost, strange))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "restored", "kinds", "lost", "strange"]
            )

    return suspects.mapInArrow(run, f"`{key}` {kind}, restored string, kinds array<string>, lost int, strange int")
