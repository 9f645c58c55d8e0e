"""Column functions for cleaning, fingerprinting and comparing texts; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that the sites add to a text, and words that mark a repeated complaint.
TECHNICAL_LINES = ("ответить", "показать полностью", "читать далее", "развернуть", "свернуть")
RECURRENCE_MARKERS = ("снова", "опять", "повторно", "до сих пор", "уже неделю", "уже месяц", "не первый раз")
#: Query parameters that only track.
TRACKING = "^(utm_[^=]*|fbclid|gclid|yclid|_openstat|mc_cid|mc_eid)(=|$)"
TOKEN = r"[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*"
CYRILLIC, LATIN = "[^а-яА-ЯёЁ]", "[^a-zA-Z]"
MAX_CHARS, MIN_CHARS = 200_000, 2


def remove_controls(c: Column) -> Column:
    """Drop control, format and private characters but line feed and tab."""
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}&&[^\n\t]]", "")


def normalize_whitespace(c: Column) -> Column:
    """One kind of line end, single blanks, no blanks at line ends, at most one empty line, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0B\x{A0}]{2,}|[\t\f\x0B\x{A0}]", " ")  # not a match for every single blank
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def drop_technical_lines(c: Column, lines: tuple[str, ...] = TECHNICAL_LINES) -> Column:
    kept = F.filter(F.split(c, "\n"), lambda line: ~F.lower(F.trim(line)).isin(*lines))
    return F.array_join(kept, "\n")


def quoted_lines(c: Column) -> Column:
    """Lines that quote another message with a leading angle."""
    return F.filter(F.split(c, "\n"), lambda line: F.ltrim(line).startswith(">"))


def without_quotes(c: Column) -> Column:
    """The text without quoting lines and quote blocks; an unterminated block runs to the end."""
    c = F.regexp_replace(c, r"(?s)\[quote\].*?(\[/quote\]|$)", "")
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~F.ltrim(line).startswith(">")), "\n")


def script_language(c: Column) -> Column:
    """ru or en by four fifths of the letters, else mixed; fewer than three letters are unknown."""
    cyr, lat = F.length(F.regexp_replace(c, CYRILLIC, "")), F.length(F.regexp_replace(c, LATIN, ""))
    n = cyr + lat
    return F.when(F.coalesce(n, F.lit(0)) < 3, "unknown").when(cyr >= 0.8 * n, "ru").when(lat >= 0.8 * n, "en").otherwise("mixed")


def canonical_url(c: Column) -> Column:
    """Lower scheme and host, no fragment, no tracking parameters, sorted parameters, no final slash."""
    whole = F.split_part(c, F.lit("#"), F.lit(1))
    base = F.split_part(whole, F.lit("?"), F.lit(1))
    origin = F.regexp_extract(base, "^[^:/]+://[^/]*", 0)
    path = F.regexp_replace(F.substring(base, F.length(origin) + 1, F.length(base)), "/+$", "")
    parameters = F.filter(F.split(F.split_part(whole, F.lit("?"), F.lit(2)), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(parameters), "&")
    return F.concat(F.lower(origin), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def identity_digest(source: Column, external_id: Column) -> Column:
    return F.sha2(F.concat(F.lower(source), F.lit("\x00"), external_id), 256)


def stable_id(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def token_jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(0.0)


def bands(simhash: Column) -> Column:
    """Four (number, 16 bits) bands of a 64-bit hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("band"), F.call_function("shiftrightunsigned", simhash, i * 16).bitwiseAND(F.lit(65535)).alias("bits")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rejections(text: Column, has_time: Column) -> Column:
    """Reasons to reject a message, in fixed order; an empty list accepts it."""
    return F.array_compact(
        F.array(
            F.when(F.length(text) > MAX_CHARS, "TEXT_TOO_LONG"),
            F.when(F.coalesce(F.length(text), F.lit(0)) < MIN_CHARS, "MODEL_TEXT_TOO_SHORT"),
            F.when(~has_time, "PUBLISHED_AT_MISSING_TIMEZONE"),
        )
    )


def has_recurrence_marker(c: Column) -> Column:
    def found(low: Column) -> Column:
        out = F.lit(False)
        for marker in RECURRENCE_MARKERS:
            out = out | F.coalesce(F.contains(low, F.lit(marker)), F.lit(False))
        return out

    return F.exists(F.array(F.lower(c)), found)  # lower case is made once, not for every marker


def has_offset(raw: Column) -> Column:
    """Whether a raw time names its zone; times without one are not guessed."""
    return F.coalesce(raw.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), F.lit(False))


def epoch_or_iso(raw: Column) -> Column:
    """Seconds or milliseconds since 1970, or an ISO time; anything else is null."""
    number = F.try_to_number(raw, F.lit("9999999999999999"))
    seconds = F.when(number > 10_000_000_000, number / 1000).otherwise(number)
    return F.when(raw.rlike(r"^\d{9,16}$"), F.timestamp_seconds(seconds.cast("double"))).otherwise(F.try_to_timestamp(raw))


#: Hosts and literal addresses of private, loopback, link-local, shared, multicast and reserved networks.
_PRIVATE_HOST = (
    r"(?i)^https?://(?:localhost|[^/:?#]*\.localhost|0\.|10\.|127\.|169\.254\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\."
    r"|172\.(?:1[6-9]|2\d|3[01])\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|(?:22[4-9]|2[34]\d|25[0-5])\."
    r"|\[(?:::1?\]|::ffff:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:))"
)


def safe_url(url: Column) -> Column:
    """Whether a web address may be fetched: http or https, no user, port 80 or 443, no private network by its text.

    Names are not resolved, so a public name of a private address passes; null stays null."""
    host = r"(?:\[[0-9a-fA-F:.]+\]|[^/@:?#\[\]]+)"
    return url.rlike(rf"(?i)^https?://{host}(?::(?:80|443))?(?:[/?#][^@]*)?$|(?i)^https?://{host}(?::(?:80|443))?[/?#]") & ~url.rlike(_PRIVATE_HOST)
