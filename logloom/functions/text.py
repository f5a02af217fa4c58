r"""Message-text functions as Column expressions; everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = "IEWASDX"
_RANK = {"A": 7, "E": 6, "W": 5, "S": 4, "D": 3, "X": 2, "I": 1}

#: First message id of a text: 2-8 upper-case characters, 1-5 digits, a severity letter, then a blank or the end.
MSGID_IN_TEXT = (
    r"\A(?:[^A-Z$]++|[A-Z$](?![A-Z$#@])|[A-Z$][A-Z$#@]{8,}+|[A-Z$][A-Z$#@]{1,7}+(?![A-Z$#@])"
    r"(?:(?![0-9])|[0-9]{6,}+|[0-9]{1,5}+(?![0-9])(?:(?![IEWASDX])|[IEWASDX](?![ \t\n]|\z))))*+"
    r"([A-Z$][A-Z$#@]{1,7}[0-9]{1,5}[IEWASDX])(?=[ \t\n]|\z)"
)
MSGID_IN_TEXT_ANY_SEVERITY = r"(?<![A-Z$#@0-9])([A-Z$][A-Z$#@]{1,7}[0-9]{1,5}[IEWASDX]?)(?=[ \t\n]|\z)"
#: Id at the start of a manual's line.
MSGID_AT_START = r"\A[ \t]*+([A-Z$#@]{2,8}+(?:_[A-Z0-9_]{2,}+[xX]?|[0-9]{1,5}+[IEWASDX]?+))(?=[ \t\n]|\z)"
MSGID_TOKEN = r"\A[A-Z$#@]{2,8}[0-9]{1,5}[A-Z]?\z"
_BLANKS = r"\A[ \t\r\n]+|[ \t\r\n]+\z"


def extract_msgid(text: Column, severity_optional: bool = False) -> Column:
    """First message id in the text, '' if none."""
    return F.regexp_extract(text, MSGID_IN_TEXT_ANY_SEVERITY if severity_optional else MSGID_IN_TEXT, 1)


def extract_leading_msgid(line: Column) -> Column:
    """Message or code id that starts a manual's line, '' if none."""
    return F.regexp_extract(line, MSGID_AT_START, 1)


def looks_like_msgid(token: Column) -> Column:
    return token.rlike(MSGID_TOKEN)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, "")


def snippet(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def severity_of(msgid: Column, strict: bool = True) -> Column:
    """Last character of an id; when strict, ' ' unless it is a severity letter."""
    last = F.right(msgid, F.lit(1))
    return F.when(last.isin(*SEVERITIES), last).otherwise(F.lit(" ")) if strict else last


def severity_rank(severity: Column) -> Column:
    out = None
    for letter, rank in _RANK.items():
        out = F.when(severity == letter, rank) if out is None else out.when(severity == letter, rank)
    return out.otherwise(0)


def tier(severity: Column) -> Column:
    return F.when(severity.isin("A", "E"), "critical").when(severity == "W", "warning").otherwise("info")


def excerpt(sample: Column, msgid: Column) -> Column:
    """The sample text after its leading id and one more character."""
    cut = F.length(msgid) + 1
    return trim(F.when(F.length(sample) > cut, F.substring(sample, cut + 1, F.length(sample))).otherwise(sample))


def base_filename(filename: Column) -> Column:
    """The path without a '[chunk N]' or '[MSGID]' suffix at its end."""
    return F.regexp_replace(filename, r" \[(?:chunk [0-9]+|[A-Z$#@0-9_xX]+)\]\z", "")


def msgid_list(ids: Column) -> Column:
    """Distinct ids in first-seen order, comma separated."""
    return F.array_join(F.array_distinct(F.filter(ids, lambda x: x != "")), ",")


def join_some(values: Column, most: int = 4) -> Column:
    """The first values, comma separated, with '...' for the rest."""
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(F.size(values) > most, ", ...").otherwise(""))


def one_line(text: Column) -> Column:
    """Text for a one-line JSON field: newline, tab and control characters to blanks, carriage return dropped."""
    return F.regexp_replace(F.regexp_replace(text, "\r", ""), r"[\x00-\x1F]", " ")


def cache_escape(text: Column) -> Column:
    r"""Backslash, tab and newline as \\, \t and \n."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def cache_unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def minute_of_day(ts: Column) -> Column:
    """HH:MM... as minutes, 0 where it is shorter than five characters or not a number."""
    hour, minute = F.try_to_number(F.substring(ts, 1, 2), F.lit("99")), F.try_to_number(F.substring(ts, 4, 2), F.lit("99"))
    return F.when(F.length(ts) < 5, 0).otherwise(F.coalesce(hour * 60 + minute, F.lit(0))).cast("int")


def full_date(julian_date: Column) -> Column:
    """yyDDD (of this century) as yyyyDDD; anything else as it is."""
    return F.when(F.length(julian_date) == 5, F.concat(F.lit("20"), julian_date)).otherwise(julian_date)


def event_time(julian_date: Column, ts: Column) -> Column:
    """yyyyDDD (or yyDDD, of this century) and HH:MM:SS.hh as a timestamp; null if malformed."""
    return F.try_to_timestamp(F.concat(full_date(julian_date), ts), F.lit("yyyyDDDHH:mm:ss.SS"))
