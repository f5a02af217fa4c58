"""The query language: KEY:VALUE tokens, wildcards and free text, plus explicit options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..operators.keyword import KeywordQuery

KEYWORD, SEMANTIC, HYBRID = "keyword", "semantic", "hybrid"

_KEYS = {
    "MSGID": "msgid", "MSG": "msgid", "JOB": "jobname", "SYS": "sysname", "SEV": "severity", "SEVERITY": "severity",
    "DATE": "julian_date", "TYPE": "source_type",
}
_MSGID = re.compile(r"[A-Z$#@]{2,8}[0-9]{1,5}[A-Z]?\Z")


@dataclass(frozen=True)
class ParsedQuery:
    mode: str
    text: str = ""
    keyword: KeywordQuery = field(default_factory=KeywordQuery)


def looks_like_msgid(token: str) -> bool:
    return bool(_MSGID.match(token))


def has_wildcards(token: str) -> bool:
    return "*" in token or "?" in token


def no_lower_case(token: str) -> bool:
    return not any("a" <= c <= "z" for c in token)


def parse_query(query: str) -> ParsedQuery:
    """Classify a query; see the tests for the golden cases."""
    rest, fields = query.strip(" \t"), {}
    structured = False
    while rest:
        token, _, after = rest.partition(" ")
        key, colon, value = token.partition(":")
        name = _KEYS.get(key.upper()) if colon and 1 <= len(key) <= 10 else None
        if name is None:
            break
        fields[name] = value[:1].upper() if name == "severity" else value
        structured, rest = True, after.lstrip(" ")
    kq = KeywordQuery(**fields)
    if structured:
        return ParsedQuery(HYBRID if rest else KEYWORD, rest, kq)

    first, _, others = rest.partition(" ")
    others = others.strip(" ")
    if not others:
        if first and has_wildcards(first):
            return ParsedQuery(KEYWORD, "", KeywordQuery(msgid=first))
        if first and no_lower_case(first) and looks_like_msgid(first):
            return ParsedQuery(KEYWORD, "", KeywordQuery(msgid=first))
        if first and no_lower_case(first) and len(first) <= 20:
            return ParsedQuery(HYBRID, first, KeywordQuery(text=first))
        return ParsedQuery(SEMANTIC, rest)
    base = first.replace("*", "").replace("?", "")
    if no_lower_case(first) and (looks_like_msgid(first) or has_wildcards(first) and 2 <= len(base) <= 8):
        return ParsedQuery(HYBRID, others, KeywordQuery(msgid=first))
    return ParsedQuery(SEMANTIC, rest)


@dataclass(frozen=True)
class Options:
    """Explicit options override what the query says; since, before and source_type do not change the mode."""

    msgid: str = ""
    job: str = ""
    sys: str = ""
    severity: str = ""
    date: str = ""
    since: str = ""
    before: str = ""
    source_type: str = ""
    mode: str = ""
    k: int = 5


def overlay(parsed: ParsedQuery, o: Options) -> ParsedQuery:
    given = {"msgid": o.msgid, "jobname": o.job, "sysname": o.sys, "severity": o.severity[:1].upper(), "julian_date": o.date}
    given = {k: v for k, v in given.items() if v}
    quiet = {k: v for k, v in {"ts_after": o.since, "ts_before": o.before, "source_type": o.source_type}.items() if v}
    mode = parsed.mode
    if given and mode == SEMANTIC:
        mode = HYBRID if parsed.text else KEYWORD
    return ParsedQuery(o.mode or mode, parsed.text, replace(parsed.keyword, **given, **quiet))
