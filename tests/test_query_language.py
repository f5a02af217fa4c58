import pytest

from logloom.operators.keyword import KeywordQuery, timeline_bounds, wildcard_to_like
from logloom.plans.query import HYBRID, KEYWORD, SEMANTIC, Options, overlay, parse_query

GOLDEN = [
    ("IEF450I", KEYWORD, dict(msgid="IEF450I"), ""),
    ("DFH*", KEYWORD, dict(msgid="DFH*"), ""),
    ("JOB:PAYROLL", KEYWORD, dict(jobname="PAYROLL"), ""),
    ("sev:e", KEYWORD, dict(severity="E"), ""),
    ("MSGID:IEF* JOB:PAY* abend", HYBRID, dict(msgid="IEF*", jobname="PAY*"), "abend"),
    ("TYPE:operlog reboot", HYBRID, dict(source_type="operlog"), "reboot"),
    ("SYS:", KEYWORD, {}, ""),
    ("IEC030I data management error", HYBRID, dict(msgid="IEC030I"), "data management error"),
    ("DFH* storage", HYBRID, dict(msgid="DFH*"), "storage"),
    ("S0C7", HYBRID, dict(text="S0C7"), "S0C7"),
    ("CICS", HYBRID, dict(text="CICS"), "CICS"),
    ("ABEND_0C4", HYBRID, dict(text="ABEND_0C4"), "ABEND_0C4"),
    ("DB2", KEYWORD, dict(msgid="DB2"), ""),
    ("what?", KEYWORD, dict(msgid="what?"), ""),
    ("storage shortage during batch", SEMANTIC, {}, "storage shortage during batch"),
    ("ief450i", SEMANTIC, {}, "ief450i"),
    ("MVS abend codes", SEMANTIC, {}, "MVS abend codes"),
    ("17:30 JOB:X", SEMANTIC, {}, "17:30 JOB:X"),
]


@pytest.mark.parametrize("text,mode,fields,rest", GOLDEN)
def test_classification(text, mode, fields, rest):
    got = parse_query(text)
    assert (got.mode, got.keyword, got.text) == (mode, KeywordQuery(**fields), rest)


def test_options_promote_or_not():
    plain = parse_query("storage shortage")
    assert overlay(plain, Options(job="PAY*")).mode == HYBRID
    assert overlay(plain, Options(since="10:00", source_type="operlog")).mode == SEMANTIC
    assert overlay(plain, Options(mode=KEYWORD)).mode == KEYWORD
    assert overlay(parse_query("JOB:X"), Options(severity="e")).keyword == KeywordQuery(jobname="X", severity="E")


def test_wildcards_and_bounds():
    assert wildcard_to_like("DFH*") == "DFH%"
    assert wildcard_to_like("IE?030I") == "IE_030I"
    assert wildcard_to_like("a\\b") == "a\\\\b"
    assert timeline_bounds("00:05") == ("00:00:00.00", "00:15:59.99")
    assert timeline_bounds("23:55") == ("23:45:00.00", "23:59:59.99")
