"""Operators over the whole corpus: Jaccard join, substrings, language model, mixing, pipeline."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import jaccard_join, lm_scoring, mixing, substring_dedup
from logloom.llm.components import components
from logloom.llm.elias_fano import EliasFano, Level, Packed, quantise, restore
from logloom.llm.packing import pack, ranked, unpack
from logloom.llm.wordhash import ngram_hashes, word_hashes, word_spans

DOCS = "doc_id long, text string, lang string, source string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


# ---- building blocks ------------------------------------------------------------------------


def test_packing():
    r = np.random.default_rng(0)
    columns = [np.sort(r.integers(0, 2**63, 100)).astype(np.uint64), r.integers(-5, 5, 7), np.zeros(0, np.int64), np.array([2**64 - 1], np.uint64)]
    back = unpack(pack(*columns))
    assert [b.tolist() for b in back] == [c.astype(np.int64).view(np.uint64).tolist() if c.dtype != np.uint64 else c.tolist() for c in columns]


def test_ranked():
    column = np.array([5, 5, -3, 5, 900, -3])
    table, place = ranked(column)
    assert table[place].tolist() == column.tolist() and table[:2].tolist() == [5, -3]
    assert [x.tolist() for x in ranked(column[:0])] == [[], []]


def test_word_hashes():
    texts = ["a bc a", "", "bc", " x\ty ", "é a"]
    raw = b"".join(t.encode() for t in texts)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    s, e, n = word_spans(raw, off)
    assert n.tolist() == [3, 0, 1, 2, 2]
    found = [raw[a:b].decode() for a, b in zip(s, e)]
    assert found == ["a", "bc", "a", "bc", "x", "y", "é", "a"]
    h = word_hashes(raw, s, e)
    assert len({(w, int(x)) for w, x in zip(found, h)}) == len(set(found)) == len(set(h.tolist()))
    assert len(ngram_hashes(h, 3)) == 6 and len(ngram_hashes(h, 9)) == 0


def test_elias_fano_and_levels():
    r = np.random.default_rng(1)
    for top in (1, 100, 10**9):
        v = np.sort(r.integers(0, top, 500))
        assert (EliasFano(v)[np.arange(500)] == v).all()
    for bits in (1, 7, 31, 63):
        v = r.integers(0, 2**bits, 300).astype(np.uint64)
        assert (Packed(v, bits)[np.arange(300)] == v).all()
    fan = r.integers(0, 6, 50)
    child = np.concatenate([np.sort(r.choice(90, k, replace=False)) for k in fan])
    level = Level(fan, child, 90, p=r.random(len(child)))
    parent = np.repeat(np.arange(50), fan)
    assert (level.find(parent, child) == np.arange(len(child))).all()
    have = set(zip(parent.tolist(), child.tolist()))
    p, c = r.integers(-1, 50, 2000), r.integers(0, 90, 2000)
    assert [(int(a), int(b)) in have for a, b in zip(p, c)] == (level.find(p, c) >= 0).tolist()
    x = -8 * r.random(50_000)
    assert (np.abs(restore(quantise(x)) - x) <= np.sqrt(-x) / 4000 + 1e-6).all()


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (20, 10), (10, 30)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 10, 20: 10, 30: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- Jaccard join -----------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = words(t)
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, n=150):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randint(0, 30))
    shared = [word() for _ in range(40)]
    rows = []
    bases = [[word() for _ in range(r.choice([6, 30, 80, 120]))] for _ in range(12)]
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.7 else [word() for _ in range(r.randint(0, 90))]
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            if w:
                w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = w + shared
        rows.append((i, r.choice([" ", "\n"]).join(w).title() if r.random() < 0.5 else " ".join(w), "en", "s"))
    return rows


@pytest.mark.parametrize("seed,block,hot,flush", [(1, 2048, 256, 1_000_000), (2, 8, 3, 2_000), (3, 3, 2, 700)])
def test_jaccard_against_brute_force(spark, monkeypatch, seed, block, hot, flush):
    monkeypatch.setattr(jaccard_join, "_FLUSH", flush)
    rows = near_copies(seed) + [(500, None, "", ""), (501, "", "", ""), (502, "a b", "", ""), (503, "A  B", "", ""), (504, "a b c", "", ""), (505, "x y z w v", "", ""), (506, "X y z w v", "", "")]
    rows += [rows[3], rows[3], rows[3], (rows[4][0], rows[7][1], "", ""), (None, "a b", "", "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash")).repartition(5)
    got = jaccard_join.join(df, list_block=block, hot=hot, portion=block).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_shingles"] is None and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}


def test_jaccard_hot_shingle_is_one_count_a_block(monkeypatch):
    """A line in a third of all documents: the range of its shingles gets counts, not documents."""
    monkeypatch.setattr(jaccard_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [f"own{i} a{i} b{i} c{i} d{i}" + (" the same line of seven words here" if i % 3 == 0 else "") for i in range(900)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(900)), "text": texts})
    out = [r for b in jaccard_join._emit_blocks("text", 5, 4, 64)(iter([batch])) for r in b.to_pylist()]
    waiting = [unpack(r["blob"]) for r in out if r["shard"] < 0]
    assert len(waiting) == 1 and len(waiting[0][0]) == 900
    parts = [unpack(r["blob"]) for r in out if r["shard"] >= 0]
    hot = {int(h): int(k) for p in parts for h, k in zip(p[3], p[4])}
    assert sorted(hot.values()) == [300] * 3
    assert max(np.bincount(np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)[1])) < 64


def test_skip_list_finds_all_and_skips_blocks():
    r = np.random.default_rng(2)
    n = np.sort(r.integers(5, 400, 3000))
    pos = (n * r.random(3000) * 0.21).astype(np.int64)
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    entries = jaccard_join.SkipList(n, pos, 80)
    whole = 0
    for i in range(0, 3000, 7):
        j = np.arange(i + 1, 3000)
        need = -(-80 * (n[i] + n[j]) // 180)
        fits = (100 * n[i] >= 80 * n[j]) & (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= need)
        assert entries.after(i).tolist() == j[fits].tolist()
        whole += max(0, (np.searchsorted(n, 100 * n[i] // 80, "right") - 1) // 64 - (i + 1) // 64 + 1)
    assert entries.visited < 0.95 * whole
    every = [(int(i), int(j)) for some in entries.pairs(500) for i, j in zip(*some)]
    assert every == [(i, int(j)) for i in range(3000) for j in entries.after(i)]
    tok = np.repeat(np.arange(60), 50)
    lists = jaccard_join.SkipList(*(np.concatenate([x[o] for o in (np.lexsort((pos[a : a + 50], n[a : a + 50])) + a for a in range(0, 3000, 50))]) for x in (n, pos)), 80)
    got = sorted((int(i), int(j)) for some in jaccard_join._pairs_within(tok, lists) for i, j in zip(*some))
    assert got == sorted((a + int(i), a + int(j)) for a in range(0, 3000, 50) for some in jaccard_join.SkipList(lists.n[a : a + 50], (lists.n - lists.left - 1)[a : a + 50], 80).pairs() for i, j in zip(*some))
    short = jaccard_join.SkipList(n[100:160], pos[100:160], 80)
    assert [(int(i), int(j)) for some in short.pairs() for i, j in zip(*some)] == [(i, int(j)) for i in range(60) for j in short.after(i)]


def test_jaccard_accepts_from_a_common_pivot():
    """Bounds by a common pivot accept and reject without the sets."""
    rows = {"tok": [5] * 4, "doc_id": [1, 2, 3, 4], "n": [100] * 4, "pos": [0] * 4, "comp": [1, 2, 3, 4], "pivot": [9, 9, 9, -1], "pivot_n": [100, 100, 100, 0], "over": [98, 97, 20, 0], "side": [0] * 4, "across": [False] * 4}
    got = {(x["a"], x["b"]): x["sure"] for x in jaccard_join._derive(80)(pa.table(rows)).to_pylist()}
    assert got == {(1, 2): True, (1, 4): False, (2, 4): False, (3, 4): False}


def test_jaccard_largest_class_meets_only_the_rest(spark):
    kind = "tok long, doc_id long, n long, pos long, comp long"
    label = spark.createDataFrame([(7, i, 50, 0, 1 if i < 1000 else i) for i in range(1003)], kind)
    best = spark.createDataFrame([], "b long, best struct<a:long,na:long,overlap:long>")
    dealt = jaccard_join._dealt(label, best, 100, 4).collect()
    major = [x for x in dealt if x["comp"] == 1]
    assert len(major) == 1000 and len(dealt) - len(major) == 3 * 10 + 3
    sizes = Counter((x["kind"], x["lo"], x["hi"]) for x in dealt)
    assert max(sizes.values()) < 200


def test_jaccard_empty(spark):
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0
    one = jaccard_join.join(spark.createDataFrame([(5, None, "", "")], DOCS)).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5)]


# ---- substrings -----------------------------------------------------------------------------------


def brute_units(text):
    """(start, next start, normalised, line, size) by one walk over the characters; shares nothing with the operator."""
    out, start, i, line = [], 0, 0, 0
    skip = lambda k, chars: next((j for j in range(k, len(text)) if text[j] not in chars), len(text))
    while i <= len(text):
        before, end = text[i - 1 : i], None
        if i == len(text):
            end = i
        elif text[i] in " \t" and before and before in ".!?,;:":
            end = skip(i, " \t")
        elif text[i] in "\r\n":
            end = skip(i, "\r\n")
        elif before and before in "。！？｡" and (skip(i, " \t") > i or text[i] not in "。！？｡」』”’）\r\n"):
            end = skip(i, " \t")
            end -= text[end : end + 1] != "" and text[end] in "。！？｡」』”’）\r\n"
        if end is None:
            i += 1
            continue
        w = text[start:i].split()
        if w:
            out.append((start, end, " ".join(w).casefold(), line, max(len(w), sum(map(len, w)) // 6)))
        line += any(c in "\r\n" for c in text[i:end])
        start, i = end, max(end, i + 1)
    return out


def brute_dedup(rows, min_line=0):
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        found, again = brute_units(t), []
        for u in found:
            again.append(u[2] in seen)
            seen.add(u[2])
        gone = [all(r for r, v in zip(again, found) if v[3] == u[3]) and sum(v[4] for v in found if v[3] == u[3]) >= min_line for u in found]
        for a in range(len(found)):
            for b in range(a + 1, len(found) + 1):
                if all(again[a:b]) and (a == 0 or not again[a - 1]) and (b == len(found) or not again[b]):
                    x, y = a, b
                    if any(found[k][4] >= 4 for k in range(a, b)):
                        x = next(k for k in range(a, b) if found[k][4] >= 4)
                        y = next(k for k in range(b, a, -1) if found[k - 1][4] >= 4)
                    if sum(found[k][4] for k in range(x, y)) >= 25:
                        gone[x:y] = [True] * (y - x)
        spans = []
        for k, u in enumerate(found):
            if gone[k]:
                spans = [*spans[:-1], (spans[-1][0], u[1])] if k and gone[k - 1] else [*spans, (u[0], u[1])]
        text = t
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        out[i] = (text, spans)
    return out


def test_units_keep_offsets():
    text = "One two. Three  four!\nFive six\r\n\n seven. "
    got = substring_dedup.units(text)
    assert [text[a:b].strip() for a, b, *_ in got] == ["One two.", "Three  four!", "Five six", "seven."]
    assert [u[2] for u in got] == [2, 2, 2, 1]
    assert substring_dedup.units("A b. C")[0][3] == substring_dedup.units("x y\na  B.")[1][3]


def test_substrings_against_brute_force(spark):
    r = random.Random(7)
    sentence = lambda n: " ".join("".join(r.choice("abcde") for _ in range(3)) for _ in range(n)).capitalize() + "."
    passages = [" ".join(sentence(r.randint(5, 15)) for _ in range(r.randint(1, 5))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [sentence(r.randint(1, 12)) for _ in range(r.randint(0, 6))]
        for _ in range(r.choice([0, 1, 1, 2])):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        rows.append((i, r.choice(["\n", " "]).join(parts), "en", "s"))
    rows += [(300, None, "", ""), (301, "", "", ""), rows[5], (None, passages[0], "", ""), (302, passages[1] * 50, "", "")]
    clash = {"removed": F.lit("clash"), "__id": F.lit("kept"), "__repeated": F.lit(1)}
    df = spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(4)
    for min_line in (0, 12):
        out = substring_dedup.dedup(df, min_line_words=min_line)
        assert out.columns == ["doc_id", "text", "lang", "source", "__id", "__repeated", "removed"]
        got = out.collect()
        assert len(got) == len(rows) and {x["__id"] for x in got} == {"kept"}
        want = brute_dedup(rows, min_line)
        for x in got:
            if x["doc_id"] is None:
                assert x["text"] == passages[0] and x["removed"] == []
            else:
                assert (x["text"] or "", [(s["start"], s["end"]) for s in x["removed"]]) == want[x["doc_id"]], x["doc_id"]
        assert any(s for _, s in want.values())
    assert substring_dedup.dedup(df, spans=False).columns == df.columns
    assert substring_dedup.dedup(df.where("doc_id < 0")).count() == 0


def test_op2_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_dedup([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = substring_dedup.op2_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    for x in got:
        said = [tuple(map(int, s.split("-"))) for c in ("removed", "removed_lines") if x[c] for s in x[c].split(",")]
        assert ((x["text"] or ""), sorted(said)) == want[x["doc_id"]] and x["n_passages"] <= x["n_removed"]
        assert x["n_removed"] == len(want[x["doc_id"]][1])


def test_substring_long_passage_goes_and_first_stays(spark):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(3, "Own text of three. " + passage + " More of three.", "", ""), (1, passage, "", ""), (2, "Alone here\n" + passage + "\nand after", "", "")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, DOCS), spans=False).collect()}
    assert got == {1: passage, 2: "Alone here\nand after", 3: "Own text of three. More of three."}


def test_substring_passage_pasted_between_words_goes_but_for_its_ends(spark):
    passage = ", ".join(" ".join(f"w{k}x{i}" for i in range(9)) for k in range(6))
    rows = [(1, "Host one begins " + passage + " and goes on.", "", ""), (2, "Another host here " + passage + " has more to say.", "", "")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, DOCS), spans=False).collect()}
    parts = passage.split(", ")
    assert got == {1: rows[0][1], 2: f"Another host here {parts[0]}, {parts[-1]} has more to say."}


def test_substring_short_lines_go_and_shared_sentences_stay(spark):
    rows = [(1, "Subscribe now\nOnly here one. Yes.", "", ""), (2, "Mine\nsubscribe  NOW\nYes. But not here.", "", ""), (3, "Subscribe now", "", ""), (4, "Only here one. Yes.\nx", "", "")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, DOCS), spans=False).collect()}
    assert got == {1: rows[0][1], 2: "Mine\nYes. But not here.", 3: "", 4: "x"}


def test_substring_text_without_blanks(spark):
    r = random.Random(4)
    sentence = lambda n, end: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n)) + end
    passage = "".join(sentence(30, "。") for _ in range(8))
    blank = " ".join(sentence(200, ".") for _ in range(2))
    own = [sentence(20, "。") for _ in range(4)]
    rows = [(1, passage + own[0], "", ""), (2, own[1] + passage + own[2], "", ""), (3, own[3] + passage[:31] + own[2], "", ""), (4, blank + " One.", "", ""), (5, "Two. " + blank + " Three.", "", "")]
    got = {x["doc_id"]: x["text"] for x in substring_dedup.dedup(spark.createDataFrame(rows, DOCS), spans=False).collect()}
    assert got == {1: rows[0][1], 2: own[1] + own[2], 3: rows[2][1], 4: rows[3][1], 5: "Two. Three."}


# ---- language model ---------------------------------------------------------------------------------


def brute_lm(rows, trained, mu=lm_scoring.MU):
    seqs = [(words(t) + [None], tr) for (_, t, *_), tr in zip(rows, trained)]
    c1, c2, c3, x1, x2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for s, tr in seqs:
        if tr:
            c1.update(s)
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
            x1.update(s[:-1])
            x2.update(list(zip(s, s[1:]))[:-1])
    z = sum(c1.values()) + len(c1) + 1
    out = []
    for s, _ in seqs:
        score = 0
        for i, w in enumerate(s):
            p = (c1[w] + 1) / z
            if i > 0:
                p = (c2[s[i - 1], w] + mu * p) / (x1[s[i - 1]] + mu)
            if i > 1:
                p = (c3[s[i - 2], s[i - 1], w] + mu * p) / (x2[s[i - 2], s[i - 1]] + mu)
            score += math.log10(p)
        out.append((len(s), sum(c1[w] > 0 for w in s), sum(c1.values()), sum(math.log10((c1[w] + 1) / z) for w in s), score))
    return out


@pytest.mark.parametrize("shards,block", [(1, 6 << 20), (5, 300), (40, 300)])
def test_language_model_against_brute_force(spark, shards, block):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(15)] + ["Été", "x"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60))), "", "") for i in range(60)] + [(100, None, "", ""), (101, "", "", ""), (102, "new words only", "", ""), (103, "w1", "", "")]
    trained = [i % 4 != 0 for i, *_ in rows]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).repartition(3)
    got = {x["doc_id"]: x for x in lm_scoring.score(df, F.col("doc_id") % 4 != 0, shards=shards, block_bytes=block).collect()}
    for (i, *_), (n, known, total, base, score) in zip(rows, brute_lm(rows, trained)):
        g = got[i]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (n, known, total)
        assert g["base_score"] == pytest.approx(base, rel=1e-12) and g["score"] == pytest.approx(score, rel=1e-3)


def test_language_model_spreads_a_hot_word(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["the", f"w{r.randint(0, 60)}", f"v{r.randint(0, 9)}"]) for _ in range(r.randint(1, 80))), "", "") for i in range(80)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {x["doc_id"]: x for x in lm_scoring.score(df, F.col("doc_id") % 5 != 0, shards=24, block_bytes=2000).collect()}
    for (i, *_), (n, known, total, base, score) in zip(rows, brute_lm(rows, [i % 5 != 0 for i in range(80)])):
        g = got[i]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (n, known, total)
        assert g["base_score"] == pytest.approx(base, rel=1e-12) and g["score"] == pytest.approx(score, rel=1e-3)
    # The bigrams of the hot word are dealt out: no shard has more than a third of them.
    texts = [t.encode() for _, t, *_ in rows]
    token, counts = lm_scoring._tokens(b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    words, token = np.unique(token, return_inverse=True)
    b = lm_scoring._Block(pack(words, np.arange(len(words)), token, counts, np.arange(80), np.zeros(80, np.int64), np.ones(80, np.int64)))
    hot = lm_scoring.Hot(words, np.bincount(token) / len(token), 24)
    route = lm_scoring._Route(b, 24, hot)
    the = word_hashes(b"the", np.array([0]), np.array([3]))[0]
    mine = b.words[b.w2a[route.order2]] == the
    per = [int(mine[x:y].sum()) for x, y in zip(route.two, route.two[1:])]
    assert the in hot.words and sum(per) > 50 and max(per) < sum(per) / 3


def test_sums_without_expansion():
    key, count = np.array([5, 3, 5, 9, 3]), np.array([10**12, 0, 2, 1, 4])
    assert [x.tolist() for x in lm_scoring._sum_by(key, count)] == [[3, 5, 9], [4, 10**12 + 2, 1]]
    assert [x.tolist() for x in lm_scoring._sum_by(key, count * 0)] == [[], []]


def test_language_model_edges(spark):
    assert lm_scoring.score(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0
    rows = [(None, "a b", "", ""), (2, "a b", "", ""), (2, "a b", "", "")]
    got = lm_scoring.score(spark.createDataFrame(rows, DOCS), F.lit(False)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["2", "2", "None"]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0.0 for r in got)


# ---- mixing ------------------------------------------------------------------------------------------


def brute_frame(quota, slots):
    done, out = {k: 0 for k in quota}, []
    for t in range(slots):
        free = [(-(-(done[k] + 1) * slots // n), k) for k, n in sorted(quota.items()) if done[k] < n and done[k] * slots // n <= t]
        out.append(min(free)[1])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("quota", [{"a": 50, "b": 30, "c": 20}, {"a": 97, "b": 1, "c": 1, "d": 1}, {"a": 100}])
def test_frame_is_earliest_deadline_first_and_fair(spark, quota):
    df = spark.createDataFrame([(k, n) for k, n in quota.items()], f"{mixing._KEY} string, quota int")
    got = [r[mixing._KEY] for r in mixing.frame(df, 100).orderBy("slot").collect()]
    assert got == brute_frame(quota, 100)
    for k, n in quota.items():
        done = np.cumsum([x == k for x in got])
        assert np.abs(done - np.arange(1, 101) * n / 100).max() < 1


def test_mixture(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(300)] + [(1000, "n", "", None), (1001, None, "", None), (5, "t5", "en", "big")]
    df = spark.createDataFrame(rows, DOCS).withColumn("mix_slot", F.lit("clash"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    for kind in (None, weights):
        for bucket in (None, 7):
            out = mixing.mix(df, kind, block_docs=4, slots=20, bucket_docs=bucket).collect()
            assert len(out) == len(rows)
            places = [(r["mix_slot"], r["mix_offset"]) for r in out]
            assert len(set(places)) == len(places)
            for source in ("big", "small", None):
                mine = sorted((r["mix_block"], r["mix_offset"]) for r in out if r["source"] == source)
                assert mine == [(i // 4, i % 4) for i in range(len(mine))]
    slots = {r["mix_slot"]: r["source"] for r in out}
    first = [slots.get(t) for t in range(20)]
    assert first.count("small") > 2 * first.count("big")
    assert mixing.mix(df.where("doc_id < 0")).count() == 0
    with pytest.raises(Exception, match="sources"):
        mixing.mix(spark.range(30).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source")), slots=20).collect()


def test_mixture_of_more_sources_than_slots(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("source"))
    out = mixing.mix(df, block_docs=2).collect()
    assert len(out) == 6000 and {r["mix_slot"] for r in out} == set(range(3000))
    assert len({(r["mix_slot"], r["mix_offset"]) for r in out}) == 6000
    first = Counter(r["source"] for r in out if r["mix_slot"] < 1500)
    assert max(first.values()) == 2


@pytest.mark.parametrize("sources", [1000, 1001, 1050])
def test_mixture_is_one_schedule_on_both_sides_of_a_thousand_sources(spark, sources):
    n_docs = {f"{i:04}": 400 if i == 7 else 40 if i % 100 == 3 else 3 + i % 4 for i in range(sources)}
    rows = [(i * 1000 + k, s) for i, (s, n) in enumerate(n_docs.items()) for k in range(n)]
    slots = 1000 + 10 * (sources - 1000)
    weight = {s: math.sqrt(n) for s, n in n_docs.items()}
    share = {s: round(w / sum(weight.values()) * (slots - sources), 6) for s, w in weight.items()}
    quota = {s: math.floor(x) + 1 for s, x in share.items()}
    for s in sorted(share, key=lambda s: (math.floor(share[s]) - share[s], s))[: slots - sum(quota.values())]:
        quota[s] += 1
    place = {s: [] for s in quota}
    for t, s in enumerate(brute_frame(quota, slots)):
        place[s].append(t)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=2).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in rows)
    for r in out:
        turn, k = divmod(r["mix_block"], quota[r["source"]])
        assert r["mix_slot"] == turn * slots + place[r["source"]][k]


def test_exact_mixture_follows_the_weights(spark):
    share = {"s0": 1 / 3, **{f"s{i}": 2 / 57 for i in range(1, 20)}}
    rows = [(i * 10_000 + k, s) for i, (s, w) in enumerate(share.items()) for k in range(round(9000 * w))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame(list(share.items()), "source string, weight double")
    out = mixing.mix(docs, weights, block_docs=1, exact=True, bucket_docs=500).orderBy("mix_slot").collect()
    assert [r["mix_slot"] for r in out] == list(range(len(rows)))
    for s, w in share.items():
        done = np.cumsum([r["source"] == s for r in out])[:8900]
        assert np.abs(done - np.arange(1, len(done) + 1) * w).max() < 2


def test_mixture_is_native(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "t", "", "s")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    line = lambda n=14: (" ".join(word() for _ in range(n)) + ".").capitalize()
    base = ["\n".join(line() for _ in range(6)) for _ in range(30)]
    passage = "\n".join(line() for _ in range(5))
    item = line(20)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "s0", len(t)) for i, t in enumerate(base[:5])]  # exact copies
    rows += [(200, base[6] + "\nmore.", "en", "s1", 0), (300, base[7] + "\n" + item, "en", "s1", 0), (301, "few words", "en", "s1", 0), (302, "### " * 100, "en", "s1", 0)]
    rows += [(400 + i, "\n".join(line() for _ in range(6)) + "\n" + passage, "en", "s2", 0) for i in range(3)]
    spark.createDataFrame(rows, DOCS + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(30), 400, 401, 402}
    assert all(out[i]["text"] == base[i] for i in range(30))
    assert passage in out[400]["text"] and passage not in out[401]["text"] and passage not in out[402]["text"]
    assert all(x["n_chars"] == len(x["text"]) for x in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "substring_dedup", "decontamination", "mixing"]


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(70)) + "."
    good = text()
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, good, "en", None, 0), (3, good, "en", None, 0), (None, good, "en", "b", 0), (4, "word " * 40_000, "en", "b", 0), (5, text() * 300, "en", "b", 0), (6, text(), None, "b", 0)]
    clash = {"_written_at": F.lit("w"), "__id": F.lit(1), "__hit": F.lit(2), "removed": F.lit("r"), "mix_slot": F.lit("m")}
    spark.createDataFrame(rows, DOCS + ", n_chars long").withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_written_at", "__id", "__hit", "removed", "mix_block", "mix_slot", "mix_offset"]
    got = out.collect()
    assert sorted(str(x["doc_id"]) for x in got) == ["3", "3", "6", "None"] and {x["_written_at"] for x in got} == {"w"}
    assert {x["text"] for x in got if x["doc_id"] != 6} == {good}
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).where("doc_id > 99")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_pipeline_mixes_by_the_weights_themselves(spark):
    import corpus_pipeline

    rows = [(i, f"s{i % 20}" if i % 3 else "s0") for i in range(6400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    slots = sorted({r["mix_slot"] for r in corpus_pipeline.mixture(spark, docs, "").collect()})
    assert slots == list(range(len(slots)))
