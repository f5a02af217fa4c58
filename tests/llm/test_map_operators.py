"""Row-wise operators: rules, urls, decontamination, language, toxicity, quality."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from logloom.llm import decontamination, language_id, quality_classifier, quality_rules, toxicity, url_filters
from logloom.llm.tables import fold

DOCS = "doc_id long, text string, lang string, source string"
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "two words", "en", None),
    (6, "word " * 30_000, "en", "b"), (7, "é" * 5000, "fr", "b"), (8, "line a b c\nline a b c\n\nx", "en", "b"), (9, "12 34 56!", None, "b"),
]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- quality rules ---------------------------------------------------------------------------


def base_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set(grams)
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_base_measurements(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab c# |d éf\n \t".split(" ") + ["x\ny", "\u2003"]) for _ in range(r.randint(0, 80))) for _ in range(200)]
    rows = [*AWKWARD, *((100 + i, t, "en", "z") for i, t in enumerate(texts))]
    got = quality_rules.judge(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, base_of(t))
    for g in got:
        assert tuple(g[c] for c in quality_rules.BASE) == by[g["doc_id"]], g
        assert g["base_failed"] == (g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"])
        assert g["kept"] == (g["rejected_by"] is None) and not (g["base_failed"] and g["kept"])


def test_rule_order_changes_cost_only(spark):
    texts = quality_rules.Texts(*_raw(["a b c", "# # # # #", "A B C D", "plain words only here", ""]))
    rules = quality_rules.default_rules(min_words=1)
    want = quality_rules.cascade(texts, rules) >= 0
    for seed in range(5):
        shuffled = random.Random(seed).sample(rules, len(rules))
        assert ((quality_rules.cascade(texts, shuffled) >= 0) == want).all()


def test_cascade_stops_early():
    seen = []
    rules = [quality_rules.Rule("first", lambda t: (seen.append(t.n), np.array([True, False, True]))[1]), quality_rules.Rule("second", lambda t: (seen.append(t.n), np.zeros(t.n, bool))[1])]
    assert quality_rules.cascade(quality_rules.Texts(*_raw(["a", "b", "c"])), rules).tolist() == [0, -1, 0]
    assert seen == [3, 1]


def test_order_prefers_rejection_per_cost(spark):
    def slow(t):
        sum(range(200_000))
        return np.ones(t.n, bool)

    rules = [quality_rules.Rule("slow", slow), quality_rules.Rule("never", lambda t: np.zeros(t.n, bool)), quality_rules.Rule("fast", lambda t: np.ones(t.n, bool))]
    assert [r.name for r in quality_rules.order_rules(rules, *_raw(["some text"] * 50))][0] == "fast"
    assert quality_rules.order_rules(rules, *_raw([])) == rules
    own = quality_rules.Ordered(rules, 3)
    own.see(pa.array(["some text"] * 9))
    assert own.rules[0].name == "fast"
    docs = spark.createDataFrame([(i, "some text") for i in range(50)], "doc_id long, text string")
    assert quality_rules.keep(docs, rules).count() == 0 and quality_rules.keep(docs, rules[1:2]).count() == 50


def _raw(texts):
    raw = [t.encode() for t in texts]
    return b"".join(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_rules_keep_filters_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, "x"), (2, "short", "y"), (3, None, "z")], "doc_id long, text string, kept string")
    out = quality_rules.keep(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, good, "x")]
    assert quality_rules.keep(df.where("doc_id > 9")).count() == 0


# ---- urls --------------------------------------------------------------------------------------


def brute_url(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = low(m[1]), m[2]
    fit = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls_against_brute_force(spark):
    r = random.Random(1)
    hosts = ["com", "example.com", "www.Example.COM", "a.b.net", "net", "xnet", "example.com:80", "q.org", "", ".com"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/x', '/es/1', '/fr', '/fr/a/b'])}{r.choice(['', '?q=/en/', '#f'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    more = [url_filters.Rule.parse(v, t) for v, t in (("block", "b.net/es/1"), ("allow", "a.b.net/es/"), ("block", "org/"), ("allow", "q.org/en/"), ("block", "net/"))]
    for rules in (url_filters.RULES, (*url_filters.RULES, *more)):
        for size in (2, 100):
            got = {x["page_id"]: tuple(x)[1:] for x in url_filters.judge_urls(df, rules, block_rules=size).collect()}
            assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}
    assert url_filters.judge_urls(df, ()).where("rule IS NOT NULL OR verdict != 'allow'").count() == 0
    assert url_filters.judge_urls(df.where("page_id < 0")).count() == 0


# ---- decontamination ----------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(window, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    r = random.Random(2)
    vocab = ["a", "b", "Ä", "c1"]
    text = lambda n: r.choice([" ", "-", ", "]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((1, 2, 3, 5, 9, 10, 11, 14, 0, 12))] + [(77, None), (78, "B"), (79, text(10))]
    items[7] = (7, "zeta " + items[7][1])
    rows = [(i, text(r.randint(0, 60)), "en", "s") for i in range(80)] + [(90 + i, "z " + items[k][1] + " z", "en", "s") for i, k in enumerate((5, 6, 7, 9))]
    rows += [(200, None, "", ""), (201, "", "", ""), (202, " !! ", "", ""), (200, None, "", "")]
    use = [x for x in items if len(x[1] or "") > 3]
    for some in (items, use, []):
        it = spark.createDataFrame(some, "item_id long, text string")
        for block in (16 << 20, 20):
            got = decontamination.judge(spark.createDataFrame(rows, DOCS).withColumn("n_hit", F.lit("clash")), it, block_bytes=block).collect()
            assert len(got) == len(rows)
            want = {i: brute_hits(t, some) for i, t, *_ in rows}
            for g in got:
                assert (g["n_words"], g["n_hit"], g["items"]) == want[g["doc_id"]]
                assert sum(s["words"] for s in g["hit_spans"]) == g["n_hit"]
    clash = spark.createDataFrame(rows, DOCS).withColumns({"__hit": F.lit("h"), "__items": F.lit(1)})
    kept = decontamination.keep_clean(clash, spark.createDataFrame(use, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "__hit", "__items"]
    empty = spark.createDataFrame([], DOCS)
    items_ = spark.createDataFrame(use, "item_id long, text string")
    assert decontamination.judge(empty, items_).count() == 0 and decontamination.keep_clean(empty, items_).count() == 0
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t, *_ in rows if not brute_hits(t, use)[1])


def test_decontamination_items_without_id_or_repeated(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " + item, "", ""), (2, "other", "", "")], DOCS)
    for items, n, ids in (([(None, item)], 0, []), ([(3, item), (3, "other"), (None, item)], 1, ["3"])):
        got = {r["doc_id"]: r for r in decontamination.judge(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert (got[1]["n_hit"], got[1]["n_items"], got[1]["items"], got[1]["contaminated"]) == (12, n, ids, True)
    assert got[2]["items"] == ["3"]


def test_decontamination_builds_once_a_worker():
    block = [(1, "a b c")]
    decontamination._built.clear()
    first = decontamination._matchers("k", block, 10)
    assert decontamination._matchers("k", block, 10) is first
    decontamination._matchers("l", block, 10), decontamination._matchers("m", block, 10)
    assert set(decontamination._built) == {"l", "m"}


# ---- language ---------------------------------------------------------------------------------------


def test_grams_against_counting():
    for text in ("Hello, wörld 12 x!", " a-b ", "", "ñ", "ab² cd", "x" * 100):
        want = {}
        run = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in run:
            p = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(p) - n + 1):
                    if p[i : i + n] != " ":
                        want[p[i : i + n]] = want.get(p[i : i + n], 0) + 1
        gram, n = language_id.grams(text)
        names = ["".join(chr((int(g) >> s) & 0x1FFFFF) for s in (42, 21, 0)).lstrip("\0") for g in gram]
        assert dict(zip(names, n.tolist())) == want


def test_out_of_place_distance():
    p = language_id.Profiles({"a": np.array([5, 7, 9]), "b": np.array([9, 11])}, 3)
    assert p.distances(np.array([7, 5, 11])).tolist() == [1 + 1 + 3, 3 + 3 + 1]
    assert p.predict(np.array([9, 11]))[0] == "b"
    assert p.predict(np.array([], np.int64)) == ("und", 0.0)


LANGUAGES = {"en": "the quick brown fox and the lazy dog that was here with all of them", "de": "der schnelle braune fuchs und die faule katze waren nicht hier gewesen", "fr": "le renard brun et rapide avec les chiens paresseux que nous avons vus"}


def test_language_prediction_and_edges(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(LANGUAGES[k].split()) for _ in range(40)), k, "s") for i, k in enumerate(list(LANGUAGES) * 40)]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None, s) for i, (_, t, _, s) in enumerate(AWKWARD)], DOCS)
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(got) == len(rows) + len(AWKWARD)
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["lang_pred"] == k for i, _, k, _ in rows)
    for i, (_, t, *_) in enumerate(AWKWARD):
        none = not any(c.isalpha() for c in t or "")
        assert (by[1000 + i]["lang_pred"] == "und") == none and 0 <= by[1000 + i]["score"] <= 1
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    changed = docs.withColumn("lang", F.when(F.col("doc_id").isin(*held), "xx").otherwise(F.col("lang")))
    assert language_id.fit(changed).languages == ["de", "en", "fr"]
    few = language_id.identify(docs.withColumn("lang_pred", F.lit(1)).withColumn("least", F.lit("x")), language_id.fit(docs), block_languages=1).collect()
    assert sorted(map(tuple, few), key=str) == sorted(map(tuple, got), key=str)
    empty = docs.where("doc_id < 0")
    assert language_id.identify(docs, language_id.fit(empty)).where("lang_pred != 'und'").count() == 0
    assert language_id.identify(empty, language_id.fit(docs)).count() == 0


# ---- toxicity and quality -----------------------------------------------------------------------------


def labelled(spark, n=400, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        toxic, good = r.random() < 0.3, r.random() < 0.6
        w = [word() for _ in range(r.randint(20, 60))]
        if toxic:
            w[3:3] = [r.choice(["idiotic", "trashy", "moronic"]) for _ in range(3)]
        rows.append((i, " ".join(w) if good else " ### ".join(w), "en", "s"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_block_max_index_is_exact():
    r = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        t = r.choice(40, r.integers(0, 8), replace=False)
        w = r.random(len(t))
        w /= np.linalg.norm(w) or 1
        vectors.append(dict(zip(t.tolist(), w.tolist())))
    index = toxicity.BlockMaxIndex(list(range(500)), vectors, 40)
    dense = np.zeros((500, 40))
    for i, v in enumerate(vectors):
        dense[i, list(v)] = list(v.values())
    for i in range(0, 500, 5):
        s = np.round(dense @ dense[i], 9)
        want = [(x, j) for x, j in sorted(((-s[j], j) for j in range(500) if s[j] > 0 and j != i))][:7]
        got = index.nearest(vectors[i], 7, skip=i)
        assert [(-round(c, 9), int(index.ids[at])) for c, at in got] == [(pytest.approx(x, abs=2e-9), j) for x, j in want]


def test_toxicity(spark):
    docs, labels, known = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, _, t in known if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.7) == bool(t) for i, t in held]) > 0.97
    trained = {i for i, *_ in known if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(model.examples.index.ids.tolist()) <= trained
    edges = toxicity.score(spark.createDataFrame(AWKWARD, DOCS).withColumn("score", F.lit("x")), model).collect()
    assert len(edges) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in edges)
    blank = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in toxicity.score(docs.limit(3), blank).collect()} == {0.5}


def test_toxicity_indexes_every_term():
    r = random.Random(2)
    plain = [f"ordinary words {r.randint(0, 9)} of text{r.randint(0, 99)}" for _ in range(100)]
    sample = [(i, t + (" moronic" if i % 2 else ""), i % 2) for i, t in enumerate(plain)]
    model = toxicity.ToxicityModel(sample, {0: 50, 1: 50})
    assert set(model.examples.terms) == {t for _, text, _ in sample for w in toxicity.words_of(text) for t in toxicity.terms_of(w)}
    score, near = model.score("ordinary")
    assert len(near) == model.k and score < model.score("ordinary moronic")[0]
    few = toxicity.ToxicityModel(sample[:20], {0: 10, 1: 10})
    assert few.score("moronic")[0] > few.score("ordinary words")[0]


def brute_tfidf(sample):
    """Weights by term, and the vector of any text, from the definitions."""
    split = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t)))
    has = [(set(split(t)), y) for _, t, y in sample]
    n, n1 = len(has), sum(y for _, y in has)
    weight = {}
    for term in set().union(*(w for w, _ in has)):
        a, b = (sum(term in w for w, y in has if y == k) for k in (1, 0))
        low_ = (a + b) * (n - a - b) * n1 * (n - n1)
        chi = (a * (n - n1 - b) - b * (n1 - a)) ** 2 / low_ if low_ else 0
        weight[term] = (chi + toxicity.LEAST) * (math.log((1 + n) / (1 + a + b)) + 1)

    def vector(text):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in split(text).items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    return vector


def brute_vote(sample, k):
    vector = brute_tfidf(sample)
    known = [(vector(t), y) for _, t, y in sample]

    def vote(text):
        v = vector(text)
        near = sorted(((-round(sum(x * w.get(t, 0) for t, x in v.items()), 9), j) for j, (w, _) in enumerate(known)))[:k]
        near = [(-c, j) for c, j in near if c < 0]
        w = [1 / (1.05 - c) for c, _ in near]
        return sum(x * known[j][1] for x, (_, j) in zip(w, near)) / sum(w) if near else None

    return vote


def test_toxicity_query_against_brute_force(spark):
    """Neighbours, votes, cross-fitted calibration and scores of every document, from the definitions."""
    docs, labels, known = labelled(spark, 120, 8)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = sorted(((i, texts[i], t) for i, _, t in known if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda x: (x[1].encode(), x[2]))
    vote = brute_vote(train, 15)
    own = [None] * len(train)
    for f in range(toxicity.FOLDS):
        others = brute_vote([x for j, x in enumerate(train) if j % toxicity.FOLDS != f], 15)
        for j in range(f, len(train), toxicity.FOLDS):
            own[j] = others(train[j][1])
    some = [j for j, v in enumerate(own) if v is not None]
    fit = toxicity.Logistic(np.array([own[j] for j in some]), np.array([train[j][2] for j in some]), np.ones(len(some)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    for i, t in texts.items():
        v = vote(t)
        assert v is None or got[i] == pytest.approx(float(fit([v])[0]), abs=1e-6), i


def test_toxicity_ids_and_partitions_do_not_matter(spark):
    docs, labels, _ = labelled(spark, 90, 3)
    twice = docs.union(docs.where("doc_id < 9").withColumn("text", F.lit("")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(twice.repartition(7), labels.repartition(3))
    assert [one.score(t) for t in ("abc moronic", "abc", "")] == [two.score(t) for t in ("abc moronic", "abc", "")]
    sample = [(i, t, i % 2) for i, t in enumerate(["same text", "same text", "same text", "other moronic"] * 5)]
    moved = [(1000 - i, t, y) for i, t, y in sample]
    a, b = toxicity.ToxicityModel(sample, {0: 10, 1: 10}, 3), toxicity.ToxicityModel(moved, {0: 10, 1: 10}, 3)
    assert a.score("same text")[0] == b.score("same text")[0]
    assert toxicity.score(docs.where("doc_id < 0"), one).count() == 0


def test_quality(spark):
    docs, labels, known = labelled(spark, 900, 5)
    model = quality_classifier.fit(docs, labels, dict_bytes=4096)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    held = [(i, q) for i, q, _ in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == bool(q) for i, q in held]) > 0.95
    edges = quality_classifier.score(spark.createDataFrame(AWKWARD, DOCS), model).collect()
    assert len(edges) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in edges)
    blank = quality_classifier.fit(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in quality_classifier.score(docs.limit(3), blank).collect()} == {0.5}
    assert quality_classifier.score(docs.where("doc_id < 0"), model).count() == 0


def test_quality_query_against_brute_force(spark):
    """Sample, dictionaries, sizes, calibration and scores of every document, from the definitions."""
    docs, labels, known = labelled(spark, 500, 6)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clash = docs.withColumns({"score": F.lit("x"), "label": F.lit(3)})
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(clash, quality_classifier.fit(clash, labels, dict_bytes=4096)).collect()}
    train, rest, turn = {0: [], 1: []}, [], {0: 0, 1: 0}
    for i, q, _ in sorted(known):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            turn[q] += 1
            (rest if turn[q] % 4 == 0 else train[q]).append((i, q))
    size = []
    for y in (0, 1):
        raw = zstandard.train_dictionary(4096, [texts[i].encode() for i, _ in train[y]], k=64, d=8, level=3)
        size.append(lambda t, d=raw: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d.as_bytes()), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t.encode())))

    def features(t):
        bad, good = size[0](t), size[1](t)
        share = min(1.0, good / len(t.encode()))
        return (bad - good) / (bad + good), share, share**2

    weight = [sum(q == y and zlib.crc32(str(i).encode()) % 4 != 2 for i, q, _ in known) / sum(q == y for _, q in rest) for _, y in rest]
    fit = quality_classifier.Logistic(np.array([features(texts[i]) for i, _ in rest]), np.array([q for _, q in rest]), np.array(weight))
    for i, t in texts.items():
        assert len(t) < 2048 and got[i] == pytest.approx(float(fit([features(t)])[0]), abs=0.02), i


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", fold("id", 7)).collect()
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 7 for r in got)
