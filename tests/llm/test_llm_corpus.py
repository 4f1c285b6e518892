"""Collocations, decontamination and filter audit against brute force: nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest

from quadrat.llm import collocations, decontaminate, filters

SCHEMA = "doc_id long, text string, lang string, row string, items string, part string"


def table(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# --- collocations


def phrases(rows, top, min_count, longest):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    out = []
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    swallowed = {(lang, p[i:j]) for (lang, p), a in cands.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and f[lang, p[i:j]] <= a}
    for lang in n:
        mine = []
        for (other, p), a in cands.items():
            if other == lang and (lang, p) not in swallowed:
                score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def spoken(seed, words, vocabulary=40):
    rng = np.random.default_rng(seed)
    of = np.minimum(rng.zipf(1.4, words), vocabulary)
    stops = rng.random(words)
    return "".join(f"{'W' if s < 0.02 else 'w'}{i}{', ' if s > 0.9 else chr(9) if s > 0.88 else ' '}" for i, s in zip(of, stops, strict=True))


FIXED = "rare1 w1 rare2 the End. rare1 w1 rare2! É é naïve\x1cone two\vé"
SPOKEN = [
    *((i, spoken(i, 120) + FIXED * (i % 3), "en", "x", "y", "z") for i in range(12)), *((20 + i, spoken(50 + i, 60, 9), "de", "x", "y", "z") for i in range(4)),
    (30, None, "en", "x", "y", "z"), (31, "", None, "x", "y", "z"), (32, "a b a b a b a b", None, "x", "y", "z"), (32, "a b a b a b a b", "und", "x", "y", "z"), (33, "...", "fr", "x", "y", "z"),
    (None, spoken(3, 90), "en", "x", "y", "z"), (34, " ".join(["again"] * 3000), "es", "x", "y", "z"),
]


@pytest.mark.parametrize("top, min_count, longest, frontier", [(2000, 3, 5, 1 << 18), (3, 4, 4, 12)])
def test_collocations(spark, top, min_count, longest, frontier):
    got = collocations.collocations(table(spark, SPOKEN), top, min_count, longest, frontier=frontier)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for _, t in got.dtypes} == {"string", "bigint"}
    assert sorted(map(tuple, got.collect())) == phrases(SPOKEN, top, min_count, longest)


def test_collocations_prune(spark, monkeypatch):
    """A bound keeps words that are too frequent from being grown, ends that the best phrases need excepted."""
    sent, rows = [], [(i, "one off " * 1 + "the " * 40 + spoken(i, 60), "en", "x", "y", "z") for i in range(30)]
    real = collocations._grown
    monkeypatch.setattr(collocations, "_grown", lambda coded, tries: sent.append(sum(len(t.words) for t in tries.values())) or real(coded, tries))
    got = collocations.collocations(table(spark, rows), 1, 10, 3, frontier=8)
    assert sorted(map(tuple, got.collect())) == phrases(rows, 1, 10, 3)
    assert len(sent) > 1


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, SPOKEN).where("false")).count() == 0
    assert collocations.collocations(table(spark, SPOKEN[-3:]), min_count=5000).count() == 0


def test_wide_products(spark):
    """Products of 1000 * a * n pass 64 bits."""
    rows = spark.createDataFrame([(10**12 + 7, 10**12 + 11, 3 * 10**11, 10**14)], "a long, l long, r long, n long")
    got = rows.select(collocations._floor(*map(rows.__getitem__, ("a", "l", "r", "n")))).first()[0]
    assert got == 1000 * (10**12 + 7) * 10**14 // ((10**12 + 11) * 3 * 10**11)


# --- decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEM = "Alpha beta gamma, delta: epsilon zeta eta theta iota kappa lambda (mu) nu"
ITEMS = [(1, ITEM), (2, "one two three"), (3, None), (4, "..."), (5, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (5, "unique words here"), (None, "nameless item words"), (2, "one two three"), (10, "Ünïcode wörds 東京")]
ITEM_DOCS = [
    (1, "x " + ITEM + " y"), (2, "start ALPHA beta\ngamma delta epsilon zeta eta theta iota kappa"), (3, "alpha beta gamma delta epsilon zeta eta theta iota"), (4, None), (5, ""), (6, "one-two three one two three"),
    (7, "nameless, item words"), (8, "ünïcode wörds 東京; ÜNÏCODE"), (9, "!!"), (2, "start ALPHA beta\ngamma delta epsilon zeta eta theta iota kappa"), (None, "unique words here and there"), (11, ("filler " * 50000) + ITEM),
    (12, " ".join([ITEM] * 30)), (13, "Ünïcode wörds 東京"),
]


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def marked(text, width=10):
    words, hit, items = fold(text), set(), set()
    for item, said in ITEMS:
        its = fold(said)
        n = min(width, len(its))
        wins = {tuple(its[i : i + n]) for i in range(len(its) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                items.update([] if item is None else [str(item)])
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def item_tables(spark):
    docs = table(spark, [(i, t, "en", "x", "y", "z") for i, t in ITEM_DOCS])
    return docs, table(spark, [(*r, "e") for r in ITEMS], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("sent", [decontaminate.SENT, 400])
def test_contamination(spark, sent):
    docs, items = item_tables(spark)
    got = decontaminate.audit(docs, items, sent=sent)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((i, *marked(t)) for i, t in ITEM_DOCS)
    assert decontaminate.audit(docs.where("false"), items).count() == 0
    assert {r.contaminated for r in decontaminate.audit(docs, items.where("false")).collect()} == {False}


def test_decontaminate(spark):
    docs, items = item_tables(spark)
    clean = {(i, t) for i, t in ITEM_DOCS if not marked(t)[1]}
    whole = decontaminate.decontaminate(docs, items, "documents")
    assert whole.columns == docs.columns and {(r.doc_id, r.text) for r in whole.collect()} == clean
    cut = decontaminate.decontaminate(docs, items, "spans")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == len(ITEM_DOCS)
    assert texts[1] == "x  y" and texts[2] == "start " and texts[4] is None and texts[3] == ITEM_DOCS[2][1] and texts[8] == ITEM_DOCS[7][1] and texts[13] == "" and texts[11] == "filler " * 50000
    with pytest.raises(ValueError, match="remove"):
        decontaminate.decontaminate(docs, items, "words")


# --- filter audit

LONG = "x" * 70
FILTERED = [
    (1, "word " * 300, "en"), (2, "word " * 300, "en"), (3, " ".join(f"w{i}" for i in range(250)), "en"), (4, None, "en"), (5, "", None), (6, "", ""), (7, "AB " * 5, "de"), (8, "a$b " + " ".join(f"v{i}" for i in range(250)), "de"),
    (2, "word " * 300, "fr"), (None, "word " * 300, "en"), (9, f"{LONG}a {LONG}b {LONG}a\v{LONG}b", "en"), (10, "é é é東 É | " * 60, "fr"), (11, " ".join(f"w{i}" for i in range(250)), "de"), (12, "AbcdefghiJ " * 40000, "es"), (13, "A" * 3 + "b" * 97, "es"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (8, 1, None), (12, 0, 1), (99, 1, 1), (None, 1, 1)]


def audited(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    facts, found = [], []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        facts.append((lang or "", f, i is not None and any(m[0] == i and m[1] == 1 for m in MARKS), i is not None and any(m[0] == i and m[2] == 1 for m in MARKS)))
    for part in sorted({p for p, *_ in facts}):
        mine, steps = [x for x in facts if x[0] == part], []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order):
                gone, left, there = [x for x in left if x[1][c]], [x for x in left if not x[1][c]], left
                steps.append([part, order, k + 1, len(left), len(gone), sum(x[1][c] for x in mine) - len(gone), sum(x[1][c] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        total = collections.Counter()
        for s in steps:
            total[s[1][s[2] - 1]] += s[4]
        found += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(found)


def test_filter_audit(spark):
    docs = table(spark, [(*r, "x", "y", "z") for r in FILTERED])
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    got = filters.interaction_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(FILTERED)
    assert filters.interaction_audit(docs.where("false"), labels).count() == 0
    assert sorted(map(tuple, filters.interaction_audit(docs.where("doc_id = 7"), labels.where("false")).collect())) == audited([FILTERED[6]])


def test_transducer():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("aBé東 \t\v#|\x1cxyz𝄞"), n)) for n in (0, 1, 2, 7, 8, 9, 500, 3000)] + ["", "a" * 65 + "b " + "a" * 65 + "c " + "a" * 65 + "b"]
    want = [(len(w := re.findall("[^\x20\x09-\x0d]+", t)), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))) for t in texts]
    assert [tuple(r) for r in filters.measured([t.encode() for t in texts]).tolist()] == want


def test_words_of_one_hash(monkeypatch):
    """Words whose hashes agree are told apart by their bytes."""
    monkeypatch.setattr(filters.WordTable, "_hashes", lambda self, starts, sizes, owners: np.zeros(len(starts), np.uint64))
    assert filters.measured([b"a b c a b", b"a b " + b"q" * 70 + b" " + b"q" * 70])[:, 1].tolist() == [3, 3]


def test_shards_prune_files(spark):
    """A filter on one source or language opens few more files, by their smallest and largest values, than hold it."""
    from quadrat.llm import sharding

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard_documents(docs, 40).select("doc_id", "shard").join(docs.select("doc_id", "source", "lang"), "doc_id").toPandas()
    for col, most in (("source", 16), ("lang", 17)):
        ends = out.groupby("shard")[col].agg(["min", "max"])
        opened = [((ends["min"] <= v) & (v <= ends["max"])).sum() for v in out[col].unique()]
        held = [out[out[col] == v].shard.nunique() for v in out[col].unique()]
        assert np.mean(opened) <= min(most, 1.25 * np.mean(held))
