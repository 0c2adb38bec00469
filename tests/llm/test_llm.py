"""Training-data operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, embedding_dedup, fingerprint, language_id, license_scan, mixing, ngram_join, packing, quality, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    full = [(*r, *[None] * (5 - len(r))) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    # Extra columns whose names clash with those that operators add.
    return df.withColumns({"score": F.lit("x"), "ids": F.lit(1), "label": F.lit(0), "shard": F.lit("s")})


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id"), (5, "word " * 3000), (6, "é世😀 \x00 \x1f"), (7, "same text here again now"), (8, "same text here again now")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def collect(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: repr(r[key]))


# ---- licences ----------------------------------------------------------------------------------------------------------

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(common.ASCII_UPPER, common.ASCII_LOWER)))
    places, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, odd, empty):
    rng = random.Random(2)
    bits = ["under", "the", "MIT", "license", "Apache", "License,", "Version", "2.0", "cc", "BY-NC", "\n", "é", "xmit", "licenses", "(", "2", "Under The Mit License."]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(150)] + [(900, "Apache License, Version 2"), (901, "CC-BY-NC"), (902, "\u212aunder the mit license"), (903, "under the mit licensé")]
    for r in collect(license_scan.scan_licenses(docs_of(spark, rows))):
        text = dict(rows)[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    got = collect(license_scan.scan_licenses(odd))
    assert len(got) == len(ODD) and all(r.labels == "" and r.score == 0 for r in got)
    assert license_scan.scan_licenses(empty).isEmpty()


def test_license_rules_suppress_what_lies_inside(spark):
    texts = {
        1: "SPDX-License-Identifier: MPL-2.0", 2: "This is licensed under the GNU Lesser General Public License, version 2.1 or later.", 3: "see https://www.apache.org/licenses/LICENSE-2.0",
        4: "Creative Commons Attribution-ShareAlike 4.0", 5: "released under the BSD-3-Clause", 6: "GNU General Public License", 7: "All rights\nreserved", 8: "just a text under a tree",
    }
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(docs_of(spark, list(texts.items()))).collect()}
    assert got == {1: "mpl-2.0", 2: "lgpl-2.1", 3: "apache-2", 4: "cc-by-sa", 5: "bsd-3-clause", 6: "gpl", 7: "proprietary", 8: ""}
    found = license_scan.detections(docs_of(spark, [(2, texts[2])]), key="doc_id").collect()
    assert [(r.label, texts[2][r.start : r.end].startswith("licensed under")) for r in found] == [("lgpl-2.1", True)]
    assert len(license_scan.signatures()) > 250


def written_out(items):
    """Texts a parsed regex matches: every alternative, option and member of a set, a blank as a line's end."""
    out = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = ["\n" if str(x) == "CATEGORY_SPACE" else "x" if o == "CATEGORY" else chr(x[0] if o == "RANGE" else x) for o, x in ((str(o), x) for o, x in arg)]
        elif name == "BRANCH":
            more = [x for branch in arg[1] for x in written_out(branch)]
        elif name == "SUBPATTERN":
            more = written_out(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [x * n for x in written_out(arg[2]) for n in {arg[0], max(arg[0], 1)}]
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            more = [""]
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_license_gates_let_every_alternative_through(spark):
    rules = license_scan.signatures()
    rows = [(r.label, r.keyword, r.also, r.regex, x) for r in rules for x in written_out(re._parser.parse(r.regex, re.I))]
    assert len(rows) > 5_000 and all(re.search(r[3], r[4], re.I) for r in rows)
    low = F.lower("text")
    df = spark.createDataFrame(rows, "label string, keyword string, also string, regex string, text string")
    assert df.where(~license_scan._gate(low) | ~license_scan._due(low, F.struct("keyword", "also"))).select("label", "text").take(5) == []
    texts = {
        1: "Creative Commons Zero v1.0 Universal", 2: "under the Python Software Foundation License", 3: "Etalab 2.0", 4: "MIT No Attribution", 5: "SPDX-License-Identifier: Apache-2.0",
        6: "released under Creative Commons Zero", 7: "Licence Ouverte / Etalab 2.0", 8: "CC0 1.0", 9: "the PSF license", 10: "SPDX-License-Identifier: Apache-2.1",
    }
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs_of(spark, list(texts.items()))).collect()}
    assert got == {
        1: ("cc0-1.0", 0.6), 2: ("python-2.0", 0.6), 3: ("etalab-2.0", 0.6), 4: ("mit-0", 0.6), 5: ("apache-2", 1.0),
        6: ("cc0-1.0", 0.9), 7: ("etalab-2.0", 0.6), 8: ("cc0-1.0", 0.6), 9: ("python-2.0", 0.6), 10: ("", 0.0),
    }


def plain_detections(text):
    """All rules by plain search, then suppression by its definition: pairs of detections, one inside the other."""
    found = []
    for i, r in enumerate(license_scan.signatures()):
        for m in re.finditer(r.regex, text, re.I | re.A):
            found.append((m.start(), m.end(), r.priority, i, r.label))
    out = []
    for d in found:
        over = [e for e in found if e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[3] < d[3])))]
        if not over:
            out.append(d)
    return sorted((s, e, label) for s, e, _, _, label in out)


def test_license_detections_against_plain_version(spark):
    rng = random.Random(17)
    names = ["MIT License", "GNU General Public License, version 2", "GNU Lesser General Public License v2.1", "Apache License, Version 2.0", "CC BY-NC-SA 4.0", "Creative Commons Zero", "BSD-3-Clause", "Mozilla Public License 2.0", "EUPL", "Boost Software License 1.0", "all rights reserved", "zlib license", "the Unlicense"]
    frames = ["licensed under the {}", "Released under the terms of the {} license", "SPDX-License-Identifier: {}", "{}", "see {} for more", "distributed\nunder {}."]
    tags = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "LGPL-2.1", "CC-BY-NC", "0BSD", "MPL-2.0"]
    whole = [license_scan._loose(x).replace(r"\s+", " ") for _, _, x in license_scan.SENTENCES if not set("[(?{|+") & set(x.replace(r"\s+", " "))]
    links = ["https://opensource.org/licenses/MIT", "http://www.gnu.org/licenses/gpl-3.0.html", "https://creativecommons.org/licenses/by-nc-sa/4.0", "https://www.apache.org/licenses/LICENSE-2.0"]
    rows = []
    for i in range(160):
        bits = []
        for _ in range(rng.randrange(1, 6)):
            bits.append(rng.choice([rng.choice(frames).format(rng.choice(names + tags)), rng.choice(links), rng.choice(whole).replace("\\", ""), "some plain words here", "ünder no licence"]))
        rows.append((i, rng.choice([" ", "\n", " -- "]).join(bits)))
    got = {}
    for r in license_scan.detections(docs_of(spark, rows), key="doc_id").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.label))
    want = {i: plain_detections(text) for i, text in rows}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x} and sum(map(len, want.values())) > 250


# ---- n-gram join -------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(common.ASCII_UPPER, common.ASCII_LOWER)))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else min(least[r], d) if d is not None else least[r]
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(rng, n, words=60, edits=4):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(n):
        mine = list(base)
        for _ in range(rng.randrange(edits)):
            mine[rng.randrange(len(mine))] = f"v{rng.randrange(10**6)}"
        yield " ".join(mine)


@pytest.mark.parametrize("chunk", [256, 12])
def test_ngram_join(spark, monkeypatch, chunk):
    """Small chunks take the way of large blocks: hubs, then what they don't join against the whole block."""
    rng = random.Random(5)
    rows, k = [], 0
    for size, edits in ((1, 1), (2, 2), (7, 3), (60, 6), (45, 9)):
        for text in near_copies(rng, size, edits=edits):
            rows.append((k, text))
            k += 3
    rows += [(k + 1, rows[5][1]), (k + 2, rows[5][1].upper()), (k + 3, "a b c"), (k + 4, "A  b\nc"), (k + 5, "a b c d"), (k + 6, None), (k + 7, ""), (k + 8, " ")]
    rng.shuffle(rows)
    monkeypatch.setattr(ngram_join, "class_links", lambda sets, f=ngram_join.class_links: f(sets, chunk=chunk, hubs=3))
    got = sorted((tuple(r) for r in ngram_join.ngram_components(docs_of(spark, rows)).collect()), key=repr)
    assert got == brute_components(rows)


def test_ngram_join_odd_rows(spark, odd, empty):
    got = sorted((tuple(r) for r in ngram_join.ngram_components(odd).collect()), key=repr)
    assert got == brute_components(ODD)
    assert ngram_join.ngram_components(empty).isEmpty()
    kept = collect(ngram_join.keep_representatives(odd))
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([1, 2, 3, 4, None, 5, 6, 7], key=repr) and kept[0].score == "x"


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(120)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 60))) for s in sets[:40]]
    tree, links = ngram_join.PrefixTree(), set()
    for i, s in enumerate(sets):
        for r, overlap in tree.linked(s, len(s), 60, lambda r: False):
            assert overlap == len(np.intersect1d(s, sets[r]))
            if 9 * overlap >= 4 * (len(s) + len(sets[r])):
                links.add((r, i))
        tree.add(i, s, len(s))
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert links == want


@pytest.mark.parametrize("frequent", [2, 3, 10**6])
def test_ngram_join_with_frequent_shingles(spark, monkeypatch, frequent):
    """A line of all documents takes the way of frequent shingles, in some tasks and not in others."""
    rng = random.Random(31)
    line = "this very line stands at the head of all of them"
    rows = [(i, line + " " + text) for i, text in enumerate([t for _ in range(12) for t in near_copies(rng, 5, words=30, edits=3)])]
    rows += [(100 + i, line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9)))) for i in range(40)] + [(200, line), (201, line)]
    monkeypatch.setattr(ngram_join, "shared_sets", lambda docs, parts, f=ngram_join.shared_sets, **k: f(docs, parts, frequent=frequent, **k))
    docs = docs_of(spark, rows).repartition(3)
    assert sorted((tuple(r) for r in ngram_join.ngram_components(docs).collect()), key=repr) == brute_components(rows)


def test_tree_links_follow_the_global_order(monkeypatch):
    """Sets are stored from the frequent end of the order that the frequencies give, whatever the task holds."""
    seen = []
    monkeypatch.setattr(ngram_join.PrefixTree, "add", lambda self, row, tokens, size, f=ngram_join.PrefixTree.add: (seen.append(tokens.tolist()), f(self, row, tokens, size)) and None)
    tokens, dfs = [np.array([5, 9, 2]), np.array([7, 9, 2])], [np.array([2, 3, 8]), np.array([2, 3, 8])]
    ngram_join.tree_links([1, 2], [3, 3], tokens, dfs, [True, True], [True, True], [1, 2])
    # Order by frequency, then value: 5, 7, 9, 2; numbered from its end: 2 -> 0, 9 -> 1, 7 -> 2, 5 -> 3.
    assert seen == [[0, 1, 3], [0, 1, 2]]


def test_representatives_of_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "v30")
    rows = [(1, base, "en", "a"), (5, base, "en", "a"), (5, "quite another text that nobody else has got here", "de", "b"), (7, near, "en", "c"), (7, near, "fr", "c"), (None, near, "en", "d"), (None, "alone without an id but with words", "en", "d"), (9, "twice the same row in all columns", "en", "e"), (9, "twice the same row in all columns", "en", "e"), (10, None, None, None), (10, None, None, None), (11, "", "en", "f")]
    docs = docs_of(spark, rows).withColumns({"_k1": F.lit(5), "K1": F.lit("x"), "s1": F.lit(0), "cls": F.lit("c")})
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.lang) for r in kept.collect()), key=repr)
    assert got == sorted([(1, base, "en"), (5, rows[2][1], "de"), (None, rows[6][1], "en"), (9, rows[7][1], "en"), (10, None, None), (10, None, None), (11, "", "en")], key=repr)
    # Of equal ids and near texts one stays, the same on every run.
    same = docs_of(spark, [(7, near, "en", "c"), (7, base, "fr", "c"), (7, near, "de", "d")])
    one = {tuple(r)[:4] for df in (same, same.repartition(3)) for r in ngram_join.keep_representatives(df).collect()}
    assert len(one) == 1


# ---- models ------------------------------------------------------------------------------------------------------------


def test_language_id(spark, odd, empty):
    docs = common.table(spark, DIR, "documents")
    model = language_id.fit(docs)
    seen = docs.select("doc_id", "text", "lang")
    got = language_id.predict(seen, model, keep=("doc_id", "lang")).withColumn("held", common.held_out(F.col("doc_id"))).where("held").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= by and (4, "und") not in by
    assert language_id.predict(empty, model).isEmpty()
    none = language_id.fit(odd)  # no languages to learn from
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    kept = language_id.drop_unknown(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    moved = seen.withColumn("lang", F.lit("xx"))
    a, b = (sorted(map(tuple, language_id.predict(d, model).collect())) for d in (seen, moved))
    assert a == b  # lang is no input of a prediction


def test_toxicity_chain(spark, odd, empty):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vilex" + rng.choice("abcdef") * 2, "idiot", "Moron"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].is_toxic == bool(dict(labels)[i]) for i in held) >= 0.97 * len(held)
    assert model.categories == ("kind_1", "kind_2", "kind_3", "toxic") and [len(w) - len(model.vocabulary) for w in model.weights] == [1, 2, 3, 4]
    assert toxicity.score_texts(odd, model).count() == len(ODD) and toxicity.score_texts(empty, model).isEmpty()
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and abs(kept.count() - 500) <= 5
    constant = toxicity.fit(docs, marks.where("toxic = 0"))
    assert not toxicity.score_texts(odd, constant).where("is_toxic").count()
    unlabelled = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score_texts(odd, unlabelled).count() == len(ODD)
    again = toxicity.fit(docs, marks)
    assert again.vocabulary == model.vocabulary and all(np.array_equal(a, b) for a, b in zip(again.weights, model.weights, strict=True))


def test_quality(spark, odd, empty):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    got = quality.score_texts(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum((r.score >= 0.3) == bool(r.quality) for r in got) >= 0.9 * len(got) and all(r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score_texts(odd, model).count() == len(ODD) and quality.score_texts(empty, model).isEmpty()
    only = quality.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score_texts(odd, only).collect()} == {1.0}
    assert {r.score for r in quality.score_texts(odd, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def plain_regression(x, y, weight, ridge=0.5):
    """Weighted ridge logistic regression by damped Newton steps, written out; the last column is the constant."""
    if min(y) == max(y):
        p = min(max(y[0], 1e-6), 1 - 1e-6)
        return np.array([0.0] * (x.shape[1] - 1) + [np.log(p / (1 - p))])
    w, pen = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-4])
    loss = lambda w: float((weight * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + 0.5 * (pen * w * w).sum())
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (weight * (p - y)) + pen * w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(pen), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(grad).max() < 1e-9:
            break
    return w


def plain_chain(rows, y, weight, kinds_of, folds=3):
    """The chain by definition: rows are sets of words that are features themselves; every row's inputs come from the other folds."""
    words = sorted(set().union(*rows))

    def chosen(at):
        score = {}
        for w in words:
            a, b = sum(w in rows[i] and y[i] for i in at), sum(w in rows[i] and not y[i] for i in at)
            n1, n0 = sum(y[i] for i in at), sum(1 - y[i] for i in at)
            share = (a + b) / (n1 + n0) or 1
            g = 2 * sum(c * np.log(c / (m * share)) for c, m in ((a, n1), (b, n0)) if c)
            if a + b >= 3 and a / n1 > b / n0 and g > 6:
                score[w] = g
        return sorted(score, key=lambda w: -score[w])

    everyone = range(len(rows))
    per_fold = [chosen([i for i in everyone if i % folds != f]) for f in range(folds)]
    final, earlier, models = chosen(everyone), [], []
    targets = [np.array([float(k == j) for k in kinds_of]) for j in range(3)] + [np.array(y, float)]

    def matrix(at, features):
        return np.array([[float(w in rows[i]) for w in features] + [e[i] for e in earlier] + [1.0] for i in at])

    for target in targets:
        models.append(plain_regression(matrix(everyone, final), target, weight))
        out = np.zeros(len(rows))
        for f in range(folds):
            fit, ask = [i for i in everyone if i % folds != f], [i for i in everyone if i % folds == f]
            out[ask] = 1 / (1 + np.exp(-(matrix(ask, per_fold[f]) @ plain_regression(matrix(fit, per_fold[f]), target[fit], weight[fit]))))
        earlier.append(out)

    def score(text):
        p = []
        for w in models:
            p.append(1 / (1 + np.exp(-float(np.array([float(f in text) for f in final] + p + [1.0]) @ w))))
        return p

    return score


def test_toxicity_chain_against_plain_version():
    rng = random.Random(12)
    marks = [["aaa", "bbb"], ["ccc", "ddd"], ["eee", "fff"]]
    rows, y = [], []
    for i in range(240):
        row, kind = {rng.choice("ghijklmn") * 2 for _ in range(5)}, rng.randrange(3)
        if i % 4 == 0:
            row |= {m for m in marks[kind] if rng.random() < 0.9}
        elif rng.random() < 0.05:
            row.add(rng.choice(marks[kind]))
        rows.append(row)
        y.append(int(i % 4 == 0))
    weight = np.where(np.array(y) == 1, 2.0, 5.0)
    model = toxicity.fit_rows([sorted(r) for r in rows], {"toxic": np.array(y, float)}, weight)
    full = model.vocabulary
    x = np.zeros((len(rows), len(full)))
    for i, r in enumerate(rows):
        x[i, [full[f] for w in r for f in toxicity.word_features(w) if f in full]] = 1
    toxic = [i for i, t in enumerate(y) if t]
    kinds_of = np.full(len(rows), -1)
    kinds_of[toxic] = toxicity.kinds(x[toxic], 3)
    assert sorted(set(kinds_of[toxic])) == [0, 1, 2]
    # The plain version's rows hold every feature of a word, as the operator's do.
    plain = plain_chain([{f for w in r for f in toxicity.word_features(w)} for r in rows], y, weight * (len(y) / weight.sum()), kinds_of)
    for r in rows:
        mine = toxicity.probabilities(toxicity._present(" ".join(sorted(r)), full, {}), model)
        assert mine == pytest.approx(plain({f for w in r for f in toxicity.word_features(w)}), abs=2e-3)


def test_bounded_sample_at_any_size(spark):
    ids = spark.range(400_000).withColumn("doc_id", F.col("id"))
    for total, rows in ((10**12, 10**11), (3 * 10**10, 3 * 10**9), (400_000, 40_000)):
        assert abs(common.bounded_sample(ids, F.col("doc_id"), rows, total).count() - 40_000) < 1_000
    assert common.bounded_sample(ids, F.col("doc_id"), 20_000, 10**12).count() <= 2
    assert common.bounded_sample(ids, F.col("doc_id"), 400_000, 400_000).count() == 400_000


def test_labelled_samples_count_an_id_once(spark):
    docs = docs_of(spark, [(1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d"), (4, "e"), (6, "f")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (3, 0), (None, 1), (4, 7), (9, 1)], "doc_id long, toxic int")
    sample, totals = common.labelled_sample(docs, labels, "toxic", (100, 100))
    live = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    assert sorted(tuple(r) for r in sample.collect()) == [r for r in [(1, 1, "a"), (3, 0, "c")] if live(r[0])]
    assert totals == (sum(map(live, [3])), sum(map(live, [1, 2, 9])))


def test_scores_mean_the_same_when_a_class_is_sampled(spark):
    """The clean class learned from a tenth of its rows gives about the probabilities that all its rows give."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        toxic = i % 10 == 0
        words = [f"w{rng.randrange(60)}" for _ in range(12)] + (["markone"] if rng.random() < (0.6 if toxic else 0.02) else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    shares = []
    for most in (30_000, 700):
        got = toxicity.score_texts(docs, toxicity.fit(docs, marks, max_train=most)).collect()
        shares.append([np.mean([r.score for r in got if ("markone" in dict(rows)[r.doc_id]) == marked]) for marked in (True, False)])
    assert shares[0] == pytest.approx(shares[1], abs=0.08) and abs(shares[0][0] - 0.6 * 0.1 / (0.6 * 0.1 + 0.02 * 0.9)) < 0.08


def test_quality_against_plain_version(spark):
    import zstandard

    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["stone", "river", "under", "light", "over", "the", "and"]) for _ in range(rng.randrange(20, 400)))
    bad = lambda: " ".join(rng.choice(["xq##", "zz!!", "buy", "CLICK", "$$$", "win"]) for _ in range(rng.randrange(20, 400)))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(400, ""), (401, None), (402, "stone " * 40_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    model = quality.fit(docs, labels)
    assert model.slope > 0 and model.prior is None

    def plain(text):
        raw, saved = (text or "").encode(), 0
        n = max(1, round(len(raw) / 1024))
        for k in range(n if raw else 0):
            block = raw[len(raw) * k // n : len(raw) * (k + 1) // n]
            sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress(block)) for d in (model.good, model.bad)]
            saved += sizes[1] - sizes[0]
        return 1 / (1 + np.exp(-(model.slope * saved / max(1, len(raw)) + model.constant)))

    got = {r.doc_id: r for r in quality.score_texts(docs, model).collect()}
    for i, text in [*rows[:40], *rows[-3:]]:
        assert got[i].score == pytest.approx(plain(text), abs=1e-3)  # a compressor made for reuse may differ by a byte or two
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == int(i % 3 > 0) for i in held) and got[400].score == got[401].score


def test_language_of_other_scripts(spark):
    rng = random.Random(7)
    scripts = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπρσ", "ar": "ابتثجحخدذرزسشصضط", "zh": "的一是不了人我在有他这中大来上国", "bg": "абвгдежзиклмнопрст"}
    def word(lang):
        letters = scripts[lang]
        half = letters[: len(letters) // 2] if lang == "ru" else letters[len(letters) // 3 :]
        return "".join(rng.choice(half) for _ in range(rng.randrange(2, 7)))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(list(scripts) * 40)]
    docs = docs_of(spark, rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and all(got[i].lang_pred == lang for i, _, lang in held)
    vectors = language_id.letter_vectors(np.array([0, 97, 98, 1078, 945, 30340]), 11)
    assert np.abs(np.corrcoef(vectors) - np.eye(6)).max() < 0.15 and set(np.unique(vectors)) == {-1, 1}


def test_language_profile_against_plain_version():
    """Bind, permute and bundle letter by letter; also where more trigrams are met than a task remembers."""
    text = "Ünïcode текст, mixed 文字 and words. " * 3
    low, syms = f" {text.lower()} ", []
    for ch in low:
        s = ord(ch) if ch.isalpha() else 0
        if s or not syms or syms[-1]:
            syms.append(s)
    vec = {s: language_id.letter_vectors(np.array([s]), 11)[0].astype(int) for s in set(syms)}
    counts = {}
    for t in zip(syms, syms[1:], syms[2:]):
        counts[t] = counts.get(t, 0) + 1
    want = sum(np.log1p(n) * np.roll(vec[a], 2) * np.roll(vec[b], 1) * vec[c] for (a, b, c), n in counts.items())
    want = want / np.linalg.norm(want)
    for most in (32_768, 4):
        assert np.abs(language_id.profiles([text, None, "12 !"], language_id.Vectors(11, most=most))[0] - want).max() < 1e-5
    assert language_id.profiles([None, "", "3"], language_id.Vectors(11)) == [None] * 3


def test_rare_languages_are_learned(spark):
    rows = [(i, "common words of this tongue " + "abc " * (i % 5), "xx") for i in range(2000)] + [(i, "žřč ďťň ůúě", "yy") for i in range(2000, 2010)]
    model = language_id.fit(docs_of(spark, rows), per_language=50)
    assert model.langs == ("xx", "yy")


# ---- fingerprints ------------------------------------------------------------------------------------------------------


def test_entropy_is_kept_up_exactly():
    raw = np.frombuffer(("The quick brown fox. " * 20 + "a" * 90 + "zq9!" * 30).encode(), np.uint8)
    for width in (64, 16, 8):
        sums = fingerprint._entropies(raw, width) / fingerprint._SCALE
        for at in (0, 5, 200, len(raw) - width):
            c = np.bincount(raw[at : at + width], minlength=256).astype(float)
            assert sums[at] == pytest.approx((c[c > 0] * np.log2(c[c > 0])).sum(), abs=1e-3)


def test_fingerprints(spark, odd, empty):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 400))) for _ in range(25)]
    rows = list(enumerate(texts)) + ODD[1:4]
    rng.shuffle(rows)
    got = {(r.doc_id, r.edited_sha256): r for r in fingerprint.fingerprint_documents(docs_of(spark, rows).repartition(5)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    import hashlib

    for k, (i, text) in enumerate(ordered):
        other = ordered[(k + 1) % len(ordered)][1] or ""
        changed = fingerprint.edited(text or "", other)
        r = got[i, hashlib.sha256(changed.encode()).hexdigest()]
        mine, theirs, nxt = (fingerprint.digest(x.encode()) for x in (text or "", changed, other))
        assert r.n_chars == len(text or "") and r.fingerprint == fingerprint.encode(mine) and r.edited_fingerprint == fingerprint.encode(theirs)
        assert r.near_edited == pytest.approx(fingerprint.likeness(mine, theirs)) and r.near_next == pytest.approx(fingerprint.likeness(mine, nxt))
        assert np.array_equal(fingerprint.decode(r.fingerprint), mine)
    assert fingerprint.fingerprint_documents(odd).count() == len(ODD) and fingerprint.fingerprint_documents(empty).isEmpty()
    one = fingerprint.fingerprint_documents(docs_of(spark, [(3, texts[0])])).first()
    assert one.near_next == 1.0


def test_likeness_follows_shared_text():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).encode()
    a, b = text(20_000), text(20_000)
    half = a[:10_000] + b[10_000:]
    d = fingerprint.digest
    assert fingerprint.likeness(d(a), d(a)) == 1 and fingerprint.likeness(d(a), d(b)) < 0.05
    assert 0.3 < fingerprint.likeness(d(a), d(half)) < 0.8
    assert fingerprint.likeness(d(b""), d(b"")) == 1 and fingerprint.likeness(d(b""), d(a)) == 0


def test_likeness_across_sizes():
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))[:n]
    near = lambda x, y: fingerprint.likeness(fingerprint.digest(x.encode()), fingerprint.digest(y.encode()))
    for long, short in ((515, 505), (600, 450), (68, 62), (100, 50), (600, 60)):
        for _ in range(10):
            text = words(long)
            assert near(text, text[:short]) > 0.6 and near(text[:short], text) > 0.6, (long, short)
            assert near(text, words(short)) < 0.25, (long, short)
    for n in (1000, 120):
        text = words(n)
        changed = fingerprint.edited(text, "end")
        assert len(changed) == n // 2 + 3 and near(text, changed) > 0.6


def plain_features(data, width):
    """Selected windows of a width by definition: the rarest window within width // 2 on either side, leftmost of equals."""
    if len(data) < width:
        return [data] if data else []
    ranks = []
    for at in range(len(data) - width + 1):
        window = data[at : at + width]
        total = sum(c * np.log2(c) for c in {b: window.count(b) for b in window}.values())
        entropy = 1 - round(total * fingerprint._SCALE) / (fingerprint._SCALE * width * np.log2(width))
        ranks.append(1 << 30 if entropy < 0.33 else int(65_000 - abs(entropy - 0.68) * 65_000))
    reach, out = width // 2, []
    for at, r in enumerate(ranks):
        near = ranks[max(0, at - reach) : at + reach + 1]
        if r < 1 << 30 and r == min(near) and r not in ranks[max(0, at - reach) : at]:
            out.append(data[at : at + width])
    return out or [data[:width]]


def test_fingerprint_against_plain_version():
    """Features window by window, filters bit by bit, likeness filter by filter."""
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(n)).encode()

    def plain_chains(data):
        out = {}
        for width in [w for w, least in ((64, 512), (16, 64), (8, 0)) if len(data) >= least and data]:
            hashes = []
            for f in plain_features(data, width):
                h = 0
                for k, b in enumerate(f):
                    h = (h + int(fingerprint._byte_values()[b]) * pow(fingerprint._BASE, k, 2**64)) % 2**64
                h = (h + len(f)) % 2**64
                h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
                hashes.append(h ^ (h >> 31))
            out[width] = [{h >> 11 * k & 2047 for h in hashes[i : i + 160] for k in range(5)} for i in range(0, len(hashes), 160)]
        return out

    def plain_likeness(a, b):
        if not a or not b:
            return float(not a and not b)
        width = min(max(a), max(b))
        x, y = sorted((a[width], b[width]), key=len)
        best = []
        for f in x:
            scores = []
            for g in y:
                most, chance = min(len(f), len(g)), len(f) * len(g) / 2048
                chance += 0.1 * (most - chance)
                scores.append(min(1.0, max(0.0, (len(f & g) - chance) / max(most - chance, 1e-9))))
            best.append(max(scores))
        return sum(best) / len(best)

    texts = [b"", b"abc", text(3), text(20), text(60), text(200), b"a" * 700, text(900)]
    texts += [t[: len(t) // 2] + text(30) for t in texts[3:6]]
    plain, real = [plain_chains(t) for t in texts], [fingerprint.digest(t) for t in texts]
    for t, chains, d in zip(texts, plain, real, strict=True):
        want = [(w, f) for w in sorted(chains, reverse=True) for f in chains[w]]
        assert [(int(row[0]), set(np.flatnonzero(np.unpackbits(row[1:])).tolist())) for row in d] == want, t
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = 1.0 if a == b else plain_likeness(plain[i], plain[j])
            assert fingerprint.likeness(real[i], real[j]) == pytest.approx(want, abs=1e-5) or np.array_equal(real[i], real[j])


def test_fingerprints_of_a_run_of_texts():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 7, 8, 9, 63, 64, 65, 511, 512, 513, 3000, 40_000)]
    texts += [b"a" * n for n in (7, 8, 64, 512)] + [b"ab" * 300, b"", b"ab" * 300]
    rng.shuffle(texts)
    for got, text in zip(fingerprint.digests_by_run(texts), texts, strict=True):
        assert np.array_equal(got, fingerprint.digest(text))
    assert fingerprint.digests_by_run([]) == []


def test_fingerprint_ranges_of_frequent_ids(spark):
    """One id and the null id hold most rows: they are split, and every row still meets its next one."""
    rng = random.Random(2)
    rows = [(7, f"seven {rng.random()}") for _ in range(120)] + [(None, f"none {rng.random()}") for _ in range(60)] + [(rng.randrange(100), f"other {rng.random()}") for _ in range(60)]
    docs = docs_of(spark, rows).repartition(3)
    placed, parts = fingerprint.ranges(docs, per_task=60)
    sizes = [r["count"] for r in placed.where("NOT ghost").groupBy("part").count().collect()]
    assert parts > 40 and max(sizes) < 30 and sum(sizes) == len(rows)
    ordered = placed.where("NOT ghost").select("doc_id", "h", "text", "part").collect()
    ordered.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text))
    assert [r.part for r in ordered] == sorted(r.part for r in ordered)
    import hashlib

    want = sorted(hashlib.sha256(fingerprint.edited(r.text, ordered[(k + 1) % len(ordered)].text).encode()).hexdigest() for k, r in enumerate(ordered))
    assert sorted(r.edited_sha256 for r in fingerprint.fingerprint_documents(docs).collect()) == want


# ---- mixing ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights):
    """The contract's rounds, one by one."""
    caps, target, left, live = [2 * s for s in sizes], [0.0] * len(sizes), 1.5 * sum(sizes), [k for k, s in enumerate(sizes) if s]
    while left > 1e-9 and live:
        share = left / sum(weights[k] for k in live)
        for k in live:
            target[k] += weights[k] * share
        left = sum(max(0.0, target[k] - caps[k]) for k in live)
        target = [min(t, c) for t, c in zip(target, caps, strict=True)]
        live = [k for k in live if target[k] < caps[k]]
    return target


def test_targets():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 12))]
        weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))]
        assert mixing.fill_targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights), abs=1e-6)
    assert mixing.fill_targets([], []) == []


def test_mixing(spark, odd, empty):
    rng = random.Random(6)
    rows = [(i, "x " * rng.randrange(0, 900), None, rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)] + [(400, "w " * 30_000, None, "b"), (401, None, None, "z"), (5, "y y", None, "a"), (5, "y y", None, "a")]
    docs = docs_of(spark, rows)
    got = [tuple(r) for r in mixing.mix_documents(docs).collect()]
    assert sorted(got) == sorted(tuple(r) for r in mixing.mix_documents(docs.repartition(7)).collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((d, s) for d, s, *_ in got) == sorted((r[0], size(r[1])) for r in rows)
    assert all(0 <= taken <= 2 * s for _, s, _, _, taken in got)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in sources]
    want = plain_targets(sizes, [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sources))])
    by_target = {}
    for _, _, total, target, taken in got:
        by_target[total, target] = by_target.get((total, target), 0) + taken
    assert sorted((s, pytest.approx(t)) for s, t in by_target) == sorted(zip(sizes, want, strict=True))
    assert all(abs(taken - target) <= 1 for (_, target), taken in by_target.items())
    assert mixing.mix_documents(odd).count() == len(ODD) and mixing.mix_documents(empty).isEmpty()
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() > 300


# ---- packing -----------------------------------------------------------------------------------------------------------


def check_packed(rows, pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    spans, docs = {}, {}
    for p in pieces:
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append(p)
    assert sorted(spans) == list(range(len(spans)))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    for doc_id in {r[0] for r in rows}:
        texts = [r[1] or "" for r in rows if r[0] == doc_id]
        ids = tok.encode(texts[0], add_special_tokens=False).ids + [2]
        mine = sorted(docs[doc_id], key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(ids) * len(texts)
        for p in mine:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_packing(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Some", "words,", "ünd", "x.y", "don't", "12", "thing."]) for _ in range(rng.randrange(0, 700))), None, rng.choice(["a", "a", "b", None])) for i in range(120)]
    check_packed(rows, packing.pack_documents(docs_of(spark, rows)).collect())
    check_packed(ODD, packing.pack_documents(odd).collect())
    assert packing.pack_documents(empty).isEmpty()


def test_tokens_by_word_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["", "  ", "\n\n a\tb", "É é İstanbul ΑΣ ΣΑΣ.", "it's don't I'LL foo.. bar,. x.y a,b", "<|endoftext|> a<|ENDOFTEXT|>b.", "a\u2028b c \x1cd\x85e ７８９ 12.5,", "日本語 テキスト。 ⅷ ª ß ẞ ſ", "ǅ ŉ ẋ.", "\u0301 abc \u0301x", "naïve, NAÏVE. Œuvre, ÿ Ÿ µ"]
    assert [list(np.frombuffer(x, "<u2")) for x in packing.encode_texts(texts, path)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_robin_keeps_to_its_shares():
    shares = np.array([0.6, 0.3, 0.1])
    queues = packing.SourceQueues(shares, np.zeros(3), quantum=256)
    for s, n in enumerate((60_000, 30_000, 10_000)):
        for k in range(0, n, 500):
            queues.put(s, packing._Doc((s, k), 500, b""))
    seen, at = np.zeros(3), 0
    for doc, _, n, _, _ in queues.pack(100_000):
        seen[doc.doc_id[0]] += n
        at += n
        assert np.abs(seen - shares * at).max() <= 2 * 256
    assert seen.tolist() == [60_000, 30_000, 10_000] and packing.windows_of(4096 * 2 + 11) == [4096, 4096, 8, 2, 1]


# ---- urls --------------------------------------------------------------------------------------------------------------


def brute_url(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(common.ASCII_UPPER, common.ASCII_LOWER)), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("extra", [(), (url_filter.UrlRule("example.net", "", "block"), url_filter.UrlRule("net", "/de/8x", "allow"))])
def test_url_filter(spark, extra):
    rules = (*url_filter.BASE_RULES, *extra)
    urls = [None, "", "no scheme/en/", "http://Example.COM/en/7", "https://a.example.com/en/71?x#y", "http://xexample.com/en/7", "http://com/en/", "ftp://a.b.net/de/8", "http://example.net/de/8x", "http://example.net", "a://b://c", "http://x.org/es/#f", "http://x.org?/es/", "http://..com/en/", "http://É.net/de/", "http://Example.net:80/de/", "http://m.example.net/de/80"] * 2
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    for r in url_filter.filter_urls(pages, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(urls[r.page_id], rules), urls[r.page_id]
    assert url_filter.filter_urls(pages, ()).where("verdict <> 'allow'").isEmpty() and url_filter.filter_urls(pages.limit(0), rules).isEmpty()


def test_url_hosts_of_very_many_labels(spark):
    deep = "a." * 100_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{deep}/en/7/x"), (2, "http://" + "." * 50_000 + "/en/"), (3, f"http://{deep}x/en/7")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: (None, "allow")}


def test_url_filter_by_a_shuffled_rule_table(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    urls = ["http://É.Example.COM/en/7", "http://a.net/de/9", "http://example.net/de/8", "http://b.org/es/", None] * 3
    pages = spark.createDataFrame([(i % 7, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages).collect()), key=repr)
    assert got == sorted(((i % 7, *brute_url(u, url_filter.BASE_RULES)) for i, u in enumerate(urls)), key=repr)


# ---- embeddings --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("slab_rows", [8192, 60])
def test_embedding_links(spark, slab_rows):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([c + rng.standard_normal((20, 16)) * 0.2 for c in centres] + [rng.standard_normal((60, 16))]).astype(np.float32)
    vectors = [[float(v) for v in row] for row in x] + [[float(v) for v in x[0]]] * 3 + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    order = list(range(len(vectors)))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame([(i * 2, vectors[i], i) for i in order], "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(df, slab_rows=slab_rows).collect()}
    good = {i: np.array(v, np.float32).astype(float) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    comp = {i: i for i in range(len(vectors))}
    links = {i: 0 for i in comp}
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.95:
                links[i] += 1
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if c in (a, b) else c for k, c in comp.items()}
    assert sum(links.values()) > 500
    for i in comp:
        assert (got[2 * i].n_links, got[2 * i].component_id, got[2 * i].kept) == (links[i], 2 * comp[i], comp[i] == i)
    assert embedding_dedup.embedding_links(df.limit(0)).isEmpty()


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200])
def test_embeddings_in_double_precision(spark, scale):
    """Cosines a hair above and below the bound, told apart only by digits that single precision hasn't got."""
    rng = np.random.default_rng(8)
    vectors = []
    for eps in (1e-9, -1e-9) * 6:
        a = rng.standard_normal(12)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(12)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.95 + eps
        vectors += [a * scale, (c * a + np.sqrt(1 - c * c) * b) * scale * 3]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_links(df, slab_rows=7).collect()}
    unit = [exact / np.linalg.norm(exact) for exact in (v / np.abs(v).max() for v in vectors)]
    assert got == {i: sum(j != i and float(u @ w) >= 0.95 for j, w in enumerate(unit)) for i, u in enumerate(unit)}
    assert sum(got.values()) == 12


# ---- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, odd, empty):
    """Every stage keeps the columns, whatever their names, and has a result for nulls, empty and long texts, repeats and no rows at all."""
    import corpus_pipeline as P

    clash = {c: F.lit(1) for c in ("_id", "_of", "_copies", "_copy", "_text", "_key", "_k1", "_at", "block", "part", "cls", "grp", "h")}
    names = [n for n, _ in P.STAGES]
    for name, stage in P.STAGES:
        for docs in (odd.withColumns(clash), empty.withColumns(clash)):
            out = stage(spark, docs, DIR)
            if name != names[-1]:
                assert out.columns == docs.columns, name
            rows = out.collect()
            assert bool(rows) == (docs.columns == odd.withColumns(clash).columns and not docs.isEmpty()), name
    kept = {name: sorted((r.doc_id for r in stage(spark, odd, DIR).collect()), key=repr) for name, stage in P.STAGES[:4]}
    ids = sorted((r[0] for r in ODD), key=repr)
    assert kept["toxicity"] == ids
    # Nothing to learn a language from: letters decide.
    assert kept["language_id"] == sorted([4, 4, None, 5, 6, 7, 8], key=repr)
    assert kept["ngram_join"] == sorted([1, 2, 3, 4, None, 5, 6, 7], key=repr)
    assert set(kept["mixing"]) <= {4, None, 5, 6, 7, 8} and 5 in kept["mixing"]


def test_mixed_rows_follow_the_mix(spark):
    rng = random.Random(9)
    rows = [(i, "x " * rng.randrange(1, 400), None, rng.choice("abc")) for i in range(120)]
    docs = docs_of(spark, rows).withColumn("_id", F.lit(3))
    times = {}
    for r in mixing.mixed_rows(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {r.doc_id: int(np.floor(r.taken / r["size"] + 0.5)) for r in mixing.mix_documents(docs).collect()}
    assert times == {k: v for k, v in want.items() if v}


def test_language_stage_bound(spark):
    docs = docs_of(spark, [(i, "some english looking words here", "en") for i in range(30)] + [(100 + i, "ganz andere wörter stehen da", "de") for i in range(30)])
    model = language_id.fit(docs)
    mixed = docs_of(spark, [(1, "some english words"), (2, "andere wörter"), (3, "12"), (4, None)])
    assert sorted(r.doc_id for r in language_id.drop_unknown(mixed, model).collect()) == [1, 2]
    assert [r.doc_id for r in language_id.drop_unknown(mixed, model, languages=frozenset(["de"])).collect()] == [2]
    assert language_id.drop_unknown(mixed, model, least=1.0).isEmpty()


def test_pipeline_run(spark):
    """The whole run over the smallest tables: its pieces are those of the stages one by one."""
    import corpus_pipeline as P

    pieces = P.run(spark, DIR).collect()
    before = common.table(spark, DIR, "documents")
    for name, stage in P.STAGES[:-1]:
        before = common.written(stage(spark, before, DIR), f"again-{name}")
    check_packed([(r.doc_id, r.text) for r in before.collect()], pieces)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = common.table(spark, DIR, "documents")
    before = docs
    for name, stage in P.STAGES[:-1]:
        out = common.written(stage(spark, before, DIR), f"test-{name}")
        assert out.columns == docs.columns and out.count() > 0
        if name == "ngram_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, c in brute_components(rows) if d == c)
        elif name in ("toxicity", "language_id"):
            assert out.count() >= 0.85 * before.count()
        before = out
    rows = [(r.doc_id, r.text) for r in before.collect()]
    check_packed(rows, P.STAGES[-1][1](spark, before, DIR).collect())


def test_registered_queries_and_guard():
    import __spark_entry__ as E

    names = E.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)
