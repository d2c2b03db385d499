"""Further cases of the operators: recall over all pairs, linear time, hot runs, alignment of trees, large components, gaps."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from ammlytics.llm import ann, html_extract, licenses, line_dedup, ngram_join, packing, sentencepiece_bpe
from ammlytics.llm import _arrays as A
from ammlytics.llm._bpe import merge_one
from tests.llm.test_operators import components, corpus, table, texts_of, words

# 3 ---------------------------------------------------------------------------------------------------------------------------


def distinct_lines(path, most):
    import pyarrow.parquet as pq

    out = set()
    for text in pq.read_table(path, columns=["text"])["text"].to_pylist():
        out |= {x for line in (text or "").encode().split(b"\n") if (x := line_dedup.normalise(line)) and len(x) < most}
    return sorted(out)


def test_recall_of_the_query_over_all_pairs():
    """Pairs of real lines at edit similarity 0.9, found by brute force over all pairs: the keys of the query bring nine tenths and more together."""
    lines = distinct_lines("/root/testdata/sf0.001/documents.parquet", 1500)
    rng = random.Random(1)
    for x in rng.sample([x for x in lines if len(x) > 60], 60):  # near copies: one word in twenty replaced
        w = x.split()
        for i in rng.sample(range(len(w)), max(1, len(w) // 20)):
            w[i] = bytes(rng.choice(b"abcdefghij") for _ in range(len(w[i])))
        lines.append(b" ".join(w))
    lines = sorted(set(lines))
    pairs = [(i, j) for i, a in enumerate(lines) for j in range(i + 1, len(lines)) if min(len(a), len(lines[j])) >= 0.9 * max(len(a), len(lines[j])) and line_dedup.similar(a, lines[j], 0.9)]
    keys, sims = line_dedup.line_keys(lines, 6, 0.9, 20)
    sets = [set(k.tolist()) for k, _ in keys]
    near = line_dedup._by_place(0.9, line_dedup.FAR_BITS)
    spot = lambda i: np.array([len(lines[i]) << 16], np.uint64)
    met = [bool(sets[i] & sets[j]) and bool(near(spot(i), sims[i : i + 1], spot(j), sims[j : j + 1])[0]) for i, j in pairs]
    assert len(pairs) >= 50 and np.mean(met) >= 0.9


@pytest.mark.parametrize("most", [2000, 3])
def test_lines_of_one_hot_passage(spark, monkeypatch, most):
    """Many lines share a passage; those that are near copies go, those that only share it stay, whether the run has one star or many."""
    monkeypatch.setattr(line_dedup, "STARS", most)
    spell = lambda r, n: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n)]
    shared = spell(random.Random(2), 25)
    texts = [" ".join([*spell(random.Random(i), 12), *shared, *spell(random.Random(1000 + i), 12)]) for i in range(40)]
    copies = [t.replace(" ", "  ", 3).upper() + "!" for t in texts[:10]]
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(table(spark, texts + copies), grams=6, wide=20, small_run=2, block=4, chunk=8).collect()}
    assert all(got[i] == texts[i] for i in range(40)) and all(got[40 + i] == "" for i in range(10))


def test_lines_without_blanks_and_short_ones(spark):
    rng = random.Random(6)
    han = ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60)) for _ in range(5)]
    edited = [x[:30] + "新" + x[31:] for x in han]
    short = ["red blue green", "red blue greem", "one", "two"]
    got = [r.text for r in sorted(line_dedup.remove_lines(table(spark, han + edited + short), grams=6, wide=20, least_words=1).collect(), key=lambda r: r.doc_id)]
    assert got == han + [""] * 5 + ["red blue green", "", "one", "two"]


# 2 ---------------------------------------------------------------------------------------------------------------------------


def test_license_scan_is_linear():
    began = time.process_time()
    n, matches, _, _ = licenses.scan("cc by nc " * 60_000)
    assert n == 180_000 and [m[2] for m in matches if m[1] == "base"] == list(range(0, 180_000, 3))
    _, matches, expressions, permitted = licenses.scan("// SPDX-License-Identifier: MIT OR GPL-2.0-only\n" * 20_000)
    assert len(expressions) == 20_000 and permitted and [m[2] for m in matches if m[0] == "mit"] == list(range(0, 180_000, 9))
    licenses.scan("SPDX-License-Identifier: " * 30_000), licenses.scan("SPDX-License-Identifier: " + "MIT OR " * 60_000 + "MIT")
    licenses.scan("SPDX-License-Identifier: " + "(MIT OR " * 30_000 + "MIT" + ")" * 30_000)
    assert time.process_time() - began < 30


def test_license_identifiers_are_known():
    labels = lambda x: [m[0] for m in licenses.scan(f"SPDX-License-Identifier: {x}")[1]]
    assert labels("hello") == ["unknown"] and labels("GPL-3.0-or-later") == ["gpl-3"] and labels("LicenseRef-x AND MIT") == ["licenseref", "mit"]
    assert labels("Apache-2.0 WITH (LLVM-exception OR x) OR Zlib") == ["apache-2", "zlib"] and licenses.scan("xspdx-license-identifier: MIT")[1] == []


# 8 ---------------------------------------------------------------------------------------------------------------------------


def test_dropout_is_the_agenda_of_each_occurrence():
    """Against the heap run for each word by itself, with the same keys."""
    model = sentencepiece_bpe.pieces(sentencepiece_bpe.model_path())
    texts = ["the quick brown fox jumps over the lazy dog the the the internationalization", "a" * 120 + " x", "", "  two  blanks"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    docs, seed, p = np.array([7, 9, 1, 2], np.uint64), 5, 0.3
    flat, at = model.encode(data, offsets, p, seed, docs)
    least, different = np.uint64(int(p * 2**64)), set()
    for d, text, a, b in zip(docs, texts, at[:-1], at[1:], strict=True):
        marked = sentencepiece_bpe.MARK + text.replace(" ", sentencepiece_bpe.MARK) if text else ""
        starts = [i for i, c in enumerate(marked) if c == sentencepiece_bpe.MARK and (i == 0 or marked[i - 1] != c)]
        want = []
        for i, j in zip(starts, [*starts[1:], len(marked)], strict=False):
            key = A.mix(A.mix(np.array([d]) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) + np.uint64(i))
            skip = lambda s, m, e, into: bool((A.mix(key ^ sentencepiece_bpe._span(*[np.array([v]) for v in (s, m, e, into)])) < least)[0])  # noqa: B023, E731
            word = merge_one([int(model.char[ord(c)]) for c in marked[i:j]], model.table, skip)
            if marked[i:j] == sentencepiece_bpe.MARK + "the":
                different.add(tuple(word))
            want += word
        assert want == flat[a:b].tolist()
    assert len(different) > 1


# 7 ---------------------------------------------------------------------------------------------------------------------------


def test_partitions_exchange_over_a_gap(spark):
    """Many small partitions: rounds bring the count to that of one partition or near it, and no task holds all."""
    rng = random.Random(3)
    rows = [(i, 0, rng.randrange(500, 1100)) for i in range(4000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = packing.pack_pieces(pieces, partition_pieces=250).toPandas()
    assert len(got) == 4000 and got.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    whole = len(packing.best_fit_decreasing(np.array([x for _, _, x in rows]), 2048)[2])
    assert got.sequence_id.nunique() <= whole * 1.02


# 5 ---------------------------------------------------------------------------------------------------------------------------


def test_components_of_a_hot_cluster(spark):
    """Texts of all sizes that share hot passages, so that the pivot reaches few of them."""
    rng = random.Random(8)
    hot = words(rng, 12, 5000)
    texts = []
    for i in range(120):
        t = [*hot, *words(random.Random(i // 3), rng.randrange(20, 200), 9000)]
        t[rng.randrange(13, len(t))] = f"x{i}"
        texts.append(" ".join(t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(table(spark, texts), small_run=3, block=4, chunk=8, hot_from=2).collect()}
    assert got == components(texts)


# 9 ---------------------------------------------------------------------------------------------------------------------------


def say(i):
    return " ".join(words(random.Random(i), 30))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_alignment_finds_moved_template(spark, limit):
    """Without article tags, and with optional blocks that move the template's place among its siblings: alignment still finds it."""
    rows = []
    for i in range(30):
        promo = f"<div class=x>{say(5000 + i)}</div>" if i % 2 else ""
        rows.append((i, f"https://s.example/{i}", f"<body>{promo}<div class=x>Top line of the site</div><div class=b><p>{say(i)}</p>{'<p>' + say(100 + i) + '</p>' if i % 3 else ''}</div><div class=x>All rights, all pages</div></body>"))
    got = texts_of(spark, rows, broadcast_bytes=limit)
    assert got == {i: "\n".join([*[say(5000 + i)] * (i % 2), say(i), *[say(100 + i)] * (i % 3 > 0)]) for i in range(30)}
    bare = [html_extract.extract(r[2]) for r in rows]
    assert all(a != got[i] for i, a in enumerate(bare))  # the template decides


def test_matching_is_the_recursion():
    """Against the textbook recursion on random trees."""
    rng = random.Random(9)

    def tree(depth):
        return f"<{(t := rng.choice(['div', 'ul', 'section']))}>{''.join(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ''}</{t}>"

    def slow(a, i, b, j):
        if a.labels[i] != b.labels[j]:
            return 0
        x, y = a.kids[i], b.kids[j]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p, u in enumerate(x):
            for q, v in enumerate(y):
                m[p + 1][q + 1] = max(m[p][q + 1], m[p + 1][q], m[p][q] + slow(a, u, b, v))
        return m[-1][-1] + 1

    for _ in range(200):
        a, b = (html_extract.Tree.of(html_extract.parse(tree(4))[0])[0] for _ in range(2))
        size, found = html_extract.match(a, b)
        assert size == slow(a, 0, b, 0) == len(found) == len(set(found.values())) and all(a.labels[i] == b.labels[j] for j, i in found.items())


def test_pages_of_any_kind(spark):
    assert html_extract.extract('<p title="abc>broken quote</p><p>more</p>') == "broken quote\nmore"
    assert html_extract.extract("<p title='a>b' data-x=\"<i>\">ok</p><img alt=\"x>y\"/>after") == "ok\nafter"
    began = time.process_time()
    for page in ('<p title="abc>q</p>' * 20_000, "<div>" * 20_000 + "x" + "</q>" * 20_000, "<b>" * 5000 + "<p>x" * 5000, "<p>" + "long word " * 200_000, "<li>" * 20_000):
        html_extract.extract(page)
    assert time.process_time() - began < 30
    deep = "<div>" * 400 + "Site" + "</div>" * 400
    rows = [(1, "https://d.example/1", deep), (1, "https://d.example/1", deep), (2, "https://d.example/2", None), (3, None, deep), *[(10 + i, "https://d.example/x", deep + f"<p>{say(i)}</p>") for i in range(6)]]
    got = texts_of(spark, rows)
    assert got[1] == got[3] == "Site" and got[2] == "" and got[10].endswith(say(0))


# 10 --------------------------------------------------------------------------------------------------------------------------


def test_neighbours_of_multiples_and_large_components(spark):
    v = np.random.default_rng(5).normal(size=8)
    rows = [(i, (v * (i + 1)).tolist()) for i in range(40)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 3, 4, 5] or max(abs(r.score - 1) for r in got) < 1e-12
    rows = [(i, (np.roll(v, i % 8) * 10.0 ** (200 if i % 2 else -200)).tolist()) for i in range(40)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0").collect()
    assert len(got) == 20 and all(np.isfinite(r.score) for r in got) and all(r.score > 0.999 for r in got if r.rank <= 4)


def test_forest_recall_with_fewer_comparisons(spark):
    """On vectors without clusters: nine tenths of the nearest, from fewer comparisons than there are vectors."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 64))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()
    hit = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 150
    forest = ann.Forest(u, 4, 5, 7)
    for q in range(0, 1500, 100):
        opened = forest.search(u[q], 1425)
        assert sum(len(np.flatnonzero(forest.leaves(u)[:, t] == leaf)) for t, leaf in opened[:40]) <= 1500
        assert 1425 <= sum(int(forest.trees[t][4][leaf]) for t, leaf in opened) < 1500
