"""Training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ammlytics.llm import ann, html_extract, language_id, licenses, line_dedup, ngram_join, packing, sentencepiece_bpe, substring_dedup, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, n long, bucket string, body string"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, lang="en", ids=None):
    """documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, lang, "s", len(t or ""), 7, 7, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, size=60):
    return [f"w{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Random texts, exact copies, near copies of one text, shared passages, nulls, blanks, short and long ones."""
    rng = random.Random(seed)
    shared = " ".join(words(rng, 60, 5000))
    base = words(rng, 80, 5000)
    out = [None, "", "  \n ", "one two", "one two", "one two three four five", "é 日本 ü x", "x" * 30_000]
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(99)}"
            out.append(" ".join(t))
        elif kind == 1:
            out.append(" ".join(words(rng, 30, 5000)) + "\n" + shared + " " + " ".join(words(rng, 20, 5000)))
        elif kind == 2:
            out.append(rng.choice([x for x in out if x]))
        elif kind == 3:
            out.append("A b c d e\n" * rng.randrange(1, 30))
        else:
            out.append(" ".join(words(rng, rng.randrange(1, 120), 5000)))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 5 ---------------------------------------------------------------------------------------------------------------------------


def components(texts, k=5):
    sets = []
    for t in texts:
        w = WHITE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("seed", "kw"), [(1, {}), (2, {"small_run": 2, "block": 3, "chunk": 4}), (3, {"small_run": 2, "hot_from": 2, "hot_tokens": 5})])
def test_near_duplicates_are_brute_force(spark, seed, kw):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(table(spark, texts), **kw).collect()}
    assert got == components(texts)


def test_near_duplicates_edges(spark, empty):
    assert ngram_join.similarity_components(empty).count() == 0
    got = {(r.doc_id, r.component_id) for r in ngram_join.similarity_components(table(spark, ["a b", "a b", "a b"], ids=[5, None, 5])).collect()}
    assert got == {(5, 5), (None, None)}


# 6 ---------------------------------------------------------------------------------------------------------------------------


def cut(texts, size=20):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = WHITE.findall(t or "")
        gone = set()
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            if g in seen:
                gone.update(range(s, s + size))
            seen.add(g)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_are_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(table(spark, texts)).collect()}
    assert got == cut(texts)


def test_substrings_edges(spark, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    t = " ".join(f"a{i}" for i in range(25))
    same = substring_dedup.remove_repeats(table(spark, [t, t], ids=[3, 3])).collect()  # one document, given twice
    assert [r.n_removed for r in same] == [0, 0]
    kept = {r.doc_id: (r.source, r.kept) for r in substring_dedup.remove_repeats(table(spark, [t, f"x\n\n{t}\nend", None]), layout=True, carry=("source",)).collect()}
    assert kept == {0: ("s", t), 1: ("s", "x\n\nend"), 2: ("s", None)}


# 3 ---------------------------------------------------------------------------------------------------------------------------


def test_edit_distance_and_similarity():
    rng = random.Random(4)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(1500):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(14))) for _ in range(2))
        most = rng.randrange(9)
        assert line_dedup.distance(a, b, most) == min(slow(a, b), most + 1)


@pytest.mark.parametrize("small_run", [64, 2])
def test_lines_are_brute_force(spark, small_run):
    rng = random.Random(5)
    base = [" ".join(words(rng, 14, 900)) for _ in range(6)]
    texts = [None, "", "short\nshort", "\n\n"]
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(base)
            lines.append(x if rng.random() < 0.5 else x.replace("w1", "w2", 1).upper() + rng.choice(["", "!", " ?"]))
        texts.append("\n".join(lines))
    norm = lambda x: line_dedup.normalise(x.encode())
    classes = sorted({norm(x) for t in texts if t for x in t.split("\n") if norm(x).count(b" ") >= 3})
    sims = line_dedup.simhashes(classes)
    up = {c: c for c in classes}

    def root(c):
        while up[c] != c:
            c = up[c]
        return c

    for i, a in enumerate(classes):
        for j in range(i):
            if int(sims[i] ^ sims[j]).bit_count() <= 3 and line_dedup.similar(a, classes[j], 0.9):
                up[root(a)] = root(classes[j])
    seen, want = set(), {}
    for i, t in enumerate(texts):
        if t is None:
            want[i] = None
            continue
        kept = []
        for x in t.split("\n"):
            c = norm(x)
            if c in up:
                if root(c) in seen:
                    continue
                seen.add(root(c))
            kept.append(x)
        want[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(table(spark, texts), small_run=small_run).collect()}
    assert got == want


def test_lines_at_the_similarity_are_found(spark):
    """Edits anywhere in a line, up to the similarity: what brute force joins is joined but for a hundredth, whatever the SimHash."""
    rng = random.Random(3)
    lines = []
    for i in range(400):
        x = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(4, 60)))
        y = bytearray(x.encode())
        for j in rng.sample([j for j, c in enumerate(y) if c != 32], len(y) // 10):
            y[j] = 97 + (y[j] - 97 + rng.randrange(1, 26)) % 26
        lines += [x, y.decode()]
    assert all(line_dedup.similar(a.encode(), b.encode(), 0.9) for a, b in zip(lines[::2], lines[1::2], strict=True))
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(table(spark, lines), grams=24).collect()}
    assert all(got[i] == lines[i] for i in range(0, 800, 2))
    assert sum(got[i] == "" for i in range(1, 800, 2)) >= 396
    sims = line_dedup.simhashes([x.encode() for x in lines])
    assert (np.bitwise_count(sims[::2] ^ sims[1::2]) <= 3).mean() < 0.5
    few = {r.doc_id: r.text for r in line_dedup.remove_lines(table(spark, lines), grams=24, small_run=1).collect()}
    assert few == got


def test_short_lines_go_once(spark, tmp_path):
    """Copies of lines of one to three words, and of lines in scripts without blanks, in the query."""
    from ammlytics.llm import queries

    lines = ["All rights reserved", "这是一个没有空格的句子。", "one", "日本語の文です"]
    texts = ["\n".join([*lines, "", f"{'abcdefgh'[i] * 12} stays"]) for i in range(3)] + ["All rights reserved!\n}\n}"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (6, 0), 1: (6, 4), 2: (6, 4), 3: (3, 1)}


def test_lines_edges(spark, empty):
    assert line_dedup.remove_lines(empty).count() == 0
    t = "one two three four\nfive six seven eight"
    got = [(r.doc_id, r.text) for r in line_dedup.remove_lines(table(spark, [t, t, t], ids=[1, 1, None])).collect()]
    assert sorted(got, key=str) == sorted([(1, t), (1, t), (None, t)], key=str)


# 1 ---------------------------------------------------------------------------------------------------------------------------


def test_winnowing_is_the_definition():
    rng = random.Random(6)
    k, w = 5, 4
    for _ in range(300):
        points = np.array([rng.randrange(3) for _ in range(rng.randrange(0, 60))], np.uint32)
        hashes, places = winnowing.winnow(points, k, w)
        if not len(points):
            assert not len(hashes)
            continue
        grams = winnowing.A.gram_hashes(points.astype(np.uint64), min(k, len(points))) >> np.uint64(32)
        size = min(w, len(grams))
        want = []
        for s in range(len(grams) - size + 1):
            window = grams[s : s + size].tolist()
            p = s + max(i for i, x in enumerate(window) if x == min(window))
            if p not in want:
                want.append(p)
        assert places.tolist() == want and hashes.tolist() == [int(grams[p]) for p in want]


def test_edited_texts(spark, empty):
    texts = corpus(7, 30)
    got = {r.doc_id: r for r in winnowing.edited_fingerprints(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = lambda x: winnowing.winnow(np.frombuffer(x.encode("utf-32-le"), np.uint32), 12, 10)
        assert r.fingerprint == winnowing.digest(*own(t)) and r.edited_fingerprint == winnowing.digest(*own(edited))
        assert r.near_next == winnowing.likeness(np.unique(own(t)[0]), np.unique(own(after)[0]))
        assert 0 <= r.near_edited <= 1
    assert winnowing.edited_fingerprints(empty).count() == 0
    one = winnowing.edited_fingerprints(table(spark, ["abcdef"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert winnowing.edited_fingerprints(table(spark, ["a", "b", "b", None], ids=[None, 1, 1, 2])).count() == 4
    kept = winnowing.fingerprints(table(spark, ["x" * 40])).first()
    assert len(kept.hashes) == len(kept.positions) and kept.fingerprint


# 2 ---------------------------------------------------------------------------------------------------------------------------


def test_license_expressions():
    assert licenses.parse("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0") == ["mit", "apache-2.0", "OR", "gpl-2.0-only", "classpath-exception-2.0", "WITH", "AND"]
    assert licenses.parse("MIT OR") == ["mit"] and licenses.parse(") MIT") == [] and licenses.parse("MIT */ AND") == ["mit"]
    assert licenses.evaluate(licenses.parse("MIT OR GPL-3.0")) and not licenses.evaluate(licenses.parse("MIT AND GPL-3.0"))
    assert licenses.identifiers(licenses.parse("GPL-2.0-only WITH x OR MIT")) == ["gpl-2", "mit"]


def test_license_scan_is_brute_force(spark, empty):
    texts = ["Released Under the MIT-License.\nunder the mit license", None, "", "# SPDX-License-Identifier: MIT OR Apache-2.0\nx", "apache license, version 2.0 CC BY-NC 4.0 ", "under the émit license", "permit under the mit licenses"]
    texts += [" ".join(random.Random(i).choices(["under", "the", "mit", "license", "cc", "by", "nc", "é"], k=40)) for i in range(30)]
    got = {r.doc_id: r for r in licenses.digest(licenses.license_scan(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        hits = sorted((s, label) for p, label in licenses.BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        r = got[i]
        assert r.n_words == len(w) and r.n_base == len(hits) and r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[3].labels == "apache-2,mit" and got[3].permissive and got[3].n_base == 0
    assert licenses.digest(licenses.license_scan(empty)).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------------------


def test_language_id(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(table(spark, [None, "", "12 !? \n", "é", "a", "the of and to " * 20_000]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] in model.languages and odd[4][0] in model.languages and odd[5][0] == "en"
    assert language_id.predict(table(spark, ["abc"]), language_id.fit(empty)).first().lang_pred == "und"
    assert language_id.predict(empty, model).count() == 0


def test_bloom_slices_hold_what_was_put_in():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 2**63, 2000).astype(np.uint64) | np.uint64(1) for _ in range(70)]
    f = language_id.Filters([f"l{i:02}" for i in range(70)], keys, 0)
    for i in (0, 63, 64, 69):
        mask = np.full(2000, ~np.uint64(0))
        for s in language_id._slots(keys[i]):
            mask &= f.table[i // 64][s]
        assert ((mask >> np.uint64(i % 64)) & np.uint64(1)).all()


# 7 ---------------------------------------------------------------------------------------------------------------------------


def test_packing(spark, empty):
    from tokenizers import Tokenizer

    texts = corpus(8, 40)
    reference = Tokenizer.from_file(packing.tokenizer_path())
    reference.encode_special_tokens = True
    rows = packing.pack(table(spark, texts), size=64, partition_pieces=30).collect()
    by, fill = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids) and len(pieces) == -(-len(ids) // 64)
        for p in pieces:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(fill) <= packing.lower_bound(np.array([r.length for r in rows]), 64) * 1.1 + 1
    assert packing.pack(empty).count() == 0


def test_partitions_pass_on_their_gap():
    """Of a partition that is several sequences above its bound, ``give`` for each are exchanged."""
    import pyarrow as pa

    x = np.random.default_rng(4).integers(260, 480, 3000)
    free = packing.best_fit_decreasing(x, 1000)[2]
    gap = len(free) - packing.lower_bound(x, 1000)
    want = min(8 * gap, int((np.array(free) > 0).sum()))
    n = len(x)
    batch = pa.RecordBatch.from_pydict({"part": np.zeros(n, np.int64), "length": x, "sequence_id": np.full(n, -1), "offset": np.zeros(n, np.int64)})
    rows = pa.Table.from_batches(list(packing._packed(1000, 8, 0, False)([batch]))).to_pylist()
    assert gap > 1 and len({r["sequence_id"] for r in rows if r["open"]}) == want > 8


def test_bounds_certify():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.integers(1, 101, 40)
        bins, offsets, free = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= len(free) and all((x[bins == b].sum() <= 100) for b in range(len(free)))
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


# 8 ---------------------------------------------------------------------------------------------------------------------------


def test_merge_dropout(spark, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    texts = [*corpus(9, 30), "a" * 300, "   leading  and   wide ", "日本語 emoji 😀\x00", "tab\tnew\nline"]
    docs = table(spark, texts)
    plain = {r.doc_id: list(r.ids) for r in sentencepiece_bpe.encode(docs, dropout=0.0).collect()}
    assert plain == {i: model.encode(t or "") for i, t in enumerate(texts)}
    seeds = [{r.doc_id: list(r.ids) for r in sentencepiece_bpe.encode(docs, dropout=0.3, seed=s).collect()} for s in (1, 1, 2)]
    assert seeds[0] == seeds[1] != seeds[2] and seeds[0] != plain
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, dropout=0.3, seed=2)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.lossless for r in sentencepiece_bpe.round_trip(docs).collect()) and sentencepiece_bpe.round_trip(empty).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------------------


def test_extract_leaves_the_article():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="no-sidebar">
    <header><a>Home</a></header><nav><ul><li>Menu<li>More</ul></nav><div class="cookie-notice">Cookies!</div><!-- x -->
    <main><article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>three</b>&nbsp;four<p>Five<ul><li>six<li>seven</ul>
    <div class="ad">Buy</div><form><p>Name</p></form><table><tr><td>a<td>b</table><blockquote>q</blockquote></article>
    <section id="comments"><p>Nice!</p></section></main><aside>Side</aside><footer>(c)</footer>"""
    assert html_extract.extract(page) == "Head & line\nOne two three four\nFive\nsix\nseven\na\nb\nq"
    assert html_extract.extract(None) == html_extract.extract("") == "" and html_extract.extract("<p>a &lt b<p>c") == "a < b\nc"
    assert html_extract.extract("<body><p>x<!-- never ends") == "x" and html_extract.extract("plain") == "plain"


def pages(n, host):
    return [(i, f"https://{host}/{i}", f"<html><body><div class=top>Site of things</div><div class=c><p>{' '.join(words(random.Random(i), 30))}</p></div><div class=end>All about us</div></body></html>") for i in range(n)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_wrappers_find_the_template(spark, limit):
    rows = [*pages(30, "a.example"), (98, None, "<p>no host</p>"), (99, "https://b.example/", "<div class=top>Site of things</div>"), (97, "http://[bad", None)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, keys string"), broadcast_bytes=limit).collect()}
    assert all(got[i] == " ".join(words(random.Random(i), 30)) for i in range(30))
    assert got[98] == "no host" and got[99] == "Site of things" and got[97] == ""


def texts_of(spark, rows, **kw):
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **kw).collect()}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_wrappers_of_all_pages(spark, limit):
    """Two templates with the same places but for one, pages of many elements, and hosts of just LEAST pages."""
    say = lambda i: " ".join(words(random.Random(i), 30))
    rows = []
    for i in range(40):
        kind = i % 2
        rows.append((i, f"https://two.example/{i}", f"<body><div class=top>Template {kind}</div><div class=c{kind}><p>{say(i)}</p></div></body>"))
    for i in range(40, 45):
        more = "".join(f"<div class=x><span>{say(1000 * i + j)}</span></div>" for j in range(300))
        rows.append((i, f"https://long.example/{i}", f"<body><div class=top>Site of things</div><div class=c><p>{say(i)}</p></div>{more}</body>"))
    for i in range(50, 70):
        rows += [(4 * i + j, f"https://h{i}.example/{j}", f"<body><div class=top>Site {i}</div><div class=c><p>{say(4 * i + j)}</p></div></body>") for j in range(html_extract.LEAST)]
    got = texts_of(spark, rows, broadcast_bytes=limit)
    assert all(got[i] == say(i) for i in range(40))
    assert all(got[i].split("\n")[0] == say(i) and len(got[i].split("\n")) == 301 for i in range(40, 45))
    assert all(got[i] == say(i) for i in range(200, 280))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_wrappers_inside_articles(spark, limit):
    """A notice on every page goes from article and main, too; what three quarters of them have stays there."""
    say = lambda i: " ".join(words(random.Random(i), 30))
    rows = [(i, f"https://{tag}.example/{i}", f"<body><{tag}><h1>{say(i)}</h1><p>Read more on our site</p><p>{say(i + 100)}</p>{'<p>Well then</p>' if i % 4 else ''}<ul><li>Get the app</li></ul></{tag}></body>") for j, tag in enumerate(("article", "main")) for i in range(20 * j, 20 * j + 20)]
    got = texts_of(spark, rows, broadcast_bytes=limit)
    assert got == {i: "\n".join([say(i), say(i + 100), *["Well then"] * bool(i % 4)]) for i in range(40)}


def test_html_empty_table(spark):
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching():
    a, b = (html_extract.parse(x)[0] for x in ("<div><p>a</p><p>b</p></div>", "<div><p>a</p><ul></ul><p>c</p></div>"))
    assert html_extract.match(a, b)[0] == 4


# 10 --------------------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[50:120] = v[50]  # copies
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0] * 15 + [None], 0), (None, [1.0] * 16, 0), (404, [1.0, 2.0], 0), (50, v[50].tolist(), 1)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id % 50 = 0").collect()
    u = v.astype(np.float64)
    norm = np.sqrt((u * u).sum(1))
    hit = 0
    for q in range(0, 400, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        s = (u @ u[q]) / (norm * norm[q])
        order = sorted((x for x in range(400) if x != q), key=lambda x: (-round(s[x], 12), x))[:5]
        hit += len({x for _, x, _ in mine} & set(order))
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s[x] - z) < 1e-12 for _, x, z in mine) and q not in {x for _, x, _ in mine}
    assert hit >= 0.9 * 40 and [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [51, 52, 53, 54, 55]
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0


def test_neighbours_tied(spark):
    """Different vectors of the same cosine: the smallest vec_id come first."""
    v = np.random.default_rng(5).normal(size=8)
    rows = [(100 + i, (v * 2.0 ** ((i * 7) % 40 - 20)).tolist()) for i in range(40)] + [(0, v.tolist()), (1, (-v).tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [100, 101, 102, 103, 104]
