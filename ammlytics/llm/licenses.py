"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A phrase matches where its words stand
consecutively, anywhere in the whole text. Where the words of an identifier tag (``SPDX-License-Identifier:``) match, the rest of the
line in the original text is read as an expression: identifiers joined by AND, OR, WITH and parentheses (WITH binds closest,
then AND, then OR), as far as it is well formed. An identifier that is on no list here gets the label ``unknown``, one that begins with
``LicenseRef-`` or ``DocumentRef-`` the label ``licenseref``. Time grows with the length of a text, whatever it holds.

Rows. Null text is empty: no words, no matches, score 0. Rows are independent of each other; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ammlytics.llm import _arrays as A
from ammlytics.llm._spark import texts

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices of this scan.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl-1",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "gnu library general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license version 2": "epl-2",
    "apache license": "apache",
    "apache software license": "apache",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "european union public licence": "eupl",
    "python software foundation license": "psf",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "sil open font license": "ofl",
    "microsoft public license": "ms-pl",
    "open data commons": "odc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
}
TAGS = ("spdx license identifier",)
# Identifiers of licences in expressions (lower case, without what says the version is a minimum) and their labels.
ALIASES = {"apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-3.0": "lgpl-3", "agpl-3.0": "agpl-3", "mpl-2.0": "mpl-2", "epl-2.0": "epl-2", "cc0-1.0": "cc0", "bsl-1.0": "bsl-1"}
KNOWN = frozenset(
    """0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware
    blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6
    cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0
    cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c
    cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0
    hpnd icu ijg imagemagick intel ipl-1.0 isc json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libtiff lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception
    ms-pl ms-rl mulanpsl-2.0 ncsa nposl-3.0 odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql
    psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.0 zpl-2.1""".split()
)
PERMISSIVE = frozenset(
    """mit mit-0 apache apache-1.1 apache-2 bsd 0bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear isc bsl-1 cc0 cc-by cc-by-3.0 cc-by-4.0
    public-domain unlicense zlib libpng curl icu ncsa postgresql psf-2.0 python-2.0 unicode-3.0 unicode-dfs-2016 upl-1.0 wtfpl x11 blueoak-1.0.0""".split()
)
UNKNOWN, REFERENCE = "unknown", "licenseref"
#: How sure a kind of evidence is.
WEIGHT = {"base": 0.9, "tag": 0.95, "notice": 0.7}

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[list(range(0x00, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x80))] = True
_FOLD = bytes(32 if _SEPARATORS[b] else (b + 32 if 65 <= b <= 90 else b) for b in range(256))
_TAG = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])spdx-license-identifier\s*:", re.I)
_TOKEN = re.compile(r"\s*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+\-]*))")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def parse(line: str) -> list[str]:
    """The longest well-formed expression at the start of line, in reverse Polish notation ([] if there is none)."""
    out: list[str] = []
    stack: list[str] = []
    done, rest = 0, []  # the best expression so far: out[:done] and these operators
    at, depth, operand = 0, 0, True
    while m := _TOKEN.match(line, at):
        at = m.end()
        if m[1]:
            if not operand:
                break
            stack.append("(")
            depth += 1
            continue
        word = m[3] and m[3].upper()
        if m[2]:
            if operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _BINDS:
            if operand:
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
            continue
        else:
            if not operand:
                break
            out.append(m[3].lower().rstrip(".") or m[3].lower())
            operand = False
        if not depth:  # at most one operator of each kind waits here
            done, rest = len(out), stack[::-1]
    return out[:done] + rest


def label(identifier: str) -> str:
    """Label of an identifier of an expression."""
    x = identifier.removesuffix("-or-later").removesuffix("-only").rstrip("+")
    if x in ALIASES:
        return ALIASES[x]
    if x.startswith(("licenseref-", "documentref-")):
        return REFERENCE
    return x if x in KNOWN else UNKNOWN


def evaluate(rpn: list[str], allowed: frozenset = PERMISSIVE) -> bool:
    """Is there a choice at each OR under which every licence is allowed? An exception (WITH) only adds rights."""
    stack: list[bool] = []
    for x in rpn:
        if x in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a if x == "WITH" else a and b if x == "AND" else a or b)
        else:
            stack.append(label(x) in allowed)
    return stack[-1] if stack else False


def identifiers(rpn: list[str]) -> list[str]:
    """Licence labels of an expression; what follows WITH is an exception, not a licence."""
    names: list[str] = []
    spans: list[tuple[int, int]] = []  # each part of an expression is a run of its operands
    except_ = [0]
    for x in rpn:
        if x in _BINDS:
            (b, end), (a, _) = spans.pop(), spans.pop()
            spans.append((a, end))
            if x == "WITH":
                except_[b] += 1
                except_[end] -= 1
        else:
            spans.append((len(names), len(names) + 1))
            names.append(x)
            except_.append(0)
    inside, found = 0, []
    for name, step in zip(names, except_, strict=False):
        inside += step
        if not inside:
            found.append(label(name))
    return found


@cache
def _automaton():
    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("base", BASE), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def scan(text: str | bytes | None) -> tuple[int, list[tuple[str, str, int, int]], list[str], bool | None]:
    """Number of words; matches (label, kind, first word, words); expressions; may all expressions be met by permissive licences?"""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split(b" ")
    words = [x for x in words if x] if b"" in words else words
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    matches, expressions, tagged, permitted = [], [], False, None
    blanks = place = 0  # matches come in order of their ends, so blanks are counted once
    for end, (kind, label_, _, count) in _automaton().iter(joined):
        blanks += joined.count(" ", place, end + 1)
        place = end + 1
        if kind == "tag":
            tagged = True
        else:
            matches.append((label_, kind, blanks - 1 - count, count))
    if tagged:
        before = place = 0
        stop = -1
        for m in _TAG.finditer(raw):
            before += len(raw[place : m.start()].translate(_FOLD).split())
            place = m.start()
            if m.end() > stop:
                stop = raw.find(b"\n", m.end())
                stop = stop if stop >= 0 else len(raw)
            following = _TAG.search(raw, m.end(), stop)  # a line may hold several tags: each one's expression ends before the next
            rpn = parse(raw[m.end() : following.start() if following else stop].decode("utf-8", "replace"))
            if rpn:
                expressions.append(" ".join(rpn))
                permitted = evaluate(rpn) and permitted is not False
                matches += [(x, "tag", before, 3) for x in dict.fromkeys(identifiers(rpn))]
    return len(words), matches, expressions, permitted


_MATCH = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("words", pa.int64())])


def license_scan(docs: DataFrame) -> DataFrame:
    """Of docs(doc_id, text): doc_id, n_words, matches (label, kind base/notice/tag, first word, words), expressions (reverse Polish), permissive (null without expressions)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(_MATCH)), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())])

    def run(batches):
        for ids, data, offsets in A.chunks(batches, 2):
            raw = data.tobytes()
            found = [scan(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            matches = [[dict(zip(("label", "kind", "first", "words"), m, strict=True)) for m in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array(matches, pa.list_(_MATCH)), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([x[3] for x in found], pa.bool_())], schema=schema)

    return texts(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, matches array<struct<label string, kind string, first long, words long>>, expressions array<string>, permissive boolean")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of a scan."""
    base = F.filter("matches", lambda m: m["kind"] == "base")

    def labels(x: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")

    doubt = F.lit(1.0)
    kinds = F.transform("matches", lambda m: m["kind"])
    for kind, weight in WEIGHT.items():
        doubt = doubt * F.when(F.array_contains(kinds, kind), 1 - weight).otherwise(1.0)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        (1 - doubt).alias("score"),
        F.array_join("expressions", "; ").alias("expressions"),
        "permissive",
    )
