"""Operators that look at one text at a time."""
import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabred.llm import bpe, html, licenses, pii, quality, secrets
from tests_brute import base_personal, base_secrets, digest, quality_counts


def test_long_texts_are_cut_where_the_library_cuts(ranks):
    enc = bpe.encoding(*ranks)
    text = "Words,  and   more\n\nwords don't 's 12 3. x " * 500
    for size in (7, 100, 10 ** 6):
        assert bpe.encode(text, enc, size).tolist() == enc.encode_ordinary(text)
        assert "".join(bpe.pieces(text, size)) == text


def test_bpe_round_trip(odd, documents, ranks):
    rows = odd.select("doc_id", "text").union(documents.select("doc_id", "text"))
    enc = bpe.encoding(*ranks)
    texts = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), len(enc.encode_ordinary(r[1] or ""))) for r in rows.collect())
    assert Counter((r.doc_id, r.decoded_sha256, r.n_tokens) for r in bpe.round_trip(rows, *ranks).collect()) == texts
    ids = bpe.encode_texts(odd, *ranks)
    back = Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode_ids(ids, *ranks).collect())
    assert back == Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert bpe.round_trip(odd.limit(0), *ranks).count() == 0


def test_quality_counts_and_verdicts(spark, odd, documents, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = odd.select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    field = quality.train(documents, labels)
    got = quality.judge(rows, field).select("doc_id", "text", "quality.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_counts(r.text or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    held = {r.doc_id: r.quality for r in labels.collect()}
    sure = [(r.kept, held[r.doc_id - 1000]) for r in got if r.doc_id and r.doc_id - 1000 in held and not r.base_failed]
    assert sum(k == bool(q) for k, q in sure) >= 0.95 * len(sure)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert quality.quality_rules(odd.limit(0), labels.limit(0)).count() == 0
    assert quality.quality_rules(odd, labels.limit(0)).count() == odd.count()


def test_field_decodes_like_brute_force():
    import itertools
    import numpy as np
    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=len(quality.PRIOR)), rng.normal(size=(2, 2)))
    bounds = np.array([0, 4, 4, 9, 10])
    features = rng.normal(size=(10, len(quality.PRIOR)))
    got, score = field.decode(features, bounds), features @ field.weights
    for a, b in zip(bounds[:-1], bounds[1:]):
        def worth(states, a=a):
            return sum(score[a + i] * s for i, s in enumerate(states)) + sum(field.steps[s, t] for s, t in zip(states, states[1:]))
        assert b == a or tuple(got[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=worth)


def test_base_secrets(odd, documents):
    rows = odd.select("doc_id", "text", "source", "lang").union(documents.select("doc_id", "text", "source", "lang"))
    got = secrets.find_secrets(rows, F.col("source"), F.concat_ws("/", "source", "lang"))
    want = Counter((r.doc_id, digest(base_secrets(r.text or ""))) for r in rows.collect())
    assert Counter((r.doc_id, r.base_sha256) for r in got.collect()) == want
    for r in got.where("n_assign + n_access + n_hex > 0").collect():
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in secrets.KINDS[:3])
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
    assert secrets.find_secrets(odd.limit(0), F.col("source"), F.col("lang")).count() == 0


def test_secrets_that_many_own_are_examples(spark):
    token, copied = "Ab3dEf6hIj9lMn2pQr5tUv8x", "Zy1wVu4sRq7oNm0kJi3gFe6c"
    rows = [(i, f"key {copied} here", f"owner{i}", "r") for i in range(8)] + [(9, f"key {token} here", "owner1", "r"), (10, f"key {token} here", "owner1", "q")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, o string, r string"), F.col("o"), F.col("r")).collect()}
    assert all(got[i].spans == "" for i in range(8))
    assert got[9].spans == got[10].spans == "random:4:28" and got[9].n_live == 1 and got[9].most_repositories == 2


def test_base_personal_data(odd, documents):
    rows = odd.select("doc_id", "text").union(documents.select("doc_id", "text"))
    want = Counter((r[0], digest(base_personal(r[1] or ""))) for r in rows.collect() if len(r[1] or "") < 20_000)
    got = Counter((r.doc_id, r.base_sha256) for r in pii.find_private(rows).collect())
    assert not want - got
    assert pii.find_private(odd.limit(0)).count() == 0


def test_personal_data_is_masked(odd):
    masked = {r.doc_id: r for r in pii.mask_private(odd).collect()}
    assert masked[11].text == "mail <EMAIL> or <PHONE>, <IP>, <CARD>" and masked[11].n_chars == len(masked[11].text)
    assert masked[12].text.startswith("é😀 ünï <EMAIL> x") and masked[3].text is None and masked[4].text == ""
    assert pii.mask_private(odd).columns == odd.columns


def test_weak_labels_follow_the_better_labelers():
    good = [(4, (1, 1, 1, 1), 300), (4, (-1, -1, 0, -1), 300), (4, (1, 0, 0, 1), 50), (4, (-1, 0, 1, -1), 40), (5, (0, 0, 0, 1), 3)]
    fitted = pii.fit(good)
    score = lambda kind, votes: fitted.kinds[kind] + sum(w * v for w, v in zip(fitted.labelers, votes))
    assert score(4, (1, 1, 0, 1)) > 0 > score(4, (-1, -1, 1, -1))
    assert fitted.reliability[0] > fitted.reliability[2]
    assert pii.fit([]).reliability == [0.8] * 4


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a b\n c<p>d<script>x", "a b c\nd"),
    ("<nav><a href=x>menu, with, much, punctuation.</a></nav><article><h1>Head</h1><p>Long text, with a point. And more.</p><p>Short.</p>"
     "<section class='comments'><p>I think, that, all is wrong.</p></section></article><footer>Foot, note.</footer>", "Head\nLong text, with a point. And more.\nShort."),
    ("<body><div id=cookie-banner>We use, yes, cookies.</div><div class=main-col><h2>H</h2><p>Text, and more text, to read here.</p><ul><li>one<li>two</ul></div>"
     "<aside>Other, text.</aside><form><p>Name, please:</p></form></body>", "H\nText, and more text, to read here.\none\ntwo")])
def test_main_text(page, text):
    assert html.main_text(page) == text


BODY = "<p>A long paragraph, with commas, points and much to read. It goes on, and on, until the very end of it is reached.</p>"
READ = re.sub("<[^>]*>", "", BODY)


@pytest.mark.parametrize("page, text", [
    (f"<article><h1>Title</h1><p>Intro.</p><div class=entry-content>{BODY * 4}</div><p>End.</p></article><div>Site, all rights. And so on.</div>", ["Title", "Intro.", *[READ] * 4, "End."]),
    (f"<div>Site</div><main><h1>Title</h1><article><div class=lead>Lead</div><section><h2>One</h2>{BODY * 4}</section><section><h2>Two</h2><p>Few.</p></section></article></main>",
     ["Title", "Lead", "One", *[READ] * 4, "Two", "Few."]),
    (f"<article><h1>Title</h1><p>Intro.</p><table>{f'<tr><td>{BODY}</td></tr>' * 4}</table><ul><li>one<li>two</ul></article>", ["Title", "Intro.", *[READ] * 4, "one", "two"]),
    (f"<div>Site</div><div class=post><h1>Title</h1><p>Intro.</p><div class=entry-content>{BODY * 4}</div><ul><li>one</ul></div><div>Imprint</div>", ["Title", "Intro.", *[READ] * 4, "one"]),
    (f"<div>Site</div><div class=post><h1>Title</h1><table><thead><tr><th>Column</th></tr></thead>{f'<tr><td>{BODY}</td></tr>' * 4}</table></div>", ["Title", "Column", *[READ] * 4]),
    (f"<article><h1>One</h1>{BODY * 9}</article><div>Site</div><article><h1>Two</h1>{BODY}</article>", ["One", *[READ] * 9, "Two", READ])])
def test_nested_bodies_are_whole(page, text):
    assert html.main_text(f"<body><nav>Home</nav>{page}<footer>Foot, note.</footer></body>").split("\n") == text


@pytest.mark.parametrize("page, text", [
    (f"<div class='layout has-sidebar'><article><h1>Title</h1>{BODY}<p>End.</p></article></div>", ["Title", READ, "End."]),
    (f"<div class=sidebar><article><h1>Title</h1>{BODY}</article></div>", ["Title", READ]),
    (f"<form id=all><main><h1>Title</h1>{BODY}<p>End.</p></main></form>", ["Title", READ, "End."]),
    (f"<div class='layout has-sidebar'><div class=sidebar><p>Other, text.</p></div><div class=text><h1>Title</h1>{BODY * 3}<p>End.</p></div></div>", ["Title", *[READ] * 3, "End."]),
    (f"<div id='search-results'><h1>Title</h1>{BODY}<p>End.</p></div>", ["Title", READ, "End."]),
    (f"<main><div class='post comments-open'><h1>Title</h1>{BODY * 3}<p>End.</p></div></main>", ["Title", *[READ] * 3, "End."]),
    (f"<article><h1>Title</h1>{BODY * 3}<section class='related-work'><h2>Related work</h2>{BODY}<p>End.</p></section></article>", ["Title", *[READ] * 3, "Related work", READ, "End."]),
    (f"<article><h1>Title</h1>{BODY * 2}</article><div id=comments>{BODY * 5}<article>{BODY}</article></div><div class=ad>Buy, now.</div>", ["Title", *[READ] * 2]),
    ("<div class=ad>Buy this, and that, and more of it. It is new, and cheap. So go, and buy it.</div><article><h1>Short title here</h1><p>Short title here</article>", ["Short title here"] * 2),
    (f"<article><h1>Title</h1>{BODY * 2}<section class=comments>{BODY * 3}</section></article>", ["Title", *[READ] * 2])])
def test_marks_lower_ratios_only(page, text):
    assert html.main_text(f"<body><nav>Home</nav>{page}<footer>Foot, note.</footer></body>").split("\n") == text


def test_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = pages.union(spark.createDataFrame([(-1, None, None), (-2, "u", "<p>x"), (-2, "u", "<p>x")], pages.schema))
    got = html.extract_pages(rows).collect()
    assert len(got) == rows.count() and all(r.n_chars == len(r.text) for r in got)
    inside = re.compile(r"<article>(.*?)</article>", re.DOTALL)
    for r in pages.collect():
        found = inside.search(r.html)
        words = re.sub(r"&\w+;", "", re.sub(r"<[^>]*>", " ", found[1])).split() if found else []
        assert set(words) >= {w for w in re.sub("[&\"<>]", "", next(g.text for g in got if g.page_id == r.page_id)).split() if w.isalpha() and w in words}
    assert html.extract_pages(rows.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/!-'\"= apbdivscript&;.\n", max_size=200))
def test_any_markup_is_read(page):
    assert isinstance(html.main_text(page), str)


def test_licenses(odd):
    got = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert got[14].licenses == "Apache-2.0,MIT" and got[3].n_found == got[8].n_found == 0
    for name, notice in (("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
                         ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("AGPL-3.0", "Released under the GNU Affero General Public License, version 3.")):
        assert [s[2] for s in licenses.scan_text(f"Some words before. {notice} And some after it.")] == [name]
    assert licenses.scan_text("He has a driving license and permission to sell.") == []
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_every_license_of_a_block_is_found():
    names = list(licenses.NAMES)
    spans = licenses.scan_text(" ".join(licenses.NOTICES[i % 5].format(licenses.NAMES[k][0]) for i, k in enumerate(names)))
    assert [s[2] for s in spans] == names and all(s[3] == 0 for s in spans)
    for name in ("MIT", "ISC"):
        spans = licenses.scan_text(" And ".join(n.format(licenses.NAMES[name][0]) for n in licenses.NOTICES))
        assert [s[2] for s in spans] == [name] * 5


def test_changed_copies_before_the_best_are_found():
    text = licenses.TEXTS["ISC"][0]
    changed = text.replace("any purpose", "every purpose").replace("copyright", "ownership")
    assert [s[2:4] for s in licenses.scan_text(f"{changed} Other words stand here. {text} And at the end: {changed}")] == [("ISC", 2), ("ISC", 0), ("ISC", 2)]


def test_near_places_have_the_least_changes():
    import numpy as np
    rng = np.random.default_rng(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    for _ in range(100):
        block, wording = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, 5)
        every = {(f, e): distance(wording, block[f:e]) for f in range(len(block)) for e in range(f + 1, len(block) + 1)}
        got = licenses.near(block, wording, 2)
        assert all(every[f, e] == c for c, f, e in got)
        assert min([c for c, *_ in got], default=9) == min([d for d in every.values() if d <= 2], default=9)
        assert all(d > 2 or any(f < y and x < e for _, x, y in got) for (f, e), d in every.items())


def test_license_texts_are_told_apart():
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
           "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
           "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
           "PARTICULAR PURPOSE ARE DISCLAIMED.")
    third = ("3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this "
             "software without specific prior written permission. ")
    gnu = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
           "Foundation; either version {} of the License, or (at your option) any later version.")
    for text, name in ((bsd.format(""), "BSD-2-Clause"), (bsd.format(third), "BSD-3-Clause"), (bsd[:140] + ": none.", "BSD-family"),
                       (gnu.format("Lesser General Public License", "2.1"), "LGPL-2.1"), (gnu.format("Lesser General Public License", "3"), "LGPL-3.0"),
                       (gnu.format("Library General Public License", "2"), "LGPL-2.0"), (gnu.format("Affero General Public License", "3"), "AGPL-3.0"),
                       (gnu.format("General Public License", "2"), "GPL-2.0"), (gnu.format("General Public License", "3"), "GPL-3.0")):
        assert [s[2] for s in licenses.scan_text(text)] == [name], text
    assert licenses.scan_text(gnu.format("General Public License", "7")) == []


def test_long_white_space(ranks):
    enc = bpe.encoding(*ranks)
    for run in (" " * 12_000, "\n" * 10_001, " \n\t" * 4000, "　\xa0" * 6000, "\x1c" * 12_000, "\x1c \x1f" * 5000):
        for text in (run, f"a{run}", f"{run}b", f"one{run}two {run}!", f"{run}'s{run}5"):
            assert bpe.encode(text, enc).tolist() == enc.encode_ordinary(text)
    for run in (" " * 2_000_000, "\n" * 2_000_000, " \n" * 1_000_000):
        ids = bpe.encode(f"word{run}end", enc)
        assert enc.decode_bytes(ids.tolist()) == f"word{run}end".encode()


def test_ranking_decides_between_overlapping_wordings(monkeypatch):
    """Both GPL wordings are confirmed on the same words: the one that makes the block smaller gets them."""
    text = licenses.TEXTS["MIT"][0]
    right = licenses.scan_text(f"Some words. {text}")
    assert [s[2] for s in right] == ["MIT"]
    plain = licenses.ranked
    monkeypatch.setattr(licenses, "ranked", lambda raw: plain(raw)[::-1])
    wrong = licenses.scan_text(f"Some words. {text}")
    assert [s[2] for s in wrong] != ["MIT"]


def test_every_exact_wording_is_found_where_nothing_better_lies():
    every, _ = licenses.templates()
    for t in every[::7]:
        block = f"before it {' '.join(t.words)} after it license"
        spans = licenses.scan_text(block)
        assert any(block[s[0]:s[1]].lower().find(" ".join(t.words)) >= 0 or (s[0] <= 10 and s[1] >= 10 + len(" ".join(t.words))) or s[2] == t.license for s in spans), t.license
