"""Language ID, license scans, page extraction, archives, audio and the pipeline."""

import io
import math
import random
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chroma, labelled_pages, language, license_scan, maintext, warc
from quillon.llm.corpus_queries import held_out
from quillon.llm.dom import parse

SMALL = "/root/testdata/sf0.001"


def test_counts_in_blocks(monkeypatch):
    text = "Some Text, über 3 words… " * 9000
    whole, letters = language.counts(text)
    assert letters == sum(c.isalpha() for c in text) and whole.sum() > 0
    assert language.counts(None)[1] == 0 and language.counts("123 !?")[1] == 0


def plain_counts(text):
    """n-grams of a text one by one."""
    import unicodedata

    low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    found = np.zeros(language.DIMS, np.int64)
    mask = 2**32 - 1
    for i, c in enumerate(low):
        a, b = (low[j] if j >= 0 else " " for j in (i - 2, i - 1))
        if b == c == " ":
            continue
        two = ((ord(b) * 0x9E3779B1 & mask) ^ (ord(c) * 0x85EBCA77 & mask)) * 0xC2B2AE3D & mask
        three = (two ^ (ord(a) * 0x27D4EB2F & mask)) * 0x165667B1 & mask
        for x in (two, three):
            found[x >> (32 - (language.DIMS.bit_length() - 1))] += 1
    return found


def test_counts_and_cosines_one_by_one(spark):
    r = random.Random(8)
    texts = ["", "a", "Ab", " x ", "Über-Straße 3 résumé", "\u0301\U0001d400 \U00020000x", "ab" * 70000 + " end"] + ["".join(r.choice("abcé ß,.1\n中") for _ in range(r.randint(0, 200))) for _ in range(60)]
    for text in texts:
        assert (language.counts(text)[0] == plain_counts(text)).all(), text[:50]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, ~held_out())
    for row in language.predict(docs, model).select("text", "lang_pred", "score").limit(40).collect():
        weights = [math.log1p(n) * float(w) for n, w in zip(plain_counts(row["text"] or ""), model.idf)]
        size = math.sqrt(sum(w * w for w in weights)) or 1.0
        cosines = [sum(w * float(c) for w, c in zip(weights, centre)) / size for centre in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        if row["lang_pred"] != "und":
            assert row["lang_pred"] == model.languages[model.owner[best]] and row["score"] == pytest.approx(cosines[best], abs=1e-4)


def test_many_labels(spark, monkeypatch):
    """A dirty label column: every label is learned and all texts are predicted; more labels than a model may have are an error."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    dirty = docs.unionByName(docs.limit(60).withColumn("lang", F.concat(F.lit("dirt "), F.col("doc_id").cast("string"))))
    model = language.train(dirty, F.lit(True))
    labels = sorted(r[0] for r in dirty.where("lang IS NOT NULL").select("lang").distinct().collect())
    assert len(labels) > 60 and model.languages == labels and language.predict(dirty, model).count() == dirty.count()
    monkeypatch.setattr(language, "LANGUAGES", len(labels))
    assert language.train(dirty, F.lit(True)).languages == labels
    monkeypatch.setattr(language, "LANGUAGES", len(labels) - 1)
    with pytest.raises(ValueError, match="languages to learn"):
        language.train(dirty, F.lit(True))


def test_sample_is_bounded_and_the_same_however_rows_are_dealt(spark, monkeypatch):
    docs = spark.range(600).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('wort ', CAST(id AS STRING), repeat(chr(97 + CAST(id % 26 AS INT)), 3)) AS text", "IF(id % 3 = 0, 'a', 'b') AS lang")
    docs = docs.union(docs.limit(1).selectExpr("doc_id", "'42' AS text", "lang")).union(docs.where("text LIKE 'wort 7%'"))
    seen, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda rows: seen.append(rows) or fit(rows))
    models = [language.train(docs.repartition(n), F.lit(True), sample=20) for n in (1, 3, 7)]
    for rows in seen:
        assert [lang for lang, _ in rows] == [lang for lang, _ in seen[0]] and all(sum(lang == x for lang, _ in rows) <= 20 for x in "ab")
        assert {lang for lang, _ in rows} == {"a", "b"} and all((x == y).all() for (_, x), (_, y) in zip(rows, seen[0]))
    assert all((m.centroids == models[0].centroids).all() for m in models)
    with_ends = language.train(docs, F.lit(True), sample=1000)
    assert with_ends.languages == ["a", "b"] and len(seen[-1]) == docs.where("text <> '42'").count()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, ~held_out())
    found = language.predict(docs, model).where(held_out()).select("lang", "lang_pred", "score", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found) and not any(r["rejected"] for r in found)
    ids = {i for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r[0] for r in spark.range(50).withColumnRenamed("id", "doc_id").where(held_out()).collect()} == ids


def test_language_cases(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, ~held_out())
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 -- !!", 5), (4, "жзйцщ ъыьэю фхчшя " * 60, 5), (5, "the of and that is " * 20000, 5)], "doc_id long, text string, score int")
    found = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    for i in (1, 2, 3):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[4]["rejected"] and not found[5]["rejected"] and found[5]["lang_pred"] == "en"
    assert language.predict(odd.where("doc_id < 0"), model).count() == 0
    none = language.train(docs.where("doc_id < 0"), ~held_out())
    assert {r["lang_pred"] for r in language.predict(odd, none).collect()} == {"und"}


def test_licenses():
    own = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        spdx = name.removesuffix("-notice").removesuffix("-text")
        for around in (text, f"Some words.\nCopyright 2020 X\n{text}.\n\nMore words.", f"{'much other text ' * 300} {text} {'and on it goes ' * 300}"):
            found = own.scan(around)
            assert [x["license"] for x in found] == [spdx], (name, found)
            assert around[found[0]["at"] : found[0]["end"]].split()[0] in text
    assert own.scan(None) == [] and own.scan("") == [] and own.scan("We license what is permitted; copyright applies.") == []
    assert [x["license"] for x in own.scan("Licensed under CC BY-XX 4.0")] == []
    assert [x["license"] for x in own.scan("SPDX-License-Identifier: MIT")] == ["MIT"]


#: Where the usual copies of the long templates have empty lines: before these words.
PARAGRAPHS = {
    "Apache-2.0-notice": ("You may obtain", "http://www", "Unless required"),
    "BSD-2-Clause": ("1. Redis", "2. Redis"),
    "BSD-3-Clause": ("1. Redis", "2. Redis", "3. Neither"),
    "GPL-3.0-or-later-notice": ("This program is distributed",),
    "MIT-text": ("The above copyright",),
}
PROSE = "It was one of the days on which the rest of the town went to the end of the road to see the use of the copyright in the software of the year. "


def in_paragraphs(name):
    text = license_scan.TEMPLATES[name]
    for start in PARAGRAPHS[name]:
        assert text.count(start) == 1
        text = text.replace(start, "\n\n" + start)
    return text


def test_licenses_in_paragraphs():
    own = license_scan.Scanner()
    for name in PARAGRAPHS:
        text, spdx = in_paragraphs(name), name.removesuffix("-notice").removesuffix("-text")
        commented = "\n".join(f"# {line}".strip() if line else "" for line in text.split("\n"))
        for around in (text, commented, f"Name\n\nCopyright 2020 X\n\n{text}\n\nTHE SOFTWARE IS PROVIDED AS IS.", f"{PROSE * 30}\n\n{text}\n\n{PROSE * 30}"):
            found = own.scan(around)
            assert [x["license"] for x in found] == [spdx], (name, found)
            assert around[found[0]["at"] :].split()[0] in text
    # Copies and other licenses close by are findings of their own.
    texts = [in_paragraphs(k) for k in ("MIT-text", "BSD-2-Clause", "MIT-text", "MIT-text", "BSD-3-Clause")]
    assert [x["license"] for x in own.scan("\n\n".join(texts))] == ["MIT", "BSD-2-Clause", "MIT", "MIT", "BSD-3-Clause"]


def gnu(kind, which, what="program"):
    return f"""/* This file is part of X.
 *
 * This {what} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {kind}General Public
 * License as published by the Free Software Foundation; {which}.
 *
 * This {what} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * {kind}General Public License for more details.
 *
 * You should have received a copy of the GNU {kind}General Public
 * License along with this {what}; if not, write to the Free Software
 * Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA. */
int main(void);
"""


def test_gnu_licenses():
    own = license_scan.Scanner()
    later = "either version {} of the License, or (at your option) any later version"
    cases = [("", "1", "GPL-1.0"), ("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Library ", "2", "LGPL-2.0"), ("Lesser ", "2", "LGPL-2.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")]
    for kind, version, spdx in cases:
        for what in ("program", "library"):
            for which, end in ((later.format(version), "or-later"), (f"version {version} of the License", "only")):
                text = gnu(kind, which, what)
                for around in (text, text.replace(" *\n", "\n"), f"{PROSE * 20}\n{text}\n{text}"):
                    assert {x["license"] for x in own.scan(around)} == {f"{spdx}-{end}"}, (kind, which)
        moved = gnu(kind, "X").replace("the terms of the GNU", f"the terms of version {version} of the GNU").replace("; X", "")
        assert [x["license"] for x in own.scan(moved)] == [f"{spdx}-only"]
    # No template has these, and no other license is given for them.
    for kind, version in (("", "4"), ("Affero ", "2"), ("Lesser ", "2.2")):
        assert own.scan(gnu(kind, later.format(version))) == []
    found = own.scan(gnu("", later.format("3")).replace("any later version", "any other, newer and later version"))
    assert [(x["license"], x["missing"], x["inserted"]) for x in found] == [("GPL-3.0-or-later", 0, 3)]
    notice = license_scan.TEMPLATES["Apache-2.0-notice"]
    assert [x["license"] for x in own.scan(notice.replace("Version 2.0", "Version 3.0"))] == []


def test_short_notices_in_other_words():
    own = license_scan.Scanner()
    cases = {
        "This program is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Distributed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU Lesser General Public License, version 2.": [],
        "It is available under the MIT License.": ["MIT"],
        "The photo is under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
        "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License": [],
        "GNU GPL v3": ["GPL-3.0"],
        "GNU GPL v4": [],
        "It has the GNU LGPL version 2.1.": ["LGPL-2.1"],
        "MIT License": ["MIT"],
        "# The MIT License (MIT)\n\nCopyright 2020 X": ["MIT"],
        "I read of the MIT License and of the GNU General Public License, version 3.": [],
        "Available under the MIT umbrella, without a license.": [],
        license_scan.TEMPLATES["MPL-2.0"].replace("http:", "https:"): ["MPL-2.0"],
    }
    for text, want in cases.items():
        assert [x["license"] for x in own.scan(text)] == want, text


class EveryTemplate(license_scan.Scanner):
    """Brute force: every window with every template, whatever words they share."""

    def candidates(self, ws):
        return sorted((0, len(ws), k) for k in self.words) if len(ws) > 1 else []


def test_licenses_against_every_template(spark):
    r, own, brute = random.Random(3), license_scan.Scanner(), EveryTemplate()
    texts = [row[0] for row in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").where("text IS NOT NULL").collect() if any(c in row[0].lower() for c in license_scan.CUES) and len(row[0]) < 3000][:15]
    names = sorted(license_scan.TEMPLATES)
    for _ in range(25):
        parts = []
        for _ in range(r.randint(1, 3)):
            ws = license_scan.TEMPLATES[r.choice(names)].split()
            for _ in range(r.choice([0, 0, 1, 3, len(ws) // 6])):  # words lost, changed or added
                i = r.randrange(len(ws))
                ws[i : i + 1] = r.choice([[], ["other"], [ws[i], "more"]])
                ws = ws or ["license"]
            parts += [" ".join(ws), " ".join(r.choice(PROSE.split()) for _ in range(r.randint(0, 20)))]
        texts.append(r.choice([" ", "\n\n"]).join(parts))
    found = [[[(x["license"], x["at"], x["end"], x["template"]) for x in scan(t)] for t in texts] for scan in (own.scan, brute.scan)]
    assert sum(map(len, found[0])) > 25
    for text, some, every in zip(texts, *found):
        for spdx, at, end, k in every:
            if spdx not in {x[0] for x in some}:  # only places with fewer word pairs of the template than make a candidate
                ws, pairs = license_scan.words(text[at:end]), set(zip(own.words[k], own.words[k][1:]))
                assert sum(p in pairs for p in zip(ws, ws[1:])) < min(20, max(2, (len(own.words[k]) - 1) // 2)), (text, spdx)


def test_compression_ranks_before_words_confirm():
    r = random.Random(11)
    ws = ["".join(r.choice("abcdefghij") for _ in range(2 if 20 <= i < 30 else 14)) for i in range(60)]
    ws[0] = "license"
    most_words = [f"{w[::-1]}x" if i in (5, 10, 15, 35, 45, 55) else w for i, w in enumerate(ws)]
    smallest = [f"{w}x" if 21 <= i < 29 else w for i, w in enumerate(ws)]
    own = license_scan.Scanner({"Most-words": " ".join(most_words), "Smallest": " ".join(smallest)})
    assert own.compared(ws, "Most-words")[0] == 54 and own.compared(ws, "Smallest")[0] == 52
    assert [k for _, k in own.ranked(ws, list(own.words))] == ["Smallest", "Most-words"]
    assert [(x["license"], x["missing"]) for x in own.scan(" ".join(ws))] == [("Smallest", 8)]
    # Words are aligned in the order of the reductions, until a template is confirmed.
    aligned = []

    class Watched(license_scan.Scanner):
        def compared(self, ws, name):
            aligned.append(name)
            return super().compared(ws, name)

    own = Watched()
    text = license_scan.TEMPLATES["BSD-3-Clause"]
    assert {k for _, _, k in own.candidates(license_scan.words(text))} >= {"BSD-2-Clause", "BSD-3-Clause"}
    assert [x["license"] for x in own.scan(text)] == ["BSD-3-Clause"] and set(aligned) == {"BSD-3-Clause"}


def test_licenses_of_like_words_in_one_block():
    """What lies around a place is ranked anew, and words far off decide nothing."""
    own = license_scan.Scanner()
    for names in (("AGPL-3.0-only", "GPL-3.0-or-later"), ("LGPL-2.1-only", "LGPL-3.0-or-later"), ("GPL-2.0-or-later", "GPL-2.0-only", "AGPL-3.0-or-later")):
        text = " and what follows is under ".join(license_scan.TEMPLATES[f"{k}-notice"] for k in names)
        assert [(x["license"], x["missing"]) for x in own.scan(text)] == [(k, 0) for k in names]


def test_long_templates_and_long_texts():
    """A template far longer than the least window, in a text far longer than that."""
    r = random.Random(5)
    long = " ".join(f"term{r.randint(0, 400)}" for _ in range(1600))
    own = license_scan.Scanner(license_scan.TEMPLATES | {"Long-1.0": f"Terms of a long license. {long} End of the terms."})
    for before in (0, 1500):
        text = f"{PROSE * (before // 30)} Terms of a long license. {long} End of the terms. {PROSE * 40}"
        assert [x["license"] for x in own.scan(text)] == ["Long-1.0"]
    text = PROSE * 100 + license_scan.TEMPLATES["MIT-text"] + "word " * 300000
    assert [x["license"] for x in license_scan.scanner().scan(text)] == ["MIT"]


def test_license_rows(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "Released under the MIT License.\n\nWords.\nLicensed under CC BY 4.0", "x"), (2, None, None), (1, "Released under the MIT License.", None)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r["doc_id"], r["nth"], r["license"]) for r in found) == [(1, 0, "MIT"), (1, 0, "MIT"), (1, 1, "CC-BY-4.0")]


PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other page</a></li></ul></nav>'
    '<div class="ad">Buy this now, it is cheap.</div><article><h1>A title of words</h1><p>First   block &amp; more\n text.<p>Second <b>bold</b>word, ends here.<br>After it.</p></article>'
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I think that this is wrong.</p></div></section><footer>&copy; 2020 Someone</footer></body></html>'
)


def test_main_text():
    model = maintext.trained()
    assert maintext.extract(PAGE, model) == "A title of words\nFirst block & more text.\nSecond boldword, ends here. After it."
    assert maintext.extract(None, model) == "" and maintext.extract("", model) == "" and maintext.extract("<script>x", model) == ""


def test_main_text_open_head():
    model = maintext.trained()
    whole = maintext.extract(PAGE, model)
    for without in (("</head>", "<body>", "</body>"), ("</head>", "</body>"), ("<html>", "</head>", "<body>", "</body>", "</html>")):
        page = PAGE
        for tag in without:
            page = page.replace(tag, "")
        assert "<head>" in page and maintext.extract(page, model) == whole
    page = parse("<head><meta charset=utf-8>\n<title>T</title><noscript><img src=x>no</noscript><template><p>no</p></template><link rel=x>\nA <b>word</b>.")
    assert "".join(page.text).strip() == "A word."


PROSE_LINE = "This is a sentence of prose that has about a hundred letters in it, so that it looks like any other text."
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other page</a></li></ul></nav>', "<footer>&copy; 2020 Someone</footer>"
LAYOUTS = {
    "loose": ("<html><body>" + NAV + "<h1>A title</h1>" + f"<p>{PROSE_LINE}</p>" * 4 + FOOT + "</body></html>", ["A title"] + [PROSE_LINE] * 4),
    "loose, nothing else": ("<body><h1>A title</h1>" + f"<p>{PROSE_LINE}</p>" * 4, ["A title"] + [PROSE_LINE] * 4),
    "no tags": (PROSE_LINE + "\n\n" + PROSE_LINE, [PROSE_LINE + " " + PROSE_LINE]),
    "one box": ("<html><body><div>" + f"<p>{PROSE_LINE}</p>" * 5 + "</div></body></html>", [PROSE_LINE] * 5),
    "grid": (f'<body>{NAV}<div class="wrap"><div class="row"><div class="col-8">' + f"<p>{PROSE_LINE}</p>" * 4 + f"</div></div></div>{FOOT}", [PROSE_LINE] * 4),
    "formula": (f"<body>{NAV}<article><h1>A title</h1><p>{PROSE_LINE} <math><mi>x</mi></math> is so.</p></article>{FOOT}", ["A title", PROSE_LINE + " x is so."]),
    "links": (f'<body>{NAV}<article><h1>A title</h1><p>{PROSE_LINE}</p><ul><li><a href="/1">First link</a></li><li><a href="/2">Second link</a></li></ul></article>{FOOT}', ["A title", PROSE_LINE, "First link", "Second link"]),
    "object": (f"<body>{NAV}<article><h1>A title</h1><p>{PROSE_LINE}</p><object data=x>Text in its place</object></article>{FOOT}", ["A title", PROSE_LINE, "Text in its place"]),
    "noscript": (f"<body>{NAV}<article><h1>A title</h1><p>{PROSE_LINE}</p><noscript>Text in its place</noscript></article>{FOOT}", ["A title", PROSE_LINE, "Text in its place"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_layouts(name):
    page, lines = LAYOUTS[name]
    assert maintext.extract(page, maintext.trained()) == "\n".join(lines)


@pytest.mark.parametrize("change", ["article", "div", "section", ""])
def test_main_text_of_the_table(change):
    """Pages of the table, and the same pages without an article element, against the text of that element."""
    import html
    import re

    pq = pytest.importorskip("pyarrow.parquet")
    model, squeeze = maintext.trained(), lambda t: re.sub(r"\s+", "", t)
    n = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        article = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
        if article:
            inner = re.sub(r"<(script|style)\b.*?</\1>", "", article[1], flags=re.S)
            other = re.sub(r"<(/?)article[^>]*>", rf"<\1{change}>" if change else "", page)
            assert squeeze(maintext.extract(other, model)) == squeeze(html.unescape(re.sub(r"<[^>]+>", "", inner)))
            n += 1
    assert n > 200


@pytest.mark.parametrize("part", ['<a "', "<div>", '<a href="', "<p title='x", "<", "<!--", "<b>", "</i>", "<table><tr><td>", "<a x=", "<script>", "</", "= <a ", "<a class"])
def test_long_broken_pages_take_linear_time(part):
    import time

    def took(n):
        began = time.perf_counter()
        parse("<p>" + part * n)
        return time.perf_counter() - began

    n = 1_000_000 // len(part)
    assert took(n) < max(4.0, 30 * took(n // 10))


def test_unclosed_quotes_lose_no_text():
    page = parse('<p title="a > b">one</p><p title="never closed>two</p><p>three</p>')
    assert "".join(page.text) == "onetwothree"


def test_main_text_held_out():
    model, good = maintext.trained(), 0
    for i in range(150):
        page = parse(labelled_pages.Maker(10_000_000 + i).page())
        marked = [0] * len(page.tag)
        for j in range(1, len(page.tag)):
            own = (page.attrs[j] or {}).get("data-main")
            marked[j] = int(own) if own else marked[page.parent[j]]
        keep = model.content(page)
        good += all((keep[j] >= 0.5) == marked[j] for j in range(len(page.tag)) if page.text[j].strip())
    assert good >= 140


def test_messages_of_all_pages_at_once():
    pages = [parse(x) for x in labelled_pages.pages(12)]
    forest = maintext.Forest([(page, maintext.labels_of(page)) for page in pages])
    r = np.random.default_rng(3)
    weights, edges = r.normal(size=len(forest.names)), r.normal(size=(maintext.EDGES, 4))
    p, both, child = forest.expected(weights, edges)
    at, by_name = 0, dict(zip(forest.names, weights))
    for page in pages:
        own = [sum(by_name[f] for f in fs) for fs in maintext.features(page)]
        one = maintext.marginals(page.parent, own, maintext.kinds(page), [tuple(e) for e in edges])
        for whole, part in zip((p, both, child), one):
            assert whole[at : at + len(own)] == pytest.approx(part, abs=1e-9)
        at += len(own)


def test_messages_give_exact_marginals():
    import itertools
    import math

    r = random.Random(1)
    for _ in range(20):
        n = r.randint(2, 7)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        own, kind = [r.gauss(0, 2) for _ in range(n)], [r.randrange(2) for _ in range(n)]
        edges = [tuple(r.gauss(0, 1) for _ in range(4)) for _ in range(2)]
        total, single, pair = 0.0, [0.0] * n, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(o * a for o, a in zip(own, y)) + sum(edges[kind[i]][2 * y[parent[i]] + y[i]] for i in range(1, n)))
            total += w
            for i in range(n):
                single[i] += w * y[i]
                pair[i] += w * y[i] * y[parent[i]] if i else 0
        p, both, _ = maintext.marginals(parent, own, kind, edges)
        assert p == pytest.approx([x / total for x in single], rel=1e-6)
        assert both[1:] == pytest.approx([x / total for x in pair[1:]], rel=1e-6)


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (1, "u", PAGE, "x")]
    found = maintext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in found) == [(1, len(found[0]["text"] or found[1]["text"]))] * 2 + [(2, 0)]


def archive_brute(rows, least):
    groups = {}
    for i, _, h, *_ in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda i: i != keep)):
            revisit = len(payload) >= least and n > 0
            out.append((i, len(payload), warc.digest(payload), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_archives(spark, least):
    rows = [(1, "http://a/", "<p>same page</p>", 1), (2, "http://b/\r\nX: y", "<p>same page</p>", 1), (3, None, None, 1), (4, "u", "", 1), (5, "u", "ü" * 40000, 1), (6, "u", "\r\n\r\nWARC/1.1\r\n", 1), (2, "http://b/", "<p>same page</p>", 1), (None, "u", "only", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    found = [tuple(r) for r in warc.round_trip(pages, least).collect()]
    assert sorted(found, key=repr) == archive_brute(rows, least)
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("packed", [False, True])
def test_packages_of_other_makers(packed):
    """Several archives, one of them plain; compressed and plain indexes, as JSON lines and in eleven fields."""
    import gzip
    import json

    records = [warc.record(i, f"http://a/{i}", f"<p>page {i}</p>".encode()) for i in range(60)]
    archives, lines = {"one.warc.gz": b"", "two.warc.gz": b"", "three.warc": b""}, {}
    for i, data in enumerate(records):
        name = list(archives)[i % 3]
        own = gzip.compress(data) if name.endswith(".gz") else data
        lines.setdefault(name, []).append((i, len(archives[name]), len(own)))
        archives[name] += own
    cdxj = "".join(f"a,a)/{i} 20200101000000 {json.dumps({'filename': n, 'offset': str(o), 'length': str(size)})}\n" for n in ("one.warc.gz", "two.warc.gz") for i, o, size in lines[n])
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"a,a)/{i} 20200101000000 http://a/{i} text/html 200 X - - {size} {o} three.warc\n" for i, o, size in lines["three.warc"])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in archives.items():
            z.writestr(f"archive/{name}", data)
        half = cdxj.index("\n", len(cdxj) // 2) + 1
        z.writestr("indexes/index.cdx.gz", gzip.compress(cdxj[:half].encode()) + gzip.compress(cdxj[half:].encode()))
        z.writestr("indexes/plain.cdx", cdx.strip(), zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
        z.writestr("pages/pages.jsonl", "{}")
    package = warc.Package(Source(out.getvalue()))
    for block in (7, 1 << 20):
        found = [package.record(x["offset"], x["length"], x["filename"]) for x in package.index(block)]
        assert sorted(found) == sorted(records)


def test_zip_directories():
    out = io.BytesIO()
    made = warc.ZipWriter(out)
    made.member("a/b.txt", [b"one", b"two"])
    made.member("c", [])
    made.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a/b.txt") == b"onetwo"
    m = warc.directory(Source(out.getvalue()))["a/b.txt"]
    assert out.getvalue()[m["data"] : m["data"] + m["size"]] == b"onetwo" and m["method"] == 0
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:  # without ZIP64, with a comment
        z.writestr("x", b"data")
        z.comment = b"PK\5\6 in a comment"
    m = warc.directory(Source(plain.getvalue()))["x"]
    assert plain.getvalue()[m["data"] : m["data"] + 4] == b"data"
    with pytest.raises(ValueError):
        warc.directory(Source(b"no archive"))


def wav(x):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(chroma.RATE)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def searched(spark, rows, queries=lambda i: F.lit(True)):
    """Rows by id, and the links of each class."""
    found = chroma.search(spark.createDataFrame(rows, "id long, media binary"), queries, "id", "media").collect()
    links = {}
    for x in found:
        if x["link_class"] is not None:
            links.setdefault(x["id"], {})[x["link_class"]] = x
    return {x["id"]: x for x in found}, links


def brute_links(rows, least=chroma.OVERLAP):
    """(query, other) -> least bit error over all starts and offsets, whether they share a landmark or not."""
    prints, found = {i: chroma.fingerprint(m) for i, m in rows}, {}
    for i, media in rows:
        own = chroma.starts(media) if len(prints[i]) else []
        for j in prints:
            if i == j or not len(prints[j]) or np.array_equal(prints[i], prints[j]):
                continue
            tries = [e for x, _ in own for o in range(-len(x) + least, len(prints[j]) - least + 1) for e, n in [chroma.bit_error(x, prints[j], o)] if n >= least]
            if min(tries, default=1) <= chroma.ERRORS:
                found[i, j] = min(tries)
    return found


def test_audio(spark):
    r = np.random.default_rng(0)
    songs = [chroma.melody(r.normal(size=64).tolist()) for _ in range(12)]
    rows = list(enumerate(songs)) + [(100 + i, wav(chroma.samples(songs[i])[2048:] + r.normal(size=len(chroma.samples(songs[i])) - 2048) * 0.05)) for i in range(6)]
    odd = [(20, songs[3]), (40, None), (41, b""), (42, b"no audio"), (43, wav(np.zeros(100))), (44, wav(np.zeros(40000)))]
    found, links = searched(spark, rows + odd)
    assert len(found) == len(rows + odd) and found[20]["class_id"] == 3 and found[3]["class_size"] == 2
    assert all(found[i]["n_frames"] == 0 and found[i]["n_links"] == 0 for i in (40, 41, 42, 43)) and found[44]["n_links"] == 0
    assert {(i, j) for i in links for j in links[i]} == set(brute_links(rows)) and links[0][100]["offset"] == -8
    assert found[20]["n_links"] == found[3]["n_links"] == 1 and 20 not in links
    assert not searched(spark, [])[0]


def test_audio_recall(spark):
    """Excerpts that start off the frame grid, under noise up to the rule's limit, against brute force over all offsets and starts."""
    r = np.random.default_rng(4)
    rows, wholes = [], 25
    for i in range(wholes):
        song = chroma.samples(chroma.melody(r.normal(size=64).tolist()))
        rows.append((i, wav(song * 0.5)))
        for n, noise in enumerate((0, 0.05, 0.1, 0.15, 0.2)):
            cut = int(r.integers(1, 8000))
            excerpt = song[cut : cut + int(r.integers(16000, 24000))] * 0.5
            rows.append((1000 * (n + 1) + i, wav(excerpt + r.normal(size=len(excerpt)) * noise)))
    for cut in (2176, 3000):
        rows.append((9000 + cut, wav(chroma.samples(rows[0][1])[cut:])))
    _, links = searched(spark, rows, lambda i: i >= 1000)
    want = brute_links([x for x in rows if x[0] >= 1000] + [x for x in rows if x[0] < 1000])
    want = {(i, j) for i, j in want if i >= 1000}
    found = {(i, j) for i in links for j in links[i]}
    assert found <= want and len(found) >= 0.9 * len(want), (len(found), len(want))
    planted = {(i, i % 1000) for i, _ in rows if 1000 <= i < 4000}  # stronger noise is beyond the limit now and then
    assert planted <= found and {(11176, 0), (12000, 0)} <= found


def bars(seed, n, notes=12):
    """Tunes whose lengths are whole hops, so that copies of them have equal frames wherever they stand."""
    r = np.random.default_rng(seed)
    return [chroma.samples(chroma.melody(r.normal(size=notes).tolist(), 3 * chroma.HOP / chroma.RATE)) for _ in range(n)]


def test_audio_repeated_bars(spark):
    """An exact excerpt, all bars of which stand earlier in another order."""
    a, b, c, d, *other = bars(1, 8)
    query, before = [a, b, c, d], [*other, c, d, b, c, a, b]
    _, links = searched(spark, [(0, wav(np.concatenate(query))), (1, wav(np.concatenate(before + query)))])
    at = sum(map(len, before)) // chroma.HOP
    assert [(x["link_class"], x["offset"], x["bit_error"]) for x in links[0].values()] == [(1, at, 0.0)]
    assert [(x["link_class"], x["offset"], x["bit_error"]) for x in links[1].values()] == [(0, -at, 0.0)]
    # Against brute force over all places.
    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = (r.integers(0, 2, r.integers(0, 30)).astype(np.uint32) for _ in range(2))
        gap = chroma.GAP
        mask = np.full(max(0, len(x) - gap), (1 << chroma.WEAK) - 1, np.uint64)
        same = lambda i, j: x[i] == y[j] and not (int(x[i + gap]) ^ int(y[j + gap])) >> chroma.WEAK
        want = {j - i for i in range(len(x) - gap) for j in range(len(y) - gap) if same(i, j)}
        assert chroma.shared_offsets(x, mask, y).tolist() == sorted(want)


@pytest.mark.parametrize("part", [4096, 2])
def test_audio_frequent_clip(spark, monkeypatch, part):
    """A clip that stands in many recordings, each much longer than it, links to all of them."""
    monkeypatch.setattr(chroma, "PART", part)
    clip, *songs = bars(3, 19, 24)
    wholes = [np.concatenate([*songs[3 * i : 3 * i + 2], clip, songs[3 * i + 2], *songs[3 * i : 3 * i + 2]]) for i in range(6)]
    rows = [(9, wav(clip))] + [(i, wav(x)) for i, x in enumerate(wholes)]
    _, links = searched(spark, rows)
    assert {(i, j) for i in links for j in links[i]} == set(brute_links(rows))
    at = 2 * len(clip) // chroma.HOP
    assert sorted((x["link_class"], x["offset"], x["bit_error"]) for x in links[9].values()) == [(i, at, 0.0) for i in range(6)]
    assert all(links[i][9]["bit_error"] == 0 for i in range(6))


def test_pipeline(spark):
    """Against its stages by brute force."""
    import corpus_pipeline
    from tests.llm.test_dedup import fingerprint_brute, roots_brute
    from tests.llm.test_tokens import check_packed, library

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, ~held_out())
    rows = [(r["doc_id"], r["text"]) for r in language.predict(docs, model).where("NOT rejected").collect()]
    last = {}
    for i, t in sorted(rows):
        last[t or ""] = (i, t)
    rows = sorted(last.values())
    fps = [fingerprint_brute(t) for _, t in rows]
    rows = [x for n, (x, root) in enumerate(zip(rows, roots_brute(fps))) if n == root]
    found = corpus_pipeline.run(spark, SMALL).collect()
    check_packed(rows, found, 2048, library("word_bpe_49k.json"))


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    more = docs.withColumns({c: F.lit("own") for c in ("rejected", "score", "keep_id", "fp", "recipe", "digest", "kept")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, more, SMALL)
        assert kept.columns == more.columns and kept.where("rejected <> 'own' OR score <> 'own'").isEmpty()
        assert stage(spark, docs.limit(0), SMALL).isEmpty()
