"""Language ID, toxicity, packing, licences, urls and HTML against brute force and edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.llm import html, language, licenses, packing, toxicity, urls
from gridframe.llm import text as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "12 34 !!"), (5, "word"), (5, "word"), (6, "long text " * 60_000)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("words", F.lit(1))


# --- language ---------------------------------------------------------------

def brute_kneser_ney(texts, order, discount):
    """P(char | context) by the definition, with dictionaries."""
    pad = " " * order
    runs = [pad + "".join(map(chr, language.char_codes(t))) + " " for t in texts]
    counts = [None] * (order + 1)
    counts[order] = Counter(r[i - order + 1:i + 1] for r in runs for i in range(order, len(r)))
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    vocabulary = len({c for r in runs for c in r}) + 1

    def p(gram):
        if not gram:
            return 1 / vocabulary
        c = counts[len(gram)]
        same = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        lower = p(gram[1:])
        if not same:
            return lower
        return max(c.get(gram, 0) - discount, 0) / sum(same) + discount * len(same) / sum(same) * lower

    return p


def test_kneser_ney_equals_the_definition():
    texts = ["banana bandana", "ana nab"]
    model = language.train({"x": texts}, order=3)
    p = brute_kneser_ney(texts, 3, language.DISCOUNT)
    for probe in ["banana", "nab zq", "dan"]:
        ce, n = language.cross_entropies(model, [probe])
        run = "   " + probe
        want = -sum(math.log(p(run[i - 2:i + 1])) for i in range(3, len(run)))
        assert n[0] == len(probe) and abs(ce[0, 0] * n[0] - want) < 1e-3


def test_kneser_ney_sums_to_one():
    p = brute_kneser_ney(["abcab"], 3, 0.75)
    letters = "abc "
    assert abs(sum(p("ab" + c) for c in letters) + p("ab?") - 1) < 1e-9


def test_long_texts_in_chunks(monkeypatch):
    model = language.train({"a": ["the cat sat on the mat"], "b": ["der hund und die katze"]})
    text = "the cat und die matte " * 50
    whole = language.cross_entropies(model, [text, text])
    monkeypatch.setattr(language, "CHUNK", 37)
    parts = language.cross_entropies(model, [text, text])
    assert np.allclose(whole[0], parts[0], atol=1e-5) and (whole[1] == parts[1]).all()


def test_language_accuracy_on_held_out(spark, docs):
    model = language.fit(docs)
    got = language.identify(docs.withColumn("held_out", T.held_out("doc_id")), model).toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.rejected.mean() < 0.01 and got.score.between(0, 1).all()
    junk = spark.createDataFrame([(1, "xq zzkw jjqx wvvk qqzj " * 40)], "doc_id long, text string")
    assert language.identify(junk, model).first()["rejected"]


def test_language_odd_rows(spark, docs):
    model = language.fit(docs)
    rows = {(r["doc_id"], r["text"]): r for r in language.identify(odd(spark), model).collect()}
    for key in [(None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "12 34 !!")]:
        assert (rows[key]["lang_pred"], rows[key]["score"], rows[key]["rejected"]) == ("und", 0.0, True)
    assert rows[(6, "long text " * 60_000)]["words"] == 1
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd(spark), none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


# --- toxicity ----------------------------------------------------------------

def test_convolution_equals_brute_force():
    rng = np.random.default_rng(3)
    model = toxicity._start(1, 64)
    model.table[:-1] = rng.normal(size=model.table[:-1].shape)
    docs = [rng.integers(-2 ** 62, 2 ** 62, n) for n in (0, 1, 2, 3, 9, 40)]
    rows = [toxicity.rows_of(d, d[::-1].copy(), 64) for d in docs]
    flat, offsets = toxicity._pick(rows)
    got = toxicity.logits(model, flat, offsets)
    for d, z in zip(rows, got, strict=True):
        x = np.zeros((len(d) + 4, toxicity.WIDTH))
        x[:len(d)] = model.table[d].sum(1) if len(d) else 0
        tops = []
        for k in model.kernels:
            w = len(k)
            tops.append(np.max([sum(x[i + j] @ k[j] for j in range(w)) for i in range(max(len(d) - w, 0) + 1)], axis=0))
        want = np.maximum(np.concatenate(tops) + model.bias, 0) @ model.out + model.intercept
        assert abs(z - want) < 1e-3


def test_toxicity_chunks_equal_whole(monkeypatch):
    rng = np.random.default_rng(5)
    model = toxicity._start(2, 64)
    model.table[:-1] = rng.normal(size=model.table[:-1].shape)
    d = rng.integers(-2 ** 62, 2 ** 62, 500)
    flat, offsets = toxicity._pick([toxicity.rows_of(d, d, 64)] * 2)
    whole = toxicity.logits(model, flat, offsets)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    assert np.allclose(whole, toxicity.logits(model, flat, offsets), atol=1e-4)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(T.held_out("doc_id")), model).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert len(got) > 300


def test_toxicity_odd_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.classify(odd(spark), none).collect()} == {0.0}
    one = toxicity.fit(docs, labels.withColumn("toxic", F.lit(1)))
    assert {r["predicted"] for r in toxicity.classify(odd(spark), one).collect()} == {1}
    assert toxicity.classify(docs.limit(0), model).count() == 0


# --- packing -----------------------------------------------------------------

def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(900_001, "日本語 <|endoftext|> naïve’s 😀\r\n\t  x²½ ٣"), (900_002, None), (900_003, "")], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(extra).repartition(5)
    pieces = packing.pack(some).collect()
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in some.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and 0 < p["length"] <= 2048
        assert p["ids_crc32"] == zlib.crc32(own[p["start"]:p["start"] + p["length"]].tobytes())
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts, size in [*((sorted(v), len(ids[k])) for k, v in by_doc.items()), *((sorted(v), None) for v in by_seq.values())]:
        at = 0
        for begin, length in parts:
            assert begin == at
            at += length
        assert size is None or at == size
    assert set(by_doc) == set(ids)
    full = [sum(n for _, n in v) for _, v in sorted(by_seq.items())]
    assert all(n == 2048 for n in full[:-1]) and sorted(by_seq) == list(range(len(by_seq)))


def test_packing_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>é", "<|endoftext", "plain text  only"]
    got = packing.token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * r["doc_tokens"] else "<u4").tolist() for r in got}
    assert ids == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_packing_odd_rows(spark):
    got = packing.pack(odd(spark)).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1
    assert len([r for r in got if r["doc_id"] == 5]) >= 2 and any(r["doc_id"] is None for r in got)
    assert packing.pack(odd(spark).limit(0)).count() == 0


def test_byte_bpe_equals_the_tokenizer(docs):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from gridframe.llm import tokens

    tokenizer, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.byte_bpe(added_tokens=True)
    rnd = random.Random(5)
    letters = list("aé日😀'sdt 12\n\t\r\xa0\u2028\x00_-<|") + ["<|endoftext|>", "'ll", "   ", "\u0301", "٣", "ſ"]
    made = ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(2000)]
    for text in [*made, "a" * 5000, " " * 3000, *[r["text"] or "" for r in docs.select("text").collect()]]:
        assert mine.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert b"".join(mine.token_bytes[i] for i in mine.encode("é <|endoftext|>x")) == "é <|endoftext|>x".encode()


# --- licences ----------------------------------------------------------------

BSD_TEXT = """Copyright (c) 2012, The Regents. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of {} nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def test_licences_as_projects_write_them(spark):
    rows = [
        ("Licensed under the Apache License,\nVersion 2.0", "Apache-2.0"),
        ("This file is licensed under the\nMIT License", "MIT"),
        ("licensed under the MIT\nLicense.", "MIT"),
        ("Released under the terms of the\nGNU General Public License, version 3.", "GPL-3.0"),
        ("# SPDX-License-Identifier: MIT\nimport os", "MIT"),
        ("/* SPDX-License-Identifier: Apache-2.0 */\n#include <a.h>", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        ("// SPDX-License-Identifier: LGPL-2.1-or-later\r\n", "LGPL-2.1-or-later"),
        (BSD_TEXT, "BSD-2-Clause,All-Rights-Reserved"),
        (BSD_TEXT + THIRD.format("the University"), "BSD-3-Clause,All-Rights-Reserved"),
        (BSD_TEXT + THIRD.format("the\n   University of Somewhere"), "BSD-3-Clause,All-Rights-Reserved"),
        (BSD_TEXT + THIRD.format("Example, Inc."), "BSD-3-Clause,All-Rights-Reserved"),
        # a reference on a line of its own, after lines that do not end in a full stop
        ("walking through the,\nReleased under the MIT License.\nand so on", "MIT"),
        ("Prices went under the\nbudget of the\nyear", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert got == {i: k for i, (_, k) in enumerate(rows)}


def test_licence_rules(spark):
    import re

    assert all(re.search(licenses.ANCHOR, s) for s in licenses.sentence_table())
    assert all(any(w in a for w in licenses.IN_ANCHORS) for a in licenses.ANCHOR.split("|"))
    rows = [
        (1, "Foo.\nLicensed under CC BY-NC 4.0.\nBar", "CC-BY-NC-4.0"),
        (2, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        (3, "Released under the MIT License.\nAll rights reserved.", "MIT,All-Rights-Reserved"),
        (4, None, ""), (5, "", ""), (6, "No licence here. A free licence to roam.", ""),
        (7, 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
            "You may obtain a copy of the License at\n", "Apache-2.0"),
        (8, "This program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as "
            "published by the Free Software\nFoundation, either version 3 of the License, or (at your option) any later\nversion.", "GPL-3.0-or-later"),
        (9, "Released under the MIT License. " * 3000, "MIT"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("licenses", F.lit(0))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert got == {r[0]: r[2] for r in rows}
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- urls --------------------------------------------------------------------

def brute_url(url, weights):
    import re

    import xxhash

    url = url or ""
    rest = url[url.index("://") + 3:] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rule = None
    for r, v in sorted(urls.RULES, key=lambda r: -len(r[0])):
        name, prefix = r[:r.index("/")], r[r.index("/"):]
        if (host == name or host.endswith("." + name)) and path.startswith(prefix):
            rule = (r, v)
            break
    grams = []
    for kind, s in (("h", host), ("p", path)):
        s = f"^{s}$"
        for n in urls.GRAMS:
            for i in range(len(s) - n + 1):
                h = xxhash.xxh64(f"{kind}{n}:{s[i:i + n]}".encode(), seed=42).intdigest()
                grams.append((h - 2 ** 64 if h >= 2 ** 63 else h) % (len(weights) - 1))
    z = sum(weights[g] for g in grams) / math.sqrt(max(len(grams), 1)) + weights[-1]
    score = 1 / (1 + math.exp(-z))
    return host, path, rule and rule[0], rule[1] if rule else ("block" if round(score, 6) >= 0.5 else "allow"), score


def test_url_filter_equals_brute_force(spark):
    weights = urls.train(urls.labelled_urls(spark))
    judged = urls.judge(urls.labelled_urls(spark), weights, rules=[]).collect()
    assert all(r["verdict"] == ("block" if r["label"] else "allow") for r in judged)
    odd_urls = [(u,) for u in ["http://a.Foo.ORG/x", "https://example.org/es/1", "https://example.org/en/17", "https://example.org/en/27", "http://x.com/de/",
                               "noscheme.org/x", None, "", "http://foo.org", "http://foo.org?x=/", "ftp://h#frag", "http://notorg/x", "://", "http://é.org/ü?",
                               "https://win-casino-bonus.example/slots"]]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url").union(spark.createDataFrame(odd_urls, "url string"))
    got = urls.judge(pages.withColumn("rule", F.lit(1)), weights)
    for r in got.collect():
        host, path, rule, verdict, score = brute_url(r["url"], weights)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict) and abs(r["score"] - score) < 2e-6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert urls.judge(pages.limit(0), weights).count() == 0
    assert urls.train(urls.labelled_urls(spark).limit(0))[:-1] == [0.0] * urls.BUCKETS


# --- HTML --------------------------------------------------------------------

@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\n\nb"),
    ("<html><head><title>x</title><p>Hello <b>w</b>orld &amp; co<script>var a='</p>';</script></p><div class=ad>buy</div>", "Hello world & co"),
    ('<body class="has-sidebar"><div id=nav><a href=x>m</a></div><div class="content-wrap"><h1>T</h1><div class="post-body"><p>First paragraph, long enough '
     'to count.<p>Second one, also rather long.<ul><li>one<li>two</ul></div></div><div class=comments><p>Nice post!</p></div></body>',
     "T\n\nFirst paragraph, long enough to count.\n\nSecond one, also rather long.\n\none\n\ntwo"),
    ("<article><h1>A</h1><form>f</form><aside>s</aside><p>x <a href='q>ok</a>'>l</a>\n y<br>z</p><footer>foot</footer></article>", "A\n\nx l y z"),
    ("<div>" * 5000 + "deep", "deep"), ("<article><p>cut off <b>here", "cut off here"), ("<!-- only a comment", ""),
    ("<article><p title='the hidden class of ads'>kept</p><p><a href=/x/>one link</a></p><p>a<p hidden>b<p class=notice>c</article>", "kept\n\none link\n\na"),
])
def test_html(page, text):
    assert html.main_text(page) == text


STORY = "A sentence of the story, with commas, that goes on for a while. " * 4
MENU = "<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Sport</a></ul>"


@pytest.mark.parametrize("page, blocks", [
    # sections of a container without an article element, the last one short
    (f"<body>{MENU}<div><section><h2>A</h2><p>{STORY}<p>{STORY}</section><section><h2>B</h2><p>{STORY}</section>"
     "<section><h2>C</h2><p>Short one.</section></div></body>", ["A", STORY, STORY, "B", STORY, "C", "Short one."]),
    # sibling containers right below the body, between lists of links
    (f"<body>{MENU}<div><p>{STORY}<p>{STORY}</div><div><p>{STORY}</div><div><a href=1>x</a> | <a href=2>y</a></div></body>", [STORY, STORY, STORY]),
    # a class word that would take the whole page; the comments inside it go
    (f"<body>{MENU}<div class='text-alert-story'><p>{STORY}<p>{STORY}<div class=comments><p>{STORY * 5}</div></div></body>", [STORY, STORY]),
    # marked elements go, however long, if there is text without them
    (f"<body><div class='cookie-notice'><p>{STORY * 3}</div><div><p>{STORY}</div><div class=comments><p>{STORY * 20}</div></body>", [STORY]),
    # a teaser article beside the story is links
    (f"<body><main><article><h1>T</h1><p>{STORY}<p>{STORY}</article><article><h3><a href=1>Other story</a></h3><a href=2>read on</a></article></main></body>",
     ["T", STORY, STORY]),
])
def test_html_by_density(page, blocks):
    assert html.main_text(page) == "\n\n".join(b.strip() for b in blocks)


def test_html_pages_without_article_elements(spark):
    """The density alone finds what the article elements hold, also cut into containers."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page, want = r["html"], html.main_text(r["html"])
        plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html.main_text(plain) == want
        # a container per paragraph: thin ones stay inside a common container (right below the body they go)
        cut = page.replace("<article>", "<div><div>").replace("</article>", "</div></div>").replace("</p><p>", "</p></div><div><p>")
        assert html.main_text(cut) == want


def test_html_pages(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit(1))
    got = html.extract(pages).collect()
    want = {}
    for r in pages.collect():  # the fixture's template: the article element's blocks
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.entities.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", body)]
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(pages.limit(0)).count() == 0


def test_kept_columns_may_have_dots(spark, docs):
    rows = docs.limit(40).withColumn("a.b", F.lit(7))
    model = language.fit(docs)
    for out in (licenses.scan(rows), language.identify(rows, model), html.extract(rows.withColumn("html", F.col("text")).withColumn("x.y", F.lit(1)))):
        assert "a.b" in out.columns and {r["a.b"] for r in out.collect()} == {7}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = toxicity.classify(rows, toxicity.fit(docs, labels))
    assert {r["a.b"] for r in out.collect()} == {7}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """All labelled rows reach the training, the long ones too, in several shards."""
    text = F.when(F.col("id") == 7, F.repeat(F.lit("plain "), 40_000)).when(F.col("id") % 40 == 0, F.lit("a vile day")).otherwise(F.lit("a fair day"))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.col("text").contains("vile").cast("int").alias("toxic"))
    rows = toxicity.labelled_rows(docs, labels, shards=3)
    assert rows.count() == docs.where(~T.held_out("doc_id")).count() and rows.agg(F.max(F.size("words"))).first()[0] == 40_000
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 100_000)
    got = toxicity.classify(docs.join(labels, "doc_id"), toxicity.fit(docs, labels))
    assert got.where("doc_id <> 7 and predicted <> toxic").count() == 0  # row 7: words of no other row


def test_toxicity_peaks_of_long_documents(monkeypatch):
    rng = np.random.default_rng(8)
    model = toxicity._start(2, 64)
    model.table[:-1] = rng.normal(size=model.table[:-1].shape)
    d = rng.integers(-2 ** 62, 2 ** 62, 300)
    flat, offsets = toxicity._pick([toxicity.rows_of(x, x, 64) for x in (d, d[:0], d[40:], d[:1])])
    top, at = toxicity._peaks(model, flat, offsets)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    top2, at2 = toxicity._peaks(model, flat, offsets)
    assert np.allclose(top, top2, atol=1e-4) and np.array_equal(at, at2)


def test_toxicity_labels_and_texts_meet_in_one_exchange(spark):
    """Whatever their sizes, labels and texts are shuffled once, together; an id's texts all take its highest label."""
    docs = spark.createDataFrame([(1, "one", "en"), (1, "one", "en"), (1, "other one", None), (2, "two", "en"), (3, None, "en"), (None, "none", "en"),
                                  (5, "five", "en"), (6, "", "en"), (7, "no label", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, 1), (5, 2), (6, 0), (None, 1), (99, 1)], "doc_id int, toxic int")
    rows = toxicity.labelled_rows(docs, labels, shards=3)
    taught = docs.where("doc_id in (1, 2, 6)").where(~T.held_out("doc_id")).select((F.col("doc_id") == 1).cast("int").alias("label"), "lang", F.size(T.words("text")).alias("n"))
    assert taught.count() > 1 and sorted(rows.select("label", "lang", F.size("words")).collect(), key=str) == sorted(taught.collect(), key=str)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_toxicity_sends_only_words_to_python(spark):
    """Kept columns, the texts themselves too, stay with Spark; each row is scored once, whatever filter follows."""
    model = toxicity._start(2, toxicity.BUCKETS)
    model.table[:-1] = np.random.default_rng(5).normal(size=model.table[:-1].shape)
    model.groups, model.votes, model.limits = ["any"], np.zeros((toxicity.BUCKETS, 1), np.float32), np.zeros(1)
    texts = ["Some words, here", "other words", "", None, "words " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("gap", F.expr("make_interval(1)"))  # a type Arrow does not take
    out = toxicity.classify(docs, model)
    assert [c for c, _ in out.dtypes] == ["doc_id", "text", "gap", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.withColumn("gap", F.col("gap").cast("string")).collect()}
    for i, text in enumerate(texts):
        h = spark.sql("SELECT 1").select(T.word_hashes(F.lit(text)).alias("w"), F.transform(T.words(F.lit(text)), lambda w: F.xxhash64(F.left(w, F.lit(toxicity.PREFIX)))).alias("b")).first()
        rows = toxicity.rows_of(np.array(h["w"], np.int64), np.array(h["b"], np.int64), toxicity.BUCKETS)
        score = toxicity.scores(model, rows, np.array([0, len(rows)]))[0]
        assert got[i]["gap"] == "1 years" and abs(got[i]["score"] - score) < 1e-5 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    plan = out.where("predicted = 0").select("text")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
