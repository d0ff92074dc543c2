"""Operators on single texts against brute-force versions."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from millrace.llm import bpe, gbt, html_extract, license_scan, pii, quality, toxicity
from millrace.llm.queries import tokenizer_path

PATH = tokenizer_path()
ODD = ["", " ", "\n\n", "a", "é", "it's I'LL we'll", "x  y\t\tz \n", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "日本語 😀😀", "՘a\U000323b0 1", "\x00\x1c\x85\xa0", "ab" * 3000, "١٢٣ ½ Ⅷ"]


@pytest.fixture(scope="module")
def documents(sf):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]


# ------------------------------------------------------------------ BPE


def test_bpe_equals_the_library(documents):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(PATH)
    model = bpe.Bpe(PATH)
    rng = random.Random(1)
    noise = ["".join(rng.choices("ab é1'\n .😀", k=40)) for _ in range(200)]
    texts = [*documents, *ODD, *noise]
    ids = model.encode_batch(texts)
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in ids] == want
    assert [model.decode(i) for i in ids] == [theirs.decode(w, skip_special_tokens=False) for w in want] == texts


def test_bpe_remembers_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    model = bpe.Bpe(PATH)
    texts = ["one two three four", "five six seven", "one two"]
    assert [model.decode(model.encode_batch([t])[0]) for t in texts] == texts
    assert len(model.known) < 8


def test_attributes_of_added_tokens(tmp_path):
    import json

    tokenizers = pytest.importorskip("tokenizers")
    spec = json.loads(open(PATH, encoding="utf-8").read())
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    for k, (content, more) in enumerate((("<left>", {"lstrip": True}), ("<right>", {"rstrip": True}), ("<both>", {"lstrip": True, "rstrip": True}), ("whole", {"single_word": True}))):
        spec["added_tokens"].append({"id": 50257 + k, "content": content, **plain, **more})
    path = str(tmp_path / "t.json")
    open(path, "w", encoding="utf-8").write(json.dumps(spec))
    theirs, model = tokenizers.Tokenizer.from_file(path), bpe.Bpe(path)
    texts = ["a <left> b", "a  <right>  b", "x <both> \n y", "whole wholes a whole. unwhole", "<left><right>", " whole "]
    got = [np.frombuffer(i, dtype="<u4").tolist() for i in model.encode_batch(texts)]
    assert got == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


# ------------------------------------------------------------------ personal data


def base_spans(text):
    """The definition of the base kinds, by plain expressions."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans(documents):
    rng = random.Random(2)
    noise = ["".join(rng.choices("a.@@-1 2+(", k=60)) for _ in range(4000)]
    noise += ["".join(rng.choices("0123456789 -.", k=70)) for _ in range(2000)]
    hand = ["a@b@c.de", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "x@y", "@a.b", "é@a.b a%+@a-b.c-"]
    for text in [*documents, *noise, *hand, ""]:
        assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE] == base_spans(text), text


def test_method_spans():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32. My SSN is 123-45-6789; part 123-45-6789x" + " " * 80 + "987-65-4321 token = abcdef0123456789abcd"
    found = [(k, text[a:b]) for k, a, b, _ in pii.spans_of(text) if k not in pii.BASE]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in found and ("ssn", "123-45-6789") in found and ("secret", "abcdef0123456789abcd") in found
    assert ("ssn", "987-65-4321") not in found and sum(k == "iban" for k, _ in found) == 1
    plain, near = pii.spans_of("a@b.cd")[0][3], pii.spans_of("mail a@b.cd")[0][3]
    assert near > plain
    plain, near, against, both = (pii.spans_of(t)[0][3] for t in ("x 1.2.3.4", "server 1.2.3.4", "version 1.2.3.4", "server version 1.2.3.4"))
    assert against < plain < near == both
    assert pii.redacted("version 1.2.3.4", 0.6) == "version 1.2.3.4" and pii.redacted("server 1.2.3.4", 0.6) == "server <IP>"
    assert pii.redacted("to a@b.cd, +1 234 567 8901!") == "to <EMAIL>, <PHONE>!"
    assert pii.redacted(None) is None and pii.redacted("nothing") == "nothing"


@pytest.mark.parametrize("after", ["", ".", " BIC COBADEFFXXX", " EUR 500", " A payment", " 12 34 56 78", " GB82 WEST 1234 5698 7654 32", " AB12 3456"])
@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S", "ZZ90WEST12345698765473"])
@pytest.mark.parametrize("before", ["", "to AB12 3456 ", "REF XY99 "])
def test_ibans_end_at_a_checked_boundary(before, iban, after):
    text = before + iban + after
    assert iban in [text[a:b] for k, a, b, _ in pii.spans_of(text) if k == "iban"]
    assert iban not in pii.redacted(text)


@pytest.mark.parametrize("n", [15, 16, 512, 513, 700, 100_000])
def test_secrets_of_any_length(n):
    text = "token=" + "aB3-" * (n // 4) + "x" * (n % 4)
    assert [s[:3] for s in pii.spans_of(text + " end")] == ([("secret", 6, 6 + n)] if n >= 16 else [])
    assert pii.redacted(text + " end") == ("token=<SECRET> end" if n >= 16 else text + " end")


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for unit in ("a", "1", "1.", "a@", "@", "+1", "+1(", "token", "token ", "AB12", "1-", "."):
        pii.spans_of(unit * (300_000 // len(unit)))
    assert time.perf_counter() - began < 20


# ------------------------------------------------------------------ quality


def brute_repeats(words):
    at = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if at[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_quality_figures(documents):
    rng = random.Random(3)
    noise = [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(300)]
    for text in [*documents, *noise, *ODD, None, "a\x0bb\x0cc d e", "x\nx\n \n \ny\nx"]:
        d, t = quality.Doc(text), text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert d.n_words == len(words) and d.word_chars == sum(map(len, words))
        assert d.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert d.n_dup_lines == len(lines) - len(set(lines))
        assert d.n_repeat_words == brute_repeats(words)


def brute_kept(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = len(lines) - len(set(lines))
    shouted = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words)
    return not (
        n < 50
        or 100 * brute_repeats(words) > 50 * n
        or 10 * len(re.findall(r"[#*$%&|<>]", t)) > n
        or 10 * shouted > 6 * n
        or (repeated >= 4 and 10 * repeated > 6 * len(lines))
        or not 2 * n <= chars <= 25 * n
        or 2 * len(re.findall("[0-9]", t)) > chars
        or 5 * len(re.findall(r"[!?;:,.()\[\]{}\"'\-_/\\=+@^~`]", t)) > 2 * chars
    )


def quality_texts(documents):
    rng = random.Random(13)
    pools = (["ab", "CD", "EF", "GH"], ["12", "345", "x"], ["a!!!-", "?!.b;", "(c)..."], ["#", "word", "other"], ["a" * 40, "b"], ["line one\n", "line two\n"])
    return [*documents, *(" ".join(f"{w}{rng.randint(0, 99)}" if k % 2 else w for w in rng.choices(p, k=rng.randint(30, 120))) for k in range(20) for p in pools), *ODD, None]


def test_verdicts(documents):
    verdicts = Counter()
    for t in quality_texts(documents):
        no = quality.first_rejection(quality.Doc(t), quality.RULES)
        assert (no is None) == brute_kept(t), t
        verdicts[no] += 1
    # repeated lines are repeated words as well, so the rule before them rejects first
    assert set(verdicts) == {None, *(n for n, _ in quality.RULES)} - {"repeated_lines"}
    line = quality.Doc("\n".join(["one line that stands here again and again"] * 8))
    assert [r(line) for n, r in quality.RULES if n == "repeated_lines"] == [True]


def test_cascade_order_saves_work_and_never_changes_the_verdict(documents):
    texts = quality_texts(documents)
    order = quality.plan([quality.profile(t) for t in texts])
    assert sorted(n for n, _ in order) == sorted(n for n, _ in quality.RULES)
    work = Counter()
    for t in texts:
        verdicts = set()
        for name, rules in (("plan", order), ("given", quality.RULES), ("back", order[::-1])):
            d = quality.Doc(t)
            verdicts.add(quality.first_rejection(d, rules) is None)
            work[name] += sum(d.work.values())
        work["all"] += sum(quality.profile(t).work.values())
        assert len(verdicts) == 1
    assert work["plan"] < work["given"] and work["plan"] < work["back"] and work["plan"] < 0.95 * work["all"]
    dear = ("dear", lambda d: d.n_repeat_words < 0)
    cheap = ("cheap", lambda d: d.n_symbols >= 0)
    assert [n for n, _ in quality.plan([quality.profile(t, [dear, cheap]) for t in "ab"], [dear, cheap])] == ["cheap", "dear"]
    assert [n for n, _ in quality.plan([], [dear, cheap])] == ["cheap", "dear"]


def test_shared_features_are_charged_once(documents):
    rules = [("one", lambda d: d.n_words < 0), ("two", lambda d: d.n_upper < 0), ("three", lambda d: d.n_symbols < 0)]
    assert [n for n, _ in quality.plan([quality.profile(t, rules) for t in documents], rules)] == ["three", "one", "two"]


# ------------------------------------------------------------------ licenses


def test_license_base(documents):
    rng = random.Random(4)
    noise = [" ".join(rng.choices(["cc", "by", "all", "rights", "reserved", "General", "public", "license", "x", "é"], k=30)) for _ in range(300)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text in [*documents, *noise, *ODD, None, "CC BY", "cc-by,cc by.cc", "All rights reserved"]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        at = {}
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    at.setdefault(label, []).append(i)
        every = sum(at.values(), [])
        n_words, n_base, first, last, base, labels, score, _ = license_scan.scan(text)
        assert (n_words, n_base, first, last) == (len(words), len(every), min(every, default=None), max(every, default=None))
        assert base == ",".join(sorted(at)) and set(base.split(",")) <= {*labels.split(","), ""} and 0 <= score <= 1


def labels(text):
    return license_scan.scan(text)[5]


def test_license_templates():
    assert labels("Released under the MIT License.") == "mit"
    assert labels("Licensed under the Apache License, Version 2.0.") == labels("licensed under the terms of the apache license 2.0") == "apache-2.0"
    assert labels("Licensed under the Apache Software License 2.0") == ""
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("Copyright (c) 2020 Some Body. All rights reserved") == "reserved"
    assert labels("Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.") == "agpl-3.0,gpl"
    assert labels("under the GNU Lesser General Public License v2.1") == "gpl,lgpl-2.1"
    assert labels("Mozilla Public License 2.0") == "mpl-2.0" and labels("BSD 3-Clause License") == "bsd-3-clause"
    assert labels("Creative Commons Attribution 4.0 International License") == "cc-by-4.0"
    assert labels("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International") == "cc-by-nc-sa-4.0"
    assert labels("SPDX-License-Identifier: Apache-2.0") == "apache-2.0" and labels("permission to copy the software") == ""
    with pytest.raises(ValueError):
        license_scan.Template("x", "a [[b")


def filled(markup, word="someone"):
    """A text of a template: every optional region and one word at each free place."""
    return re.sub(r"\{\{\d+\}\}", word, markup.replace("[[", "").replace("]]", ""))


@pytest.mark.parametrize("k", range(len(license_scan.TEMPLATES)))
def test_every_template_is_found(k):
    label, markup = license_scan.TEMPLATES[k]
    t = license_scan.COMPILED[k]
    text = filled(markup)
    assert label in labels(f"before it\n{text.upper()}\nand after").split(",")
    least = re.sub(r"\[\[[^\[\]]*\]\]", "", markup)
    least = re.sub(r"\[\[[^\[\]]*\]\]", "", least)
    fixed = b" " + b" ".join(re.sub(r"\{\{\d+\}\}", "", least).encode().translate(license_scan.ALNUM).split()) + b" "
    assert any(key in fixed for key in license_scan.KEYS), fixed
    assert label in labels(re.sub(r"\{\{\d+\}\}", "", least)).split(",")
    words = text.split()
    if len(fixed.split()) > 20:  # with another mandatory word it is no longer this text
        words[next(i for i in range(len(words) // 3, len(words)) if words[i].isalpha() and words[i] != "someone")] = "zzz"
        assert all(n[2] - n[1] < len(words) - 3 for n in license_scan.scan(" ".join(words))[7])


def brute_ends(parts, words, at):
    """All places where a template (words, numbers for free places, lists for optional regions) can end."""
    if not parts:
        return {at}
    first, rest = parts[0], parts[1:]
    if isinstance(first, list):
        return brute_ends(rest, words, at) | {e for m in brute_ends(first, words, at) for e in brute_ends(rest, words, m)}
    if isinstance(first, int):
        return {e for n in range(first + 1) if at + n <= len(words) for e in brute_ends(rest, words, at + n)}
    return brute_ends(rest, words, at + 1) if at < len(words) and words[at] == first else set()


def test_template_automaton():
    rng = random.Random(6)

    def grow(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            out.append(rng.randint(1, 2) if kind < 0.2 else grow(depth - 1) if kind < 0.45 and depth else rng.choice("abc"))
        return out

    def shown(parts):
        return " ".join(f"{{{{{p}}}}}" if isinstance(p, int) else f"[[{shown(p)}]]" if isinstance(p, list) else p for p in parts)

    cases = [["a", [2, "b"], "c"], ["a", ["b", ["c"], "d"], 2, "e"], [[1, ["a"]], "b"], [2, [1], "c"]]
    for parts in cases + [grow(2) for _ in range(400)]:
        t = license_scan.Template("x", shown(parts))
        for _ in range(25):
            words = rng.choices("abcq", k=rng.randint(0, 8))
            want = max(brute_ends(parts, words, 0), default=None)
            assert t.match([w.encode() for w in words], 0) == want, (shown(parts), words)


# ------------------------------------------------------------------ toxicity


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(1500):
        y = int(k % 6 == 0)
        noise = rng.integers(100, 1 << toxicity.BITS, 60).astype(np.int32)
        rows.append(np.unique(np.append(noise, [rng.integers(0, 5)] if y else [99]).astype(np.int32)))
        labels.append(y)
    model = toxicity.ftrl(rows[:1200], labels[:1200])
    w = model.dense()
    right = sum(((w[r].sum() + model.bias) > 0) == y for r, y in zip(rows[1200:], labels[1200:]))
    assert right >= 0.97 * 300 and len(model.index) < 0.05 * 1200 * 60
    assert not toxicity.ftrl([], []).trained


def scalar_ftrl(rows, labels, alpha=1.0, beta=1.0, l1=6.0, l2=0.1, epochs=6, seed=7):
    """FTRL-proximal one coordinate at a time, by its definition; the bias (-1) has no L1."""
    z, n = Counter(), Counter()

    def weight(i):
        keep = 0.0 if i == -1 else l1
        if abs(z[i]) <= keep:
            return 0.0
        return -(z[i] - (keep if z[i] > 0 else -keep)) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            active = [*rows[k].tolist(), -1]
            w = {i: weight(i) for i in active}
            p = 1 / (1 + np.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = p - labels[k]
            for i in active:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if i != -1 and weight(i)}, weight(-1)


def test_ftrl_equals_the_scalar_definition():
    rng = np.random.default_rng(8)
    labels = rng.integers(0, 2, 300).tolist()
    rows = [np.unique(np.append(rng.integers(10, 400, 25), [y, 5])).astype(np.int32) for y in labels]
    model = toxicity.ftrl(rows, labels, l1=1.5)
    weights, bias = scalar_ftrl(rows, labels, l1=1.5)
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(weights, rel=1e-4, abs=1e-6)
    assert model.bias == pytest.approx(bias) and 0 < len(weights) < 392


def test_features_are_words_pairs_and_skip_pairs():
    f = toxicity.Features()
    one, two, three = (set(f(t).tolist()) for t in ("a b", "a c b", "a x y b"))
    assert len(one) == 3 and len(two) == 6 and len(three) == 9
    assert len(set(f("a q c").tolist()) & set(f("a z c").tolist())) == 3  # both words and the pair around the middle


def test_features_are_distinct_and_ignore_case():
    f = toxicity.Features(remembered=2)
    assert f("").size == f(None).size == 0
    assert f("One, two; THREE").tolist() == f("one two three").tolist() and len(f("one two three")) == 6


# ------------------------------------------------------------------ HTML


@pytest.fixture(scope="module")
def trees():
    return html_extract.train(pages=250)


def test_generated_pages(trees):
    right = wrong = total = 0
    for page, main in html_extract.training_pages(120, seed=77):
        got = {t for t in html_extract.extract(page, trees).split("\n\n") if t}
        right, wrong, total = right + len(got & main), wrong + len(got - main), total + len(main)
    assert right / total > 0.97 and right / (right + wrong) > 0.97


def test_pages_of_the_table(trees, sf):
    import html as h

    import duckdb

    for page in (r[0] for r in duckdb.sql(f"select html from '{sf}/pages.parquet'").fetchall()):
        inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
        parts = (re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside))
        assert html_extract.extract(page, trees) == "\n\n".join(filter(None, parts))


def test_decoding_keeps_no_node_in_a_dropped_one(trees):
    nodes = html_extract.nodes_of(html_extract.parse("<div><p>one</p><p>two</p></div><p>three</p>"))
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = html_extract.decode(nodes, rng.normal(0, 3, len(nodes)))
        assert [n.text for n in kept] == [t for t in ("one", "two", "three") if t in {n.text for n in kept}]
    assert html_extract.decode(nodes, np.full(len(nodes), -5.0)) == []
    assert len(html_extract.decode(nodes, np.full(len(nodes), 5.0))) == 3


def test_broken_html(trees):
    for page in (None, "", "<", "<a <b>", "<script>x", "<!--", "<![CDATA[x", "</p></div>", "<p", "&amp", "<br><hr/>"):
        assert isinstance(html_extract.extract(page, trees), str)
    assert html_extract.extract("<p>a &amp; b&nbsp;&#233;\n\n c<br>d</p>", trees) == "a & b é c d"
    began = time.perf_counter()
    for page in ("<div>" * 30_000 + "x", "<p " * 60_000, '<a b="' * 30_000, "<p>x" * 20_000, "<script>" * 20_000):
        html_extract.extract(page, trees)
    assert time.perf_counter() - began < 30


def test_references_are_decoded_within_a_piece_of_text(trees):
    text = "many more words here to make this a paragraph of an article"
    assert html_extract.extract(f"<article><p>&am<b>p;lt;</b> {text} &amp;lt; &lt;</p></article>", trees) == f"&amp;lt; {text} &lt; <".replace("&amp;lt;", "&am" + "p;lt;", 1)


def test_closing_tags(trees):
    def shape(node):
        return node.text if node.text is not None else (node.tag, [shape(k) for k in node.kids])

    tree = lambda page: shape(html_extract.parse(page))
    assert tree("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ("html", [("ul", [("li", ["a"]), ("li", ["b", ("ul", [("li", ["c"])])])]), "d"])
    assert tree("<p>a<div>b</p>c</div>d") == ("html", [("p", ["a"]), ("div", ["b", "c"]), "d"])
    assert tree("<li><div>x</li>y</div>z") == ("html", [("li", [("div", ["x", "y"]), "z"])])
    assert tree("<section><blockquote><p>x</section>y") == ("html", [("section", [("blockquote", [("p", ["x"])])]), "y"])
    assert tree("</div></p>x<body>y</body>z") == ("html", ["x", ("body", ["y"]), "z"])


@pytest.mark.parametrize("unit", ["<blockquote>", "<svg>", "<button>x", "<li><div>", "<ul><li>", "</li>", "<blockquote></li>", "<p>", "<section></p>", "<td>", "<select>", "<b>", "<a>"])
def test_parsing_takes_linear_time(unit):
    def took(n):
        began = time.perf_counter()
        html_extract.nodes_of(html_extract.parse("<li><div>" + unit * n + "x"))
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 25 * max(took(10_000), 0.02)


def test_boosting_fits_an_interaction():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gbt.Boosted(trees=20, depth=3).fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.93
