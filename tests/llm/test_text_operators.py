"""Licence scans, chat formatting, URL rules, WARC, toxicity: brute force, round trips and edge cases."""

import base64
import gzip
import hashlib
import math
import random
import zlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, licenses, toxicity, url_filter, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = [
    None, "", "Released under the MIT License. mit-license MIT\nlicense", "GNU General Public License and the Apache License, cc-by", "gnu general public licenses", "É mit license\x7fmit license",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: MIT. This is prose", "mit " * 5000 + "license", "permission is hereby granted, free of charge",
]


def brute_scan(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("id", F.lit(1))
    found = {r.id: r for r in licenses.scan_licenses(rows).collect()}
    for k, text in enumerate(TEXTS):
        r = found[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert found[6].labels == "apache-2.0,classpath-exception-2.0,gpl-2.0-only,mit" and found[7].labels == "mit" and found[9].labels == "mit"
    assert found[6].freedom == pytest.approx(0.65)
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


def test_shunting_yard():
    assert licenses.postfix(licenses.tokens("a or b and c with d")) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.postfix(licenses.tokens("(a or b) and c")) == ["a", "b", "or", "c", "and"]
    assert licenses.tokens("mit and and") == ["mit"] and licenses.postfix(["(", "a"]) is None
    assert licenses.tokens("Apache-2.0 OR (MIT") == ["Apache-2.0"] and licenses.tokens("(MIT") == [] and licenses.tokens("(a or b) and (c") == ["(", "a", "or", "b", ")"]


def test_license_labels_and_scores(spark):
    """All labels against a plain search for the phrases and a plain reading of tags; repeated rows and null ids are rows of their own."""
    tags = {"MIT": "mit", "Apache-2.0 OR (MIT": "apache-2.0", "(": "", "MPL-2.0 and MIT": "mpl-2.0,mit"}
    texts = [f"{notice} // SPDX-License-Identifier: {tag}\nrest" for notice in ("", "the ISC license,", "All rights reserved; CC0") for tag in tags]
    rows = [(None if k % 3 else k, t) for k, t in enumerate(texts)] * 2
    found = Counter((r.id, r.labels) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    expected = Counter()
    for id_, text in rows:
        label = tags[text.partition(": ")[2].partition("\n")[0]]
        words = " ".join(WORD.findall(text.translate(LOWER)))
        own = {x for phrase, x in {**licenses.BASE, **licenses.NOTICES}.items() if f" {phrase} " in f" {words} "}
        expected[id_, ",".join(sorted(own | set(filter(None, label.split(",")))))] += 1
    assert found == expected


CHATS = [
    (1, 0, "user", "hi </s> [INST] there"), (1, 1, "assistant", "<\\s> and <s> \\ and <\\\\/s>"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", "tie"), (None, None, "assistant", "null id"),
    (3, 0, "[/INST]", "[INST] x [/INST] y </s>"), (4, 5, "system", "z" * 50), (4, None, "assistant", "first"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
]


@pytest.mark.parametrize("chunk", [1 << 20, 20])
def test_chat_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    found = {r.conv: r for r in chat.read_chats(chat.format_chats(rows)).collect()}
    for conv in {c for c, *_ in CHATS}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"[INST] {chat.escape(a)} [/INST]{chat.escape(b)}</s>") for *_, a, b in turns) + 3
    assert chat.read_chats(chat.format_chats(rows.limit(0))).count() == 0


def test_escape_is_reversible_and_safe():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "s>", "/s>", "[INST]", "INST]", "[", "/", "</s>", "<s>", "x", " "]) for _ in range(rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_template_language():
    tree = chat.fold_body(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{% for m in messages %}{% if m.role != 'x' and loop.first %}!{% endif %}{{ m.text | trim }}{% endfor %}"))
    assert tree[0] == ("text", "abcd") and tree[1][0] == "for"
    render = chat.compile_template("{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}")
    assert list(render([{"text": "q", "role": "r"}])) == [("q", True), (";", False)]
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ a | system }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def brute_rule(host, path):
    fits = [(len(h + p), -k, v, h + p) for k, (v, h, p) in enumerate(url_filter.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def test_url_rules(spark):
    urls = [None, "", "example.com/en/7", "HTTP://A.Example.COM/en/7x?q=/de/", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8/9#x", "http://b.org/es/?a", "http://b.org?x=/es/", "http://foo.net/x.example.com/en/7",
            "ftp://spam-farm.example.org/fr/1", "http://x/setup.exe", "://com/en/", "http://é.com/en/ü", "http://" + "a" * 5000 + ".com/en/", "http://a.com/EN/", "a://b://c.com/en/", "http://a.b\n.com/en/"]
    rng = random.Random(2)
    urls += [f"http://{rng.choice(['', 'a.', 'b.example.'])}{rng.choice(['com', 'example.com', 'net', 'example.net', 'org', 'de'])}{rng.choice(['/en/', '/de/', '/es/', '/en', ''])}{rng.randrange(90)}" for _ in range(300)]
    found = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    for k, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        rule = brute_rule(host, path)
        r = found[k]
        assert (r.host, r.path) == (host, path) and r.rule == (rule[1] if rule else None) and r.verdict == (rule[0] if rule else r.verdict), url
    assert found[11].verdict == "block" and found[12].verdict == "block" and found[0].verdict == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    """Written out, as rules read from the module can't show that one of them is wrong."""
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://example.net/de/1": ("net/de/", "allow"), "http://a.example.net/de/81": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"), "http://net/de/x.exe": ("net/de/", "allow")}
    found = {r.id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [found[k] for k in range(len(urls))] == [*urls.values()]


@pytest.mark.parametrize("url, spelling", [
    ("http://u:p@a.com.:80//x/./y/../z", "a.com/x/z"), ("https://a.com:443", "a.com/"), ("http://a.com:8080/b/", "a.com:8080/b/"), ("http://a.com/%41%2fb%7E%c3%a9%zz", "a.com/A%2Fb~%C3%A9%zz"),
    ("http://a.com/../../x", "a.com/x"), ("http://a.com/x/..", "a.com/"), ("http://a.com/x/.", "a.com/x/"), ("http://a%2Ecom/", "a%2Ecom/"),
])
def test_canonical_urls(url, spelling):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    assert url_filter.canonical(m[1], m[2]) == spelling
    assert url_filter.canonical(*spelling.partition("/")[::2]).rstrip("/") in (spelling.rstrip("/"), spelling.rstrip("/").replace("//", "/"))


def test_block_list_sees_canonical_urls(spark):
    urls = ["http://a.com/x/../%77p-login.php", "http://spam-farm.com:80/", "http://b.com/%2e%2e/f.zip", "http://b.com/f.zip/more", "http://x@casino.net", "http://a.com/wp-login.php5"]
    found = {r.id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [found[k] for k in range(6)] == ["block", "block", "block", "allow", "block", "allow"]


def test_rules_from_tables(spark, monkeypatch):
    """Ties between rules of equal length go to the one given first; tables come in the order of host and path."""
    urls = spark.createDataFrame([(1, "http://a.com/xy"), (2, "http://b.org/q")], "page_id long, url string")
    tie = [("block", "a.com", "/x"), ("allow", "a.com", "/x")]
    assert {r.id: r.verdict for r in url_filter.judge_urls(urls, rules=tie).collect()} == {1: "block", 2: "allow"}
    assert {r.id: r.verdict for r in url_filter.judge_urls(urls, rules=tie[::-1], blocked=["b.org/?"]).collect()} == {1: "allow", 2: "block"}
    table = spark.createDataFrame([("block", "A.com", "/x"), ("block", "A.com", "/x"), ("allow", None, "/")], "verdict string, host string, path string")
    assert url_filter.rules_from(table) == [("block", "a.com", "/x")]
    assert url_filter.globs_from(spark.createDataFrame([("b*",), ("a?",), (None,)], "glob string")) == ["a?", "b*"]
    assert url_filter.rules_from(table.limit(0)) == [] and {r.verdict for r in url_filter.judge_urls(urls, rules=[], blocked=[]).collect()} == {"allow"}
    monkeypatch.setattr(url_filter, "MOST_RULES", 1)
    with pytest.raises(ValueError, match="more than 1 rules"):
        url_filter.globs_from(spark.createDataFrame([("b*",), ("a?",)], "glob string"))


def glob_regex(glob):
    out = ""
    k = 0
    while k < len(glob):
        if glob.startswith("**", k):
            out, k = out + "(?s:.*)", k + 2
            continue
        out += "[^/]*" if glob[k] == "*" else "[^/]" if glob[k] == "?" else re.escape(glob[k])
        k += 1
    return re.compile(out)


def test_shift_and_against_regex():
    rng = random.Random(4)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    strings = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    found = url_filter.ShiftAnd([url_filter.parse_glob(g) for g in globs]).match([s.encode() for s in strings])
    for j, glob in enumerate(globs):
        regex = glob_regex(glob)
        assert [bool(regex.fullmatch(s)) for s in strings] == found[:, j].tolist(), glob


def warc_expected(pages):
    expected = []
    for k, (page, _, html) in enumerate(pages):
        body = (html or "").encode()
        first = min((p is None, p or 0, j) for j, (p, _, h) in enumerate(pages) if (h or "") == (html or ""))[2]
        expected.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == k else "revisit", None if first == k else pages[first][0]))
    return sorted(expected, key=repr)


@pytest.mark.parametrize("size", [1 << 25, 3_000])
def test_warc_round_trip(spark, size):
    """With one file and with several files to a task."""
    pages = [(1, "http://a.com/x y", "same"), (0, None, "same"), (2, "http://b.com", None), (5, "", ""), (3, "http://c.com/é", "ünï\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (7, "u", "z" * 100_000), (9, "u", "same"), (9, "u", "same"), (None, "n", "null id"), (11, "m", "line\nend\n")]
    pages += [(100 + k, f"http://h.com/{k}", "hot" if k % 3 else f"own {k} " * 50) for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("type", F.lit("clash")).withColumn("id", F.lit(7))
    assert sorted((tuple(r) for r in warc.round_trip(df, file_bytes=size).collect()), key=repr) == warc_expected(pages)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ids_of_any_text(spark):
    pages = [("", "u", "empty"), (None, "u", "null"), ("a\r\npayloadLength: 9\r\n", "u", "line end"), ("é +%2B", "u", "signs"), ("", "u", "again"), (" b ", "u", "line end")]
    found = [tuple(r) for r in warc.round_trip(spark.createDataFrame(pages, "page_id string, url string, html string")).collect()]
    assert sorted(r[0] or "-" for r in found) == sorted(p or "-" for p, *_ in pages) and sum(r[0] is None for r in found) == 1
    assert [r[4] for r in found if r[3] == "revisit"] == [" b "] and len(found) == len(pages)


def test_warc_files_are_bound_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"{k} " + "x" * 5_000) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", file_bytes=20_000)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert len(sizes) > 10 and max(sizes) < 21_000
    assert warc.read_archives(spark, f"{tmp_path}/w").where("type = 'response' and length(payload) > 5000").count() == 40


def test_warc_assembly_joins_either_way(spark):
    schema = "record_id string, concurrent_to string, refers_to string, type string, target_uri string, digest string, payload_bytes long, fields map<string,string>, payload binary"
    rows = [("r1", None, None, "response", "u", "d", 1, None, None), ("q1", "r1", None, "request", "u", None, 0, None, None), ("r2", "q2", None, "response", "u", "d", 1, None, None), ("q2", None, None, "request", "u", None, 0, None, None), ("m1", "r1", None, "metadata", "u", None, 0, {"a": "b"}, None), ("r3", None, None, "response", "u", "d", 1, None, None)]
    found = {r.record_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"r1": ("q1", "m1"), "r2": ("q2", None), "r3": (None, None)}


def test_nnpu_finds_the_unlabelled_positives():
    rng = np.random.default_rng(0)

    def doc(toxic):
        words = rng.integers(100, 5000, 60).tolist() + ([int(rng.integers(0, 8))] if toxic else [])
        return np.unique(np.array(words, np.int32))

    positive, unlabelled = [doc(True) for _ in range(300)], [doc(k % 10 == 0) for k in range(2000)]
    counts = (np.bincount(np.concatenate(rows), minlength=toxicity.FEATURES) for rows in (positive, unlabelled))
    model = toxicity.fit(positive, unlabelled, 0.1, toxicity.evidence(*counts, 300, 2000))
    cut = np.median([model.weights[doc(True)].sum() for _ in range(50)]) / 2
    model = toxicity.Model(model.weights, toxicity.placed(cut))
    score = lambda d: 1 / (1 + np.exp(-(model.weights[d].sum() + model.bias)))
    assert np.mean([score(doc(True)) >= 0.7 for _ in range(300)]) > 0.9 and np.mean([score(doc(False)) >= 0.7 for _ in range(300)]) < 0.05


@pytest.mark.parametrize("shift", [-3.0, 0.0, 3.0])
def test_slopes_are_those_of_the_risk(shift):
    """By finite differences: of the risk where the estimate for negatives is not below zero, else of that estimate, turned round."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(size=7) - shift, rng.normal(size=9) + shift
    of_p, of_u, prior = (x / x.sum() for x in (rng.random(7), rng.random(9))), None, 0.4
    of_p, of_u = of_p
    loss = lambda z: np.log1p(np.exp(-z))
    negative = lambda p, u: of_u @ loss(-u) - prior * (of_p @ loss(-p))
    goal = (lambda p, u: prior * (of_p @ loss(p)) + negative(p, u)) if negative(p, u) >= 0 else (lambda p, u: -negative(p, u))
    got, dp, du = toxicity.slopes(p, u, of_p, of_u, prior)
    assert got == pytest.approx(negative(p, u))
    for k, slope in enumerate(dp):
        step = np.eye(7)[k] * 1e-6
        assert slope == pytest.approx((goal(p + step, u) - goal(p - step, u)) / 2e-6, abs=1e-7)
    for k, slope in enumerate(du):
        step = np.eye(9)[k] * 1e-6
        assert slope == pytest.approx((goal(p, u + step) - goal(p, u - step)) / 2e-6, abs=1e-7)


def test_toxicity_of_held_out_rows_and_long_texts(spark):
    """Labels of held-out rows change no score; a toxic document of many words is fitted on and found."""
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    rows = [(k, f"{filler(20_000 if k % 10 == 0 else 15)} {'vilest scum' if k < 60 else ''}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc_id for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).where("h").collect()}
    assert 100 < len(held) < 300
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(k, int((k < 60) != (flip and k in held))) for k in range(300)], "doc_id long, toxic int")
        scores.append({r.id: r.score for r in toxicity.scored(docs, labels).collect()})
    assert scores[0] == scores[1]
    assert all((scores[0][k] >= toxicity.THRESHOLD) == (k < 60) for k in range(600))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "idiot " * 5), (3, "idiot " * 5)], "doc_id long, text string").withColumn("score", F.lit(9))
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted((str(r.id), r.score) for r in toxicity.scored(docs, empty).collect()) == sorted((str(k), 0.0) for k in (1, 2, None, 3, 3))
    kept = toxicity.drop_toxic(docs, empty)
    assert kept.columns == docs.columns and kept.count() == 5
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    scores = sorted((str(r.id), r.score) for r in toxicity.scored(docs, labels).collect())
    assert [k for k, _ in scores] == ["1", "2", "3", "3", "None"] and scores[2] == scores[3] and all(0 <= x <= 1 for _, x in scores)
    assert scores[0][1] == scores[1][1]  # a null text is an empty one
    left = sorted(str(r.doc_id) for r in toxicity.drop_toxic(docs, labels).collect())
    assert left == [k for k, x in scores if x < toxicity.THRESHOLD]
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0 and toxicity.scored(docs.limit(0), labels).count() == 0


def test_toxicity_scores_are_sums_of_weights(spark):
    """Every score by plain loops: a document's distinct words, each with its beginnings, through the model's weights and the cut that splits the training rows best."""
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))
    rows = [(k, f"{noise(rng.randrange(30))} {'Vilest scum' if k % 6 == 0 else ''} {noise(3)}") for k in range(240)] + [(500, "scum, SCUM: 7"), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(0, 200)], "doc_id long, toxic int")
    model, ids = toxicity.untuned(docs, labels)
    plain = {}
    for k, text in rows:
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        features = [zlib.crc32(part.encode()) % toxicity.FEATURES for w in words for part in [w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) > n)]]
        plain[k] = sum(float(model.weights[f]) for f in features)
    bias = toxicity.tuned(model, toxicity.logits(docs, model), ids).bias
    found = {r.id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert found == pytest.approx({k: 1 / (1 + math.exp(-(x + model.bias + bias))) for k, x in plain.items()})
    train = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    toxic = {k for k in train if k % 6 == 0 and k < 200}
    assert toxic and all(found[k] >= toxicity.THRESHOLD for k in toxic)
    assert sum(found[k] >= toxicity.THRESHOLD for k in train if k % 6 or k >= 240) <= 2


def test_toxicity_cut_does_not_depend_on_the_sample(spark, monkeypatch):
    """Half of the toxic documents are told from clean ones by one word, half share theirs with 5% of the clean: in all documents, unlike in a sample of as many, that is too common a word to cut at."""
    rng = random.Random(6)
    noise = lambda: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(20))
    rows = [(k, f"{noise()} {'vilest' if k % 2 else 'crude'}") for k in range(200)] + [(k, f"{noise()} {'crude' if k % 20 == 0 else ''}") for k in range(200, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(3000)], "doc_id long, toxic int")
    for sample in (150, 6000):
        monkeypatch.setattr(toxicity, "UNLABELLED", sample)
        scores = {r.id: r.score for r in toxicity.scored(docs, labels).collect()}
        assert all(scores[k] >= toxicity.THRESHOLD for k in range(1, 200, 2)), sample
        assert sum(scores[k] >= toxicity.THRESHOLD for k in range(200, 6000)) < 20, sample
