"""The operators that work document by document: secrets, quality, licenses, BPE, HTML."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from likeloom.llm import bpe, html, licenses, mixing, quality, secrets
from likeloom.llm import queries as Q

BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- secrets -------------------------------------------------------------------------------------


def plain_spans(text):
    found = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), rank, m.end(), rule.kind))
    return [(k, s, e) for s, _, e, k in sorted(found)]


PIECES = ["password", "PassWd: ", "token==", "api_key='", "apikey", " = ", '"', "AKIA", "AKIA" + "Z9" * 9, "deadbeef" * 3, "0" * 23, "ghp_" + "x" * 36, "xoxb-1234567890", "AIza" + "k" * 35, "sk_live_" + "7" * 16, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "Bearer " + "q" * 16, "http://u:p@h/", "é", "K", "ſecret: abcdefg", " ", "\n", "the"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), max_size=6))
def test_index_finds_what_plain_scans_find(texts):
    assert secrets.Scanner().spans(texts) == [plain_spans(t) for t in texts]


def test_trigram_queries():
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert queries["hex"] == secrets.TRUE
    assert all(q != secrets.TRUE for k, q in queries.items() if k not in ("hex",))
    assert queries["access"] == ("and", ("gram", b"aki"), ("gram", b"kia"))


def test_index_postings():
    documents = [b"abcabc", b"xxABC", b"", b"ab"]
    index = secrets.TrigramIndex(documents, [b"abc", b"bca"])
    assert [p.tolist() for p in index.postings] == [[0, 1], [0]]
    assert index.candidates(("and", ("gram", b"abc"), ("gram", b"bca"))).tolist() == [0]
    assert index.candidates(("or", ("gram", b"abc"), ("gram", b"bca"))).tolist() == [0, 1]
    assert index.candidates(secrets.TRUE).tolist() == [0, 1, 2, 3]


def test_secrets_awkward(awkward, nothing, awkward_rows):
    got = Counter((r["doc_id"], tuple(map(tuple, r["spans"]))) for r in secrets.scan_secrets(awkward).collect())
    assert got == Counter((r[0], tuple(plain_spans(r[1] or ""))) for r in awkward_rows)
    assert secrets.scan_secrets(nothing).collect() == [] == secrets.redact_secrets(nothing).collect()
    clean = secrets.redact_secrets(awkward)
    assert clean.columns == awkward.columns and clean.count() == len(awkward_rows)
    assert sum(len(plain_spans(r["text"] or "")) for r in clean.collect()) == 0
    assert {r["n_chars"] == len(r["text"]) for r in clean.collect() if r["text"] is not None} == {True}


HOSTILE = {
    "letters with ://": "x://" + "a" * 1_000_000,
    "schemes": "a://b:" * 150_000,
    "letters": "xyz" * 330_000 + "://u:p@h",
    "eyJ": "eyJ" * 330_000,
    "eyJ with points": "eyJaaaaaaaa." * 80_000,
    "bearer": "bearer " * 140_000,
    "keys": "password" * 120_000 + " " * 1000,
    "pem": "-----BEGIN " * 90_000 + "A" * 1000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_seconds(name):
    scanner, start = secrets.Scanner(), time.perf_counter()
    found = scanner.spans([HOSTILE[name]])[0]
    assert time.perf_counter() - start < 10
    assert name != "letters" or [k for k, _, _ in found] == ["login"]


def test_op1_equals_sql(same):
    same(Q.op1_secrets, Q.ORACLE["op1_secrets"])


# ---- quality -------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab #\n\t\x0b\x85é|"), max_size=80))
def test_measures(text):
    assert quality.measures(text)[:5] == plain_measures(text)


def test_quality_awkward(awkward, nothing, awkward_rows):
    rows = quality.quality_report(awkward).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in rows) == Counter((r[0], *(plain_measures(r[1] or "")[i] for i in (0, 4))) for r in awkward_rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows) and any(r["kept"] for r in rows)
    assert quality.quality_report(nothing).collect() == [] == quality.keep_good(nothing).collect()
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r["kept"] for r in rows)


def plain_em(votes, rounds=3000):
    """EM document by document, with the same start and prior."""
    share, accuse = quality.GOOD, [[quality.PRIOR[c]] * votes.shape[1] for c in (0, 1)]
    for _ in range(rounds):
        good = []
        for row in votes:
            odds = [1 - share, share]
            for c in (0, 1):
                for r, v in enumerate(row):
                    odds[c] *= accuse[c][r] if v < 0 else 1 - accuse[c][r] if v > 0 else 1
            good.append(odds[1] / (odds[0] + odds[1]))
        weights = [[1 - g for g in good], good]
        old = accuse
        accuse = [[(sum(w for w, row in zip(weights[c], votes) if row[r] < 0) + quality.PSEUDO * quality.PRIOR[c]) / (sum(w for w, row in zip(weights[c], votes) if row[r]) + quality.PSEUDO) for r in range(votes.shape[1])] for c in (0, 1)]
        share = (sum(good) + quality.PSEUDO * quality.GOOD) / (len(good) + quality.PSEUDO)
        if np.abs(np.array(old) - accuse).max() < 1e-9:
            break
    return share, np.array(accuse), good


def votes_by(rng, n, false_alarms, hits=(0.5, 0.4, 0.6, 0.3, 0.7), share=0.85):
    good = rng.random(n) < share
    bad_vote = [rng.random(n) < np.where(good, false_alarms, a) for a in hits]
    return good, np.stack([np.where(x, -1, 1) * (rng.random(n) < 0.9) for x in bad_vote], axis=1)


def test_em_equals_a_plain_one():
    _, votes = votes_by(np.random.default_rng(2), 250, 0.05)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, accuse = quality.fit(patterns, counts.astype(float))
    plain_share, plain_accuse, good = plain_em(votes)
    assert abs(share - plain_share) < 1e-3 and np.abs(accuse - plain_accuse).max() < 1e-3
    assert np.abs(quality.posterior(patterns, share, accuse)[inverse.ravel()] - good).max() < 1e-2


@pytest.mark.parametrize("false_alarms", [0.005, 0.05, 0.15])
def test_em_finds_the_rules_accuracies(false_alarms):
    good, votes = votes_by(np.random.default_rng(5), 20_000, false_alarms)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, accuse = quality.fit(patterns, counts.astype(float))
    assert abs(share - 0.85) < 0.06 and np.abs(accuse[1] - false_alarms).max() < 0.02 and np.abs(accuse[0] - (0.5, 0.4, 0.6, 0.3, 0.7)).max() < 0.15
    kept = quality.posterior(patterns, share, accuse)[inverse.ravel()] >= 0.5
    accused = (votes == -1).any(axis=1)
    best = quality.posterior(patterns, 0.85, np.array([(0.5, 0.4, 0.6, 0.3, 0.7), [false_alarms] * 5]))[inverse.ravel()] >= 0.5
    assert np.mean(kept == best) > 0.96 and np.mean(kept == good) > np.mean(best == good) - 0.01
    assert kept[accused & good].mean() > 0.4  # not the agreement of all rules


def test_quality_agrees_with_labels(spark):
    report = quality.quality_report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("quality", "label")
    rows = report.filter("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = ([r["kept"] for r in rows if r["label"] == v] for v in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_some_accused_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    measured = quality.document_measures(docs).filter(~quality.base_failed()).withColumn("votes", quality.votes_code())
    judged = measured.select("votes").join(quality.qualities(measured.drop("votes")), "votes")
    n = len(quality.rules())
    accused = [r["quality"] for r in judged.collect() if any(r["votes"] // 3**i % 3 == 0 for i in range(n))]
    assert 0 < sum(q >= 0.5 for q in accused) < 0.2 * len(accused)


def test_quality_equals_plain_parts(spark, sf_dir):
    """The query's verdict from votes on plain measures and a plain EM over all documents."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [(i, *quality.measures(t)) for i, t in docs.items()]
    df = spark.createDataFrame(rows, ["doc_id", *quality.COUNTS, *quality.MORE])
    n = len(quality.rules())
    votes = {r["doc_id"]: [r["v"] // 3**i % 3 - 1 for i in range(n)] for r in df.filter(~quality.base_failed()).select("doc_id", quality.votes_code().alias("v")).collect()}
    _, _, good = plain_em(np.array(list(votes.values())))
    kept = {i for i, g in zip(votes, good, strict=True) if g >= 0.5}
    assert {r["doc_id"] for r in Q.op6_quality(spark, sf_dir).collect() if r["kept"]} == kept


# ---- licenses ------------------------------------------------------------------------------------

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_places(text):
    words = FOLDED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return len(words), sorted((i, x.label) for x in licenses.PHRASES for i in range(len(words)) if words[i : i + len(x.phrase.split())] == x.phrase.split())


PARTS = ["GNU", "General", "public", "license", "apache", "MIT", "cc", "by", "-", " ", "\n", "é", ".", "apachelicense", "the", " MIT License "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map(" ".join))
def test_exact_phrases(text):
    flat = licenses.folded(text)
    got = [(flat.count(b" ", 0, at) - 1, label) for at, label in licenses.Scanner().exact(flat)]
    assert (flat.count(b" ") - 1, sorted(got)) == plain_places(text)


def test_fuzzy_notices_survive_edits():
    rng = random.Random(3)
    scanner = licenses.Scanner()
    for notice in licenses.NOTICES:
        for _ in range(12):
            letters = list(notice.phrase)
            for _ in range(notice.errors):
                start = "".join(letters).find(notice.telling)  # the telling words have their own test
                at = rng.choice([i for i in range(len(letters)) if not (notice.telling and start - 1 <= i <= start + len(notice.telling))])
                rng.choice([lambda a: letters.__setitem__(a, "q"), lambda a: letters.pop(a), lambda a: letters.insert(a, "q")])(at)
            found = scanner.fuzzy(f" before it {''.join(letters)} after it ".encode())  # folding could add an edit
            assert any(label == notice.label and n <= notice.errors for _, _, label, n in found), (notice, "".join(letters))
    assert scanner.fuzzy(licenses.folded("plain words about licenses in general and the public at large")) == []


def test_neighbouring_licenses_are_told_apart():
    scanner = licenses.Scanner()

    def labels(text):
        return {x[2] for x in scanner.fuzzy(licenses.folded(text))}

    assert labels("released under the bsd license") == labels("released under the mpl license") == labels("a general public license") == set()
    assert labels("GNU Lesser General Public License") == {"lgpl"} and labels("GNU Affero General Public License") == {"agpl"}
    assert labels("gnu general pablic licence") == labels("gnv general public license") == {"gpl"}
    assert labels("released under the mit licence") == labels("released under the mitt license") == {"mit"}


NOT_THE_LICENSE = {
    "released under the bsd license": set(), "released under the isc license": set(), "released under the gpl license": set(), "released under the zlib license": set(),
    "licensed under gcc by default": set(), "licensed under acc by law": set(), "a general public license": set(), "the new general public licensee": set(),
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": {"lgpl"},
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": {"agpl"},
    "permission is hereby granted free of charge to any person obtaining a copy of the font software": set(),
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software": set(),
    "licensed under the academic free license version 3 0": set(), "licensed under the educational community license version 2 0": set(), "licensed under the artistic license version 2 0": set(),
    "european union public license": set(), "creative commons zero": set(), "apachelike licenses": set(),
}


@pytest.mark.parametrize("text", NOT_THE_LICENSE)
def test_other_licenses_get_no_false_label(text):
    flat = licenses.folded("It was " + text + ", as the file says.")
    scanner = licenses.Scanner()
    assert {x[2] for x in scanner.fuzzy(flat)} == NOT_THE_LICENSE[text]


def test_licenses_own_phrasings():
    scanner = licenses.Scanner()
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software')": {"mit"},
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": {"gpl"},
        "Licensed under the Apache License, Version 2.0": {"apache"}, "Licenced under the Apache Licence, Version 2.0": {"apache"}, "Mozilla Public License": {"mpl"},
        "Redistribution and use in source and binary forms, with or without modification": {"bsd"}, "relesed under the MIT licence": {"mit"},
    }
    for text, labels in texts.items():
        assert {x[2] for x in scanner.fuzzy(licenses.folded(text))} == labels, text


def plain_edits(a, b):
    """Levenshtein's distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def test_fuzzy_spans_are_real_and_complete():
    """Words with notices among them, some spoilt: spans are whole words within the errors, and a place that plain search finds has one."""
    rng, scanner = random.Random(9), licenses.Scanner()
    for notice in licenses.NOTICES:
        for _ in range(4):
            words = [rng.choice("the of software free open work license public".split()) for _ in range(12)]
            words[6:6] = notice.phrase.split()
            letters = list(" ".join(words))
            for _ in range(rng.randrange(notice.errors + 2)):
                letters[rng.randrange(len(letters))] = rng.choice("abcxyz ")
            flat = (" " + " ".join("".join(letters).split()) + " ").encode()
            spans = [x for x in licenses.Scanner(notices=(notice,)).fuzzy(flat)]
            for a, b, label, n in spans:
                assert label == notice.label and flat[a - 1 : a] == b" " == flat[b : b + 1]
                assert plain_edits(flat[a:b], notice.phrase.encode()) == n <= notice.errors
            ends = [i for i, c in enumerate(flat) if c == 32]
            whole = [(a + 1, b) for a in ends for b in ends if abs(b - a - 1 - len(notice.phrase)) <= notice.errors and plain_edits(flat[a + 1 : b], notice.phrase.encode()) <= notice.errors]
            telling = licenses.Telling(notice)
            for a, b in whole:
                if telling.among(flat[a:b]):
                    assert any(x < b and a < y for x, y, _, _ in spans)
    assert scanner.fuzzy(b" ") == []


def test_op9_equals_plain_parts(spark, sf_dir):
    """Base columns by brute force, labels and score from the operator's spans, over the whole table."""
    scanner = licenses.Scanner()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.op9_licenses(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        n, own = plain_places(texts[r["doc_id"]])
        near = scanner.fuzzy(licenses.folded(texts[r["doc_id"]]))
        base = sorted({x for _, x in own})
        score = 1.0 if own else max((1 - e / (b - a) for a, b, _, e in near), default=0.0)
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"])
        assert got == (n, len(own), own[0][0] if own else None, own[-1][0] if own else None, ",".join(base), ",".join(sorted({*base, *(x for _, _, x, _ in near)})))
        assert abs(r["score"] - score) < 1e-9


def test_licenses_awkward(awkward, nothing, awkward_rows):
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["places"]))) for r in licenses.scan_licenses(awkward).collect())
    assert got == Counter((r[0], n, tuple(p)) for r in awkward_rows for n, p in [plain_places(r[1] or "")])
    assert licenses.scan_licenses(nothing).collect() == []


def test_op9_columns(spark, sf_dir):
    for r in Q.op9_licenses(spark, sf_dir).collect():
        assert 0 <= r["score"] <= 1 and (r["n_base"] > 0) == (r["first_word"] is not None)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


# ---- BPE -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(BPE)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_on_documents(spark, sf_dir, library, coder):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert list(coder.coded(texts)) == [expected(library, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.lists(st.sampled_from(["don't", "I'LL", "ΑΣ", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "1234", "½", "…", "aaaaaaa", "日本", " ", "é", "<|"]), max_size=12).map("".join), max_size=5))
def test_bpe_equals_library(library, coder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert list(coder.coded(texts)) == [expected(library, t) for t in texts]


def test_bpe_merges_like_a_plain_loop(coder):
    model, rng = coder.bpe, random.Random(8)
    rank = {int(k): (int(r), int(m)) for k, r, m in zip(model.pairs, model.ranks, model.merged, strict=True)}
    words = ["".join(rng.choice("thernaiou") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    for word, got in zip(words, model.encode_words(words), strict=True):
        symbols = [int(x) for x in model.first[np.frombuffer(word.encode(), np.uint8)]]
        symbols[-1] = int(model.last[word.encode()[-1]])
        while True:
            pairs = [(rank[a << 20 | b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a << 20 | b in rank]
            if not pairs:
                break
            _, i = min(pairs)
            symbols[i : i + 2] = [rank[symbols[i] << 20 | symbols[i + 1]][1]]
        assert got == symbols


def test_long_words_equal_the_library(coder, library):
    rng = random.Random(4)
    texts = ["a" * 700, "ab" * 300, "the" * 150 + "rn" * 40, "".join(rng.choice("etaoinshr") for _ in range(3000)), "日本語" * 100, "x" * 65 + " " + "y" * 64, "aaab" * 50 + "\n" + "-" * 300 + "Z" * 90]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    assert list(coder.coded(texts)) == [expected(library, t) for t in texts]
    assert coder.bpe.rising and not any(len(w) > bpe.LONG for w in coder.new)
    coder.bpe.rising = False  # one merge at a time gives the same
    try:
        assert coder.bpe.encode_words(["ab" * 60, "thern" * 20]) == [library.encode(t).ids for t in ("ab" * 60, "thern" * 20)]
    finally:
        coder.bpe.rising = True


def test_a_megabyte_without_blanks_takes_seconds(coder):
    rng, start = random.Random(1), time.perf_counter()
    texts = ["a" * 1_000_000, "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))]
    assert [n > 0 for n, _, _ in coder.coded(texts)] == [True, True]
    assert time.perf_counter() - start < 60


def test_op10_digests(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: (n, *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))) for i, t in texts.items() for n, ids, decoded in [expected(library, t)]}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in Q.op10_bpe(spark, sf_dir).collect()} == want


def test_bpe_small_memory_gives_the_same(coder):
    texts = ["the cat sat on " + str(i) for i in range(50)]
    assert list(bpe.Coder(BPE, kept=8).coded(texts)) == list(coder.coded(texts))


def test_bpe_awkward(awkward, nothing, awkward_rows, library):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in bpe.encode_decode(awkward, BPE).collect())
    assert got == Counter((r[0], *expected(library, r[1] or "")) for r in awkward_rows)
    assert bpe.encode_decode(nothing, BPE).collect() == []


# ---- HTML ----------------------------------------------------------------------------------------


def test_blocks():
    page = "<p>a&amp;b <b>c</b>d<br>e<p>f</p>tail<ul><li>x<li>y</ul><script>var p='</p>'</script><!-- <p>no</p> --><div class='Ad x'>g"
    assert [(b.path[-1] if b.path else (), b.text) for b in html.page_blocks(page)] == [(("p",), "a&b cd e"), (("p",), "f"), ((), "tail"), (("li",), "x"), (("li",), "y"), (("div", "ad", "x"), "g")]
    assert html.page_blocks("") == [] and [b.text for b in html.page_blocks("1 < 2 & 3")] == ["1 < 2 & 3"]


BROKEN = {"open tags": "<a " * 330_000, "open quotes": "<a href='" * 110_000, "mixed quotes": "<a \"<b '" * 110_000, "declarations": "<!" * 500_000, "comments": "<!--" * 250_000, "deep": "<div>" * 200_000, "items": "<ul><li>" * 120_000, "paragraphs": "<p>x" * 250_000, "ends": "</div>" * 160_000, "scripts": "<script>" * 120_000, "less": "<" * 1_000_000}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_seconds(name):
    start = time.perf_counter()
    html.page_blocks(BROKEN[name])
    assert time.perf_counter() - start < 20


def test_tags_inside_quotes_and_comments():
    page = "<!DOCTYPE html><p title='a > b <i>'>one</p><!-- <p>no</p> --><p>two < three</p><?php echo '>' ?><p>3 <4 <b>five</b></p><!-- open <p>x"
    assert [b.text for b in html.page_blocks(page)] == ["one", "two < three", "' ?>", "3 <4 five"]


def test_pages_without_a_layout(spark):
    rows = [(1, "u", "only words, without any tag."), (2, "u", "<p>"), (3, "u", "<" * 10)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_text(df).collect()} == {1: "only words, without any tag.", 2: "", 3: "<" * 10}


def test_labeller_on_held_out_layouts():
    x, y = html.training_set(4242, 150)
    got = html.trained().main_blocks(x)
    wrong = sum(int((g != (w > 0)).sum()) for g, w in zip(got, y, strict=True))
    assert wrong / sum(map(len, y)) < 0.02


def test_gradients_are_right():
    model = html.Labeller(1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = html.training_set(3, 3)
    xs, mask = html.padded(x)
    labels = np.zeros(mask.shape)
    for i, v in enumerate(y):
        labels[i, : len(v)] = v

    def loss():
        p = 1 / (1 + np.exp(-model.scores(xs, mask)))
        return -(mask * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / mask.sum()

    found = model.gradients(xs, mask, labels)
    for name in ("hf", "hb", "o", "vb"):
        at = np.unravel_index(3, model.w[name].shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-3
        up = loss()
        model.w[name][at] = old - 1e-3
        down = loss()
        model.w[name][at] = old
        assert abs((up - down) / 2e-3 - found[name][at]) < 1e-3 + 0.02 * abs(found[name][at])


def test_pages(spark, sf_dir, nothing):
    tags = re.compile(r"</?(?:p|h1|br)>")
    wrong = []
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in Q.op4_html(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.references.unescape(tags.sub(" ", article).replace("<b>", "").replace("</b>", "")).split())
        wrong += [r["page_id"]] * (r["text"] != want or r["n_chars"] != len(want))
    assert len(wrong) <= 0.01 * len(pages), wrong
    odd = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (3, "v", "<article><p>one two three.</p></article>" * 2000, 3), (None, None, None, None)], "page_id bigint, url string, html string, text int")
    rows = html.extract_text(odd).collect()
    assert len(rows) == 5 and sum(r["text"] == "" for r in rows) == 4
    assert html.extract_text(odd.limit(0)).collect() == []


# ---- mixing --------------------------------------------------------------------------------------


def test_op3_equals_sql(same):
    same(Q.op3_mixing, Q.ORACLE["op3_mixing"])


def shares_of(rows):
    total = sum(r["tokens"] * r["factor"] for r in rows)
    return {v: sum(r["tokens"] * r["factor"] for r in rows if v in (r["source"], r["lang"], r["topic"])) / total for v in {x for r in rows for x in (r["source"], r["lang"], r["topic"])}}


CELLS = "source string, lang string, topic string, tokens bigint"


def test_raking_meets_its_targets(spark):
    cells = [(s, g, t, 100 * (1 + i * j + k)) for i, s in enumerate("abc") for j, g in enumerate("xy") for k, t in enumerate("pq")]
    df = spark.createDataFrame(cells, CELLS)
    rows = mixing.raked(df, targets={"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"x": 0.4, "y": 0.6}}).collect()
    shares = shares_of(rows)
    assert all(abs(shares[v] - w) < 1e-9 for v, w in {"a": 0.2, "b": 0.3, "c": 0.5, "x": 0.4, "y": 0.6}.items()) and rows[0]["residual"] <= mixing.TOLERANCE
    for budget in (0.3, 0.9, 1.0):
        got = mixing.calibrated(mixing.raked(df), budget).collect()
        assert abs(sum(r["tokens"] * r["probability"] for r in got) / sum(r["tokens"] for r in got) - budget) < 1e-9


def test_raking_with_empty_margins(spark):
    """A source without a share takes its own language with it; shares that can't be had are refused."""
    df = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 50), ("b", "z", "p", 70)], CELLS)
    rows = mixing.raked(df, targets={"source": {"a": 1.0}}).collect()
    assert {r["source"]: r["factor"] > 0 for r in rows} == {"a": True, "b": False}
    assert abs(sum(r["tokens"] * r["factor"] for r in rows) - 150) < 1e-6
    with pytest.raises(ValueError, match="have the shares given"):
        mixing.raked(df, targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.05, "z": 0.05}})
    with pytest.raises(ValueError, match="have the shares given"):
        mixing.raked(df, targets={"source": {"c": 1.0}})
    for wrong in ({"source": {"a": 0.5}}, {"source": {"a": 1.5, "b": -0.5}}, {"colour": {"a": 1.0}}):
        with pytest.raises(ValueError, match="margin"):
            mixing.raked(df, targets=wrong) if "colour" in wrong else mixing.raked(df, targets={"margin": wrong["source"]})
    with pytest.raises(ValueError, match="add up to 1"):
        mixing.raked(df, targets={"source": {"a": 0.5}})
    near = mixing.raked(df).collect()  # temperatures that a language in one source alone contradicts
    assert all(r["factor"] > 0 for r in near) and 0 < near[0]["residual"] < 0.2


def test_a_topic_column_is_taken(spark):
    rows = [(i, "w " * (5 + i % 7), "en", f"s{i % 3}", f"topic {i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, topic string")
    found = mixing.mixing(docs, targets={"topic": {"topic 0": 0.25, "topic 1": 0.75}}).collect()
    total = sum(r["n_tokens"] * r["factor"] for r in found)
    assert {r["topic"] for r in found} == {"topic 0", "topic 1"}
    assert abs(sum(r["n_tokens"] * r["factor"] for r in found if r["topic"] == "topic 1") / total - 0.75) < 1e-9


def test_mixing_awkward(awkward, nothing, awkward_rows):
    rows = mixing.mixing(awkward).collect()
    assert len(rows) == len(awkward_rows)
    assert all(not r["sampled"] and r["probability"] == 0 for r in rows if r["n_tokens"] == 0)
    kept = mixing.sample_mix(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r["sampled"] for r in rows)
    assert mixing.mixing(nothing).collect() == [] == mixing.sample_mix(nothing).collect()
