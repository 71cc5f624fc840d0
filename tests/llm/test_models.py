"""Trained operators, url filters and licence scans."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from palisade.llm import components, licenses, pii, toxicity, url_filters
from palisade.llm.char_crf import PAD, Tagger
from palisade.llm.common import table
from tests.llm.conftest import ODD, PROSE, documents


def plain_spans(text):
    """The fixed patterns by the plain regular expressions."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(1)
    parts = ["@", ".", "-", "+", " ", "a", "Z9", "1", "255", "256", "4111 1111 1111 1111", "x.y",
             "user@host.example.com", "1.2.3.4", "+1 (555) 123-4567", "(", ")", "é", "\n", "%_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_are_linear():
    text = "a" * 200_000 + "@ " + "1" * 200_000 + " " + "1." * 100_000 + "x"
    assert [s[2] for s in pii.base_spans(text)] == ["ip"] * 25_000


def test_tagger_gradient():
    rng = np.random.default_rng(4)
    tagger = Tagger(2, hidden=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x, y = rng.integers(1, 90, (4, 6)), np.array([[0, 1, 2, 0, 3, 4]] * 4)
    _, grads = tagger.step(x, y)
    for name in tagger.p:
        places = np.argsort(-np.abs(grads[name]), axis=None)[:3]
        for at in map(tuple, np.transpose(np.unravel_index(places, grads[name].shape))):
            old, losses = tagger.p[name][at], []
            for step in (1e-3, -1e-3):
                tagger.p[name][at] = old + step
                losses.append(tagger.step(x, y)[0])
            tagger.p[name][at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05, abs=2e-3)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fitted(table(spark, "/root/testdata/sf0.1", "documents"))


def test_tagger_on_held_out_texts(spark, tagger):
    """Base spans of other documents are found again by the tagger alone."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    base = [set(pii.base_spans(t)) for t in texts]
    found = [set(s) for s in pii.tagged(tagger, texts)]
    both = sum(len(a & b) for a, b in zip(base, found))
    assert both >= 0.8 * sum(map(len, base)) and both >= 0.8 * sum(map(len, found))


def test_tagger_reads_long_stretches(tagger):
    text = "call +1 (269) 555-3296 now " * 40
    base, spans = pii.all_spans(tagger, [text])[0]
    assert len(base) == 40 and set(base) <= set(spans)
    assert pii.tagged(tagger, ["1" * 20_000])[0] is not None


def test_disguised_addresses_without_digit_or_at_sign(tagger):
    """Spelled-out at signs and dots are read in prose that holds neither a digit nor '@'."""
    forms = ["jane.doe (at) mail.example.org", "mary.smith(at)mail.example.com",
             "bob.jones [at] mail.example.net", "tom.brown at mail.example.com",
             "jonathan.alexander.featherstonehaugh (at) mail.engineering.example.org",
             "ann.lee at mail dot example dot com"]
    texts = [f"{PROSE} Please write to {f} for more. {PROSE}" for f in forms]
    for form, text, (base, spans) in zip(forms, texts, pii.all_spans(tagger, texts)):
        assert base == [] and [text[a:b] for a, b, _ in spans] == [form]
        assert form not in pii.cleaned(text, spans) and "[EMAIL]" in pii.cleaned(text, spans)
    plain = PROSE * 5 + "They met at dawn. He looked at it. A dot on the map, at best. "
    assert pii.all_spans(tagger, [plain]) == [([], [])]
    assert pii.stretches("at." * 50_000) == [(0, 150_000)]


def test_scan_and_redaction(spark, odd):
    rows = [(k, f"{PROSE} mail joe.{k}@mail.example.com or 10.0.0.{k} {PROSE}") for k in range(60)]
    docs = documents(spark, rows).union(odd)
    got = pii.scanned(docs).collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        if r.doc_id is not None and r.doc_id < len(rows) and r.n_email:
            spans = plain_spans(dict(rows)[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
            assert set(pii.listed(spans).split(",")) <= set(r.spans.split(","))
    clean = pii.redacted(docs)
    assert clean.schema == docs.schema
    texts = [r.text for r in clean.collect()]
    assert sum("[EMAIL]" in (t or "") for t in texts) == 60 and None in texts
    assert not any("@mail.example" in (t or "") for t in texts)


def test_cleaned_joins_overlaps():
    assert pii.cleaned("ab 12345 cd", [(3, 6, "card"), (5, 8, "phone"), (9, 11, "ip")]) \
        == "ab [CARD] [IP]"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_toxicity_on_held_out_thirds(spark):
    rng = np.random.default_rng(6)
    syllables = "ba ke li mo nu ra se ti vo zu".split()
    bad = ["grumblefax", "snorkwit", "blatherpox"]
    rows, marks = [], []
    for k in range(900):
        own = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60)]
        if k % 8 == 0:
            for place in rng.choice(60, 4, replace=False):
                own[place] = bad[rng.integers(3)]
        rows.append((k, " ".join(own)))
        marks.append((k, 1, int(k % 8 == 0), "x"))
    got = toxicity.scored(documents(spark, rows), labels(spark, marks)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.predicted == int(r.score >= 0.7) for r in got) and len(held) > 200
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) > 0.97
    # Labels of the held-out third are never looked at.
    fold = {r.doc_id for r in held}
    turned = [(i, q, 1 - t if i in fold else t, x) for i, q, t, x in marks]
    again = toxicity.scored(documents(spark, rows), labels(spark, turned)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in got}


def plain_ratios(counts):
    """Ratios of words from {word: (ordinary, toxic)} by dictionaries over byte strings."""
    def grams(word):
        raw = [0] * 5 + list(f" {word} ".encode())
        return [bytes(raw[k:k + 6]) for k in range(1, len(raw) - 5)]

    top = {}
    for word, (n0, n1) in counts.items():
        for g in grams(word):
            a = top.setdefault(g, [0, 0])
            a[0], a[1] = a[0] + n0, a[1] + n1
    seen = [g for g, (n0, n1) in top.items() if n0 + n1]

    def lower(g, order):
        if not order:
            return 1 / 256
        below = lower(g, {4: 2, 2: 0}[order])
        ends = [x[-order:] for x in seen]
        near = [e for e in ends if e[:-1] == g[-order:-1]]
        if not near:
            return below
        n = ends.count(g[-order:])
        return (max(n - 0.75, 0) + 0.75 * len(set(near)) * below) / len(near)

    out = {}
    for word in counts:
        out[word] = 0.0
        for g in grams(word):
            near = [top[x] for x in seen if x[:-1] == g[:-1]]
            t0, t1 = sum(x[0] for x in near), sum(x[1] for x in near)
            c0, c1 = top[g]
            p = lower(g, 4)
            if t0 + t1:
                p = (max(c0 + c1 - 0.75, 0) + 0.75 * len(near) * p) / (t0 + t1)
            out[word] += np.log((c1 + 0.5) / (t1 * p + 0.5) / ((c0 + 0.5) / (t0 * p + 0.5)))
    return out


def test_toxicity_ratios_equal_dictionaries(spark):
    counts = {"vile": (1, 9), "vilest": (0, 3), "evil": (4, 4), "mild": (20, 1), "milder": (6, 0),
              "wild": (0, 0), "aaaaaaaaaa": (2, 1), "日本": (3, 2), "q" * 200: (0, 2), "x": (9, 1)}
    rows = [(k, toxicity.name_of(w), w, a + b, a, b, 0, 0)
            for k, (w, (a, b)) in enumerate(counts.items())]
    words = spark.createDataFrame(
        rows, "id long, name string, word string, " + ", ".join(f"{n} long" for n in toxicity.COUNTS))
    got = {r["name"]: r for r in toxicity.word_ratios(words, toxicity.strings(words)).collect()}
    for word, ratio in plain_ratios(counts).items():
        row = got[toxicity.name_of(word)]
        assert row.whole == row.part and row.whole / toxicity.UNIT == pytest.approx(ratio, abs=1e-6)


def test_toxicity_words_by_either_way(spark):
    """Words that are joined count as those that every task has."""
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for k in range(120):
        own = [f"w{rng.integers(40)}" for _ in range(30)] + ["y" * 90] * (k % 3)
        rows.append((k, " ".join(own + ["grumblefax"] * (k % 4 == 0))))
        marks.append((k, 1, int(k % 4 == 0), "x"))
    rows += [(7, rows[7][1]), (None, rows[4][1]), (500, None)]
    docs = documents(spark, rows)
    all_joined, some, none = ([tuple(r) for r in sorted(toxicity.scored(
        docs, labels(spark, marks), common_words=n).collect(), key=str)] for n in (0, 30, 10**6))
    assert all_joined == some == none and len(some) == len(rows)


def test_toxicity_odd_rows(spark, odd, empty):
    marks = labels(spark, [(1, 1, None, ""), (2, 1, 0, ""), (2, 1, 1, ""), (6, 1, 0, ""),
                           (None, 1, 1, ""), (4, 1, 1, ""), (7, 1, 0, "")])
    got = toxicity.scored(odd, marks).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.scored(empty, labels(spark, [])).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, node string")


def canonical(url):
    return f'<head><LINK href="{url}" data-x=1 rel="canonical"></head>'


def refresh(url):
    return f"<meta http-equiv='refresh' content='0; url={url}'>"


def test_url_rules_and_aliases(spark):
    rules = {"bad.com/": "block", "good.bad.com/": "allow", "x.net/a": "block", "x.net/ab": "allow"}
    rows = [
        (1, "http://BAD.com/x", "", "r", "n"), (2, "https://sub.bad.com/y?q=1#z", None, "", ""),
        (3, "http://good.bad.com/", "", "", ""), (4, "http://notbad.com/x", "", "", ""),
        (5, "http://x.net/abc", "", "", ""), (6, "http://x.net/acb", "", "", ""),
        # 7 -> 8 -> 9 (blocked); 10 leads to an allowed page too, so its group is allowed.
        (7, "http://one.org/p", canonical("http://two.org/q/"), "", ""),
        (8, "https://two.org/q?utm_source=f", refresh("//bad.com/w"), "", ""),
        (9, "http://bad.com/w#top", "", "", ""),
        (10, "http://three.org/p", canonical("http://bad.com/v"), "", ""),
        (11, "http://bad.com/v", canonical("/v2"), "", ""), (12, "http://bad.com/v2", "", "", ""),
        (13, "http://three.org/p/", refresh("http://good.bad.com/k"), "", ""),
        (14, "http://good.bad.com/k", "", "", ""),
        (15, None, canonical("http://bad.com/w"), "", ""), (16, "no host", None, "", ""),
        (7, "http://one.org/p", canonical("http://two.org/q/"), "", ""), (None, "a://B:8/c?d", "", "", ""),
    ]
    got = [r.asDict() for r in url_filters.judged(pages(spark, rows), rules).collect()]
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    verdicts = {i: r["verdict"] for i, r in by.items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block",
                        7: "block", 8: "block", 9: "block", 10: "allow", 11: "block", 12: "block",
                        13: "allow", 14: "allow", 15: "allow", 16: "allow", None: "allow"}
    assert (by[2]["host"], by[2]["path"], by[2]["rule"]) == ("sub.bad.com", "/y", "bad.com/")
    assert by[5]["rule"] == "x.net/ab" and (by[15]["host"], by[16]["path"]) == ("", "")
    assert (by[None]["host"], by[None]["path"]) == ("b:8", "/c")
    assert url_filters.judged(pages(spark, []), rules).collect() == []


def test_url_relative_targets(spark):
    """Relative refreshes and canonical links lead to a blocked page as absolute ones do."""
    to = {1: "new.html", 2: "../x", 3: "?id=2", 4: "./c/../../y", 5: "z.html", 6: "sub/?u=http://k.l/",
          7: "../up", 8: "/r/./s/..", 9: "#top", 10: "mailto:a.b", 11: "http://e.org/?url=b"}
    ends = {1: "one.org/a/new.html", 2: "two.org/x", 3: "three.org/p?id=2", 4: "four.org/a/y",
            5: "other.org/d/z.html", 6: "six.org/sub/?u=http://k.l/", 7: "seven.org/b/up",
            8: "eight.org/r/", 11: "e.org/?url=b"}
    bases = {5: "<base href='http://other.org/d/'>", 7: '<BASE target="t" HREF="b/c/">'}
    at = {1: "http://one.org/a/old.html", 2: "http://two.org/q/r", 3: "http://three.org/p?id=1",
          4: "http://four.org/a/b/", 5: "http://five.org/p", 6: "https://six.org",
          7: "http://seven.org/k", 8: "http://eight.org/k", 9: "http://nine.org/p?q=1",
          10: "http://ten.org/p", 11: "http://eleven.org/p/b"}
    rows = [(k, u, bases.get(k, "") + (canonical if k % 2 else refresh)(to[k]), "", "")
            for k, u in at.items()]
    rows += [(100 + k, f"https://{e}", None, "", "") for k, e in ends.items()]
    rows += [(200, "http://eleven.org/p/c", refresh("http://e.org/?url=b"), "", "")]
    rules = {e.split("?")[0]: "block" for e in ends.values()}
    got = {r.page_id: r for r in url_filters.judged(pages(spark, rows), rules).collect()}
    for k in at:
        assert got[k].verdict == ("block" if k in ends else "allow"), k
        if k in ends:
            assert got[k].alias_group == got[100 + k].alias_group, k
    assert got[9].alias_group == "nine.org/p?q=1" and got[10].alias_group == "ten.org/p"
    assert got[200].alias_group == got[111].alias_group


def test_components_of_chains_hubs_and_cycles(spark):
    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(1000, 1060)]
    edges += [(0, int(k)) for k in range(1, 200)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    edges += [(int(a), int(b)) for a, b in rng.integers(2000, 2060, (40, 2))] + [(None, 3), (9000, 9000)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_components_of_long_chains_in_any_order(spark):
    """Long chains whose names are shuffled, or in order, settle in few levels."""
    names = np.random.default_rng(12).permutation(5001).tolist()
    edges = list(zip(names, names[1:])) + [(k, k + 1) for k in range(10_000, 12_000)]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(5001), 0), **dict.fromkeys(range(10_000, 12_001), 10_000)}


INDEX = licenses.Index(licenses.TEMPLATES)


def test_licences_that_differ_by_a_word():
    for text, name in {
            "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
            "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
            "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
            "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
            "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 2.0.": None,
            "Licensed under the Apache License, Version 1.1": "Apache-1.1",
            "Licensed under the Apache License, Version 1.0": None,
            "Released under the GNU Library General Public License, version 3": None,
            "Licensed under the BSD 4-Clause License.": None,
            "Distributed under the Mozilla Public License, version 2.0": "MPL-2.0",
            licenses.license_texts.TEXTS["GPL-3.0"][0]: "GPL-3.0",
            licenses.license_texts.TEXTS["BSD-3-Clause"][0]: "BSD-3-Clause",
            licenses.license_texts.TEXTS["BSD-2-Clause"][0]: "BSD-2-Clause"}.items():
        found = [m[2] for m in licenses.matches(PROSE + text + " " + PROSE, INDEX)]
        assert found == ([name] if name else []), (text, found)


def full_alignment(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, w in enumerate(a):
        for j, v in enumerate(b):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j],
                                     best[i, j] + 1 if w == v else 0)
    return best[-1, -1]


def test_licences_against_full_alignment():
    """Every template is found whole; edited ones cover what an unbanded alignment covers."""
    rng = np.random.default_rng(10)
    for k, (name, template) in enumerate(sorted(licenses.TEMPLATES.items())):
        words, name = template.split(), name.partition("/")[0]
        free = [i for i, w in enumerate(words) if not any(
            licenses.decides(x) for x in licenses._WORD.findall(w.lower()))]
        for edits in (0, len(words) // 12):
            if len(words) < 24 and k % 7 or len(free) < edits:
                continue
            own = list(words)
            for place in rng.choice(free, edits, replace=False):
                own[place] = "edited"
            text = "é " + PROSE * 2 + " ".join(own) + " " + PROSE
            found = licenses.matches(text, INDEX)
            assert [m[2] for m in found] == [name], (template, found)
            (start, end, _, coverage), = found
            a = licenses._WORD.findall(template.lower())
            inside = licenses._WORD.findall(text[start:end].lower())
            n = full_alignment(a, licenses._WORD.findall(text.lower()))
            assert full_alignment(a, inside) >= n - 2
            assert abs(coverage - n / (len(a) + len(inside) - n)) < 0.1


def test_an_edited_copy_before_an_exact_one():
    whole = licenses.license_texts.TEXTS["ISC"][0]
    edited = whole.replace("any purpose", "each aim").replace("hereby", "herewith")
    found = licenses.matches(edited + " " + whole + " " + edited, INDEX)
    assert [m[2] for m in found] == ["ISC"] * 3 and found[1][3] == 1.0 > found[0][3]


def test_unmatched_against_counts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (["abcd"[k] for k in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        left, right = licenses.unmatched(a, b)
        assert len(a) - len(left) == len(b) - len(right) == full_alignment(a, b)
        assert [w for k, w in enumerate(a) if k not in left] == [
            w for k, w in enumerate(b) if k not in right]


def test_licences_odd_rows(spark, odd, empty):
    rows = [(50, PROSE * 200 + "Released under the MIT License.\n"
             "This work is licensed under the GNU General Public License, version 3."),
            (51, "licensed under nothing at all, version 3")]
    got = {r.doc_id: r for r in licenses.scanned(documents(spark, rows).union(odd)).collect()}
    assert got[50].n_matches == 2 and got[50].coverage == 1.0 and got[50].license == "GPL-3.0"
    assert (got[51].n_matches, got[51].license, got[51].spans) == (0, None, "")
    assert Counter(r.doc_id for r in licenses.scanned(odd).collect()) == Counter(i for i, *_ in ODD)
    assert licenses.scanned(empty).collect() == []


def test_pii_empty_table(empty):
    assert pii.scanned(empty).collect() == [] and pii.redacted(empty).collect() == []
    assert PAD == 0


def test_pipeline_stages(spark, sf_dir):
    """Stages return the columns of documents; decisions take effect one after the other."""
    docs = start = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "n-gram Jaccard join", "personal data",
                     "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == start.columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > counts[0] // 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {
        r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_on_an_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_pii_held_out_disguises(tagger):
    """Forms, names and endings that no training window holds are found whole; prose is left alone."""
    before, after = "As he wrote in the spring, please write to ", " before the end of the week."
    names = ["kate", "j.smith", "maria.lopez", "bob", "info", "tim_miller"]
    domains = ["school.edu", "uni.se", "work.example.ch", "mail.shop.nl", "bank.at"]
    signs = ["{at}", " (AT) ", "<at>", " [AT] ", " at ", "_at_", "(a)", " @ "]
    caught = total = 0
    for i, name in enumerate(names):
        for j, domain in enumerate(domains):
            for sign in signs[(i + j) % 2::2]:
                own = name + sign + domain
                text = before + own + after
                found = [text[a:b] for a, b, k in pii.all_spans(tagger, [text])[0][1]]
                total += 1
                caught += own in found
                assert all(own in f or f in own for f in found if "@" not in f), (own, found)
    assert caught >= 0.9 * total, (caught, total)
    numbers = ["269 555 3296", "(269) 555-3296", "269-555-3296", "0269 555 3296"]
    for number in numbers:
        text = before.replace("write to", "call") + number + after
        assert (text.index(number), text.index(number) + len(number), "phone") in pii.all_spans(
            tagger, [text])[0][1], number
    text = "We met at noon. At two we left. Look at that. Then dot the page, version 10.0.0.300 of it."
    assert pii.all_spans(tagger, [text])[0][1] == []
