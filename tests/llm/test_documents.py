"""Operators over documents against plain loops, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from palisade.llm import bpe, fingerprints, jaccard_join, packing, quality_classifier, quality_rules
from palisade.llm.queries import BYTE_BPE, WORD_BPE
from tests.llm.conftest import LONG, ODD, PROSE, documents

GAPS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAPS.split(text or "") if w]


def test_rules_measures(odd):
    def plain(text):
        text = text or ""
        own = words(text)
        windows = Counter(tuple(own[k:k + 5]) for k in range(len(own) - 4))
        covered = {k + d for k in range(len(own) - 4) if windows[tuple(own[k:k + 5])] > 1
                   for d in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text),
                len(lines) - len(set(lines)), len(covered))

    got = quality_rules.judged(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words) for r in got) == Counter(
        (i, *plain(t)) for i, t, _ in ODD)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_overlapping_repeats(spark):
    text = " ".join("a b c d e f a b c d e f g h i j k a b c d e".split() + ["z"] * 9)
    row = quality_rules.judged(documents(spark, [(1, text)])).first()
    own = words(text)
    seen = Counter(tuple(own[k:k + 5]) for k in range(len(own) - 4))
    assert row.n_repeat_words == len({k + d for k in range(len(own) - 4)
                                      if seen[tuple(own[k:k + 5])] > 1 for d in range(5)})


def test_rules_hosts(spark):
    """A host whose documents mostly fail is blocked; a lone failure at a clean one is forgiven."""
    good = "Plain words that nobody has to complain about are written in this line number {}."
    bad = "#one $two %three &four *five #six $seven %eight &nine *ten #eleven {}"
    rows = [(k, bad.format(k), "bad") for k in range(90)]
    rows += [(100 + k, good.format(k), "bad") for k in range(10)]
    rows += [(1000 + k, good.format(k), "fine") for k in range(999)] + [(5000, bad.format(1), "fine")]
    got = {r.doc_id: r for r in quality_rules.judged(documents(spark, rows)).collect()}
    assert got[100].host_blocked and not got[100].kept
    assert got[1000].kept and got[5000].kept and not got[5000].host_blocked
    kept = quality_rules.accepted(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert kept.columns == documents(spark, []).columns


def test_fingerprints_edited_text_and_order(spark, odd):
    got = fingerprints.fingerprinted(odd).collect()
    rows = [(i, t or "") for i, t, _ in ODD]
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    numbered = [(i, t) for i, t in rows if i is not None and i not in (6, 8)]
    order = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None]
    texts = {i: [t for j, t in rows if j == i] for i, _ in rows}
    for i, text in numbered:
        half = len(text) // 2
        following = texts[order[(order.index(i) + 1) % len(order)]]
        hashes = {hashlib.sha256((text[:len(text) - half] + f[:half]).encode()).hexdigest()
                  for f in following}
        assert next(r for r in got if r.doc_id == i).edited_sha256 in hashes
    same = {r.fingerprint for r in got if r.doc_id in (6, 7)}
    assert len(same) == 1
    for r in got:
        assert 0 <= r.near_edited <= 1 and len(r.fingerprint) == 32
        a, b = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        assert r.near_edited == pytest.approx(1 - (a ^ b).bit_count() / 128)


def test_radius_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(60)]
    for k in range(200):
        x = base[k % 60]
        for bit in rng.choice(128, k % 7, replace=False):
            x ^= 1 << int(bit)
        base.append(x)
    table = spark.createDataFrame([(f"{x:032x}",) for x in base] + [(None,)], "fingerprint string")
    for radius in (1, 3):
        got = {(r.query, r.fingerprint, r.distance)
               for r in fingerprints.within_radius(table, table, radius).collect()}
        names = set(base)
        assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in names for b in names
                       if a != b and (a ^ b).bit_count() <= radius}


def test_bpe_equals_library(odd):
    library = Tokenizer.from_file(WORD_BPE)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in bpe.encoded(odd, WORD_BPE).collect())

    def plain(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    assert got == Counter((i, *plain(t)) for i, t, _ in ODD)


@pytest.mark.parametrize("text", [
    "Hello WORLD's don't <|endoftext|>x<|startoftext|>", "İstanbul ΑΣΑΣ Σ ǅ ﬁ", "a\x1cb\x85c d\xa0e",
    "日本語 テスト 123 ½ ² Ⅷ 👍🏽 !!!???", "x'ss'LL'Re''t", "ABC" * 3000, "ha" * 500 + "aaaaaaaaaab" * 9])
def test_bpe_odd_texts(text):
    library = Tokenizer.from_file(WORD_BPE)
    ids = library.encode(text, add_special_tokens=False).ids
    (own, decoded), = bpe.loaded(WORD_BPE).encode_batch([text])
    assert np.frombuffer(own, "<u4").tolist() == ids
    assert decoded == library.decode(ids, skip_special_tokens=False) == bpe.decode(own, WORD_BPE)


def test_bpe_memory_decides_nothing(monkeypatch):
    texts = [PROSE + str(k) for k in range(20)]
    first = bpe.WordBpe(WORD_BPE).encode_batch(texts)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    small = bpe.WordBpe(WORD_BPE)
    assert [small.encode_batch([t])[0] for t in texts] == first


def test_packing_covers_every_id(odd):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pieces(odd, BYTE_BPE).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
           for i, t, _ in ODD if i not in (6, 8)}
    for name, own in ids.items():
        parts = sorted((r for r in rows if r.doc_id == name), key=lambda r: r.start)
        at = 0
        for r in parts:
            assert r.start == at and r.length & (r.length - 1) == 0 and r.length <= 1024
            assert zlib.crc32(own[at:at + r.length].tobytes()) == r.ids_crc32
            assert r.doc_tokens == len(own) and r.offset == 0 and 1 << r.bucket == r.length
            at += r.length
        assert at == len(own)
    assert len({r.sequence_id for r in rows}) == len(rows)


@pytest.mark.parametrize("text", [" a", "a ", "a  b", "a \n b", "x\ny z\n", "it's  'd",
                                  "a<|endoftext|>b c", "a\xa0 b", "\x1c a"])
def test_packing_ids_equal_library(text):
    own = packing.loaded(*BYTE_BPE)
    assert own.encode(text) == np.array(
        own.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_refuses_other_lengths(odd):
    with pytest.raises(ValueError):
        packing.pieces(odd, BYTE_BPE, most=1000)


def brute_force_links(rows):
    """Links between different texts, and the smallest id of each text's group."""
    texts = sorted({t or "" for _, t in rows})
    sets = {}
    for t in texts:
        own = words(t)
        k = min(5, len(own))
        sets[t] = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
    near = {t: {u for u in texts if u != t and sets[t] and sets[u]
                and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]) - 1e-9} for t in texts}
    root = {}
    for t in texts:
        group, todo = {t}, [t]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        ids = [i for i, u in rows if (u or "") in group and i is not None]
        root[t] = min(ids) if ids else None
    return near, root


def near_copies():
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(90):
        own = list(base)
        for place in rng.choice(120, k % 6, replace=False):
            own[place] = f"x{rng.integers(0, 9999)}"
        rows.append((100 + k, " ".join(own)))
    rows += [(500 + k, " ".join(f"u{x}" for x in rng.integers(0, 5000, 60))) for k in range(30)]
    return rows + [(900, rows[3][1]), (901, rows[3][1] + " "), (902, "a b c"), (903, "a  b c")]


def test_jaccard_equals_brute_force(spark, monkeypatch):
    rows = near_copies()
    near, root = brute_force_links(rows)
    assert max(map(len, near.values())) > 20
    for chunk in (512, 7):  # one chunk, and many that meet pairwise
        monkeypatch.setattr(jaccard_join, "CHUNK_TEXTS", chunk)
        got = jaccard_join.classes(documents(spark, rows)).collect()
        texts = dict(rows)
        assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {
            (i, root[t], len(near[t])) for i, t in texts.items()}
    kept = jaccard_join.without_copies(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_jaccard_odd_rows(odd):
    got = jaccard_join.classes(odd).collect()
    assert len(got) == len(ODD)
    near, root = brute_force_links([(i, t) for i, t, _ in ODD])
    texts = {i: t for i, t, _ in ODD if i != 8}
    for r in got:
        if r.doc_id is not None and r.doc_id != 8:
            assert (r.class_id, r.n_links) == (root[texts[r.doc_id] or ""],
                                               len(near[texts[r.doc_id] or ""]))
    kept = jaccard_join.without_copies(odd)
    assert kept.columns == odd.columns
    # The text without an id and that of 7 are near that of 6; 8 has two texts.
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 8, 8])


def test_pruning_table():
    for n in (32, 64, 256):
        m = jaccard_join.fewest_matches(0.8, n)
        chance = [sum(math.comb(n + 1, k) * 0.8 ** k * 0.2 ** (n + 1 - k) for k in range(x + 1))
                  for x in (m - 1, m)]
        assert chance[0] < jaccard_join.TOLERANCE <= chance[1]


def test_classifier_keeps_prose_and_drops_junk(spark):
    rng = np.random.default_rng(9)
    vocabulary = "river stone letter evening market garden window morning story winter".split()
    small = "the of and to in is that for with on".split()

    def prose():
        return " ".join(w for k in range(80) for w in (
            small[rng.integers(10)], vocabulary[rng.integers(10)])) + "."

    rows = [(k, prose()) for k in range(300)]
    rows += [(1000 + k, " ".join(w + "&&&" for w in prose().split())) for k in range(40)]
    rows += [(2000 + k, prose().upper().replace(" ", "!! ")) for k in range(20)]
    got = {r.doc_id: r.kept for r in
           quality_classifier.scored(documents(spark, rows)).collect()}
    assert np.mean([got[i] for i in got if i < 1000]) > 0.97
    assert np.mean([got[i] for i in got if i >= 1000]) < 0.1


def test_weak_labels_find_the_bad_heuristic():
    """Each heuristic sees half of the junk; the last one sees little and blames good texts."""
    rng = np.random.default_rng(2)
    patterns, truth = Counter(), {}
    for _ in range(5000):
        good = rng.random() < 0.85
        chance = [0.01] * 7 + [0.15] if good else [0.5] * 7 + [0.1]
        p = "".join("0" if rng.random() < c else "2" for c in chance)
        patterns[p] += 1
        truth.setdefault(p, Counter())[good] += 1
    labels = quality_classifier.WeakLabels(patterns)
    accuracy = labels.accuracy()
    assert min(accuracy, key=accuracy.get) == "marks"
    right = sum(n for p, seen in truth.items() for good, n in seen.items()
                if (labels.posterior[p] > 0.5) == good)
    assert right > 0.93 * 5000  # 0.85 are good


def test_classifier_odd_rows(odd):
    got = quality_classifier.scored(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.accepted(odd).columns == odd.columns


@pytest.mark.parametrize("run", [
    quality_rules.judged, quality_rules.accepted, fingerprints.fingerprinted,
    lambda d: bpe.encoded(d, WORD_BPE), lambda d: packing.pieces(d, BYTE_BPE),
    jaccard_join.classes, jaccard_join.without_copies, quality_classifier.scored,
    quality_classifier.accepted])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_word_hashes_do_not_depend_on_place():
    from palisade.llm.common import shingle_hashes, word_hashes
    assert (word_hashes("ab  cd\nab") == word_hashes(" x ab cd ab")[1:]).all()
    assert len(set(word_hashes(LONG).tolist())) == len(set(LONG.split()))
    assert len(shingle_hashes("a b")) == 1 and len(shingle_hashes("")) == 0
