"""Trie, shards and divergences against plain loops, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm import divergence, prefix_trie, sharding, sql_corpus
from tests.llm.conftest import LONG, ODD, PROSE, documents

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in ("depth", "range", "k1", "words", "top")]])


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], TURNS)


def truncated(c, n):
    return c - int(c / n) * n


def plain_trie(rows):
    """The nodes by dictionaries over whole sequences."""
    def digest(role, text):
        return hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).hexdigest()

    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((-1 if turn is None else turn + 10**6, digest(role or "", text or ""),
                                role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - truncated(c, 20), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * words
    return {(min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
             children[node], leaves[node], saved[node], hashlib.sha256(",".join(
                 str(c) for c in sorted(convs) if full[c] == node).encode()).hexdigest())
            for node, convs in members.items()}


def found_trie(df):
    rows = df.collect()
    assert df.columns == prefix_trie.COLUMNS
    got = {tuple(r[c] for c in prefix_trie.COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def odd_conversations():
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(2)} w " * rng.randrange(3))
            for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(60, t, "user", "same") for t in range(5)] + [(61, None, None, None)] * 2
    rows += [(c, t, "user", "hot first" if t < 3 else f"x{c % 9} {t}") for c in range(80, 160)
             for t in range(5)]
    rows += [(None, 1, "user", "lost"), (200, None, "user", LONG), (200, 3, None, ""),
             (-7, 0, "user", "below"), (-7, 1, "user", "zero"), (3_000_000_000, 1, "a", "b")]
    return rows


@pytest.mark.parametrize("most", [256, 4])
def test_trie_odd_rows(spark, most):
    rows = odd_conversations()
    assert found_trie(prefix_trie.trie(conversations(spark, rows), most)) == plain_trie(rows)


def test_trie_deep_and_hot(spark):
    """A conversation with most of the rows, and copies that end at one node."""
    rows = [(20, t, "user", f"turn {t}") for t in range(900)]
    rows += [(c, t, "user", f"turn {t}") for c in range(40, 100) for t in range(4)]
    rows += [(c, t, "user", f"turn {t}" if t < 3 else f"own {c}") for c in range(100, 160)
             for t in range(4)]
    assert found_trie(prefix_trie.trie(conversations(spark, rows), 50)) == plain_trie(rows)


def test_trie_equals_sql(spark):
    rows = odd_conversations()
    con = duckdb.connect()
    held = conversations(spark, rows).toPandas()
    con.register("held", held)
    con.execute("CREATE VIEW conversations AS SELECT conv_id::bigint AS conv_id, turn::bigint AS"
                " turn, role, text FROM held")
    assert set(con.execute(sql_corpus.prefix_trie()).fetchall()) == plain_trie(rows)


def test_trie_empty(spark):
    assert prefix_trie.trie(conversations(spark, [])).collect() == []


def test_centroid_totals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 60, 500):
        parent = np.array([-1 if k == 0 or rng.random() < 0.05 else
                           (k - 1 if rng.random() < 0.5 else rng.integers(0, k)) for k in range(n)])
        depth = np.zeros(n, np.int64)
        weight, values = np.ones(n, np.int64), rng.integers(0, 9, (n, 2))
        for k in range(n):
            depth[k] = 1 if parent[k] < 0 else depth[parent[k]] + 1
        expected = values.copy()
        for k in range(n - 1, 0, -1):
            if parent[k] >= 0:
                expected[parent[k]] += expected[k]
                weight[parent[k]] += weight[k]
        assert (prefix_trie.centroid_totals(parent, depth, weight, values) == expected).all()


def test_ends_digest_of_many_ids(spark):
    ends = spark.range(0, 40_000).selectExpr("1L AS k1", "id % 2 AS k2", "19999 - id AS conv")
    got = {r.k2: r.ends.hex() for r in prefix_trie.ends_digests(ends.repartition(7)).collect()}
    for k2 in (0, 1):
        ids = ",".join(str(c) for c in range(-20_000, 20_000) if (19999 - c) % 2 == k2)
        assert got[k2] == hashlib.sha256(ids.encode()).hexdigest()


# --- shards -----------------------------------------------------------------------------------

def naive_best_fit(sizes, capacity):
    left = []
    for size in sorted(sizes, reverse=True):
        fitting = [(room, k) for k, room in enumerate(left) if room >= size]
        if fitting:
            left[min(fitting)[1]] -= size
        else:
            left.append(max(capacity, size) - size)
    return left


def test_best_fit_equals_the_naive_one():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randrange(5, 60)
        sizes = [rng.randrange(1, 70) for _ in range(rng.randrange(0, 80))]
        runs = sorted(Counter(sizes).items(), reverse=True)
        fills = sharding.best_fit(runs, capacity)
        used = Counter()
        for size, first, end, number in fills:
            used[number] += size * (end - first)
        assert [f[1] for f in fills] == [0, *[f[2] for f in fills]][:len(fills)]
        assert sum(f[2] - f[1] for f in fills) == len(sizes)
        naive = naive_best_fit(sizes, capacity)
        assert len(used) == len(naive)
        assert sorted(capacity - used[k] if used[k] <= capacity else 0 for k in used) == sorted(naive)


def test_equal_shares():
    rng = random.Random(9)
    sizes = Counter(rng.randrange(9, 3000) for _ in range(5000))
    fills = sharding.equal_shares(sorted(sizes.items(), reverse=True), 24)
    used = Counter()
    for size, first, end, number in fills:
        used[number] += size * (end - first)
    assert set(used) == set(range(24))
    assert max(used.values()) <= 1.001 * sum(used.values()) / 24
    assert min(used.values()) >= 0.99 * sum(used.values()) / 24


def judged_shards(rows, got, shards):
    texts = defaultdict(set)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for r in got:
        texts[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(len(s) == 1 for s in texts.values())  # equal texts share a shard
    for k in range(shards):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


def test_shards_odd_rows(spark, odd, empty):
    judged_shards(ODD, sharding.sharded(odd).collect(), 24)
    assert sharding.sharded(empty).collect() == []


def test_shards_hot_group(spark):
    rows = [(k, "copy " * 40) for k in range(400)] + [
        (1000 + k, f"{k} " * (k % 50 + 1)) for k in range(800)]
    got = sharding.sharded(documents(spark, rows)).collect()
    judged_shards(rows, got, 24)
    used = Counter()
    for r in got:
        used[r.shard] += r.size
    hot = max(used, key=used.get)
    assert used[hot] == 400 * 208  # the group of copies alone
    rest = [n for k, n in used.items() if k != hot]
    assert len(rest) == 23 and max(rest) <= 1.02 * sum(rest) / 23


def test_shards_of_fixed_capacity(spark):
    rows = [(k, "x" * (k * 37 % 91)) for k in range(300)]
    got = sharding.packed(documents(spark, rows), 500).collect()
    used, groups = Counter(), Counter()
    for r in got:
        used[r.shard] += r.size
        groups[r.text_crc32] += r.size
    assert len(used) == len(naive_best_fit(list(groups.values()), 500))


# --- divergences ------------------------------------------------------------------------------

def plain_divergences(rows, min_docs, top):
    """Rows of (text, lang, source) by whole numbers of any size."""
    tokens = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), t or "")), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in tokens}:
        own = [(ts, s) for ts, g, s in tokens if g == lang]
        df = Counter(t for ts, _ in own for t in set(ts))
        kept = [t for t in df if df[t] >= min_docs]
        whole = Counter(t for ts, _ in own for t in ts)
        by = {s: Counter(t for ts, o in own if o == s for t in ts) for _, s in own}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in by.items()}
        for s in by:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode())
                     for o in by if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept
                     if by[s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1)
                        for k, (v, item) in enumerate(ranked)}
    return out


def divergence_rows():
    rng = random.Random(11)
    vocabulary = [*"abcdefg", "Ärger", "eightbyt", "ninebytes", "sixteen_bytes_", "x" * 16, "y" * 17,
                  "é" * 30, "日本語", "straße", "A" * 300, "ΑΣ"]
    rows = [(" ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\x00", "1"])
                      for _ in range(rng.randrange(40))), rng.choice(["en", "de", None]),
             rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(150)]
    return rows + [(None, "fr", "s1"), ("", "fr", "s2"), ("one two", "fr", None),
                   ("q" * 100_000, "en", "s1"), (LONG, "en", "s1"), (PROSE, "it", "s9")] + [
                       ("word " * 50, "en", "hot")] * 100


def test_divergences(spark):
    rows = divergence_rows()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (
        "text", "lang", "source", "term", "n", "p", "item")])
    docs = spark.createDataFrame([(*r, *"abcd") for r in rows], schema).repartition(5)
    got = divergence.audited(docs, top=5).select(
        "lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain_divergences(rows, 3, 5)


def test_divergences_empty(spark, empty):
    assert divergence.audited(empty).collect() == []


def test_counts_in_small_parts(monkeypatch):
    """Parts of a few bytes: texts are cut between terms and counted once for their document."""
    monkeypatch.setattr(divergence, "PART_BYTES", 64)
    texts = ["alpha beta alpha " * 30, "", "z" * 200 + " alpha", "beta", "é" * 50 + " É" * 40]
    batch = pa.RecordBatch.from_arrays([
        pa.array(["l"] * 5), pa.array(["s", "s", "t", "s", "t"]), pa.array(texts)],
        ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in divergence.count_batches(iter([batch])):
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n == {("s", "alpha"): 60, ("s", "beta"): 31, ("t", "z" * 200): 1, ("t", "alpha"): 1,
                 ("t", "é" * 50): 1, ("t", "É"): 40}
    assert docs["s", "alpha"] == 1 and docs["s", "beta"] == 2 and docs["t", "É"] == 1


def test_radix_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) % np.uint64(1 << 40)
    words[::3] = words[0]
    group = rng.integers(0, 5, 3000).astype(np.uint32)
    assert (divergence.radix_order([words, group]) == np.lexsort([words, group])).all()


def test_share_beyond_64_bits(spark):
    big = 9 * 10**17
    row = spark.range(1).selectExpr(f"{big}L AS n", f"{big * 10 - 1}L AS t", "7L AS v").select(
        divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (big * 10 + 6)
