"""Importance resampling, byte-level BPE and the conversation trie against plain
versions, SQL and an exact round trip, and on edge cases."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pliego.llm")

import __spark_entry__ as entry
from pliego.llm import resample, trie
from pliego.llm.bytebpe import SAFE, bpe_decode, bpe_digests, bpe_encode, encode_text, rank_file, safe_parts, split_pattern
from pliego.llm.common import table
from pliego.llm.resample import Hasher, importance_ranks, resampled_documents
from pliego.llm.trie import conversation_trie
from pliego.sources.tables import TABLES

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@there
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_conversation_trie"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in res.fetchall())


# --------------------------------------------------- importance resampling


def plain_features(text, n):
    words = re.findall(resample.WORD, (text or "").encode().lower().decode())
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_of_long_texts(n, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["Uno", "dos", "ÑANDÚ", "ß9", " ", "  ", "\n", "-", "_", " x", "İ"]) for _ in range(3000))
    words, want = plain_features(text, n)
    monkeypatch.setattr(resample, "PART_BYTES", 50)
    monkeypatch.setattr(resample.parts, "__defaults__", (50,))
    count, got = Hasher(n, 997).features(text.encode())
    assert count == len(words) and Counter(got.tolist()) == Counter(zlib.crc32(f.encode()) % 997 for f in want)


def plain_ranks(docs, target, n, buckets, percent, least, seed):
    s, t = Counter(), Counter()
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in plain_features(text, n)[1])
    feats = []
    for _, text in docs:
        words, own = plain_features(text, n)
        feats.append((len(words), [zlib.crc32(f.encode()) % buckets for f in own]))
        s.update(feats[-1][1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (i, _), (words, own) in zip(docs, feats, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, own))
        rows.append([i, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = math.floor(percent * len(able) / 100)
    return Counter((*r[:4], None) for r in [*able[drawn:], *(r for r in rows if r[4] < least)]) + Counter((*r[:4], k + 1) for k, r in enumerate(able[:drawn]))


@pytest.mark.parametrize("percent", [0, 10, 37, 100])
def test_ranks_by_brute_force(spark, percent):
    """A third of the rows is one repeated row, which the cut of the draw may split."""
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta Ñu öl 7 x".split())
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    docs += [(7, docs[30][1] + " same same same alpha " * 6)] * 100 + [(None, "alpha " * 30), (None, None), (500, None), (501, ""), (502, "alpha beta " * 40_000)]
    target = ["alpha alpha gamma", None, "", "Ñu öl alpha beta"]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, rank int, _u int, _n int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain_ranks(docs, target, 2, 50, percent, 20, 9)
    got = importance_ranks(df, aim, n=2, buckets=50, percent=percent, seed=9).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == want
    drawn = resampled_documents(df, aim, n=2, buckets=50, percent=percent, seed=9)
    assert drawn.columns == df.columns
    assert Counter(r.doc_id for r in drawn.collect()) == sum((Counter({k[0]: v}) for k, v in want.items() if k[4] is not None), Counter())


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    none = docs.filter("false")
    assert importance_ranks(none, docs).count() == resampled_documents(none, docs).count() == 0
    assert importance_ranks(docs, none.select("text")).first().n_features == 40
    assert importance_ranks(none, none).count() == 0


# ---------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    with open(rank_file(), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def plain_ids(text, ranks):
    """Byte-pair merging as its definition has it: the lowest rank first, leftmost."""
    import regex

    out = []
    for m in regex.finditer(split_pattern(), text):
        parts = [bytes([b]) for b in m.group().encode()]
        while len(parts) > 1:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


ODD = ["", " ", "\n\n  \n", "it's 'sall we'll'd I'M", "a1b2 c3!d4 5%6", "日本語の文章。 次の文", "naïve café  x\x1cy\x85z", "<|endoftext|> end", "🙂🙂 👩‍👩‍👧 á", "x" * 500, " " * 300 + "y", "1" * 70 + "a" * 70]


@there
def test_digests_by_brute_force(spark, ranks):
    got = {r.doc_id: r for r in entry.queries()["op12_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = plain_ids(d.text or "", ranks)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@there
def test_round_trip(spark):
    docs = table(spark, SF, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe_decode(bpe_encode(docs))
    assert back.filter(F.col("decoded") != F.col("text").cast("binary")).isEmpty() and back.filter("decoded IS NULL").isEmpty()


def test_parts_at_safe_places(ranks):
    """Cut after every few characters wherever a cut is allowed, ids stay those of the whole text."""
    rng = random.Random(5)
    for text in [*ODD, *("".join(rng.choice(["a", "'s", "'", "9", " ", "\n", "\t", "!", "é", "。", "\x1c", " ", "語"]) for _ in range(400)) for _ in range(60))]:
        assert list(safe_parts(text, 3)) and "".join(safe_parts(text, 3)) == text
        assert encode_text(text, rank_file(), split_pattern(), 3) == plain_ids(text, ranks)
    long = "word 12,tree\n" * 40_000
    assert max(map(len, safe_parts(long))) < 65536 + 20
    assert SAFE.search("don't") is not None and SAFE.search("don't").start() == 3 and not SAFE.search("'sé語")


def test_bpe_edges(spark, ranks):
    rows = [(1, None, "k", 5), (1, None, "k", 5), (2, "", "k", 5), (None, "a b", None, 5), (3, "a " * 100_000, "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = bpe_encode(docs)
    assert got.columns == ["doc_id", "text", "decoded", "ids"] and got.count() == 5
    by = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe_digests(docs).collect())
    empty = hashlib.sha256(b"").hexdigest()
    ids = plain_ids("a " * 10, ranks)
    assert by[(1, 0, empty)] == 2 and by[(2, 0, empty)] == 1 and by[(None, 2, hashlib.sha256(b"a b").hexdigest())] == 1
    assert by[(3, len(ids) + 99_990, hashlib.sha256(b"a " * 100_000).hexdigest())] == 1
    assert bpe_digests(docs.filter("false")).count() == 0
    odd = spark.createDataFrame([(1, [50256]), (2, [1, None]), (3, None), (4, []), (5, [-1]), (6, plain_ids("語", ranks)[:1])], "i int, ids array<int>")
    out = {r.i: r.decoded for r in bpe_decode(odd).collect()}
    assert [out[i] for i in range(1, 6)] == [None, None, None, b"", None] and "語".encode().startswith(bytes(out[6]))
    broken = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytes(bpe_decode(bpe_encode(broken)).first().decoded) == "a�b".encode()


# ---------------------------------------------------------------- the trie


def plain_trie(rows, lead=4, family=20):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    new = {}
    for c, v in said.items():
        h = zlib.crc32(str(c).encode()) % lead
        new[c] = said.get(c - int(math.fmod(c, family)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = set()
    for node, cs in members.items():
        end = ",".join(str(c) for c in sorted(cs) if len(new[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.add((min(cs), len(node), up, len(cs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(end.encode()).hexdigest()))
    return out


def random_rows(rng, convs, depth, width):
    rows = []
    for c in convs:
        for turn in range(rng.randrange(1, depth)):
            text = rng.choice([None, "", "yes", "no  way\tout", "a b c"][:width])
            rows.append((c, rng.choice([turn, turn]) if turn else rng.choice([None, 0]), rng.choice(["user", None, ""]), text))
    return rows


@pytest.mark.parametrize("weight", [65536, 40, 1])
def test_trie_by_brute_force(spark, weight):
    """Weight 1 sends every component through the joins, 40 some of them."""
    rng = random.Random(6)
    rows = random_rows(rng, [*range(-25, 90), 1_000_000_007, 2**53], 7, 5)
    rows += [(c, t, "user", f"hot {t}") for c in range(200, 260) for t in range(4)]  # a group of copies
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, k1 int").repartition(3)
    got = [tuple(r) for r in conversation_trie(df, local_weight=weight).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_one_long_conversation(spark):
    """A conversation over many ranges and blocks, beside one that leaves it half-way."""
    rows = [(0, t, "user", f"turn {t}") for t in range(5000)] + [(20, t, "user", f"turn {t}" if t < 2600 else "other") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in conversation_trie(df, local_weight=2000).collect()}
    assert got == plain_trie(rows)


def test_repeated_turns_and_nothing(spark):
    rows = [(40, 1, "user", "same words here")] * 500 + [(41, None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in conversation_trie(df).collect()} == plain_trie(rows)
    assert conversation_trie(df.filter("false")).count() == 0
    assert conversation_trie(df.filter("conv_id < 0").unionByName(spark.createDataFrame([(None, 1, "user", "x")], df.schema))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_centroids_of_random_forests(seed):
    rng = np.random.default_rng(seed)
    n = 400
    parent = np.array([i if i < 3 else int(rng.integers(max(0, i - 9 if seed % 2 else 0), i)) for i in range(n)])
    depth = np.zeros(n, dtype=np.int64)
    for i in range(3, n):
        depth[i] = depth[parent[i]] + 1
    weight = rng.integers(1, 9, n)
    own = rng.integers(0, 100, (n, 2))
    want = own.copy()
    for i in range(n - 1, 2, -1):
        weight[parent[i]] += weight[i]
        want[parent[i]] += want[i]
    assert np.array_equal(trie.finish(np.arange(n), depth, parent, weight, own, np.zeros((n, 2), dtype=np.int64)), want)
