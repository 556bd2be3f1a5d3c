"""Each operator against SQL, a brute-force version, an exact round trip or
held-out labels, on the small tables."""

import html as entities
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pliego.llm")

import __spark_entry__ as entry
from pliego.llm.covertree import build_tree, cover, descend, embedding_links, leaf_pairs
from pliego.llm.features import normal_word
from pliego.llm.htmltext import main_text
from pliego.llm.linededup import spread_lines
from pliego.llm.mixing import DOMAINS, fit_rates, posteriors
from pliego.llm.packing import plan, places, token_ids, vocabulary
from pliego.llm.simhash import fingerprint, near_edges, segments, simhash_components
from pliego.llm.urlrules import Rule, index, judge_urls
from pliego.sources.tables import TABLES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_quality_rules", "op3_url_filters"])
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


# ------------------------------------------------------------------ SimHash


def test_fingerprint_by_hand():
    import xxhash

    text = "Uno DOS tres Ñu\tcinco\x0bseis"
    words = ["uno", "dos", "tres", "Ñu", "cinco", "seis"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(3)]
    want = sum((sum(h >> b & 1 for h in hashes) * 2 > 3) << b for b in range(64))
    assert fingerprint(text) == want
    assert fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42) and fingerprint(None) == fingerprint(" \n") == 0


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5])
def test_one_segment_differs_by_at_most_one_bit(bits):
    rng = np.random.default_rng(1)
    cuts = segments(bits)
    assert sum(w for _, w in cuts) == 64
    for _ in range(2000):
        x = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
        assert min(bin(x >> at & (1 << w) - 1).count("1") for at, w in cuts) <= 1


@pytest.mark.parametrize("block", [32768, 3])
def test_simhash_components_by_brute_force(spark, block):
    """Chains, dense groups and far fingerprints; block 3 sends every key through the pairs of blocks."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(map(int, rng.integers(0, 2**63, 80, dtype=np.uint64)))
    for b in base:
        x = int(b)
        for _ in range(12):
            for k in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    a = np.array(fps, dtype=np.uint64)
    root = union_find(len(fps), [(i, int(j) + i + 1) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4)])
    df = spark.createDataFrame([(int(v),) for v in a.view(np.int64)], "fp long")
    at = {int(v): i for i, v in enumerate(a.view(np.int64))}
    edges = [(at[r.a], at[r.b]) for r in near_edges(df, 4, block).collect()]
    assert union_find(len(fps), edges) == root


def test_simhash_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    a = np.array([fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    root = union_find(len(ids), [(i, int(j) + i + 1) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4)])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect()}
    assert got == {i: (f"{int(f):016x}", ids[r]) for i, f, r in zip(ids, a, root, strict=True)}


# --------------------------------------------------------------- embeddings


@pytest.mark.parametrize("block", [4096, 40])
def test_embedding_links_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    near = [c + rng.normal(0, s, (n, 16)) for c, s, n in zip(rng.normal(0, 1, (9, 16)), [0.02, 0.1, 0.2, 0.25, 0.3, 0.1, 0.05, 0.2, 0.15], [60, 30, 30, 30, 30, 5, 2, 20, 90], strict=True)]
    x = np.concatenate([*near, rng.normal(0, 1, (60, 16))])
    x = np.concatenate([x, x[:50], 3 * x[50:80]])  # copies, and copies of another length
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = union_find(len(x), [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(link[i])])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_links(df, block=block).collect()}
    assert got == {i: (int(link[i].sum()), root[i], root[i] == i) for i in range(len(x))}


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(0, 0.05, (30, 8)) for c in rng.normal(0, 1, (20, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root, _ = build_tree(x[::3], 24)
    pivots = x[::3]
    leaf, gap = descend(root, pivots, x)
    cover(root, pivots, {int(k): float(gap[leaf == k].max()) for k in set(leaf)})
    pairs = set(leaf_pairs(root, pivots, 0.3))
    assert len(set(leaf)) > 10 and len(pairs) < len(set(leaf)) * (len(set(leaf)) + 1) / 2
    for i in range(len(x)):
        for j in np.flatnonzero(np.linalg.norm(x[i + 1 :] - x[i], axis=1) <= 0.3) + i + 1:
            assert (min(leaf[i], leaf[j]), max(leaf[i], leaf[j])) in pairs


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1 - 1e-12])
def test_embedding_links_at_other_thresholds(spark, threshold):
    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.normal(0, s, (40, 8)) for c, s in zip(rng.normal(0, 1, (6, 8)), [0.01, 0.1, 0.3, 0.5, 0.02, 0.2], strict=True)])
    x = np.concatenate([x, 2 * x[:20]])  # the same directions
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= threshold
    np.fill_diagonal(link, False)
    root = union_find(len(x), [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(link[i])])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df, threshold=threshold, block=64).collect()}
    assert got == {i: (int(link[i].sum()), root[i]) for i in range(len(x))}


def test_clustered_vectors_are_pruned_at_any_size(spark):
    """A tenth of all pairs is not looked at, below one block and beyond it; links of a
    tight cluster need no comparison of its vectors."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (30, 16))
    for each in (20, 100):
        x = np.concatenate([c + rng.normal(0, 0.03, (each, 16)) for c in centres])
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        report = {}
        got = embedding_links(df, block=512, report=report).collect()
        assert all((r.n_links, r.component_id) == (each - 1, r.vec_id // each * each) for r in got)
        assert report["knots"] < len(x) / 5 and report["knot_pairs"] + report["vector_pairs"] < len(x) ** 2 / 20


def test_an_id_with_several_vectors_is_one_node(spark):
    east, north = [1.0, 0.0], [0.0, 1.0]
    rows = [(5, east), (5, north), (7, [1.0, 0.01]), (9, [0.01, 1.0]), (3, [-1.0, 0.0])]
    got = {r.vec_id: r.component_id for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 3: 3}


def test_registered_links_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    root = union_find(len(x), [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(link[i])])
    got = {r.vec_id: (r.n_links, r.component_id) for r in entry.queries()["op6_cover_tree_links"](spark, SF).collect()}
    assert got == {int(ids[i]): (int(link[i].sum()), min(int(ids[j]) for j in range(len(x)) if root[j] == root[i])) for i in range(len(x))}


# ------------------------------------------------------------------ packing


def test_ids_equal_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(400).collect()]
    texts += ["", " ", "a<|endoftext|>b", "   x́ \U0001f600‍ 123 4567890 don't  \n\n\t x", "é" * 500, "\r\n \x85  y", "漢字かな交じり文"]
    for text in texts:
        assert token_ids(text, vocabulary()).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_packing_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op7_pattern_packing"](spark, SF).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, parts in by_doc.items():
        ids, at = token_ids(docs[i], vocabulary()), 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_seq) <= 1.005 * -(-total // 2048) + 1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(129, dtype=np.int64)
    for v in rng.integers(1, 129, 3000) if seed else []:
        hist[v] += 1
    sequences = plan(hist, 128)
    used = Counter()
    for lengths, n in sequences:
        assert n > 0 and sum(lengths) <= 128
        for v in lengths:
            used[v] += n
    assert used == Counter({v: int(n) for v, n in enumerate(hist) if n})
    assert len(places(sequences)) == sum(len(set(x)) for x, _ in sequences)


# ------------------------------------------------------- sharding and mixing


def test_shards_have_equal_bytes(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = entry.queries()["op5_kd_tree_sharding"](spark, "/root/testdata/sf0.1").collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 24
    assert max(abs(v - mean) for v in sizes.values()) <= 0.01 * mean + max(r.size for r in rows) / 2


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(5)
    t = rng.integers(1, 500, 400)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    have = (t[:, None] * p).sum(0)
    want = np.array([0.9, 0.3, 0.05]) * have
    m = (p * t[:, None]).T @ p
    r = np.ones(400)
    for _ in range(500):
        r = np.maximum(0, r - p @ np.linalg.solve(m, p.T @ (t * r) - want))
    rows = spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(t, p, strict=True))], "i int, tokens long, p array<double>")
    got = np.array([x.rate for x in fit_rates(rows, list(want), rounds=200, tolerance=1e-9).orderBy("i").collect()])
    assert (got >= 0).all() and np.abs(p.T @ (t * got) - want).max() < 1e-3 * want.sum()
    assert np.abs(got - r).max() < 1e-2
    low = fit_rates(rows, list(want), lower=(F.col("p")[0] > 0.5).cast("double")).collect()
    assert all(x.rate >= 1 for x in low if x.p[0] > 0.5)


# ------------------------------------------------------------- other checks


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op8_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good])
    assert auc > 0.95
    assert sum(s >= 0.3 for s in bad) > 0.8 * len(bad) and sum(s >= 0.3 for s in good) < 0.03 * len(good)
    assert normal_word("m0r0n!!") == ("moron", True) and normal_word("Moron.") == ("moron", False)


def test_held_out_domains_with_quoted_and_disguised_words(spark):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("ta", "re", "mi", "so", "lu") for b in ("nder", "lit", "vop", "kans", "ger", "mel")]
    toxic = ["bronkel", "zorgulon", "vikkarim"]
    shapes = {"plain": " {} ", "quoted": '"{}"', "bracket": "({})", "tab": "\t{}\t", "capitals": "{}!"}

    def doc(words):
        out = [str(w) for w in rng.choice(plain, 40)]
        for w in words:
            out.insert(int(rng.integers(1, 40)), w)
        return " ".join(out)

    def shaped(kind):
        words = [str(w) for w in rng.choice(toxic, 3)]
        if kind == "disguised":
            return [w.replace("o", "0").replace("i", "!") for w in words]
        if kind == "drawn out":
            return [w.replace("o", "ooo").replace("i", "iii") for w in words]
        return [shapes[kind].format(w) for w in words]

    rows, marks = [], []
    for i in range(240):
        rows.append((i, doc(shaped("plain") if i % 3 == 2 else []), "labelled", i % 3))
        marks.append((i, int(i % 3 != 1), int(i % 3 == 2)))
    kinds = [*shapes, "disguised", "drawn out"]
    rows += [(1000 + i, doc(shaped(kinds[i % len(kinds)])), kinds[i % len(kinds)], 2) for i in range(20 * len(kinds))]
    rows += [(5000 + i, doc([]), "none", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, d int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = Counter()
    for r in posteriors(docs, labels, "text", "doc_id", ["doc_id", "kind"]).collect():
        found[r.kind, DOMAINS[int(np.argmax(r.p))] == "toxic"] += 1
    assert found["none", True] == 0
    for kind in kinds:
        assert found[kind, True] >= 18, (kind, found)


def test_main_text_of_the_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert main_text(r.html) == want


PAGES = [
    ("<body><div id=menu><a>x</a></div><div class='content has-sidebar'><h2>T</h2><p>Long text of the page, it goes on and on.<p>Short.<ul><li>one<li>two</ul></div><section class=comments><p>Nice one, thanks a lot for it!</section>", "T Long text of the page, it goes on and on. Short. one two"),
    ("<main><header><h1>Title</h1></header><p>Body &lt;b&gt; &eacute;.</p><form><p>Name</p><input></form><aside>Also</aside></main><footer>f</footer>", "Title Body <b> é."),
    ("<title>t</title><style>p{}</style><p>One <b>bold</b>word<br>next</p><script>if (a < b) '</p>'</script><!-- <p>no</p> --><p>two</p>", "One boldword next two"),
    ("<div class='cookie-notice'>We use cookies on this site to do things.</div><article><p>A</p><div class='ad'>Buy</div><p>B</p></article>", "A B"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text_of_other_layouts(html, text):
    assert main_text(html) == text


LEAD, STORY = "A lead of some words.", "A story of words that goes on. " * 60
STEPS = [f"Step {i} of the list, in a few words" for i in range(100)]
BESIDE = [
    (f"<body><div class=lead><p>{LEAD}</p></div><div class=story><p>{STORY}</p></div>", [LEAD, STORY]),
    (f"<body><div class=intro><p>{STORY}</p></div><div class=steps><ul>{''.join(f'<li>{x}</li>' for x in STEPS)}</ul></div>", [STORY, *STEPS]),
    (f"<table><tr><td><p>{STORY}</p></td><td>{LEAD}</td></tr><tr><td>x1</td><td>x2</td></tr></table>", [STORY, LEAD, "x1 x2"]),
    (f"<article><p>{STORY}</p></article><article><p>{LEAD}</p></article>", [STORY, LEAD]),
    (f"<article><p>{STORY}</p></article><div class=steps>{''.join(f'<p>{x}</p>' for x in STEPS)}</div>", [STORY, *STEPS]),
    (f"<body><div><a href=a>Home</a></div><div><a href=b>News</a></div><div><p>{STORY}</p><p>{STORY}</p><p>{STORY}</p></div>", [STORY] * 3),
]


@pytest.mark.parametrize("html, blocks", BESIDE)
def test_main_text_of_blocks_beside_each_other(html, blocks):
    assert main_text(html) == " ".join(" ".join(blocks).split())


def test_line_spread_is_exact_near_the_threshold(spark):
    rows = [(h, f"s{k}") for h in range(40) for k in range(h) for _ in range(2)]
    df = spark.createDataFrame(rows, "h long, site string")
    for lg_k in (4, 10):
        assert {r.h for r in spread_lines(df, 5, lg_k).collect()} == set(range(5, 40))


def test_rules_are_fetched_by_their_rarest_token(spark):
    rules = (Rule("block", regex=r"cheap-pills", literals=("cheap", "pills")), Rule("block", regex=r"^ads\.", literals=("ads",)), Rule("block", regex="x{3}"))
    by, always = index(rules, {"cheap": 5, "pills": 2, "ads": 0})
    assert set(by) == {"pills", "ads", ""} and [e[1] for e in always] == ["x{3}"]
    pages = spark.createDataFrame([(1, "http://a/cheap-pills"), (2, "http://ads.b"), (3, "http://pills.c"), (4, "http://axxxb")], "page_id long, url string")
    assert {r.page_id: r.pattern for r in judge_urls(pages, rules=rules).collect()} == {1: "cheap-pills", 2: r"^ads\.", 3: None, 4: "x{3}"}


def test_copies_share_a_shard(spark):
    """Groups of equal texts are split by a cut only."""
    rows = entry.queries()["op5_kd_tree_sharding"](spark, "/root/testdata/sf0.1").collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32, r.size].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 23
