"""The pipeline's stages against a brute-force version on the smallest table."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("pliego.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np

from pliego.llm.common import cut
from pliego.llm.mixing import mix
from pliego.llm.packing import token_ids, vocabulary
from pliego.llm.simhash import fingerprint

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return re.sub(r"[1-9]", "0", re.sub(r"[ \t\x0b\x0c\r]+", " ", line.lower())).strip(" ")


def quality(docs):
    often, hosts = defaultdict(set), defaultdict(set)
    mark = {t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for _, t, _ in docs}
    for _, t, host in docs:
        hosts[host].add(t)
        for line in t.split("\n"):
            if norm(line):
                often[host, norm(line)].add(mark[t])
    out = []
    for i, t, host in docs:
        words = WORD.findall(t)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}

        def gone(line, t=t, host=host):
            seen = often[host, norm(line)] if norm(line) else ()
            return len(seen) > max(10, 0.001 * len(hosts[host])) and min(seen) != mark[t]

        lost = sum(len(norm(x).split(" ")) for x in t.split("\n") if gone(x))
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words) and len(words) - lost >= 0.2 * len(words):
            out.append((i, "\n".join(x for x in t.split("\n") if not gone(x)), host))
    return out


def lines(docs):
    sites, first = defaultdict(set), {}
    for i, t, host in sorted(docs):
        for k, line in enumerate(t.split("\n")):
            sites[norm(line)].add(host)
            first.setdefault(norm(line), (i, k))

    def gone(i, k, line):
        return len(norm(line).split(" ")) >= 3 and len(sites[norm(line)]) >= 5 and first[norm(line)] != (i, k)

    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if not gone(i, k, x)), host) for i, t, host in docs]


def near(docs):
    docs = sorted(docs)
    a = np.array([fingerprint(t) for _, t, _ in docs], dtype=np.uint64)
    label = np.arange(len(docs))
    while True:
        new = np.array([min(label[np.bitwise_count(a ^ x) <= 4]) for x in a])
        if (new == label).all():
            return [d for k, d in enumerate(docs) if label[k] == k]
        label = new


def rows(df):
    return sorted((r.doc_id, r.text, r.source) for r in df.collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, want = docs, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, lines, near), strict=False):
        now = cut(stage(spark, now, SF), name)
        want = brute(want)
        assert now.columns == docs.columns and rows(now) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in now.collect())
    before = {r.doc_id: r for r in now.collect()}
    decided = {r.doc_id: r for r in mix(now, spark.read.parquet(f"{SF}/labels.parquet"), protect="clean").collect()}
    now = cut(corpus_pipeline.STAGES[3][1](spark, now, SF), "mixed")
    assert now.columns == docs.columns
    mixed = Counter(r.doc_id for r in now.collect())
    assert mixed == Counter({i: r.copies for i, r in decided.items() if r.copies})
    assert all(mixed[i] >= 1 for i, r in decided.items() if max(r.p) == r.p[0])
    packed = corpus_pipeline.STAGES[4][1](spark, now, SF).collect()
    pieces = Counter((r.doc_id, r.start, r.ids_crc32) for r in packed)
    expect = Counter()
    for i, n in mixed.items():
        ids = token_ids(before[i].text, vocabulary())
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for s, e in zip(bounds, bounds[1:], strict=False):
            expect[i, s, zlib.crc32(ids[s:e].tobytes())] += n
    assert pieces == expect
