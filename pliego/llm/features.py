"""Dense features of whole texts for the toxicity and domain classifiers, and the
bounded samples of labelled rows that such classifiers are fitted on."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import KEY, arrow_batches, row_key, with_fields

FEATURES = (
    "learned_words", "learned_stems", "learned_top", "learned_sum", "insults", "hits", "proximity",
    "second_person", "capitals", "caps_words", "exclaims", "questions", "punctuation", "obfuscated",
    "symbols", "word_length", "distinct_words", "digits", "log_words",
)

# Insults known beforehand, and words of second-person address in
# the languages of the corpus. What else is toxic is learned from labels.
INSULTS = set("idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash garbage scum clown filth filthy imbecile fool bastard pig freak ugly retard shut hate kill".split())
SECOND = set("you your yours yourself youre u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros eres".split())
# Look-alikes that stand for letters inside a word.
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "*": "", ".": "", "-": "", "_": "", "'": ""})
COMMON = ".,;:!?\"'()[]{}<>|%&$#*«»¿¡-"  # most of what stands around a word; EDGE finds the rest
EDGE = re.compile(r"^\W+|\W+$")
RUN = re.compile(r"(.)\1{2,}")
LETTERS = re.compile(r"[^\W\d_]")
INSIDE = re.compile(r"[^\W\d_][@$!*+0-9][^\W\d_]")
STEMS = (4, 5, 6)  # letters
PLAIN = (0.0, False, False)  # what is known of a word that no list holds
CACHE = 500_000  # words whose analysis a task remembers
SURE = 3.0  # z-score from which a learned word counts as a hit


def normal_word(token: str) -> tuple[str, bool]:
    """A white-space token as a plain lower-case word, and whether it was disguised."""
    low = token.strip(COMMON).lower()
    if low.isalpha() and not RUN.search(low):
        return low, False
    bare = EDGE.sub("", token)
    low = bare.lower()
    if low.isalpha() and not RUN.search(low):
        return low, False
    hidden = bool(INSIDE.search(bare)) or bool(RUN.search(low) and LETTERS.search(low))
    plain = RUN.sub(r"\1", low.translate(LEET) if LETTERS.search(low) else low)
    return plain, hidden


def vocabulary(text: str | None) -> set[str]:
    """What the lexicon is learned from: a text's words, and their stems as ``stem-``."""
    out: set[str] = set()
    for token in set((text or "").split()):
        w, _ = normal_word(token)
        if len(w) > 2 and w.isalpha():
            out.add(w)
            out.update(w[:k] + "-" for k in STEMS if len(w) > k)
    return out


class Analyser:
    """Features of texts under one lexicon (word or stem -> z-score of its log-odds);
    remembers the words it has seen."""

    def __init__(self, lexicon: dict[str, float]):
        self.stems = {s[:-1]: z for s, z in lexicon.items() if s.endswith("-")}
        # Most words are rare and plain: one look at their first letters rules all stems out.
        self.fronts = {s[:4] for s in self.stems}
        self.known = {w: (lexicon.get(w, 0.0), w in INSULTS, w in SECOND) for w in {*lexicon, *INSULTS, *SECOND}}
        self.plain: set[str] = set()  # tokens all of whose flags are nought
        self.flags: dict[str, tuple] = {}  # the others

    def telling(self, tokens: Iterable[str]) -> list[str]:
        """Those of ``tokens`` that have flags; others are remembered as plain."""
        if len(self.plain) + len(self.flags) > CACHE:
            self.plain.clear()
            self.flags.clear()
        out = []
        for token in filterfalse(self.plain.__contains__, tokens):
            if token not in self.flags:
                flags = self.word(token)
                if flags is None:
                    self.plain.add(token)
                    continue
                self.flags[token] = flags
            out.append(token)
        return out

    def word(self, token: str) -> tuple | None:
        """(z of the word or its best stem, and None or the flags: learned word, learned
        stem, insult, second person, all capitals, disguised), None for a plain word."""
        w, hidden = normal_word(token)
        caps = token.isupper() and len(token) > 1
        z, insult, second = self.known.get(w, PLAIN)
        stem, n = 0.0, len(w)
        if n > 4 and w[:4] in self.fronts:
            get = self.stems.get
            stem = get(w[:4], 0.0)
            if n > 5 and (more := get(w[:5], 0.0)) > stem:
                stem = more
            if n > 6 and (more := get(w[:6], 0.0)) > stem:
                stem = more
        if not (z or stem or caps or hidden or insult or second):
            return None
        best = z if z > stem else stem
        flags = (z >= SURE, stem >= SURE, insult, second, caps, hidden)
        return best, flags if any(flags) else None

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        n, chars = len(tokens), max(1, len(text))
        sums = [0] * 6
        hits: set[str] = set()
        top = total = 0.0
        counts = Counter(tokens)
        second: set[str] = set()
        for token in self.telling(counts):
            z, flags = self.flags[token]
            if z:
                total += z
                if z > top:
                    top = z
            if flags is None:
                continue
            k = counts[token]
            for i in range(6):
                if flags[i]:
                    sums[i] += k
            if z >= SURE or flags[2]:
                hits.add(token)
            if flags[3]:
                second.add(token)
        near = 0.0
        if hits and second:
            at = np.array([i for i, t in enumerate(tokens) if t in hits])
            you = np.array([i for i, t in enumerate(tokens) if t in second])
            j = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(j, len(you) - 1)]), np.abs(at - you[np.maximum(j - 1, 0)]))
            near = float(np.mean(1 / (1 + gap)))
        code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        ascii_counts = np.bincount(code[code < 128], minlength=128)
        upper = ascii_counts[65:91].sum() + ((code >= 0xC0) & (code <= 0xDE)).sum()
        letters = max(1, upper + ascii_counts[97:123].sum() + (code >= 0xDF).sum())
        punct = ascii_counts[33:48].sum() + ascii_counts[58:65].sum() + ascii_counts[91:97].sum() + ascii_counts[123:127].sum()
        symbols = sum(int(ascii_counts[ord(c)]) for c in "#*$%&|<>")
        words = max(1, n)
        found = sum(counts[t] for t in hits)
        return [
            sums[0] / words, sums[1] / words, top, min(total, 60.0), sums[2] / words, float(min(found, 20)), near,
            sums[3] / words, upper / letters, sums[4] / words, ascii_counts[33] / words, ascii_counts[63] / words, punct / chars, sums[5] / words,
            symbols / chars, letters / words, len(counts) / words, ascii_counts[48:58].sum() / chars, float(np.log1p(n)),
        ]


def with_features(docs: DataFrame, text: str, keep: list[str], lexicon: dict[str, float]) -> DataFrame:
    """``keep`` and a double column for each of FEATURES, and n_words; whole texts,
    one narrow pass. A null text has the features of an empty one."""
    arrow_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias("_text"))
    schema = with_fields(src.select(*keep), ", ".join(f"{c} double" for c in FEATURES) + ", n_words long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(lexicon)
        for b in batches:
            rows = np.array([analyser.features(t.as_py()) for t in b.column("_text")], dtype=float).reshape(-1, len(FEATURES))
            n = np.rint(np.expm1(rows[:, -1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c) for c in rows.T), pa.array(n)], names=schema.names)

    return src.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], text: str, doc_id: str, bound: int) -> DataFrame:
    """(_id, _text, ``columns``): about ``bound`` labelled documents at most, chosen by
    a hash of the id; copies of a text count once. ``labels`` rows without a
    label are left out, and of a repeated id the largest labels hold."""
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(*[F.max(c).alias(c) for c in columns])
    known = known.dropna()
    n = known.count()
    part = min(1.0, bound / max(1, n))
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    # At most about ``bound`` ids of a few bytes: their size is known before they are sent.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    return rows.select("*", *row_key("_text")).dropDuplicates(KEY).drop(*KEY)


def learn_lexicons(rows: DataFrame, label: str, part: str, text: str = "_text", support: int = 3, least: float = 2.0) -> dict[object, dict[str, float]]:
    """For each value of column ``part`` in the bounded sample ``rows``, the lexicon of
    that part, and under None that of all parts: words and stems that at least
    ``support`` texts with label 1 hold, with the z-score of their log-odds."""
    src = rows.select(F.col(text).alias("_text"), F.col(label).cast("long").alias("y"), F.col(part).cast("long").alias("part"))
    arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y, k in zip(b.column("_text"), b.column("y"), b.column("part"), strict=True):
                words = list(vocabulary(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([v.as_py()] * len(words), pa.int64()) for v in (y, k))], names=["w", "y", "part"])

    sizes = {r["part"]: (r["t"], r["n"]) for r in src.groupBy("part").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    sizes[None] = tuple(map(sum, zip(*sizes.values(), strict=True))) if sizes else (0, 0)
    counts = src.mapInArrow(run, "w string, y long, part long").groupBy("w").agg(
        *[f(F.when(F.col("part") == k, v) if k is not None else v).alias(f"{c}{'' if k is None else k}") for k in sizes for c, f, v in (("t", F.sum, F.col("y")), ("n", F.count, F.lit(1)))]
    )
    counts = counts.filter(F.col("t") >= support)
    scored = []
    for k, (ones, n) in sizes.items():
        name = "" if k is None else str(k)
        t = F.coalesce(F.col(f"t{name}"), F.lit(0))
        c = F.col(f"n{name}") - t
        odds = F.log((t + 0.5) / F.lit(ones + 1.0)) - F.log((c + 0.5) / F.lit(n - ones + 1.0))
        scored.append(F.when(t >= support, odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))).alias(f"z{name}"))
    z = F.greatest(*[F.coalesce(F.col(f"z{'' if k is None else k}"), F.lit(0.0)) for k in sizes], F.lit(0.0)) if sizes else F.lit(0.0)
    found = counts.select("w", *scored).filter(z >= least).collect()  # words of the bounded sample
    return {k: {r["w"]: v for r in found if (v := r[f"z{'' if k is None else k}"]) is not None and v >= least} for k in sizes}
