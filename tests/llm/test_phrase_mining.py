from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from clusterloom.llm import phrase_mining as p


def brute(rows, least, keep):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i:i + n])] += 1
    many = {k: v for k, v in counts.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, w), a in many.items():
        longer = any(g == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                     for (g, v), b in many.items())
        if longer:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * words[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, l, r, words[lang], score))
    return sorted((lang, i + 1, x[2].decode(), *x[3:]) for lang, rows_ in out.items() for i, x in enumerate(sorted(rows_)[:keep]))


def found(spark, rows, **options):
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string")
    return sorted(tuple(r) for r in p.mine(docs, **options).collect())


def sample(rng, n):
    words = ["a", "b", "Cé", "d", "e\x00f", "ß", "gg", "H"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ".", ", ", "\r\n"]) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(sample(rng, rng.randint(0, 60)), rng.choice(["x", "x", "y", None, "und"])) for _ in range(150)]
    rows += [(None, "x"), ("", None), (" \t.,", "z"), ("one two three four five six. " * 9, "w")] + [("fixed phrase of five words", "x")] * 8
    want = brute(rows, 6, 40)
    assert len(want) > 100
    assert found(spark, rows, min_count=6, keep=40) == want
    assert found(spark, rows[:0]) == []


def test_long_text_is_cut_at_separators():
    rng = random.Random(5)
    data = np.frombuffer(sample(rng, 3000).encode(), np.uint8)
    cut = list(p._parts(3, 4, data, np.array([0, len(data)]), 100))
    assert len(cut) > 20 and b"".join(x[2].tobytes() for x in cut) == data.tobytes()
    assert all(p._separators()[x[2][-1]] for x in cut[:-1])


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(6)
    for least in (5, 20):
        keys = np.concatenate([rng.zipf(1.3, 20000) % 5000, rng.integers(5000, 40000, 20000)]).astype(np.uint32)
        rng.shuffle(keys)
        summary = p.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, 37):
            summary.merge(*p.add_up(part, np.ones(len(part), np.int64)))
            summary.settle()
        assert summary.taken > 0 and len(summary.keys) <= summary.capacity
        frequent = {k for k, n in Counter(keys.tolist()).items() if n >= least}
        assert frequent <= set(summary.survivors(least).tolist())
