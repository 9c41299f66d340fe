import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, lang string, row string, node int, sketch string"


def shingles(text, words):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1))


def brute(docs, words, num, den):
    sets = [shingles(t, words) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return Counter((d, len(sets[k]), least.get(find(k)), d == least.get(find(k))) for k, (d, _) in enumerate(docs))


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ÉTÉ", "the", "The", "…"]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    docs = []
    for i in range(n):
        kind = r.random()
        if docs and kind < 0.45:
            words = r.choice(docs)[1].split(" ")
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        elif kind < 0.6:
            text = passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 40)))
        else:
            text = r.choice([" ", "\n"]).join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 20, 60, 150])))
        docs.append((i, text))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "clash", 1, "clash") for d, t in docs], SCHEMA).repartition(3)


def run(spark, docs, *args):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame(spark, docs), *args).collect())


@pytest.mark.parametrize("args", [(3, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, args):
    docs = corpus() + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "x y z " * 4000)]
    docs += [(None, docs[0][1]), (None, "lonely text of no id at all"), (5, docs[5][1]), (5, docs[5][1])]
    assert run(spark, docs, *args) == brute(docs, *args)


@pytest.mark.parametrize("short", [1, 5, 1000])
def test_blocks_settle_what_rounds_leave(spark, monkeypatch, short):
    monkeypatch.setattr(nd, "ROUNDS", 0)
    monkeypatch.setattr(nd, "SHORT", short)
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "PER_CENTRE", 3)
    docs = corpus(2, 80)
    assert run(spark, docs, 3, 85, 100) == brute(docs, 3, 85, 100)


def test_chains_of_near_copies(spark):
    words = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(60):
        words[3 * i : 3 * i + 2] = [f"n{i}", f"m{i}"]
        docs.append((100 - i, " ".join(words)))
    assert run(spark, docs, 3, 85, 100) == brute(docs, 3, 85, 100)


def test_keep_one(spark):
    docs = corpus(3, 60) + [(None, "a b c d e f g h"), (900, None), (901, ""), (7, corpus(3, 60)[7][1])]
    got = nd.keep_one(frame(spark, docs), 3, 85, 100)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = Counter(r.doc_id for r in got.collect())
    want = brute(docs, 3, 85, 100)
    assert kept[900] == kept[901] == kept[None] == 1 and max(kept.values()) == 1
    assert set(kept) - {None} == {d for d, _, c, _ in want if d is not None and d == c}


def test_empty(spark):
    assert run(spark, []) == Counter() and nd.keep_one(frame(spark, [])).count() == 0


def test_shingle_sets_have_the_right_size():
    s = nd.Shingler(3)
    for text in [t for _, t in corpus(4)] + ["", "a", "a b", "A b a B a b", "\x1cx y\x0bz"]:
        assert len(s(text)) == len(shingles(text, 3))
    a, b = corpus(5)[0][1], corpus(5)[1][1]
    assert len(np.intersect1d(s(a), s(b))) == len(shingles(a, 3) & shingles(b, 3))
