import zlib

import numpy as np

from gridloom.llm import toxicity


def corpus(n=900):
    g = np.random.default_rng(3)
    syllables = ["tha", "er", "in", "on", "lu", "ko", "mi", "ra", "ti", "ed"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(g.choice(syllables, g.integers(1, 4))) for _ in range(g.integers(8, 80))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(g.integers(0, len(words)), g.choice(["scum", "idiot", "lowei" + g.choice(syllables)]) + g.choice(["", ",", "."]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, "clash", 9) for r in docs], "doc_id long, text string, score string, toxic int").repartition(4)
    return toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()


def test_held_out_and_edges(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (5002, "... 12"), (None, "tha er scum idiot scum"), (0, docs[0][1]), (5003, "tha er in " * 30_000)]
    labels += [(7000, 1), (None, 1), (1, None), (3, 1)]
    got = run(spark, docs, labels)
    assert len(got) == len(docs)
    truth = {i: int(i % 3 == 0) for i in range(900)}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(not r.predicted for r in got if r.doc_id in (5000, 5001, 5002, 5003))


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(200)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    key = lambda rows: sorted((r.doc_id, r.score) for r in rows)
    assert key(run(spark, docs, labels)) == key(run(spark, docs, flipped))


def test_one_class_or_none(spark):
    docs, _ = corpus(30)
    assert {r.score for r in run(spark, docs, [(i, 0) for i in range(30)])} == {0.0}
    assert {r.score for r in run(spark, docs, [])} == {0.0}
    assert run(spark, [], [(1, 1)]) == []


def test_words_are_distributions():
    """What the model knows is likelier than what it does not, and models of equal counts say the same."""
    words = ["abab", "abba", "baab"]
    import pyarrow as pa

    rows = []
    names = ["kind", "gram", "context", "suffix", "suffix_context", "low", "low_context", "unit", "n"]
    for kind in (0, 1, 2):
        keys, _ = toxicity._rolling(words)
        cols = ("g4", "h3", "g3", "h2", "g2", "h1", "g1") if kind == 2 else ("g5", "h4", "g4", "h3", "g3", "h2", "g1")
        _, first, n = np.unique(keys[cols[0]], return_index=True, return_counts=True)
        rows += [[kind, *(int(keys[c][i]) for c in cols), int(m)] for i, m in zip(first, n)]
    model = toxicity.fit(pa.table(dict(zip(names, zip(*rows)))))
    keys, word_of = toxicity._rolling(["a" + c for c in ["a", "b", "z"]])
    shared = model["one"][keys["g1"]]
    for (share, left), g, h in ((model["two"], "g2", "h1"), (model["three"], "g3", "h2")):
        shared = share[keys[g]] + left[keys[h]] * shared
    top, top_left, middle, middle_left = model["classes"][0]
    p = top[keys["g5"]] + top_left[keys["h4"]] * (middle[keys["g4"]] + middle_left[keys["h3"]] * shared)
    second = p[[1, 4, 7]]  # P(a|^a), P(b|^a), P(z|^a)
    assert second[1] > second[0] > second[2] > 0 and second.sum() < 1
    assert np.allclose(toxicity.word_ratios(model, words), 0)


def brute_force(classes, corpus):
    """P(next character | four before) of each class, from counts of strings in dictionaries."""
    from collections import Counter

    def grams(words, order):
        return Counter(("\x02" * 4 + w + "\x03")[i - order + 1 : i + 1] for w in words for i in range(4, len(w) + 5))

    def continued(counts):
        return Counter(g[1:] for g in set(counts))

    def interpolated(counts, lower):
        totals, types = Counter(), Counter()
        for g, n in counts.items():
            totals[g[:-1]] += n
            types[g[:-1]] += 1

        def p(context, c):
            h = context[len(context) - len(next(iter(counts))) + 1 :]
            if h not in totals:
                return lower(context, c)
            left = min(toxicity.DISCOUNT * types[h] / totals[h], 1)
            return max(counts[h + c] - toxicity.DISCOUNT, 0) / totals[h] + left * lower(context, c)

        return p

    three = continued(grams(set(corpus), 4))
    shared = lambda context, c: 1 / toxicity.CHARACTERS
    for counts in (continued(continued(three)), continued(three), three):
        shared = interpolated(counts, shared)
    tops = [grams(words, 5) for words in classes]
    return [interpolated(top, interpolated(continued(top), shared)) for top in tops], set("".join(corpus)) | {"\x03"}


def test_kneser_ney_against_brute_force(spark):
    """Ratios of known and unknown words equal those of a model of dictionaries, whose probabilities sum to one."""
    g = np.random.default_rng(7)
    docs = [(i, " ".join("".join(g.choice(list("abcdé"), g.integers(1, 8))) for _ in range(12))) for i in range(30)]
    known = {i: i % 2 for i in range(20)}
    own = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = toxicity.orders(own.mapInArrow(toxicity._counted(spark.sparkContext.broadcast(known)), toxicity._COUNTS))
    texts = dict(docs)
    classes = [[w for i, c in known.items() if c == kind for w in texts[i].split()] for kind in (0, 1)]
    models, alphabet = brute_force(classes, [w for t in texts.values() for w in t.split()])
    words = sorted({w for t in texts.values() for w in t.split()})[::7] + ["a", "zz", "abcdeabcde", "éz", "b" * 30]
    want = []
    for w in words:
        line = "\x02" * 4 + w + "\x03"
        want.append(sum(np.log(models[1](line[i - 4 : i], line[i]) / models[0](line[i - 4 : i], line[i])) for i in range(4, len(line))))
    assert np.allclose(toxicity.word_ratios(toxicity.collected(found), words), want, atol=1e-9) and np.ptp(want) > 1
    for p in models:
        for context in ("\x02" * 4, "\x02\x02ab", "abcd", "zzzz", "\x02aéb"):
            rest = (toxicity.CHARACTERS - len(alphabet)) * p(context, "z")
            assert abs(sum(p(context, c) for c in alphabet) + rest - 1) < 1e-9


def test_words_in_marks_count_as_their_own(spark):
    """A word has one ratio whatever marks are around it, also after the memo was emptied; marks alone have none."""
    docs, labels = corpus(60)
    own = spark.createDataFrame(docs, "doc_id long, text string")
    classes = spark.sparkContext.broadcast({i: c for i, c in labels})
    evidence = toxicity.Evidence(toxicity.collected(toxicity.orders(own.mapInArrow(toxicity._counted(classes), toxicity._COUNTS))))
    plain, marked, marks = evidence(["scum tha idiot", '"scum," (tha) *idiot*', "... !!"])
    assert np.array_equal(plain, marked) and not marks.any() and plain.any()
    evidence.memo.update({f"w{k}": 0.0 for k in range(toxicity.MEMO_WORDS)})
    assert np.array_equal(evidence(["(tha) scum! idiot"])[0], plain) and len(evidence.memo) < 100


def test_counts_grow_with_the_corpus(spark):
    """Every n-gram has its own count, however many there are, as in strings."""
    from collections import Counter

    g = np.random.default_rng(5)
    words = {"".join(map(chr, g.integers(0x4E00, 0x9F00, 6))) for _ in range(12_000)}
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string").repartition(3)
    found = toxicity.orders(docs.mapInArrow(toxicity._counted(spark.sparkContext.broadcast({})), toxicity._COUNTS)).collect()
    grams = {("\x02\x02\x02\x02" + w + "\x03")[k - 3 : k + 1] for w in words for k in range(4, len(w) + 5)}
    want = {}
    for order in (3, 2, 1):
        want[order] = Counter(x[1:] for x in grams)
        grams = set(want[order])
    for order, counts in want.items():
        assert Counter(r.n for r in found if r.order == order) == Counter(counts.values())


def test_join_gives_what_broadcast_gives(spark):
    docs, labels = corpus(300)
    docs += [(5000, None), (5001, "... 12"), (5002, "scum"), (None, "tha er scum scum"), (0, docs[0][1])]
    d, one = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    a, b = (sorted(toxicity.score(d, one, broadcast_grams=n).collect(), key=key) for n in (10**9, 0))
    assert [(r.doc_id, r.held_out, r.predicted) for r in a] == [(r.doc_id, r.held_out, r.predicted) for r in b]
    assert np.allclose([r[2:-1] for r in a], [r[2:-1] for r in b], atol=1e-7)
    kept = [sorted(map(key, toxicity.clean_rows(d, one, broadcast_grams=n).collect())) for n in (10**9, 0)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < len(docs)
