import itertools
import zlib

import numpy as np

from gridloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, languages int"
WORDS = {"aa": ["tha", "ing", "the", "was"], "bb": ["lich", "und", "keit", "der"], "cc": ["çion", "él", "ñas", "que"]}


def corpus():
    g = np.random.default_rng(1)
    out = []
    for i in range(300):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(g.choice(WORDS[lang], g.integers(3, 60))), lang))
    return out


def run(spark, rows):
    return langid.identify(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)).collect()


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 *** …", "cc"), (1003, "tha ing " * 20_000, None), (None, "lich und der keit", "bb"), (5, "tha the was", "aa")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und"
    want = {i: lang for i, _, lang in corpus()}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want and r.doc_id != 5)
    assert [r.lang_pred for r in got if r.doc_id == 1003] == ["aa"] and [r.lang_pred for r in got if r.doc_id is None] == ["bb"]


def test_mixture_finds_both_languages(spark):
    rows = corpus() + [(2000, "tha ing the was " * 30 + "lich und keit der " * 15, "aa")]
    got = next(r for r in run(spark, rows) if r.doc_id == 2000)
    assert got.languages == ["aa", "bb"] and abs(got.proportions[0] - 0.62) < 0.15


def test_mixture_against_direct_maximum():
    g = np.random.default_rng(2)
    logs = np.log(g.dirichlet(np.ones(40), 2).T)
    counts = g.integers(0, 9, 40).astype(float)
    share, value = langid.mixture(logs, counts)
    grid = [(np.log(np.exp(logs) @ [a, 1 - a]) @ counts, a) for a in np.linspace(0.001, 0.999, 999)]
    assert abs(value - max(grid)[0]) < 0.05 and abs(share[0] - max(grid)[1]) < 0.05


def test_nothing_learnt(spark):
    assert [r.lang_pred for r in run(spark, [(1, "text", None)])] == ["und"]
    assert run(spark, []) == []


def test_set_against_all_subsets():
    """The set that is chosen has the highest penalised likelihood of all sets of languages."""
    g = np.random.default_rng(4)
    for trial in range(12):
        logs = np.log(g.dirichlet(np.full(60, 0.3), 4).T + 1e-6)
        true = g.choice(4, g.integers(1, 4), replace=False)
        weight = g.dirichlet(np.full(len(true), 8.0))
        counts = g.multinomial(600, (np.exp(logs[:, true]) @ weight) / (np.exp(logs[:, true]) @ weight).sum()).astype(float)
        chosen, _ = langid.infer(logs, counts)
        cost = langid.PENALTY * 0.5 * np.log(counts.sum() / langid.DEPENDENCE)
        value = lambda s: langid.mixture(logs[:, list(s)], counts / langid.DEPENDENCE)[1] - cost * len(s)
        best = max((s for k in range(1, 5) for s in itertools.combinations(range(4), k)), key=value)
        assert value(sorted(chosen.tolist())) >= value(best) - 1e-6 and sorted(chosen.tolist()) == list(best) == sorted(true.tolist())


def test_ties_go_to_the_first_name(spark):
    rows = [(i, "tha ing the was", lang) for i, lang in enumerate(["bb", "aa"] * 40)] + [(1000, "the was", None)]
    got = {r.lang_pred for r in run(spark, rows) if r.doc_id == 1000}
    counts = {lang: sum(1 for i, _, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5) for lang in ("aa", "bb")}
    assert counts["aa"] != counts["bb"] or got == {"aa"}
    logs = np.log(np.full((6, 3), 1 / 6))
    assert langid.infer(logs, np.ones(6))[0].tolist() == [0]


def test_rows_that_fit_no_language_go(spark):
    g = np.random.default_rng(3)
    junk = [(3000 + k, " ".join("".join(g.choice(list("bcdfghjkmpqvxyz"), g.integers(3, 9))) for _ in range(n)), None) for k, n in enumerate((8, 40, 400))]
    mixed = [(4000, "tha ing the was " * 9 + "lich und keit der " * 9 + "çion él ñas que " * 9, None), (4001, "tha", None)]
    rows = corpus() + junk + mixed + [(5000, None, None), (5001, "", None), (5002, "12 !", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    kept = langid.identified_rows(df)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in corpus() + mixed}
    assert {r.doc_id for r in langid.identified_rows(df, ["bb"]).collect()} - {4000} == {i for i, _, lang in corpus() if lang == "bb"}
