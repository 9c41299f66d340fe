"""Language identification as inference of a mixture of languages.

Each language is a distribution over n-grams of three bytes, counted over all training rows. A document is
a mixture of languages: expectation-maximisation estimates the proportions from the likelihoods of its
n-grams, and languages are taken into its set, the largest proportion first, for as long as the likelihood
gains more than a penalty for each. The prediction is the language of the largest proportion in that set.

n-grams fall into a fixed number of buckets, so the model's size depends only on the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import remainder, table

BITS = 17
#: Added to each count. Steps of expectation-maximisation. Cost of one more language in a set, in units of log(n) / 2.
SMOOTHING, STEPS, PENALTY = 0.5, 12, 2.0
#: Neighbouring n-grams share bytes; likelihoods count as those of so many times fewer n-grams.
DEPENDENCE = 3.0
UNDETERMINED = "und"
#: A text fits no language if the mean log-likelihood of its n-grams stays below what its languages expect of their own
#: texts by more than the first, and the second over the root of the number of independent n-grams.
MISFIT, MISFIT_SHORT = 3.0, 4.0
#: Bytes of text whose n-grams are counted at a time.
AT_ONCE = 4 << 20

_TO_SPACE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of the text's n-grams: lower case, what is no letter in ASCII as a space, runs of it as one."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counted(langs: list[str]):
    number = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        size = 0

        def settle() -> None:
            for lang, parts in waiting.items():
                n = np.bincount(np.concatenate(parts), minlength=1 << BITS)
                totals[lang] = totals[lang] + n if lang in totals else n
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                g = grams(text)
                waiting.setdefault(number[lang], []).append(g)
                size += len(g)
                if size > AT_ONCE:
                    settle()
                    size = 0
        settle()
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])

    return run


Model = tuple[list[str], np.ndarray, np.ndarray]


def fit(langs: list[str], rows: pa.Table) -> Model:
    """Languages in order, the log-probability of each n-gram in each, and what each expects of its n-grams, from counts."""
    counts = np.zeros((1 << BITS, len(langs)))
    counts[rows["gram"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    logs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts)))
    return langs, logs.astype(np.float32), (counts * logs).sum(0) / np.maximum(counts.sum(0), 1)


def mixture(logs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns' languages and the log-likelihood under them. logs: n-grams by languages."""
    if logs.shape[1] == 1:
        return np.ones(1), float(logs[:, 0] @ counts)
    top = logs.max(1)
    likely = np.exp(logs - top[:, None])
    share = np.full(logs.shape[1], 1 / logs.shape[1])
    for _ in range(STEPS):
        joint = likely * share
        share = counts @ (joint / joint.sum(1)[:, None])
        share /= share.sum()
    return share, float((np.log(likely @ share) + top) @ counts)


def infer(logs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of languages (columns, the largest proportion first) and their proportions."""
    counts = counts / DEPENDENCE
    share, _ = mixture(logs, counts)
    order = np.argsort(-share, kind="stable")
    single = counts @ logs
    # of the sets of one language the likeliest; a larger set begins with the largest proportions
    best, best_share, best_value = np.array([single.argmax()]), np.ones(1), float(single.max())
    cost = PENALTY * 0.5 * np.log(max(counts.sum(), 2.0))
    for size in range(2, len(order) + 1):
        chosen = order[:size]
        if share[chosen[-1]] < 0.01:
            break
        own, value = mixture(logs[:, chosen], counts)
        if value - best_value <= cost * (size - len(best)):
            break
        best, best_share, best_value = chosen, own, value
    again = np.argsort(-best_share, kind="stable")
    return best[again], best_share[again]


def decide(text: str, langs: list[str], logs: np.ndarray, expected: np.ndarray) -> tuple[str, float, list[str], list[float], float | None, bool]:
    """Prediction, score, set of languages and proportions of one text, its misfit, and whether it fits its languages."""
    if not langs or not has_letter(text):
        return UNDETERMINED, 0.0, [], [], None, False
    found, counts = np.unique(grams(text), return_counts=True)
    rows = logs[found].astype(np.float64)
    chosen, share = infer(rows, counts)
    certain = 1.0
    if len(chosen) == 1:  # how much likelier the language is than any other alone
        single = counts @ rows / DEPENDENCE
        certain = 1 / np.exp(np.clip(single - single[chosen[0]], -700, 700)).sum()
    n = counts.sum()
    misfit = float(expected[chosen] @ share - np.log(np.exp(rows[:, chosen]) @ share) @ counts / n)
    fits = misfit <= MISFIT + MISFIT_SHORT / np.sqrt(n / DEPENDENCE)
    return langs[chosen[0]], float(share[0] * certain), [langs[c] for c in chosen], share.tolist(), misfit, bool(fits)


_OUT = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>, misfit double, fits boolean"


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64(), pa.bool_())
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [decide(text, *model.value) for text in part.column("text").to_pylist()]
                cols = [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), types[1:]))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _OUT.split(", ")])

    return run


def train(docs: DataFrame, held_out_mod: int = 5, held_out: int = 0) -> Model:
    """The model of all rows with a text and a language whose crc32(id as text) is not held out.

    What comes back is at most 2^BITS counts a language, as numbers. Rows with a null id teach nothing.
    """
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder("doc_id", held_out_mod) != held_out))
    langs = sorted(r.lang for r in usable.select("lang").distinct().collect())  # as many as there are languages
    counts = usable.select("lang", "text").mapInArrow(_counted(langs), "lang int, gram int, n long")
    return fit(langs, counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``, the set of languages with their proportions, ``misfit`` and ``fits``, of every whole text.

    A null or empty text, one without a letter, and every text where nothing was learnt get ``und`` and the
    score 0. Ties go to the first language by name. Repeated rows and null ids each keep their row. An empty table
    gives no rows. Other columns, ``lang`` among them, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), _OUT)


def identify(docs: DataFrame) -> DataFrame:
    """Trains on ``docs`` and predicts all of them; ``held_out`` tells which rows taught nothing."""
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "proportions", "misfit", "fits")


def identified_rows(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a language that was learnt (of ``languages``, if given).

    Texts without a letter and texts that fit no language, such as rows of random letters or a language that nothing was
    learnt of, go. That cut does not depend on how many languages there are, so a text that mixes many of them stays.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [decide(text or "", *model.value) for text in part.column("text").to_pylist()]
                yield part.filter(pa.array([fits and (languages is None or lang in languages) for lang, *_, fits in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`identify` of all documents; the docstring of :func:`predict` states the odd cases."""
    return identify(table(spark, sf_dir, "documents"))
