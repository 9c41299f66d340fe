"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary words, are interpolated Kneser-Ney models of order 5 whose
orders 5 and 4 hold counts of their class. Both back off to the same lower orders, whose continuation
counts come from the words of the whole corpus: of a rare expression that neither class knows, both models
say the same, and it counts for nothing. The log-likelihood ratio of the two is taken a word at a time. A
document's evidence is length-normalised: its mean ratio over all its words, and the means over its one,
two and three most toxic words. A logistic regression on labelled rows that the counts did not use turns
that evidence into a score.

Counts are keyed by 64-bit keys of whole n-grams and grow with the corpus: they are grouped in Spark and written
as a table. A model whose measured number of n-grams is small is broadcast; for a larger one the distinct words
are joined with the table, and the documents with the ratios of their words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, release, remainder, table

#: Labelled rows of each class that the class counts and the regression may use, those of the smallest hashes.
LABELLED_DOCS = 20_000
#: Of these, one in so many goes to the regression and the rest to the counts.
FIT_ONE_IN = 4
THRESHOLD = 0.7
DISCOUNT = 0.75
#: A model of at most this many n-grams (by measured count) is broadcast; a larger one stays a table that words are joined with.
BROADCAST_GRAMS = 6_000_000
#: Characters that the lowest order spreads its weight over.
CHARACTERS = 0x110000
#: Words that a worker remembers; it forgets all when full, which changes no result.
MEMO_WORDS = 300_000
#: Characters around a word that are not part of it.
AROUND = ".,;:!?*%$#&|\"'()[]<>=/\\-_{}+~`@^0123456789"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    return text.lower().split()


def _mixed(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    key = (key + codes) * _PRIME
    return key ^ (key >> np.uint64(29))


def _rolling(words: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Keys of the n-grams and contexts that end at each character of the words, and each position's word.

    A word is led by four start marks and closed by an end mark, which is predicted as a character is.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = "\x02\x02\x02\x02" + "\x03\x02\x02\x02\x02".join(words) + "\x03"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths + 5) - (lengths + 5)
    word_of = np.repeat(np.arange(len(words)), lengths + 1)
    at = np.arange(len(word_of)) + 4 * (word_of + 1)
    assert len(at) == 0 or at[-1] == len(codes) - 1 and starts[-1] + 4 + lengths[-1] == at[-1]
    out, now = {}, np.zeros(len(at), np.uint64)
    for m in range(1, 6):
        now = _mixed(now, codes[at - (m - 1)])
        out[f"g{m}"] = now.view(np.int64)
    before = np.zeros(len(at), np.uint64)
    for m in range(2, 6):  # the context of an n-gram is all but its last character
        before = _mixed(before, codes[at - (m - 1)])
        out[f"h{m - 1}"] = before.view(np.int64)
    return out, word_of


_COUNTS = "kind int, gram long, context long, suffix long, suffix_context long, low long, low_context long, unit long, n long"


#: Distinct words that a task gathers before it counts their n-grams.
WORDS_AT_ONCE = 30_000
#: Shared n-grams that a task remembers to have emitted; it forgets all when full, which changes no result.
SEEN_GRAMS = 1_000_000


def _counted(classes):
    """n-gram counts of a partition: kind 0 and 1 for the classes, 2 for the shared types, each of these once."""
    names = [("g5", "h4", "g4", "h3", "g3", "h2", "g1")] * 2 + [("g4", "h3", "g3", "h2", "g2", "h1", "g1")]

    def rows(kind: int, counts: dict[str, int], seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        clean: Counter = Counter()
        for w, n in counts.items():
            clean[w.strip(AROUND)] += n
        clean.pop("", None)
        words, weights = list(clean), np.fromiter(clean.values(), np.int64, len(clean))
        for a in range(0, len(words), 10_000):
            keys, word_of = _rolling(words[a : a + 10_000])
            grams, first, inverse = np.unique(keys[names[kind][0]], return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights[a : a + 10_000][word_of], len(grams)).astype(np.int64)
            if kind == 2:
                new = ~np.isin(grams, seen[0], assume_unique=True)
                first = first[new]
                n = np.ones(len(first), np.int64)
                seen[0] = np.concatenate([seen[0], grams[new]]) if len(seen[0]) < SEEN_GRAMS else grams
            cols = [pa.array(np.full(len(first), kind, np.int32)), *(pa.array(keys[x][first]) for x in names[kind]), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _COUNTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = classes.value, [np.zeros(0, np.int64)]
        gathered: list[Counter | dict] = [Counter(), Counter(), {}]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = tokens(text)
                    gathered[2].update(dict.fromkeys(words, 1))
                    if doc_id in known:
                        gathered[known[doc_id]].update(words)
                for kind, counts in enumerate(gathered):
                    if len(counts) >= WORDS_AT_ONCE:
                        yield from rows(kind, counts, seen)
                        counts.clear()
        for kind, counts in enumerate(gathered):
            yield from rows(kind, counts, seen)

    return run


class Table:
    """Values by 64-bit key, and a default for the keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float):
        own = keys.view(np.uint64)
        order = np.argsort(own)
        bits = len(own).bit_length() + 1
        self.keys, self.values = own[order], np.append(values[order], default)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys).view(np.uint64)
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        found = np.full(len(keys), len(self.keys))
        open_ = np.flatnonzero(at < end)
        while len(open_):
            same = self.keys[at[open_]] == keys[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return self.values[found]


def _order(grams: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[Table, Table]:
    """Discounted share of each n-gram in its context, and the weight that each context leaves to the lower order."""
    found, inverse = np.unique(contexts, return_inverse=True)
    totals, types = np.bincount(inverse, counts, len(found)), np.bincount(inverse, minlength=len(found))
    return Table(grams, np.maximum(counts - DISCOUNT, 0) / totals[inverse], 0.0), Table(found, np.minimum(DISCOUNT * types / totals, 1), 1.0)


def _continuations(grams: np.ndarray, suffixes: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, its context, number of distinct n-grams that end in it)."""
    _, first = np.unique(grams, return_index=True)
    found, at, n = np.unique(suffixes[first], return_index=True, return_counts=True)
    return found, contexts[first][at], n.astype(np.float64)


def _model(of) -> dict:
    """The tables from the n-grams, their contexts and counts, which ``of(kind, order)`` gives."""
    model: dict = {"classes": [(*_order(*of(kind, 5)), *_order(*of(kind, 4))) for kind in (0, 1)]}
    model["three"], model["two"] = _order(*of(2, 3)), _order(*of(2, 2))
    share, left = _order(*of(2, 1))
    base = left[np.zeros(1, np.int64)][0] / CHARACTERS
    model["one"] = share
    share.values = share.values + base
    return model


def fit(rows) -> dict:
    """The tables of the models from the rows of counts (an Arrow table, one row per kind and n-gram)."""
    parts: dict = {}
    for kind in (0, 1, 2):
        own = rows.filter(pc.equal(rows["kind"], kind))
        x = {c: own[c].to_numpy() for c in own.column_names}
        if kind < 2:
            parts[kind, 5] = x["gram"], x["context"], x["n"].astype(np.float64)
        parts[kind, 4 if kind < 2 else 3] = _continuations(x["gram"], x["suffix"], x["suffix_context"])
    parts[2, 2] = _continuations(x["suffix"], x["low"], x["low_context"])
    parts[2, 1] = _continuations(x["low"], x["unit"], np.zeros_like(x["unit"]))
    return _model(lambda kind, order: parts[kind, order])


def orders(counted: DataFrame) -> DataFrame:
    """``kind, order, gram, context, n`` of every order of the models, from what :func:`_counted` gives."""
    names = [c.split()[0] for c in _COUNTS.split(", ")][2:-1]
    # an n-gram's key decides its other fields, so all are grouped by: numbers alone, which need no sort
    whole = materialise(counted.groupBy("kind", "gram", *names).agg(F.sum("n").alias("n")), "grams")
    top = whole.filter("kind < 2").select("kind", F.lit(5).alias("order"), "gram", "context", "n")
    one_up = materialise(whole.groupBy("kind", *names[1:]).agg(F.count("*").alias("n")), "suffixes")
    low = one_up.filter("kind = 2").groupBy("kind", "low", "low_context", "unit").agg(F.count("*").alias("n"))
    unit = low.groupBy("kind", F.col("unit").alias("gram")).agg(F.count("*").alias("n"))
    out = top.unionByName(one_up.select("kind", F.when(F.col("kind") < 2, 4).otherwise(3).alias("order"), F.col("suffix").alias("gram"), F.col("suffix_context").alias("context"), "n"))
    out = out.unionByName(low.select("kind", F.lit(2).alias("order"), F.col("low").alias("gram"), F.col("low_context").alias("context"), "n"))
    out = materialise(out.unionByName(unit.select("kind", F.lit(1).alias("order"), "gram", F.lit(0).cast("long").alias("context"), "n")), "orders")
    release(whole, one_up)
    return out


def collected(found: DataFrame) -> dict:
    """The tables of the models on the driver, from :func:`orders`."""
    rows = found.toArrow()

    def of(kind: int, order: int) -> tuple:
        own = rows.filter(pc.and_(pc.equal(rows["kind"], kind), pc.equal(rows["order"], order)))
        return own["gram"].to_numpy(), own["context"].to_numpy(), own["n"].to_numpy().astype(np.float64)

    return _model(of)


def word_ratios(model: dict, words: list[str]) -> np.ndarray:
    """log of toxic to ordinary likelihood of each word."""
    keys, word_of = _rolling(words)
    shared = model["one"][keys["g1"]]
    for (share, left), g, h in ((model["two"], "g2", "h1"), (model["three"], "g3", "h2")):
        shared = share[keys[g]] + left[keys[h]] * shared
    logs = []
    for top, top_left, middle, middle_left in model["classes"]:
        p = middle[keys["g4"]] + middle_left[keys["h3"]] * shared
        logs.append(np.log(top[keys["g5"]] + top_left[keys["h4"]] * p))
    return np.bincount(word_of, logs[1] - logs[0], len(words))


FEATURES = ("mean_all", "top1", "top2", "top3")

#: Each order's n-gram and context among the keys of a position.
_KEYS = {5: ("g5", "h4"), 4: ("g4", "h3"), 3: ("g3", "h2"), 2: ("g2", "h1"), 1: ("g1", None)}
_ORDERS = [(0, 5), (0, 4), (1, 5), (1, 4), (2, 3), (2, 2), (2, 1)]


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's words without what is around them, and how often they occur; a row without words has one null."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part, cols = batch.slice(a, 256), ([], [], [], [])
            for row, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for w, n in Counter(w.strip(AROUND) for w in tokens(text)).items() or [(None, 0)]:
                    for col, v in zip(cols, (row, doc_id, w, n)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["row", "doc_id", "word", "n"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that each character of each word looks up: place 0 to 6 of _ORDERS, for the n-gram or for the context."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1_000):
            words = batch.column("word").slice(a, 1_000)
            keys, word_of = _rolling(words.to_pylist())
            at, own = pa.array(np.arange(len(word_of), dtype=np.int32)), words.take(pa.array(word_of))
            for place, (_, order) in enumerate(_ORDERS):
                for left, name in enumerate(_KEYS[order]):
                    if name:
                        yield pa.RecordBatch.from_arrays([own, at, pa.array(np.full(len(at), 2 * place + left, np.int32)), pa.array(keys[name])], ["word", "at", "slot", "key"])


def ratios_by_join(found: DataFrame, words: DataFrame) -> DataFrame:
    """``word, ratio`` of the distinct ``words``, as :func:`word_ratios` has them, by joins with the table of :func:`orders`."""
    place = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("order") == o), F.lit(2 * i)) for i, (k, o) in enumerate(_ORDERS)))
    found = found.select(place.alias("slot"), "gram", "context", "n")
    sums = found.groupBy("slot", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    left = F.least(DISCOUNT * F.col("types") / F.col("total"), F.lit(1.0))
    shares = found.join(sums.drop("types"), ["slot", "context"]).select("slot", F.col("gram").alias("key"), (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("value"))
    values = shares.unionByName(sums.filter(F.col("slot") < 12).select((F.col("slot") + 1).alias("slot"), F.col("context").alias("key"), left.alias("value")))
    base = [r[0] for r in sums.filter(F.col("slot") == 12).select(left / CHARACTERS).collect()]
    looked_up = words.mapInArrow(_positions, "word string, at int, slot int, key long").join(values, ["slot", "key"], "left")
    v = [F.coalesce(F.max(F.when(F.col("slot") == i, F.col("value"))), F.lit(float(i % 2))).alias(f"v{i}") for i in range(13)]
    p, c = looked_up.groupBy("word", "at").agg(*v), lambda i: F.col(f"v{i}")
    shared = c(8) + c(9) * (c(10) + c(11) * (c(12) + F.lit(base[0] if base else 1 / CHARACTERS)))
    logs = [F.log(c(i) + c(i + 1) * (c(i + 2) + c(i + 3) * shared)) for i in (0, 4)]
    return p.select("word", (logs[1] - logs[0]).alias("ratio")).groupBy("word").agg(F.sum("ratio").alias("ratio"))


def evidence_by_join(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``row, doc_id`` and the evidence of ``rows`` (``row, doc_id, text``), by joins with the table of :func:`orders`."""
    held = materialise(rows.mapInArrow(_stripped, "row long, doc_id long, word string, n long"), "words")
    ratios = materialise(ratios_by_join(found, held.select("word").filter("word <> ''").distinct()), "ratios")
    r, n = F.coalesce("ratio", F.lit(0.0)), F.col("n")
    each = held.join(ratios, "word", "left")
    most = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat(r, F.least(n, F.lit(3)).cast("int")))), False), 1, 3)
    each = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.try_divide(F.sum(r * n), F.sum(n)).alias("mean_all"), most.alias("most"))
    top = [F.aggregate(F.slice("most", 1, k), F.lit(0.0), lambda a, b: a + b) / k for k in (1, 2, 3)]
    return each.select("row", "doc_id", F.coalesce("mean_all", F.lit(0.0)).alias("mean_all"), *(t.alias(f) for t, f in zip(top, FEATURES[1:])))


class Evidence:
    """Evidence of texts; remembers the ratios of words."""

    def __init__(self, tables: dict):
        self.tables, self.memo = tables, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        docs, memo = [tokens(t) for t in texts], self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = list({w for d in docs for w in d if w not in memo})
        inner = [w.strip(AROUND) for w in new]
        memo[""] = 0.0
        unseen = [w for w in set(inner) if w not in memo]  # many words differ only in what is around them
        for b in range(0, len(unseen), 8_000):
            some = unseen[b : b + 8_000]
            memo.update(zip(some, word_ratios(self.tables, some).tolist()))
        memo.update(zip(new, map(memo.__getitem__, inner)))
        out = np.zeros((len(docs), len(FEATURES)))
        for i, d in enumerate(docs):
            if d:
                r = np.fromiter(map(memo.__getitem__, d), np.float64, len(d))
                best = np.sort(np.partition(r, max(0, len(r) - 3))[-3:])[::-1]
                out[i] = r.mean(), best[0], best[:2].sum() / 2, best.sum() / 3
        return out


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = evidence(part.column("text").to_pylist())
                cols = [part.column("doc_id"), *(pa.array(out[:, k]) for k in range(len(FEATURES)))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *FEATURES])

    return run


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, by Newton's method on standardised columns."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty * len(x)] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)


def labelled_sample(labels: DataFrame, held_out_mod: int = 3, held_out: int = 1, most: int = LABELLED_DOCS) -> dict[int, tuple[int, bool]]:
    """Class by id of the sample, and whether the row is for the regression; at most 2 * ``most`` rows."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder("doc_id", held_out_mod) != held_out))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    one = one.withColumn("h", F.xxhash64("doc_id", F.lit(4)))
    found = {}
    for c in (0, 1):
        for r in one.filter(F.col("toxic") == c).orderBy("h", "doc_id").limit(most).collect():
            found[r.doc_id] = (c, r.h % FIT_ONE_IN == 0)
    return found


def _rows(docs: DataFrame, *others: str) -> DataFrame:
    return docs.select(*others, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _of_evidence(model, rows: DataFrame) -> DataFrame:
    if isinstance(model, DataFrame):
        return evidence_by_join(model, rows.withColumn("row", F.monotonically_increasing_id())).drop("row")
    return rows.mapInArrow(_evidence(model), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def train(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS, broadcast_grams: int = BROADCAST_GRAMS):
    """The tables of the models (broadcast, or where they are large the DataFrame), and weights and intercept of the score.

    The shared counts come from all of ``docs``, the counts of the classes and the regression from the
    sample of labelled rows. With rows of only one class the weights are zero and the intercept infinite.
    """
    spark, rows = docs.sparkSession, _rows(docs)
    sample = labelled_sample(labels, most=labelled_docs)
    counted = {d: c for d, (c, fits) in sample.items() if not fits}
    classes = spark.sparkContext.broadcast(counted)
    model = orders(rows.mapInArrow(_counted(classes), _COUNTS))
    if model.count() <= broadcast_grams:
        found, model = model, spark.sparkContext.broadcast(collected(model))
        release(found)
    fitting = {d: c for d, (c, fits) in sample.items() if fits}
    if len(set(fitting.values())) < 2 or len(set(counted.values())) < 2:
        fitting = {d: c for d, (c, _) in sample.items()}
    none = np.zeros(len(FEATURES))
    if not fitting:
        return model, none, -np.inf
    wanted = spark.createDataFrame(sorted(fitting.items()), "doc_id long, toxic int")
    found = _of_evidence(model, rows.join(F.broadcast(wanted), "doc_id", "left_semi"))
    found = found.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")  # at most one row of each of the sample
    toxic = found.doc_id.map(fitting).to_numpy(float)
    if len(set(toxic)) < 2:
        return model, none, np.inf if toxic.any() else -np.inf
    return model, *_regression(found[list(FEATURES)].to_numpy(), toxic)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, labelled_docs: int = LABELLED_DOCS, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the evidence of every whole text.

    Labels are learnt from rows whose crc32(id as text) mod 3 is not 1; of repeated labels the larger
    counts, others than 0 and 1 are left out. A null or empty text, or one without words, has no evidence:
    zeros, which score as such. Repeated rows are scored alike, each on its own; a null id is never held
    out. With rows of only one class to learn from, every score is that class, without any it is 0. Other
    columns are not read.
    """
    model, weights, intercept = train(docs, labels, labelled_docs, broadcast_grams)
    z = F.lit(float(np.clip(intercept, -1e6, 1e6)))
    for name, w in zip(FEATURES, weights.tolist()):
        z = z + F.col(name) * F.lit(w)
    value = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    out = _of_evidence(model, _rows(docs)).select("doc_id", held_out.alias("held_out"), F.round(value, 12).alias("score"), *FEATURES)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic."""
    model, weights, intercept = train(docs, labels, broadcast_grams=broadcast_grams)
    # score >= threshold where the weighted evidence is at least this
    least = np.log(threshold / (1 - threshold)) - intercept
    if isinstance(model, DataFrame):
        kept = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
        found = evidence_by_join(model, _rows(kept, "_row").withColumnRenamed("_row", "row"))
        value = sum((F.col(f) * F.lit(w) for f, w in zip(FEATURES, weights.tolist())), F.lit(0.0))
        return kept.join(found.filter(value >= F.lit(float(least))).select(F.col("row").alias("_row")), "_row", "left_anti").select(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                toxic = evidence([t or "" for t in part.column("text").to_pylist()]) @ weights >= least
                yield part.filter(pa.array(~toxic))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
