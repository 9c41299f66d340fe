"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its word shingles; one hash function orders all shingles, and a sketch is the k
least of a set. Documents of equal sets form one class, whose links need no comparison. Inverted lists of
retained values give the candidates: of its sketch a class enters the lists of its rarest values only, as
many as two similar sets can differ in and some more, so that two similar classes meet in a list while
those that share no more than a frequent passage don't. Candidates pass if the sketch of the union, formed
from both sketches, estimates a similarity not far below the threshold; exact sets then confirm links.

A list is no clique to expand. Each round compares the members of a list with one centre only, and lists
whose members have come together in one component are done. Of what is left after the rounds, the members
of short lists are compared pair by pair. Those of longer lists are written as their differences from the
list's centre, and as the difference of two sets follows exactly from their differences from a third,
blocks of members are compared by these short arrays alone; a block yields a spanning forest of its links,
not the links. So no link between components is lost, and no group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, release, small_or_shuffled, table, unused_names
from gridloom.llm.components import components, spanning

SHINGLE_WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Values of a sketch, and how many of them, the rarest, a set of more shingles than the sketch holds is
#: listed under. Two such sets at the threshold differ in about 5 of 32 values, with a deviation of 2.
SKETCH, LISTED = 32, 16
#: Deviations by which the estimate may stay below the threshold.
DEVIATIONS = 5.0
#: Rounds with one centre a list, members of a list that is short, and members of a block of longer ones.
ROUNDS, SHORT, BLOCK = 2, 32, 256
#: Documents compared with one copy of a centre.
PER_CENTRE = 400
MEMO_WORDS = 50_000
#: Texts of a batch.
BATCH = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct hashes of a text's shingles."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and ASCII white space
        if not found:
            return np.zeros(0, np.int64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        k = self.words if len(h) >= self.words else len(h)
        n = len(h) - k + 1
        x = np.full(n, k, np.uint64)
        for i in range(k):
            x = (x ^ h[i : i + n]) * _MIX
            x ^= x >> np.uint64(29)
        x = (x * np.uint64(0xBF58476D1CE4E5B9)) ^ (x >> np.uint64(32))
        return np.unique(x.view(np.int64))


_SKETCHED = "doc_id long, text_hash long, bytes long, n_shingles long, sig_a long, sig_b long, sketch array<long>"


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part, n, sig_a, sig_b, sketch = batch.slice(a, BATCH), [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    n.append(len(s))
                    sig_a.append(digest[0])
                    sig_b.append(digest[1])
                    sketch.append(s[:SKETCH])
                cols = [*(part.column(c) for c in ("doc_id", "text_hash", "bytes")), pa.array(n, pa.int64()), pa.array(sig_a, pa.int64()), pa.array(sig_b, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SKETCHED.split(", ")])

    return run


def _with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).cast("long").alias("bytes"), text.alias("text"))


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the sketch of the union: the share of its values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


class _Join:
    """One run of the operator: its tables and thresholds."""

    def __init__(self, docs: DataFrame, words: int, numerator: int, denominator: int):
        self.words, self.numerator, self.denominator = words, numerator, denominator
        t = numerator / denominator
        # a set that fits its sketch needs no estimate: the error stays below that of a full sketch
        self.least = max(0.0, t - DEVIATIONS * (t * (1 - t) / SKETCH) ** 0.5)
        self.docs = _with_keys(docs)
        self.rows = materialise(self.docs.mapInArrow(_sketched(words), _SKETCHED).withColumn("row", F.monotonically_increasing_id()), "sketched")
        set_key = ["n_shingles", "sig_a", "sig_b"]
        least = F.min(F.struct("row", "text_hash", "bytes", "sketch"))
        classes = self.rows.filter("n_shingles > 0").groupBy(*set_key).agg(least.alias("m"))
        self.classes = materialise(classes.select(*set_key, F.col("m.row").alias("node"), F.col("m.text_hash").alias("text_hash"), F.col("m.bytes").alias("bytes"), F.col("m.sketch").alias("sketch")), "classes")
        self.edges: list[DataFrame] = []

    def index(self) -> DataFrame:
        """(value, node, n_shingles): a class in the lists of its rarest values, without lists of one member."""
        values = self.classes.select("node", "n_shingles", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
        # written before it is joined back: only a join of plain shuffles is split where a value is frequent
        shared = materialise(values.groupBy("value").agg(F.count("*").alias("f")).filter("f > 1"), "shared")
        met = values.join(small_or_shuffled(shared), "value").groupBy("node", "n_shingles", "k").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("met"))
        n = F.col("n_shingles")
        differing = n - F.expr(f"cast((n_shingles * {self.numerator} + {self.denominator - 1}) div {self.denominator} as long)") + 1
        # sets whose partners fit their sketches too: the differing shingles and one more are always enough
        wanted = F.when(n * self.denominator <= SKETCH * self.numerator, differing).otherwise(F.lit(LISTED))
        alone = F.col("k") - F.size("met")  # values that no other class has are rarer than all others
        taken = F.greatest(F.lit(0), wanted - alone).cast("int")
        listed = met.withColumn("taken", taken).filter("taken > 0").select("node", "n_shingles", F.explode(F.slice("met", F.lit(1), F.col("taken"))).alias("m"))
        index = materialise(listed.select(F.col("m.value").alias("value"), "node", "n_shingles"), "index")
        release(shared)
        return index

    def active(self, index: DataFrame, component: DataFrame | None) -> DataFrame:
        """Index rows with their components, of lists whose members are not all in one, as a table."""
        if component is None:
            known = index.withColumn("component", F.col("node"))
        else:
            known = index.join(small_or_shuffled(component), "node", "left").withColumn("component", F.coalesce("component", "node"))
        centre = F.min(F.struct(F.xxhash64("node", F.lit(17 * len(self.edges))).alias("h"), "node", "n_shingles", "component")).alias("centre")
        known = materialise(known, "known")
        several = known.groupBy("value").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), centre).filter("low < high")
        several = materialise(several.drop("low", "high"), "several")
        active = materialise(known.join(small_or_shuffled(several), "value"), "active")
        release(known, several)
        return active

    def similar_sizes(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * self.denominator >= F.greatest(n, m) * self.numerator

    def star_pairs(self, active: DataFrame) -> DataFrame:
        met = active.filter(F.col("centre.component") != F.col("component")).filter(self.similar_sizes(F.col("n_shingles"), F.col("centre.n_shingles")))
        pairs = met.select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()
        sketch = self.classes.select("node", "sketch")
        pairs = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("s")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("t")), "b")
        return materialise(pairs.filter(estimate(F.col("s"), F.col("t")) >= self.least).select("a", "b"), "pairs")

    def short_pairs(self, active: DataFrame) -> DataFrame:
        """All pairs of different components in the short lists that are left, which pass the sizes and the estimate."""
        rows = active.filter(F.col("members") <= SHORT).select("value", "node", "n_shingles", "component")
        rows = rows.join(self.classes.select("node", "sketch"), "node")
        ordered = rows.repartition("value").sortWithinPartitions("value")
        return materialise(ordered.mapInArrow(_short_pairs(self.numerator, self.denominator, self.least), "a long, b long").distinct(), "pairs")

    def long_links(self, active: DataFrame) -> DataFrame:
        """A spanning forest of the links between components in the long lists that are left."""
        met = active.filter(F.col("members") > SHORT).select(F.col("centre.node").alias("a"), F.col("node").alias("b"), "n_shingles", "component")
        met = materialise(met.distinct(), "members")
        blocks = met.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
        ordered, texts = self.texts_by_centre(met.select("a", "b"))
        deltas = ordered.mapInArrow(_deltas(self.words), "a long, b long, delta array<long>").dropDuplicates(["a", "b"])
        rows = deltas.join(met, ["a", "b"]).join(blocks, "a").withColumn("own", F.pmod(F.xxhash64("b", F.lit(5)), F.col("blocks")).cast("int"))
        rows = materialise(rows, "deltas")
        release(texts, met)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = rows.select("a", "b", "n_shingles", "component", "own", "delta", other)
        dealt = dealt.select("a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "b", "n_shingles", "component", "delta")
        ordered = dealt.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
        edges = materialise(ordered.mapInArrow(_block_links(self.numerator, self.denominator), "u long, v long"), "confirmed")
        release(rows)
        return edges

    def texts_by_centre(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, b, text) in groups of a bounded number of pairs with one centre (a), whose own text leads with
        a null b, and the table of texts to release."""
        busy = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > PER_CENTRE)
        groups = pairs.join(busy, "a", "left").withColumn("g", F.pmod(F.xxhash64("b"), F.coalesce(F.expr(f"cast(ceil(n / {PER_CENTRE}) as long)"), F.lit(1))))
        groups = groups.select("a", "b", "g")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = materialise(self.classes.select("node", "text_hash", "bytes").join(nodes, "node"), "wanted")
        texts = self.docs.select("text_hash", "bytes", "text").join(small_or_shuffled(wanted), ["text_hash", "bytes"]).select("node", "text")
        # of the copies of a text one is enough; what is dropped is equal
        texts = materialise(texts.dropDuplicates(["node"]), "texts")
        release(wanted)
        side = groups.join(texts.withColumnRenamed("node", "b"), "b").select("a", "g", "b", "text")
        head = groups.select("a", "g").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "g", F.lit(None).cast("long").alias("b"), "text")
        return side.unionByName(head).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first()), texts

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose exact similarity reaches the threshold."""
        ordered, texts = self.texts_by_centre(pairs)
        edges = materialise(ordered.mapInArrow(_confirmed(self.words, self.numerator, self.denominator), "u long, v long"), "confirmed")
        release(texts)
        return edges

    def component(self) -> DataFrame:
        edges = self.edges[0]
        for e in self.edges[1:]:
            edges = edges.unionByName(e)
        return materialise(components(edges), "components")

    def run(self) -> DataFrame:
        index, component = self.index(), None
        for step in range(ROUNDS + 1):
            active = self.active(index, component)
            if active.isEmpty():
                release(active)
                break
            pairs = self.star_pairs(active) if step < ROUNDS else self.short_pairs(active)
            self.edges.append(self.confirm(pairs))
            if step == ROUNDS and not active.filter(F.col("members") > SHORT).isEmpty():
                self.edges.append(self.long_links(active))
            release(active, pairs, component)
            component = self.component()
        release(index)
        nodes = self.classes.select("n_shingles", "sig_a", "sig_b", "node")
        if component is not None:
            nodes = nodes.join(component, "node", "left")
        else:
            nodes = nodes.withColumn("component", F.lit(None).cast("long"))
        nodes = materialise(nodes.select("n_shingles", "sig_a", "sig_b", F.coalesce("component", "node").alias("group")), "nodes")
        base = self.rows.select("doc_id", "text_hash", "bytes", "n_shingles", "sig_a", "sig_b", "row")
        grouped = materialise(base.join(small_or_shuffled(nodes), ["n_shingles", "sig_a", "sig_b"], "left").withColumn("group", F.coalesce("group", "row")).drop("sig_a", "sig_b"), "grouped")
        release(self.rows, self.classes, nodes, component, *self.edges)
        return grouped


def _grouped_rows(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows with equal keys, of batches sorted by them."""
    now, rows = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in key))
        for k, r in zip(keys, zip(*(batch.column(c).to_pylist() for c in columns))):
            if k != now:
                if rows:
                    yield rows
                now, rows = k, []
            rows.append(r)
    if rows:
        yield rows


def _short_pairs(numerator: int, denominator: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = set(), []
        for rows in _grouped_rows(batches, ("value",), ("node", "n_shingles", "component", "sketch")):
            sets = [set(r[3]) for r in rows]
            for p, (node, n, component, _) in enumerate(rows):
                for q in range(p):
                    other, m, its, _ = rows[q]
                    if its == component or min(n, m) * denominator < max(n, m) * numerator or (min(node, other), max(node, other)) in a:
                        continue
                    both = sets[p] & sets[q]
                    if len(both) >= least * SKETCH or max(n, m) < SKETCH:
                        union = sorted(sets[p] | sets[q])[:SKETCH]
                        if sum(x in both for x in union) >= least * len(union):
                            pair = min(node, other), max(node, other)
                            a.add(pair)
                            b.append(pair)
            if len(b) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*b)], ["a", "b"])
                b = []
            if len(a) > 500_000:
                a.clear()
        if b:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*b)], ["a", "b"])

    return run


def _deltas(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, centre = Shingler(words), None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part, out = batch.slice(at, BATCH), []
                for a, b, text in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text"))):
                    if b is None:
                        centre = shingles(text)
                    else:
                        out.append((a, b, np.setxor1d(centre, shingles(text), assume_unique=True)))
                if out:
                    cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays(cols, ["a", "b", "delta"])

    return run


def common_counts(arrays: list[np.ndarray]) -> np.ndarray:
    """How many values each two arrays of distinct values share (the diagonal: 0)."""
    n = len(arrays)
    both = np.zeros((n, n), np.int32)
    owners = np.repeat(np.arange(n), [len(x) for x in arrays])
    values = np.concatenate(arrays) if n else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]):
        if e - s > 1:
            members = owners[s:e]
            both[members[:, None], members] += 1
    np.fill_diagonal(both, 0)
    return both


def _block_links(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped_rows(batches, ("a", "i", "j"), ("own", "b", "n_shingles", "component", "delta")):
            own, nodes, sizes, comps = (np.array(x, np.int64) for x in list(zip(*rows))[:4])
            if comps.min() == comps.max():
                continue
            deltas = [np.array(r[4], np.int64) for r in rows]
            lengths = np.array([len(d) for d in deltas])
            apart = np.add.outer(lengths, lengths) - 2 * common_counts(deltas)  # of the symmetric difference
            total = np.add.outer(sizes, sizes)
            linked = ((total - apart) * denominator >= (total + apart) * numerator) & (comps[:, None] != comps[None, :])
            if own.min() != own.max():
                linked &= own[:, None] != own[None, :]
            i, j = np.nonzero(np.triu(linked, 1))
            root = spanning(len(rows), i, j)
            at = np.flatnonzero(root != np.arange(len(rows)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], ["u", "v"])

    return run


def _confirmed(words: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, centre, now = Shingler(words), None, None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part, found = batch.slice(a, BATCH), []
                for key, b, text in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("text").to_pylist()):
                    if b is None:
                        centre, now = shingles(text), key
                        continue
                    assert key == now
                    s = shingles(text)
                    common = len(np.intersect1d(centre, s, assume_unique=True))
                    if common * denominator >= (len(centre) + len(s) - common) * numerator:
                        found.append((key, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    return run


def groups(docs: DataFrame, words: int = SHINGLE_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, bytes, n_shingles, row`` and its ``group``, a number."""
    return _Join(docs, words, numerator, denominator).run()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer words than a shingle is one
    shingle. A null or empty text, or one without words, has no shingles and links with nothing. Repeated
    rows are documents of their own with equal sets. A row with a null id belongs to its group, whose
    component is the least id that is not null, or null. Other columns are not read.
    """
    grouped = groups(docs, words, numerator, denominator)
    least = materialise(grouped.groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")
    out = grouped.join(small_or_shuffled(least), "group").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one stays in each group: that of the least id.

    Rows without shingles all stay. Of repeated rows one stays.
    """
    grouped = groups(docs, words, numerator, denominator)
    key = ["doc_id", "text_hash", "bytes"]
    first = F.struct(F.col("doc_id").isNull().alias("null"), *key)
    lone = grouped.filter("n_shingles = 0").select(*key).distinct().withColumn("many", F.lit(False))
    stay = grouped.filter("n_shingles > 0").groupBy("group").agg(F.min(first).alias("m")).select("group", *(F.col(f"m.{c}").alias(c) for c in key))
    stay = materialise(stay, "least")
    # rows that repeat a key of their group can't be told apart; of these a single one is taken below
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in key]
    times = small_or_shuffled(stay).alias("s").join(grouped.alias("g"), (F.col("s.group") == F.col("g.group")) & same[0] & same[1] & same[2])
    stay = times.groupBy("s.group", *(f"s.{c}" for c in key)).agg((F.count("*") > 1).alias("many")).select(*key, "many")
    stay = materialise(stay.unionByName(lone), "stay")
    text = F.coalesce("text", F.lit(""))
    own = unused_names(docs, *key, "many", *(f"stay_{c}" for c in key))
    names = {c: own[c] for c in key}
    keyed = docs.withColumns({names["doc_id"]: F.col("doc_id").cast("long"), names["text_hash"]: F.xxhash64(text), names["bytes"]: F.octet_length(text).cast("long")})
    marked = stay.select(*(F.col(c).alias(own[f"stay_{c}"]) for c in key), F.col("many").alias(own["many"]))
    on = [F.col(names[c]).eqNullSafe(F.col(own[f"stay_{c}"])) for c in key]
    joined = keyed.join(marked, on[0] & on[1] & on[2])
    single = joined.filter(~F.col(own["many"])).select(*docs.columns)
    repeated = joined.filter(F.col(own["many"])).dropDuplicates(list(names.values())).select(*docs.columns)
    return single.unionByName(repeated)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` of all documents with three words and 0.85; its docstring states the odd cases."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, numerator=85, denominator=100)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT n, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), x AS (SELECT n, len(sh) AS size, unnest(sh) AS h FROM s),
c AS (SELECT a.n AS a, b.n AS b, a.size AS sa, b.size AS sb, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.n < b.n GROUP BY a.n, b.n, a.size, b.size),
p AS (SELECT a, b FROM c WHERE 100 * common >= 85 * (sa + sb - common)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT n, n FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS n, min(s.doc_id) AS component_id FROM r JOIN s ON s.n = r.b GROUP BY r.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (n)
"""
