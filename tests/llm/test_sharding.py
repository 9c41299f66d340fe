import random
import zlib
from collections import Counter, defaultdict

from gridloom.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, size string, shard int, row int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", -1, -1) for r in rows], SCHEMA).repartition(5)
    return sharding.shard(df, **kw).collect()


def check(got, rows, shards):
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, total = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


def test_near_equal_bytes_and_whole_groups(spark):
    r = random.Random(1)
    texts = ["é" * r.randrange(1, 300) + str(i) for i in range(3000)]
    rows = [(i, t, r.choice(["en", "de", None]), "hot" if r.random() < 0.4 else f"s{r.randrange(9)}") for i, t in enumerate(texts)]
    rows += [(9000 + i, texts[i % 40], "en", f"s{i % 9}") for i in range(120)]
    got = run(spark, rows, shards=40)
    total = check(got, rows, 40)
    mean, largest = sum(total.values()) / 40, max(x.size for x in got)
    assert all(abs(total[s] - mean) <= 2.5 * 4 * largest for s in range(40))
    shards_of, weight = defaultdict(set), Counter()
    for x in got:
        shards_of[x.text_crc32, x.size].add(x.shard)
        weight[x.text_crc32, x.size] += x.size
    part = sum(total.values()) // (40 * sharding.PARTS_OF_TARGET)
    assert all(len(v) == 1 for k, v in shards_of.items() if weight[k] <= part)
    assert sum(len(v) > 1 for v in shards_of.values()) <= 5


def test_hot_group_is_split_and_stays_close(spark):
    rows = [(i, "copy " * 30, "en", "a") for i in range(1000)] + [(5000 + i, f"text {i} " * 20, "fr", "b") for i in range(1000)]
    got = run(spark, rows, shards=10)
    total = check(got, rows, 10)
    mean = sum(total.values()) / 10
    assert max(total.values()) < 1.15 * mean and min(total.values()) > 0.85 * mean
    assert len({x.shard for x in got if x.doc_id < 5000}) <= 7


def test_weighted_median_against_sort(spark):
    r = random.Random(2)
    items = [(k, r.randrange(1, 50)) for k in r.sample(range(1 << 40), 500)]
    df = spark.createDataFrame([([k, 0, 0, 0], w, 1.0, 0.0, 0.0, 0.0) for k, w in items], "keys array<long>, w long, lang_at double, source_at double, size_at double, id_at double")
    root = sharding.build(df, 2)
    total, below, best = sum(w for _, w in items), 0, None
    for k, w in sorted(items):
        if below + w >= total / 2:
            best = min(abs(below - total / 2), abs(below + w - total / 2))
            break
        below += w
    assert abs(sum(w for k, w in items if k <= root.cut) - total / 2) == best


def test_slots_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    rows = [(i, f"t{i}", "en", "a") for i in range(300)]
    check(run(spark, rows, shards=3), rows, 3)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, None, "x"), (1, "", "en", "x"), (1, "", "en", "x"), (2, "z" * 100_000, None, None)]
    check(run(spark, rows, shards=40), rows, 40)
    assert run(spark, [], shards=40) == []
