import zlib
from collections import defaultdict

from factloom.llm import sharding
from tests.llm.rows import TEXTS, table


def check(rows, texts, shards=8):
    home, slots, load = {}, defaultdict(list), [0] * shards
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            text = (texts[r.doc_id] or "").encode()
            assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
            assert home.setdefault(text, r.shard) == r.shard
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    return load


def test_groups_slots_and_sizes(spark):
    rows = sharding.assign_shards(table(spark)).collect()
    assert len(rows) == len(TEXTS)
    check(rows, {i: t for i, t, *_ in TEXTS})


def test_balance_over_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == len(texts)
    load = check(rows, texts)
    sizes = defaultdict(int)
    for t in texts.values():
        sizes[t] += len(t.encode()) + 1
    # the least loaded shard got the last unit: the spread is at most one unit
    assert max(load) - min(load) <= max(sizes.values())
    assert max(load) <= max(max(sizes.values()), 1.02 * sum(load) / 8)


def test_schedule_is_longest_processing_time():
    sizes = list(enumerate([7, 7, 6, 5, 4, 4, 3, 3, 2, 1]))
    placed = sharding.schedule(sizes, 3)
    load = [0, 0, 0]
    for unit, size in sorted(sizes, key=lambda u: (-u[1], u[0])):
        assert load[placed[unit]] == min(load)
        load[placed[unit]] += size
    assert max(load) == 14


def test_hot_group_is_numbered_in_parts(spark):
    rows = [(i, "hot " * 50, "en", "s") for i in range(600)] + [(1000 + i, f"cold {i}", "en", "s") for i in range(200)]
    got = sharding.assign_shards(table(spark, rows), units=64).collect()
    load = check(got, {i: t for i, t, *_ in rows})
    assert sum(x > 0 for x in load) > 1


def test_a_hot_group_without_ids_is_numbered_in_parts(spark, monkeypatch):
    """Rows that share text and id, or have none, are split by where they are, not left to one task."""
    seen = []
    plain = sharding.in_parts
    monkeypatch.setattr(sharding, "in_parts", lambda *a: seen.append(plain(*a)) or seen[-1])
    rows = [(None, "hot " * 50, "en", "s")] * 500 + [(7, "hot " * 50, "en", "s")] * 300 + [(1000 + i, f"cold {i}", "en", "s") for i in range(100)]
    got = sharding.assign_shards(table(spark, rows).repartition(3), units=64).collect()
    check(got, {i: t for i, t, *_ in rows})
    assert len(got) == 900 and len({r.shard for r in got if r["size"] == 201}) == 1
    sizes = [r["count"] for r in seen[0].where("size = 201").groupBy("unit", "part").count().collect()]
    assert sum(sizes) == 800 and max(sizes) < 60


def test_empty_table(spark):
    assert sharding.assign_shards(table(spark, [])).count() == 0


def test_loads_equal_brute_force(spark):
    """Where every group is large enough to be a unit of its own, loads are those of plain scheduling."""
    import random

    chance = random.Random(4)
    rows = [(i, "x" * chance.choice([3, 17, 40, 41, 90, 200, 333]) + str(chance.randrange(25)), "en", "s") for i in range(300)]
    groups = defaultdict(int)
    for _, t, *_ in rows:
        groups[t] += len(t) + 1
    want = [0] * 5
    for size in sorted(groups.values(), reverse=True):
        want[want.index(min(want))] += size
    load = defaultdict(int)
    for r in sharding.assign_shards(table(spark, rows), shards=5, units=1 << 20).collect():
        load[r.shard] += r["size"]
    assert sorted(load.values()) == sorted(want)
