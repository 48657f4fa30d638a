import heapq
import random
import zlib
from collections import defaultdict

import pytest
from cases import ODD, documents, frame

from millrace.llm import sharding


@pytest.mark.parametrize("rows", [documents, ODD, [(i, "same text") for i in range(500)] + [(i, f"t{i}") for i in range(500, 1500)]], ids=["documents", "odd", "hot"])
def test_shards(spark, rows):
    rows = rows(spark) if callable(rows) else rows
    got = sharding.shard_by_bytes(frame(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in rows) == sorted((str(r.doc_id), r.size, r.text_crc32) for r in got)
    slots, together, load = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        together[r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in together.values())
    groups = defaultdict(int)
    for d, t in rows:
        groups[t or ""] += size(t)
    assert sorted(load[s] for s in range(24)) == sorted(plain(groups.values(), 24))


def plain(sizes, shards):
    """Loads by the rule itself, group by group."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_schedule_is_plain_longest_first(shards):
    r = random.Random(shards)
    for most in (1, 3, 40, 3000):
        sizes = [(s, r.randint(1, most)) for s in r.sample(range(1, 500), 30)]
        loads = [0] * shards
        for size, got in sharding.schedule(sizes, shards):
            loads = [load + size * n for load, n in zip(loads, got)]
        assert loads == plain([s for s, n in sizes for _ in range(n)], shards)


def test_many_groups_of_one_size_are_numbered_in_sections(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SECTION_ROWS", 100)
    rows = [(i, f"text {i:05}") for i in range(3000)] + [(7, "same")] * 900
    got = sharding.shard_by_bytes(frame(spark, rows), shards=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 3900 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_table(spark):
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0
