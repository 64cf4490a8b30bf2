import hashlib
from collections import Counter

import pytest

from loam.llm import sharding


def brute(names, slots):
    """Turn by turn, from the permutations written out."""
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    walks = [[(h(f"offset:{n}") + j * (h(f"skip:{n}") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    assert all(sorted(w) == list(range(slots)) for w in walks)
    table = {}
    while len(table) < slots:
        for i, w in enumerate(walks):
            if len(table) < slots:
                table.setdefault(next(s for s in w if s not in table), i)
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize("shards,slots", [(1, 7), (3, 13), (7, 101), (13, 13)])
def test_table_is_brute_force_s(shards, slots):
    names = sharding.shard_names(shards)
    table = sharding.lookup_table(names, slots)
    assert table == brute(names, slots)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1


def test_few_keys_move_when_a_shard_goes():
    before, after = (sharding.lookup_table(sharding.shard_names(n), 5003) for n in (20, 19))
    assert sum(a != b for a, b in zip(before, after) if a != 19) < 0.12 * 5003


def test_bad_sizes():
    for names, slots in ((["a"], 8), ([], 7), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_documents(docs):
    ids = [*range(300), None, None, 5, -7, 2**62]
    got = sharding.place_documents(docs([(i, "x") for i in ids]).withColumnRenamed("lang", "slot").withColumnRenamed("source", "shard"), 5, 101).collect()
    table = sharding.lookup_table(sharding.shard_names(5), 101)
    slot = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16) % 101
    assert Counter(map(tuple, got)) == Counter((i, slot(i), table[slot(i)]) for i in ids)
    assert sharding.place_documents(docs([])).count() == 0
