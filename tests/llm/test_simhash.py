from __future__ import annotations

import random

import numpy as np
import xxhash

from roadstats.llm.components import connected_components
from roadstats.llm.simhash import _blocks, _masks, fingerprint, link_lists, near_links, simhash_components

from .conftest import ODD


def by_hand(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_fingerprint():
    texts = [t for _, t in ODD] + ["A b C d É ü", "a\x0bb\x0cc  d", "a b", "ÀB c"]
    assert [fingerprint(t) for t in texts] == [by_hand(t) for t in texts]


def near_prints(seed, n):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


def test_links_find_every_class(spark):
    prints = near_prints(1, 600)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    links = near_links(spark.createDataFrame(signed, "fp long")).collect()
    at = {x[0]: i for i, x in enumerate(signed)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 * 64
        parent[find(at[a])] = find(at[b])
    assert same_partition([find(i) for i in range(len(prints))], classes_by_hand(prints))


def test_every_number_of_blocks_covers_three_bits():
    rng = random.Random(2)
    for n in (2, 1 << 10, 1 << 20, 1 << 25, 1 << 32):
        masks = _masks(*_blocks(n, 3))
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(diff & m == 0 for m in masks)


def test_long_lists_are_looked_up(monkeypatch):
    """A list longer than 2**13: neighbours instead of a sweep, with the same classes."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    free = rng.sample(range(64), 16)
    prints = sorted({base ^ sum(1 << b for b in free if rng.random() < 0.5) for _ in range(9000)})[:9000]
    fp = np.array(prints, np.uint64)
    zero = np.zeros(len(fp), np.int64)
    a, b = link_lists(zero, zero, fp, 3)
    assert (np.bitwise_count(a ^ b) >= 0).all()
    # A dense ball is one class: every member but the smallest is linked to it.
    assert len(b) == len(fp) - 1 and len(set(a.tolist())) == 1


def test_components_of_documents(documents):
    words = [f"word{i}" for i in range(400)]
    near = " ".join([*words[:399], "other"])
    far = " ".join(f"else{i}" for i in range(400))
    rows = [(9, " ".join(words)), (4, near), (7, far), (8, far), (2, None), (3, ""), (5, " \n")]
    found = {r["doc_id"]: r for r in simhash_components(documents(*rows)).collect()}
    prints = {i: by_hand(t) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == prints
    expected = classes_by_hand(list(prints.values()))
    assert same_partition([found[i]["component_id"] for i in prints], expected)
    assert found[8]["component_id"] == 7 and found[5]["component_id"] == 2
    assert same_partition([found[i]["root"] for i in prints], expected)


def test_odd_rows_and_empty_table(documents):
    rows = simhash_components(documents(*ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    assert simhash_components(documents((1, "x")).limit(0)).count() == 0


def test_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1400)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a long, b long")
    found = dict(connected_components(edges).collect())
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
