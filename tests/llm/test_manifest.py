from __future__ import annotations

import hashlib
import zlib

import pytest

from roadstats.llm import manifest
from roadstats.llm.manifest import document_manifest, merkle_manifest, ranked
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, fan=3):
    """Root, and each leaf's steps as (left, right) lists."""
    nodes, under, steps = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = range(0, len(nodes), fan)
        for i in runs:
            run = nodes[i : i + fan]
            for k, held in enumerate(under[i : i + fan]):
                for x in held:
                    steps[x].append((run[:k], run[k + 1 :]))
        nodes, under = [digest(*nodes[i : i + fan]) for i in runs], [sum(under[i : i + fan], []) for i in runs]
    return nodes[0], steps


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for held in groups.values():
        held.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = [tree([leaf(r, r["text"]) for r in groups[s]]) for s in names]
    root, upper = tree([t[0] for t in trees])
    out = []
    for s, (subroot, ways), above in zip(names, trees, upper, strict=True):
        for r, way in zip(groups[s], ways, strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in way + above:
                folded = digest(*left, folded, *right)
            proof = digest(*[d for left, right in way + above for d in left + right])
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = document_manifest(docs).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(docs.collect())
    assert 0 < sum(r["verified"] for r in found) < len(found)


def test_odd_rows(documents):
    docs = documents(*ODD, (9, "a\nb", "de", "s"), (10, "a\nb", "de", "S"), (11, "a\nb", "de", ""))
    found = document_manifest(docs).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(docs.collect())


@pytest.mark.parametrize("n", [0, 1, 28])
def test_several_rounds(spark, monkeypatch, n):
    # Blocks of three rows: a tree of 28 leaves takes four rounds.
    monkeypatch.setattr(manifest, "BLOCK", 3)
    rows = [(i // 20, i, digest(str(i))) for i in range(n)]
    frame = spark.createDataFrame(rows, "source string, id long, leaf string")
    found = {r["leaf"]: r for r in merkle_manifest(frame, "source", "id").collect()}
    assert len(found) == n
    if n:
        trees = [tree([r[2] for r in rows if r[0] == g]) for g in sorted({r[0] for r in rows})]
        root, upper = tree([t[0] for t in trees])
        for (_, ways), above, g in zip(trees, upper, (0, 1)):
            for r, way in zip([r for r in rows if r[0] == g], ways, strict=True):
                steps = [(s["left"], s["right"]) for s in found[r[2]]["steps"]]
                assert steps == [("".join(a), "".join(b)) for a, b in way + above]
                assert found[r[2]]["root"] == root


def test_other_fans_and_other_columns(spark):
    rows = [("g", i, digest(str(i)), "own") for i in range(11)]
    frame = spark.createDataFrame(rows, "source string, id long, leaf string, root string")
    for fan in (2, 5):
        found = merkle_manifest(frame, "source", "id", fan).collect()
        assert {r["root"] for r in found} == {tree([r[2] for r in rows], fan)[0]}


def test_any_change_shows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = document_manifest(docs).first()["root"]
    for column, value in (("lang", "'xx'"), ("text", "text || ' '")):
        changed = docs.selectExpr(*[f"if(doc_id = 7, {value}, {c}) AS {c}" if c == column else c for c in docs.columns])
        assert document_manifest(changed).first()["root"] != whole
    assert document_manifest(docs.filter("doc_id <> 7")).first()["root"] != whole


def test_a_group_with_most_rows_is_ranked_in_parts(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 < 2, 'hot', concat('g', id % 7)) AS g", "(id * 7919) % 5000 AS k")
    found = ranked(rows, "g", ["k"], "test").collect()
    held = {}
    for r in found:
        held.setdefault(r["g"], []).append((r["k"], r["_pos"], r["_size"]))
    for places in held.values():
        places.sort()
        assert [p[1] for p in places] == list(range(len(places))) and {p[2] for p in places} == {len(places)}
