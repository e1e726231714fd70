"""The Merkle manifest against a plain tree in Python, and against its SQL."""

import hashlib
import zlib

import pytest
from compare import compare, connect

from tessera.llm import merkle
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(digests, fan=16):
    """(top, for every leaf its siblings as (left, right) by level)."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // fan * fan
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + fan])))
        level, at = [h(*level[r : r + fan]) for r in range(0, len(level), fan)], [p // fan for p in at]
    return level[0], paths


def brute(rows, fan=16):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan) for s in names}
    root, tops = tree([built[s][0] for s in names], fan)
    out = []
    for s, top in zip(names, tops):
        for (_, _, leaf, row), path in zip(sorted(groups[s], key=lambda x: x[:3]), built[s][1]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            lower = row[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
            folded = leaf_of(row, lower) if hit else leaf
            for left, right in path + top:
                folded = h(left, folded, right)
            proof = h(*(left + right for left, right in path + top))
            out.append((row[0], leaf, built[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_sql(spark):
    query, sql = QUERIES["op13_merkle"]
    assert compare(query(spark, SF), connect(SF), sql)[2] is None


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 16, 17], [300, 1, 256, 257], [1] * 40])
def test_brute_force(spark, sizes):
    rows = []
    for s, n in enumerate(sizes):
        source = None if s == 1 else f"sé{s}" if s % 2 else f"S{s}"
        rows += [((7 * i + 3 * s) % 500 if i % 50 else None, None if i % 11 == 3 else "" if i % 11 == 5 else f"Text É {i % 90}", "en", source, i % 90) for i in range(n)]
    rows += rows[: len(rows) // 3]  # repeated rows
    rows.append((9, "Ä" * 300_000, None, "S0", 300_000))
    found = merkle.checked(spark.createDataFrame(rows, DDL).repartition(5))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_other_fan_and_distance_of_levels(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 2}", 1) for i in range(70)]
    docs = spark.createDataFrame(rows, DDL)
    for every in (1, 2, 3):
        made = merkle.build(docs, fan=3, every=every)
        ok = made.proofs().withColumn("folded", merkle.fold("leaf"))
        assert {r["folded"] for r in ok.collect()} == {made.root} == {brute(rows, 3)[0][3]}
        assert len(made.groups) == 1 + -(-4 // every)  # 35 leaves: levels 1 to 4, of which every n-th is stored


def test_empty_and_clashing_columns(spark):
    assert merkle.checked(spark.createDataFrame([], DDL)).collect() == []
    rows = [(i, f"T{i}", "en", f"s{i % 2}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DDL)
    odd = docs
    for name in ("g", "p", "d", "m", "sub", "top", "path", "grp", "key", "leaf", "root", "part", "first", "n", "tie", "o1", "c_again", "given", "name"):
        odd = odd.selectExpr("*", f"'x' as `{name}`")
    assert sorted(map(tuple, merkle.checked(odd).collect()), key=repr) == brute(rows)
