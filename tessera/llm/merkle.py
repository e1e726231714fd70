"""Merkle manifest of a table: a digest tree for each group, a tree over the groups, and proofs for every row.

A row's leaf is the hash of its fields. In each group the leaves ascend by key; every ``FAN`` consecutive nodes of a
level (the last run may be shorter) become their hash until one is left, the group's subroot. The subroots, ascending
by group, become the root in the same way. Digests are lowercase hex SHA-256 and are concatenated as text.

Checkpoint and recompute: only every ``EVERY``-th level is stored. A proof needs the siblings of a row on all levels;
those of the levels between are made again from the stored nodes of their aligned subtree (at most ``FAN ** EVERY``),
used for the proofs of this subtree and given up. What lies above a subtree comes down as one path for all of it.

A position within a group is found without collecting it: rows are range-partitioned by (group, key), and the offset
of a partition is the count of the group's rows in those before. Groups, however large, are thus spread, and no step
holds more than one subtree.

Defined results: a null field hashes as "-", so null and empty texts differ. Null keys come first, a null group is the
first group. Repeated rows are leaves of their own, next to each other; rows of one key are ordered by their leaves.
An empty table has no root (None) and no proofs. Very long texts are hashed whole. Only the named fields are read;
columns of other names, also those that the operator uses itself, neither change the result nor clash with it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAN = 16
EVERY = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of one row's fields: "-" for null, else UTF-8 length, colon, value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def fold(digest_col: str, path_col: str = "path") -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.expr(f"aggregate(`{path_col}`, `{digest_col}`, (below, s) -> sha2(cast(concat(s.left, below, s.right) as binary), 256))")


def siblings(path_col: str = "path") -> Column:
    """All sibling digests of a path as one text, level by level, left to right."""
    return F.expr(f"array_join(transform(`{path_col}`, s -> concat(s.left, s.right)), '')")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``p``: the place (from 0) of every row among those of its group ``g``, by the ``order`` columns."""
    spread = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("m", F.monotonically_increasing_id())
    spread = materialize(spread, "merkle-order")  # the numbering must not be made again by another plan
    part = F.shiftright("m", 33)
    runs = spread.groupBy("g", part.alias("part")).agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (before - F.col("first")).alias("shift"))
    placed = spread.withColumn("part", part).join(runs.hint("merge"), ["g", "part"])
    return placed.withColumn("p", F.col("m") + F.col("shift")).drop("m", "part", "shift", *order)


def _members(nodes: DataFrame, payload: list[str], fan: int, every: int) -> DataFrame:
    """One row for each aligned subtree (g, sub): its stored ``nodes`` in order, and d0 .. d_every, its levels' digests.

    A level of one node that is the whole group is its top and is not hashed again.
    """
    held = ", ".join(["p", "d", *payload])
    made = nodes.groupBy("g", F.expr(f"p div {fan**every}").alias("sub")).agg(F.expr(f"sort_array(collect_list(struct({held})))").alias("m"))
    made = made.withColumn("d0", F.expr("transform(m, x -> x.d)"))
    for t in range(every):
        up = f"transform(sequence(0, (size(d{t}) - 1) div {fan}), j -> sha2(cast(array_join(slice(d{t}, cast(j * {fan} + 1 as int), {fan}), '') as binary), 256))"
        made = made.withColumn(f"d{t + 1}", F.expr(f"if(sub = 0 and size(d{t}) = 1, d{t}, {up})"))
    return made


def _levels(nodes: DataFrame, fan: int, every: int) -> list[DataFrame]:
    """The stored levels of all groups' trees, lowest first, up to the one at which every group has one node."""
    levels = [nodes]
    while levels[-1].agg(F.max("p")).first()[0]:
        up = _members(levels[-1].select("g", "p", "d"), [], fan, every)
        levels.append(materialize(up.select("g", F.col("sub").alias("p"), F.expr(f"element_at(d{every}, 1)").alias("d")), "merkle-level"))
    return levels


def _paths(nodes: DataFrame, payload: list[str], above: DataFrame, fan: int, every: int) -> DataFrame:
    """(g, p, d, payload, path, top) of every node, given those (g, p, path, top) of the next stored level."""
    steps = []
    for t in range(every):
        at = f"(i div {fan**t})"
        left = f"array_join(slice(d{t}, cast({at} - {at} % {fan} + 1 as int), cast({at} % {fan} as int)), '')"
        right = f"array_join(slice(d{t}, cast({at} + 2 as int), cast({fan - 1} - {at} % {fan} as int)), '')"
        steps.append(f"if(sub = 0 and size(d{t}) = 1, cast(array() as {PATH}), array(struct({left} as left, {right} as right)))")
    up = above.select("g", F.col("p").alias("sub"), F.col("path").alias("above"), "top")
    joined = _members(nodes, payload, fan, every).join(up.hint("merge"), ["g", "sub"])
    levels = [f"d{t}" for t in range(every)]
    one = joined.select("g", "sub", "top", "above", *levels, F.posexplode("m").alias("i", "x"))  # the paths of a subtree are never held together
    return one.select("g", "top", *[f"x.{c}" for c in ("p", "d", *payload)], F.expr(f"concat({', '.join(steps)}, above)").alias("path"))


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree over them; the lowest of the first is the leaves."""

    groups: list[DataFrame]
    tops: list[DataFrame]
    root: str | None
    carry: list[str]
    fan: int
    every: int

    def proofs(self) -> DataFrame:
        """Every row: ``group``, ``key``, ``leaf``, carried columns, ``subroot`` and ``path`` (siblings left and right, lowest level first)."""
        highest = self.tops[-1]
        path = highest.select("g", "p", F.expr(f"cast(array() as {PATH})").alias("path"), F.lit("").alias("top"))
        for i in range(len(self.tops) - 2, -1, -1):  # the highest stored level is the root itself
            path = _paths(self.tops[i], ["name"] if i == 0 else [], path, self.fan, self.every)
        if len(self.tops) == 1:
            path = path.join(highest.select("g", "p", "d", "name"), ["g", "p"])
        path = path.select(F.col("name").alias("g"), F.lit(0).cast("bigint").alias("p"), "path", F.col("d").alias("top"))
        payload = ["grp", "key", *self.carry]
        for i in range(len(self.groups) - 2, -1, -1):
            path = _paths(self.groups[i], payload if i == 0 else [], path, self.fan, self.every)
        if len(self.groups) == 1:
            path = self.groups[0].join(path, ["g", "p"])
        return path.select(F.col("grp").alias("group"), "key", F.col("d").alias("leaf"), *self.carry, F.col("top").alias("subroot"), "path")


def build(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", carry: Mapping[str, Column] | None = None, fan: int = FAN, every: int = EVERY
) -> Manifest:
    """The manifest of ``docs``. ``carry`` names columns (not group, key, leaf, subroot, path) that come back with the proofs."""
    carry = dict(carry or {})
    name = F.col(f"`{group}`").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"), name.alias("grp"), F.col(f"`{key}`").alias("key"),
        leaf([F.col(f"`{f}`") for f in fields]).alias("d"), *[c.alias(f"c_{n}") for n, c in carry.items()], F.monotonically_increasing_id().alias("tie"),
    )
    rows = materialize(rows, "merkle-leaves").withColumns({"o1": F.col("key"), "o2": F.col("d"), "o3": F.col("tie")})
    leaves = materialize(_placed(rows.drop("tie"), ["o1", "o2", "o3"]), "merkle-level")
    groups = _levels(leaves, fan, every)
    subroots = groups[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "d", F.col("g").alias("o1"))
    tops = _levels(materialize(_placed(subroots, ["o1"]), "merkle-level"), fan, every)
    root = tops[-1].select("d").first()
    made = Manifest(groups, tops, root and root[0], [f"c_{n}" for n in carry], fan, every)
    return made


def tampered(key: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """(which rows are tampered with, their text): every fifth by CRC-32 of the decimal key, A-Z in lower case; a null key never."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return hit, F.when(hit, F.translate(F.col(f"`{text}`"), letters, letters.lower())).otherwise(F.col(f"`{text}`"))


def checked(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """Proofs of all rows, folded from the rows as tampered with: what a reader of altered rows would find."""
    hit, other = tampered(key, text)
    again = leaf([other if f == text else F.col(f"`{f}`") for f in fields])
    made = build(docs, fields, key, group, {"again": F.when(hit, again)})
    found = made.proofs().withColumn("given", F.coalesce("c_again", "leaf"))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), digest(siblings()).alias("proof_sha256"), fold("given").alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 5) -> str:
    """SQL of ``checked`` over ``documents`` for groups (and numbers of groups) of at most 16 ** levels."""
    part = "coalesce(strlen({0}::varchar) || ':' || {0}, '-')"
    h = "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
    crc = "list_reduce(list_prepend(4294967295::ubigint, [ascii(c)::ubigint for c in string_split(doc_id::varchar, '')]), lambda r, b: list_reduce(list_prepend(xor(r, b), [x::ubigint for x in range(8)]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::ubigint)))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"base AS (SELECT doc_id, coalesce('=' || source, '') AS g, {h.format('text')} AS leaf, {h.format(lower)} AS again, xor({crc}, 4294967295::ubigint) % 5 = 0 AS hit FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS d, '' AS sib, if(hit, again, leaf) AS f FROM base)",
    ]

    def climb(name: str, count: int) -> None:
        for t in range(count):
            n, m = f"{name}{t}", f"{name}{t + 1}"
            ctes.append(f"{n}_n AS (SELECT g, p, any_value(d) AS d FROM {n} GROUP BY g, p)")
            ctes.append(f"{n}_c AS (SELECT g, count(*) AS c FROM {n}_n GROUP BY g)")
            ctes.append(f"{n}_r AS (SELECT g, p // 16 AS q, string_agg(d, '' ORDER BY p) AS run, list(d ORDER BY p) AS ds FROM {n}_n GROUP BY g, p // 16)")
            left, right = "array_to_string(ds[1:p % 16], '')", "array_to_string(ds[p % 16 + 2:], '')"
            ctes.append(
                f"{m} AS (SELECT x.* REPLACE (if(c = 1, p, q) AS p, if(c = 1, d, sha256(run)) AS d, if(c = 1, sib, sib || {left} || {right}) AS sib, "
                f"if(c = 1, f, sha256({left} || f || {right})) AS f) FROM {n} x JOIN {n}_c USING (g) JOIN {n}_r r ON r.g = x.g AND r.q = x.p // 16)"
            )

    climb("a", levels)
    ctes.append(f"b0 AS (SELECT doc_id, leaf, d AS subroot, d, sib, f, '' AS g, dense_rank() OVER (ORDER BY g) - 1 AS p FROM a{levels})")
    climb("b", levels)
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = d AS verified FROM b{levels}"
    )
