"""Merkle manifest of a table of documents: leaves by row, a tree for each language, a tree over the languages.

A leaf is the SHA-256 of a row's fields. The leaves of a language, in the order of
doc_id, are hashed two by two, level by level, until one node is left; the nodes left
over, in the order of the languages, are hashed in the same way to the root.

Work goes by aligned blocks of `2 ** BLOCK_LEVELS` neighbours, which make one whole
subtree. An executor gets a block as one Arrow group and DuckDB runs its levels there
(`string_agg` in order, then `sha256`). The roots of all blocks are the nodes of the
next round, so a tree of n leaves takes log2(n) / BLOCK_LEVELS rounds. On the way back
Spark joins each block with the path of its root, and DuckDB adds the siblings within
the block. Only blocks meet in a task, and nothing but the size of the largest tree
reaches the driver.
"""

from __future__ import annotations

import functools

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import forget, written

BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where this divides the checksum of the id, the row is tampered with.
TAMPERED = 7
DIGEST = "sha256"

_NODES = "grp string, size long, pos long, h string"
_PATHS = "grp string, pos long, path array<string>, subroot string, root string"
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(value: Column) -> Column:
    """The bytes of a value in UTF-8, with their number before them; `-` if there is none."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Hash of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, tampered): grp orders the languages, null first; tampered is null where the row is left as it is."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("leaf"),
        F.when(hit, leaf(n_chars=more)).alias("tampered"),
    )


def ranked(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """`rows` with `pos`, the place in its `grp` from 0, and `size`, the rows of the grp; and the largest size.

    Rows are dealt by ranges of (grp, order) and sorted there. Rows that agree in all of
    these are told apart by where they were read, so that no key fills a range alone. A
    table of one row for each range and grp says where the ranges begin.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "_tie").sortWithinPartitions("grp", *order).drop("_tie")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-ranked")
    part = F.shiftright("_at", 33).alias("_part")
    ranges = dealt.groupBy("grp", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("grp")
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    ranges = written(ranges.select("grp", "_part", "_first", before.alias("_before"), F.sum("_n").over(own).alias("size")), "merkle-ranges")
    placed = dealt.withColumn("_part", part).join(ranges, ["grp", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_part", "_at", "_first", "_before"), ranges.agg(F.max("size")).first()[0] or 0


@functools.lru_cache(maxsize=1)
def _engine() -> duckdb.DuckDBPyConnection:
    """One for each worker process; it keeps to memory and to one thread."""
    db = duckdb.connect(":memory:")
    for setting in ("threads = 1", "memory_limit = '400MB'", "temp_directory = ''"):
        _do(db, f"SET {setting}")
    return db


def _do(db: duckdb.DuckDBPyConnection, statement: str, values: list | None = None) -> list[tuple]:
    """Run a statement to its end; a connection takes the next one only then."""
    return db.execute(statement, values or []).fetchall()


def _raise_levels(db: duckdb.DuckDBPyConnection, nodes: pa.Table, size: int, most: int) -> int:
    """Tables level_0, level_1, ... of a block (pos in the block, h), as many as a tree of `size` leaves has within it."""
    db.register("nodes", nodes)
    _do(db, f"CREATE OR REPLACE TEMP TABLE level_0 AS SELECT pos % {1 << most} AS pos, h FROM nodes")
    db.unregister("nodes")
    levels = min(most, (size - 1).bit_length())
    for k in range(levels):
        _do(db, f"CREATE OR REPLACE TEMP TABLE level_{k + 1} AS SELECT pos // 2 AS pos, {DIGEST}(string_agg(h, '' ORDER BY pos)) AS h FROM level_{k} GROUP BY pos // 2")
    return levels


def block_roots(nodes: DataFrame, most: int) -> DataFrame:
    """The root of each block of `nodes`, which are the nodes of the next round."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        size, db = key[1].as_py(), _engine()
        levels = _raise_levels(db, block.select(["pos", "h"]), size, most)
        ((root,),) = _do(db, f"SELECT h FROM level_{levels}")
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "size": pa.array([-(-size >> most)]), "pos": pa.array([key[2].as_py()]), "h": pa.array([root], pa.string())})

    return nodes.select("grp", "size", "pos", "h", F.shiftright("pos", most).alias("block")).groupBy("grp", "size", "block").applyInArrow(run, _NODES)


def climb(nodes: DataFrame, largest: int, most: int) -> list[DataFrame]:
    """The nodes of all rounds; in the last each grp has one."""
    rounds = [nodes]
    while len(rounds) == 1 or largest > 1:
        rounds.append(written(block_roots(rounds[-1], most), "merkle-nodes"))
        largest = -(-largest >> most)
    return rounds


#: The sibling of the node at level k above each row of the block: none, on the left or on the right.
_SIBLING = "LEFT JOIN level_{k} s ON s.pos = xor(p.pos >> {k}, 1)"


def descend(children: DataFrame, parents: DataFrame, most: int) -> DataFrame:
    """Paths of `children`: their siblings within the block, then the path of the block.

    A step is L or R, the side on which the sibling stands, and its hash; `-` where a node has none.
    """

    def run(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        db, parent = _engine(), above.to_pylist()[0]
        levels = _raise_levels(db, block.select(["pos", "h"]), block.column("size")[0].as_py(), most)
        _do(db, "CREATE OR REPLACE TEMP TABLE paths AS SELECT pos, CAST([] AS VARCHAR[]) AS path FROM level_0")
        for k in range(levels):
            step = "CASE WHEN s.h IS NULL THEN '-' WHEN s.pos % 2 = 0 THEN 'L' || s.h ELSE 'R' || s.h END"
            _do(db, f"CREATE OR REPLACE TEMP TABLE paths AS SELECT p.pos, list_append(p.path, {step}) AS path FROM paths p {_SIBLING.format(k=k)}")
        first = key[1].as_py() << most
        return db.sql(
            "SELECT $1::VARCHAR AS grp, p.pos + $2::BIGINT AS pos, list_concat(p.path, $3::VARCHAR[]) AS path, coalesce($4::VARCHAR, l.h) AS subroot, $5::VARCHAR AS root FROM paths p JOIN level_0 l USING (pos)",
            params=[key[0].as_py(), first, parent["path"], parent["subroot"], parent["root"]],
        ).to_arrow_table()

    return _with_parents(children.select("grp", "size", "pos", "h"), parents, most).applyInArrow(run, _PATHS)


def _with_parents(children: DataFrame, parents: DataFrame, most: int):
    above = parents.withColumnRenamed("pos", "block")
    return children.withColumn("block", F.shiftright("pos", most)).groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))


def _proofs(key: tuple, block: pa.Table, above: pa.Table, most: int) -> pa.Table:
    """Siblings and folded root of each row of a block: within it by joins with its levels, above it along its path."""
    db, parent = _engine(), above.to_pylist()[0]
    levels = _raise_levels(db, block.select(["pos", "h"]), block.column("size")[0].as_py(), most)
    db.register("rows", block.select(["pos", "doc_id", "h", "tampered"]))
    _do(db, f"CREATE OR REPLACE TEMP TABLE rows_0 AS SELECT pos % {1 << most} AS pos, doc_id, h AS leaf, coalesce(tampered, h) AS h, '' AS siblings FROM rows")
    db.unregister("rows")
    for k in range(levels):
        fold = f"CASE WHEN s.h IS NULL THEN {DIGEST}(p.h) WHEN s.pos % 2 = 0 THEN {DIGEST}(s.h || p.h) ELSE {DIGEST}(p.h || s.h) END"
        _do(db, f"CREATE OR REPLACE TEMP TABLE rows_0 AS SELECT p.pos, p.doc_id, p.leaf, {fold} AS h, p.siblings || coalesce(s.h, '') AS siblings FROM rows_0 p {_SIBLING.format(k=k)}")
    for step in parent["path"]:
        fold = {"-": "h", "L": "$1::VARCHAR || h", "R": "h || $1::VARCHAR"}[step[0]]
        _do(db, f"CREATE OR REPLACE TEMP TABLE rows_0 AS SELECT * REPLACE ({DIGEST}({fold}) AS h) FROM rows_0", [step[1:]] if step != "-" else [])
    outer = "".join(s[1:] for s in parent["path"])
    return db.sql(
        f"SELECT doc_id, leaf, $1::VARCHAR AS subroot, $2::VARCHAR AS root, {DIGEST}(siblings || $3::VARCHAR) AS proof_sha256, h AS folded_root, h = $2::VARCHAR AS verified FROM rows_0",
        params=[parent["subroot"], parent["root"], outer],
    ).to_arrow_table()


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null doc_id comes before all others, rows with one doc_id in the order of their
    leaves; rows that agree in everything are leaves of their own. A null language is a
    tree of its own, before the others, as is an empty one. A tampered row whose n_chars
    is null stays as it is, and so does one whose id is null. Very long texts are hashed
    where they are read. Other columns are ignored. No rows give no rows.
    """
    hashed = written(leaves(docs), "merkle-leaves")
    rows, largest = ranked(hashed, "doc_id", "leaf")
    forget(hashed)
    rows = rows.withColumnRenamed("leaf", "h")
    rounds = climb(rows, largest, block_levels)
    tops, langs = ranked(rounds[-1].select(F.lit("all").alias("grp"), F.col("grp").alias("name"), "h"), "name")
    outer = climb(tops, langs, block_levels)
    paths = outer[-1].select("grp", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    for nodes in reversed(outer[1:-1]):
        #: Inner nodes of the tree over the languages are nobody's subroot.
        paths = descend(nodes, paths, block_levels).withColumn("subroot", F.lit(None).cast("string"))
    named = descend(outer[0], paths, block_levels).join(outer[0].select("pos", "name"), "pos")
    paths = written(named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"), "merkle-paths")
    for nodes in reversed(rounds[1:-1]):
        paths = written(descend(nodes, paths, block_levels), "merkle-paths")
    with_parents = _with_parents(rows.select("grp", "size", "pos", "doc_id", "h", "tampered"), paths, block_levels)
    return with_parents.applyInArrow(lambda key, block, above: _proofs(key, block, above, block_levels), _PROOFS)


def _crc32_sql(text: str) -> str:
    """The checksum of a short ASCII text, four bits at a time with a table made by rule."""

    def entry(n: int) -> int:
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        return n

    table = "[" + ", ".join(str(entry(n)) for n in range(16)) + "]::BIGINT[]"
    half = lambda x: f"xor({x} >> 4, ({table})[({x} & 15) + 1])"
    whole = half(half("xor(crc, byte)"))
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte: {whole}, 4294967295::BIGINT), 4294967295)"


def _sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    whole = lambda n: f"sha256({' || '.join(field(n if c == 'n_chars' else c) for c in FIELDS)})"
    token = "CASE WHEN s.h IS NULL THEN '-' WHEN s.pos % 2 = 0 THEN 'L' || s.h ELSE 'R' || s.h END"
    fold = "lambda h, x: CASE x[1] WHEN '-' THEN sha256(h) WHEN 'L' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END"
    return f"""
WITH RECURSIVE
hashed AS (SELECT doc_id, coalesce('v' || lang, 'n') AS grp, {whole('n_chars')} AS leaf,
  CASE WHEN n_chars IS NOT NULL AND {_crc32_sql('doc_id::VARCHAR')} % {TAMPERED} = 0 THEN {whole('(n_chars + 1)')} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
tree AS (SELECT grp, 0 AS k, pos, n, leaf AS h FROM placed
  UNION ALL SELECT grp, k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, k, pos // 2, n),
subroots AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS k, pos, n, h FROM subroots
  UNION ALL SELECT k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY k, pos // 2, n),
inner_levels AS (SELECT DISTINCT grp, k FROM tree WHERE n > 1),
outer_levels AS (SELECT DISTINCT k FROM top WHERE n > 1),
inner_steps AS (SELECT p.grp, p.pos, list({token} ORDER BY l.k) AS steps FROM placed p JOIN inner_levels l USING (grp) LEFT JOIN tree s ON s.grp = p.grp AND s.k = l.k AND s.pos = xor(p.pos >> l.k, 1) GROUP BY p.grp, p.pos),
outer_steps AS (SELECT r.grp, list({token} ORDER BY l.k) AS steps FROM subroots r CROSS JOIN outer_levels l LEFT JOIN top s ON s.k = l.k AND s.pos = xor(r.pos >> l.k, 1) GROUP BY r.grp),
paths AS (SELECT p.*, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(i.steps, []), coalesce(o.steps, [])) AS steps
  FROM placed p JOIN subroots r USING (grp) LEFT JOIN inner_steps i ON i.grp = p.grp AND i.pos = p.pos LEFT JOIN outer_steps o ON o.grp = p.grp),
folded AS (SELECT *, list_reduce(steps, {fold}, coalesce(tampered, leaf)) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


SQL = _sql()
