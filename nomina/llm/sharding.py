"""Sharding by a hierarchical weighted hash tree (operator 6), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import stored, table, unit_hash, unit_hash_sql

#: Regions of racks of shards; each shard is (number, weight).
TREE = {
    "r0": {"k0": [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)], "k1": [(4, 1.0), (5, 1.0), (6, 1.0), (7, 1.0)]},
    "r1": {"k0": [(8, 1.0), (9, 1.0), (10, 1.0), (11, 1.0)], "k1": [(12, 1.0), (13, 1.0), (14, 1.0), (15, 1.0)]},
}


def grown(tree: dict, weight: float = 1.0) -> dict:
    """tree with one more shard in a region and rack of its own: only draws for that region change, so rows move
    into the new shard alone."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s, _ in shards)
    return tree | {f"r{len(tree)}": {"k0": [(new, weight)]}}


def _levels(tree: dict) -> dict:
    """Children of each inner node as {name: (weight, children or shard)}."""
    return {r: (sum(w for shards in racks.values() for _, w in shards), {k: (sum(w for _, w in shards), {str(s): (w, s) for s, w in shards}) for k, shards in racks.items()}) for r, racks in tree.items()}


def _paths(node: dict, path: str = "") -> tuple[dict, dict]:
    """{path of an inner node: [(name, weight)]} and {path of a leaf: shard}."""
    inner, leaves = {path: [(n, node[n][0]) for n in sorted(node)]}, {}
    for n in node:
        if isinstance(node[n][1], dict):
            a, b = _paths(node[n][1], f"{path}/{n}")
            inner, leaves = inner | a, leaves | b
        else:
            leaves[f"{path}/{n}"] = node[n][1]
    return inner, leaves


def shard_of(rows: DataFrame, key: str, out: str, tree: dict = TREE) -> DataFrame:
    """rows with the key's shard as column out: region, then rack, then shard, each by weighted hash draws.

    The child with the greatest ln(u) / weight wins; u is a hash of the child's path and the key, so a weight that changes
    moves rows only to or from that child. A null key counts as the empty string."""
    inner, leaves = _paths(_levels(tree))
    children = F.create_map(*[x for p, c in inner.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("w")) for n, w in c]))])
    rows = rows.withColumn("_path", F.lit(""))
    for _ in range(3):
        draws = F.transform(children[F.col("_path")], lambda c: F.struct((F.log(unit_hash(F.col("_path"), "/", c["n"], ":", F.col(key)) + 2.0**-53) / c["w"]).alias("d"), c["n"].alias("n")))
        best = F.reduce(draws, F.element_at(draws, 1), lambda a, b: F.when(b["d"] > a["d"], b).otherwise(a))
        rows = rows.withColumn("_path", F.concat("_path", F.lit("/"), best["n"]))
    shards = F.create_map(*[F.lit(x) for pair in leaves.items() for x in pair])
    return rows.withColumn(out, shards[F.col("_path")].cast("int")).drop("_path")


def place(docs: DataFrame, tree: dict = TREE) -> DataFrame:
    """docs with size, text_crc32, shard, grown_shard and slot, columns of these names replaced.

    Shard: from doc_id alone. Slot: gapless from 0 in each shard, by hash of doc_id, doc_id, crc and size; rows alike in
    all of these take neighbouring slots. A null text has size 1 and the CRC of no bytes. Slots come from counts of about
    sqrt(rows of a shard) stretches, so no task holds a shard."""
    cols = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "grown_shard", "slot")]
    rows = docs.select(
        *cols,
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        unit_hash("slot:", F.col("doc_id")).alias("_u"),
    )
    rows = shard_of(shard_of(rows, "doc_id", "shard", tree), "doc_id", "grown_shard", grown(tree))
    if "text" in cols:
        rows, cols = rows.drop("text"), [c for c in cols if c != "text"]
    rows = stored(rows)
    n = sum(len(s) for racks in tree.values() for s in racks.values())
    parts = max(1, int((rows.count() / n) ** 0.5))
    rows = rows.withColumn("_p", F.floor(F.col("_u") * parts))
    counts = stored(rows.groupBy("shard", "_p").agg(F.count(F.lit(1)).alias("_n")))
    order = Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_p", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_p").orderBy("_u", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("_r", F.row_number().over(within) - 1)
    return rows.join(counts, ["shard", "_p"]).select(*cols, "size", "text_crc32", "shard", (F.col("_before") + F.col("_r")).cast("long").alias("slot"), "grown_shard")


def op6_hash_tree_shards(spark, sf_dir) -> DataFrame:
    out = place(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _descend_sql(node: dict, key: str, path: str) -> str:
    names = sorted(node)
    below = [_descend_sql(node[n][1], key, f"{path}/{n}") if isinstance(node[n][1], dict) else str(node[n][1]) for n in names]
    if len(names) == 1:
        return below[0]
    draws = ", ".join("ln(" + unit_hash_sql(f"'{path}/{n}:'", key) + f" + 1.1102230246251565e-16) / {node[n][0]}" for n in names)
    return "(SELECT CASE list_position(v, list_max(v)) " + " ".join(f"WHEN {i + 1} THEN {b}" for i, b in enumerate(below)) + f" END FROM (SELECT [{draws}] AS v))"


def sql(tree: dict = TREE) -> str:
    """DuckDB SQL of op6; CRC-32 is folded over the bytes of the distinct texts."""
    return f"""
WITH bytes AS (
  SELECT DISTINCT text, hex(encode(coalesce(text, ''))) AS h FROM documents
), crc AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, ({[_crc_entry(i) for i in range(256)]}::BIGINT[])[1 + (xor(c, b) & 255)]))) AS text_crc32 FROM bytes
), placed AS (
  SELECT doc_id, (coalesce(strlen(d.text), 0) + 1)::BIGINT AS size, crc.text_crc32, {_descend_sql(_levels(tree), "doc_id", "")}::INTEGER AS shard,
    {_descend_sql(_levels(grown(tree)), "doc_id", "")}::INTEGER AS grown_shard, {unit_hash_sql("'slot:'", "doc_id")} AS u
  FROM documents d JOIN crc ON d.text IS NOT DISTINCT FROM crc.text
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY u, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i
