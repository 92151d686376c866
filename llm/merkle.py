"""A Merkle manifest of a table: every row is a leaf, every source a tree, and a tree over the sources gives one root.

Leaves of a source stand in the order of their key; every 16 consecutive nodes of a level become one node, the hash of their
digests, until one is left. Proofs come from pointer jumping: a node first holds the siblings of its own run (a segment)
and a pointer to its parent; a self-join appends the segments of the node that it points at and takes over that node's
pointer, so the distance doubles and a tree of any height needs logarithmically many joins. All leaves of a run share
the way to the root, so the jumping is done once per run and a leaf adds its siblings of the lowest level when it is given out.

Positions are counted over a range partitioning: no task holds a source. Of documents only key, source and digest move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small_side, stage

FAN = 16
TOP = -1  # number of the tree over the sources
_ID, _UP = ("tree", "level", "pos"), ("up_tree", "up_level", "up_pos")


def encoded(*values: Column) -> Column:
    """Each value as `-` (null) or its UTF-8 byte count, `:` and itself; one after the other."""
    text = [v.cast("string") for v in values]
    return F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text])


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings from the lowest level up, each level from left to right, as one string."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def numbered(staged: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos, the row's number within its group along order (nulls first), and n, the rows of the group. Written once, sorted by ranges."""
    ordered = staged.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = stage(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_many"))
    spans = spans.withColumns({"_before": F.coalesce(F.sum("_many").over(before), F.lit(0)), "n": F.sum("_many").over(Window.partitionBy("_g"))})
    spans = small_side(stage(spans))
    return rows.join(spans, F.col("_part").eqNullSafe(F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn(
        "pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_g", "_p", "_first", "_many", "_before")


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """The next level of every tree that has several nodes (tree, pos, n, digest): its nodes with their children's digests."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
    up = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / FAN).cast("long").alias("up"), F.ceil(F.col("n") / FAN).cast("long").alias("n")).agg(kids.alias("kids"))
    return up.select("tree", F.lit(level).cast("long").alias("level"), F.col("up").alias("pos"), "n", digest(F.concat_ws("", "kids")).alias("digest"), "kids")


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _grow(nodes: DataFrame, level: int, height: int) -> list[DataFrame]:
    """All levels above the given one."""
    out = []
    for k in range(level + 1, height + 1):
        out.append(stage(_runs(nodes, k)))
        nodes = out[-1]
    return out


def _sides(i: Column, kids: Column) -> Column:
    """The digests left and right of number i (from 0)."""
    join = lambda x: F.concat_ws("", x)
    return F.struct(join(F.slice(kids, 1, i)).alias("left"), join(F.slice(kids, i + 2, FAN)).alias("right"))


def _pointers(runs: DataFrame) -> DataFrame:
    """A row per child of the given runs: pointer to the run, and the siblings as the first segment of its way."""
    kid = runs.select(*_ID, "kids", F.posexplode("kids").alias("i", "_"))
    own = [F.col("tree"), (F.col("level") - 1).alias("level"), (F.col("pos") * FAN + F.col("i")).alias("pos")]
    return kid.select(*own, *[F.col(a).alias(b) for a, b in zip(_ID, _UP)], F.array(_sides(F.col("i"), F.col("kids"))).alias("path"))


def jump(pointers: DataFrame) -> DataFrame:
    """Doubles the distance of all pointers until none points at a node that has one itself. Only nodes that are pointed at
    take the other side of the join; they become sixteen times fewer with every level."""
    pointers = stage(pointers)
    while True:
        asked = pointers.filter("up_tree IS NOT NULL").select(*[F.col(u).alias(i) for u, i in zip(_UP, _ID)]).distinct()
        known = stage(pointers.join(asked, list(_ID)).select(
            *[F.col(i).alias(f"_{i}") for i in _ID], *[F.col(u).alias(f"_{u}") for u in _UP], F.col("path").alias("_path")))
        if known.isEmpty():
            return pointers.select(*_ID, "path")
        met = [F.col(u) == F.col(f"_{i}") for u, i in zip(_UP, _ID)]
        pointers = stage(pointers.join(small_side(known), met[0] & met[1] & met[2], "left").select(
            *_ID, *[F.col(f"_{u}").alias(u) for u in _UP],
            F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path")))


def manifest(docs: DataFrame, leaf: Column, source: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """Of every row of docs: source, key and the carried columns, leaf, subroot (of its source), root and proof, the siblings
    from the leaf's run to the root as an array of (left, right), each the digests of one level.

    A null source is a source of its own and the first; a null key is its source's first. Equal keys stand by digest and then
    by carried columns; equal rows are leaves of their own. Null and empty values differ in their digest. A source with one row has that leaf as its
    subroot, a table with one source its subroot as root. Only the columns named here are read, whatever others are called. An empty table gives no rows."""
    carry = carry or {}
    thin = docs.select(F.col(source).alias("source"), F.col(key).alias("key"), leaf.alias("digest"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carry"))
    # sorted by what tells rows apart; carried columns last
    rows = numbered(stage(thin), "source", ["key", "digest", "carry"])
    counted = rows.groupBy("source").agg(F.max("n").alias("n"))
    sources = numbered(stage(counted.select("source", F.col("n").alias("rows"), F.lit(0).alias("all"))), "all", ["source"])
    sources = stage(sources.select(F.col("source").alias("_source"), F.col("pos").alias("tree"), F.col("n").alias("trees"), "rows"))
    size = sources.agg(F.max("rows").alias("rows"), F.max("trees").alias("trees")).first()
    kind = f"source {rows.schema['source'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}"
    if size["rows"] is None:
        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema["carry"].dataType.fields if f.name != "_")
        return docs.sparkSession.createDataFrame([], f"{kind}{', ' if names else ''}{names}, leaf string, subroot string, root string, proof array<struct<left:string,right:string>>")
    rows = rows.join(small_side(sources), F.col("source").eqNullSafe(F.col("_source")))
    entry = F.array_sort(F.collect_list(F.struct("pos", "digest", "key", "carry")))
    lowest = rows.groupBy("tree", F.floor(F.col("pos") / FAN).cast("long").alias("run"), "rows").agg(F.first("source").alias("source"), entry.alias("leaves"))
    lowest = stage(lowest.withColumn("kids", F.transform("leaves", lambda x: x["digest"])))
    lone = F.col("rows") == 1
    first = lowest.select("tree", F.when(lone, 0).otherwise(1).cast("long").alias("level"), F.col("run").alias("pos"), F.ceil(F.col("rows") / FAN).cast("long").alias("n"),
                          F.when(lone, F.col("kids")[0]).otherwise(digest(F.concat_ws("", "kids"))).alias("digest"))
    first = stage(first)
    above = _grow(first.filter("level = 1"), 1, _height(size["rows"]))
    tops = first.filter("n = 1")
    for level in above:
        tops = tops.unionByName(level.filter("n = 1").select(*first.columns))
    tops = stage(tops)
    heads = tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size["trees"]).cast("long").alias("n"), "digest")
    over = _grow(heads, 0, _height(size["trees"]))
    root = (over[-1] if over else tops).first()["digest"]

    to_head = tops.filter("level > 0").select(*_ID, F.lit(TOP).cast("long").alias("up_tree"), F.lit(0).cast("long").alias("up_level"), F.col("tree").alias("up_pos"),
                                              F.expr("CAST(array() AS array<struct<left:string,right:string>>)").alias("path"))
    pointers = to_head
    for level in [*above, *over]:
        pointers = pointers.unionByName(_pointers(level))
    ways = jump(pointers)
    begin = [F.when(lone, F.lit(TOP)).otherwise(F.col("tree")).cast("long"), F.when(lone, 0).otherwise(1).cast("long"), F.when(lone, F.col("tree")).otherwise(F.col("run")).cast("long")]
    here = lowest.withColumns({f"_{i}": c for i, c in zip(_ID, begin)}).join(
        ways.select(*[F.col(i).alias(f"_{i}") for i in _ID], "path"), [f"_{i}" for i in _ID], "left")
    here = here.join(small_side(stage(tops.select(F.col("tree").alias("_t"), F.col("digest").alias("subroot")))), F.col("tree") == F.col("_t"))
    out = here.select("source", "subroot", "kids", "path", lone.alias("lone"), F.posexplode("leaves").alias("i", "at"))
    way = F.coalesce("path", F.expr("CAST(array() AS array<struct<left:string,right:string>>)"))
    proof = F.when(F.col("lone"), way).otherwise(F.concat(F.array(_sides(F.col("i"), F.col("kids"))), way))
    return out.select("source", F.col("at.key").alias("key"), *[F.col(f"at.carry.{n}").alias(n) for n in carry], F.col("at.digest").alias("leaf"),
                      "subroot", F.lit(root).alias("root"), proof.alias("proof"))
