"""Merkle manifest of a table, with a proof for every row by pointer jumping.

A row is a leaf: the digest of its fields, each as `-` if null, else its length in
UTF-8 bytes, a colon and the value. The leaves of a language, by doc_id, are paired
level by level (a last one alone too) up to a subroot, and the subroots, by language,
up to the root. Digests are lowercase hex SHA-256 over hex texts; work tables hold
their 32 bytes.

Levels are built CHUNK at a time: leaves of one stretch of 2 ** CHUNK places meet in
one row, whose arrays give all nodes of these levels with their siblings. Proofs come
by pointer jumping: each node first holds the sibling on its one step up; a self-join
of nodes whose level is a multiple of 2d with those they point at, d levels up, doubles
the distance and concatenates the segments, until the leaves point at their subroot.
Upper nodes are few (one of 2 ** d), and each is repeated for every 2 ** SHARE nodes
below, so that no key of a join holds more rows than that.

DataFrame operations only. Rows without doc_id come first, equal doc_ids by digest, and
repeated rows are leaves of their own; a null language is a language; a row without a
doc_id is never tampered with; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ranks import positions

CHUNK, SHARE = 10, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(hexes: Column) -> Column:
    return F.unhex(F.sha2(hexes, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(fields: list[Column]) -> Column:
    return _digest(F.concat(*map(_field, fields)))


def _paired(nodes: Column) -> Column:
    """The next level of an array of digests."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: _digest(F.concat(_hex(F.get(nodes, i * 2)), F.coalesce(_hex(F.get(nodes, i * 2 + 1)), F.lit("")))))


def _depth(total: Column) -> Column:
    """Levels above the leaves."""
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes below the root, and roots, of one tree for each g over leaves (g, pos, total, digest).

    Nodes: g, level, pos, total, depth, up (level of the node pointed at), segment (siblings
    on the way there, null where a node is alone). Roots: g, root, total.
    """
    current = leaves.select("g", "pos", "total", "digest").withColumn("depth", _depth(F.col("total")))
    nodes, roots, base = [], [], 0
    deepest = current.agg(F.max("depth")).first()[0] or 0
    while True:
        group = current.groupBy("g", "total", "depth", F.shiftright("pos", CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("members"))
        group = group.select("g", "total", "depth", "chunk", F.transform("members", lambda m: m["digest"]).alias("a0"))
        for k in range(CHUNK):
            group = group.withColumn(f"a{k + 1}", F.when(F.col("depth") > base + k, _paired(F.col(f"a{k}"))))
        group = stored(group, "chunks")

        def level(k: int) -> Column:
            array = F.col(f"a{k}")
            of = F.transform(
                array,
                lambda _, i: F.struct(
                    F.lit(base + k).alias("level"), (F.shiftleft("chunk", CHUNK - k) + i).alias("pos"), F.array(F.get(array, i.bitwiseXOR(F.lit(1)))).alias("segment")
                ),
            )
            return F.when(F.col("depth") > base + k, of).otherwise(F.expr("array()").cast("array<struct<level:int,pos:bigint,segment:array<binary>>>"))

        below = group.select("g", "total", "depth", F.explode(F.concat(*map(level, range(CHUNK)))).alias("x"))
        nodes.append(below.select("g", "x.level", "x.pos", "total", "depth", (F.col("x.level") + 1).alias("up"), "x.segment"))
        tops = F.array(*[F.col(f"a{k}") for k in range(CHUNK + 1)])
        roots.append(group.where(F.col("depth") <= base + CHUNK).select("g", F.get(F.get(tops, F.col("depth") - base), F.lit(0)).alias("root"), "total"))
        base += CHUNK
        if base >= deepest:
            return reduce(DataFrame.union, nodes), reduce(DataFrame.union, roots)
        current = group.where(F.col("depth") > base).select("g", F.col("chunk").alias("pos"), "total", F.get(f"a{CHUNK}", F.lit(0)).alias("digest"), "depth")


def jumped(nodes: DataFrame) -> DataFrame:
    """(g, pos, path) of all leaves that aren't roots: path has the siblings up to the root, null where there is none."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    far = 1
    while far < deepest:
        left = nodes.where(F.col("level") % (2 * far) == 0).withColumn("at", F.call_function("shiftright", "pos", F.lit(far))).withColumn("share", F.shiftright(F.col("pos").bitwiseAND((1 << far) - 1), SHARE))
        right = nodes.where(F.col("level") % (2 * far) == far)
        beneath = F.least(F.lit(1 << far), F.col("total"))  # nodes that may point at this one
        right = right.select(
            "g", F.col("level").alias("up"), F.col("pos").alias("at"), F.explode(F.sequence(F.lit(0), F.shiftright(beneath - 1, SHARE))).alias("share"), F.col("segment").alias("more"), F.col("up").alias("further")
        )
        joined = left.join(right, ["g", "up", "at", "share"], "left")
        joined = joined.select("g", "level", "pos", "total", "depth", F.coalesce("further", "up").alias("up"), F.when(F.col("more").isNull(), F.col("segment")).otherwise(F.concat("segment", "more")).alias("segment"))
        nodes, far = stored(joined, "jumps"), 2 * far
    return nodes.where("level = 0").select("g", "pos", F.col("segment").alias("path"))


def _steps(path: Column, pos: Column) -> Column:
    """Siblings in hex, and whether each stands on the left."""
    return F.transform(path, lambda x, i: F.struct(_hex(x).alias("sibling"), (F.call_function("shiftright", pos, i).bitwiseAND(1) == 1).alias("left")))


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest (hex) and its steps give."""
    both = lambda own, s: F.when(s["left"], F.concat(s["sibling"], own)).otherwise(F.concat(own, F.coalesce(s["sibling"], F.lit(""))))
    return F.aggregate(steps, digest, lambda own, s: F.sha2(both(own, s), 256))


def manifest(df: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `tampered` holds, the folded root comes from a leaf whose n_chars is one more.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    more = [F.try_add(f, F.lit(1)) if c == "n_chars" else f for c, f in zip(FIELDS, fields, strict=True)]
    fake = F.lit(None).cast("binary") if tampered is None else F.when(tampered, leaf_digest(more))
    key = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    leaves = df.select("doc_id", key.alias("g"), leaf_digest(fields).alias("digest"), fake.alias("fake"))
    # equal leaves get numbers, so that a row repeated very often spreads over ranges
    leaves = stored(leaves.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    leaves = stored(positions(leaves, "g", [F.col("doc_id"), F.col("digest"), F.col("nth")], "ordered").drop("nth"), "placed")
    nodes, roots = forest(leaves)
    paths, roots = jumped(stored(nodes, "nodes")), stored(roots, "roots")

    # the tree over subroots, and each language's way to the root
    langs = stored(positions(roots.withColumnRenamed("g", "lang").withColumn("g", F.lit("top")).withColumnRenamed("total", "rows"), "g", [F.col("lang")], "langs").withColumnRenamed("root", "digest"), "langs")
    upper, root = forest(langs)
    ways = jumped(stored(upper, "nodes")).select(F.col("pos").alias("place"), F.col("path").alias("way"))
    langs = langs.select(F.col("lang").alias("g"), F.col("digest").alias("subroot"), F.col("pos").alias("place"), "rows", F.lit("top").alias("all")).join(ways, "place", "left")
    langs = langs.join(root.select(F.col("g").alias("all"), "root"), "all").withColumn("stretch", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("rows") - 1, 16))))

    rows = leaves.join(paths, ["g", "pos"], "left").withColumn("stretch", F.shiftright("pos", 16)).join(langs.drop("rows", "all"), ["g", "stretch"])
    none = F.expr("array()").cast("array<binary>")
    steps = F.concat(_steps(F.coalesce("path", none), F.col("pos")), _steps(F.coalesce("way", none), F.col("place")))
    rows = rows.withColumn("steps", steps).withColumn("folded_root", folded(_hex(F.coalesce("fake", "digest")), F.col("steps")))
    return rows.select(
        "doc_id",
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform("steps", lambda s: s["sibling"]), ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == _hex(F.col("root"))).alias("verified"),
    )
