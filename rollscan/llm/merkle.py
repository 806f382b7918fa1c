"""Merkle dataset manifest: a tree of digests for each source, and one over the sources, by windows of fixed lag and lead.

All levels of a block of ARITY^LEVELS nodes come from one shuffle and one order. On level l a node's digest stands in the first
row below it, so that its neighbours stand ARITY^l rows before and after: fixed offsets, masked by the node's slot in its run
and the run's length, supply the siblings, and a run's first row hashes the parent. The blocks' tops are the nodes of the next
round. Blocks hold as many rows whatever the source, so a source with a third of all rows is cut into as many as it fills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import running, sized, stage

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: A block's siblings are broadcast up to so many rows, of some 3 KB each.
BROADCAST_TOPS = 10_000
#: Siblings of a node on a level, as hex text end to end: those before it and those after it.
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for a null, else the length in UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def climbed(nodes: DataFrame) -> DataFrame:
    """nodes with `block`, `path` (the siblings on the block's levels, lowest first) and `node`: in a block's first row its top.
    nodes: key, idx (0 to n - 1 in each key), n, digest."""
    w = Window.partitionBy("key", "block").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).withColumn("node", F.col("digest"))
    for level in range(LEVELS):
        span = ARITY**level
        count = F.expr(f"(n + {span - 1}) div {span}")
        place = F.expr(f"idx div {span}")
        slot = place % ARITY
        run = F.least(F.lit(ARITY), count - (place - slot))
        near = lambda f, by: F.coalesce(f("node", by * span).over(w), F.lit(""))  # noqa: B023, E731
        left = F.concat(*[F.when(slot >= by, near(F.lag, by)).otherwise("") for by in range(ARITY - 1, 0, -1)])
        right = F.concat(*[F.when(slot + by < run, near(F.lead, by)).otherwise("") for by in range(1, ARITY)])
        step = F.when((F.col("idx") % span == 0) & (count > 1), F.struct(left.alias("left"), right.alias("right")))
        out = out.withColumn("_step", step)
        parent = F.when(count == 1, F.col("node")).when(slot == 0, digest(F.col("node"), F.col("_step.right")))
        out = out.withColumn("node", F.when(F.col("idx") % span == 0, parent))
        out = out.withColumn(f"_s{level}", F.last("_step", True).over(upto))
    path = F.array_compact(F.array(*[F.col(f"_s{level}") for level in range(LEVELS)]))
    return out.withColumn("path", path).drop("_step", *[f"_s{level}" for level in range(LEVELS)])


def climb(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """nodes with `path`, all siblings up to the key's top, and `apex`, an array that begins with that top's digest. finish:
    what goes on above the tops (key, idx, n, digest; one a key); it gives key, idx, path and apex.

    A round of LEVELS levels leaves one node of BLOCK; rounds end when every key has one node left.
    """
    out = climbed(nodes)
    tops = out.filter(F.col("idx") % BLOCK == 0).select("key", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("node").alias("digest"))
    tops = stage(tops, "merkle-nodes")
    if (tops.agg(F.max("n")).first()[0] or 0) > 1:
        above = climb(tops, finish)
    elif finish:
        above = finish(tops)
    else:
        above = tops.select("key", "idx", F.array().cast(PATH).alias("path"), F.array("digest").alias("apex"))
    above = stage(above.select("key", F.col("idx").alias("block"), F.col("path").alias("_upper"), "apex"), "merkle-paths")
    joined = out.drop("node").join(sized(above, limit=BROADCAST_TOPS), ["key", "block"])
    return joined.withColumn("path", F.concat("path", "_upper")).drop("_upper", "block")


def over_sources(tops: DataFrame) -> DataFrame:
    """The tree over the sources' subroots, in order of key. apex: subroot, root."""
    n = tops.count()
    named = running(tops.withColumn("_one", F.lit(1).cast("long")), [F.col("key")], "_one", "_at")
    nodes = stage(named.select(F.lit("").alias("key"), F.col("_at").alias("idx"), F.lit(n).cast("long").alias("n"), "digest", F.col("key").alias("_name")), "merkle-sources")
    return climb(nodes).select(F.col("_name").alias("key"), F.lit(0).cast("long").alias("idx"), "path", F.concat(F.array("digest"), "apex").alias("apex"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step.left, node, step.right), 256))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """key (orders as source does: missing, then by UTF-8 bytes), doc_id, leaf, and `now`: the leaf of the row where its text is
    replaced by `changed`."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(*[field(c) for c in fields], field(F.col("text")))
    now = leaf if changed is None else digest(*[field(c) for c in fields], field(changed))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), now.alias("now"))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, now for every row of docs; see leaves() for `now`.

    Leaves of a source are in order of doc_id (missing ones first), rows that share it in order of their leaf; repeated rows
    are a leaf each. A lone leaf is its source's subroot, a lone subroot the root; paths are empty then. Null fields are
    marked in the leaf, so a null text differs from an empty one. An empty table gives no row; further columns are ignored,
    and texts are hashed whole.
    """
    rows = leaves(docs, changed).withColumns({"_row": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")})
    rows = stage(rows, "merkle-leaves")
    placed = stage(running(rows, [F.col(c) for c in ("key", "doc_id", "leaf", "_row")], "_one", "_at").drop("_one", "_row", "part"), "merkle-order")
    sources = stage(placed.groupBy("key").agg(F.min("_at").alias("_first"), F.count("*").alias("n")), "merkle-counts")
    nodes = placed.join(sized(sources), "key").select("key", (F.col("_at") - F.col("_first")).alias("idx"), "n", F.col("leaf").alias("digest"), "doc_id", "now")
    out = climb(nodes, over_sources)
    return out.select("doc_id", F.col("digest").alias("leaf"), F.col("apex")[0].alias("subroot"), F.col("apex")[1].alias("root"), "path", "now")


def proofs(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """manifest() with the digest of each leaf's proof, and the root that `now` folds to beside the one recorded."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), "")
    m = manifest(docs, changed).withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
