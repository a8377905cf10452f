"""Conversation prefix trie, built as burst tries.

A turn has an id (the digest of its role and text), a conversation is a row of ids. Conversations are cut into segments of SEGMENT turns, and equal segments
after equal ones are one suffix with the number and the least id of its conversations, so that copies of a conversation are a single suffix.

A container holds the suffixes that hang from one head of the trie. At first there is one for each head at a segment's end (the root and, beyond
SEGMENT turns, the nodes there). As long as any holds more than LIMIT suffixes it bursts: the turns that all its suffixes begin with become nodes, and the rest is
dealt to containers by the next turn id, whose heads those nodes then are. Containers that are left are dealt out by their heads, sorted, and swept
into nodes: a stack of the turns of the last suffix is popped to what the next one shares. What a container counts is added to each head above it in one sum.

Rows are ordered by turn (null first), then by id; null roles and texts are empty; repeated rows are turns of their own; rows without a conv_id belong to no
conversation and are left out. Places in a conversation come from ranges of all rows, segments are bounded, and copies are summed before they meet, so no
conversation or group of copies is held by one task. An empty table gives no nodes; other columns are ignored. SHA-256 can't be split: the ids of those
who end at one node are one stream through one task, in blocks that were joined before.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import streamed_sha256, written

SEGMENT, LIMIT = 1024, 256
KEY = ["c1", "c2"]
HEAD = ["head1", "head2"]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"{NODE}, is_node boolean, c1 long, c2 long, head1 long, head2 long, path array<struct<c1: long, c2: long>>"
_BLOCK_BITS = 12


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, rank (in all rows: by conversation, then by turn), id and words of each turn."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).where("conv_id is not null")
    own = own.select("conv_id", "turn", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("id"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["conv_id", "turn", "id"]
    own = written(own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "id", "words", F.monotonically_increasing_id().alias("n")), "turns")
    # a row a partition: its first rank
    parts = own.groupBy(F.shiftright("n", 33).alias("part")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = own.withColumn("part", F.shiftright("n", 33)).join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    return ranked.select("conv_id", (F.col("before") + F.col("n").bitwiseAND((1 << 33) - 1)).alias("rank"), "id", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, pos, id, words, total; conversations: conv_id, total). Conversation c begins with the first h turns of c - c % 20 in place of its own first h, where h = crc32(c) % 4."""
    turns = written(turns_of(rows), "ranked")
    convs = turns.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    convs = written(convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "base": F.col("conv_id") - F.col("conv_id") % 20}), "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"), F.col("size").alias("base_size"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken).withColumn("total", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "first", "base_first", "h", "taken", "total"), "rebuilt")
    heads = convs.where("taken > 0").select("conv_id", "total", "base_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken").cast("long") - 1)).alias("pos"))
    heads = heads.withColumn("rank", F.col("base_first") + F.col("pos")).join(turns.select("rank", "id", "words"), "rank").select("conv_id", "pos", "id", "words", "total")
    own = turns.join(convs, "conv_id").withColumn("pos", F.col("rank") - F.col("first")).where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "words", "total")
    return own.unionByName(heads), convs.select("conv_id", "total")


def segments(turns: DataFrame, length: int) -> DataFrame:
    """conv_id, seg, its turns in order, the digests of all before it (head) and with it (next), and whether it is the last."""
    own = turns.groupBy("conv_id", "total", F.floor(F.col("pos") / length).cast("long").alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("turns"))
    own = own.withColumn("turns", F.transform("turns", lambda t: F.struct(t.id.alias("id"), t.words.alias("words"))))
    ids = F.transform("turns", lambda t: t.id)
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    for k in (1, 2):
        own = own.withColumn(f"own{k}", F.xxhash64(F.lit(k), "seg", ids)).withColumn(f"head{k}", F.coalesce(F.bit_xor(F.col(f"own{k}")).over(before), F.lit(0)))
        own = own.withColumn(f"next{k}", F.col(f"head{k}").bitwiseXOR(F.col(f"own{k}")))
    return written(own.select("conv_id", "seg", "turns", *HEAD, "next1", "next2", ((F.col("seg") + 1) * length >= F.col("total")).alias("last")), "segments")


def ends_of(parts: DataFrame, convs: DataFrame) -> DataFrame:
    """next1, next2 and the digest of the ids of the conversations that end there."""
    own = parts.where("last").select("next1", "next2", "conv_id").unionByName(convs.where("total = 0").select(F.lit(0).cast("long").alias("next1"), F.lit(0).cast("long").alias("next2"), "conv_id"))
    blocks = own.groupBy("next1", "next2", F.shiftright("conv_id", _BLOCK_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return streamed_sha256(blocks, ["next1", "next2"], ["block"], "ids", ",").withColumnRenamed("sha256", "ends")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes come by container, in order. A stack of open nodes: [id, words, n, m, children, leaves, saved, ends, children beyond, closed children]."""
    names = [c.split(":")[0].split()[0] for c in _SWEPT.split(", ")[:13]] + ["path"]
    key = pa.struct([("c1", pa.int64()), ("c2", pa.int64())])
    kinds = [*[pa.int64()] * 7, pa.string(), pa.bool_(), *[pa.int64()] * 4, pa.list_(key)]
    out: list[tuple] = []
    stack: list[list] = []
    at: dict | None = None

    def close() -> None:
        node = stack.pop()
        _, words, n, m, children, leaves, saved, ends, beyond, closed = node
        if not children + beyond:
            leaves = 1
        saved += (n - 1) * words
        out.extend((*c[:2], m, *c[2:]) for c in closed)
        up = stack[-1]
        up[2] += n
        up[3] = m if up[3] is None else min(up[3], m)
        up[4] += 1
        up[5] += leaves
        up[6] += saved
        row = (m, at["depth"] + len(stack), n, children + beyond, leaves, saved, ends)
        if len(stack) > 1:
            up[9].append(row)
        else:  # a child of the container's head, whose least id is known
            out.append((*row[:2], at["head_m"], *row[2:]))

    def end() -> tuple:
        while len(stack) > 1:
            close()
        top = stack.pop()
        return (top[3], at["depth"], None, top[2], top[4], top[5], top[6], None, False, at["c1"], at["c2"], at["head1"], at["head2"], at["path"])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        whole = [r if len(r) > 8 else (*r, True, None, None, None, None, None) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in whole], t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        for small in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            for r in small.to_pylist():
                if at is None or (r["c1"], r["c2"]) != (at["c1"], at["c2"]):
                    if at is not None:
                        out.append(end())
                    at = r
                    stack.append([None, 0, 0, None, 0, 0, 0, None, 0, []])
                turns, shared = r["turns"], 0
                while shared < min(len(turns), len(stack) - 1) and turns[shared]["id"] == stack[shared + 1][0]:
                    shared += 1
                while len(stack) > shared + 1:
                    close()
                stack.extend([t["id"], t["words"], 0, None, 0, 0, 0, None, 0, []] for t in turns[shared:])
                last = stack[-1]
                last[2] += r["n"]
                last[3] = r["m"] if last[3] is None else min(last[3], r["m"])
                last[5] += r["x_leaves"]
                last[6] += r["x_saved"]
                last[7], last[8] = r["ends"], r["x_children"]
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
    if at is not None:
        out.append(end())
    if out:
        yield batch_of(out)


def _containers(suffixes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals by head: head1, head2, children, leaves, saved) of suffixes: head1, head2, head_m, depth, turns, n, m, ends, x_children, x_leaves, x_saved."""
    key_type = "array<struct<c1: long, c2: long>>"
    left = written(suffixes.withColumns({"c1": F.col("head1"), "c2": F.col("head2"), "path": F.expr(f"cast(array() as {key_type})")}), "suffixes")
    burst = None
    while True:
        big = written(left.groupBy(*KEY).agg(F.count("*").alias("size")).where(F.col("size") > limit).select(*KEY), "oversized")
        if big.isEmpty():
            break
        inside = left.join(big, KEY, "left_semi")
        found = inside.groupBy(*KEY).agg(F.min("turns").alias("least"), F.max("turns").alias("most"), F.sum("n").alias("b_n"), F.min("m").alias("b_m"), F.first("depth").alias("b_depth"), F.first("path").alias("b_path"), F.first("head1").alias("b_head1"), F.first("head2").alias("b_head2"), F.first("head_m").alias("b_head_m"))
        differ = F.array_position(F.zip_with("least", "most", lambda a, b: a.id.eqNullSafe(b.id)), False)
        found = written(found.withColumn("shared", F.when(differ == 0, F.size("least")).otherwise(differ - 1).cast("int")).drop("most"), "burst")
        dealt = inside.join(found, KEY)
        # at most one suffix a container ends with the shared turns
        ended = dealt.where(F.size("turns") == F.col("shared")).select(*KEY, "ends", "x_children", "x_leaves", "x_saved")
        chain = written(found.withColumn("shared_turns", F.slice("least", 1, F.col("shared"))).drop("least").join(ended, KEY, "left").fillna(0, ["x_children", "x_leaves", "x_saved"]), "chains")
        burst = chain if burst is None else burst.unionByName(chain)
        child = {f"new{k}": F.xxhash64(F.lit(k), *KEY, F.col("turns")[F.col("shared")]["id"]) for k in (1, 2)}
        parted = dealt.where(F.size("turns") > F.col("shared")).withColumns(child).withColumns({
            "path": F.concat("path", F.array(F.struct(*KEY))), "depth": F.col("depth") + F.col("shared"), "head_m": F.when(F.col("shared") > 0, F.col("b_m")).otherwise(F.col("head_m")),
            "turns": F.slice("turns", F.col("shared") + 1, F.size("turns"))})
        parted = parted.withColumns({"c1": F.col("new1"), "c2": F.col("new2")}).select(left.columns)
        left = written(left.join(big, KEY, "left_anti").unionByName(parted), "suffixes")
    swept = left.repartition(*KEY).sortWithinPartitions(*KEY, "turns").mapInArrow(_sweep, _SWEPT)
    swept = written(swept, "swept")
    nodes, own = swept.where("is_node").select(*(c.split()[0] for c in NODE.split(", "))), swept.where("not is_node")
    counted = own.select(*KEY, *HEAD, "path", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    if burst is not None:
        chain_saved = F.aggregate("shared_turns", F.lit(0).cast("long"), lambda s, t: s + t.words) * (F.col("b_n") - 1)
        heads = burst.select(*KEY, F.col("b_head1").alias("head1"), F.col("b_head2").alias("head2"), F.col("b_path").alias("path"), F.when(F.col("shared") > 0, 1).cast("long").alias("children"), F.col("x_leaves").alias("leaves"), (chain_saved + F.col("x_saved")).alias("saved"))
        counted = counted.unionByName(heads)
        above = counted.select("leaves", "saved", F.size("path").alias("levels"), F.posexplode("path").alias("level", "up"))
        below = written(above.groupBy(F.col("up.c1").alias("c1"), F.col("up.c2").alias("c2")).agg(F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"), F.count_if(F.col("level") == F.col("levels") - 1).alias("parts")), "below")
        counted = counted.join(below.select(*KEY, "parts"), KEY, "left").withColumn("children", F.coalesce("children", "parts")).drop("parts")
        last = F.col("k") == F.col("shared") - 1
        later = F.aggregate(F.slice("shared_turns", F.col("k") + 1, F.col("shared")), F.lit(0).cast("long"), lambda s, t: s + t.words) * (F.col("b_n") - 1)
        line = burst.where("shared > 0").join(below, KEY).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("shared") - 1)))
        nodes = nodes.unionByName(line.select(
            F.col("b_m").alias("conv_id"), (F.col("b_depth") + F.col("k") + 1).alias("depth"), F.when(F.col("k") == 0, F.col("b_head_m")).otherwise(F.col("b_m")).alias("parent_conv_id"), F.col("b_n").alias("n_convs"),
            F.when(last, F.col("parts") + F.col("x_children")).otherwise(1).cast("long").alias("n_children"), (F.col("below_leaves") + F.col("x_leaves")).alias("n_leaves"), (F.col("below_saved") + F.col("x_saved") + later).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends_sha256")))
    by_head = counted.groupBy(*HEAD).agg(F.sum(F.when(F.size("path") == 0, F.col("children"))).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes, written(by_head, "totals")


def trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, limit: int = LIMIT) -> DataFrame:
    """The nodes of conversations: turns has conv_id, pos (from 0, without gaps), id (binary), words and total; convs has conv_id and total."""
    spark = turns.sparkSession
    parts = segments(turns, segment)
    ends = written(ends_of(parts, convs), "ends")
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("m")).first()
    if not root.n:
        return spark.createDataFrame([], NODE)
    units = written(parts.groupBy("seg", *HEAD, "next1", "next2").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.first("turns").alias("turns")), "units")
    above = units.select(F.col("next1").alias("head1"), F.col("next2").alias("head2"), F.col("m").alias("head_m"))
    units = written(units.join(above, HEAD, "left").withColumn("head_m", F.coalesce("head_m", F.lit(root.m))).join(ends, ["next1", "next2"], "left"), "units")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    totals, nodes = None, None
    for seg in range(units.agg(F.coalesce(F.max("seg"), F.lit(-1))).first()[0], -1, -1):
        own = units.where(F.col("seg") == seg).withColumn("depth", F.lit(seg * segment).cast("long"))
        if totals is None:
            own = own.withColumns({f"x_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            beyond = totals.select(F.col("head1").alias("next1"), F.col("head2").alias("next2"), *(F.col(c).alias(f"x_{c}") for c in ("children", "leaves", "saved")))
            own = own.join(beyond, ["next1", "next2"], "left").fillna(0, ["x_children", "x_leaves", "x_saved"])
        found, totals = _containers(own.select(*HEAD, "head_m", "depth", "turns", "n", "m", "ends", "x_children", "x_leaves", "x_saved"), limit)
        nodes = found if nodes is None else nodes.unionByName(found)
    top = totals.first() if totals is not None else None
    ended = ends.where("next1 = 0 and next2 = 0").first()
    head = spark.createDataFrame([(root.m, 0, None, root.n, top.children if top else 0, top.leaves if top else 1, top.saved if top else 0, ended.ends if ended else None)], NODE)
    nodes = head if nodes is None else nodes.unionByName(head)
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
