"""Near duplicates by fast similarity sketching, banding and exact verification.

A text's set holds its distinct shingles of `words` words (64-bit hashes); a text of fewer words,
but some, has its whole sequence as the one member. Sketch: in round i < t every member is hashed
to one of t bins with value i + hash, in round t + j all members are hashed into bin j; each bin
keeps its minimum, and the rounds end when all bins are filled. So every coordinate is filled after
2t rounds, mostly after few, and coordinates agree as often as the sets are similar.

Equal sets form a class, of which the smallest id stands for all. The sketches of the classes are
cut into bands; classes that agree in a band form a group. Links are verified on full sets in units of bounded
memory, in two rounds. First the groups of the first few bands: a group of more than `block` members (or of many
bytes) is dealt into hash blocks, each joined by two members that all blocks share, and a unit holds all pairs of a block.
What these links connect shares a label. Then the groups of all bands that hold more than one label: a small
one is a unit; of a large one, the members without the label of its first shared member, in blocks, meet all members, in blocks.
Pairs that are left out are connected already, so no link between components is lost, and near copies of one
text cost units in proportion to their number. A unit returns the forest of its links, not the links. Components come from these forests.

The number of bands makes a linked pair miss all bands with a probability of at most `miss`.
Sets so small that any difference breaks the threshold take part in classes only, which is exact.

Null or empty text has no set and is linked with nothing. A null id gets a null component and is
kept. Rows are not merged: repeated rows share their component. doc_id is taken to identify a text. Texts of any length are
compared whole, an empty table gives an empty result, and extra columns are left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .runtime import cut, map_arrow, pick
from .text import SPACED, U, Words, distinct_pairs, mix, raw, slices

FULL = U(2**64 - 1)


def shape(percent: int, rows: int = 5, miss: float = 1e-8) -> tuple[int, int]:
    """(bands, rows a band) for a link threshold in percent."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(percent / 100, 0.99) ** rows))), rows


def sketches(d: np.ndarray, g: np.ndarray, n: int, t: int) -> np.ndarray:
    """The sketch (t values) of each of n sets, given members g of sets d."""
    out = np.full((n, t), FULL)
    flat = out.reshape(-1)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = mix(g ^ mix(np.array([i + 1], U) * U(0x9E3779B97F4A7C15)))
            b = ((h >> U(40)) * U(t) >> U(24)).astype(np.int64) if i < t else np.full(len(g), i - t)
            np.minimum.at(flat, d * t + b, (U(i) << U(40)) | (h & U(2**40 - 1)))
            busy = np.unique(d)
            open_ = np.zeros(n, bool)
            open_[busy[(out[busy] == FULL).any(axis=1)]] = True
            keep = open_[d]
            d, g = d[keep], g[keep]
            if not len(d):
                break
    return out


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = s.reshape(len(s), bands, rows)
    h = np.zeros(s.shape[:2], U)
    with np.errstate(over="ignore"):
        for j in range(rows):
            h = mix(h * U(3) ^ s[:, :, j])
        return mix(h + np.arange(bands, dtype=U) * U(0xD6E8FEB86659FD93))


def _describe(batch: pa.RecordBatch, id_col: str, text_col: str, words: int, least: int, bands: int, rows: int):
    for part in slices(batch, text_col, 2 << 20):
        data, off = raw(part.column(text_col))
        w = Words(data, off, SPACED)
        d, g = distinct_pairs(*w.shingles(words))
        n = part.num_rows
        first = np.searchsorted(d, np.arange(n + 1))
        size = np.diff(first)
        with np.errstate(over="ignore"):
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(g ^ U(seed)), dtype=U)]) for seed in (0x51ED27, 0xA3F1C9)]
            sig = [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums]
        use = size >= least
        m = use[d]
        new = np.cumsum(use) - 1
        h = band_hashes(sketches(new[d[m]], g[m], int(use.sum()), bands * rows), bands, rows).view(np.int64) if use.any() else np.empty((0, bands), np.int64)
        edges = np.concatenate([[0], np.cumsum(np.where(use, bands, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column(id_col), pa.array(size), pa.array(np.diff(off)), pa.array(sig[0], mask=size == 0), pa.array(sig[1], mask=size == 0), pa.ListArray.from_arrays(edges, pa.array(h.reshape(-1)))],
            ["doc", "n_shingles", "n_bytes", "s1", "s2", "bands"],
        )


def _forest(nodes: np.ndarray, d: np.ndarray, g: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) by the links among these sets."""
    n = len(nodes)
    order = np.argsort(g, kind="stable")
    gs, ds = g[order], d[order]
    new = np.ones(len(gs), bool)
    new[1:] = gs[1:] != gs[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    ds, col = ds[shared], col[shared]
    inter = np.zeros((n, n), np.float32 if size.max(initial=0) < 1 << 24 else np.float64)
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        cuts = np.searchsorted(col, np.arange(0, col[-1] + 8193, 8192))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = np.zeros((n, 8192 if len(cuts) > 2 else int(col[-1]) + 1), inter.dtype)
            x[ds[a:b], col[a:b] % 8192] = 1
            inter += x @ x.T
    inter = inter.astype(np.int64)
    link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    label = np.arange(n)
    rank = np.argsort(nodes, kind="stable")
    link = link[np.ix_(rank, rank)]
    np.fill_diagonal(link, True)
    while True:
        best = np.where(link, label[None, :], n).min(axis=1)
        best = np.minimum(best, best[best])
        if (best == label).all():
            break
        label = best
    own = nodes[rank]
    moved = label != np.arange(n)
    return own[moved], own[label[moved]]


def _verify(tables, words: int, percent: int):
    """Streams rows sorted by unit; each unit's rows are contiguous."""

    def emit(t: pa.Table):
        key = [t.column(c).to_numpy() for c in ("k", "h", "i", "j")]
        edge = np.ones(t.num_rows, bool)
        edge[1:] = np.any([x[1:] != x[:-1] for x in key], axis=0)
        unit = np.cumsum(edge) - 1
        nodes = t.column("node").to_numpy()
        d, g = distinct_pairs(*Words(*raw(t.column("text")), SPACED).shingles(words))
        size = np.bincount(d, minlength=t.num_rows)
        first = np.searchsorted(unit, np.arange(unit[-1] + 2))
        spot = np.searchsorted(d, first)
        for a, b, p, q in zip(first[:-1], first[1:], spot[:-1], spot[1:], strict=True):
            yield _forest(nodes[a:b], d[p:q] - a, g[p:q], size[a:b], percent)

    def finish(t: pa.Table):
        found = list(emit(t))
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held: list[pa.Table] = []
    size = 0
    last = None
    for batch in tables:
        for part in slices(batch, "text"):
            t = pa.Table.from_batches([part])
            key = np.stack([t.column(c).to_numpy() for c in ("k", "h", "i", "j")])
            ends = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
            start = 0
            if last is not None and (key[:, 0] != last).any() and size > 1 << 20:
                yield finish(pa.concat_tables(held).combine_chunks())
                held, size = [], 0
            elif size > 1 << 20 and len(ends):
                yield finish(pa.concat_tables([*held, t.slice(0, ends[0])]).combine_chunks())
                held, size, start = [], 0, int(ends[0])
            held.append(t.slice(start))
            size += len(raw(part.column("text"))[0])
            last = key[:, -1]
    if held:
        yield finish(pa.concat_tables(held).combine_chunks())


def _block(node: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col(blocks))


def _groups(member: DataFrame, block: int, block_bytes: int, label: str | None = None) -> DataFrame:
    """(k, h, blocks, hub, hub2 and, with label, the least and the greatest label) of groups of two members or more, once for each set of members."""
    hub = F.struct(F.xxhash64(F.lit(7), "node").alias("order"), "node", *([label] if label else []))
    more = [F.min(label).alias("least"), F.max(label).alias("most")] if label else []
    return (
        member.groupBy("k", "h")
        .agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"), *[F.sum(F.xxhash64(F.lit(s), "node").bitwiseAND(F.lit((1 << 40) - 1))).alias(f"x{s}") for s in (1, 2)], F.min(hub).alias("hub"), F.max(hub).alias("hub2"), *more)
        .where("n > 1")
        .groupBy("n", "x1", "x2")  # bands that give the same group
        .agg(F.min(F.struct("k", "h")).alias("of"), *[F.first(c).alias(c) for c in ("bytes", "hub", "hub2", *(["least", "most"] if label else []))])
        .select("of.k", "of.h", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).alias("blocks"), "hub", "hub2", *(["least", "most"] if label else []))
    )


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, rows: int = 5, miss: float = 1e-8, block: int = 192, block_bytes: int = 8_000_000, broadcast_ids: int = 1_000_000, quick: int = 4
) -> DataFrame:
    """For each row: id, n_shingles, component_id (smallest id that is reachable by links) and kept (id = component_id).

    percent: texts are linked where 100 * intersection >= percent * union. quick: bands of the first round.
    """
    bands, rows = shape(percent, rows, miss)
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62
    text = pick(docs, id_col, text_col)
    kind = text.schema[id_col].dataType.simpleString()
    base = cut(map_arrow(text, lambda b: _describe(b, id_col, text_col, words, least, bands, rows), f"doc {kind}, n_shingles long, n_bytes long, s1 long, s2 long, bands array<long>"))

    key = ["s1", "s2", "n_shingles"]
    classes = cut(base.where("doc is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc").alias("rep")))  # cut, so that the join below can split a large class
    named = cut(base.join(classes, key, "left").select("doc", "n_shingles", "n_bytes", F.when(F.col("doc").isNotNull(), F.col("rep")).alias("rep"), F.when(F.col("doc") == F.col("rep"), F.col("bands")).alias("bands")))

    # one row a class; repeated rows of an id are one
    reps = cut(named.where("size(bands) > 0").groupBy("doc").agg(F.max("n_bytes").alias("n_bytes"), F.first("bands").alias("bands")))
    wanted = text.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{text_col}`").alias("text"))

    def verified(units: DataFrame) -> DataFrame:
        nodes = units.select("node").distinct()
        texts = wanted.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= broadcast_ids else wanted  # only ids, of which the number has been checked
        sorted_ = units.join(texts.dropDuplicates(["node"]), "node").repartition("k", "h", "i", "j").sortWithinPartitions("k", "h", "i", "j")
        return sorted_.mapInArrow(lambda it: _verify(it, words, percent), f"u {kind}, v {kind}")

    member = reps.select(F.col("doc").alias("node"), "n_bytes", F.posexplode(F.slice("bands", 1, quick)).alias("k", "h"))
    one = member.join(_groups(member, block, block_bytes), ["k", "h"]).withColumn("mine", _block("node", "blocks"))
    shared = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    units = cut(one.select("node", "k", "h", F.explode(F.when(F.col("node").isin(F.col("hub.node"), F.col("hub2.node")), shared).otherwise(F.array("mine"))).alias("i"), F.lit(-1).cast("long").alias("j")))
    first = cut(components(verified(units)))

    labelled = cut(reps.join(first, reps["doc"] == first["node"], "left").select("doc", "n_bytes", "bands", F.coalesce("root", "doc").alias("label")))
    member = labelled.select(F.col("doc").alias("node"), "label", "n_bytes", F.posexplode("bands").alias("k", "h"))
    mixed = cut(_groups(member, block, block_bytes, "label").where("least <> most").drop("least", "most", "hub2"))
    both = member.join(mixed, ["k", "h"]).withColumn("mine", _block("node", "blocks"))
    zero = F.lit(0).cast("long")
    units = both.where("blocks = 1").select("node", "k", "h", zero.alias("i"), zero.alias("j"))
    if not mixed.where("blocks > 1").isEmpty():
        large = cut(both.where("blocks > 1").withColumn("rest", F.col("label") != F.col("hub.label")))
        few = large.where("rest").groupBy("k", "h").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_bytes") / block_bytes)).alias("few"))
        large = large.join(few, ["k", "h"]).withColumn("own", _block("node", "few"))
        turn = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
        rest = large.where("rest").select("node", "k", "h", F.col("own").alias("i"), turn("blocks").alias("j"))
        units = units.unionByName(rest.unionByName(large.select("node", "k", "h", turn("few").alias("i"), F.col("mine").alias("j"))).distinct())
    links = first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(verified(cut(units)))
    roots = cut(components(links))  # cut, so that the join below can split a large class
    return (
        named.join(roots, named["rep"] == roots["node"], "left")
        .select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("root", "rep", "doc").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))
    )
