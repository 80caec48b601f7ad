"""One document of each group of similar texts: five-word shingles, Jaccard similarity of 0.8 or more.

Candidates are texts whose SimHash fingerprints the trie self-join links, and
texts that agree in one of ``BANDS`` bands of ``ROWS`` MinHash values each, which
finds a pair of similarity s with probability 1 - (1 - s**ROWS)**BANDS: 0.9993
at 0.8, more above. Texts of one band, or of one set that the trie join connects, are
compared by their whole shingle sets; only pairs that reach the similarity are links,
and only links are closed over. So texts that share a passage with others don't draw
these into one large set. Texts of equal shingle sets are one node from the start
and are never compared.

A task compares the texts of one candidate set. A set of more than
``MOST`` shingles, or of more than a task's fair share, is cut into chunks that
meet pairwise in tasks of their own, so no group is gathered whole and no pair is
lost. Whole texts are shuffled for candidates only: a bitmap tells the others
apart (see :mod:`rankloom.llm.lookups`).

Edge cases: null text is empty, and empty texts are alike; fewer than five words
make one shingle; rows are told apart by id and text, so texts that share an id
are judged one by one, and rows without an id take part. Of a group the row of
the smallest id stays; of rows alike in id and text one. Texts of any length are
compared whole; an empty table gives no rows; extra columns are kept as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.lookups import fair_share, lookup, maybe
from rankloom.llm.simhash import NO_ID, SEED, fingerprint, trie_edges
from rankloom.llm.sketches import WORDS, Shingler, mix
from rankloom.llm.work import drop, table

LEAST = 0.8
BANDS, ROWS = 24, 6
CHUNK = 512  # shingles hashed at a time
MOST = 8_000_000  # shingles of one set of candidates, or of one chunk of it, that a task holds
SPLIT = 8  # chunks that a set below MOST is cut into at most, to share its work
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band, none for an empty set."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), CHUNK):
        least = np.minimum(least, np.multiply.outer(FACTORS, shingles[i : i + CHUNK]).min(axis=1))
    rows = mix(least ^ FACTORS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return (mix(rows) >> np.uint64(1)).view(np.int64)


def marks(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """key, text_hash, node (of the shingle set), size (shingles), fp and bands for rows of (key, text_hash, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        shingler = Shingler()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(2).to_pylist()
                sets = [shingler.shingles(t) for t in texts]
                node = pa.array([xxh64_intdigest(h.tobytes(), SEED) >> 2 for h in sets], pa.int64())
                size = pa.array([len(h) for h in sets], pa.int64())
                fp = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
                bands = pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), part.column(1), node, size, pa.array(fp), bands], names=["key", "text_hash", "node", "size", "fp", "bands"])

    return rows.mapInArrow(run, "key long, text_hash long, node long, size long, fp long, bands array<long>")


def candidate_sets(nodes: DataFrame, n: int, budget: int = 4) -> DataFrame:
    """component, node: the candidate sets of the ``n`` distinct nodes (node, fp, bands), as rows; a node may be in several.

    A set is what shares one band, or what the trie join connects. Sets are not
    closed over each other, since most of their pairs are no true ones. Of equal sets one is kept.
    """
    of_fp = table(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "fp-nodes")
    linked = components(trie_edges(of_fp.select("fp", F.col("rep").alias("node")), of_fp.count(), budget)).select(F.col("node").alias("rep"), "component")
    told = of_fp.join(linked, "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component"))
    several = told.groupBy("component").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("component")
    of_trie = table(told.join(several, "component").select("fp", "n", "component"), "trie-sets")
    by_trie = lookup(nodes.select("fp", "node"), of_trie, "fp", fair_share(n, nodes), "inner").select(F.xxhash64(F.lit("trie"), "component").alias("component"), "node")
    dealt = nodes.select("node", F.explode("bands").alias("band"))
    held = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1")
    shared = table(held.groupBy("n", "least", "mark").agg(F.min("band").alias("band")).select("band", "n"), "bands")
    likely = maybe(dealt, F.col("band"), shared, F.col("band"), shared.count()).where("_maybe").drop("_maybe")
    by_band = lookup(likely, shared.withColumn("component", F.xxhash64(F.lit("band"), "band")), "band", fair_share(n, nodes), "inner").select("component", "node")
    return by_trie.unionByName(by_band)


def exact_groups(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """Component of each set, first one's position, over all pairs of a similarity of ``least`` or more.

    Two such sets share one of the rarest shingles of either: the first
    size - ceil(least * size) + 1 in one order of all shingles, rarest first. Only
    sets that meet there are compared.
    """
    n = len(sets)
    group, size = np.arange(n), np.array([len(s) for s in sets])
    if n < 2:
        return group
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((which, count[which], owner))
    first = np.cumsum(size) - size
    rare = np.arange(len(flat)) - first[owner] < (size - np.ceil(least * size - 1e-9) + 1)[owner]
    of_set, shingle = owner[rare], which[order][rare]
    at = np.r_[0, np.cumsum(np.bincount(of_set, minlength=n))]
    by = np.argsort(shingle, kind="stable")
    posted, ends = of_set[by], np.cumsum(np.bincount(shingle, minlength=len(count)))
    starts = np.r_[0, ends[:-1]]
    open_ = np.ones(n, dtype=bool)
    for head in range(n):
        if not open_[head]:
            continue
        open_[head] = False
        reached = [head]
        while reached:
            u = reached.pop()
            if not size[u]:
                continue
            met = np.unique(np.concatenate([posted[starts[x] : ends[x]] for x in shingle[at[u] : at[u + 1]]]))
            fit = met[open_[met]]
            fit = fit[np.minimum(size[fit], size[u]) >= least * np.maximum(size[fit], size[u]) - 1e-9]
            for i in range(0, len(fit), 1024):
                some = fit[i : i + 1024]
                other = np.concatenate([sets[k] for k in some])
                hit = sets[u][np.minimum(np.searchsorted(sets[u], other), size[u] - 1)] == other
                both = np.add.reduceat(hit, np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
                near = some[both >= least * (size[some] + size[u] - both) - 1e-9]
                group[near], open_[near] = head, False
                reached += near.tolist()
    return group


def settled(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """node, group for rows of (component, meet, node, text): texts that meet are compared in one task; a node has a row for each of its sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        now, nodes, sets = None, [], []

        def out() -> pa.RecordBatch:
            group = exact_groups(sets, least)
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([nodes[g] for g in group], pa.int64())], names=["node", "group"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for component, meet, node, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    if (component, meet) != now:
                        if nodes:
                            yield out()
                        now, nodes, sets = (component, meet), [], []
                    if not nodes or nodes[-1] != node:  # a row may be there twice
                        nodes.append(node)
                        sets.append(shingler.shingles(text))
        if nodes:
            yield out()

    dealt = rows.select("component", "meet", "node", "text").repartition("component", "meet")
    return dealt.sortWithinPartitions("component", "meet", "node").mapInArrow(run, "node long, group long")


def groups(rows: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """node, group (its smallest node; a group's smallest node has no row) of the asked nodes (component, node, size, key, text_hash), by true links within the sets."""
    total = asked.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    share = max(20_000, (total["size"] or 0) // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    needed = lambda most: F.ceil(F.col("size") / F.lit(most)).cast("int")
    large = asked.groupBy("component").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(F.col("size") > min(MOST, share))
    large = table(large.select("component", "n", F.greatest(needed(MOST), F.least(F.lit(SPLIT), needed(share))).alias("chunks")), "large-sets")
    own = F.struct("key", "text_hash")
    likely = maybe(rows, F.xxhash64(own), asked, F.xxhash64(own), total.n).where("_maybe").drop("_maybe")
    met = likely.join(asked.select("component", "node", "key", "text_hash"), ["key", "text_hash"])
    if large.take(1):
        cut = lookup(met.select("component", "node", "text"), large, "component", fair_share(total.n, rows))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int"))
        meets = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.least(x, "own") * F.col("chunks") + F.greatest(x, "own")))
        dealt = cut.select("component", "node", "text", F.explode(meets).alias("meet"))
    else:
        dealt = met.withColumn("meet", F.lit(0))
    links = table(settled(dealt, least).where("node <> group").distinct(), "similar-links")
    linked = components(links.select(F.col("node").alias("u"), F.col("group").alias("v")))
    return linked.select("node", F.col("component").alias("group"))


def one_of_similar(df: DataFrame, least: float = LEAST, budget: int = 4) -> DataFrame:
    """The rows of ``df`` without all but one row of each group of similar texts."""
    text = F.coalesce("text", F.lit(""))
    hashed = F.xxhash64(text)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + hashed.bitwiseAND(F.lit(NO_ID - 1)))
    keyed = df.select(F.struct(*df.columns).alias("doc"), own.alias("key"), hashed.alias("text_hash"))
    rows = df.select(own.alias("key"), hashed.alias("text_hash"), text.alias("text"))
    prints = table(marks(rows), "fingerprints")
    row = F.struct("key", "text_hash")
    nodes = table(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min(row).alias("row"), F.count("*").alias("n")), "nodes")
    n_rows, n = prints.count(), nodes.count()
    linked = candidate_sets(nodes.select("node", "fp", "bands"), n, budget)
    asked = table(linked.join(nodes, "node").select("component", "node", "size", "row.key", "row.text_hash"), "candidates")
    group = groups(rows, asked, least)
    # every node whose rows aren't all alone: of a group of several nodes, or of several rows
    of_node = nodes.join(group, "node", "left").select("node", "n", F.coalesce("group", "node").alias("group"))
    of = lookup(prints.select("key", "text_hash", "node"), of_node, "node", fair_share(n_rows, df)).select("key", "text_hash", "group")
    of = table(of, "row-groups")
    stays = of.groupBy("group").agg(F.min(row).alias("stays"), F.max(row).alias("last"), F.count("*").alias("n")).where("stays <> last").drop("last")
    going = table(lookup(of, stays, "group", fair_share(n_rows, df), "inner").where(row != F.col("stays")).select("key", "text_hash").distinct(), "duplicates")
    told = maybe(keyed, F.xxhash64(row), going, F.xxhash64(row), going.count())
    left = told.where("NOT _maybe").drop("_maybe").unionByName(told.where("_maybe").drop("_maybe").join(going, ["key", "text_hash"], "left_anti"))
    again = table(prints.groupBy("key", "text_hash").count().where("count > 1").select("key", "text_hash"), "repeated-rows")
    if again.take(1):
        left = left.join(again, ["key", "text_hash"], "left_anti").unionByName(left.join(again, ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"]))
    return left.select("doc.*")
