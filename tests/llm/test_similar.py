"""Near-dedup of the pipeline against brute force, on edited copies of known similarity."""

import random
import re
from collections import Counter, defaultdict

import pytest

from corpus_pipeline import simhash_near_dedup
from rankloom.llm import similar, stores, work
from rankloom.llm.sketches import Shingler

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def made(seed=7, n=40):
    """Texts of 60 to 300 words with up to three copies of a tenth fewer five-word runs each, and looser ones."""
    draw, rows = random.Random(seed), []
    for k in range(n):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 300))]
        rows.append((len(rows), " ".join(words)))
        for share in (0.01, 0.02, 0.05):
            copy = list(words)
            for at in draw.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def brute(rows):
    """The ids that stay: the smallest of each component of pairs of 0.8 or more."""
    sets = {i: set(Shingler().shingles(t or "").tolist()) for i, t in rows}
    of = {i: i for i in sets}
    close = 0
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                close += 1
                low, high = sorted((of[a], of[b]))
                of = {i: low if x == high else x for i, x in of.items()}
    return {i for i, x in of.items() if i == x}, close


def brute_by_text(rows, words=5):
    """As brute, from the shingles' texts; pairs that share no shingle can't be similar and aren't compared."""
    sets, holders, of = {}, defaultdict(list), {}
    for i, t in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i], of[i] = {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}, i
    for i in sorted(sets):
        shared = defaultdict(int)
        for x in sets[i]:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, n in shared.items():
            if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = {k: low if x == high else x for k, x in of.items()}
    return {i for i, x in of.items() if i == x}


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    stay = brute_by_text(rows)
    got = [r.doc_id for r in similar.one_of_similar(table).select("doc_id").collect()]
    assert len(stay) < len(rows) and sorted(got) == sorted(stay)


def test_edited_copies_go(spark):
    rows = [*made(), (900, None), (901, " "), (902, "short one"), (903, "Short  ONE"), (904, "another")]
    stay, close = brute(rows)
    got = [r.doc_id for r in simhash_near_dedup(spark, docs(spark, rows), "").collect()]
    assert close > 40 and len(got) == len(set(got)) and set(got) == stay


def test_rows_not_ids_decide(spark):
    a, b, c = ([f"{x}{k}" for k in range(80)] for x in "abc")
    text = [" ".join(x) for x in (a, b, c)]
    edited = " ".join(["new", *a[1:]])
    rows = [(1, text[0]), (2, edited), (2, text[1]), (3, text[2]), (3, text[2]), (None, text[1] + " more"), (None, "no id")]
    got = similar.one_of_similar(docs(spark, rows))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, text[0]), (2, text[1]), (3, text[2]), (0, "no id")])
    assert similar.one_of_similar(docs(spark, [])).count() == 0


def test_a_chain_of_loosely_similar_texts_makes_no_large_set(spark):
    words = [f"w{k}" for k in range(18 * 400)]
    rows = [(k, " ".join(words[18 * k : 18 * k + 90])) for k in range(395)]  # a similarity of 0.65 to the next one
    prints = similar.marks(spark.createDataFrame([(i, i, t) for i, t in rows], "key long, text_hash long, text string"))
    sets = similar.candidate_sets(prints.select("node", "fp", "bands"), len(rows)).collect()
    sizes = Counter(r.component for r in sets)
    linked = {}
    for r in sets:
        linked.setdefault(r.component, []).append(r.node)
    closed = {i: i for r in sets for i in [r.node]}
    for nodes in linked.values():
        old = {closed[x] for x in nodes}
        closed = {x: min(old) if c in old else c for x, c in closed.items()}
    assert max(sizes.values()) <= 8 and max(Counter(closed.values()).values()) > 12  # closed over each other, the sets would run along the chain
    assert similar.one_of_similar(docs(spark, rows)).count() == len(rows)


def test_paths_are_qualified_on_the_driver(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://127.0.0.1:8020")
        assert work.qualified(spark, "/shared/x") == "hdfs://127.0.0.1:8020/shared/x" and work.qualified(spark, "file:///tmp/x").startswith("file:/")
    finally:
        conf.set("fs.defaultFS", old)
    assert stores.arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and stores.arrow_uri("wasbs://c@acc.blob.core.windows.net/p") == "abfss://c@acc.dfs.core.windows.net/p"
    assert stores.arrow_uri("hdfs://n:8020/p") == "hdfs://n:8020/p" and stores.locate("file:///tmp/a")[1] == "/tmp/a"
    with pytest.raises(ValueError):
        stores.locate("/shared/x")
