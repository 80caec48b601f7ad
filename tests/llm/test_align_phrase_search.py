"""Alignment, phrases and search against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import alignment, bitslices, lookups, phrases, queries

BYTE, PIECE = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, row long, key long, n long, phrase string, words string, block int, part int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 1, 1, "p", "w", 1, 1) for i, t, g in rows], SCHEMA)


TEXTS = [
    (1, None), (2, ""), (3, "The house by the river."), (3, "The house by the river."), (None, "no id"), (5, " \n\t  two  spaces \n"), (6, "don't I'LL <s> </s> <unk> <0x41> <|endoftext|>"),
    (7, "Ünïcödé 日本語 😀 é ﬁ ａ"), (8, "a▁b"), (9, "x" * 3000), (10, " ".join(f"word{i % 97} and{i}" for i in range(4000))), (11, "\x00 \x85　 \r\n end"),
]


def library(texts):
    """(a ids, b ids) of each text, or none, by the libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    tok.encode_special_tokens = True
    stand_in = {c: b for b, c in bytes_to_characters().items()}
    out = []
    for t in texts:
        if not t:
            out.append(([], [], []))
            continue
        raw = (" " + t).encode()
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        ba = [bytes(stand_in[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ba) != raw or b"".join(bb) != raw:
            out.append(([], [], []))
            continue
        groups, i, j, x, y = [], 0, 0, 0, 0
        pa, pb = 0, 0
        while i < len(a) or j < len(b):
            if x <= y:
                x += len(ba[i])
                i += 1
            else:
                y += len(bb[j])
                j += 1
            if x == y:
                groups.append((a[pa:i], b[pb:j]))
                pa, pb = i, j
        out.append((a, b, groups))
    return out


def bytes_to_characters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def brute_report(texts):
    found = library(texts)
    links = [[(g[0][-1], g[1][-1]) for g in groups] for *_, groups in found]
    count = Counter(x for l in links for x in l)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (a, b, groups), l in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_alignment_equals_the_libraries(spark, most):
    found = alignment.alignment_report(docs(spark, [(i, t, "en") for i, t in TEXTS]).repartition(3), BYTE, PIECE, most).collect()
    assert sorted((r.doc_id or -1, tuple(r)[1:]) for r in found) == sorted((i or -1, want) for (i, _), want in zip(TEXTS, brute_report([t for _, t in TEXTS])))


def test_alignment_of_real_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = df.orderBy("doc_id").collect()
    want = dict(zip((r.doc_id for r in rows), brute_report([r.text for r in rows])))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op11_token_alignment(spark, sf_dir).collect()} == want


def test_alignment_groups_and_empty_table(spark):
    got = alignment.align_documents(docs(spark, [(1, "don't stop", "en"), (2, None, "en")]), BYTE, PIECE, groups=True).collect()
    ((_, _, groups), _) = library(["don't stop", None])
    assert [r.groups for r in got] == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), ""]
    assert alignment.alignment_report(docs(spark, []), BYTE, PIECE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Zz'sé.,!-\n\t\r  　9日😀_\x1c▁<0x>"), max_size=30), min_size=1, max_size=4))
def test_pieces_equal_the_library(texts):
    ours = alignment.aligner(BYTE, PIECE).b
    got = [x.tolist() for x in ours.encode_many([" " + t for t in texts])]
    for t, ids in zip(texts, got):
        if "▁" not in t and t:
            assert ids == ours.sp.encode(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 6))
def test_components_are_the_cuts(sizes, at):
    a = np.array(sizes)
    b = np.diff([0, *sorted({*(x for x in range(at, int(a.sum()), at + 1)), int(a.sum())})])
    x = alignment.align(a, b)
    cuts = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
    assert np.searchsorted(cuts, np.cumsum(a)).tolist() == x.group_a.tolist() and np.searchsorted(cuts, np.cumsum(b)).tolist() == x.group_b.tolist()
    assert np.cumsum(a)[x.link_a].tolist() == cuts == np.cumsum(b)[x.link_b].tolist()


def test_long_components():
    n = 50_000  # no end in common but the last one
    x = alignment.align(np.array([2] * n), np.array([1, *[2] * (n - 1), 1]))
    assert x.group_a.max() == x.group_b.max() == 0 and len(x.link_a) == 1


def brute_phrases(rows, least, top):
    n, f = Counter(), Counter()
    for _, t, g in rows:
        g = "und" if g is None else g
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[g, tuple(w[i : i + k])] += 1
    out = []
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = {}
    for (g, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[g, w[i : i + k]] = max(longer.get((g, w[i : i + k]), 0), a)
    for (g, w), a in candidates.items():
        if 100 * longer.get((g, w), 0) >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        out.append((g, " ".join(w), a, l, r, n[g], score))
    ranked = []
    for g in n:
        own = sorted((x for x in out if x[0] == g), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(g, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


PHRASE_ROWS = [
    *[(i, "New York is a big city. The\tNEW york times, new york", "en") for i in range(4)], *[(i, "new york is a big city", None) for i in range(3)], (90, "a a a a a a", "en"), (91, None, "en"), (92, "", "fr"),
    (93, "x\x1cy x\x1cy x\x1cy  x y x\x01 y x y x\x01 y x y x y", "xx"), (94, "é ô é ô É ô é ô\ré ô", "fr"), (95, ("z" * 100 + " tail ") * 5, "en"), (96, " ".join(["one two three four five"] * 2000), "de"),
]


@pytest.mark.parametrize("options", [{}, {"most_words": 3}, {"most_words": 0}, {"longest": 2}])
def test_phrases_equal_brute_force(spark, options):
    got = phrases.collocations(docs(spark, PHRASE_ROWS).repartition(3), least=2, top=9, **options).collect()
    assert sorted(map(tuple, got)) == brute_phrases(PHRASE_ROWS, 2, 9)


def test_phrases_of_an_empty_table_and_slabs(spark, monkeypatch):
    assert phrases.collocations(docs(spark, [])).count() == 0
    monkeypatch.setattr(phrases, "SLAB", 16)
    text = b"One  two, three four five six\nseven eight nine ten eleven twelve"
    assert [w for part in phrases.tokens([text, b"last"]) for w in part if w] == [*b"one two \n three four five six \n seven eight nine ten eleven twelve \n last".split(b" ")]


def test_radix_order_and_run_lengths():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 1 << 40, 3000) // (1 << 37), rng.integers(0, 1 << 62, 3000) // (1 << 59)
    assert radix_list(hi, lo) == sorted(zip(hi.tolist(), lo.tolist()))
    h, l, n = phrases.run_lengths(hi, lo)
    assert dict(zip(zip(h.tolist(), l.tolist()), n.tolist())) == Counter(zip(hi.tolist(), lo.tolist()))


def radix_list(hi, lo):
    order = phrases.radix_order(hi, lo)
    return list(zip(hi[order].tolist(), lo[order].tolist()))


def test_scores_beyond_64_bits(spark):
    big = 1 << 60
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, n long")
    (r,) = phrases.score_by_cuts(counts).collect()
    assert (r.l, r.r, r.score) == (big, big + 7, 2000000 * (big - 1) // (2 * big + 7))


def test_largest_counts(spark):
    df = spark.createDataFrame([(i,) for i in [1] * 50 + [40] * 5 + [90]], "n long")
    assert sorted(r.n for r in lookups.largest_counts(df, "n", 10).collect()) == [40] * 5 + [90]
    assert lookups.largest_counts(df, "n", 0).count() == 0 and lookups.largest_counts(df, "n", 56).count() == 56


def brute_search(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and math.hypot(*[1024 * x for x in v], 0) < 2**31]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(ok) if n != at and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def vectors(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, row long, block int, x int")


def search(df, k):
    return sorted(map(tuple, bitslices.top_k(df, F.pmod("vec_id", F.lit(100)) == 0, k).collect()))


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(400)] + [(1000 + i, [0.5, -0.25, 0.0, 1.0, 2.0]) for i in range(150)]
    rows += [(100, rows[100][1]), (100, [1.0] * 5), (200, None), (300, [1.0, None, 2.0, 0.0, 0.0]), (400, [float("nan")] * 5), (500, [float("inf"), 0, 0, 0, 0.0]), (None, [1.0] * 5), (600, [0.0] * 5), (700, []), (701, []), (800, [3.0, 4.0]), (900, [1e300] * 5), (1100, [1e5, -1e5, 3e4, 1.0, 0.0])]
    assert search(vectors(spark, rows).repartition(5), 10) == brute_search(rows, 10)
    assert search(vectors(spark, []), 10) == []


def test_search_over_many_blocks(spark, monkeypatch):
    for name, n in (("BLOCK", 64), ("LEAST_BLOCK", 16), ("QUERIES", 2)):
        monkeypatch.setattr(bitslices, name, n)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 8) / 8).tolist()) for i in range(500)]
    assert search(vectors(spark, rows), 10) == brute_search(rows, 10)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 130), st.integers(1, 12))
def test_slices_add_up(seed, n, k):
    rng = np.random.default_rng(seed)
    scale = 2 ** int(rng.integers(1, 25))
    x, w = rng.integers(-scale, scale, (n, 4)), rng.integers(-scale, scale, 4)
    found = [(-1, 0, 64, np.arange(n).astype("<i8").tobytes()), (-2, 0, 64, np.arange(n).astype("<i8").tobytes())]
    for at in range(4):
        least, slices = bitslices.slices_of(x[:, at])
        found.append((at, least, len(slices), slices.tobytes()))
    import pandas as pd

    block = bitslices.Block(pd.DataFrame(found, columns=["at", "least", "bits", "slices"]))
    assert (block.values == x).all()
    ids, score = block.search(-1, w, k)
    want = sorted(zip((-(x @ w)).tolist(), range(n)))[:k]
    assert list(zip((-score).tolist(), ids.tolist())) == want
