"""Lexical search, packing along a curve and vector codes, held against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clonoform.llm import curve_packing, lexical_search, queries, vector_codes
from clonoform.llm.common import table, tokenizer_path
from clonoform.llm.hilbert import hilbert_keys

DOCS = "doc_id long, text string, key long, rid long, label string, score long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "x", 7) for r in rows], DOCS)


# --- Hilbert keys -------------------------------------------------------------------------
@pytest.mark.parametrize(("axes", "bits"), [(1, 6), (2, 4), (3, 3), (4, 2), (5, 1)])
def test_keys_walk_the_grid_step_by_step(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_keys_need_room():
    with pytest.raises(ValueError, match="63"):
        hilbert_keys(np.zeros((1, 8), int), 8)


# --- packing along the curve --------------------------------------------------------------
def packed(rows, texts, capacity, end_id):
    """Checks the contract of packing and returns the lengths of the sequences."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = Counter()
    for doc, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        want[doc, len(ids)] += 1
        own = sorted(set(pieces[doc, len(ids)]))
        if want[doc, len(ids)] == 1 and len(own) == len(pieces[doc, len(ids)]):
            assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and sum(own[-1][:2]) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in own)
    assert set(want) == set(pieces)
    assert sum(r["length"] for r in rows) == sum(n * k for (_, n), k in want.items())
    out = []
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c[0] for (a, b), c in zip(parts, parts[1:], strict=False))
        out.append(sum(parts[-1]))
    assert max(out, default=0) <= capacity
    return out


def test_packing_of_whole_documents(spark, sf_dir):
    rows = queries.op11_curve_packing(spark, sf_dir).collect()
    lengths = packed(rows, [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()], 4096, 2)
    rest = sorted(n for n in lengths if n < 4096)
    assert all(n & (n - 1) == 0 for n in rest) and len(set(rest)) == len(rest)


def test_packing_of_odd_documents(spark):
    odd = [(1, None), (2, ""), (3, "Plain words"), (None, "no id"), (4, "x y " * 5_000), (5, "\n \t "), (6, "É́ ñ 中文 🎉")]
    rows = curve_packing.pack_along_curve(docs_of(spark, odd), tokenizer_path(), 2, 64, with_ids=True).collect()
    lengths = packed(rows, odd, 64, 2)
    assert sum(n < 64 for n in lengths) <= 6 and all(n & (n - 1) == 0 for n in lengths)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    many = [(1, "the same words")] * 40
    again = curve_packing.pack_along_curve(docs_of(spark, many), tokenizer_path(), 2, 8).collect()
    assert sum(r["length"] for r in again) == sum(packed(again, many, 8, 2)) == 160
    assert curve_packing.pack_along_curve(docs_of(spark, []), tokenizer_path()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.sampled_from([16, 64, 128]))
def test_rest_is_powers_of_two(total, capacity):
    full, tail = curve_packing.sequence_starts(total, capacity)
    lengths = np.diff(tail).tolist()
    assert full * capacity + sum(lengths) == total == tail[-1] and lengths == sorted(set(lengths), reverse=True)
    assert all(n & (n - 1) == 0 and n < capacity for n in lengths)


def test_neighbours_share_words(spark):
    """Documents of one vocabulary lie together along the curve."""
    rng = np.random.default_rng(3)
    words = [[f"{a}{b}" for b in "aeiouy" for a in c] for c in ("bcdf", "ghjk", "lmnp")]
    rows = [(i, " ".join(rng.choice(words[i % 3], 60))) for i in range(90)]
    got = curve_packing.pack_along_curve(docs_of(spark, rows), tokenizer_path(), 2, 4096).orderBy("sequence_id", "offset").collect()
    kinds = [r["doc_id"] % 3 for r in got if r["start"] == 0]
    assert sum(a == b for a, b in zip(kinds, kinds[1:], strict=False)) > 55


# --- vector codes -------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, rid long, code string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS)


def plain_codes(rows, rounds):
    """(vec_id, code, error, label_error) of rows of equal length, and the digest."""
    whole = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    s = len(whole[0][1]) // 8
    cut = lambda v: [v[p * s : (p + 1) * s] for p in range(8)]
    book = [[cut(v)[p] for _, v, _ in whole[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, p: min(range(len(book[p])), key=lambda e: (dist(part, book[p][e]), e))
    for _ in range(rounds):
        own = [[nearest(cut(v)[p], p) for _, v, _ in whole] for p in range(8)]
        for p in range(8):
            fresh = list(book[p])
            for e in set(own[p]):
                some = [cut(v)[p] for (_, v, _), x in zip(whole, own[p], strict=True) if x == e]
                fresh[e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
            book[p] = fresh
    out, labels = [], Counter()
    for i, v, lab in whole:
        codes = [nearest(cut(v)[p], p) for p in range(8)]
        error = sum(dist(cut(v)[p], book[p][c]) for p, c in enumerate(codes))
        labels[lab] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab]) for i, c, e, lab in out), key=repr), digest


@pytest.mark.parametrize(("n", "width", "block"), [(300, 16, 7), (120, 64, 32), (10, 8, 256)])
def test_codes_are_those_of_brute_force(spark, n, width, block):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in v], int(i) % 4 or None) for i, v in zip(rng.permutation(n), rng.standard_normal((n, width)).astype(np.float32) * 2, strict=True)]
    rows += [(n, None, 1), (n + 1, [0.5] * (width - 1) + [None], 1), (n + 2, [float("nan")] + [0.5] * (width - 1), 1), (n + 3, [0.5] * (width - 1) + [float("-inf")], 2)]
    rows += [(n + 4, [0.25] * width, None)] * 25 + [(None, [-0.25] * width, None)]
    want, digest = plain_codes(rows, 6)
    got = vector_codes.vector_codes(vectors_of(spark, rows), block=block).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_odd_vectors(spark):
    rows = [(1, [0.5] * 10, None), (2, [0.25] * 10, 3), (3, [0.5] * 9, 3), (4, [], 3), (5, [1e30] * 10, 3)]
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(vectors_of(spark, rows)).collect()}
    assert set(got) == {1, 2} and got[1]["code"] == "00" * 5 + "000000" and got[2]["code"][:10] == "01" * 5
    assert all(r["error"] == 0 and r["label_error"] == 0 for r in got.values())
    assert vector_codes.vector_codes(vectors_of(spark, [(1, None, 2)])).collect() == []
    assert vector_codes.vector_codes(vectors_of(spark, []).drop("label")).collect() == []
    same = vector_codes.vector_codes(vectors_of(spark, [(k % 3, [1.5] * 8, 1) for k in range(50)]), block=4).collect()
    assert len(same) == 50 and {r["code"] for r in same} == {"00" * 8}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 16), st.integers(1, 5))
def test_short_lists_hold_every_nearest_entry(seed, entries, size):
    rng = np.random.default_rng(seed)
    book = rng.integers(-6, 7, (entries, size))
    points = rng.integers(-8, 9, (5, 6, size)) // rng.integers(1, 4)
    lists = vector_codes.shortlists(points.min(1), points.max(1), book)
    for some, keep in zip(points, lists, strict=True):
        assert keep.any() and keep[((some[:, None] - book) ** 2).sum(-1).argmin(1)].all()


def test_short_lists_are_short():
    rng = np.random.default_rng(5)
    book = rng.integers(-4000, 4000, (16, 8))
    low = rng.integers(-4000, 4000, (500, 8))
    assert vector_codes.shortlists(low, low + 400, book).sum(1).mean() < 3


# --- lexical search -----------------------------------------------------------------------
def plain_search(docs, items, depth):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, inside = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * inside[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + ((x[2] or 0),))[:depth])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("tree_terms", "leaf", "pilot", "block_bytes"), [(2_000_000, 32, 1_000_000, 2_000_000), (40, 2, 20, 150), (300, 1, 60, 10**6)])
def test_ranks_are_those_of_brute_force(spark, tree_terms, leaf, pilot, block_bytes):
    rng = np.random.default_rng(9)
    words = ["the", "of", "Ñandú", "x1", "42", "rare", "中文", "tail"] + [f"w{k}" for k in range(30)]
    odds = 1 / np.arange(1, len(words) + 1)
    docs = [(int(k), " ".join(rng.choice(words, rng.integers(1, 60), p=odds / odds.sum()))) for k in rng.permutation(200)]
    docs += [(500, None), (501, ""), (502, " -- !"), (None, "rare tail rare"), (503, "THE; of\nTHE_of\x00Ñandú"), (504, "rare tail " * 3_000)] + [(505, "rare tail w29")] * 3
    items = [(int(k), " ".join(rng.choice(words, 8))) for k in range(12)] + [(50, None), (51, "?"), (52, "unknown word"), (None, "rare, RARE tail"), (3, "w29 w28")]
    frame = spark.createDataFrame([(*r, 7, "x") for r in items], "item_id long, text string, doc_id long, rank string")
    got = lexical_search.rank_documents(docs_of(spark, docs), frame, 9, block_bytes, tree_terms, leaf, pilot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(docs, items, 9)
    assert got[0].asDict().keys() == {"item_id", "rank", "doc_id", "score"}


def test_empty_searches(spark):
    docs, items = docs_of(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.rank_documents(docs.limit(0), items).collect() == []
    assert lexical_search.rank_documents(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical_search.rank_documents(docs, items).collect()] == [(1, 1, 1, plain_search([(1, "a b")], [(1, "a")], 5)[0][3])]


def test_bounds_prune():
    """Many documents aren't scored, and the bounds of a subtree hold for all in it."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.zipf(1.4, 25) % 300) for _ in range(3_000)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    counts = rng.integers(1, 9, first[-1])
    tree = lexical_search.DocumentTree(np.concatenate(rows).astype(np.uint32), counts, first, rng.integers(50, 400, len(rows)), list(range(len(rows))), 300, 4)
    weight = np.zeros(300, np.int64)
    item = np.array([5, 40, 80, 123, 200, 250])
    weight[item] = [100, 2000, 3000, 5000, 6000, 7000]
    best = []
    scored = tree.search(item, weight, best, 10, 1)
    scores = np.array([(weight[tree.terms[a:b]] * tree.share[a:b]).sum() for a, b in zip(tree.first, tree.first[1:], strict=False)])
    want = sorted(((-s, tree.ids[i]) for i, s in enumerate(scores.tolist()) if s > 0))[:10]
    assert sorted((-s, d) for s, _, d in best) == want and scored < 0.6 * len(rows)
