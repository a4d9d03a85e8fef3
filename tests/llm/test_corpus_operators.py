"""Operators on whole tables, held against brute force, and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clonoform.llm import chat_format, decontamination, exact_dedup, language_id, packing, queries, simhash_dedup
from clonoform.llm.common import table, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "Plain words"), (3, "plain words"), (None, "no id"), (4, "x y " * 50_000), (5, "\n \t "), (6, "É́ ñ 中文")]


def docs_of(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows], SCHEMA)


def texts_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- packing ------------------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=300))
def test_bins_are_full_and_gapless(lengths):
    a = np.array(lengths)
    bins, offsets, used = packing.pack(a, 50)
    for b in range(used):
        rows = sorted((int(o), int(n)) for o, n in zip(offsets[bins == b], a[bins == b], strict=True))
        assert rows[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(rows, rows[1:], strict=False)) and sum(rows[-1]) <= 50
    assert used <= -(-sum(lengths) // 50) * 1.25 + 1


def test_how_full_bins_are():
    rng = np.random.default_rng(0)
    short = np.minimum(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 2048)
    assert packing.pack(short, 2048)[2] <= -(-int(short.sum()) // 2048) + 2
    cuts = np.sort(rng.choice(np.arange(1, 2048), (2_000, 2)), axis=1)
    perfect = np.concatenate([cuts[:, 0], cuts[:, 1] - cuts[:, 0], 2048 - cuts[:, 1]])
    perfect = perfect[perfect > 0]
    assert 2_000 <= packing.pack(perfect, 2048)[2] <= 2_100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=9))
def test_few_pieces_take_at_most_a_bin_more_than_the_best(lengths):
    def best(left, free):
        if not left:
            return len(free)
        n, rest = left[0], left[1:]
        ways = [best(rest, free[:i] + (f - n,) + free[i + 1 :]) for i, f in enumerate(free) if f >= n and f not in free[:i]]
        return min([*ways, best(rest, (*free, 10 - n))])

    assert packing.pack(np.array(lengths), 10)[2] <= best(tuple(sorted(lengths, reverse=True)), ()) + 1


def test_packing_of_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = texts_of(spark, sf_dir)
    rows = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by.keys() == texts.keys()
    total = 0
    for d, text in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        own = sorted(by[d], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(sum(a) == b[0] for a, b in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_packing_of_odd_rows(spark):
    rows = packing.pack_documents(docs_of(spark, ODD), tokenizer_path(), shard_pieces=10).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in ODD)
    assert packing.pack_documents(docs_of(spark, []), tokenizer_path()).count() == 0


# --- exact duplicates -----------------------------------------------------------------------
def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return sorted((str(i), str(max(g, key=lambda x: (x is not None, x or 0))), len(g), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows for g in [groups[low(t)]])


@pytest.mark.parametrize("low_high", [(256, 8192), (4, 16)])
def test_exact_duplicates(spark, sf_dir, low_high):
    texts = list(texts_of(spark, sf_dir).items()) + [(10**6, "x" * 30_000), (10**6 + 1, "X" * 30_000), (10**6 + 2, "x" * 30_001), *ODD[:3], *ODD[4:]]
    rows = exact_dedup.exact_duplicates(docs_of(spark, texts), *low_high).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows) == brute_exact(texts)
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({low(t) for _, t in texts})


def test_equal_ids_keep_one_row(spark):
    rows = exact_dedup.exact_duplicates(docs_of(spark, [(3, "A"), (3, "a"), (3, "a"), (None, "a")])).collect()
    assert [r["group_size"] for r in rows] == [4] * 4 and sum(r["kept"] for r in rows) == 1
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).count() == 0


# --- near duplicates ------------------------------------------------------------------------
def brute_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ps = list(prints)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates(spark, sf_dir):
    rows = list(texts_of(spark, sf_dir).items()) + [(1000 + i, t) for i, t in ODD if i]
    rows += [(2000 + i, f"{rows[0][1]} tail{i}") for i in range(5)]
    prints = [(i, brute_simhash(t)) for i, t in rows]
    root = brute_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        least[root[p]] = min(least.get(root[p], i), i)
    got = simhash_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{p:016x}", least[root[p]]) for i, p in prints)
    assert simhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize(("bucket", "refined"), [(32, 4), (3, 4), (3, 1), (1, 50), (1, 1)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bucket, refined):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    monkeypatch.setattr(simhash_dedup, "REFINED", refined)
    rng = np.random.default_rng(5)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        prints.add(centre)
        for _ in range(25):
            x = centre
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(edges).collect()}
    want = brute_components({p & (1 << 64) - 1 for p in signed})
    groups = defaultdict(set)
    for p, r in want.items():
        groups[r].add(p - (1 << 64) if p >> 63 else p)
    for g in groups.values():
        assert {roots.get(p, p) for p in g} == {min(g)}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = Counter()
    plain = simhash_dedup.stage
    monkeypatch.setattr(simhash_dedup, "stage", lambda df, name: (rounds.update([name]), plain(df, name))[1])
    n = 1_024
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5_000, 5_001), (6_000, 6_000)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(chain).collect()}
    assert roots == {i: 0 for i in range(n + 1)} | {5_000: 5_000, 5_001: 5_000}
    assert rounds["hooks"] <= 12


def test_one_row_of_a_component_is_first(spark):
    rows = [(None, "a b c d", 1), (7, "a b c d", 2), (7, "a b c d", 3), (8, "x y z w", 4), (None, "", 5), (None, None, 6)]
    docs = spark.createDataFrame([(i, t, None, None, None, n) for i, t, n in rows], SCHEMA + ", n long")
    got = {r["n"]: (r["component_id"], r["first"]) for r in simhash_dedup.near_duplicates(docs, row="n").collect()}
    assert got == {1: (7, False), 2: (7, True), 3: (7, False), 4: (8, True), 5: (None, True), 6: (None, False)}


@pytest.mark.parametrize("hot", [2, 1])
def test_large_groups_are_joined_in_parts(spark, sf_dir, monkeypatch, hot):
    from clonoform.llm import common

    rows = [(i, f"text {i % 4}") for i in range(40)] + ODD
    runs = {f: Counter(map(str, f(docs_of(spark, rows)).drop("kept").collect())) for f in (exact_dedup.exact_duplicates, simhash_dedup.near_duplicates)}
    monkeypatch.setattr(common, "HOT", hot)
    for f, want in runs.items():
        assert Counter(map(str, f(docs_of(spark, rows)).drop("kept").collect())) == want


# --- contamination --------------------------------------------------------------------------
def test_blocks_of_items_give_the_rows_of_one(spark):
    common = [f"common{i}" for i in range(12)]
    texts = [" ".join([x for i, w in enumerate(common[k % 3 :]) for x in (w, f"own{k}x{i}")] + [f"tail{k % 2}"] * (k % 4)) for k in range(9)]
    items = spark.createDataFrame(list(enumerate([*texts, None, "", texts[0]])), "item_id long, text string")
    docs = docs_of(spark, [(i, "before it " + " ".join(t.split()[: -1 - i % 3]) + " after it " * 40 + t[: len(t) // 2]) for i, t in enumerate(texts)])
    one, many = (sorted(map(tuple, decontamination.find_contamination(docs, items, block_bytes=n).collect())) for n in (2_000_000, 700))
    assert len(one) >= len(texts) and [x[:2] for x in one] == [x[:2] for x in many]
    assert np.allclose(np.array(one), np.array(many), rtol=0, atol=1e-12)


def test_contamination(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    want = set()
    for d, t in texts.items():
        ws = decontamination.words(t.encode())
        have = {tuple(ws[i : i + 5]) for i in range(len(ws))}
        for i, x in items:
            own = decontamination.Item(i, x, 5)
            if len(own.whole & have) >= 0.8 * len(own.whole) and len(own.question & have) >= 0.5 * len(own.question) and len(own.answer & have) >= 0.5 * len(own.answer):
                want.add((d, i))
    assert want
    for size in (2_000_000, 1_000):
        got = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_edited_and_clean_passages(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [(i, " ".join(word() for _ in range(40)).capitalize() + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(50)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[7][1].split()
    edited[20] = "changed"
    docs = [(1, noise(300) + " " + items[3][1].upper() + " " + noise(500)), (2, noise(90) + "\n" + " ".join(edited)), (3, noise(900)), (4, items[9][1][:60]), *ODD]
    got = decontamination.find_contamination(docs_of(spark, docs), spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 3), (2, 7)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs_of(spark, docs), none).count() == 0


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abcdefghijkl"), min_size=1, max_size=9), min_size=1, max_size=40),
    st.lists(st.lists(st.sampled_from("abcdefghijklz"), max_size=9), min_size=1, max_size=5),
    st.floats(0.05, 1),
)
def test_wand_finds_all_above_the_threshold(items, passages, threshold):
    index = decontamination.Bm25Index([(i, " ".join(x)) for i, x in enumerate(items)], block=3)
    n, mean = len(items), sum(map(len, items)) / len(items)
    score = {}
    for i, x in enumerate(items):
        weight = {}
        for w, f in Counter(x).items():
            df = sum(w in y for y in items)
            weight[w] = np.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean))
        for p, qs in enumerate(passages):
            score[p, i] = sum(v for w, v in weight.items() if w in qs) / sum(weight.values())
    pairs = sorted({(p, index.terms[q.encode()]) for p, qs in enumerate(passages) for q in qs if q.encode() in index.terms})
    a = np.array(pairs, np.int64).reshape(-1, 2)
    got = {}
    for ps, ks, xs in index.search(a[:, 0], a[:, 1], threshold):
        for p, k, x in zip(ps.tolist(), ks.tolist(), xs.tolist(), strict=True):
            assert (p, index.texts[k][0]) not in got
            got[p, index.texts[k][0]] = x
    index.entry = None  # entries by search, as in large indexes
    again = {(p, index.texts[k][0]): x for ps, ks, xs in index.search(a[:, 0], a[:, 1], threshold) for p, k, x in zip(ps.tolist(), ks.tolist(), xs.tolist(), strict=True)}
    assert again == got
    assert {k for k, s in score.items() if s >= threshold + 1e-6} <= got.keys()
    assert all(abs(score[k] - s) < 1e-9 and s >= threshold - 1e-6 for k, s in got.items())


def test_the_driver_holds_one_index_at_a_time(spark):
    import tracemalloc

    rows = spark.range(10_000).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 25), k -> substr(md5(concat(id, '.', k)), 1, 6))) as text")
    docs = rows.where("item_id % 1000 = 7").selectExpr("item_id as doc_id", "concat('before ', text, ' after') as text")
    tracemalloc.start()
    got = decontamination.find_contamination(docs, rows, block_bytes=400_000).collect()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(7, 10_000, 1000)]
    assert peak < 13e6  # some four times an index, of which there are six


def test_rows_are_alike_for_any_number_of_indexes(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 3))
    texts = [" ".join(word() for _ in range(int(rng.integers(6, 30)))) + ". " + word() + " " + word() for _ in range(60)]
    items = [(i, t) for i, t in enumerate(texts)] + [(5, texts[7]), (5, texts[8]), (None, texts[3]), (None, texts[4])]
    docs = [(k, " ".join(word() for _ in range(20)) + " " + " ".join(t.split()[: len(t.split()) - k % 4]) + " " + word()) for k, t in enumerate(texts)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for size in (10_000_000, 5_000, 600):
        found[size] = sorted(map(tuple, decontamination.find_contamination(docs_of(spark, docs), table, block_bytes=size).collect()), key=str)
        assert len({x[:2] for x in found[size]}) == len(found[size])
    assert found[10_000_000] == found[5_000] == found[600] and len(found[600]) > 30
    edge = sorted(x[2] for x in found[600])[len(found[600]) // 2]  # a score right at the threshold
    at = [sorted(map(tuple, decontamination.find_contamination(docs_of(spark, docs), table, threshold=edge, block_bytes=size).collect()), key=str) for size in (10_000_000, 600)]
    assert at[0] == at[1] and min(x[2] for x in at[0]) == edge
    docs = [(100 + i, t) for i, t in docs]
    clean = docs_of(spark, docs + ODD).selectExpr("*", "1 as item_id", "2 as block", "3 as index")
    for size in (10_000_000, 600):
        kept = decontamination.uncontaminated(clean, table, block_bytes=size)
        assert kept.columns == clean.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in docs + ODD if i is None or i - 100 not in {x[0] for x in found[size]})


# --- language ---------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language_id.identify_languages(docs).collect()
    test = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert len(got) == len(lang) and len(test) > 100
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in test) / len(test) > 0.97


def test_letters_of_all_planes_count(spark):
    text = "\U00020000\U00020001 \U00030000"
    assert language_id.buckets([text])[1][0] > 0 and language_id.buckets([text + " \U0001f600"])[1][0] == language_id.buckets([text + " 1"])[1][0]
    docs = spark.createDataFrame([(i, text, "zh", None, None) for i in range(8)] + [(8, "\U0001f600 \U0010ffff", None, None, None)], SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs).collect()}
    assert got == {i: "zh" if i < 8 else "und" for i in range(9)}


def plain_grams(text, bits):
    """Buckets of the character n-grams of a text, one n-gram at a time."""
    import re

    points = [ord(c) for c in re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))]
    out = []
    if any(p != 32 for p in points):
        for order in (1, 2, 3):
            for i in range(len(points) - order + 1):
                code = 0
                for p in points[i : i + order]:
                    code = (code * 0x9E3779B1 + p + 1) & (1 << 64) - 1
                out.append(((code * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> (64 - bits))
    return out


def test_predictions_are_those_of_naive_bayes(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, sf_dir, "documents").collect()]
    bits, counts, sizes = 10, defaultdict(Counter), Counter()
    for d, t, lang in docs:
        if lang and t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            counts[lang].update(plain_grams(t, bits))
            sizes[lang] += 1
    total = {x: sum(c.values()) + 0.5 * 2**bits for x, c in counts.items()}
    want = {}
    for d, t, _ in docs:
        grams = Counter(plain_grams(t or "", bits))
        like = {x: np.log(sizes[x] / sum(sizes.values())) + sum(n * np.log((counts[x][g] + 0.5) / total[x]) for g, n in grams.items()) for x in sorted(counts)}
        want[d] = max(like, key=like.get) if grams else "und"
    for languages in (256, 3, 1):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(table(spark, sf_dir, "documents"), bits, languages=languages).collect()}
        assert {d: x for d, (x, _) in got.items()} == want
        first = got if languages == 256 else first
        assert all(abs(got[d][1] - first[d][1]) < 1e-9 and 0 <= got[d][1] <= 1 for d in got)


def test_thousands_of_languages(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12))
    own = [" ".join(word() for _ in range(3)) for _ in range(5_000)]
    rows = [(i, t, f"l{i:04}") for i, t in enumerate(own)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs_of(spark, rows), 12, languages=1_500).collect()}
    assert len(learned) > 3_000 and np.mean([got[i] == lang for i, _, lang in learned]) > 0.9


def test_clashing_columns(spark, sf_dir):
    """Other columns never matter, whatever their names."""
    names = ["fp", "key", "h", "rid", "part", "shard", "n", "place", "size", "unit", "body", "recipe", "best", "row", "piece", "ids", "held_out", "lang_pred", "score", "component_id", "least", "root", "fingerprint", "item_id", "block", "start", "blob"]
    plain = docs_of(spark, [(i, t, "en") for i, t in ODD])
    docs = plain.selectExpr("*", *[f"'x' as {n}" for n in names])
    items = spark.createDataFrame([(1, "plain words", "y", "z")], "item_id long, text string, doc_id string, block string")
    runs = {
        "op3": lambda d: decontamination.find_contamination(d, items, overlap=0.1),
        "op7": lambda d: packing.pack_documents(d, tokenizer_path()).drop("sequence_id", "offset"),
        "op8": exact_dedup.exact_duplicates,
        "op9": language_id.identify_languages,
        "op10": simhash_dedup.near_duplicates,
    }
    for name, run in runs.items():
        a, b = (Counter(map(str, run(d).drop("kept").collect())) for d in (plain, docs))
        assert a == b, name


def test_languages_of_odd_rows(spark):
    rows = [(i, t, "en") for i, t in ODD] + [(7, "12 34 !!", "en"), (8, "bonjour le monde", "fr")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(docs_of(spark, rows)).collect()}
    assert got[1] == got[2] == got[5] == got[7] == ("und", 0.0) and got[3][0] in ("en", "fr")
    assert language_id.identify_languages(docs_of(spark, [])).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(docs_of(spark, ODD)).collect()} == {"und"}


# --- chats ------------------------------------------------------------------------------------
texts = st.text(alphabet="ab<[\\|/]>$1\n é", max_size=12)


def test_chats_round_trip(spark):
    rng = np.random.default_rng(1)
    marks = ["<|end|>", "</s>", "[INST]", "\\", "<", "[", "<|", "<\\", "\\\\", "plain", "", "$1", "é\n", "<|text|>", "<|turn|>"]
    rows = []
    for c in range(40):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, str(rng.choice(["user", "assistant", "system", "a<|b"])), "".join(rng.choice(marks, rng.integers(0, 5)))))
    rows.append((99, None, None, None))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    made = chat_format.format_chats(df)
    for r in made.collect():
        inner = r["formatted"].replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "")
        assert "<|" not in inner and "</s>" not in inner and "[INST]" not in inner
    for r in chat_format.read_chats(made).collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1] or 0)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")
    assert chat_format.read_chats(chat_format.format_chats(df.limit(0))).count() == 0


def test_chats_of_many_and_of_very_long_turns(spark):
    """More texts than a run holds, and texts that end at, before and behind the pieces' ends."""
    rng = np.random.default_rng(2)
    rows = [(1, t, str(rng.choice(["user", "assistant"])), "é𝄞<x" * int(rng.integers(0, 4))) for t in range(20_000)]
    rows += [(2, t, "assistant" if t % 2 else "user", "𝄞[" * n) for t, n in enumerate((500, 0, 1, 511, 512, 513, 30_000, 1_024, 1_023))]
    rows.append((3, 0, "user", "no loss"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    made = chat_format.format_chats(df).collect()
    for r in made:
        own = [(x[3].replace("<", "<\\").replace("[", "[\\")) for x in rows if x[0] == r["conv_id"] and x[2] == "assistant"]
        assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == own
    for r in chat_format.read_chats(chat_format.format_chats(df)).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in own]
        assert r["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")


def test_chats_merge_adjacent_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(df).first()["formatted"] == "<|turn|>user<|text|>a<|text|>b<|end|><|turn|>assistant<|text|>c<|end|>"


def test_chat_query_over_the_table(spark, sf_dir):
    by = defaultdict(list)
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = queries.op6_chat_format(spark, sf_dir).collect()
    assert len(got) == len(by)
    for r in got:
        own = by[r["conv_id"]]
        loss = "".join(t for x, t in own if x == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# --- pipeline -----------------------------------------------------------------------------------
def brute_contaminated(texts, items):
    out = set()
    for d, t in texts.items():
        ws = low(t)
        ws = "".join(c if c.isdigit() or c.islower() or ord(c) >= 128 else " " for c in ws).split()
        have = {tuple(ws[i : i + 5]) for i in range(len(ws))}
        for i, x in items:
            own = decontamination.Item(i, x, 5)
            parts = [{tuple(w.decode() for w in s) for s in p} for p in (own.whole, own.question, own.answer)]
            if all(len(p & have) >= share * len(p) for p, share in zip(parts, (0.8, 0.5, 0.5), strict=True)):
                out.add(d)
    return out


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {d: t for d, t in texts.items() if any(c.isalpha() for c in t)}
    last = {}
    for d in sorted(kept):
        last[low(kept[d])] = d
    kept = {d: kept[d] for d in last.values()}
    prints = {d: brute_simhash(t) for d, t in kept.items()}
    root = brute_components(set(prints.values()))
    first = {}
    for d in sorted(prints):
        first.setdefault(root[prints[d]], d)
    kept = {d: kept[d] for d in first.values()}
    gone = brute_contaminated(kept, [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()])
    assert gone
    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for d in kept.keys() - gone:
        ids = np.array(t.encode(kept[d], add_special_tokens=False).ids + [0], "<u4")
        for k, lo in enumerate(range(0, len(ids), 2048)):
            want[d, k] = (lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes()))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(b)[0][0] == 0 and sum(n for _, n in b) == sum(max(b)) <= 2048 for b in bins.values())
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_identification" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_stages_decide_on_rows_not_on_ids(spark, sf_dir, monkeypatch, most):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", most)
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    rows = [(None, "one clean text without an id"), (None, "another clean text without any id"), (None, item), (None, "12 34"), (4, "the same id twice over"), (4, "another text of this id"), (4, "THE same id twice over"), (9, item + " more")]
    docs = docs_of(spark, rows)
    out = {name: Counter(r["text"] for r in step(spark, docs, sf_dir).collect()) for name, step in corpus_pipeline.STAGES[:-1]}
    every = Counter(t for _, t in rows)
    assert out["benchmark_decontamination"] == every - Counter([item, item + " more"])
    assert sum(out["exact_deduplication"].values()) == 7 and low_count(out["exact_deduplication"]) == low_count(every)
    assert set(out["near_deduplication"]) >= {t for i, t in rows if i is None} - {item}


def low_count(texts):
    return {low(t) for t in texts}


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    import corpus_pipeline

    for rows in (ODD, []):
        docs = docs_of(spark, rows)
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, docs, sf_dir).columns == corpus_pipeline.COLUMNS
            step(spark, docs, sf_dir).count()


def test_two_pipelines_at_once_leave_other_tables(spark, sf_dir):
    from threading import Thread

    import corpus_pipeline
    from clonoform.llm.common import stage

    rows = lambda: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    want, found = rows(), {}
    threads = [Thread(target=lambda k=k: found.update({k: rows()})) for k in range(2)]
    for t in threads:
        t.start()
    other = stage(spark.range(10), "other")
    for t in threads:
        t.join()
    assert found == {0: want, 1: want} and want
    assert other.count() == 10
