import random

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.llm import exact_dedup, ngram_join
from inkveil.llm.components import connected_components, id_filter, passes
from inkveil.llm.shared import Scratch


def rows_of(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
NEAR = ("doc_id", "n_shingles", "component_id")


def test_exact_groups_of_hard_rows(docs_of, hard):
    for block in (7, 4096):
        some = hard if block > 100 else [r for r in hard if len(r[1] or "") < 1000]
        assert rows_of(exact_dedup.exact_groups(docs_of(some), block_bytes=block), *EXACT) == brute.exact(some)


def test_exact_groups_of_nothing(docs_of):
    assert exact_dedup.exact_groups(docs_of([])).count() == 0
    assert exact_dedup.drop_copies(docs_of([])).count() == 0


def test_repeated_rows_and_null_ids_leave_one(spark, docs_of):
    rows = [(5, "a b"), (5, "A b"), (None, "a b"), (None, "other"), (7, "x"), (7, "x")]
    out = exact_dedup.exact_groups(docs_of(rows)).collect()
    assert len(out) == 6 and sum(r["kept"] for r in out) == 3
    left = exact_dedup.drop_copies(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in left) == [("5", "a b"), ("7", "x"), ("None", "other")]


def test_rows_that_share_an_id_are_judged_by_their_texts(docs_of):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (5, a.upper()), (2, b + " x"), (None, a), (None, ""), (7, None), (7, None), (9, a + " y")]
    left = sorted((str(r["doc_id"]), r["text"]) for r in ngram_join.keep_one_of_each(docs_of(rows)).collect() if r["text"])
    assert left in ([(str(i), t) for i, t in ((2, b + " x"), (5, x), (None, a))] for x in (a, a.upper()))
    assert ngram_join.keep_one_of_each(docs_of(rows)).filter("text is null").count() == 2
    kept = sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in exact_dedup.drop_copies(docs_of(rows)).collect())
    assert kept == sorted([("5", a), ("5", b), ("2", b + " x"), ("7", ""), ("9", a + " y")])


def test_clashing_columns_stay(spark):
    names = "doc_id long, text string, rid string, name string, n long, h1 long, kept string, block string, doc_ID2 long, component string, key long"
    df = spark.createDataFrame([(1, "a b c d e f", "r", "n", 1, 2, "k", "b", 3, "c", 4), (2, "A b c d e f", "r2", "n", 1, 2, "k", "b", 3, "c", 4)], names)
    assert [r["rid"] for r in exact_dedup.drop_copies(df).collect()] == ["r2"]
    assert [r["rid"] for r in ngram_join.keep_one_of_each(df).collect()] == ["r"]
    assert exact_dedup.drop_copies(df).columns == df.columns == ngram_join.keep_one_of_each(df).columns


def test_near_groups_of_hard_rows(docs_of, hard):
    assert rows_of(ngram_join.near_duplicate_groups(docs_of(hard)), *NEAR) == brute.near(hard)


def test_near_groups_of_nothing(docs_of):
    assert ngram_join.near_duplicate_groups(docs_of([])).count() == 0
    assert ngram_join.near_duplicate_groups(docs_of([(1, None), (2, " ")])).count() == 2


def corpus(seed, n=220):
    """Families of edited copies, chains, a boilerplate passage in most documents, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    boiler = " ".join(word() for _ in range(40))
    rows, i = [], 0
    while i < n:
        base = [word() for _ in range(rng.choice([3, 6, 9, 11, 13, 30, 60, 120]))]
        text = base
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(text if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
            rows.append((i, " ".join(text) + (" " + boiler if rng.random() < 0.6 else "")))
            i += 1
    return rows


def test_near_groups_equal_brute_force(docs_of, monkeypatch):
    for seed, frequent, pivots, small in ((1, 50, 1024, 1 << 18), (2, 3, 16, 5), (3, 1, 6, 1)):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
        for name in ("PAIRS", "COUNTS", "TEXT"):
            monkeypatch.setattr(ngram_join, name, small)
        rows = corpus(seed)
        assert rows_of(ngram_join.near_duplicate_groups(docs_of(rows)), *NEAR) == brute.near(rows)


def test_links_are_of_words(docs_of, monkeypatch):
    """Neither words that polynomial digests confuse nor any other collisions link documents."""
    word = brute.thue_morse(1024)
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper()), (4, f"{word} x y z q r s")]
    assert rows_of(ngram_join.near_duplicate_groups(docs_of(rows)), *NEAR) == brute.near(rows)
    texts = ["a b c d e f g", "h i j k l m n", "a b c d e f q", "", "x", "y z"]
    want = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    real, real_shingles = ngram_join.B.digests, ngram_join.B.shingles
    for change in ({"digests": lambda *a: real(*a) % np.uint64(3)}, {"shingles": lambda *a: real_shingles(*a) % np.uint64(4)}, {}):
        with monkeypatch.context() as m:
            for name, f in change.items():
                m.setattr(ngram_join.B, name, f)
            sets = ngram_join.Shingling().exact_sets(pa.array(texts))
        assert [len(s) for s in sets] == [len(s) for s in want]
        assert [[len(np.intersect1d(a, b)) for b in sets] for a in sets] == [[len(a & b) for b in want] for a in want]


def test_a_large_group_that_does_not_link_to_its_hub(spark, docs_of, monkeypatch):
    """Near copies of one text, most of them over the threshold apart, in chains; the rows that comparisons make follow their number."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows, text = [], base
    for i in range(5000):
        text = list(text if i % 10 else base)
        for k in rng.sample(range(60), 1 if i % 10 else 2):
            text[k] = f"e{i}"
        rows.append((i, " ".join(text)))
    want = brute.near_by_index(rows)
    assert 400 < len({c for _, _, c in want}) < 4000
    made, keep = [], Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        made.extend([out.count()] * name.startswith(("possible", "links-", "groups")))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    assert rows_of(ngram_join.near_duplicate_groups(docs_of(rows)), *NEAR) == want
    assert max(made) <= 60 * len(rows)


def test_near_duplicates_leave_one_of_each(docs_of):
    rows = corpus(4, 60)
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each(docs_of(rows)).collect()}
    assert kept == {c for _, _, c in brute.near(rows)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(10, 120), st.integers(0, 60), st.integers(0, 12))
def test_similar_sets_share_a_key(seed, n, common, edits):
    """Completeness of the index, with some shingles frequent, for pairs on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, n + edits, dtype=np.uint64))
    x = np.sort(pool[: len(pool) - edits] if edits else pool)
    y = np.sort(np.concatenate([rng.permutation(x)[: max(1, len(x) - rng.integers(0, edits + 1))], pool[len(pool) - edits :] if rng.random() < 0.5 else pool[:0]]))
    y = np.unique(y)
    often = rng.permutation(np.unique(np.concatenate([x, y])))[:common]
    classes, at = np.unique((often >> np.uint64(32)).astype(np.uint32), return_index=True)
    counts = rng.integers(51, 99, len(classes)).astype(np.int64)
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    both = len(np.intersect1d(x, y))
    if 5 * both >= 4 * (len(x) + len(y) - both):
        both_seen = ngram_join.Classes(classes, counts, np.zeros(1 << 13, np.uint8), 16)
        for bit in np.intersect1d(x, y) >> np.uint64(48):
            both_seen.seen[int(bit) >> 3] |= 128 >> (int(bit) & 7)
        (k1, s1), (k2, _) = ngram_join.prefix_keys(small, both_seen), ngram_join.prefix_keys(large, both_seen)
        assert np.isin(k1[s1], k2).any()
        a, b = (np.frombuffer(ngram_join.parity(s), np.uint64) for s in (x, y))
        size = min(len(a), len(b))
        assert int(np.bitwise_count(ngram_join.fold(a, size) ^ ngram_join.fold(b, size)).sum()) <= ngram_join.most_distance(len(x), len(y))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**24 - 1), max_size=50))
def test_steps_round_trip(values):
    v = np.sort(np.array(values, np.uint32))
    assert (ngram_join.unpack_sorted(ngram_join.pack_sorted(v)) == v).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(connected_components(df, Scratch(spark, "t"), "c").select("node", "component").collect())
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}


def test_id_filter_lets_all_pass(spark):
    words = id_filter(spark.range(0, 5000, 7))
    ids = np.arange(5000)
    ok = passes(words, ids)
    assert ok[::7].all() and ok.sum() < 800
