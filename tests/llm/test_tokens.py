import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.llm import bytetext as B
from inkveil.llm import packing, token_counts, token_index
from inkveil.llm.encode import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_tokenizer())


def ids_of(coder, texts):
    return [ids[at[k] : at[k + 1]].tolist() for i, j, ids, at in coder.column(pa.array(texts, pa.string())) for k in range(j - i)]


def test_encoding_is_the_librarys(coder, library, hard):
    texts = [t for _, t in hard if len(t or "") < 1_000_000]
    assert ids_of(coder, texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_short_words_beside_a_very_long_one(library):
    few = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    text = f"{few} {'q' * 1_500_000} {few[:5000]} tail"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = B.words(data, np.array([0, len(data)]), B.NOT_SPACE)
    alone = {w: B.digests(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in set(text.split())}
    assert len(set(alone.values())) == len(alone)
    assert B.digests(data, starts, ends).tolist() == [alone[w] for w in text.split()]
    # The long word has many ids of its own: those before and after it are compared.
    got, n = ids_of(Encoder(default_tokenizer()), [text])[0], 50_000
    before, after = (library.encode(t, add_special_tokens=False).ids for t in (few, f"{few[:5000]} tail"))
    assert got[:n] == before[:n] and got[-len(after) :] == after


def test_words_that_polynomial_digests_confuse(library):
    for word in brute.thue_morse(1024), brute.thue_morse(256), brute.thue_morse(200):
        texts = [f"x {w} y {w}" for w in (word, word.translate(str.maketrans("ab", "ba")))]
        assert ids_of(Encoder(default_tokenizer()), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_does_not_rest_on_digests(library, hard, monkeypatch):
    real = B.digests
    monkeypatch.setattr(B, "digests", lambda *a: real(*a) % np.uint64(5))
    coder = Encoder(default_tokenizer())
    texts = ["one two three four, five. six", "six seven eight one", *[t for _, t in hard if len(t or "") < 10_000]]
    for _ in range(2):
        assert ids_of(coder, texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_what_does_not_come_again(library, monkeypatch):
    from inkveil.llm import encode

    monkeypatch.setattr(encode, "REMEMBERED", 60)
    coder, asked = Encoder(default_tokenizer()), []
    real = coder._library
    monkeypatch.setattr(coder, "_library", lambda parts: asked.append(parts) or real(parts))
    for k in range(40):
        text = f"often{k // 20}, " + " ".join(f"once{k}x{i}" for i in range(20)) + f" OFTEN{k // 20} é{k % 3}"
        assert ids_of(coder, [text, None, text]) == [library.encode(t, add_special_tokens=False).ids for t in (text, "", text)]
        assert len(coder.known) == len(coder.start) == len(coder.place) - 1 <= 60 and len(coder.ids) == coder.count.sum()
    assert sum(parts.count("often0") for parts in asked) == sum(parts.count("often1") for parts in asked) == 1
    monkeypatch.setattr(encode, "REMEMBERED", 4)  # fewer than one text has
    assert ids_of(coder, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_texts_go_to_workers_in_small_batches(spark, docs_of):
    from inkveil.llm.shared import BATCH_BYTES, BATCH_LIMIT, Scratch, small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    docs = docs_of([(0, "x")]).selectExpr("explode(sequence(1, 400)) as doc_id", "repeat('word ', 20000) as text").coalesce(1)
    with small_batches(spark):
        got = Scratch(spark, "sizes").keep(docs.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r["rows"] for r in got) == 400 and max(r["bytes"] for r in got) <= BATCH_BYTES + 200_000
    assert spark.conf.get(BATCH_LIMIT, None) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\x00é"), min_size=1, max_size=30), min_size=1, max_size=20))
def test_equality_of_words(some):
    data = np.frombuffer(" ".join(some).encode(), np.uint8)
    length = np.array([len(w.encode()) for w in some])
    starts = np.cumsum(length + 1) - length - 1
    i, j = (x.ravel() for x in np.indices((len(some), len(some))))
    got = B.equal(data, starts[i], starts[i] + length[i], data, starts[j], starts[j] + length[j])
    assert got.tolist() == [a == b for a in some for b in some]
    assert B.faithful(data, starts, starts + length, B.digests(data, starts, starts + length))
    assert B.faithful(data, starts, starts + length, length.astype(np.uint64)) == all(a == b for a in some for b in some if len(a.encode()) == len(b.encode()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé.,!' \n\t\u00a0\u0301\u0331H1½“—<|>endofxt🙂İΣ"), max_size=30), max_size=5))
def test_encoding_of_odd_texts(coder, library, texts):
    assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_reads_back(spark, docs_of, library, hard, monkeypatch):
    rows = [r for r in hard if len(r[1] or "") < 1_000_000]
    docs = docs_of(rows)
    store = token_index.write_store(docs, shard_docs=3)
    got = [tuple(r) for r in token_index.records(store, docs.select("doc_id"), digests=True).collect()]
    assert sorted(got) == brute.encoded(library, rows, token_index.END_ID)
    whole = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), f"<u{r['width']}").tolist() for r in token_index.records(store, docs.select("doc_id")).collect()}
    assert whole[18] == [*library.encode(dict(rows)[18], add_special_tokens=False).ids, token_index.END_ID]


def test_store_with_repeated_and_null_ids(spark, docs_of):
    rows = [(1, "a")] * 5 + [(1, "b c"), (None, "n"), (None, None), (2, "z")]
    store = token_index.write_store(docs_of(rows), shard_docs=2)
    got = token_index.records(store, spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id long"), digests=True).collect()
    assert len(got) == 9 and sorted(r["start"] for r in got) == sorted({r["start"] for r in got})
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted([("1", 2)] * 5 + [("1", 3), ("2", 2), ("None", 2), ("None", 1)])


def test_empty_store(spark, docs_of):
    docs = docs_of([])
    assert token_index.records(token_index.write_store(docs), docs.select("doc_id")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=400))
def test_perfect_hash_is_a_bijection(keys):
    k = np.array(sorted(keys), np.int64)
    seeds, slots = token_index.build_mph(k)
    assert sorted(slots) == list(range(len(k)))
    assert (token_index.find_slots(k, seeds, len(k)) == slots).all()


def test_absent_keys_are_told_apart():
    k = np.arange(20_000, dtype=np.int64)
    seeds, slots = token_index.build_mph(k)
    prints = np.zeros(len(k), "<u4")
    prints[slots] = token_index.fingerprints(k)
    other = np.arange(10**6, 10**6 + 20_000, dtype=np.int64)
    assert (prints[token_index.find_slots(other, seeds, len(k))] == token_index.fingerprints(other)).sum() <= 2


def test_histogram_answers_equal_counting(spark, docs_of, library, hard):
    rows = [r for r in hard if len(r[1] or "") < 1_000_000]
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    table = token_counts.token_counts(docs_of(rows))
    for r in table.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r["docs_total"], r["tokens_total"], r["truncated_total"]) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
    limits = [0, 1, 5, 64, 10**9]
    got = {r["context_limit"]: (r["docs_longer"], r["tokens_left"]) for r in token_counts.totals_for_limits(table, limits).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits}
    q = {r["probability"]: r["n_tokens"] for r in token_counts.quantiles(table, [0.25, 0.5, 1.0]).collect()}
    assert q == {p: sorted(lengths)[-int(-p * len(lengths) // 1) - 1] for p in (0.25, 0.5, 1.0)}


def test_counts_of_nothing(docs_of):
    assert token_counts.token_counts(docs_of([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), max_size=25))
def test_plan_uses_every_piece_once(histogram):
    plan = packing.plan_bins(histogram, 64)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    table = packing.SlotTable(plan)
    places = {}
    for x, n in histogram.items():
        for s, o in zip(*table.place(x, np.arange(n)), strict=True):
            places.setdefault(int(s), []).append((int(o), x))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(x for _, x in p[:k]) for k in range(len(p))]


def test_a_full_bin_is_found():
    assert packing.plan_bins({60: 1, 30: 2, 25: 1, 9: 1, 4: 1}, 64)[0] == ([60, 4], 1)


def test_packing_keeps_all_ids(spark, docs_of, library, hard):
    rows = [r for r in hard if len(r[1] or "") < 1_000_000]
    packed = packing.best_fit_pack(docs_of(rows), capacity=128, keep_ids=True)
    got = packed.collect()
    back = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == r["piece"] * 128 and r["length"] == len(r["ids"]) <= 128
        back.setdefault(r["doc_id"], []).extend(r["ids"])
    assert back == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for r in packing.sequences(packed).collect():
        parts = sorted((x["offset"], x["length"]) for x in got if x["sequence_id"] == r["sequence_id"])
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and len(r["input_ids"]) <= 128
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 128) + 1


def test_packing_repeated_rows_and_nothing(docs_of):
    got = packing.best_fit_pack(docs_of([(1, "a b")] * 7 + [(None, None)])).collect()
    assert len(got) == 8 and len({(r["sequence_id"], r["offset"]) for r in got}) == 8
    assert packing.best_fit_pack(docs_of([])).count() == 0
