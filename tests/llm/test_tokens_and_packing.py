import random
import zlib

import numpy as np
import pytest

from corpuslens.llm import packing as K
from corpuslens.llm import pretokens as P
from corpuslens.llm import queries
from corpuslens.llm import token_counts as T

from llm_cases import rows


@pytest.fixture(scope="module")
def library():
    with open(P.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    return text, P.load_tokenizer(text)


def strange_texts():
    rng = random.Random(5)
    texts = ["", "  ", " a", "it's 'tis ''s he'll've 're 1's2 3'LL", "a\r\n\r\n  b'", "<|endoftext|>a <|endoftext|> b", "日本語１２ ³½ é 😀!!",
             "aaaaaaaaaaaa aaa", " " * 60 + "x", "=" * 101, "՘ ab ⺿\U00020000", "a\x00b\x00 c", "ab" * 3000]
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32, 39, 0x1F600]))
    return texts + ["".join(pick() for _ in range(200)) for _ in range(150)]


def test_counts_and_ids_equal_the_library(library):
    text, tokenizer = library
    classes = P.code_classes()
    texts = strange_texts()
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert T.TokenCounter(text, classes).count_texts(texts).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in K.Encoder(text, classes).encode(texts)] == [w + [0] for w in want]


def test_cache_starts_anew_and_grows(library):
    counter = T.TokenCounter(library[0], P.code_classes())
    counter.known.MOST, counter.known.BITS = 50, 4
    counter.known.reset()
    texts = [f"word{i} other{i * 7} third{i}" for i in range(200)]
    for k in range(0, 200, 20):
        part = texts[k:k + 20]
        assert counter.count_texts(part).tolist() == [len(library[1].encode(t).ids) for t in part]


def test_count_query(spark, sf_dir, library):
    out = {r.doc_id: r for r in queries.QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        n = len(library[1].encode(d.text or "", add_special_tokens=False).ids)
        r = out[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_count_edge_cases(edge, nothing, library):
    out = T.token_counts(edge).collect()
    assert len(out) == len(rows())
    want = sorted(str((i, len((t or "").encode()), len(library[1].encode(t or "").ids))) for i, t, *_ in rows())
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in out) == want
    assert T.token_counts(nothing).count() == 0


def check_packing(out, docs, tokenizer, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in docs:
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == capacity or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, sf_dir, library):
    out = queries.QUERIES["op5_best_fit_packing"](spark, sf_dir).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    used = check_packing(out, docs, library[1])
    assert used <= -(-sum(r.length for r in out) // 2048) + 1


def test_packing_edge_cases(edge, nothing, library):
    unique = edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = K.pack_documents(unique).collect()
    check_packing(out, [(r.doc_id, r.text) for r in unique.collect()], library[1])
    every = K.pack_documents(edge, with_ids=True).collect()
    assert sum(r.piece == 0 for r in every) == len(rows())
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in every)
    assert len({(r.sequence_id, r.offset) for r in every}) == len(every)
    assert K.pack_documents(nothing).count() == 0


def least_bins(lengths, capacity):
    """Exact number of bins of a small instance, by trying every place for each item."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rest):
        nonlocal best
        if len(rest) >= best:
            return
        if k == len(lengths):
            best = len(rest)
            return
        for room in {r for r in rest if r >= lengths[k]}:
            i = rest.index(room)
            place(k + 1, rest[:i] + [room - lengths[k]] + rest[i + 1:])
        place(k + 1, rest + [capacity - lengths[k]])
    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_instances():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
        counts = [lengths.count(s) for s in range(21)]
        kinds = K.bin_completion(counts, 20)
        placed = [s for n, members in kinds for s in members for _ in range(n)]
        assert sorted(placed) == sorted(lengths) and all(sum(m) <= 20 for _, m in kinds)
        assert sum(n for n, _ in kinds) == least_bins(lengths, 20)


def test_bin_completion_improves_on_best_fit():
    """4 + 4 + 2 twice fits two bins of 10 exactly; best fit takes 6 + 4 first."""
    counts = [0] * 11
    for s in (6, 5, 5, 4, 3, 3, 2, 2):
        counts[s] += 1
    assert sum(n for n, _ in K.bin_completion(counts, 10)) == 3


def perfect_triplets(n, seed, capacity=2048):
    """Counts of lengths, between a quarter and a half, that fill n sequences exactly."""
    rng, counts = random.Random(seed), [0] * (capacity + 1)
    for _ in range(n):
        a = rng.randrange(capacity * 38 // 100, capacity * 49 // 100)
        b = rng.randrange((capacity - a) // 2, max((capacity - a) // 2 + 1, min(capacity * 49 // 100, capacity - a - capacity // 4)))
        for s in (a, b, capacity - a - b):
            counts[s] += 1
    return counts


def test_perfect_triplets_are_nearly_found():
    for n, most in ((20, 20), (60, 61), (300, 304)):
        counts = perfect_triplets(n, 1)
        kinds = K.bin_completion(counts)
        assert sum(m for m, _ in K.best_fit(counts, 2048)) > most
        assert n <= sum(m for m, _ in kinds) <= most
        used = [0] * 2049
        for m, members in kinds:
            for s in members:
                used[s] += m
        assert used == counts


def test_fillings_are_complete_and_undominated():
    """Against every subset of small instances; thousands of equal lengths fill in one step."""
    rng = random.Random(5)
    for _ in range(40):
        free = [0] * 16
        for _ in range(rng.randrange(1, 7)):
            free[rng.randrange(1, 16)] += 1
        room, sizes = rng.randrange(1, 16), [s for s in range(16) if free[s]]
        every = [()]
        for s in sizes:
            every = [f + (s,) * n for f in every for n in range(free[s] + 1)]
        every = [f for f in every if sum(f) <= room]
        want = {tuple(sorted(f)) for f in every
                if not any(free[s] > f.count(s) and m < s <= m + room - sum(f) for m in {0, *f} for s in sizes)}
        got = [f for f in K.fillings(room, sizes, free, room) if f is not None]
        assert sorted(map(sum, got), reverse=True) == list(map(sum, got))
        assert len(got) == len(set(got)) and {tuple(sorted(f)) for f in got} == want
    free = [0, 3000]
    assert next(K.fillings(1248, [1], free, 0)) == (1,) * 1248


def test_lower_bound_counts_lengths_that_share_nothing():
    counts = [0] * 11
    counts[6], counts[5] = 3, 1
    assert K.least_sequences(counts, 10) == 4 and K.bin_completion(counts, 10, nodes=0)
    assert K.least_sequences([0] * 11, 10) == 0 and K.bin_completion([0] * 11, 10) == []
