"""Packing by lexical neighbours: whole round trip, no padding, neighbours first."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import prose
from tokenizers import Tokenizer

from corpuslens.llm import lexical_packing as L
from corpuslens.llm.pretokens import tokenizer_file

FILE = tokenizer_file(L.VOCABULARY)
LIBRARY = Tokenizer.from_file(FILE)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, L.END]


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, encoding="utf-8") as f:
        return L.Encoder(f.read())


def test_ids_equal_the_library(encoder):
    signs = [chr(c) for c in range(0x250)]
    texts = [f"ab{c}cd {c}{c} 1{c}2 !{c}? it'{c}s's{c}'ll A{c}_B_{c}__ '{c}" for c in signs]
    rnd = random.Random(1)
    texts += ["".join(rnd.choices(signs + ["'", "s", " "] * 60, k=200)) for _ in range(300)]
    texts += ["", " ", "a <|endoftext|> b <|startoftext|>", "日本語 é   x", "𝔘𝔫𝔦 ſt ﬁ K İ", prose(5, 3000), "Z" * 3000, "\x00\x1c\x85 a"]
    for a in range(0, len(texts), 100):
        got = encoder.encode(texts[a:a + 100])
        assert [g[1].tolist() for g in got] == [ids_of(t) for t in texts[a:a + 100]]


def test_vocabulary_is_loaded_once_per_worker(monkeypatch):
    """Tasks that follow each other in one Python worker share the loaded library, not the terms."""
    loads = []
    monkeypatch.setattr(L, "load_tokenizer", lambda text: loads.append(1) or Tokenizer.from_str(text))
    L.vocabulary_parts.cache_clear()
    with open(FILE, encoding="utf-8") as f:
        text = f.read()
    first, second = L.Encoder(text), L.Encoder(text)
    assert len(loads) == 2 and first.encode(["red green"])[0][1].tolist() == ids_of("red green")
    assert not second.slots and second.encode(["green"])[0][1].tolist() == ids_of("green")
    assert L.Index([np.zeros(0, np.int64)]).scores(0).tolist() == [0.0]


def test_terms_survive_renumbering(encoder):
    (before, _), = encoder.encode(["red green blue green"])
    (after,) = encoder.renumber([before])
    names = list(encoder.slots)
    assert [names[k] for k in after] == ["red", "green", "blue", "green"]
    assert encoder.encode(["green red"])[0][1].tolist() == ids_of("green red")


def test_scores_equal_bm25(encoder):
    texts = [prose(k % 7, 40 + k) for k in range(60)] + [""]
    terms = [t for t, _ in encoder.encode(texts)]
    index = L.Index(terms)
    mean = np.mean([len(t) for t in terms])
    for seed in (0, 13, 60):
        got = index.scores(seed)
        for d in range(len(texts)):
            want = 0.0
            for t in set(terms[seed].tolist()):
                df, tf = sum(t in x for x in terms), (terms[d] == t).sum()
                if tf:
                    want += np.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * tf * (L.K1 + 1) / (tf + L.K1 * (1 - L.B + L.B * len(terms[d]) / mean))
            assert abs(got[d] - want) < 1e-9


def test_neighbours_share_sequences(encoder):
    """Documents of five subjects, shuffled: sequences hold mostly one subject."""
    rnd = random.Random(2)
    subject = [rnd.randrange(5) for _ in range(400)]
    texts = [" ".join(f"{'abcde'[s]}word{rnd.randrange(50)}" for _ in range(60)) for s in subject]
    shard = L.Shard(1024)
    for k, (t, ids) in enumerate(encoder.encode(texts)):
        shard.add(k, t, ids)
    rows = list(shard.sequences(True))
    same = [max(np.bincount([subject[d] for d, _, _ in r])) / len(r) for r in rows if len(r) > 2]
    assert np.mean(same) > 0.9


def check(rows, texts, capacity):
    """Each id in exactly one piece, checksums right, sequences gapless and a power of two long."""
    sequences, of_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        of_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
        lengths.append(at)
    for d, t in texts.items():
        ids, at = np.array(ids_of(t), "<u4"), 0
        for start, n, crc, total in sorted(of_doc[d]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start:start + n].tobytes())
            at += n
        assert at == len(ids)
    return lengths


def test_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for capacity, shard in ((4096, L.SHARD_TOKENS), (256, 20_000)):
        rows = L.pack_neighbours(docs, capacity=capacity, shard_tokens=shard).collect()
        assert {r["doc_id"] for r in rows} == set(texts)
        lengths = check(rows, texts, capacity)
        assert sum(n < capacity for n in lengths) <= 3 * 12
    with pytest.raises(ValueError):
        L.pack_neighbours(docs, capacity=1000)


def test_edges(spark, edge, nothing):
    rows = L.pack_neighbours(edge, with_ids=True).collect()
    texts = {}
    total = 0
    for r in edge.select("doc_id", "text").collect():
        texts[r["doc_id"]] = r["text"]
        total += len(ids_of(r["text"]))
    assert sum(r["length"] for r in rows) == total and sum(len(r["ids"]) for r in rows) == 4 * total
    single = edge.filter("doc_id is not null and doc_id != 4")
    check(L.pack_neighbours(single).collect(), {r["doc_id"]: r["text"] for r in single.collect()}, 4096)
    assert L.pack_neighbours(edge).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert L.pack_neighbours(nothing).count() == 0
    assert {r["doc_id"] for r in rows} == set(texts)
