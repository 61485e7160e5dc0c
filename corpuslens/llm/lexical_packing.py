"""Operator 12: packing documents with their lexical neighbours.

The table is dealt into shards: consecutive documents of a task, about
``SHARD_TOKENS`` tokens of them.  A shard keeps an inverted index over its
documents (postings by term, with BM25 weights under the shard's own document
frequencies and mean length).  The first unused document is the seed of a
sequence; scores of all unused documents are summed over the postings of the
seed's terms, and the best ones are taken while they fit.  When none that
shares a term fits, the best one left (the next document, if none shares a
term) is cut: its first part closes the sequence and its rest stays in the
index as a shorter document.  So every sequence is full, whatever the lengths.

Documents longer than a sequence fill whole ones first.  What is left of a shard
when its tokens no longer fill a sequence goes over to the task's next shard;
the last rest of a task becomes sequences of powers of two, which take no padding.

A shard is one Python worker's bounded piece of work (or the longest single
document): texts are not shuffled, so hot sources, copies and lost executors need
no care; a task that runs again over its split gives the same rows.  Numbers of
sequences carry the task's number in their upper bits.

Terms are the vocabulary's own pre-tokens, so a text is split once.  Texts with
signs outside ``PLAIN`` or with the string of an added token are encoded by the
library as a whole; other texts are split here (tested for every sign of
``PLAIN``) and the library encodes each distinct pre-token once per task.

Defined results: null and empty texts have only the closing id and no terms;
equal scores go in the fixed order of the sort; repeated rows and rows without id are
packed each; an empty table gives an empty table; only ``doc_id`` and ``text``
are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batches
from .pretokens import added_tokens, load_tokenizer, text_lists, tokenizer_file

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END = 2                       # id that closes a document
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75             # BM25
CACHE = 400_000               # pre-tokens kept by a task, and those of one shard more
LONG = 1 << 20                # signs of a text from which on its pre-tokens are not held as a list
JOINED = 200                  # pre-tokens that the library takes as one text
PLAIN = "\t\n\r -~\xa0-\u012f\u0131-\u017f"
LETTERS, DIGITS = "a-zªµºß-öø-ÿ\u0100-\u017f", "0-9²³¹¼-¾"      # of PLAIN, in lower case
#: The vocabulary file's own splitting pattern (a fixed value), for PLAIN signs and for any.
PLAIN_PATTERN = rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"


class Slots(dict):
    """Pre-token -> number, by order of arrival."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


@lru_cache(maxsize=1)
def vocabulary_parts(tokenizer_json: str):
    """What a vocabulary file alone decides, made once per Python worker and not per task: the
    library, the library for pre-tokens in lower case put side by side, added tokens, ids that end a pre-token."""
    library, parts = load_tokenizer(tokenizer_json), json.loads(tokenizer_json)
    parts |= {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
    vocabulary = library.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return library, load_tokenizer(json.dumps(parts)), added_tokens(tokenizer_json), closes


class Encoder:
    """Terms and token ids of texts; ids of a term are made once and kept."""

    def __init__(self, tokenizer_json: str):
        self.library, self.merges, self.added, self.closes = vocabulary_parts(tokenizer_json)
        self.odd, self.plain, self.any = re.compile(f"[^{PLAIN}]"), re.compile(PLAIN_PATTERN), re.compile(PATTERN)
        self.reset()

    def reset(self) -> None:
        """Forgets all terms."""
        self.slots, self.size, self.met_odd = Slots(), 0, False
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def renumber(self, terms: list[np.ndarray]) -> list[np.ndarray]:
        """Forgets all terms but those given, which get new numbers."""
        names, odd = list(self.slots), self.met_odd
        self.reset()
        self.met_odd = odd
        return [np.fromiter((self.slots[names[k]] for k in t.tolist()), np.int64) for t in terms]

    def _encode_new(self) -> None:
        new = list(islice(self.slots, self.size, None))
        if not new:
            return
        own, at = new, slice(None)
        if self.met_odd:                                                  # words with odd signs are terms only
            at = [k for k, w in enumerate(new) if not self.odd.search(w)]
            own = [new[k] for k in at]
        joined = [" ".join(own[i:i + JOINED]) for i in range(0, len(own), JOINED)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(joined, add_special_tokens=False))])
        ends = np.flatnonzero(self.closes[ids]) + 1
        assert len(ends) == len(own), "a pre-token's last id must close it"
        size = np.zeros(len(new), np.int64)
        size[at] = np.diff(ends, prepend=0)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size))
        self.ids = np.append(self.ids, ids)
        self.size = len(self.slots)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(terms, ids with the closing id)`` of each text."""
        terms, whole = [], {}
        for i, t in enumerate(texts):
            odd = self.odd.search(t)
            self.met_odd |= odd is not None
            if odd or any(a in t for a in self.added):
                whole[i] = np.array([*self.library.encode(t, add_special_tokens=False).ids, END], np.uint32)
            pattern = self.any if odd else self.plain
            words = pattern.findall(t.lower()) if len(t) < LONG else map(re.Match.group, pattern.finditer(t.lower()))
            terms.append(np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words) if isinstance(words, list) else -1))
        self._encode_new()
        n = np.fromiter(map(len, terms), np.int64, len(terms))
        flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
        size = self.first[flat + 1] - self.first[flat]
        at = np.arange(int(size.sum())) + np.repeat(self.first[flat] - (np.cumsum(size) - size), size)
        ids = self.ids[at]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n)]
        out, a = [], 0
        for i, e in enumerate(ends.tolist()):
            out.append((terms[i], whole[i] if i in whole else np.append(ids[a:e], np.uint32(END))))
            a = e
        return out


class Index:
    """BM25 postings of a shard's documents, by term."""

    def __init__(self, terms: list[np.ndarray]):
        n = np.fromiter(map(len, terms), np.int64, len(terms))
        flat = np.concatenate([*terms, np.zeros(0, np.int64)])
        doc = np.repeat(np.arange(len(terms)), n)
        key, tf = np.unique(flat * max(1, len(terms)) + doc, return_counts=True)
        number, self.doc = np.divmod(key, max(1, len(terms)))
        term = np.cumsum(np.append(False, number[1:] != number[:-1])[:len(key)])   # from 0, without gaps
        df = np.bincount(term)
        idf = np.log1p((len(terms) - df + 0.5) / (df + 0.5))
        length = n[self.doc] / max(1.0, n.mean() if len(n) else 1.0)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        self.first = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        order = np.argsort(self.doc, kind="stable")
        self.of_doc, self.doc_first = term[order], np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(terms)))])
        self.size = len(terms)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct terms of one."""
        t = self.of_doc[self.doc_first[seed]:self.doc_first[seed + 1]]
        lo, n = self.first[t], self.first[t + 1] - self.first[t]
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.size)


class Shard:
    """Documents waiting to be packed: id row, terms, ids, and how far each is used."""

    def __init__(self, capacity: int):
        self.capacity, self.docs, self.tokens = capacity, [], 0

    def add(self, key, terms: np.ndarray, ids: np.ndarray, used: int = 0) -> None:
        self.docs.append((key, terms, ids, used))
        self.tokens += len(ids) - used

    def sequences(self, last: bool):
        """Yields full sequences as lists of ``(document, start, length)``; what cannot fill one
        stays, or, at the ``last``, goes into sequences of powers of two."""
        docs, cap = self.docs, self.capacity
        index = Index([d[1] for d in docs])
        used = np.array([d[3] for d in docs], np.int64)
        left = np.array([len(d[2]) for d in docs], np.int64) - used
        free, total, seed = np.ones(len(docs), bool), int(left.sum()), 0

        def take(d: int, n: int) -> tuple[int, int, int]:
            nonlocal total
            piece = (d, int(used[d]), n)
            used[d] += n
            left[d] -= n
            total -= n
            free[d] = left[d] > 0
            return piece

        while total >= cap:
            while not free[seed]:
                seed += 1
            if left[seed] >= cap:
                yield [take(seed, cap)]
                continue
            room = cap - int(left[seed])
            row = [take(seed, int(left[seed]))]
            if room:
                score = index.scores(seed)
                near = np.flatnonzero(free & (score > 0))
                near = near[np.argsort(-score[near])]
                for d, n in zip(near.tolist(), left[near].tolist()):
                    if n <= room:
                        row.append(take(d, n))
                        room -= n
                        if not room:
                            break
                near = near[free[near]]
                if room and len(near):                         # longer than the room, or it would have been taken
                    row.append(take(int(near[0]), room))
                    room = 0
                while room:                                    # nothing that shares a term is left
                    while not free[seed]:
                        seed += 1
                    n = min(room, int(left[seed]))
                    row.append(take(seed, n))
                    room -= n
            yield row
        if not last:
            self.docs, self.tokens = [], 0
            for d in np.flatnonzero(free).tolist():
                key, terms, ids, _ = docs[d]
                self.add(key, terms, ids, int(used[d]))
            return
        rest = [(d, int(left[d])) for d in np.flatnonzero(free).tolist()]
        for power in [1 << k for k in range(cap.bit_length() - 1, -1, -1) if total >> k & 1]:
            row, room = [], power
            while room:
                d, n = rest[0]
                n = min(n, room)
                row.append(take(d, n))
                room -= n
                rest[0] = (d, int(left[d]))
                if not left[d]:
                    rest.pop(0)
            yield row
        self.docs, self.tokens = [], 0


def _pack(shared, capacity: int, shard_tokens: int, with_ids: bool, kind: pa.DataType):
    def out(shard: Shard, number: int, last: bool):
        docs = shard.docs
        cols = [[] for _ in range(8 + with_ids)]
        for row in shard.sequences(last):
            offset = 0
            for d, start, n in row:
                key, _, ids, _ = docs[d]
                raw = ids[start:start + n].astype("<u4").tobytes()
                for c, x in zip(cols, (key, start, n, zlib.crc32(raw), len(ids), number, offset, raw)):
                    c.append(x)
                offset += n
            number += 1
        arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array(cols[7], pa.binary()))
            names.append("ids")
        return number, pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"         # Spark runs the tasks side by side
        encoder, shard = Encoder(shared.value), Shard(capacity)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch["doc_id"].to_pylist()
            for first, texts in text_lists(batch["text"]):
                for k, (terms, ids) in enumerate(encoder.encode(texts)):
                    shard.add(keys[first + k], terms, ids)
                if shard.tokens >= shard_tokens:
                    number, done = out(shard, number, False)
                    yield done
                    if encoder.size > CACHE:
                        kept = encoder.renumber([d[1] for d in shard.docs])
                        shard.docs = [(d[0], t, *d[2:]) for d, t in zip(shard.docs, kept)]
        if shard.docs:
            yield out(shard, number, True)[1]
    return run


def pack_neighbours(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY,
                    shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their places: ``(doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset[, ids])``; ``capacity`` is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file: a few MB, whatever the input
    field = docs.schema["doc_id"].dataType
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _pack(shared, capacity, shard_tokens, with_ids, to_arrow_type(field)),
        f"doc_id {field.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        f"sequence_id bigint, offset bigint" + ", ids binary" * with_ids)
