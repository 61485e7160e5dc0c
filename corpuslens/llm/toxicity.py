"""Operator 10: toxicity by gradient-boosted trees over dense features.

Per text: densities of two lexicons (a short list of plain insults, and words
and word beginnings that the labelled training texts single out), how close
lexicon words stand to second-person words, and rates of capitals, punctuation
and obfuscated words.  Small boosted trees on these are calibrated by isotonic
regression on training rows that the trees did not see.

Training uses at most about ``TRAIN_ROWS`` labelled rows of each label, picked by
a hash of the id among those that are not held out; the bound is a parameter.
The learned lexicon is a grouped count in Spark.  Scoring reads whole texts,
row by row, so skew and lost executors need no care.

Defined results: null and empty texts are scored from features that are all 0;
without rows of both labels every score is the share of label 1 seen (0 if
none); a document with several labels counts as toxic if one says so;
repeated rows get equal scores; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, last_place, place
from .words import SpanHasher, Words, text_slices, word_bytes

TRAIN_ROWS = 4000
LEXICON_SIZE = 4000
PREFIXES = (4, 5, 6, 7, 8)        # word beginnings, in bytes
LEAST_DOCS, LEAST_ODDS = 4, 2.5   # toxic training texts with the entry; log odds
NEAR = 6                          # words between a lexicon word and a second-person word
TREES, LEVELS, RATE, BINS = 60, 3, 0.2, 32

# Plain insults, and second-person words (English, German, French, Spanish)
INSULTS = ("idiot idiots moron morons stupid dumb fool loser losers trash scum garbage pathetic worthless disgusting "
           "clown imbecile jerk hate ugly idiotin dumm trottel abschaum widerlich idiote stupide imbécile ordure minable "
           "tonto estúpido idiota basura asqueroso inútil").split()
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous "
                 "votre vos tú ti tus usted ustedes vosotros").split()
FEATURES = ("insult_density insult_hits learned_density learned_hits learned_weight learned_most distinct_hits near_density "
            "closeness capitals capital_words punctuation exclamations symbols obfuscated long_runs log_words").split()


def word_hashes(words: list[str]) -> np.ndarray:
    reader = SpanHasher()
    data = [w.encode() for w in words]
    end = np.cumsum([len(d) for d in data])
    return np.sort(reader.hash(np.frombuffer(b"".join(data), np.uint8), end - [len(d) for d in data], end))


def among(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def terms(words: Words, reader: SpanHasher):
    """``(word index, hash)`` of all words and of the beginnings of longer ones."""
    yield np.arange(len(words.start)), words.hash
    size = words.end - words.start
    for k, n in enumerate(PREFIXES):
        at = np.flatnonzero(size > n)
        yield at, reader.spans(words.sums, words.start[at], words.start[at] + n) ^ np.uint64(k + 1)


class Featurizer:
    def __init__(self, lexicon: dict[int, float]):
        keys = np.array(sorted(lexicon), np.uint64)
        self.keys, self.weight = keys, np.array([lexicon[int(k)] for k in keys], np.float64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.insults, self.second = word_hashes(INSULTS), word_hashes(SECOND_PERSON)
        self.reader, self.mask = SpanHasher(), word_bytes()
        t = np.zeros(256, np.uint8)
        t[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
        self.punct = t.astype(bool)

    def learned(self, words: Words) -> np.ndarray:
        """Largest weight of each word's entries in the learned lexicon."""
        out = np.zeros(len(words.start))
        for at, h in terms(words, self.reader):
            maybe = self.seen[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            if len(at):
                k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                np.maximum.at(out, at, np.where(self.keys[k] == h, self.weight[k], 0))
        return out

    def rows(self, column: pa.Array) -> np.ndarray:
        """The features of each text."""
        out = [np.zeros((0, len(FEATURES)))]
        for _, _, data, offsets in text_slices(column):
            words = Words(data, offsets, self.mask, self.reader)
            out.append(self._slice(words, data, offsets))
        return np.concatenate(out)

    def _slice(self, w: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, first = len(offsets) - 1, w.first
        words, size = np.diff(first), np.diff(offsets)
        row = np.repeat(np.arange(n), words)
        total = lambda x: np.bincount(row, weights=x, minlength=n)[:n] if len(row) else np.zeros(n)
        by_byte = lambda m: _row_sums(m, offsets)
        weight = self.learned(w)
        insult, learned = among(self.insults, w.hash), weight > 0
        hit = insult | learned
        at = np.flatnonzero(hit)
        person = np.flatnonzero(among(self.second, w.hash))
        near = np.zeros(n)
        close = np.zeros(n)
        if len(at) and len(person):
            for k in (np.searchsorted(person, at) - 1, np.searchsorted(person, at)):
                ok = (k >= 0) & (k < len(person))
                p = person[np.clip(k, 0, len(person) - 1)]
                ok &= row[p] == row[at]
                gap = np.abs(p - at)
                np.maximum.at(close, row[at[ok]], 1.0 / (1 + gap[ok]))
                np.add.at(near, row[at[ok & (gap <= NEAR)]], 1)
        most = np.zeros(n)
        np.maximum.at(most, row, weight)
        distinct = np.zeros(n)
        if len(at):
            pairs = np.unique(np.stack([row[at].astype(np.uint64), w.hash[at]], axis=1), axis=0)
            distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=n).astype(float)
        upper = (data >= 65) & (data <= 90)
        letters = by_byte(upper | (w.data >= 97) & (w.data <= 122))
        digit = (w.data >= 48) & (w.data <= 57)
        letter = (w.data >= 97) & (w.data <= 122)
        mixed = np.zeros(len(data), bool)                 # a digit or sign between two letters
        if len(data) > 2:
            mixed[1:-1] = letter[:-2] & letter[2:] & (digit | np.isin(w.data, [36, 42, 64, 33, 35]))[1:-1]
        runs = np.zeros(len(data), bool)
        if len(data) > 2:
            runs[2:] = letter[2:] & (w.data[2:] == w.data[1:-1]) & (w.data[2:] == w.data[:-2])
        ups = np.concatenate([[0], np.cumsum(upper)])
        shout = (ups[w.end] - ups[w.start] == w.end - w.start) & (w.end - w.start > 1)
        many, long = np.maximum(words, 1), np.maximum(size, 1)
        return np.stack([
            total(insult) / many, np.log1p(total(insult)), total(learned) / many, np.log1p(total(learned)),
            total(weight) / many, most, np.log1p(distinct), near / many, close,
            by_byte(upper) / np.maximum(letters, 1), total(shout) / many, by_byte(self.punct[data]) / long,
            by_byte(data == 33) / long, by_byte(np.isin(data, [35, 36, 37, 38, 42, 64])) / long,
            by_byte(mixed) / many, by_byte(runs) / many, np.log1p(words)], axis=1)


def _row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(mask)])
    return (run[offsets[1:]] - run[offsets[:-1]]).astype(float)


# ---------------------------------------------------------------- trees

def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees with logistic loss on binned features; Newton leaves."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        tree = []
        for level in range(LEVELS):
            nodes = 1 << level
            best = [(1e-6, -1, 0)] * nodes
            for j in range(x.shape[1]):
                cell = node * BINS + binned[:, j]
                gs = np.cumsum(np.bincount(cell, g, nodes * BINS).reshape(nodes, BINS), axis=1)
                hs = np.cumsum(np.bincount(cell, h, nodes * BINS).reshape(nodes, BINS), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
                for k in range(nodes):
                    b = int(np.argmax(gain[k, :-1]))
                    if gain[k, b] > best[k][0] and b < len(cuts[j]):
                        best[k] = (float(gain[k, b]), j, b)
            tree.append([(j, float(cuts[j][b])) if j >= 0 else (0, float("inf")) for _, j, b in best])
            right = np.array([binned_right(binned, j, b) for _, j, b in best])
            node = node * 2 + right[node, np.arange(len(y))]
        leaves = 1 << LEVELS
        value = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        score += value[node]
        trees.append((tree, value))
    return {"base": base, "trees": trees}


def binned_right(binned: np.ndarray, j: int, b: int) -> np.ndarray:
    return (binned[:, j] > b).astype(np.int64) if j >= 0 else np.zeros(len(binned), np.int64)


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    score = np.full(len(x), model["base"])
    for tree, value in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for splits in tree:
            feature, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
            node = node * 2 + (x[np.arange(len(x)), feature[node]] >= cut[node])
        score += value[node]
    return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean score and calibrated value of each block."""
    blocks: list[list[float]] = []
    for s, v in sorted(zip(score.tolist(), y.tolist())):
        blocks.append([s, v, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> dict:
    """Trees on the rows outside ``calibrate``, isotonic steps on those inside."""
    if len(set(y[calibrate].tolist())) < 2 or len(set(y[~calibrate].tolist())) < 2:
        calibrate = np.zeros(len(y), bool)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    model = boost(x[~calibrate], y[~calibrate])
    use = calibrate if calibrate.any() else ~calibrate
    model["at"], model["value"] = isotonic(raw_scores(model, x[use]), y[use])
    return model


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return np.clip(np.interp(raw_scores(model, x), model["at"], model["value"]), 0, 1)


# ---------------------------------------------------------------- Spark

def _terms(batches):
    reader, mask = SpanHasher(), word_bytes()
    for batch in batches:
        out = []
        for _, _, data, offsets in text_slices(batch["text"]):
            w = Words(data, offsets, mask, reader)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
            at, h = (np.concatenate(x) for x in zip(*terms(w, reader)))
            order = np.lexsort((h, row[at]))
            h, r = h[order], row[at][order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[fresh], r[fresh]
            edge = np.searchsorted(r, np.arange(len(offsets)))
            out += [h[a:b].view(np.int64) for a, b in zip(edge, edge[1:])]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(out, pa.list_(pa.int64()))], ["toxic", "terms"])


def _features(shared):
    def run(batches):
        features = Featurizer(shared.value)
        for batch in batches:
            x = features.rows(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["toxic"], batch["fold"], pa.array(list(x), pa.list_(pa.float64()))],
                                             ["toxic", "fold", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict, dict]:
    """``(lexicon, model)`` from a bounded sample of labelled rows that are not held out."""
    spark = docs.sparkSession
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(last_place(rows, n)).cast("bigint"))]) if sizes else None
    if part is None:
        return {}, {"constant": 0.0}
    chosen = known.filter(place(F.col("doc_id")) <= part[F.col("toxic")])  # about 2 * rows rows, whatever the input: broadcast
    sample = (docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
              .join(F.broadcast(chosen), "doc_id")
              .select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(4)).cast("int").alias("fold")).persist())
    n1 = sample.filter("toxic = 1 AND fold <> 0").count()
    n0 = sample.filter("toxic = 0 AND fold <> 0").count()
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") + 0.5) / (n0 + 1.0))
    lexicon = (sample.filter("fold <> 0").select("text", "toxic").mapInArrow(_terms, "toxic int, terms array<bigint>")
               .select("toxic", F.explode("terms").alias("term"))
               .groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))
               .filter(F.col("t") >= LEAST_DOCS).withColumn("w", odds).filter(F.col("w") >= LEAST_ODDS)
               .orderBy(F.desc("t"), F.desc("w"), "term").limit(LEXICON_SIZE).collect())
    lexicon = {r["term"] % (1 << 64): float(r["w"]) for r in lexicon}
    seen = sample.mapInArrow(_features(spark.sparkContext.broadcast(lexicon)), "toxic int, fold int, x array<double>").collect()
    sample.unpersist()
    seen.sort(key=lambda r: (r["fold"], r["toxic"], r["x"]))
    x = np.array([r["x"] for r in seen], float).reshape(-1, len(FEATURES))
    y, fold = np.array([r["toxic"] for r in seen], float), np.array([r["fold"] for r in seen])
    return lexicon, fit(x, y, fold == 0)


def _score(shared):
    def run(batches):
        lexicon, model = shared.value
        features = Featurizer(lexicon)
        for batch in batches:
            p = probabilities(model, features.rows(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p, pa.float64())], ["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text)``;
    learns from ``labels(doc_id, toxic)``."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _score(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
