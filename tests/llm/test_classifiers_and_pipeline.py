import math
import zlib

import numpy as np

import corpus_pipeline
from corpuslens.llm import common as C
from corpuslens.llm import language as L
from corpuslens.llm import queries
from corpuslens.llm import toxicity as X

from llm_cases import rows
from test_decontaminate import brute as contaminated
from test_near_dedup import brute as groups


def out_of_training(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_query_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op9_language_id"](spark, sf).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == out_of_training(r.doc_id) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and truth[r.doc_id].lang]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert sum(r.rejected for r in out) <= 2


def plain_counts(text):
    """Hashed n-grams of a text, one at a time."""
    b = []
    for x in (" " + (text or "").lower() + " ").encode("utf-8", "replace"):
        x = x if 97 <= x <= 122 or x >= 128 else 32
        if x != 32 or not b or b[-1] != 32:
            b.append(x)
    out = {}
    if len(b) >= 3:
        grams = [(x, 1) for x in b if x != 32] + [(x << 8 | y, 2) for x, y in zip(b, b[1:])]
        for code, seed in grams + [(x << 16 | y << 8 | z, 3) for x, y, z in zip(b, b[1:], b[2:])]:
            h = code * 2654435761 % 2**32 ^ seed
            h ^= h >> 15
            place = (h * 2246822519 % 2**32) >> 32 - (L.FEATURES.bit_length() - 1)
            out[place] = out.get(place, 0) + 1
    return out


def plain_prediction(model, text):
    """Language, cosine and rejection by sums over dictionaries."""
    counts = plain_counts(text)
    v = {k: math.log1p(n) * float(model["idf"][k]) for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    cosines = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model["centre"]]
    best = max(range(len(cosines)), key=lambda c: cosines[c])
    language = int(model["of"][best])
    bound = model["low"][language][int(math.log2(1 + len(counts)))]
    return model["names"][language], cosines, cosines[best], bound


FOREIGN = """Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.
Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.
Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet.
Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.
Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.""".split("\n")


def test_language_equals_plain_cosines_and_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, grams = L.train(L.training_rows(docs)), L.Grams()
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    junk = [" ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n)) for n in (8, 16, 64, 256) for _ in range(20)]
    own = [r.text for r in docs.filter("text IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    texts = own + junk + FOREIGN + ["", None, "12 !", "x"]
    names, score, rejected = L.predict(model, grams, texts)
    for t, name, s, no in zip(texts, names, score, rejected):
        if not L.has_letter(t):
            assert (name, s, no) == ("und", 0.0, True)
            continue
        want, cosines, cosine, bound = plain_prediction(model, t)
        assert abs(s - min(1, max(0, cosine))) < 1e-4
        assert name == want or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4
        assert no == (cosine < bound) or abs(cosine - bound) < 1e-4
    assert rejected[len(own):len(own) + len(junk) + len(FOREIGN)].mean() > 0.98 and rejected[-9:-4].all()
    assert rejected[:len(own)].sum() <= 1


def test_bounds_are_those_of_the_beginnings(spark):
    rows = [(" ".join(f"{a}{k % 7}{a}o the{a}r" for k in range(n)), y) for n in (1, 3, 9, 40, 200) for a, y in (("b", "x"), ("zw", "y")) for _ in range(25)]
    model = L.train(rows)
    reached = {}
    for t, y in rows:
        for n in {*(n for n in L.STARTS if n < len(t)), len(t)}:
            _, cosines, _, _ = plain_prediction(model, t[:n])
            size = int(math.log2(1 + len(plain_counts(t[:n]))))
            for c, z in enumerate(model["names"]):
                best = max(x for x, of in zip(cosines, model["of"]) if of == c)
                reached.setdefault((c, size, y == z), []).append(best)
    checked = 0
    for (c, size, own), values in reached.items():
        if own and len(values) >= L.ENOUGH:
            least, other = np.quantile(values, L.QUANTILE), reached.get((c, size, False))
            foreign = np.quantile(other, 1 - L.QUANTILE) if other else 0
            assert abs(model["low"][c, size] - min(L.NEAR * least, max(L.SAFE * least, foreign))) < 1e-4
            checked += 1
    assert checked >= 3 and model["low"].shape == (2, L.FEATURES.bit_length())


def test_language_edge_cases(edge, nothing, spark):
    out = L.languages(edge)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    got = out.collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id in (0, 1, 2, 9):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred == "en"
    assert L.drop_rejected(edge).columns == edge.columns
    assert L.languages(nothing).count() == 0 and L.drop_rejected(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert L.languages(unlabelled).first().lang_pred == "und"
    assert L.has_letter("x" * 3) and L.has_letter("1 " * 100 + "é") and not L.has_letter("² 12 !") and not L.has_letter("")


def test_far_texts_are_rejected():
    model = L.train([(f"the cat and the dog number {'abc'[k % 3]} went over there together", "en") for k in range(30)])
    grams = L.Grams()
    names, score, rejected = L.predict(model, grams, ["the dog and the cat", "щчъ ыэю ящф жцх", None])
    assert not rejected[0] and rejected[1] and rejected[2] and names[0] == "en"


def test_toxicity_query_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == out_of_training(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out_of_training(r.doc_id)]
    score = np.array([out[i].score for i, _ in labels])
    y = np.array([t for _, t in labels])
    pairs = (score[y == 1][:, None] > score[y == 0][None]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None]).mean()
    assert pairs > 0.9
    assert np.mean([out[i].predicted == t for i, t in labels]) > 0.95


def test_toxicity_edge_cases(edge, nothing, spark):
    labels = spark.createDataFrame([(i, int(i % 2), "x") for i in range(12)] + [(3, None, "x"), (4, 1, "x"), (None, 1, "x")],
                                   "doc_id bigint, toxic int, text string")
    assert X.toxicity(edge, labels).count() == len(rows())
    got = X.toxicity(edge, labels.limit(0)).collect()
    assert len(got) == len(rows()) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert X.toxicity(nothing, labels).count() == 0


def test_trees_isotonic_and_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = X.fit(x[:400], y[:400], np.arange(400) % 4 == 0)
    assert ((X.probabilities(model, x[400:]) >= 0.5) == y[400:]).mean() > 0.9
    at, value = X.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(value) > 0).all() and value.tolist() == [0, 0.5, 1]
    import pyarrow as pa
    f = X.Featurizer({}).rows(pa.array(["you are an IDIOT!!", "a calm day", "", None, "such st*pid noooise"]))
    col = dict(zip(X.FEATURES, f.T))
    assert col["insult_density"].tolist() == [0.25, 0, 0, 0, 0] and col["closeness"][0] > 0 and col["capital_words"][0] == 0.25
    assert col["obfuscated"][4] > 0 and col["long_runs"][4] > 0 and not f[2].any() and not f[3].any()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    known, near, clean, private, packed = (f for _, f in corpus_pipeline.STAGES)
    have = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    left = known(spark, docs, sf_dir)
    model = L.train(L.training_rows(docs))
    assert left.columns == docs.columns
    gone = {i for i, _ in have} - {r.doc_id for r in left.collect()}
    assert gone == {i for i, t in have if not L.has_letter(t) or plain_prediction(model, t)[2] < plain_prediction(model, t)[3]}
    unique = near(spark, docs, sf_dir)
    assert {r.doc_id for r in unique.collect()} == {i for i, (_, c) in groups(have, 5).items() if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in clean(spark, docs, sf_dir).collect()} == {w[0] for w in contaminated(have, items) if not w[5]}
    assert private(spark, docs, sf_dir).columns == docs.columns


def test_pipeline_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "packing"]
    used = {}
    for r in out:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert out and max(used.values()) <= 2048


def test_samples_hold_at_every_input_size(spark):
    for count in (401, 10**6, 419 * 10**6, 10**9, 10**10, 10**13):
        assert abs((C.last_place(400, count) + 1) / C.PLACES * count - 400) < 0.01
    assert C.last_place(400, 400) == C.last_place(400, 1) == C.PLACES - 1
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id < 20, 'few', 'many') AS lang")
    got = [lang for _, lang in L.training_rows(docs, 300)]
    assert got.count("few") == sum(not out_of_training(i) for i in range(20)) and 220 < got.count("many") < 380
