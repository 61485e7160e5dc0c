"""Operator 3: document fingerprints by consistent weighted sampling (native).

Terms are the lower-cased words of a text, weighted by how often they occur.
For each of ``samples`` draws, a term of weight w gets from its hash
r, c ~ Gamma(2, 1) and b ~ U(0, 1), the level t = floor(ln w / r + b) and the
value ln a = ln c - r (t - b + 1); the draw keeps the (term, t) with the least
a.  Two texts keep the same one with a probability equal to the generalised
Jaccard similarity of their weights, so the share of equal draws estimates it.

A draw is one bigint: the rank of ln a above a tag of the term and level, so
that each draw is a plain ``min`` in a hash aggregate.

Only DataFrame functions are used.  Texts are shuffled once by document, and
the beginnings that go into the next document's edited text once more; words
are exploded, counted and sampled inside those partitions.  A document's place
in the order comes from range partitioning and the counts of the partitions
before, not from one sorted task.

Defined results: null and empty texts have the empty fingerprint; two empty
fingerprints are 1 alike, an empty and another 0; rows that repeat an id and a
text have equal results, and stand as one document in the order; rows with one
id and different texts are ordered by a hash of the text; rows without id come
last; a single document is its own next one; an empty table gives an empty
table.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SAMPLES = 24
SCALE, OFFSET = 1 << 20, 100   # steps per unit of ln a; makes it positive
TAG_BITS = 36
NO_ID = -(1 << 63)


def draw(term: str, log_weight: str, k: int) -> Column:
    """The k-th draw's value for a term (a bigint column) of a weight, as a bigint."""
    one, two = f"xxhash64({term}, {2 * k})", f"xxhash64({term}, {2 * k + 1})"
    uniform = lambda z, at, n: f"(((shiftrightunsigned({z}, {at}) & {(1 << n) - 1}L) + 0.5D) / {1 << n}D)"
    r = f"(-ln({uniform(one, 0, 32)} * {uniform(one, 32, 32)}))"
    log_c = f"ln(-ln({uniform(two, 0, 24)} * {uniform(two, 24, 20)}))"
    b = uniform(two, 44, 20)
    level = f"floor({log_weight} / {r} + {b})"
    rank = f"CAST(({log_c} - {r} * ({level} - {b} + 1D) + {OFFSET}D) * {SCALE}D AS BIGINT)"
    return F.expr(f"shiftleft({rank}, {TAG_BITS}) + (xxhash64({one}, {level}) & {(1 << TAG_BITS) - 1}L)")


def words(text: Column) -> Column:
    return F.split(F.translate(F.lower(text), "\t\n\u000b\f\r", "     "), " ")


def sampled(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys``, ``mine`` and ``other``: the draws of ``text`` and of ``edited`` (null
    without words).  ``texts`` should be partitioned by ``keys``."""
    both = (texts.select(*keys, words(F.col("text")).alias("w"), words(F.col("edited")).alias("v"))
            .select(*keys, F.size("w").alias("n"), F.posexplode(F.concat("w", "v")).alias("pos", "word")).filter("word <> ''"))
    weights = (both.select(*keys, F.xxhash64("word").alias("term"), (F.col("pos") < F.col("n")).cast("int").alias("own"))
               .groupBy(*keys, "term").agg(F.sum("own").alias("x"), F.sum(1 - F.col("own")).alias("y"))
               .select(*keys, "term", *(F.when(F.col(c) > 0, F.log(F.col(c).cast("double"))).alias(f"log_{c}") for c in "xy")))
    draws = [F.min(draw("term", f"log_{c}", k)).alias(f"{c}{k}") for k in range(samples) for c in "xy"]
    array = lambda c: F.when(F.col(f"{c}0").isNotNull(), F.array(*[F.col(f"{c}{k}") for k in range(samples)]))
    return weights.groupBy(*keys).agg(*draws).select(*keys, array("x").alias("mine"), array("y").alias("other"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def written(draws: Column) -> Column:
    """Hexadecimal digits of the draws' tags."""
    tag = F.transform(draws, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND((1 << 32) - 1))), 8, "0"))
    return F.coalesce(F.array_join(tag, ""), F.lit(""))


def ordered(docs: DataFrame) -> DataFrame:
    """``(id, digest, n, rows, place)``: distinct documents numbered from 0 by descending id."""
    small = docs.groupBy("id", "digest").agg(F.min(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows"))
    order = [F.desc("id"), F.asc("digest")]
    placed = staged(small.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row per partition
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    base = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])[part] if before else F.lit(0)
    return placed.select("id", "digest", "n", "rows", (base + row).cast("bigint").alias("place"), F.lit(total).cast("bigint").alias("total"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)`` per row of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), text.alias("text")).withColumn("digest", F.xxhash64("text"))
    key = ["id", "digest"]
    place = staged(ordered(docs))
    after = place.select(F.pmod(F.col("place") - 1, "total").alias("place"), F.col("id").alias("next_id"), F.col("digest").alias("next_digest"))
    links = staged(place.join(after, "place").select(*key, "n", "rows", "next_id", "next_digest"))

    one = docs.groupBy(*key).agg(F.first("text").alias("text"))
    give = links.select(F.col("next_id").alias("id"), F.col("next_digest").alias("digest"), F.col("id").alias("to_id"),
                        F.col("digest").alias("to_digest"), F.floor(F.col("n") / 3).cast("int").alias("asked"))
    given = one.join(give, key).select(F.col("to_id").alias("id"), F.col("to_digest").alias("digest"), F.expr("substring(text, 1, asked)").alias("gift"))
    texts = one.join(given, key).select(*key, "text", F.expr(
        "concat(substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT)), gift)").alias("edited"))

    hashed = texts.select(*key, F.sha2("edited", 256).alias("edited_sha256"))
    prints = staged(hashed.join(sampled(texts, key, samples), key, "left").join(links, key))
    next_print = prints.select(F.col("id").alias("next_id"), F.col("digest").alias("next_digest"), F.col("mine").alias("next_mine"))
    return (prints.join(next_print, ["next_id", "next_digest"])
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
            .select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"), "edited_sha256",
                    written(F.col("mine")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
                    likeness(F.col("mine"), F.col("other")).alias("near_edited"),
                    likeness(F.col("mine"), F.col("next_mine")).alias("near_next")))
