"""Quality classifier by importance resampling of hashed n-grams.

Two generative models over hashed words, punctuation marks and pairs of them are counted: one of target
text (labelled documents of high quality), one of the whole corpus. A document's log weight is the mean
log ratio of the two over its n-grams, scaled, and measured from a level that labelled documents held
back from the target model fix. Documents are drawn without replacement by the Gumbel top-k rule; k is
the expected number of acceptances, the sum of all weights cut at 1, so it follows the corpus.

Toxicity is a second log ratio of the same n-grams: in how many toxic and in how many other labelled
documents each occurs. N-grams whose lean to the toxic side is beyond chance carry weight; a document has the
weight of its heaviest, whatever its length, so a few words in a long text still count. Labelled documents,
each rated by the counts of the others, fix the level from which a document is toxic. `accepted` is the draw by
quality alone, `kept` is accepted and not toxic.

Cases: a null or empty text has no n-grams and is rejected; very long texts are counted whole; repeated
rows have equal keys and go or stay together; without labelled documents of low quality nothing but
empty texts is rejected; without labelled toxic documents nothing is toxic; an empty table gives no rows; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import columns, tables

BUCKET_BITS = 17
#: Labelled rows used at most: the target model and the level are fitted on a sample of this size.
LABEL_LIMIT = 20_000
SMOOTHING = 1.0
SHARPNESS = 100.0
#: Log ratios are kept as integers of this fraction, so that sums do not depend on the order of the n-grams.
FIXED_POINT = 1 << 20
SEED = 7
#: An n-gram must occur in this many toxic documents to carry weight.
MIN_TOXIC = 3

_KIND = np.full(256, 2, np.int8)
_KIND[128:] = 1
for _low, _high in ((48, 57), (65, 90), (95, 95), (97, 122)):
    _KIND[_low : _high + 1] = 1
_KIND[[32, 9, 10, 11, 12, 13]] = 0


@dataclass(frozen=True)
class Toxicity:
    """Sorted hashes of n-grams, their weights, and the level from which the heaviest of a document is toxic."""

    hashes: np.ndarray
    weights: np.ndarray
    level: float = np.inf


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray
    level: float
    toxicity: Toxicity


def ngram_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of single tokens and of token pairs, each with the first place of every text."""
    data, offsets = columns.text_bytes(column)
    data = columns.lowered(data)
    start, end, first = columns.runs(_KIND[data], offsets)
    tokens = columns.span_hashes(data.astype(columns.U64) + columns.U64(1), start, end)
    pairs, pair_first = columns.sequence_hashes(tokens, first, 2)
    return tokens, first, columns.mix(pairs), pair_first


def ngram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of single tokens and of token pairs, each with the first place of every text."""
    tokens, first, pairs, pair_first = ngram_hashes(column)
    return bucket(tokens), first, bucket(pairs), pair_first


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> columns.U64(64 - BUCKET_BITS)).astype(np.int64)


def label_sample(labels: DataFrame, limit: int = LABEL_LIMIT) -> DataFrame:
    """doc_id, role and side of at most `limit` labelled documents.

    The role is target, or held back (good or bad); the side is toxic or clean.
    """
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.max("toxic").alias("said"))
    drawn = one.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(limit)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    held = F.xxhash64("doc_id", F.lit(SEED + 1)) % 2 == 0
    role = F.when(F.col("quality") == 0, "bad").when(good & ~held, "target").when(good, "good")
    side = F.when(F.col("said") == 1, "toxic").when(F.col("said") == 0, "clean")
    return drawn.select("doc_id", role.alias("role"), side.alias("side")).where("role IS NOT NULL OR side IS NOT NULL")


def with_roles(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample holds at most LABEL_LIMIT ids, so it is sent to every task and texts stay where they are."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")


def count_ngrams(rows: DataFrame) -> DataFrame:
    """bucket, raw and target counts over all documents; every task sends one row per bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns.release_kept()
        raw = np.zeros(1 << BUCKET_BITS, np.int64)
        target = np.zeros(1 << BUCKET_BITS, np.int64)
        for block in columns.blocks(batches, "text"):
            wanted = np.array([r == "target" for r in block.column("role").to_pylist()], bool)
            singles, first, pairs, pair_first = ngram_buckets(block.column("text"))
            for buckets, at in ((singles, first), (pairs, pair_first)):
                raw += np.bincount(buckets, minlength=len(raw))
                target += np.bincount(buckets[np.repeat(wanted, np.diff(at))], minlength=len(raw))
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    counted = rows.select("text", "role").mapInArrow(count, "bucket int, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target / raw) per bucket in units of 1 / FIXED_POINT; the table has 2**BUCKET_BITS rows at most, whatever the corpus."""
    size = 1 << BUCKET_BITS
    found = counts.toArrow()
    raw, target = np.zeros(size), np.zeros(size)
    at = found.column("bucket").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * size)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * size)
    return np.rint(np.log(p / q) * FIXED_POINT).astype(np.int64)


def count_sides(rows: DataFrame) -> DataFrame:
    """hash of each n-gram, and the numbers of toxic and of clean documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columns.blocks(batches, "text"):
            is_toxic = np.array([x == "toxic" for x in block.column("side").to_pylist()], bool)
            tokens, first, pairs, pair_first = ngram_hashes(block.column("text"))
            for hashes, at in ((tokens, first), (pairs, pair_first)):
                doc = np.repeat(np.arange(block.num_rows), np.diff(at))
                order = np.lexsort((doc, hashes))
                hashes, doc = hashes[order], doc[order]
                once = np.ones(len(hashes), bool)
                once[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                found, which = np.unique(hashes[once], return_inverse=True)
                toxic = np.bincount(which, is_toxic[doc[once]], len(found)).astype(np.int64)
                clean = np.bincount(which, minlength=len(found)) - toxic
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(toxic), pa.array(clean)], ["hash", "toxic", "clean"])

    counted = rows.where("side IS NOT NULL").select("text", "side").mapInArrow(count, "hash long, toxic long, clean long")
    return counted.groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def toxic_weights(t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int, tries: int) -> np.ndarray:
    """Log ratio of the shares of toxic and clean documents; 0 unless it leans to toxic by more than chance would in as many tries."""
    share = (t + c) / (n_toxic + n_clean)

    def part(seen, of):
        parts = [(seen, share), (of - seen, 1 - share)]
        return sum(np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(p * of, 1e-300)), 0.0) for k, p in parts)

    # Twice this gain is chi-square with one degree of freedom, whose tail is below exp(-gain).
    beyond = (part(t, n_toxic) + part(c, n_clean) > np.log(max(tries, 1))) & (t * n_clean > c * n_toxic) & (t >= MIN_TOXIC)
    return np.where(beyond, np.maximum(np.log((t + 0.5) / (n_toxic + 1.0)) - np.log((c + 0.5) / (n_clean + 1.0)), 0.0), 0.0)


def heaviest(number: int, grams: tuple[np.ndarray, ...], words: Toxicity, near: np.ndarray) -> np.ndarray:
    """Per text the weight of its heaviest n-gram, 0 without any; `near` marks the buckets that hold weighted n-grams."""
    out = np.zeros(number)
    for hashes, at in (grams[:2], grams[2:]):
        hits = np.flatnonzero(near[bucket(hashes)])
        if len(hits):
            place = np.minimum(np.searchsorted(words.hashes, hashes[hits]), len(words.hashes) - 1)
            same = words.hashes[place] == hashes[hits]
            np.maximum.at(out, np.searchsorted(at, hits[same], "right") - 1, words.weights[place[same]])
    return out


def toxic_buckets(words: Toxicity) -> np.ndarray:
    near = np.zeros(1 << BUCKET_BITS, bool)
    near[bucket(words.hashes)] = True
    return near


def toxic_ratios(rows: DataFrame, words: Toxicity, keep: list[str]) -> DataFrame:
    """Carry the columns of `keep`; add toxic_ratio."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns.release_kept()
        near = toxic_buckets(sent.value)
        for block in columns.blocks(batches, "text"):
            found = heaviest(block.num_rows, ngram_hashes(block.column("text")), sent.value, near)
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], pa.array(found)], [*keep, "toxic_ratio"])

    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rate, rows.select(*keep).schema.add("toxic_ratio", "double"))


def toxic_level(held: list[tuple[str, float]]) -> float:
    """The level with the fewest errors of either kind; none if no level does better than chance."""
    found = np.array([m for s, m in held if s == "toxic"])
    clean = np.array([m for s, m in held if s == "clean"])
    if not len(found) or not len(clean):
        return np.inf
    level = best_level([("good", m) for m in found] + [("bad", m) for m in clean])
    return level if level > 0 and np.mean(found < level) + np.mean(clean >= level) < 1 else np.inf


def fit_toxicity(rows: DataFrame) -> Toxicity:
    """Weights and level from the rows of `rows` that have a side; all tables read here are of at most LABEL_LIMIT documents."""
    sizes = {r["side"]: r["count"] for r in rows.where("side IS NOT NULL").groupBy("side").count().collect()}
    n_toxic, n_clean = sizes.get("toxic", 0), sizes.get("clean", 0)
    if not n_toxic or not n_clean:
        return Toxicity(np.zeros(0, columns.U64), np.zeros(0))
    # An n-gram as frequent on the clean side never carries weight, not even without one of its clean documents.
    often = tables.keep(count_sides(rows).where(F.col("toxic") >= MIN_TOXIC), "quality-toxic")
    tries = often.count()
    found = often.where((F.col("clean") - 1) * n_toxic < F.col("toxic") * (n_clean - 1)).orderBy("hash").toArrow()
    hashes = found.column("hash").to_numpy().view(columns.U64)
    t, c = (found.column(k).to_numpy().astype(float) for k in ("toxic", "clean"))

    def words(weights: np.ndarray) -> Toxicity:
        order = np.argsort(hashes)
        order = order[weights[order] > 0]
        return Toxicity(hashes[order], weights[order])

    # Each labelled document is rated by the counts of the others.
    others = {"toxic": toxic_weights(t - 1, c, n_toxic - 1, n_clean, tries), "clean": toxic_weights(t, np.maximum(c - 1, 0), n_toxic, n_clean - 1, tries)}
    rated = [r for side, w in others.items() for r in toxic_ratios(rows.where(F.col("side") == side), words(w), ["side"]).collect()]
    level = toxic_level([(r["side"], r["toxic_ratio"]) for r in rated])
    return replace(words(toxic_weights(t, c, n_toxic, n_clean, tries)), level=level)


def mean_ratios(rows: DataFrame, log_ratio: np.ndarray, keep: list[str], score: str = "mean_ratio", size: str = "n_ngrams", words: Toxicity | None = None) -> DataFrame:
    """Carry the columns of `keep`; add the number of n-grams, their mean log ratio (null without any) and with `words` toxic_ratio."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(log_ratio)
    sent_words = spark.sparkContext.broadcast(words)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns.release_kept()
        near = toxic_buckets(sent_words.value) if sent_words.value else None
        for block in columns.blocks(batches, "text"):
            grams = ngram_hashes(block.column("text"))
            total = np.zeros(block.num_rows, np.int64)
            number = np.zeros(block.num_rows, np.int64)
            for hashes, at in (grams[:2], grams[2:]):
                sums = np.concatenate(([0], np.cumsum(sent.value[bucket(hashes)])))
                total += sums[at[1:]] - sums[at[:-1]]
                number += np.diff(at)
            mean = pa.array(total / (np.maximum(number, 1) * float(FIXED_POINT)), mask=number == 0)
            made = {size: pa.array(number), score: mean}
            if near is not None:
                made["toxic_ratio"] = pa.array(heaviest(block.num_rows, grams, sent_words.value, near))
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], *made.values()], [*keep, *made])

    schema = rows.select(*keep).schema.add(size, "long").add(score, "double")
    if words is not None:
        schema = schema.add("toxic_ratio", "double")
    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rate, schema)


def best_level(held: list[tuple[str, float]]) -> float:
    """The level between held-back good and bad documents with the fewest errors of either kind, in the middle of the gap."""
    good = np.sort([m for r, m in held if r == "good" and m is not None])
    bad = np.sort([m for r, m in held if r == "bad" and m is not None])
    if not len(bad) or not len(good):
        return -np.inf
    marks = np.unique(np.concatenate((good, bad)))
    cuts = np.concatenate(([marks[0] - 1], (marks[1:] + marks[:-1]) / 2, [marks[-1] + 1]))
    lost = np.searchsorted(good, cuts) / len(good)
    passed = 1 - np.searchsorted(bad, cuts) / len(bad)
    worst = lost + passed
    best = np.flatnonzero(worst <= worst.min() + 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def log_weight(mean, level: float):
    """Scaled distance from the level; an empty text has none."""
    return F.lit(0.0) + F.when(mean.isNotNull(), 0.0) if np.isinf(level) else F.lit(SHARPNESS) * (mean - F.lit(level))


def gumbel_key(weight, doc_id):
    uniform = ((F.xxhash64(doc_id, F.lit(SEED + 2)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")) + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(uniform))


def classify(docs: DataFrame, labels: DataFrame, limit: int = LABEL_LIMIT) -> tuple[DataFrame, Model, float]:
    """Scores of every document (doc_id, n_ngrams, mean_ratio, log_weight, sample_key, accepted, toxic_ratio, toxic, kept), the model and the cut of the keys."""
    rows = with_roles(docs, label_sample(labels, limit))
    ratios = log_ratios(count_ngrams(rows))
    # The labelled documents are kept apart, so that fitting does not read all texts again.
    toxicity = fit_toxicity(tables.keep(rows.where("side IS NOT NULL").select("side", "text"), "quality-sides"))
    scored = tables.keep(mean_ratios(rows, ratios, ["doc_id", "role"], words=toxicity), "quality-scores")
    held = [(r["role"], r["mean_ratio"]) for r in scored.where("role IN ('good', 'bad')").select("role", "mean_ratio").collect()]  # at most `limit` labelled documents
    model = Model(ratios, best_level(held), toxicity)
    weighed = scored.withColumn("log_weight", log_weight(F.col("mean_ratio"), model.level)).withColumn("sample_key", gumbel_key(F.col("log_weight"), F.col("doc_id")))
    drawn = weighed.where("sample_key IS NOT NULL")
    wanted = round(drawn.agg(F.sum(F.exp(F.least(F.col("log_weight"), F.lit(0.0))))).first()[0] or 0.0)
    cut = np.inf
    if wanted:
        ranked = tables.running_total(drawn.select("sample_key", F.lit(1).cast("long").alias("_one")), [F.col("sample_key").desc()], {"_rank": "_one"}, "quality-keys")
        cut = ranked.where(F.col("_rank") == wanted - 1).first()["sample_key"]
    accepted = F.coalesce(F.col("sample_key") >= F.lit(float(cut)), F.lit(False))
    toxic = F.col("toxic_ratio") >= F.lit(toxicity.level)
    scores = weighed.withColumn("accepted", accepted).withColumn("toxic", toxic).withColumn("kept", F.col("accepted") & ~F.col("toxic"))
    return scores.select("doc_id", "n_ngrams", "mean_ratio", "log_weight", "sample_key", "accepted", "toxic_ratio", "toxic", "kept"), model, float(cut)


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that quality accepts and that are not toxic, with all their columns: every text is rated where it lies, and nothing is joined or shuffled."""
    _, model, cut = classify(docs, labels)
    packed = tables.pack(docs, ["doc_id", "text"])
    rated = mean_ratios(packed, model.log_ratio, packed.columns, words=model.toxicity)
    key = gumbel_key(log_weight(F.col("mean_ratio"), model.level), F.col("doc_id"))
    return rated.where((key >= F.lit(cut)) & (F.col("toxic_ratio") < F.lit(model.toxicity.level))).select(*tables.unpack(packed, docs))
