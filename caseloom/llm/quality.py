"""Quality rules: hashed n-gram log-likelihood ratio, DataFrame functions only.

Word n-grams are hashed to a fixed number of buckets.  Two multinomials over
the buckets, one of the whole corpus and one of trusted documents, give each
bucket a weight log p(trusted) - log p(corpus); a document's score is the mean
weight of its n-grams.  Weights are fixed-point integers, so a score does not
depend on the order of summation and the threshold decides the same way every
time.

The corpus and the trusted documents are both counted whole, with partial sums
before a shuffle of at most ``buckets`` rows a task.  The trusted side is fitted
in two halves by the parity of the ids' hashes, and a document is scored with the
half that does not hold it, so trusted documents score as others do.  The
threshold is the least of all trusted documents' own scores, at every size of
corpus: what scores below every trusted document is rejected, so none of them is
lost, and one that is trusted by mistake can lower the threshold.

Trusted documents are found by a join on their ids.  A filter of bounded size
(``FILTER_BITS``) is broadcast first, so that few other texts are shuffled; their
buckets are stored, and counted and scored from there.

Repeated windows of three words are found by 64-bit hashes of their words.

Nulls and edge cases: a null text has no words, fails the base rules and scores
0; without trusted documents (that pass the base rules) the threshold is
``THRESHOLD``, without any all weights are 0; a null id is never trusted;
trusted ids are taken in the type of the documents' ids; repeated rows are judged alike, each counted; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table
from .ngram_join import FILTER_BITS, filter_words

BUCKETS = 1 << 14
#: Where no trusted document passes the base rules.
THRESHOLD = -0.08
_UNIT = 1 << 20

# Fixed values of the base rules.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def bucket_array(words: Column, buckets: int) -> Column:
    """Buckets of all words and all pairs of neighbours."""
    slot = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: slot(a, b),
    )
    return F.concat(F.transform(words, lambda w: slot(w)), F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<int>")))


@dataclass(frozen=True)
class Model:
    """Fixed-point bucket weights for documents of even and of odd parity, and the threshold."""

    even: list[int]
    odd: list[int]
    threshold: float = THRESHOLD


def _parity(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(2))


def _base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def _mean(total: Column, n_grams: Column) -> Column:
    """The score of a document whose n-grams' weights sum up to ``total``."""
    return total / (F.greatest(n_grams, F.lit(1)).cast("double") * _UNIT)


def _total(buckets: Column, weight: Column) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.get(weight, b))


def _weight(model: Model, parity: Column) -> Column:
    # Literals of fixed size, folded once when the query is planned.
    literal = lambda own: F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>")
    return F.when(parity == 0, literal(model.even)).otherwise(literal(model.odd))


def _repeated(words: Column) -> Column:
    """Words in windows of three that stand in the text twice or more."""

    def windows(words: Column) -> Column:
        """64-bit names of all three words in a row."""
        n = F.greatest(F.size(words) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(words, F.lit(3), n), lambda ab, c: F.xxhash64(ab, c))

    def covered(own: Column) -> Column:
        # Windows sorted with their places: equal ones are neighbours.
        placed = F.sort_array(F.transform(own, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
        places = _let(placed, lambda s: F.transform(same(s), lambda x: x["i"]))
        every = lambda at: F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))
        return _let(places, lambda at: F.size(F.array_distinct(every(at))))

    return _let(windows(words), lambda t: F.when(F.size(t) > F.size(F.array_distinct(t)), covered(t)).otherwise(0))


def _trusted_rows(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``parity, buckets, base_failed`` of every trusted document, stored."""
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).try_cast(docs.schema[id_col].dataType).alias("trusted_id"))
    ids = table(ids.where("trusted_id is not null").distinct(), "trusted-ids")
    words = filter_words(ids.select(F.xxhash64("trusted_id").alias("h")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    at = F.xxhash64("id").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr("shiftright(bits, cast(xxhash64(id) & 63 as int)) & 1L")
    likely = rows.join(F.broadcast(words), F.floor(at / 64).cast("int") == F.col("word")).where(bit == 1)  # bounded by the filter's size
    # Ids are distinct, so this is a semi join; as one it would be moved below the filter, to every text.
    found = likely.join(ids, F.col("id") == F.col("trusted_id")).select(
        _parity(F.col("id")).alias("parity"),
        _let(
            words_of(F.col("text")),
            lambda w: F.struct(bucket_array(w, buckets).alias("buckets"), _base_failed(F.size(w), _repeated(w)).alias("base_failed")),
        ).alias("v"),
    )
    return table(found.select("parity", "v.*"), "trusted-documents")


def fit(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> Model:
    """The model of a corpus.  ``trusted_ids``: one column of ids."""
    trusted = _trusted_rows(docs, trusted_ids, id_col, text_col, buckets)
    every = docs.select(F.lit(None).cast("long").alias("parity"), F.explode(bucket_array(words_of(F.col(text_col)), buckets)).alias("bucket"))
    counts = (
        every.unionByName(trusted.select("parity", F.explode("buckets").alias("bucket")))
        .groupBy("bucket")
        .agg(
            F.count(F.when(F.col("parity").isNull(), 1)).alias("n"),
            *(F.count(F.when(F.col("parity") == k, 1)).alias(f"t{k}") for k in (0, 1)),
        )
        .collect()  # at most ``buckets`` rows
    )
    n = [0] * buckets
    t = ([0] * buckets, [0] * buckets)
    for r in counts:
        n[r.bucket], t[0][r.bucket], t[1][r.bucket] = r.n, r.t0, r.t1
    raw = sum(n) + buckets
    share = [(c + 1) / raw for c in n]

    def weights(own: list[int]) -> list[int]:
        # The trusted side leans on the corpus with the weight of one n-gram a bucket.
        total = sum(own)
        return [round(_UNIT * math.log((own[k] + buckets * share[k]) / (total + buckets) / share[k])) if total else 0 for k in range(buckets)]

    made = Model(weights(t[1]), weights(t[0]))
    total = _let(_weight(made, F.col("parity")), lambda w: _total(F.col("buckets"), w))
    least = trusted.where("not base_failed").agg(F.min(_mean(total, F.size("buckets")))).first()[0]
    return made if least is None else replace(made, threshold=least)


def _verdict(text: Column, key: Column, model: Model) -> Column:
    """A struct of features, score and verdict.

    Each step is bound to a lambda variable: it is computed once a row, and a
    filter on the verdict cannot make the planner repeat it.
    """
    buckets = len(model.even)
    weight = _weight(model, _parity(key))
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def judged(words: Column) -> Column:
        n = F.size(words)
        total = _let(weight, lambda w: _total(bucket_array(words, buckets), w))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            _mean(total, 2 * n - 1).alias("score"),
        )

    def ruled(f: Column) -> Column:
        failed = _base_failed(f["n_words"], f["n_repeat_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
        return F.struct(
            *(f[x].alias(x) for x in names), failed.alias("base_failed"), (~failed & (f["score"] >= model.threshold)).alias("kept")
        )

    return _let(_let(words_of(text), judged), ruled)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features, score and verdict of every document; no shuffle."""
    return docs.select(id_col, _verdict(F.col(text_col), F.col(id_col), model).alias("__v")).select(id_col, "__v.*")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids labelled as good and not toxic by every label they have."""
    return (
        labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select("doc_id")
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, trusted_documents(labels)))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept rows, with the columns that came in."""
    model = fit(docs, trusted_documents(labels))
    return docs.where(_verdict(F.col("text"), F.col("doc_id"), model)["kept"])
