"""Text quality statistics and text types (problem 9).

The statistics of each document are counted over the whole text. Each
threshold on a statistic is a noisy labelling function: it votes for a form or
abstains. Expectation-maximization over the agreements of the votes learns, per
function, how often it votes what under each form, and gives each document the
posterior over the forms; documents with the same votes count once, weighted.

Defined results: null, empty and blank texts have statistics of zero and form
"empty", and no row in p9_found. Repeated rows are kept with their own key.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.tables import checkpoint, spread, table

FORMS = ("prose", "list", "table", "junk")

# Common function words of the languages served.
COMMON_WORDS = (
    "the a an and or of to in on at for with by from as is are was were be been that this these those it its our their his her your my we you he she they not no if when before after while who why which one another every"
    " el la los las un una de del que y en con por para se su al antes lo como sin"
    " der die das den dem ein eine einer und mit von zu im am nicht wie vor nach für auf ist wird werden"
    " le les des et est une dans pour sur"
)
# Frequent words of a language written without blanks.
THAI_WORDS = "ที่ และ การ ของ ใน เป็น ให้ ไม่ ได้ มี จาก ตาม ก่อน หลัง เพราะ โดย"
# Words of site menus.
MENU_WORDS = "home menu login logout search share print next prev cart privacy help contact about cookie settings accept sitemap register subscribe back top"

COMMON = frozenset(COMMON_WORDS.split())
MENU = frozenset(MENU_WORDS.split())
WORDS = re.compile(r"[^\W\d_\u0E00-\u0E7F]+|[\u0E00-\u0E7F]+")
DIGITS = re.compile(r"\d+")

#: Counts of matches, by the linear-time expressions of Arrow's string kernels.
MATCHES = {
    "n_tokens": r"\S+",
    "n_long": r"[^\s\x{0E00}-\x{0E7F}]{41}[^\s\x{0E00}-\x{0E7F}]*",
    "n_lines": r"(?m)^.*\S.*$",
    "n_closed": r"(?m)[.!?…][)\]}\x{2019}\x{201D}»\"']*[ \t]*\r?$",
    "n_stops": r"[.!?…](?:\s|$)",
    "n_commas": r"[,;]\s",
    "n_marked": r"(?m)^\s*(?:[-*•·–]|\d{1,3}[.)]|[a-z][.)]|\[[ xX]?\])[ \t]+\S",
    "n_inline": r"(?:^|[\s])(?:[a-z]\)|\d{1,2}\)|\[[ xX]?\]) \S",
    "n_short": r"(?m)^[ \t]*\S+(?:[ \t]\S+){0,11}[ \t]*\r?$",
    "n_celled": r"(?m)^(?:[^\n]*?(?:\t|\||;|,[^ \n]|,$|  )){2}[^\n]*$",
    "n_labelled": r"(?m)^[^\n:=.\t]{2,20}(?:[ \t]*[:=][ \t]+|\t| ?\.{2,} ?)\S[^\n]{0,40}$",
    "n_tabbed": r"(?m)^\t\S[^\t\n]*$",
    "n_broken": r"[ÂÃàâ][\x{0080}-\x{00BF}\x{2013}-\x{203A}€\x{FFFD}]|\x{FFFD}|à¸|à¹",
}
LOW_MATCHES = {
    "n_clusters": r"[bcdfghjklmnpqrstvwxz]{5,}|[jqvxz][bcdfgjkmpqtvwxz]|[bcdfghjklmnpqrstvwxyz]q",
    "n_keys": r"asdf|fdsa|qwer|zxcv|hjkl|lkjh|uiop|jkl;",
}
#: Counts of characters: what is left after dropping the others.
KEPT = {
    "n_visible": r"\s+",
    "n_letters": r"[^\p{L}\p{M}]+",
    "n_digits": r"[^\p{Nd}]+",
    "n_thai": r"[^\x{0E00}-\x{0E7F}]+",
    "n_unmarked": r"<[^<>]{1,200}>|&#?\w{2,8};",
}
OWN = ("n_words", "n_distinct", "n_common", "n_menu", "n_doubled", "n_line_kinds")
COUNTS = ("n_chars", *MATCHES, *LOW_MATCHES, *KEPT, "n_thai_common", *OWN)


def word_counts(text: str) -> tuple[int, ...]:
    """Words, different words, common words, menu words, words repeated at once, and different lines without their digits."""
    words = WORDS.findall(text)
    lines = {x.strip() for x in DIGITS.sub("", text).split("\n")}
    lines.discard("")
    return (len(words), len(set(words)), sum(map(COMMON.__contains__, words)), sum(map(MENU.__contains__, words)), sum(map(eq, words, words[1:])), len(lines))


def statistics(frame: DataFrame, key: str, column: str) -> DataFrame:
    """Counts and shares of each text, over the whole of it."""
    schema = T.StructType([frame.schema[key], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            low = pc.utf8_lower(text)
            found = [pc.utf8_length(text)]
            found += [pc.count_substring_regex(text, pattern=p) for p in MATCHES.values()]
            found += [pc.count_substring_regex(low, pattern=p) for p in LOW_MATCHES.values()]
            found += [pc.utf8_length(pc.replace_substring_regex(text, pattern=p, replacement="")) for p in KEPT.values()]
            found.append(pc.count_substring_regex(text, pattern="|".join(THAI_WORDS.split())))
            own = [word_counts(t) for t in low.to_pylist()]
            found += [pa.array([r[i] for r in own], pa.int64()) for i in range(len(OWN))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pc.cast(f, pa.int64()) for f in found]], names=schema.names)

    counted = spread(frame.select(key, column)).mapInArrow(run, schema)
    return counted.select(key, *COUNTS, *[c.alias(n) for n, c in shares().items()])


def shares() -> dict[str, Column]:
    """Shares of the counts, zero where there is nothing to share."""

    def part(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "mean_word_length": part("n_letters", "n_words"),
        "symbol_share": F.when(F.col("n_visible") > 0, (F.col("n_visible") - F.col("n_letters") - F.col("n_digits")) / F.col("n_visible")).otherwise(F.lit(0.0)),
        "digit_share": part("n_digits", "n_visible"),
        "letter_share": part("n_letters", "n_visible"),
        "closed_share": part("n_closed", "n_lines"),
        "words_per_line": part("n_words", "n_lines"),
        "marked_share": part("n_marked", "n_lines"),
        "short_share": part("n_short", "n_lines"),
        "celled_share": part("n_celled", "n_lines"),
        "labelled_share": part("n_labelled", "n_lines"),
        "tabbed_share": part("n_tabbed", "n_lines"),
        "comma_rate": part("n_commas", "n_words"),
        "stop_rate": part("n_stops", "n_words"),
        "common_share": part("n_common", "n_words"),
        "thai_share": part("n_thai", "n_visible"),
        "menu_share": part("n_menu", "n_words"),
        "markup_share": F.when(F.col("n_chars") > 0, 1 - F.col("n_unmarked") / F.col("n_chars")).otherwise(F.lit(0.0)),
        "broken_rate": part("n_broken", "n_visible"),
        "cluster_rate": part("n_clusters", "n_words"),
        "key_rate": part("n_keys", "n_tokens"),
        "variety": F.when(F.col("n_words") > 0, F.col("n_distinct") / F.pow(F.col("n_words").cast("double"), F.lit(0.75))).otherwise(F.lit(0.0)),
        "line_variety": part("n_line_kinds", "n_lines"),
        "doubled_rate": part("n_doubled", "n_words"),
    }


#: The labelling functions: the form voted for and the condition on the statistics.
LABELLERS: list[tuple[str, str]] = [
    ("table", "celled_share >= 0.6 and n_lines >= 2 and letter_share + digit_share >= 0.55"),
    ("table", "labelled_share >= 0.6 and n_lines >= 3"),
    ("table", "digit_share >= 0.15 and stop_rate < 0.02 and celled_share + labelled_share >= 0.3"),
    ("table", "digit_share + symbol_share >= 0.3 and letter_share + digit_share >= 0.55 and celled_share + labelled_share >= 0.5"),
    ("table", "celled_share >= 0.8 and n_lines >= 3 and letter_share + digit_share >= 0.5"),
    ("table", "labelled_share >= 0.8 and n_lines >= 4"),
    ("table", "labelled_share >= 0.5 and n_lines >= 3 and stop_rate < 0.02"),
    ("list", "(marked_share >= 0.6 and n_lines >= 3 and words_per_line < 12) or (n_inline >= 3 and comma_rate >= 0.08)"),
    ("list", "tabbed_share >= 0.6 and n_lines >= 3"),
    ("list", "short_share >= 0.8 and n_lines >= 3 and words_per_line <= 7 and celled_share < 0.3 and labelled_share < 0.3 and common_share < 0.3 and line_variety > 0.4 and letter_share > 0.6 and n_chars < 60 * n_lines or (comma_rate >= 0.15 and n_lines <= 2 and n_commas >= 3 and common_share < 0.3 and letter_share > 0.6)"),
    ("list", "comma_rate >= 0.15 and n_lines <= 2 and n_commas >= 3 and letter_share > 0.6"),
    ("list", "n_inline >= 3 and comma_rate >= 0.08"),
    ("prose", "common_share >= 0.25 or (thai_share >= 0.4 and n_thai_common >= 2 and n_chars >= 40 * n_lines)"),
    ("prose", "stop_rate >= 0.03 and stop_rate <= 0.15 and n_lines <= n_stops * 6 or (thai_share >= 0.4 and n_chars >= 40 * n_lines)"),
    ("prose", "(words_per_line >= 12 or (thai_share >= 0.4 and n_chars >= 40 * n_lines)) and letter_share >= 0.9"),
    ("prose", "thai_share >= 0.5 and n_chars / n_lines >= 30"),
    ("prose", "(closed_share >= 0.4 or (thai_share >= 0.4 and n_chars >= 40 * n_lines)) and symbol_share <= 0.08"),
    ("prose", "symbol_share <= 0.04 and digit_share <= 0.03 and letter_share > 0.9"),
    ("junk", "markup_share >= 0.3"),
    ("junk", "broken_rate >= 0.006"),
    ("junk", "n_broken >= 2 and broken_rate >= 0.003"),
    ("junk", "n_broken >= 3"),
    ("junk", "cluster_rate >= 0.2"),
    ("junk", "key_rate >= 0.5"),
    ("junk", "menu_share >= 0.5 and n_words >= 4"),
    ("junk", "letter_share < 0.4 and (celled_share < 0.3 and labelled_share < 0.3 or letter_share + digit_share < 0.55)"),
    ("junk", "line_variety <= 0.4 and n_lines >= 4 and celled_share < 0.5 and labelled_share < 0.5"),
    ("junk", "variety < 1.15 and n_words >= 10 and stop_rate < 0.02 and celled_share < 0.5 and labelled_share < 0.5"),
    ("junk", "doubled_rate >= 0.03 and stop_rate < 0.02"),
    ("junk", "n_long > 0 and n_long * 3 >= n_tokens"),
    ("junk", "mean_word_length > 14 and thai_share < 0.3"),
    ("junk", "common_share < 0.05 and thai_share < 0.3 and n_words >= 12 and words_per_line >= 12 and comma_rate < 0.15"),
]

ROUNDS = 15


def votes(stats: DataFrame) -> DataFrame:
    """The statistics with `mask`: bit i is set where labelling function i votes."""
    terms = [F.when(F.expr(rule), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, (_, rule) in enumerate(LABELLERS)]
    return stats.withColumn("mask", reduce(lambda a, b: a + b, terms))


OWNERS = np.array([FORMS.index(f) for f, _ in LABELLERS])


def fired(masks: np.ndarray) -> np.ndarray:
    """The votes as a matrix of zeros and ones, a row per mask."""
    return ((masks[:, None] >> np.arange(len(LABELLERS))) & 1).astype(float)


def posterior(masks: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The posterior of each form by the learned model; by squared vote shares where there is none yet."""
    votes_ = fired(masks)
    if model is None:
        scores = np.stack([votes_[:, OWNERS == k].sum(1) for k in range(len(FORMS))], 1) + 0.1
        scores = scores**2
    else:
        prior, rates = model
        logs = np.log(prior) + votes_ @ np.log(rates).T + (1 - votes_) @ np.log1p(-rates).T
        scores = np.exp(logs - logs.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def learn(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Prior and voting rates of each form, by expectation-maximization over the distinct vote patterns.

    `patterns` (mask, n and, where known, a form `label` with its weight `known`) has a row per pattern that
    occurs. Each task sums its patterns and only these sums, one row of fixed length per task, come to the
    driver. Labelled documents keep their form, so that the classes can't change places; the agreements of
    the votes on all documents give the rates.
    """
    model = None
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            weight, hits = np.zeros(len(FORMS)), np.zeros((len(FORMS), len(LABELLERS)))
            for batch in batches:
                masks = batch.column(0).to_numpy(zero_copy_only=False)
                share = posterior(masks, model) * batch.column(1).to_numpy(zero_copy_only=False)[:, None]
                label = batch.column(2).to_pylist()
                known = batch.column(3).to_numpy(zero_copy_only=False)
                for k, f in enumerate(FORMS):
                    share[:, k] += known * np.array([x == f for x in label])
                weight += share.sum(0)
                hits += share.T @ fired(masks)
            yield pa.RecordBatch.from_arrays([pa.array([[*weight, *hits.ravel()]], pa.list_(pa.float64()))], names=["s"])

        total = np.zeros(len(FORMS) * (1 + len(LABELLERS)))
        for row in patterns.select("mask", "n", "label", "known").mapInArrow(sums, "s array<double>").toLocalIterator():
            total += np.array(row.s)
        weight, hits = total[: len(FORMS)], total[len(FORMS) :].reshape(len(FORMS), -1)
        # A pseudo-count keeps rates off 0 and 1 and each function better than chance for its own form.
        own = OWNERS[None, :] == np.arange(len(FORMS))[:, None]
        model = (weight + 1) / (weight.sum() + len(FORMS)), (hits + np.where(own, 2.0, 0.05)) / (weight[:, None] + 4)
    return model


#: Labelled rows that anchor the classes, at most; and how much a labelled document counts against one without label.
LABELLED_ROWS = 20_000
LABEL_WEIGHT = 5.0


def vote_patterns(voting: DataFrame, key: str, labels: DataFrame | None) -> DataFrame:
    """Each vote pattern with its number of documents, and each labelled pattern with its weight."""
    readable = voting.filter("n_visible > 0").select(key, "mask")
    rows = readable.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).select("mask", "n", F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("known"))
    if labels is None:
        return rows
    # Of more labels than the bound those with the smallest hashes are taken, the same ones in every run.
    known = labels.filter(F.col("form").isin(*FORMS)).select(key, F.col("form").alias("label")).distinct()
    some = known.orderBy(F.xxhash64(key), key, "label").limit(LABELLED_ROWS)
    seen = readable.join(some, key).groupBy("mask", "label").agg((F.count(F.lit(1)) * LABEL_WEIGHT).alias("known"))
    return rows.unionByName(seen.select("mask", F.lit(0).cast("bigint").alias("n"), "label", "known"))


def text_types(frame: DataFrame, key: str, column: str, labels: DataFrame | None = None) -> DataFrame:
    """`key`, the statistics, the posterior of each form and the likeliest form of each text.

    `labels` (key, form) may name the form of some documents. The counts, not the texts, are written once and read twice.
    """
    voting = votes(checkpoint(statistics(frame, key, column)))
    model = learn(checkpoint(vote_patterns(voting, key, labels)))

    @F.pandas_udf(T.StructType([T.StructField(f"p_{f}", T.DoubleType()) for f in FORMS]))
    def score(masks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(posterior(masks.to_numpy(), model), columns=[f"p_{f}" for f in FORMS])

    scored = voting.withColumn("scores", score("mask")).select("*", "scores.*").drop("scores")
    top = F.greatest(*[F.col(f"p_{f}") for f in FORMS])
    form = F.when(F.col("n_visible") == 0, "empty")
    for f in FORMS:
        form = form.when(F.col(f"p_{f}") == top, f)
    return scored.withColumn("form", form).drop("mask")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and form of each document that is mainly not running prose."""
    rows = text_types(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "form_labels"))
    return rows.filter(F.col("form").isin("list", "table", "junk")).select("doc_id", "form").distinct()


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document with the posterior of each form."""
    return text_types(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "form_labels"))
