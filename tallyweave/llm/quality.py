"""Learned quality rules as ordered Spark conditional expressions (operator 3).

Statistics of a text are columns built from Spark's own functions. A decision list is learnt
by sequential covering, as in RIPPER (Cohen, 1995): a rule grows by the threshold test with
the largest information gain, is pruned on rows held back, and covers its rows; the next
rule sees what is left. The list is emitted as one chain of ``when`` expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, own_columns

# What separates words, and which characters count as symbols.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

WINDOW = 5
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "distinct_ratio")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and wherever the optimiser moves it."""
    return F.transform(F.array(value), body)[0]


def _window_hashes(words: Column) -> Column:
    """64-bit hashes of all windows of WINDOW words."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))
    return F.when(F.size(words) > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))  # a single window can't repeat


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash repeats: equal hashes become neighbours, then their positions are covered in order."""
    zero = F.lit(0).cast("long")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    starts = lambda p: F.sort_array(F.transform(F.filter(p, lambda x, j: same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1))), lambda x: x["i"]))
    covered = lambda s: F.aggregate(
        s,
        F.struct(zero.alias("n"), zero.alias("to")),
        lambda a, i: F.struct((a["n"] + (i + WINDOW) - F.greatest(i.cast("long"), a["to"])).alias("n"), (i + WINDOW).cast("long").alias("to")),
    )["n"]
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, lambda p: covered(starts(p)))).otherwise(zero)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct."""
    removed = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    words = F.array_remove(F.split(text, BLANKS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\u000b\f\r", "")) > 0)
    return let(
        words,
        lambda w: let(
            lines,
            lambda line: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                removed(SYMBOLS).alias("n_symbols"),
                (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
                let(_window_hashes(w), _repeat_words).alias("n_repeat_words"),
                F.size(line).cast("long").alias("lines"),
                F.size(F.array_distinct(w)).cast("long").alias("distinct"),
                removed("[A-Z]+").alias("upper"),
                removed("[0-9]+").alias("digits"),
                removed("[!?]+").alias("marks"),
            ),
        ),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios in ``FEATURES``.

    A null text has no words. Input columns of these names are replaced. Repeated windows
    are found by sorting their 64-bit hashes within the row.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    x = docs.drop("tallyweave_q", *counts, *FEATURES)
    x = x.withColumn("tallyweave_q", let(F.coalesce(F.col("text").cast("string"), F.lit("")), _counts))
    words, chars = F.greatest(F.col("tallyweave_q.n_words"), F.lit(1)), F.greatest(F.col("tallyweave_q.word_chars"), F.lit(1))
    ratios = {
        "mean_word": F.col("tallyweave_q.word_chars") / words,
        "symbol_ratio": F.col("tallyweave_q.n_symbols") / words,
        "dup_line_ratio": F.col("tallyweave_q.n_dup_lines") / F.greatest(F.col("tallyweave_q.lines"), F.lit(1)),
        "repeat_ratio": F.col("tallyweave_q.n_repeat_words") / words,
        "upper_ratio": F.col("tallyweave_q.upper") / chars,
        "digit_ratio": F.col("tallyweave_q.digits") / chars,
        "mark_ratio": F.col("tallyweave_q.marks") / words,
        "distinct_ratio": F.col("tallyweave_q.distinct") / words,
    }
    return x.withColumns({c: F.col(f"tallyweave_q.{c}") for c in counts} | ratios).drop("tallyweave_q")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


Test = tuple[str, str, float]  # (feature, "<=" or ">", threshold)


def _holds(row: dict, tests: list[Test]) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in tests)


def _thresholds(rows: list[dict], feature: str, most: int) -> list[float]:
    """Midpoints between neighbouring values, at most ``most`` of them, at even ranks."""
    values = sorted({r[feature] for r in rows})
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return cuts if len(cuts) <= most else [cuts[len(cuts) * k // most] for k in range(most)]


def _grow(rows: list[dict], target: int, max_tests: int, most_cuts: int) -> list[Test]:
    tests: list[Test] = []
    p0, n0 = sum(r["label"] == target for r in rows), sum(r["label"] != target for r in rows)
    while n0 and p0 and len(tests) < max_tests:
        best, gain = None, 1e-9
        before = math.log2(p0 / (p0 + n0))
        for f in FEATURES:
            ordered = sorted(rows, key=lambda r: r[f])
            cuts, i, p = _thresholds(rows, f, most_cuts), 0, 0
            for cut in cuts:
                while i < len(ordered) and ordered[i][f] <= cut:
                    p += ordered[i]["label"] == target
                    i += 1
                for op, pp, nn in (("<=", p, i - p), (">", p0 - p, len(ordered) - i - (p0 - p))):
                    if pp and (g := pp * (math.log2(pp / (pp + nn)) - before)) > gain:
                        best, gain = (f, op, cut), g
        if best is None:
            break
        tests.append(best)
        rows = [r for r in rows if _holds(r, [best])]
        p0, n0 = sum(r["label"] == target for r in rows), sum(r["label"] != target for r in rows)
    return tests


def _worth(rows: list[dict], tests: list[Test], target: int) -> float:
    hit = [r for r in rows if _holds(r, tests)]
    p = sum(r["label"] == target for r in hit)
    return (2 * p - len(hit)) / len(hit) if hit else -1.0


def learn(rows: list[dict], target: int = 0, max_rules: int = 12, max_tests: int = 4, most_cuts: int = 64, precision: float = 0.9) -> list[list[Test]]:
    """Ordered rules for label ``target``; a row that none covers has the other label.

    ``rows`` hold FEATURES and label. A third of them, by their place in the list, prunes. A
    rule that is right on less than ``precision`` of all rows that it still covers ends the list.
    """
    rules: list[list[Test]] = []
    rest = list(rows)
    for _ in range(max_rules):
        grow, prune = [r for i, r in enumerate(rest) if i % 3], rest[::3]
        if sum(r["label"] == target for r in grow) < 3:
            break
        tests = _grow(grow, target, max_tests, most_cuts)
        worth = _worth(prune, tests, target)
        while len(tests) > 1 and (shorter := _worth(prune, tests[:-1], target)) >= worth:
            tests, worth = tests[:-1], shorter
        hit = [r for r in rest if _holds(r, tests)]
        right = sum(r["label"] == target for r in hit)
        if not tests or right < 3 or right < precision * len(hit):
            break
        rules.append(tests)
        rest = [r for r in rest if not _holds(r, tests)]
    return rules


def as_expression(rules: list[list[Test]], target: int = 0) -> Column:
    """The decision list as ordered conditional expressions: the predicted label."""
    test = lambda t: F.col(t[0]) <= F.lit(t[2]) if t[1] == "<=" else F.col(t[0]) > F.lit(t[2])
    out = None
    for tests in rules:
        condition = reduce(lambda a, b: a & b, map(test, tests))
        out = F.when(condition, target) if out is None else out.when(condition, target)
    return F.lit(1 - target) if out is None else out.otherwise(1 - target)


def describe(rules: list[list[Test]], target: int = 0) -> list[str]:
    """The rules as text."""
    return [" and ".join(f"{f} {op} {t:.6g}" for f, op, t in tests) + f" -> {target}" for tests in rules] + [f"else -> {1 - target}"]


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> list[dict]:
    """Statistics and quality label of at most ``sample_rows`` labelled documents: those with the smallest hashes of their ids.

    The ids are picked from ``labels`` first, so only their texts are measured. Of rows that
    repeat a doc_id the text with the smallest hash is learnt from, of labels that repeat one
    the smallest. Documents that fail the base test are left out: they never reach the list.
    """
    picked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    own = docs.select(F.col("doc_id").cast("long"), "text")
    # at most sample_rows pairs of numbers
    stats = statistics(own.join(F.broadcast(picked), "doc_id")).withColumn("failed", base_failed())
    one = stats.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "label", "failed", *FEATURES)).alias("s"))
    rows = [r.asDict() for r in one.select("doc_id", "s.label", "s.failed", *[f"s.{f}" for f in FEATURES]).collect()]
    return sorted((r for r in rows if not r["failed"]), key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], tuple(r[f] for f in FEATURES)))


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """``docs`` with their statistics, base_failed and kept: not failed and not predicted to be of label 0.

    A null or empty text has no words and fails; rows are judged each by its own text, also
    where they repeat an id; texts of any length are read whole, and an empty table gives none.
    """
    stats = statistics(docs.drop("base_failed", "kept"))
    judged = stats.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (as_expression(rules) == 1))


def keep_good(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever the names: they travel in a struct of their own."""
    own = docs.select("text", F.struct(*own_columns(docs)).alias(OWN))
    return judge(own, rules).where("kept").select(f"{OWN}.*")


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> list[list[Test]]:
    """The decision list for low quality, learnt from labelled documents. Without labels it is empty and keeps all."""
    return learn(labelled_statistics(docs, labels, sample_rows))
