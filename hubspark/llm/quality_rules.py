"""Quality rules: base statistics and a learned decision list, as Spark expressions only.

The list is learned by sequential covering from labelled statistics: a rule is
grown by the threshold test of most information gain (FOIL) until it covers no
good document of the growing part, then pruned on the other part; what it
covers is removed and the next rule is grown. The result is an ordered
``CASE WHEN`` over columns. Scoring runs in the JVM; only the bounded table of
labelled statistics comes to the driver for learning.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import SPACE_WORDS, grams, hashes, let, words

#: Labelled rows used for learning (the first in the order of a hash of their id): the documented bound.
MAX_LABELLED = 4000
REPEAT = 8
FEATURES = ("word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "distinct_rate", "mark_rate", "digit_rate", "line_words")


def _n_repeat_words(h: Column, k: int) -> Column:
    """Words inside windows of ``k`` that occur twice or more, from the words' hashes."""

    def covered(s: Column) -> Column:
        # s: (hash, place) in order; a place counts if a neighbour has the same hash
        again = F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda p: p.isNotNull())
        return F.aggregate(
            F.sort_array(again),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
            lambda a, p: F.struct((p + k).alias("end"), (a["n"] + F.least(F.lit(k), p + k - a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(pairs, covered))

    return let(grams(h, k), count)


def statistics(docs: DataFrame, *carried: Column) -> DataFrame:
    """docs' doc_id (and carried columns) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and FEATURES, row by row.

    Words are runs of anything but ASCII white space; a null text is an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(SPACE_WORDS))

    def of_words(w: Column) -> Column:
        h = hashes(w)
        return let(
            h,
            lambda h: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                F.size(F.array_distinct(h)).cast("bigint").alias("n_distinct"),
                _n_repeat_words(h, REPEAT).alias("n_repeat_words"),
            ),
        )

    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    names = [f"_carried{i}" for i in range(len(carried))]
    raw = docs.select(
        "doc_id",
        *[c.alias(n) for c, n in zip(carried, names, strict=True)],
        let(words(F.col("text"), SPACE_WORDS), of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("l"),
        F.length(text).cast("bigint").alias("_len"),
        left(r"[#*$%&|<>]").alias("_symbols"),
        left(r"[A-Z]").alias("_upper"),
        left(r"[!?.,;:]").alias("_marks"),
        left(r"[0-9]").alias("_digits"),
    )
    base = raw.select(
        "doc_id", *names, "w.n_words", "w.word_chars", (F.col("_len") - F.col("_symbols")).alias("n_symbols"), F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words",
        F.col("w.n_distinct").alias("_distinct"), F.col("l.n").alias("_lines"),
        (F.col("_len") - F.col("_upper")).alias("_upper"), (F.col("_len") - F.col("_marks")).alias("_marks"), (F.col("_len") - F.col("_digits")).alias("_digits"),
    )
    words_, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    rate = {
        "word_len": F.col("word_chars") / words_,
        "symbol_rate": F.col("n_symbols") / chars,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words_,
        "upper_rate": F.col("_upper") / chars,
        "distinct_rate": F.col("_distinct") / F.sqrt(words_),
        "mark_rate": F.col("_marks") / words_,
        "digit_rate": F.col("_digits") / chars,
        "line_words": F.col("n_words") / F.greatest(F.col("_lines"), F.lit(1)),
    }
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return base.select("doc_id", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *[rate[f].alias(f) for f in FEATURES])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ``>=`` or ``<``, threshold) and what it covered when learned."""

    tests: tuple[tuple[str, str, float], ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.tests:
            out = out & ((F.col(name) >= at) if sign == ">=" else (F.col(name) < at))
        return out

    def covers(self, row: dict) -> bool:
        return all((row[n] >= at) == (sign == ">=") for n, sign, at in self.tests)

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {at:.4g}" for n, s, at in self.tests)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else 0.0


def _best_test(rows: list[dict], features) -> tuple[tuple[str, str, float] | None, float]:
    """The threshold test of most gain: one sorted sweep over each feature."""
    p0, n0 = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
    best, most = None, 1e-9
    for f in features:
        order = sorted(rows, key=lambda r: r[f])
        p = n = 0
        for a, b in zip(order, order[1:], strict=False):
            p, n = p + a["bad"], n + (not a["bad"])
            if a[f] == b[f]:
                continue
            at = (a[f] + b[f]) / 2
            for sign, p1, n1 in (("<", p, n), (">=", p0 - p, n0 - n)):
                if (g := _gain(p0, n0, p1, n1)) > most:
                    best, most = (f, sign, at), g
    return best, most


def learn(rows: list[dict], features=FEATURES, max_tests: int = 4, least: int = 3, precision: float = 0.8) -> list[Rule]:
    """Ordered rules that cover bad rows; rows have ``bad``, ``part`` (0: prune) and the features.

    Ends when the next rule covers under ``least`` bad rows or is right in under
    ``precision`` of all it covers. No bad or no good row: no rule, all is kept.
    """
    rest, rules = list(rows), []
    while True:
        grow, prune = [r for r in rest if r["part"]], [r for r in rest if not r["part"]]
        if not any(r["bad"] for r in grow) or all(r["bad"] for r in grow):
            break
        tests, inside = [], grow
        while len(tests) < max_tests and any(not r["bad"] for r in inside):
            test, _ = _best_test(inside, features)
            if test is None:
                break
            tests.append(test)
            inside = [r for r in inside if Rule((test,), 0, 0).covers(r)]

        def worth(t):
            got = [r["bad"] for r in prune if Rule(tuple(t), 0, 0).covers(r)]
            return (sum(got) - (len(got) - sum(got))) / max(1, len(got))

        tests = max((tests[:k] for k in range(len(tests), 0, -1)), key=worth, default=[])
        if not tests:
            break
        got = [r for r in rest if Rule(tuple(tests), 0, 0).covers(r)]
        bad = sum(r["bad"] for r in got)
        if bad < least or bad < precision * len(got):
            break
        rules.append(Rule(tuple(tests), bad, len(got) - bad))
        rest = [r for r in rest if not rules[-1].covers(r)]
    return rules


def labelled(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> list[dict]:
    """Statistics of at most ``bound`` labelled documents that pass the base rules, in order of doc_id.

    A doc_id with several labels takes the least; null labels do not count; of
    repeated rows of a doc_id one, the least text, is used.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("_d"), (F.col("quality") == 0).alias("_bad"))
    # the joined side has at most `bound` rows of 12 bytes, and so have the texts that are gathered
    part = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_d"))
    part = part.groupBy("doc_id", "_bad").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    stats = statistics(part, F.col("_bad")).where("not base_failed")
    rows = stats.select("doc_id", F.col("_carried0").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0).alias("part"), *FEATURES)
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["doc_id"])


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that fits, null if none does."""
    first = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        first = F.when(rule.column(), F.lit(k)).otherwise(first)
    return first


def judge(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """Per row of ``docs``: doc_id, the base columns, base_failed, rule (number of the rule that fits, null if none) and kept.

    Null and empty texts fail the base rules; repeated rows are judged alike,
    one by one; extra columns are ignored; without labels all that pass the
    base rules are kept.
    """
    first = first_rule(learn(labelled(docs, labels, bound)))
    stats = statistics(docs)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), first).alias("rule")).select(
        "*", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept")
    )


def keep(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, judged where they are read."""
    first = first_rule(learn(labelled(docs, labels, bound)))
    whole = statistics(docs, F.struct(*[docs[c] for c in docs.columns]))
    return whole.where(~F.col("base_failed") & first.isNull()).select("_carried0.*")
