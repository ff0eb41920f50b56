"""Benchmark decontamination by winnowing, on built-in functions only.

Of each run of consecutive k-gram hashes a document keeps the least
(Schleimer, Wilkerson & Aiken 2003). With k-grams of 5 words and runs of 6,
every shared span of 10 words holds one whole run on both sides, so both keep
the same fingerprint: no shared span is missed. A bit map of the items'
fingerprints, broadcast by a join, leaves few windows of a document; these are
joined with the items' windows by fingerprint and words, so that no hash
decides a result. Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import ALNUM_WORDS, ascii_lower, grams, hashes, let, words

WINDOW = 10
GRAM = 5
#: Item windows up to this many are joined by broadcast, more by a shuffle.
BROADCAST_ROWS = 500_000
#: Bits of the map for each item window, and in all. A fuller map lets more windows through to the join and changes no result.
MAP_SHARE, MAP_BITS = 32, 1 << 24


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), ALNUM_WORDS)


def _minima(gram_hashes: Column, run: Column | int) -> Column:
    """Least of each ``run`` consecutive hashes: one per window of words."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(gram_hashes) >= run, F.transform(F.sequence(F.lit(1), F.size(gram_hashes) - (run - 1)), lambda j: F.array_min(F.slice(gram_hashes, j, run)))).otherwise(none)


def _prints(word_hashes: Column, short: list[int], window: int, gram: int) -> list[tuple[int, Column]]:
    """(window length, fingerprint of each window of that length), for the full length and each short one.

    A short item of L words is one window; its fingerprint is its own hash.
    """
    full = let(grams(word_hashes, gram), lambda g: _minima(g, window - gram + 1))
    return [(window, full)] + [(n, _own(grams(word_hashes, n), n)) for n in short]


def _own(gram_hashes: Column, n: int) -> Column:
    return F.transform(gram_hashes, lambda h: F.xxhash64(h, F.lit(n)))


def _probes(fp: Column, bits: int) -> tuple[Column, Column]:
    """Two places in a map of 2**n bits."""
    return fp.bitwiseAND(bits - 1), F.shiftrightunsigned(fp, 32).bitwiseAND(bits - 1)


def fingerprint_map(fps: DataFrame, bits: int) -> DataFrame:
    """One row: ``_map``, an array of bits / 64 numbers in which both probes of each fingerprint are set, and ``_key`` 0."""
    places = fps.select(F.explode(F.array(*_probes(F.col("fp"), bits))).alias("at"))
    set_ = places.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("v"))
    slots = fps.sparkSession.range(bits // 64).join(set_, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))
    # at most MAP_BITS / 64 rows; the key 0 is computed, so that a join by it stays an equi-join
    return slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda s: s["v"]).alias("_map"), F.min("id").alias("_key"))


def _in_map(fp: Column, bits: int) -> Column:
    return F.forall(F.array(*_probes(fp, bits)), lambda at: F.getbit(F.element_at("_map", (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(63).cast("int")) == 1)


def _near(w: Column, short: list[int], window: int, gram: int, bits: int) -> Column:
    """(len, start, fp, words) of the windows of ``w`` whose fingerprint is in the map."""
    kind = "array<struct<len:int,start:int,fp:bigint,words:array<string>>>"

    def of_length(n: int, prints: Column) -> Column:
        def some(few: Column) -> Column:
            all_ = F.transform(prints, lambda x, i: F.struct(F.lit(n).alias("len"), (i + 1).cast("int").alias("start"), x.alias("fp")))
            here = F.filter(all_, lambda s: F.array_contains(few, s["fp"]))
            return F.when(F.size(few) > 0, F.transform(here, lambda s: F.struct(s["len"].alias("len"), s["start"].alias("start"), s["fp"].alias("fp"), F.slice(w, s["start"], s["len"]).alias("words")))).otherwise(F.array().cast(kind))

        return let(F.filter(F.array_distinct(prints), lambda x: _in_map(x, bits)), some)

    def bound(n: int) -> Callable[[Column], Column]:
        return lambda prints: of_length(n, prints)

    return let(hashes(w), lambda h: F.concat(*[let(p, bound(n)) for n, p in _prints(h, short, window, gram)]))


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id, len, fp, words): the windows of each item; an item of fewer words is one window."""
    w = items.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("len"))
    at = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))
    out = w.select("item_id", "len", F.explode(at).alias("words")).distinct()
    h = hashes(F.col("words"))
    fp = F.when(F.col("len") < window, F.xxhash64(F.xxhash64(h), "len")).otherwise(let(h, lambda x: F.array_min(grams(x, gram))))
    return out.select("item_id", "len", fp.alias("fp"), "words")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings), items_sha256, contaminated.

    A document word inside any occurrence of an item window is hit. Null and
    empty texts have no words and are clean; items without words match nothing;
    rows equal in doc_id and text are one document, rows that share only the
    doc_id are judged apart; extra columns are ignored. Empty benchmark: every
    document is clean.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    targets = item_windows(items, window, gram)
    seen = targets.groupBy("len").agg(F.count("*").alias("n")).collect()  # at most `window` rows
    short = sorted(r["len"] for r in seen if r["len"] < window)
    hint = F.broadcast if sum(r["n"] for r in seen) <= BROADCAST_ROWS else (lambda df: df)
    n_windows = sum(r["n"] for r in seen)
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(10, (MAP_SHARE * n_windows).bit_length()))
    marks = fingerprint_map(targets.select("fp").distinct(), bits)  # one row, which every document meets
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("_t")).withColumn("_key", F.pmod(F.col("_t"), F.lit(1).cast("bigint")))
    base = base.join(F.broadcast(marks), "_key")
    state = let(item_words(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _near(w, short, window, gram, bits).alias("near")))
    rows = base.select("doc_id", "_t", state.alias("s")).select("doc_id", "_t", "s.n_words", F.explode_outer("s.near").alias("c"))
    rows = rows.select("doc_id", "_t", "n_words", "c.len", "c.start", "c.fp", "c.words")
    by_item = hint(targets.groupBy("fp", "len", "words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")))
    keys = [rows[c] == by_item[c] for c in ("fp", "len", "words")]
    verified = rows.join(by_item, keys, "left").select("doc_id", "_t", "n_words", F.when(F.col("ids").isNotNull(), F.struct(rows["start"], rows["len"])).alias("span"), "ids")
    per = verified.groupBy("doc_id", "_t").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    # spans in order of their start: each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return per.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    bad = decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
