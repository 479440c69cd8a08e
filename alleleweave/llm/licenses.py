"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined with those of the templates: 2-grams for short templates, 3-grams
for notices and whole license texts. A hit at word p of the text and word q of the template votes for diagonal p - q; a
template that stands in the text verbatim has all its votes on one diagonal, and an insertion or omission shifts the rest to
a diagonal close by. Votes are aggregated by diagonal, neighbouring diagonals are merged, and the merged spans are
verified: enough of the template's words, in a span that isn't much longer than the template. The join
compares the words behind equal hashes, so a hit is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower

#: What parts words once A-Z are lower-cased: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template whose places are bits of one long.
SLOT = 64
#: Diagonals so close are merged: so many words put in or left out at one place within a template.
DRIFT = 3
#: A span counts if it has so many of a template's words, of a template of less than ``SHORT`` words all, as every word
#: matters there ...
COVERAGE = 0.8
SHORT = 12
#: ... in at most so many times its length.
STRETCH = 1.5

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Usual wordings of license notices, with labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


#: Whole license texts, in files beside this module, named by their labels.
WHOLE = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "mit")


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool

    @property
    def k(self) -> int:
        """Words of a gram."""
        return 2 if len(self.words) < SHORT else 3

    @property
    def needed(self) -> float:
        return 1.0 if self.base or len(self.words) < SHORT else COVERAGE


def words_of(text: str) -> tuple[str, ...]:
    """The words of an ASCII text."""
    return tuple("".join(c if c.isalnum() else " " for c in text.lower()).split())


def whole_texts() -> list[tuple[str, str]]:
    folder = resources.files(__package__) / "license_texts"
    return [((folder / f"{label}.txt").read_text("ascii"), label) for label in WHOLE]


def templates(base=BASE_PHRASES, notices=NOTICES, texts=None) -> list[Template]:
    groups = ((base, True), (notices, False), (whole_texts() if texts is None else texts, False))
    out = [Template(words_of(p), label, b) for group, b in groups for p, label in group]
    if any(len(t.words) < 2 for t in out):
        raise ValueError("a template needs 2 words")
    return out


def template_grams(spark: SparkSession, wanted: list[Template]) -> DataFrame:
    """(template, q, gram, h): each gram of each template, at its position q."""
    rows = [(n, q, list(t.words[q : q + t.k])) for n, t in enumerate(wanted) for q in range(len(t.words) - t.k + 1)]
    return spark.createDataFrame(rows, "template int, q int, gram array<string>").withColumn("h", F.xxhash64("gram"))


def _bits(q: Column, k: Column) -> Column:
    """(slot, mask) of the words q .. q + k - 1, as an array: one or two of them."""
    one = lambda slot: F.struct(
        slot.alias("slot"),
        F.aggregate(F.filter(F.sequence(q, q + k - 1), lambda w: F.floor(w / SLOT) == slot), F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (w % SLOT).cast("int")))).alias("mask"),
    )
    return F.array_distinct(F.array(one(F.floor(q / SLOT)), one(F.floor((q + k - 1) / SLOT))))


def license_spans(docs: DataFrame, wanted: list[Template], id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, id, n_words, template, diagonal, slot, mask, first, last): for each text, diagonal with a vote, and ``SLOT`` words of the
    template, which of them are found, and one row with a null template for each text.

    row numbers the rows of ``docs``, so that rows with equal or null ids stay apart. The templates are broadcast if they
    take at most ``broadcast_bytes``; else the words are dealt out by their hashes, and AQE splits a frequent one.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS), lambda w: w != "")
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("words"))
    d = d.select("row", "id", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("p", "w"))
    # Words by name, without their text's array, before the second explode: no row carries the text.
    sizes = sorted({t.k for t in wanted} | {2})
    d = d.select("row", "id", "n_words", "p", "w", *[F.get("words", F.col("p") + i).alias(f"w{i}") for i in range(1, sizes[-1])])
    gram = lambda k: F.array("w", *[F.col(f"w{i}") for i in range(1, k)])
    whole = [F.when(F.col(f"w{k - 1}").isNotNull() | F.lit(k == sizes[0]), gram(k)) for k in sizes]  # one at least, if only to keep texts without a hit
    d = d.select("row", "id", "n_words", "p", F.explode(F.array(*whole)).alias("g")).where("g IS NOT NULL").withColumn("h", F.xxhash64("g"))
    g = template_grams(docs.sparkSession, wanted)
    small = sum(len(w.encode()) + 16 for t in wanted for w in t.words) * 4 <= broadcast_bytes
    g = F.broadcast(g) if small else g.hint("merge")
    hits = d.join(g, (d.h == g.h) & (d.g == g.gram), "left")
    hits = hits.where("template IS NOT NULL OR coalesce(p, 0) = 0")
    k = F.size("gram")
    hits = hits.withColumn("b", F.explode_outer(F.when(F.col("template").isNotNull(), _bits(F.col("q"), k))))
    return hits.groupBy("row", "id", "n_words", "template", (F.col("p") - F.col("q")).alias("diagonal"), F.col("b.slot").alias("slot")).agg(
        F.bit_or("b.mask").alias("mask"), F.min("p").alias("first"), F.max(F.col("p") + k - 1).alias("last")
    )


def license_scan(docs: DataFrame, wanted: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text", drift: int = DRIFT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where all words of a base phrase stand one after another, first_word and
    last_word are the smallest and largest start of these (else null). labels has the base labels and
    those of every template of which ``COVERAGE`` of the words (all, if it has less than ``SHORT``) are in grams found on
    neighbouring diagonals; both lists are distinct, sorted and comma-joined, empty if nothing is found. score is the
    largest share of a template's words found in a span, 0 if there is none. Null and empty texts have no words. Templates
    and texts may be of any length. Rows with equal or null ids stay apart; other columns are ignored; an empty table gives an
    empty result.
    """
    wanted = wanted or templates()
    spark = docs.sparkSession
    about = spark.createDataFrame([(n, len(t.words), t.label, t.base, t.needed) for n, t in enumerate(wanted)], "template int, length int, label string, is_base boolean, needed double")
    about = F.broadcast(about) if len(wanted) * 64 <= broadcast_bytes else about
    votes = license_spans(docs, wanted, id_col, text_col, broadcast_bytes).join(about, "template", "left")
    of = Window.partitionBy("row", "template").orderBy("diagonal")
    ahead = F.col("diagonal") - F.lag("diagonal").over(of)
    apart = (ahead > drift) | (F.col("is_base") & (ahead > 0))
    votes = votes.withColumn("own", F.sum(F.bit_count("mask")).over(Window.partitionBy("row", "template", "diagonal")))
    votes = votes.withColumn("island", F.sum(F.when(apart, 1).otherwise(0)).over(of))
    key = ("row", "id", "n_words", "template", "length", "label", "is_base", "needed", "island")
    slots = votes.groupBy(*key, "slot").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("own").alias("own"), F.min("diagonal").alias("diagonal"))
    spans = slots.groupBy(*key).agg(
        F.sum(F.bit_count("mask")).alias("merged"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("own").alias("own"), F.min("diagonal").alias("diagonal")
    )
    # Verified: enough of a template on one diagonal, or in a span of about its length.
    short = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("length")
    found = F.when(short, F.greatest("own", "merged")).otherwise(F.col("own")) / F.col("length")
    spans = spans.withColumn("found", F.coalesce(found, F.lit(0.0)))
    seen = F.col("found") >= F.col("needed")
    place = F.col("is_base") & seen
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")  # noqa: E731  at most one of each label
    return spans.groupBy("row", "id", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"),
        joined(seen).alias("labels"),
        F.max("found").alias("score"),
    ).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
