"""Document fingerprints by Order MinHash, in DataFrame functions only.

White space is folded to single blanks, none at the ends; a text's k-mers are its runs of
``k`` characters, with ``k`` - 1 blanks before and after the text, so that short texts and
texts without blanks have a k-mer for each character. A k-mer's later occurrences count
as k-mers of their own: every k-mer is hashed with its occurrence number. The fingerprint has ``bins`` places. Each place takes the
``tuple_size`` occurrence-numbered k-mers with the smallest hashes among those that the
hash deals to it (one permutation serves all places), puts them back into text order and
hashes the tuple. Two texts agree at a place only if the same k-mers are the smallest
there and stand in the same order, so the likeness falls with moved passages too.

Only the ``sample`` k-mers of smallest hash, with all their occurrences, go into the
places (a bottom-k sketch): texts of any length are read whole, and the work after the
first sort does not grow with them.

A text that is null or has only white space has an empty fingerprint, alike (1.0) to another
empty one and unlike (0.0) all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosecha.llm.tables import written

KMER = 5
SAMPLE = 128
BINS = 64
TUPLE = 2
#: A k-mer's hash has HASH_BITS; packed with a place in text order of PLACE_BITS it makes a positive long.
HASH_BITS = 39
PLACE_BITS = 24
_PLACES = (1 << PLACE_BITS) - 1
_NO_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a small value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(*parts: Column) -> Column:
    """A hash of HASH_BITS."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - HASH_BITS)


def _packed(hash_: Column, place: Column) -> Column:
    """One long that sorts by hash, then place; places beyond PLACE_BITS tie."""
    return F.shiftleft(hash_, PLACE_BITS).bitwiseOR(F.least(place, F.lit(_PLACES)).cast("bigint"))


def _heads(values: Column, key: Callable[[Column], Column]) -> Column:
    """The indices (from 0) at which ``key`` of sorted ``values`` changes."""
    changes = lambda p, i: (i == 0) | (key(F.get(values, i - 1)) != key(p))
    return F.filter(F.transform(values, lambda p, i: F.when(changes(p, i), i)), lambda i: i.isNotNull())


def _numbered(picked: Column, kinds: Column) -> Column:
    """For each of ``picked`` (in text order; ``kinds`` has its distinct values): a hash of the k-mer and its occurrence number, packed with its place."""
    single = F.transform(picked, lambda x, i: _packed(_hash(x, F.lit(1).cast("bigint")), i))
    hash_of = lambda p: F.shiftright(p, PLACE_BITS)

    def number(ordered: Column) -> Column:
        def count(heads: Column) -> Column:
            length = lambda s, i: F.coalesce(F.get(heads, i + 1), F.size(ordered)) - s
            return F.flatten(F.transform(heads, lambda s, i: F.sequence(F.lit(1).cast("bigint"), length(s, i).cast("bigint"))))

        numbers = _let(_heads(ordered, hash_of), count)
        return F.zip_with(ordered, numbers, lambda p, n: _packed(_hash(hash_of(p), n), p.bitwiseAND(F.lit(_PLACES))))

    repeated = _let(F.sort_array(F.transform(picked, _packed)), number)
    return F.when(F.size(picked) == F.size(kinds), single).otherwise(repeated)


def _bins(items: Column, bins: int, size: int) -> Column:
    """Of every bin that has items, bin << 32 | hash of its tuple, in order of bins. ``items``: sorted packed values; their leading bits are the bin."""
    bin_of = lambda p: F.shiftright(p, HASH_BITS + PLACE_BITS - (bins - 1).bit_length())

    def signatures(all_: Column) -> Column:
        def signature(i: Column) -> Column:
            # The smallest members of the bin, back in text order.
            members = F.filter(F.slice(all_, i + 1, size), lambda p: bin_of(p) == bin_of(F.get(all_, i)))
            by_place = lambda p: F.shiftleft(p.bitwiseAND(F.lit(_PLACES)), HASH_BITS).bitwiseOR(F.shiftright(p, PLACE_BITS))
            in_text = F.transform(F.sort_array(F.transform(members, by_place)), lambda p: p.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
            tuple_hash = F.hash(in_text).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
            return F.shiftleft(bin_of(F.get(all_, i)), 32).bitwiseOR(tuple_hash)

        return F.transform(_heads(all_, bin_of), signature)

    return _let(items, signatures)


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = KMER, sample: int = SAMPLE, bins: int = BINS, size: int = TUPLE) -> DataFrame:
    """``df`` with the fingerprint of column ``text``: an array of bin << 32 | tuple hash, sorted; bins without k-mers are left out.

    ``bins`` is a power of two. A column called ``name`` is replaced.
    """
    kmers, kinds, picked, items = (f"_{name}_{part}" for part in ("kmers", "kinds", "picked", "items"))
    # The long arrays are columns of their own, so that each is made once and sorted by compiled code.
    folded = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    padded = F.concat(F.lit(" " * (k - 1)), folded, F.lit(" " * (k - 1)))
    # A run from every character on, but none from within a surrogate pair.
    runs = F.regexp_extract_all(padded, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{k}}}))"), F.lit(1))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(kmers, F.when(folded == "", none).otherwise(F.transform(runs, lambda t: _hash(t))))
    df = df.withColumn(kinds, F.slice(F.sort_array(F.array_distinct(kmers)), 1, sample))
    df = df.withColumn(picked, F.filter(kmers, lambda x: x <= F.get(F.col(kinds), F.size(kinds) - 1)))
    df = df.withColumn(items, F.sort_array(_numbered(F.col(picked), F.col(kinds))))
    return df.withColumn(name, _bins(F.col(items), bins, size)).drop(kmers, kinds, picked, items)


def as_text(fingerprint: Column) -> Column:
    """The fingerprint as hex: two digits of the bin and eight of the tuple, bin after bin."""
    return F.concat_ws("", F.transform(fingerprint, lambda e: F.lower(F.right(F.hex(e.bitwiseOR(F.lit(1 << 62))), F.lit(10)))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal places among those that either fingerprint has; 1 for two empty ones."""
    bins = lambda c: F.transform(c, lambda e: F.shiftright(e, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def _next_in_order(keys: DataFrame) -> DataFrame:
    """``keys`` (_id, _h; distinct) with next_id and next_h of the row that follows in descending _id, then ascending _h; the last gets the first."""
    order = [F.desc("_id"), F.asc("_h")]
    placed = written(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    within = Window.partitionBy("_part").orderBy(*order)
    pair = F.struct(F.col("_id").alias("next_id"), F.col("_h").alias("next_h"))
    # One row for each range.
    firsts = placed.groupBy("_part").agg(F.min_by(pair, F.struct(-F.col("_id").cast("decimal(20,0)"), F.col("_h"))).alias("head"))
    across = Window.orderBy("_part")
    start = F.first("head").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = firsts.select("_part", F.coalesce(F.lead("head").over(across), start).alias("after"))
    linked = placed.withColumn("follows", F.lead(pair).over(within)).join(F.broadcast(heads), "_part")
    return linked.select(*[c for c in keys.columns], F.coalesce("follows", "after").alias("_next")).select(*keys.columns, "_next.*")


def fingerprint_with_edits(docs: DataFrame, k: int = KMER, sample: int = SAMPLE, bins: int = BINS, size: int = TUPLE) -> DataFrame:
    """The contract's columns for every row of ``docs``; only doc_id and text are read.

    Documents are ordered by descending doc_id, a null one last (it stands for the
    smallest long); those that share a doc_id by a hash of their text. Rows that repeat both are one document of that order
    and get equal results. A table of one document is its own next.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Both joins read these three columns by the same keys, so that texts are shuffled once.
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"))
    keys = keyed.groupBy("_id", "_h").agg(F.first(F.char_length("text")).cast("long").alias("n_chars"))
    links = written(_next_in_order(keys), "links")

    # The next document's first characters, brought to the document that takes them.
    wants = links.select(F.col("_id").alias("to_id"), F.col("_h").alias("to_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"), F.col("next_id").alias("_id"), F.col("next_h").alias("_h"))
    given = keyed.join(wants, ["_id", "_h"]).select(F.col("to_id").alias("_id"), F.col("to_h").alias("_h"), F.left("text", "wanted").alias("given"))
    given = given.groupBy("_id", "_h").agg(F.first("given").alias("given"))
    both = keyed.join(given, ["_id", "_h"])
    n = F.char_length("text")
    edited = F.concat(F.left("text", (n - F.floor(n / 3)).cast("int")), F.col("given"))
    both = both.select("_id", "_h", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    for column, name in (("text", "own"), ("edited", "other")):
        both = with_fingerprint(both, column, name, k, sample, bins, size).drop(column)
    done = written(both, "fingerprints")

    following = done.select(F.col("_id").alias("next_id"), F.col("_h").alias("next_h"), F.col("own").alias("next")).join(
        links.select("next_id", "next_h", "_id", "_h"), ["next_id", "next_h"]
    )
    following = following.groupBy("_id", "_h").agg(F.first("next").alias("next"))
    joined = done.join(following, ["_id", "_h"])
    return joined.select(
        F.nullif("_id", F.lit(_NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
