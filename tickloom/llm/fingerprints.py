"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tickloom.llm.registry import query, table

WIDTH = 5  # words of a shingle
BINS = 256
BITS = 8  # low-order bits that are stored of a bin
PER_LONG = 64 // BITS
VALUE_BITS = 55  # of a 63-bit hash, below the 8 bits that name the bin
PROBES = 6  # bins an empty bin looks into one by one before it looks at all that are filled
EMPTY = (1 << VALUE_BITS) - 1
ROWS_PER_RANGE, MOST_RANGES = 5_000, 8_192  # documents of a range that is sorted together; ranges at most


def _steps() -> tuple[list[int], list[int], list[int]]:
    """For each bin an order in which it looks at all bins: (a t + c) mod BINS for t = 0, 1, ..; a is odd."""
    drawn = [int.from_bytes(hashlib.sha256(f"bin {i}".encode()).digest()[:8], "big") for i in range(BINS)]
    a, c = [d % BINS | 1 for d in drawn], [(d >> 20) % BINS for d in drawn]
    return a, c, [pow(x, -1, BINS) for x in a]


_A, _C, _BACK = _steps()
_PLACES = [(_A[i] * t + _C[i]) % BINS for i in range(BINS) for t in range(PROBES)]


def _numbers(values: list[int]) -> Column:
    return F.expr(f"array({','.join(map(str, values))})")


def shingle_hashes(words: str, width: int = WIDTH) -> Column:
    """63-bit hashes of the shingles of an array column of words; fewer words are one shingle, none are none."""
    w = F.col(words)
    long = F.transform(F.sequence(F.lit(0), F.size(w) - width),
                       lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    short = F.array(F.xxhash64(F.size(w), w))
    hashes = (F.when(F.size(w) >= width, long).when(F.size(w) > 0, short)
              .otherwise(F.array().cast("array<bigint>")))
    return F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1))


def with_fill(hashes: Column) -> Column:
    """The hashes in order, bin before value, with the largest value of every bin among them."""
    return F.sort_array(F.concat(hashes, _numbers([f"{(b << VALUE_BITS) + EMPTY}L" for b in range(BINS)])))


def least_by_bin(ordered: str) -> Column:
    """The least hash of each bin, in the order of bins; null for a bin that has only its filling."""
    h = F.col(ordered)
    first = F.filter(h, lambda x, i: (i == 0) | (
        F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(h, i - 1), VALUE_BITS)))
    return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(EMPTY)) != EMPTY, x))


def fingerprint_columns(df: DataFrame, text: str, name: str, width: int = WIDTH) -> DataFrame:
    """Add ``name``, the packed bins of ``text`` as an array of longs; null for a text without words.

    Every empty bin takes the value of the first filled bin in an order of its own.  The order is fixed by the bin, so
    texts agree on it, and it is another for each bin (optimal densification).
    """
    words, ordered, least, filled = (f"_{name}_{part}" for part in ("words", "ordered", "least", "filled"))
    trimmed = F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn(words, F.when(trimmed != "", F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
                       .otherwise(F.array().cast("array<string>")))
    df = df.withColumn(ordered, F.when(F.size(words) > 0, with_fill(shingle_hashes(words, width))))
    df = df.withColumn(least, least_by_bin(ordered))
    df = df.withColumn(filled, F.array_compact(F.transform(
        F.col(least), lambda x: F.shiftright(x, VALUE_BITS).cast("int"))))
    places, c, back, mask = _numbers(_PLACES), _numbers(_C), _numbers(_BACK), F.lit(BINS - 1)

    def dense(x: Column, i: Column) -> Column:
        """The first filled bin in the order of bin i.

        A few places are looked up one by one; where all of those are empty, the filled bin of least rank is found.
        """
        looked = [F.get(F.col(least), F.get(places, i * PROBES + t)) for t in range(PROBES)]
        ranked = F.array_min(F.transform(F.col(filled), lambda j: (
            F.get(back, i) * (j - F.get(c, i) + BINS)).bitwiseAND(mask) * BINS + j))
        return F.coalesce(x, *looked, F.get(F.col(least), ranked.bitwiseAND(mask)))

    low = F.transform(F.col(least), lambda x, i: dense(x, i).bitwiseAND(F.lit((1 << BITS) - 1)))
    df = df.withColumn(f"_{name}_low", low)
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda k: F.aggregate(
        F.slice(F.col(f"_{name}_low"), k * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"),
        lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)))
    df = df.withColumn(name, F.when(F.col(f"_{name}_low").isNotNull(), packed))
    return df.drop(words, ordered, least, filled, f"_{name}_low")


def likeness(x: Column, y: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    A stored value agrees by chance once in 2 ** BITS cases, so the share of agreeing bins is corrected by that.  Two
    texts without words are alike; one with and one without are not.
    """
    lowest = F.lit(sum(1 << (BITS * i) for i in range(PER_LONG)))

    def equal(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        for half in (4, 2, 1):  # gathers the bits of a bin in its lowest one
            d = d.bitwiseOR(F.shiftrightunsigned(d, half))
        any_bit = d.bitwiseAND(lowest)
        return F.lit(PER_LONG) - F.bit_count(any_bit)

    share = F.aggregate(F.zip_with(x, y, equal), F.lit(0), lambda acc, n: acc + n) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return (F.when(x.isNull() & y.isNull(), F.lit(1.0)).when(x.isNull() | y.isNull(), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance))))


def as_text(packed: Column) -> Column:
    """Hexadecimal digits of a packed fingerprint, two for each bin; the empty text for null."""
    return F.coalesce(F.array_join(F.transform(packed, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), ""), F.lit(""))


def ranges(docs: DataFrame, key: str, rows: int = ROWS_PER_RANGE) -> tuple[Column, int]:
    """The number of a row's range of keys, 0 and up, for ranges of about ``rows`` rows, and how many there are.

    The borders are percentiles, one number per range.  Equal keys share a range; a null key is in the first.
    """
    parts = min(MOST_RANGES, max(1, -(-docs.count() // rows)))
    found = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    borders = sorted(set(found or []))
    if not borders:
        return F.lit(0), 1
    # Binary search: step by step as far as a border that is not above the key.
    table_ = _numbers([f"{b}L" for b in borders])
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]
    part = F.aggregate(_numbers(steps), F.lit(0), lambda at, step: F.when(
        F.get(table_, at + step - 1) <= F.col(key), at + step).otherwise(at))
    return part, len(borders) + 1


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A row's edited text has its last quarter replaced by the beginning of the next text in order of the key, as long
    as the quarter or all of it; the last row's next is the first.  Rows are dealt by ranges of the key, so a text is
    shuffled once and neighbours meet in one task; the first row of each range is also sent to the range before.

    Null is the empty text.  Rows with a null key come first; rows that share a key are in order of their texts.  A text
    with fewer words than a shingle is one shingle; one without words has the empty fingerprint, like only to such.
    A single row is its own next; an empty table gives an empty result; other columns are not returned.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part, parts = ranges(rows, "doc_id")
    rows = rows.withColumn("part", part)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    # The first row of each range, known by one aggregate, stands at the end of the range before (the last's is the first's).
    low = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("f"))
    guests = low.select(F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"),
                        ((F.col("part") + parts - 1) % parts).alias("part"))
    both = (fingerprint_columns(rows, "text", "print").withColumn("guest", F.lit(0))
            .unionByName(fingerprint_columns(guests, "text", "print").withColumn("guest", F.lit(1))))
    window = Window.partitionBy("part").orderBy("guest", *order)
    n = F.char_length("text")
    with_next = (both.withColumn("next", F.lead(F.struct("text", "print")).over(window)).filter("guest = 0")
                 .withColumn("n_chars", n.cast("long")).withColumn("cut", F.floor(n / 4).cast("int"))
                 .withColumn("edited", F.concat(F.expr("left(text, n_chars - cut)"), F.expr("left(next.text, cut)"))))
    out = fingerprint_columns(with_next, "edited", "edited_print")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
                      likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                      likeness(F.col("print"), F.col("next.print")).alias("near_next"))


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
