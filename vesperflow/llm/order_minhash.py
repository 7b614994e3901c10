"""Order MinHash fingerprints, in DataFrame operations only.

A text's words are taken as pairs of neighbours (k-mers of k words), each numbered by its earlier occurrences, so
repeats count. The numbered k-mers' hashes are dealt to BINS bins; each bin selects its TUPLE smallest, puts them back
into text order and hashes that tuple. Two texts' likeness is the share of bins whose tuples agree, which falls with
the share of lost k-mers and with their reordering, and so with edit distance.

Everything per text stays in the row, in sorted arrays of longs that hold several fields each; lambda functions read
them by place. One exchange deals the rows to runs of neighbouring ids, where a window finds the next document. Runs
are cut by quantiles of quantiles of the ids, and by the texts' hashes where one id has many rows, so that uneven or
repeated ids spread too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.session import pick

K = 2
BINS = 64
TUPLE = 2
#: Bits of a word's place in packed longs. A text of more than 2 ** PLACE words raises an error.
PLACE = 28
#: Rows in a run of neighbouring ids, on average, up to CUTS ** 2 runs; from there on runs grow.
RUN = 250
#: Quantiles of the ids, and again within each of them.
CUTS = 256
#: An id with more than HEAVY neighbouring quantiles has the quantiles of its texts' hashes too.
HEAVY = 2


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it within lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, k: int = K, bins: int = BINS, size: int = TUPLE, fill: bool = False) -> Column:
    """Sorted longs bin * 65536 + value, one for each bin that has a k-mer; value is 1 to 65535.

    With `fill`, a bin of fewer than `size` k-mers draws those it lacks from the bins that follow, round to the first,
    so that all bins select `size` k-mers of any text that has as many, and short texts keep their order too. Null texts count as empty and have none. Fewer words than k make one k-mer.
    """
    high = -(1 << PLACE)
    shift = 64 - int(math.log2(bins))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    words = F.when(F.octet_length(text) > 2 << PLACE, F.when(F.size(words) <= 1 << PLACE, words).otherwise(F.raise_error("a text of over 2 ** 28 words").cast("array<string>"))).otherwise(words)

    def kmers(h: Column) -> Column:  # hashed k-mers with their places, sorted by hash
        n = F.size(h)
        many = F.transform(
            F.slice(h, 1, F.greatest(n - (k - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))).bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long")),
        )
        one = F.array(F.xxhash64(h).bitwiseAND(F.lit(high)))
        return F.sort_array(F.when(n >= k, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>")))

    def numbered(s: Column) -> Column:  # hashes of (k-mer, occurrence) with their places, sorted
        def occurrence(t: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.shiftright(F.get(t, i), PLACE) != F.shiftright(F.get(t, i - 1), PLACE)))
            return let(starts, lambda st: F.flatten(F.transform(st, lambda a, j: F.array_repeat(a, F.coalesce(F.get(st, j + 1), F.size(t)) - a))))

        def item(t: Column) -> Column:
            return let(occurrence(t), lambda first: F.transform(t, lambda x, i: F.xxhash64(F.shiftright(x, PLACE), i - F.get(first, i)).bitwiseAND(F.lit(high)).bitwiseOR(x.bitwiseAND(F.lit((1 << PLACE) - 1)))))

        return F.when(F.size(s) > 0, F.sort_array(item(s))).otherwise(s)

    def smallest(v: Column) -> Column:  # of each bin
        return F.filter(v, lambda x, i: (i < size) | (F.shiftrightunsigned(x, shift) != F.shiftrightunsigned(F.get(v, i - size), shift)))

    def tuples(w: Column) -> Column:
        def bin_of(x: Column) -> Column:
            return F.shiftrightunsigned(x, shift)

        def tuple_hash(i: Column) -> Column:
            return hashed(F.filter(F.transform(F.sequence(i, i + size - 1), lambda j: F.get(w, j)), lambda x: x.isNotNull() & (bin_of(x) == bin_of(F.get(w, i)))))

        def hashed(own: Column) -> Column:
            in_order = F.array_sort(own, lambda a, b: F.when(a.bitwiseAND(F.lit((1 << PLACE) - 1)) < b.bitwiseAND(F.lit((1 << PLACE) - 1)), -1).otherwise(1))
            return F.pmod(F.xxhash64(F.transform(in_order, lambda x: F.shiftright(x, PLACE))), F.lit(65535)) + 1

        def place(x: Column) -> Column:  # of its bin, in the order of signed longs
            return F.shiftright(x, shift).cast("int") + bins // 2

        def filled(i: Column) -> Column:  # the bin of place i and the empty ones before it, which select the same
            n = F.size(w)
            own = F.transform(F.sequence(i, i + F.least(F.lit(size), n) - 1), lambda j: F.get(w, j % n))
            before = F.when(i == 0, place(F.get(w, n - 1)) - bins).otherwise(place(F.get(w, i - 1)))
            return let(hashed(own), lambda h: F.transform(F.sequence(before + 1, place(F.get(w, i))), lambda s: F.shiftleft(F.pmod(s + bins // 2, F.lit(bins)).cast("long"), 16) + h))

        firsts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (bin_of(F.get(w, i)) != bin_of(F.get(w, i - 1))))
        if fill:
            return F.when(F.size(w) > 0, F.sort_array(F.flatten(F.transform(firsts, filled)))).otherwise(w)
        return F.when(F.size(w) > 0, F.sort_array(F.transform(firsts, lambda i: F.shiftleft(bin_of(F.get(w, i)), 16) + tuple_hash(i)))).otherwise(w)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: let(kmers(h), lambda s: let(numbered(s), lambda v: let(smallest(v), tuples))))


def fingerprint(sketched: Column) -> Column:
    """The sketch as hexadecimal text, six digits a bin: its number, then its value."""
    return F.lower(F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of the bins filled in either sketch whose tuples agree; 1 if both are empty."""

    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, 16))

    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _unit(h: Column) -> Column:
    """A 53-bit hash as 0 to 1."""
    return h / F.lit(float(1 << 53))


def _below(cuts: Column, x: Column, also: bool = False) -> Column:
    """How many of fewer than CUTS sorted cuts are less than x, or also equal to it: by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(CUTS.bit_length()))))

    def step(n: Column, by: Column) -> Column:
        c = F.get(cuts, n + by - 1)
        return n + F.when((c <= x) if also else (c < x), by).otherwise(0)

    return F.aggregate(steps, F.lit(0), step)


def _at(cuts: Column, x: Column, u: Column) -> Column:
    """(n, u): the interval of x between sorted cuts, and u within it. Where cuts equal x, u chooses among them."""

    def found(low: Column) -> Column:
        equal = _below(cuts, x, True) - low + 1
        inner = F.least(F.floor(u * equal), equal - 1)
        return F.struct((low + inner).cast("long").alias("n"), (u * equal - inner).alias("u"))

    return let(_below(cuts, x), found)


def _dealt(docs: DataFrame) -> DataFrame:
    """`docs` with its order within an id (u, then h: the text's hash) and its run, which ascend with (id, u, h).

    What reaches the driver are CUTS quantiles; what is broadcast are CUTS lists of them at most, whatever the corpus.
    """
    kind = docs.schema["id"].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"ids are to be numbers, not {kind.simpleString()}")
    rows = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 11))
    n = docs.agg(F.count("id")).first()[0]
    first = min(CUTS, max(1, math.ceil(n / RUN)))
    second = min(CUTS, max(1, math.ceil(n / RUN / first)))

    def quantiles(of: str, k: int) -> Column:
        return F.percentile_approx(of, [i / k for i in range(1, k)], 10000) if k > 1 else F.array().cast(f"array<{docs.schema['id'].dataType.simpleString() if of == 'id' else 'bigint'}>")

    edges = docs.agg(quantiles("id", first)).first()[0] or []
    rows = rows.withColumn("u", _unit(F.col("h")))
    heavy = sorted({e for e in edges if edges.count(e) >= HEAVY})
    if heavy:  # CUTS / HEAVY ids at most
        ids = docs.sparkSession.createDataFrame([(e,) for e in heavy], T.StructType([T.StructField("id", kind)]))
        some = rows.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(quantiles("h", CUTS).alias("_hs"))
        # equal rows of one id, which nothing else tells apart, by their number; their order among each other is no matter
        salt = _unit(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 11))

        def place(low: Column) -> Column:
            equal = _below(F.col("_hs"), F.col("h"), True) - low
            lo, hi = F.when(low > 0, F.get("_hs", low - 1)).otherwise(F.lit(0)), F.coalesce(F.get("_hs", low), F.lit(1 << 53))
            return (low + F.when(equal > 0, 1 + salt * (equal - 1)).otherwise((F.col("h") - lo) / (hi - lo))) / CUTS

        rows = rows.join(F.broadcast(some), "id", "left").withColumn("u", F.when(F.col("_hs").isNull(), F.col("u")).otherwise(let(_below(F.col("_hs"), F.col("h")), place))).drop("_hs")
    bounds = F.array(*map(F.lit, edges)).cast(f"array<{kind.simpleString()}>")
    rows = rows.withColumn("a", _at(bounds, F.col("id"), F.col("u")))
    if second > 1:
        within = rows.groupBy(F.col("a.n").alias("_n")).agg(quantiles("id", second).alias("_ids"))
        rows = rows.join(F.broadcast(within), F.col("a.n") == F.col("_n")).withColumn("_b", _at(F.col("_ids"), F.col("id"), F.col("a.u")))
        return rows.select("id", "text", "h", "u", (F.col("a.n") * second + F.col("_b.n")).alias("run"))
    return rows.select("id", "text", "h", "u", F.col("a.n").alias("run"))


def next_documents(docs: DataFrame, fill: bool = False) -> DataFrame:
    """(id, text, own, next_text, next_own) of rows (id, text) with an id: own is a text's sketch.

    Next is the row that follows by id, then the text's hash, then text; after the last comes the first. Rows go
    through one exchange, by run; only the first row of each run travels again. Partitions are twice those of the
    session, as runs are dealt by hash.
    """
    ordered = _dealt(docs)
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartition(parts, "run")
    firsts = dealt.groupBy("run").agg(F.min(F.struct("id", "u", "h", "text")).alias("f"))
    # the run before, in two levels: within blocks of CUTS runs, then between the blocks
    runs = ordered.select("run").distinct().withColumn("block", F.floor(F.col("run") / CUTS))
    heads = runs.groupBy("block").agg(F.min("run").alias("lo"), F.max("run").alias("hi"))
    heads = heads.select("block", F.lag("hi").over(Window.orderBy("block")).alias("prev"), F.max("hi").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    linked = runs.withColumn("before", F.lag("run").over(Window.partitionBy("block").orderBy("run"))).join(heads, "block").select("run", F.coalesce("before", "prev", "top").alias("before"))
    guards = firsts.join(linked, "run").select(F.col("before").alias("run"), F.col("f.text").alias("guard_text"), sketch(F.col("f.text"), fill=fill).alias("guard_own"))
    w = Window.partitionBy("run").orderBy("id", "u", "h", "text")
    rows = dealt.withColumn("own", sketch(F.col("text"), fill=fill)).withColumn("nx", F.lead(F.struct("text", "own")).over(w))
    rows = rows.join(guards, "run")
    return rows.select("id", "text", "own", F.when(F.col("nx").isNull(), F.col("guard_text")).otherwise(F.col("nx.text")).alias("next_text"), F.when(F.col("nx").isNull(), F.col("guard_own")).otherwise(F.col("nx.own")).alias("next_own"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fill: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. Null texts count as empty. Rows are ordered by id, then by a hash of the text, then text. A row with a
    null id has no place in the order: nothing replaces what its edited text loses, and near_next is null. A single
    row is its own next. Ids are numbers; others raise a TypeError.
    """
    rows = pick(docs, [id_col, text_col]).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    placed = next_documents(rows.where("id IS NOT NULL"), fill)
    loose = rows.where("id IS NULL").select("id", "text", sketch(F.col("text"), fill=fill).alias("own"), F.lit("").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_own"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    both = placed.unionByName(loose).select(F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited"), fill=fill).alias("other"))
    return both.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
