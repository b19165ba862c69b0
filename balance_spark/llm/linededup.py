"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity, so that two lines with a
Jaccard similarity of at least 0.8 share one of the first few pairs of neighbours in that order
(the prefix).  Lines that meet at such a pair are compared by length, position and a bitmap of
parities; what passes is verified word by word, for each line the most alike first.  A line
goes if an earlier one is that similar.  Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balance_spark.llm.common import BLANKS, durable, fresh, partitions, words

#: Words are counted in this many classes of hashes.
CLASS_BITS = 16
#: Lines that are looked up again are told apart in this many classes of hashes.
WANTED = 1 << 20
#: A mark of more distinct lines than this is joined in two steps.
HOT_LINES = 256
LAST = (1 << 63) - 1
_PLACE = ("doc", "row", "line")


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc, row, line, said)`` of lines that have a word.

    ``row`` numbers the rows of the table; rows without ``doc_id`` come after all others.
    """
    # Numbered before lines are taken apart: in one step each line would get a number.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.select(
        "row", "doc", "unnamed", F.posexplode(F.split("text", "\n")).alias("line", "said")
    ).filter(F.btrim("said", F.lit(BLANKS)) != "")


def _words(said: Column) -> Column:
    """The words of a line, as ``words`` gives them; one split at a plain blank is cheaper."""
    other = [said.contains(blank) for blank in BLANKS if blank not in " \n"]
    odd = other[0] | other[1] | other[2] | other[3]
    return F.when(odd, words(said)).otherwise(F.array_remove(F.split(said, " "), ""))


def _fixed_array(spark: SparkSession, counts: dict, size: int) -> Column:
    """``size`` whole numbers as one constant, 0 where ``counts`` has none.

    It is the answer of a subquery, so plans carry its name and not its numbers.
    """
    text = ",".join(str(counts.get(k, 0)) for k in range(size))
    made = spark.createDataFrame([(text,)], "text string")
    return made.select(F.split("text", ",").cast("array<int>")).scalar()


def rarity_classes(docs: DataFrame) -> Column:
    """For every class of word hashes four times the logarithm of its number of words.

    All words of all texts are counted; what comes to the driver has a fixed size.
    """
    found = _lines(docs).select(F.explode(_words(F.col("said"))).alias("word"))
    counts = (
        found.groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - CLASS_BITS).alias("class"))
        .agg(F.floor(4 * F.log2(F.count("*"))).cast("int").alias("size"))
        .collect()
    )
    sizes = {r["class"]: r["size"] for r in counts}
    # A constant, not a subquery: exchanges under it have to be equal to be used again.
    text = ",".join(str(sizes.get(k, 0)) for k in range(1 << CLASS_BITS))
    return F.split(F.lit(text), ",").cast("array<int>")


def _word_set(said: Column, sizes: Column) -> Column:
    """The words of a line as distinct numbers that sort by rarity.

    First counts the class of a word's hash (frequent words come last), then the hash itself.
    """

    def number(word):
        size = F.get(sizes, F.shiftrightunsigned(word, 64 - CLASS_BITS).cast("int"))
        size = F.coalesce(size, F.lit(0))  # never, but numbers without NULLs sort faster
        return F.shiftleft(size.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(word, 8))

    # Hashes are told apart first, so that each word is looked up once a line.
    found = F.array_distinct(F.transform(_words(said), lambda word: F.xxhash64(word)))
    return F.sort_array(F.transform(found, number))


def _passes(s: str, t: str) -> Column:
    """Length, position and bitmap filters for Jaccard >= 0.8, at the first mark both have.

    Bits that differ are words that only one of the lines has, at least.
    """
    least = f"CAST(ceil(4 * ({s}.n + {t}.n) / 9) AS int)"  # words that both must have
    return F.expr(
        f"5 * least({s}.n, {t}.n) >= 4 * greatest({s}.n, {t}.n) "
        f"AND 1 + least({s}.n - {s}.at, {t}.n - {t}.at) >= 3 * {least} - {s}.n - {t}.n "
        f"AND bit_count({s}.bits ^ {t}.bits) <= {s}.n + {t}.n - 2 * {least}"
    )


def _earlier(t: str, s: str) -> Column:
    return F.expr(
        f"{t}.doc < {s}.doc OR {t}.doc = {s}.doc "
        f"AND ({t}.row < {s}.row OR {t}.row = {s}.row AND {t}.line < {s}.line)"
    )


def _apart(s: str, t: str) -> Column:
    return F.expr(f"bit_count({s}.bits ^ {t}.bits)")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("s.hash").alias("hash"), F.col("t.hash").alias("first_hash"),
        _apart("s", "t").alias("apart"),
    ).distinct()


def _in_order(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs with the line that stands later as ``hash``."""
    places = first.drop("copies")  # the same columns wherever they are shuffled, so only once
    place, first_place = (F.struct(*[f"{x}.{c}" for c in _PLACE]) for x in "st")
    later = place > first_place
    return (
        pairs.join(places.alias("s"), "hash")
        .join(places.alias("t"), F.col("first_hash") == F.col("t.hash"))
        .select(F.col("s.hash").alias("hash"), "first_hash", "apart", later.alias("later"))
        .select(
            F.when(F.col("later"), F.col("hash")).otherwise(F.col("first_hash")).alias("hash"),
            F.when(F.col("later"), F.col("first_hash")).otherwise(F.col("hash")).alias("first_hash"),
            "apart",
        )
    )


def _wanted_bits(pairs: DataFrame) -> Column:
    """A bit for every class of the hashes in ``pairs``, 32 in a number; its size is fixed."""
    hashes = pairs.select("hash").unionByName(pairs.select(F.col("first_hash").alias("hash")))
    place = F.pmod("hash", F.lit(WANTED))
    bit = F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(31)).cast("int"))
    rows = (
        hashes.groupBy(F.shiftright(place, 5).cast("int").alias("at"))
        .agg(F.bit_or(bit).alias("bits"))
        .collect()
    )
    return _fixed_array(pairs.sparkSession, {r["at"]: r["bits"] for r in rows}, WANTED // 32)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(hash)`` of the lines in ``pairs`` that have a Jaccard similarity of 0.8 or more.

    Of the texts only lines whose hash may be in a pair are shuffled; without pairs none is read.
    """
    if pairs.isEmpty():
        return pairs.select("hash")
    place = F.pmod("hash", F.lit(WANTED)).cast("int")
    bits = F.get(_wanted_bits(pairs), F.shiftright(place, 5))
    inside = F.call_function(
        "shiftright", bits, place.bitwiseAND(F.lit(31))
    ).bitwiseAND(F.lit(1))
    sets = (
        _lines(docs)
        .select(F.xxhash64("said").alias("hash"), "said")
        .filter(inside == 1)
        .groupBy("hash")
        .agg(F.max("said").alias("said"))
        .select("hash", F.array_distinct(_words(F.col("said"))).alias("set"))
    )
    first = sets.select(F.col("hash").alias("first_hash"), F.col("set").alias("first_set"))
    both = pairs.join(sets, "hash").join(first, "first_hash")
    return both.filter(
        9 * F.size(F.array_intersect("set", "first_set"))
        >= 4 * (F.size("set") + F.size("first_set"))
    ).select("hash")


def _marks(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``(mark, hash, bits, n, at)``: each line at each mark of its prefix, dealt out by mark.

    A mark is a word with the next one of the line in the order of rarity; the last word has
    the end for its next.  Of two lines with ``n`` and ``m`` words, ``o`` of them in both, each
    of the other ``n + m - 2 * o`` words comes between at most two neighbours in both lines, so
    at least ``o - (n + m - 2 * o)`` marks are in both.  From ``9 * o >= 4 * (n + m)`` and
    ``5 * m >= 4 * n`` these are three fifths of ``n``: one is among the first two fifths and
    one more of either line.  (``least`` has it in whole words: of ``3 * o - c``, where ``o`` is
    ``4 * c / 9`` rounded up, the smallest for any ``c = n + m`` there can be.)  Two words
    together stand in few lines, however many have each.

    A very frequent line is dealt out from its first place only; copies of others are equal
    rows, merged where they meet.
    """
    total = first.agg(F.sum("copies")).first()[0] or 0
    often = first.filter(F.col("copies") > total / 10_000 + 100).select(
        "hash", F.col("row").alias("own_row"), F.col("line").alias("own_line")
    )  # fewer than 10,000 rows
    classes = rarity_classes(docs)
    parity = "aggregate(`set`, 0L, (bits, w) -> bits ^ shiftleft(1L, CAST(w & 63L AS INT)))"
    both = "(n + (4 * n + 4) div 5)"
    least = f"3 * ({both} div 9) + least(3, ({both} % 9 + 1) div 2)"
    rows = (
        _lines(docs)
        .withColumn("hash", F.xxhash64("said"))
        .join(F.broadcast(often), "hash", "left")
        .filter("own_row IS NULL OR own_row = row AND own_line = line")
        .withColumn("sizes", classes)
        .select("hash", _word_set(F.col("said"), F.col("sizes")).alias("set"))
        # Made before the marks are dealt out, so once a line.
        .select("hash", "set", F.size("set").alias("n"), F.expr(parity).alias("bits"))
        .select(
            "hash", "set", "bits", "n",
            F.expr(f"slice(`set`, 1, CAST(n + 1 - ({least}) AS int))").alias("prefix"),
        )
        # No prefix is empty; the plain form would first ask so, and make all sets again for it.
        .select("hash", "set", "bits", "n", F.posexplode_outer("prefix").alias("at", "word"))
        .select(
            # Behind the last word there is NULL, which a hash leaves out.
            F.xxhash64("word", F.get("set", F.col("at") + 1)).alias("mark"),
            "hash", "bits", "n", (F.col("at") + 1).alias("at"),
        )
    )
    return rows.repartition(partitions(docs.sparkSession), "mark")


def _meetings(marks: DataFrame) -> DataFrame:
    """``(hash, first_hash, apart)`` of lines that meet at marks of few lines, filtered.

    Lines at a mark of many come with ``mark``, ``bits``, ``n`` and ``at`` instead.  Every step
    goes on with the rows as they were dealt out by mark, in one job.
    """
    at_mark = Window.partitionBy("mark")
    # Most marks are one line's alone.
    shared = (
        marks.withColumns(
            {"low": F.min("hash").over(at_mark), "high": F.max("hash").over(at_mark)}
        )
        .filter("low <> high")
        .drop("low", "high")
        .distinct()
        .withColumn("lines", F.count("*").over(at_mark))
    )
    line = F.struct("hash", "bits", "n", "at")
    many = F.when(F.col("lines") > HOT_LINES, F.col("hash"))  # each a group of its own
    groups = shared.groupBy("mark", many.alias("own")).agg(F.collect_list(line).alias("lines"))
    met = groups.select("mark", "own", "lines", F.explode("lines").alias("s")).select(
        "mark", "own", "s", F.explode("lines").alias("t")
    )
    meet = F.col("own").isNull() & (F.col("s.hash") < F.col("t.hash")) & _passes("s", "t")
    alone = F.col("own").isNotNull()
    return (
        met.filter(meet | alone)
        .select(
            "s.hash", F.when(~alone, F.col("t.hash")).alias("first_hash"),
            F.when(~alone, _apart("s", "t")).alias("apart"),
            *[F.when(alone, F.col(c)).alias(c.split(".")[-1]) for c in ("mark", "s.bits", "s.n", "s.at")],
        )
        .distinct()
    )


def similar_earlier(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``(hash)`` of every distinct line that has an earlier similar one.

    Lines at marks of few lines are compared with each other.  At marks of many lines each line
    is first compared with the earliest of about its length and bitmap; only lines for which all
    that fails meet all others there, so that many variants of one line do not meet pairwise.
    """
    both = durable(_meetings(_marks(docs, first)))
    found = _in_order(both.filter("mark IS NULL").select("hash", "first_hash", "apart"), first)
    many = both.filter("mark IS NOT NULL").select("mark", "hash", "bits", "n", "at")
    many = durable(many.join(first.drop("copies"), "hash"))
    passes = _earlier("t", "s") & _passes("s", "t")
    kind = {"size": F.expr("n div 8"), "part": F.expr("bits & 255")}
    hubs = (
        many.withColumns(kind)
        .groupBy("mark", "size", "part")
        .agg(F.min(F.struct(*_PLACE, "hash", "bits", "n", "at")).alias("hub"))
        .select("mark", "size", "part", "hub.*")
    )
    tied = many.withColumns(kind).alias("s").join(hubs.alias("t"), ["mark", "size", "part"])
    known = durable(found.unionByName(_pairs(tied.filter(passes))).distinct())
    # One pair shows that a line goes; the most alike is the one to ask first.
    closest = known.groupBy("hash").agg(F.min_by("first_hash", F.struct("apart", "first_hash")))
    done = durable(_verified(docs, durable(closest.toDF("hash", "first_hash"))).distinct())
    # Lines that are done need no other, but others may be like them.
    rest = many.join(done, "hash", "left_anti")
    met = _pairs(rest.alias("s").join(many.alias("t"), "mark").filter(passes))
    left = known.join(done, "hash", "left_anti").unionByName(met)
    left = durable(left.select("hash", "first_hash").distinct())
    return done.unionByName(_verified(docs, left)).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(doc, row, line, copy)`` of the lines of ``docs (doc_id, text)`` that go.

    ``row`` numbers the rows of the table as they are scanned, ``line`` counts from 0; ``copy``
    says that the same line stands earlier, else an earlier one is similar.  Earlier lines have
    a smaller ``doc_id``, in rows of one ``doc_id`` a smaller row, in one row a smaller number,
    whether they go themselves or not.  Rows without ``doc_id`` come last; each is a document
    of its own, and ``doc`` is NULL.  Blank lines never go; NULL and empty texts have no other.
    An empty table gives an empty result.  Other columns are not read.  Lines of any length are
    compared by all their words; longer ones just have more marks.
    """
    said = _lines(docs).select(
        *_PLACE, "unnamed", F.xxhash64("said").alias("hash")
    )
    first = durable(
        said.groupBy("hash")
        .agg(F.min(F.struct(*_PLACE)).alias("place"), F.count("*").alias("copies"))
        .select("hash", "place.*", "copies")
    )
    similar = similar_earlier(docs, first).withColumn("similar", F.lit(True))
    # Joined by place, not by hash: each place is there once, however many copies a line has.
    places = first.join(similar, "hash", "left").select(
        "row", "line", F.coalesce("similar", F.lit(False)).alias("similar")
    )
    return (
        said.drop("hash")
        .join(places, ["row", "line"], "left")
        .filter("similar IS NULL OR similar")
        .select(
            F.when(~F.col("unnamed"), F.col("doc")).alias("doc"),
            "row", "line", F.col("similar").isNull().alias("copy"),
        )
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``removed_lines`` names, ``n_chars`` set anew.

    Rows that lose all their lines go; texts that lose none stay as they are.
    """
    row, gone, lines = fresh(docs, "_row", "_gone", "_lines")
    by_row = (
        removed_lines(docs)
        .groupBy(F.col("row").alias(row))
        .agg(F.collect_set("line").alias(gone))
    )
    kept = F.expr(
        f"transform(array_except(sequence(0, size({lines}) - 1), {gone}), i -> {lines}[i])"
    )
    left = (
        docs.withColumn(row, F.monotonically_increasing_id())
        .join(by_row, row, "left")
        .withColumn(lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
        .withColumn(lines, kept)
        .filter(F.col(lines).isNull() | (F.size(lines) > 0))
        .withColumn("text", F.coalesce(F.array_join(lines, "\n"), F.col("text")))
    )
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn(
            "n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(length)
        )
    return left.select(*docs.columns)


def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return removed_lines(docs).select(
        F.col("doc").alias("doc_id"), F.col("line").alias("line_no"), "copy"
    )


OP6_SQL = r"""
WITH said AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
           unnest(string_split(text, chr(10))) AS said
    FROM documents
), counted AS (
    SELECT *, regexp_extract_all(said, '[^ 	-
]+') AS found FROM said
), lines AS (
    SELECT said, list_distinct(any_value(found)) AS s,
           min({'d': doc_id, 'l': line_no}) AS place
    FROM counted WHERE len(found) >= 1 GROUP BY said
), rare AS (
    SELECT w, count(*) AS f FROM (SELECT unnest(s) AS w FROM lines) GROUP BY w
), marks AS (
    SELECT said, len(s) AS n, place, w,
           row_number() OVER (PARTITION BY said ORDER BY f, w) AS at
    FROM (SELECT said, s, place, unnest(s) AS w FROM lines) JOIN rare USING (w)
), pairs AS (
    SELECT DISTINCT a.said AS x, b.said AS y
    FROM marks a JOIN marks b ON a.w = b.w AND b.place < a.place
         AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    WHERE a.at <= a.n // 5 + 1 AND b.at <= b.n // 5 + 1
), alike AS (
    SELECT DISTINCT x AS said
    FROM pairs JOIN lines a ON a.said = x JOIN lines b ON b.said = y
    WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (len(a.s) + len(b.s))
)
SELECT c.doc_id, CAST(c.line_no AS INTEGER) AS line_no,
       NOT (c.doc_id = l.place.d AND c.line_no = l.place.l) AS copy
FROM counted c JOIN lines l USING (said) LEFT JOIN alike a USING (said)
WHERE NOT (c.doc_id = l.place.d AND c.line_no = l.place.l) OR a.said IS NOT NULL
"""
