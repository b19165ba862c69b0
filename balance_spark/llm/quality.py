"""Quality rules whose cutoffs are certified on labelled documents.

Every rule is a number per document; a document goes if one number is above the cutoff of
its stratum.  A cutoff is only used if the labels prove, by an exact binomial test, that it
rejects few good documents of the stratum.  Everything here is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import BLANKS, durable, fresh, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
RULES = ("symbol_share", "repeat_share", "dup_line_share", "shout_share")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts")
#: Strata beyond this number are joined without a broadcast.
BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class RiskPlan:
    """What the cutoffs guarantee, and between which of them there is a choice.

    With probability ``1 - delta`` over the labelled documents, no stratum loses more than
    ``alpha`` of its good documents to the rules.  ``cutoffs`` are tried from the largest to
    the smallest; of the certified ones that is taken which rejects most bad documents, a
    good one counting as ``good_weight`` bad ones.
    """

    alpha: float = 0.02
    delta: float = 0.05
    cutoffs: tuple[float, ...] = (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.09, 0.06, 0.04)
    good_weight: int = 20


def _counted(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def features(docs: DataFrame, **names: str) -> DataFrame:
    """``docs`` with a column for each of ``FEATURES`` (all long), named by ``names``.

    A NULL text counts as an empty one: all numbers are 0.  Whole texts are counted.
    """
    named = {f: names.get(f, f) for f in FEATURES}
    text, found, hashes, order = fresh(docs, "_text", "_words", "_hashes", "_order")
    rows = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn(found, words(F.col(text)))
    rows = rows.withColumn(
        hashes,
        F.expr(
            f"CASE WHEN size({found}) >= {WINDOW} THEN "
            f"transform(sequence(0, size({found}) - {WINDOW}), i -> xxhash64("
            + ", ".join(f"{found}[i + {k}]" for k in range(WINDOW))
            + ")) ELSE CAST(array() AS array<bigint>) END"
        ),
    )
    # Only texts with a window that repeats are sorted.
    rows = rows.withColumn(
        order,
        F.expr(
            f"CASE WHEN size(array_distinct({hashes})) < size({hashes}) THEN "
            f"array_sort(transform({hashes}, (h, i) -> struct(h, i))) END"
        ),
    )
    again = (
        f"array_sort(transform(filter(sequence(0, size({order}) - 1), k -> "
        f"coalesce({order}[k].h = get({order}, k - 1).h, false) OR "
        f"coalesce({order}[k].h = get({order}, k + 1).h, false)), k -> {order}[k].i))"
    )
    covered = (
        f"aggregate({again}, struct(0 AS n, -{WINDOW} AS last), (s, p) -> struct("
        f"s.n + least({WINDOW}, p - s.last) AS n, p AS last), s -> s.n)"
    )
    lines = F.filter(
        F.split(F.col(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    )
    values = {
        "n_words": F.size(found),
        "word_chars": F.length(F.translate(text, BLANKS, "")),
        "n_symbols": _counted(F.col(text), SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(F.expr(covered), F.lit(0)),
        "n_shouts": _counted(F.col(text), "!"),
    }
    # A generator: filters on these numbers must not be moved in front of it, where each
    # mention of a number would measure the text again.
    measured = F.struct(*[v.cast("long").alias(named[f]) for f, v in values.items()])
    return rows.select(*docs.columns, F.inline(F.array(measured)))


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))


def _shares(named: dict[str, str]) -> dict[str, Column]:
    """The number of each rule; 0 for texts without words."""

    def share(part, whole):
        return F.coalesce(F.try_divide(F.col(named[part]), F.col(named[whole])), F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": F.lit(20.0) * share("n_dup_lines", "n_words"),
        "shout_share": share("n_shouts", "n_words"),
    }


def tail_within(k: str, n: str, p: float, level: str) -> Column:
    """Whether P(Binomial(n, p) <= k) is at most ``level``, exactly.

    ``k >= n p`` is never within a level under one half.  A Chernoff bound that is already
    within the level proves it without the sum; otherwise terms are added up from 0 to ``k``,
    each from the one before by logarithms.
    """
    rate = f"({k} / {n})"
    bound = (
        f"exp(-{n} * (CASE WHEN {k} = 0 THEN 0 ELSE {rate} * ln({rate} / {p}) END "
        f"+ (1 - {rate}) * ln((1 - {rate}) / (1 - {p}))))"
    )
    terms = (
        f"aggregate(sequence(0L, {k}), struct({n} * ln(1 - {p}) AS term, 0D AS total), "
        f"(s, i) -> struct(CASE WHEN i < {n} THEN s.term + ln(({n} - i) / (i + 1) * {p} / "
        f"(1 - {p})) ELSE s.term END AS term, s.total + exp(s.term) AS total), s -> s.total)"
    )
    return F.expr(
        f"CASE WHEN {n} = 0 OR {k} >= {n} * {p} THEN false WHEN {bound} <= {level} THEN true "
        f"ELSE {terms} <= {level} END"
    )


def certified_cutoffs(measured: DataFrame, labels: DataFrame, plan: RiskPlan) -> DataFrame:
    """``(stratum, symbol_share, ...)``: the cutoffs that the labels prove, NULL if none.

    ``measured`` has ``doc_id, stratum, failed`` and the rules' numbers.  Rules share
    ``alpha`` and, with the strata, ``delta`` (Bonferroni); within a rule cutoffs are tested
    in a fixed order up to the first that fails, which needs no further correction.
    Documents that fail the base rules take no part.  A document with several labels counts
    as bad if one says so; rows without identifier or label are left out.
    """
    judged = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"))
    )
    rules = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])
    )
    held = (
        measured.filter("NOT failed").join(judged, "doc_id").select("stratum", "good", rules)
    ).select("stratum", "good", "col.rule", "col.value")
    tries = F.posexplode(F.array(*[F.lit(c) for c in plan.cutoffs])).alias("place", "cutoff")
    above = [
        F.count_if((F.col("good") == good) & (F.col("value") > cutoff)).alias(f"{name}{i}")
        for i, cutoff in enumerate(plan.cutoffs)
        for name, good in (("k", 1), ("bad", 0))
    ]
    counted = held.groupBy("stratum", "rule").agg(
        F.count_if(F.col("good") == 1).alias("n"), *above
    )
    strata = counted.agg(F.greatest(F.lit(1), F.countDistinct("stratum"))).scalar()
    every = range(len(plan.cutoffs))
    tested = (
        counted.select(
            "stratum", "rule", "n",
            F.array(*[f"k{i}" for i in every]).alias("ks"),
            F.array(*[f"bad{i}" for i in every]).alias("bads"),
            (F.lit(plan.delta / len(RULES)) / strata).alias("level"),
            tries,
        )
        .withColumns({"k": F.expr("ks[place]"), "bad": F.expr("bads[place]")})
        .withColumn("passed", tail_within("k", "n", plan.alpha / len(RULES), "level"))
    )
    chosen = (
        tested.groupBy("stratum", "rule")
        .agg(
            F.min(F.when(~F.col("passed"), F.col("place"))).alias("stop"),
            F.collect_list(
                F.struct(
                    (F.col("bad") - plan.good_weight * F.col("k")).alias("gain"),
                    (-F.col("place")).alias("back"), "cutoff",
                )
            ).alias("tries"),
        )
        .withColumn(
            "tries",
            F.expr(f"filter(tries, t -> -t.back < coalesce(stop, {len(plan.cutoffs)}))"),
        )
        .select("stratum", "rule", F.expr("array_max(tries).cutoff").alias("cutoff"))
    )
    return chosen.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES]
    )


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _cutoffs_of(measured: DataFrame, labels: DataFrame, plan: RiskPlan):
    named = {f: f for f in FEATURES}
    rows = measured.select(
        "doc_id", _stratum().alias("stratum"), base_failed().alias("failed"),
        *[v.alias(r) for r, v in _shares(named).items()],
    )
    cutoffs = durable(certified_cutoffs(rows, labels, plan))
    return F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs


def _verdict(rows: DataFrame, cutoffs: DataFrame, named: dict[str, str], kept: str) -> DataFrame:
    """``rows`` with the column ``kept``; strata without a certified cutoff keep all."""
    stratum, *limits = fresh(rows, "_stratum", *[f"_{r}" for r in RULES])
    cutoffs = cutoffs.select(
        F.col("stratum").alias(stratum), *[F.col(r).alias(x) for r, x in zip(RULES, limits)]
    )
    rejected = base_failed(named["n_words"], named["n_repeat_words"])
    for limit, share in zip(limits, _shares(named).values()):
        rejected = rejected | F.coalesce(share > F.col(limit), F.lit(False))
    return (
        rows.withColumn(stratum, _stratum())
        .join(cutoffs, stratum, "left")
        .withColumn(kept, ~rejected)
        .drop(stratum, *limits)
    )


def judge(docs: DataFrame, labels: DataFrame, plan: RiskPlan = RiskPlan()) -> DataFrame:
    """``doc_id``, the six features, ``base_failed`` and ``kept`` of every row.

    ``docs`` has ``doc_id, text, lang``; ``labels`` has ``doc_id, quality`` (1: good).  The
    strata are the languages; a NULL language is the stratum ''.  NULL, empty and blank texts
    have no words and fail the base rules.  Rows without ``doc_id`` are judged, but no label
    is theirs; repeated rows are judged each; an empty table gives an empty result.  Without
    enough labels only the base rules reject.  Other columns are not read.
    """
    measured = durable(
        features(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
        ).drop("text")
    )
    named = {f: f for f in FEATURES}
    judged = _verdict(measured, _cutoffs_of(measured, labels, plan), named, "kept")
    return judged.select("doc_id", *FEATURES, base_failed().alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, plan: RiskPlan = RiskPlan()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they are.

    Texts are measured once; the verdict is joined to them by the number of the row.
    """
    (row,) = fresh(docs, "_row")
    number = F.monotonically_increasing_id().alias(row)
    light = docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    measured = durable(features(light).drop("text"))
    named = {f: f for f in FEATURES}
    judged = _verdict(measured, _cutoffs_of(measured, labels, plan), named, "kept")
    kept = judged.filter("kept").select(row)
    return docs.select("*", number).join(kept, row, "left_semi").drop(row)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return judge(docs, spark.read.parquet(f"{folder}/labels.parquet"))


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), g AS (
    SELECT doc_id, i, list_slice(w, i + 1, i + 5) AS x
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), r AS (
    SELECT doc_id, unnest(range(i, i + 5)) AS j
    FROM g JOIN (SELECT doc_id, x FROM g GROUP BY doc_id, x HAVING count(*) > 1)
    USING (doc_id, x)
), n AS (
    SELECT doc_id, count(DISTINCT j) AS n FROM r GROUP BY doc_id
), f AS (
    SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_shouts
    FROM (SELECT *, list_filter(string_split(t, chr(10)),
                                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM d) LEFT JOIN n USING (doc_id)
), s AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           coalesce(n_symbols / nullif(word_chars, 0), 0.0) AS symbol_share,
           coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_share,
           20.0 * coalesce(n_dup_lines / nullif(n_words, 0), 0.0) AS dup_line_share,
           coalesce(n_shouts / nullif(n_words, 0), 0.0) AS shout_share
    FROM f
), good AS (
    SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), held AS (
    SELECT stratum, good, unnest([{'rule': 1, 'v': symbol_share}, {'rule': 2, 'v': repeat_share},
                                  {'rule': 3, 'v': dup_line_share}, {'rule': 4, 'v': shout_share}])
           AS x
    FROM s JOIN good USING (doc_id) WHERE NOT base_failed
), cutoffs AS (
    SELECT * FROM (VALUES (0, 2.0), (1, 1.0), (2, 0.7), (3, 0.5), (4, 0.35), (5, 0.25),
                          (6, 0.18), (7, 0.12), (8, 0.09), (9, 0.06), (10, 0.04)) v(place, cutoff)
), tried AS (
    SELECT stratum, x.rule AS rule, place, cutoff, count(*) FILTER (good = 1) AS n,
           count(*) FILTER (good = 1 AND x.v > cutoff) AS k,
           count(*) FILTER (good = 0 AND x.v > cutoff) AS bad
    FROM held, cutoffs GROUP BY ALL
), tested AS (
    SELECT *, n > 0 AND k < n * 0.005 AND list_sum(list_transform(range(0, k + 1), lambda i:
                  exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                      + i * ln(0.005) + (n - i) * ln(0.995))))
              <= 0.05 / 4 / (SELECT count(DISTINCT stratum) FROM held) AS passed
    FROM tried
), stops AS (
    SELECT stratum, rule, coalesce(min(place) FILTER (NOT passed), 11) AS stop
    FROM tested GROUP BY stratum, rule
), chosen AS (
    SELECT stratum, rule, arg_max(cutoff, {'gain': bad - 20 * k, 'back': -place}) AS cutoff
    FROM tested JOIN stops USING (stratum, rule) WHERE place < stop GROUP BY stratum, rule
), limits AS (
    SELECT stratum, max(cutoff) FILTER (rule = 1) AS a, max(cutoff) FILTER (rule = 2) AS b,
           max(cutoff) FILTER (rule = 3) AS c, max(cutoff) FILTER (rule = 4) AS d
    FROM chosen GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shouts, base_failed,
       NOT (base_failed OR coalesce(symbol_share > a, false) OR coalesce(repeat_share > b, false)
            OR coalesce(dup_line_share > c, false) OR coalesce(shout_share > d, false)) AS kept
FROM s LEFT JOIN limits USING (stratum)
"""
