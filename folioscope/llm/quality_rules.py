"""Operator 7, quality rules [native]: base counts, then robust multivariate outliers per language and source.

Base counts are those of the contract (words, symbols, repeated lines, words in repeated 8-word windows). The method takes
five transformed statistics and estimates location and scatter of each (lang, source) group by minimum covariance
determinant: ``STARTS`` starts (median and MAD; the covariance of spatial signs; all rows inside a box of three MADs), two
concentration steps from each, then steps from the start of least determinant until no determinant falls further. A step
keeps the ``SUPPORT`` share of smallest distances. The scatter is made consistent at the normal distribution, and a document
is rejected when its squared Mahalanobis distance exceeds the chi-square quantile ``CUTOFF``.

The statistics are shrunk towards fixed prior means by ``PRIOR`` words, so that those of short texts don't scatter wider
than those of long ones, and shares that are zero in most texts still vary with the length. A floor on the diagonal, a
tenth of what ordinary text shows or less, only keeps a statistic that is constant in a group from making it singular.

Defined cases: null or blank text has no words and fails the base rule. Null lang or source form groups of their own.
Groups with fewer than ``MIN_GROUP`` documents that pass the base rule are judged by the estimate of their language (all its
sources), those of a language with fewer by the estimate of all documents, however few. Repeated rows each get a row and
each count. Extra columns are left alone. Empty table: no rows.
All steps are DataFrame expressions. A hot group is reduced by partial aggregates only; the group table is joined, never
collected, and the h-th smallest distance comes from a histogram of log-distance buckets, not from a sort of the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.storage import Scratch

WORD = r"[^\\x20\\x09-\\x0D]+"
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Share of a group that a concentration step keeps; most steps after the best start is chosen; fall of the logarithm of the
#: determinant that ends them; factor that makes the scatter of the central share consistent (5 dimensions: 0.75 over
#: P(chi2_7 <= 6.626)); least group; chi-square quantile of 5 dimensions at a tail of 1e-6.
SUPPORT, STEPS, SETTLED, CONSISTENCY, MIN_GROUP, CUTOFF = 0.75, 12, 1e-3, 1.412, 100, 35.89
STARTS = ("mad", "signs", "box")
#: Words of the prior, and least standard deviation of each statistic.
PRIOR = 60
FLOORS = {"f_word": 0.003, "f_upper": 0.0015, "f_symbol": 0.05, "f_line": 0.05, "f_mark": 0.0015}
NAMES = list(FLOORS)
BUCKETS = 64
#: Groups whose estimates are broadcast at most (some 200 bytes each); beyond, they are joined by a shuffle.
MAX_BROADCAST = 50_000
#: Files of a table of groups; each file written costs the executor helper processes.
GROUP_FILES = 8
Dim = Callable[[DataFrame], DataFrame]


def text_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks (all long); linear in the text.

    A window of words is known by a 64-bit hash folded from the hashes of its words. Only documents in which some hash
    occurs twice have their windows sorted.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    letters = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    base = docs.withColumns({"_words": F.expr(f"transform(regexp_extract_all(coalesce(text, ''), '{WORD}', 0), w -> xxhash64(w))"), "_lines": lines, "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"), "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"), "n_upper": (F.length(text) - F.length(letters)).cast("long"), "n_marks": (F.length(text) - F.length(F.translate(text, MARKS, ""))).cast("long")})
    base = base.withColumns({"n_words": F.size("_words").cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    hashes, step = "_words", 1
    while step < WINDOW:  # doubles the span of each hash
        name = f"_h{step * 2}"
        base = base.withColumn(name, F.expr(f"transform(slice({hashes}, 1, greatest(size({hashes}) - {step}, 0)), (h, i) -> xxhash64(h, get({hashes}, i + {step})))"))
        hashes, step = name, step * 2
    last = hashes
    base = base.withColumn("_sorted", F.expr(f"case when size(array_distinct({last})) < size({last}) then array_sort(transform({last}, (h, i) -> struct(h as h, i as i))) end"))
    base = base.withColumn("_at", F.expr("case when _sorted is not null then array_sort(transform(filter(transform(_sorted, (x, j) -> struct(x.i as i, (x.h <=> get(_sorted, j - 1).h) or (x.h <=> get(_sorted, j + 1).h) as twice)), x -> x.twice), x -> x.i)) end"))
    covered = F.expr(f"coalesce(aggregate(transform(_at, (p, j) -> least({WINDOW}, coalesce(get(_at, j + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x), 0L)")
    return base.withColumn("n_repeat_words", covered).drop("_words", "_lines", "_sorted", "_at", *[f"_h{2**k}" for k in range(1, 4)])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _statistics(df: DataFrame) -> DataFrame:
    words, chars = F.col("n_words") + PRIOR, F.col("word_chars") + 5 * PRIOR
    return df.withColumns(
        {
            "f_word": F.log((F.col("word_chars") + 5.5 * PRIOR) / words),
            "f_upper": F.sqrt((F.col("n_upper") + 0.1 * PRIOR) / chars),
            "f_symbol": F.log((F.col("n_symbols") + 1.0) / chars),
            "f_line": F.log((F.col("n_dup_lines") + 1.0) / (F.col("n_lines") + 4.0)),
            "f_mark": F.sqrt((F.col("n_marks") + 0.15 * PRIOR) / chars),
        }
    )


_LOWER_HALF = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _factor(moments: DataFrame) -> DataFrame:
    """Means ``m_``, Cholesky factor ``l_i_j`` of the floored scatter and ``logdet``, from means and covariances ``c_i_j``."""
    out = moments
    for i, j in _LOWER_HALF:
        rest = F.col(f"c_{i}_{j}") + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[NAMES[i]] ** 2 / 4))) if i == j else rest / F.col(f"l_{j}_{j}"))
    logdet = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(NAMES))), F.lit(0.0))
    return out.withColumn("logdet", logdet).select("g", "s", "logdet", *[f"m_{a}" for a in NAMES], *[f"l_{i}_{j}" for i, j in _LOWER_HALF])


def _distance(rows: DataFrame, stats: DataFrame, dim: Dim) -> DataFrame:
    """Adds ``s`` and ``d2``, the squared Mahalanobis distance to each estimate of the row's group, by forward substitution;
    null without one."""
    joined = rows.join(dim(stats.select("g", "s", *[c for c in stats.columns if c[:2] in ("m_", "l_")])), "g", "left")
    total = F.lit(0.0)
    for i, a in enumerate(NAMES):
        value = F.col(a) - F.col(f"m_{a}")
        for j in range(i):
            value = value - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        joined = joined.withColumn(f"z_{i}", value / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return joined.withColumn("d2", total).select(*rows.columns, "s", "d2")


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """Means and ``scale`` times the covariances of the rows of each ``(g, s)``."""
    sums = [F.avg(a).alias(f"m_{a}") for a in NAMES] + [F.covar_pop(NAMES[i], NAMES[j]).alias(f"v_{i}_{j}") for i, j in _LOWER_HALF]
    out = rows.groupBy("g", "s").agg(*sums)
    return out.select("g", "s", *[f"m_{a}" for a in NAMES], *[(scale * F.col(f"v_{i}_{j}")).alias(f"c_{i}_{j}") for i, j in _LOWER_HALF])


def _concentrate(rows: DataFrame, stats: DataFrame, dim: Dim) -> DataFrame:
    """One step: the estimates from each group's ``SUPPORT`` share of smallest distances."""
    binned = _distance(rows, stats, dim).where("d2 is not null").withColumn("bucket", F.floor(F.log(F.greatest("d2", F.lit(1e-9))) * BUCKETS))
    counts = binned.groupBy("g", "s", "bucket").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("g", "s")
    ranked = counts.withColumns({"upto": F.sum("c").over(group.orderBy("bucket")), "all": F.sum("c").over(group)})
    edge = ranked.where(F.col("upto") >= SUPPORT * F.col("all")).groupBy("g", "s").agg(F.min("bucket").alias("edge"))
    inner = binned.join(dim(edge), ["g", "s"]).where(F.col("bucket") <= F.col("edge"))
    return _factor(_moments(inner, CONSISTENCY))


def _starts(rows: DataFrame, scratch: Scratch, dim: Dim) -> DataFrame:
    """The estimates that concentration starts from, one per group and start."""
    middle = scratch.table(rows.groupBy("g").agg(*[F.percentile_approx(a, 0.5, 2000).alias(f"m_{a}") for a in NAMES]).coalesce(GROUP_FILES))
    near = rows.join(dim(middle), "g")
    spread = near.groupBy("g").agg(*[(F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 2000) * 1.4826).alias(f"d_{a}") for a in NAMES])
    scale = scratch.table(middle.join(spread, "g").coalesce(GROUP_FILES))
    step = {a: F.greatest(F.col(f"d_{a}"), F.lit(FLOORS[a])) for a in NAMES}
    zero = F.lit(0.0)
    mad = scale.select("g", F.lit("mad").alias("s"), *[f"m_{a}" for a in NAMES], *[(F.col(f"d_{NAMES[i]}") ** 2 if i == j else zero).alias(f"c_{i}_{j}") for i, j in _LOWER_HALF])
    z = rows.join(dim(scale), "g").select("g", *[((F.col(a) - F.col(f"m_{a}")) / step[a]).alias(a) for a in NAMES])
    length = F.greatest(F.sqrt(sum((F.col(a) ** 2 for a in NAMES), zero)), F.lit(1e-9))
    inside = F.greatest(*[F.abs(a) for a in NAMES]) <= 3
    signs = z.select("g", F.lit("signs").alias("s"), *[(F.col(a) / length).alias(a) for a in NAMES])
    box = z.where(inside).select("g", F.lit("box").alias("s"), *NAMES)
    unit = _moments(signs.unionByName(box), 1.0).join(dim(scale.select("g", *[F.col(f"m_{a}").alias(f"o_{a}") for a in NAMES], *[v.alias(f"u_{a}") for a, v in step.items()])), "g")
    sign = F.col("s") == "signs"  # signs tell the shape alone: their centre is the median, their size that of unit vectors
    back = unit.select(
        "g", "s",
        *[(F.col(f"o_{a}") + F.when(sign, zero).otherwise(F.col(f"m_{a}") * F.col(f"u_{a}"))).alias(f"m_{a}") for a in NAMES],
        *[(F.when(sign, F.lit(float(len(NAMES)))).otherwise(F.lit(1.0)) * F.col(f"c_{i}_{j}") * F.col(f"u_{NAMES[i]}") * F.col(f"u_{NAMES[j]}")).alias(f"c_{i}_{j}") for i, j in _LOWER_HALF],
    )
    # written before and after: the planner's constraints grow exponentially over unwritten chains of these columns
    return scratch.table(_factor(scratch.table(mad.unionByName(back).coalesce(GROUP_FILES))).coalesce(GROUP_FILES))


def robust_groups(spark: SparkSession, rows: DataFrame, scratch: Scratch, dim: Dim) -> DataFrame:
    """Location, Cholesky factor and log-determinant of each group's minimum covariance determinant estimate."""
    stats = scratch.table(_concentrate(rows, _starts(rows, scratch, dim), dim).coalesce(GROUP_FILES))
    stats = scratch.table(_concentrate(rows, stats, dim).coalesce(GROUP_FILES))
    best = stats.groupBy("g").agg(F.min_by(F.struct(*[c for c in stats.columns if c != "g"]), F.struct("logdet", "s")).alias("x"))
    stats = scratch.table(best.select("g", "x.*").coalesce(GROUP_FILES))
    for _ in range(STEPS):
        following = scratch.table(_concentrate(rows, stats, dim).coalesce(GROUP_FILES))
        fall = following.join(dim(stats.select("g", F.col("logdet").alias("before"))), "g").agg(F.max(F.col("before") - F.col("logdet")).alias("fall")).first()["fall"]
        stats = following
        if fall is None or fall < SETTLED:
            break
    return stats


def group_levels(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, Dim]:
    """For each group ``g``: ``at``, the level whose estimate judges it (the group, its language ``l`` or all), and ``feeds``,
    the levels that its documents are estimated in. Also how to join a table of groups: broadcast if there are at most
    ``MAX_BROADCAST`` groups, so that rows aren't dealt by group."""
    groups = scratch.table(rows.groupBy("g", "l").agg(F.count_if(~F.col("base_failed")).alias("size")).coalesce(GROUP_FILES))
    langs = scratch.table(groups.groupBy("l").agg(F.sum("size").alias("l_size"), F.min("size").alias("least")).coalesce(GROUP_FILES))
    dim: Dim = F.broadcast if groups.count() <= MAX_BROADCAST else lambda df: df
    small, small_lang = F.col("size") < MIN_GROUP, F.col("l_size") < MIN_GROUP
    whole = langs.where(small_lang).limit(1).count() > 0
    group, lang, every = F.concat(F.lit("g"), "g"), F.concat(F.lit("l"), "l"), F.lit("a")
    at = F.when(~small, group).when(~small_lang, lang).otherwise(every)
    feeds = F.array_compact(F.array(F.when(~small, group), F.when((F.col("least") < MIN_GROUP) & ~small_lang, lang), F.when(F.lit(whole), every)))
    return scratch.table(groups.join(dim(langs), "l").select("g", at.alias("at"), feeds.alias("feeds")).coalesce(GROUP_FILES)), dim


def judge_quality(spark: SparkSession, docs: DataFrame, cutoff: float = CUTOFF, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` (text, lang, source and those), the counts, ``base_failed``, ``distance`` (squared; null
    if no document passes the base rule) and ``kept``."""
    scratch = Scratch(spark, "quality")
    lang, source = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source")]
    group = F.concat(lang, F.lit("\u0001"), source)
    counted = text_counts(docs.select("text", lang.alias("l"), group.alias("g"), F.struct(*keep).alias("_kept"))).drop("text").withColumn("base_failed", base_failed())
    rows = scratch.table(_statistics(counted))
    levels, dim = group_levels(rows, scratch)
    fed = rows.where("not base_failed").select("g", *NAMES).join(dim(levels.select("g", "feeds")), "g").select(F.explode("feeds").alias("g"), *NAMES)
    stats = robust_groups(spark, fed, scratch, dim)
    out = _distance(rows.join(dim(levels.select("g", "at")), "g").withColumn("g", F.col("at")).drop("at"), stats, dim).drop("s")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)
    return out.select("_kept.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance"), kept.alias("kept"))
