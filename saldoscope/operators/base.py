"""Building blocks shared by the operators.

Everything is keyed by account, and one account may hold a large part of all rows. So:

* aggregates are algebraic and combine before the shuffle;
* top-k filters sit directly on a ``row_number`` window, so Spark limits each partition
  before it shuffles;
* ordered work runs over time slices of an account, never over the whole account, with a
  small carry table (one row per slice) between slices.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

KEY = "account_id"
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
NO_ROWS = "array<string>"


def blank_to_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def first_text(*cols, default="") -> Column:
    """First non-empty text, as an ``or`` chain treats the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(default))


# The fallback chains differ on purpose: each operator names the one it follows.
def cp_profile() -> Column:
    return first_text("counterparty", "description", "merchant_name")


def cp_strict() -> Column:
    return F.trim(first_text("counterparty", "merchant_name"))


def cp_desc() -> Column:
    return first_text("counterparty", "description")


def cp_dup() -> Column:
    return F.lower(F.trim(first_text("counterparty", F.substring("description", 1, 30))))


def cp_graph() -> Column:
    return first_text("merchant_name", "counterparty", F.trim(F.substring(F.trim("description"), 1, 50)))


def cp_salary() -> Column:
    return first_text(F.trim("counterparty"), F.trim("merchant_name"), F.trim("description"))


def word_pattern(words) -> str:
    """One pattern for a word list, grouped by first letter so most positions fail at once."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join("\\Q%s\\E(?:%s)" % (c, "|".join("\\Q%s\\E" % t if t else "" for t in tails)) for c, tails in groups.items())


def has_any(text: Column, words) -> Column:
    """True if any word occurs in the text as a substring."""
    return text.rlike(word_pattern(words))


def first_word(text: Column, words) -> Column:
    """First word of the list that occurs in the text, else null."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.try_element_at(F.filter(listed, lambda w: F.contains(text, w)), F.lit(1))


def ladder(value: Column, steps, otherwise=0) -> Column:
    """Points of the first step whose test holds: ``steps`` = [(op, bound, points)]."""
    tests = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b}
    out = None
    for op, bound, points in steps:
        cond = tests[op](value, F.lit(bound))
        out = F.when(cond, F.lit(points)) if out is None else out.when(cond, F.lit(points))
    return out.otherwise(F.lit(otherwise))


def py_round(c: Column, digits: int = 0) -> Column:
    """Half-even rounding of a double."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def cents(c) -> Column:
    """Money as whole cents: long sums are exact, cheap, and fail loudly on overflow."""
    return F.rint(dbl(c) * F.lit(100.0)).cast("long")


def total(c) -> Column:
    """Exact sum of money per key as double; null-free."""
    return F.coalesce(F.sum(cents(c)) / F.lit(100.0), F.lit(0.0))


def us(c="ts") -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def day(c="ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def month(c="ts") -> Column:
    return F.date_format(c, "yyyy-MM")


def stamp(c="ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_us(c) -> Column:
    return stamp(F.timestamp_micros(c))


def read_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: a filter on them stays behind them.

    Below a plain projection Spark would put the filter with all the text work inside, nested, and
    do that work again above it.
    """
    out = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return out.select("*", *[F.col(f"_once.{n}").alias(n) for n in columns]).drop("_once")


def moments(prefix: str, c) -> list:
    """Count, sum and sum of squares: enough for mean and both deviations, and mergeable."""
    c = F.col(c) if isinstance(c, str) else c
    return [F.count(c).alias(f"{prefix}_n"), F.sum(c).cast("double").alias(f"{prefix}_s"),
            F.sum(c * c).cast("double").alias(f"{prefix}_q")]


def mean_of(prefix: str) -> Column:
    return F.col(f"{prefix}_s") / F.col(f"{prefix}_n")


def _spread(prefix: str) -> Column:
    s, q, n = F.col(f"{prefix}_s"), F.col(f"{prefix}_q"), F.col(f"{prefix}_n")
    return F.greatest(q - s * s / n, F.lit(0.0))


def std_pop(prefix: str) -> Column:
    return F.sqrt(_spread(prefix) / F.col(f"{prefix}_n"))


def std_samp(prefix: str) -> Column:
    n = F.col(f"{prefix}_n")
    return F.when(n > 1, F.sqrt(_spread(prefix) / (n - 1)))


def topk(df: DataFrame, keys, order, k: int, rank: str = "rank_in_account") -> DataFrame:
    """First ``k`` rows per key; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def counts(df: DataFrame, name: str, keys=(KEY,)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def left_all(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join one-row-per-account frames on the account."""
    return reduce(lambda a, b: a.join(b, KEY, "left"), others, base)


def n0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def having(rows: DataFrame, wanted: DataFrame, keys) -> DataFrame:
    """Rows whose keys stand in ``wanted``; a null key is a key like any other."""
    named = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]), "left_semi")


def sliced_cumsum(df: DataFrame, keys, t: str, order, values: dict, slice_us: int = DAY_US) -> DataFrame:
    """Running totals along time without putting a whole key into one task.

    Each (key, slice) is summed on its own; slice totals, one row per slice, are summed
    along the key and added back. ``values`` maps an output name to the column to add up.
    """
    df = df.withColumn("_slice", F.floor(F.col(t) / F.lit(slice_us)))
    part = [*keys, "_slice"]
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*part).agg(*[F.sum(c).alias(f"_c_{o}") for o, c in values.items()])
    carry = carry.select(*part, *[F.sum(f"_c_{o}").over(before).alias(f"_c_{o}") for o in values])
    out = df.select("*", *[F.sum(c).over(local).alias(f"_l_{o}") for o, c in values.items()])
    out = out.join(carry, part, "left")
    for o in values:
        out = out.withColumn(o, F.coalesce(F.col(f"_l_{o}"), F.lit(0)) + F.coalesce(F.col(f"_c_{o}"), F.lit(0)))
    return out.drop("_slice", *[f"_l_{o}" for o in values], *[f"_c_{o}" for o in values])


def by_instant(df: DataFrame, keys, amount=None) -> DataFrame:
    """Collapse rows to one per (key, instant): count and sum in cents. Combines map-side."""
    s = F.sum(cents(amount) if amount is not None else F.lit(0).cast("long")).alias("s")
    return df.groupBy(*keys, us().alias("t")).agg(F.count("*").alias("n"), s)


def forward_totals(instants: DataFrame, keys, width_us: int, slice_us: int = DAY_US) -> DataFrame:
    """Rows and sum inside [t, t + width] for every instant t, in linear time.

    The window total is the running total at the window end minus the one just before its
    start; the end is a probe row placed on the same timeline.
    """
    money = instants.schema["s"].dataType
    marks = F.array(
        F.struct(F.col("t").alias("at"), F.lit(1).alias("kind"), F.col("n"), F.col("s")),
        F.struct((F.col("t") + F.lit(width_us)).alias("at"), F.lit(2).alias("kind"),
                 F.lit(0).cast("long").alias("n"), F.lit(0).cast(money).alias("s")))
    line = instants.select(*keys, F.col("t").alias("t0"), F.explode(marks).alias("m"))
    line = line.select(*keys, "t0", F.col("m.at").alias("t"), "m.kind", "m.n", "m.s")
    line = sliced_cumsum(line, keys, "t", ["t", "kind"], {"cum_n": F.col("n"), "cum_s": F.col("s")}, slice_us)
    is_point = F.col("kind") == 1
    return line.groupBy(*keys, F.col("t0").alias("t")).agg(
        F.max(F.when(is_point, F.col("n"))).alias("n"),
        (F.max(F.when(~is_point, F.col("cum_n"))) - F.max(F.when(is_point, F.col("cum_n") - F.col("n")))).alias("n_w"),
        (F.max(F.when(~is_point, F.col("cum_s"))) - F.max(F.when(is_point, F.col("cum_s") - F.col("s")))).alias("s_w"))


def greedy_windows(cand: DataFrame, keys, width_us: int, k: int) -> DataFrame:
    """First ``k`` windows per key when each chosen window consumes all it covers.

    A window opened at t rules out starts up to t + width. Two picks never share an aligned
    slot of that width and a pick is at most two non-empty slots after the one before, so
    the first 2k slots hold every pick; the fold runs over those alone.
    """
    cand = cand.withColumn("_slot", F.floor(F.col("t") / F.lit(width_us)))
    slots = topk(cand.select(*keys, "_slot").distinct(), keys, ["_slot"], 2 * k, "_rank").drop("_rank")
    near = cand.join(slots, [*keys, "_slot"], "left_semi")
    packed = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "n_w", "s_w"))).alias("c"))
    kind = packed.schema["c"].dataType.simpleString()
    fold = F.aggregate(
        "c", F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) < k) & ((F.size(acc) == 0) | (x["t"] > F.try_element_at(acc, F.lit(-1))["t"] + F.lit(width_us))),
            F.concat(acc, F.array(x))).otherwise(acc))
    return packed.select(*keys, F.posexplode(fold).alias("pos", "w")).select(
        *keys, (F.col("pos") + 1).alias("rank_in_account"), "w.t", "w.n_w", "w.s_w")


def islands(instants: DataFrame, keys, gap_us: int, slice_us: int = DAY_US) -> DataFrame:
    """Give each instant the start of its run, where a run breaks at a gap over ``gap_us``.

    Runs may cross slices: the last instant and the last run start of each slice are carried
    along a table with one row per slice.
    """
    df = instants.withColumn("_slice", F.floor(F.col("t") / F.lit(slice_us)))
    part = [*keys, "_slice"]
    along = Window.partitionBy(*keys).orderBy("_slice")
    inside = Window.partitionBy(*part).orderBy("t")
    ends = df.groupBy(*part).agg(F.max("t").alias("_end")).select(*part, F.lag("_end").over(along).alias("_prev_end"))
    df = df.join(ends, part)
    prev = F.coalesce(F.lag("t").over(inside), F.col("_prev_end"))
    df = df.withColumn("_start", F.when(prev.isNull() | (F.col("t") - prev > gap_us), F.col("t"))).drop("_prev_end")
    starts = df.groupBy(*part).agg(F.max("_start").alias("_open"))
    starts = starts.select(*part, F.last("_open", ignorenulls=True).over(
        along.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    df = df.join(starts, part)
    run = F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("run", F.coalesce(run, F.col("_open"))).drop("_slice", "_start", "_open")


def exact_median(df: DataFrame, keys, value: str, out: str = "median", high: bool = False) -> DataFrame:
    """Exact median of a decimal(·,2) column per key without gathering the key's rows.

    Values are counted first, then located in two steps: by coarse bucket along the key and
    by value inside the bucket, so no task sees more than one bucket of distinct values.
    ``high`` takes the upper middle element instead of the mean of the two.
    """
    hist = df.groupBy(*keys, F.round(F.col(value) * 100).cast("long").alias("v")).agg(F.count("*").alias("n"))
    hist = hist.withColumn("_b", F.shiftright("v", 16))
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    buckets = hist.groupBy(*keys, "_b").agg(F.sum("n").alias("_bn"))
    buckets = buckets.select(*keys, "_b", (F.sum("_bn").over(along) - F.col("_bn")).alias("_before"),
                             F.sum("_bn").over(along).alias("_upto"), F.sum("_bn").over(whole).alias("_all"))
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    wanted = buckets.filter(((F.col("_before") <= lo) & (lo < F.col("_upto"))) | ((F.col("_before") <= hi) & (hi < F.col("_upto"))))
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = hist.join(wanted, [*keys, "_b"]).withColumn("_c", F.col("_before") + F.sum("n").over(inside))
    near = near.withColumn("_p", F.col("_c") - F.col("n"))
    at_lo, at_hi = (F.col("_p") <= lo) & (lo < F.col("_c")), (F.col("_p") <= hi) & (hi < F.col("_c"))
    picked = near.groupBy(*keys).agg(F.max(F.when(at_lo, F.col("v"))).alias("_lo"), F.max(F.when(at_hi, F.col("v"))).alias("_hi"))
    mid = F.col("_hi") / 100.0 if high else (F.col("_lo") + F.col("_hi")) / 200.0
    return picked.select(*keys, mid.alias(out))


def carry_last(df: DataFrame, keys, order: str, mark, out: str, slice_width: int) -> DataFrame:
    """Last non-null ``mark`` up to each row along ``order``, slice by slice with a carry."""
    df = df.withColumn("_mark", mark).withColumn("_slice", F.floor(F.col(order) / F.lit(slice_width)))
    part = [*keys, "_slice"]
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*part).agg(F.max_by(F.col("_mark"), F.when(F.col("_mark").isNotNull(), F.col(order))).alias("_end"))
    ends = ends.select(*part, F.last("_end", ignorenulls=True).over(along).alias("_before"))
    inside = Window.partitionBy(*part).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    d = df.join(ends, part).withColumn(out, F.coalesce(F.last("_mark", ignorenulls=True).over(inside), F.col("_before")))
    return d.drop("_mark", "_slice", "_before")


def near_full_slots(rows: DataFrame, keys, width_us: int, measure: Column, least: Column) -> DataFrame:
    """Rows that can lie in a window whose ``measure`` adds up to ``least``, found by one aggregate.

    A window touches two neighbouring slots at most, so one of them holds half of it: rows stay in
    such slots and in those beside them. The slots are written first, so that their true size
    decides whether rows must be shuffled to meet them.
    """
    slot = F.floor(us() / F.lit(width_us))
    full = rows.select(*keys, slot.alias("_slot"), measure.alias("_m")).groupBy(*keys, "_slot").agg(F.sum("_m").alias("_m")).filter(F.col("_m") * 2 >= least)
    beside = F.explode(F.array(*[F.col("_slot") + i for i in (-1, 0, 1)])).alias("_slot")
    near = durable(full.select(*keys, beside).distinct())
    return rows.withColumn("_slot", slot).join(near, [*keys, "_slot"], "left_semi").drop("_slot")


def prune_slots(instants: DataFrame, keys, width_us: int, measure: str, limits: DataFrame, limit: Column) -> DataFrame:
    """Drop instants that cannot lie in a window reaching ``limit``.

    A window of one slot width touches its own aligned slot and the next, so the two slot
    totals bound it. Slots that pass are kept with their follower; on quiet data nearly
    everything goes before the timeline is built, and no answer changes.
    """
    d = instants.withColumn("_slot", F.floor(F.col("t") / F.lit(width_us)))
    slots = d.groupBy(*keys, "_slot").agg(F.sum(measure).alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_slot")
    follows = F.lead("_slot").over(w) == F.col("_slot") + 1
    both = F.col("_m") + F.when(follows, F.lead("_m").over(w)).otherwise(0)
    ok = slots.withColumn("_both", both).join(limits, keys).filter(F.col("_both") >= limit)
    keep = ok.select(*keys, F.explode(F.array(F.col("_slot"), F.col("_slot") + 1)).alias("_slot")).distinct()
    return d.join(keep, [*keys, "_slot"], "left_semi").drop("_slot")
