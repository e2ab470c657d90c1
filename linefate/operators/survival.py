"""Lifetimes of lines from their fates: population, left-out counts, follow-up, and exact-death curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLOCK_TOLERANCE, DAY, INSTANT, KNOWN_ALIVE, MOST_GROUPS


def with_entry(lines: DataFrame, commits: DataFrame) -> DataFrame:
    """``lines`` and entered_at: the time of the birth commit, or of the birth if that is later."""
    at = commits.select(F.col("sha").alias("__sha"), F.col("committed_at").alias("__at"))
    joined = lines.join(at, lines["birth_commit"] == F.col("__sha"), "left")
    return joined.withColumn("entered_at", F.greatest(F.coalesce("__at", "birth_ts"), "birth_ts")).drop("__sha", "__at")


def after_entry(observed_commit: Column, birth_commit: Column, before_first_commit: Column) -> Column:
    """Whether a fate came after the line's clock started."""
    return F.when(observed_commit.isNotNull(), ~observed_commit.eqNullSafe(birth_commit)).otherwise(~before_first_commit)


def histories(lines: DataFrame, fates: DataFrame, threshold: float | None = None) -> DataFrame:
    """``lines`` (with entered_at) and what survival needs of each one's fates, in one pass over them.

    early: a fate after entry lies long before it; dead: any fate is dead; revised_on_entry; death: the first fate in seq
    order after entry that counts as death, dead or, with a threshold, of a birth similarity below it.
    """
    return _histories(lines, fates, {"death": threshold})


def swept(lines: DataFrame, fates: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``histories`` under each of ``thresholds``, a row of a line for each, with its threshold; all in one pass over the fates."""
    names = {f"__death{k}": t for k, t in enumerate(thresholds)}
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(name).alias("death")) for name, t in names.items()])
    return _histories(lines, fates, names).withColumn("__each", F.explode(each)).select("*", "__each.*").drop("__each", *names)


def _histories(lines: DataFrame, fates: DataFrame, thresholds: dict[str, float | None]) -> DataFrame:
    """``histories`` with a column of deaths for each name of ``thresholds``."""
    keys = lines.select("line_id", "birth_commit", "entered_at")
    held = fates.join(keys, "line_id")
    counts = after_entry(F.col("observed_commit"), F.col("birth_commit"), F.col("before_first_commit"))
    dead = F.col("state") == "dead"
    dies = lambda t: dead if t is None else dead | F.coalesce(F.col("birth_similarity") < t, F.lit(False))
    found = held.groupBy("line_id").agg(
        F.bool_or(counts & (F.col("observed_at") < F.col("entered_at") - CLOCK_TOLERANCE)).alias("early"),
        F.bool_or(dead).alias("dead"),
        F.bool_or((F.col("state") == "edited") & F.coalesce(F.col("observed_commit") == F.col("birth_commit"), F.lit(False))).alias("revised_on_entry"),
        *[F.min_by(F.struct("previous_seen_at", "observed_at"), F.when(counts & dies(t), F.col("seq"))).alias(name) for name, t in thresholds.items()],
    )
    return lines.join(found, "line_id", "left").fillna(False, ["early", "dead", "revised_on_entry"])


def left_out(held: DataFrame) -> DataFrame:
    """One row: lines in the population and, of the others, why they are left out."""
    agent = F.col("session_id").isNotNull()
    no_commit = F.col("birth_commit").isNull()
    bad = F.col("early") | (~F.col("dead") & (F.col("last_seen_at") < F.col("entered_at") - CLOCK_TOLERANCE))
    return held.agg(
        F.count_if(~no_commit & F.col("birth_observed") & ~bad).alias("n_lines"),
        F.count_if(agent).alias("agent_written"),
        F.count_if(agent & no_commit & F.col("dead")).alias("agent_deleted_uncommitted"),
        F.count_if(agent & no_commit & ~F.col("dead")).alias("agent_pending"),
        F.count_if(~no_commit & ~F.col("birth_observed")).alias("already_there"),
        F.count_if(~no_commit & F.col("birth_observed") & bad).alias("inconsistent"),
    )


def population(held: DataFrame) -> DataFrame:
    """Lines whose lifetime is known: committed, seen at birth, and with times that don't run backwards."""
    bad = F.col("early") | (~F.col("dead") & (F.col("last_seen_at") < F.col("entered_at") - CLOCK_TOLERANCE))
    origin = F.when(F.col("session_id").isNull(), "human").when(F.col("revised_on_entry"), "agent_then_human_revised").otherwise("agent")
    return held.where(F.col("birth_commit").isNotNull() & F.col("birth_observed") & ~bad).withColumn("entry_origin", origin)


def lifetimes(pop: DataFrame) -> DataFrame:
    """``pop`` and its lifetime (left, right] in days since entry; right is infinite for a line still alive when last seen."""
    days = lambda at: (F.greatest(at, F.col("entered_at")) - F.col("entered_at")) / DAY
    right = days(F.col("death.observed_at"))
    left = F.least(days(F.coalesce("death.previous_seen_at", "entered_at")), right)
    died = F.col("death").isNotNull()
    return pop.withColumn("left", F.when(died, F.when(left < right, left).otherwise(right - INSTANT)).otherwise(days(F.col("last_seen_at")))).withColumn("right", F.when(died, right).otherwise(F.lit(float("inf"))))


def grouped(observed: DataFrame, *by: str) -> DataFrame:
    """Identical lifetimes once, with their number as weight."""
    return observed.groupBy(*by, "left", "right").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def follow_up(observed: DataFrame, *by: str, known: int = KNOWN_ALIVE) -> DataFrame:
    """Of each group: lines, deaths, longest follow-up, last age known alive, and the age up to which its curve is drawn.

    The last is the ``known``-th greatest left end, at most the follow-up; 0 with fewer lines. It comes from the grouped
    left ends, so no list of lines is gathered.
    """
    finite = F.col("right") < float("inf")
    base = observed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(finite).alias("deaths"),
        F.greatest(F.max(F.when(finite, F.col("right")).otherwise(F.col("left"))), F.lit(0.0)).alias("follow_up"),
        F.greatest(F.max("left"), F.lit(0.0)).alias("known_until"),
    )
    ends = observed.groupBy(*by, "left").agg(F.count(F.lit(1)).alias("w"))
    at_least = F.sum("w").over(Window.partitionBy(*by).orderBy(F.desc("left")))
    nth = ends.withColumn("k", at_least).where(F.col("k") >= known).groupBy(*by).agg(F.max("left").alias("nth"))
    joined = base.join(nth, list(by), "left") if by else base.crossJoin(nth)  # one row each
    return joined.withColumn("drawable", F.coalesce(F.greatest(F.least("nth", "follow_up"), F.lit(0.0)), F.lit(0.0))).drop("nth")


def known_alive(observed: DataFrame, ages: list[float], *by: str) -> DataFrame:
    """(by, age, n): how many lines were known to be alive at each age."""
    counts = [F.count_if(F.col("left") >= a).alias(f"a{k}") for k, a in enumerate(ages)]
    wide = observed.groupBy(*by).agg(*counts)
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(float(a)).alias("age"), F.col(f"a{k}").alias("n")) for k, a in enumerate(ages)])).alias("x")).select(*by, "x.age", "x.n")


def top_groups(pop: DataFrame, key: Column, most: int = MOST_GROUPS) -> DataFrame:
    """(key, group): groups by size, then name; beyond ``most``, all but the first ``most`` - 1 are ``other``.

    Only the first ``most`` + 1 groups are ranked and broadcast, however many there are.
    """
    sizes = pop.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), "key").limit(most + 1)
    ranked = first.select(F.col("key").alias("__key"), F.row_number().over(Window.orderBy(F.desc("n"), "key")).alias("__rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__held"))
    kept = ranked.where((F.col("__held") <= most) | (F.col("__rank") <= most - 1)).withColumn("__kept", F.lit(True))
    joined = sizes.join(F.broadcast(kept), F.col("key").eqNullSafe(F.col("__key")), "left")
    return joined.select("key", "n", F.when(F.col("__kept"), F.col("key").cast("string")).otherwise("other").alias("group"))


def confounded(pop: DataFrame, origin: str = "origin") -> DataFrame:
    """One row: whether lines of agents and of people are compared, which differ in more than who wrote them."""
    has = lambda name: F.coalesce(F.bool_or(F.col(origin) == name), F.lit(False))
    return pop.agg((has("agent") & has("human")).alias("confounded"))


def innermost_intervals(observed: DataFrame, *by: str) -> DataFrame:
    """(by, start, end): every left end followed, with no other end between, by a right end; at a tie right ends come first.

    Distinct ends only, so the window's rows are bounded by the distinct lifetimes.
    """
    ends = observed.select(*by, F.col("left").alias("v"), F.lit(0).alias("is_right")).unionByName(observed.select(*by, F.col("right").alias("v"), F.lit(1).alias("is_right"))).distinct()
    w = Window.partitionBy(*by).orderBy("v", F.desc("is_right"))
    marked = ends.withColumn("before", F.lag("v").over(w)).withColumn("was_left", F.lag("is_right").over(w) == 0)
    return marked.where((F.col("is_right") == 1) & F.col("was_left")).select(*by, F.col("before").alias("start"), F.col("v").alias("end"))


def kaplan_meier(observed: DataFrame, *by: str) -> DataFrame:
    """(by, t, at_risk, deaths, survival) at each time with exact deaths; censored ties are at risk.

    A lifetime is (time, died): the right end if finite, else the left. Times are aggregated first.
    """
    time = F.when(F.col("right") < float("inf"), F.col("right")).otherwise(F.col("left"))
    counts = observed.groupBy(*by, time.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("right") < float("inf")).alias("deaths"))
    later = Window.partitionBy(*by).orderBy(F.desc("t"))
    upto = Window.partitionBy(*by).orderBy("t")
    risk = counts.withColumn("at_risk", F.sum("n").over(later)).where("deaths > 0")
    gone = F.max(F.when(F.col("deaths") == F.col("at_risk"), 1).otherwise(0)).over(upto) == 1
    log = F.sum(F.when(F.col("deaths") < F.col("at_risk"), F.ln(1 - F.col("deaths") / F.col("at_risk"))).otherwise(F.lit(0.0))).over(upto)
    return risk.withColumn("survival", F.when(gone, F.lit(0.0)).otherwise(F.exp(log))).select(*by, "t", "at_risk", "deaths", "survival")


def km_median(curve: DataFrame, *by: str) -> DataFrame:
    """(by, median): the first time at which survival is one half or less; null if it is never reached."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))
