"""Numeric series: peaks, onsets, stills, faults, moves, thresholds, envelopes and fits, over each user's events.

A series is a user's event values in order, floored, as levels 0, 1, 2, ...  Kernels are window functions; none collects a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tessella.operators import intervals
from tessella.operators.asof import asof
from tessella.operators.islands import islands
from tessella.operators.prefix import at_ranks
from tessella.sources.views import WORDS_SQL, table, words

BY = ["user_id"]
QUIET, LOUD = 40, 10
#: Families of easing curves as powers of what is still to go: value = 1 - (1 - t)^power; "in" is the reverse.
EASES = {"linear": 1, "quad": 2, "cubic": 3, "quart": 4}
#: Durations that a fit tries: so many equal parts of a series.
EASE_STEPS = 32


def in_order() -> WindowSpec:
    return W.partitionBy("user_id").orderBy("i")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i from 0, v, w): two aligned series of whole numbers."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    number = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return rows.select("user_id", number.cast("long").alias("i"), F.floor("value").cast("long").alias("v"), (F.col("event_id") * 37 % 200).cast("long").alias("w"))


LEVELS_SQL = "levels AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CAST(floor(value) AS BIGINT) AS v, event_id * 37 % 200 AS w FROM events WHERE value IS NOT NULL)"


def steps(rows: DataFrame) -> DataFrame:
    """rows with dv and dw: each value less the one before it; null at the start."""
    return rows.withColumn("dv", F.col("v") - F.lag("v").over(in_order())).withColumn("dw", F.col("w") - F.lag("w").over(in_order()))


_STEPS_SQL = f"{LEVELS_SQL}, steps AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY i) AS dv, w - lag(w) OVER (PARTITION BY user_id ORDER BY i) AS dw FROM levels)"


def _median(sorted_: Column) -> Column:
    n = F.size(sorted_)
    return F.when(n > 0, (F.element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_, (F.floor(n / 2) + 1).cast("int"))) / 2)


def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that none within three places exceeds and that are above 1.5 times the median of those places."""
    rows = levels(spark, sf_dir)
    around = F.concat(F.collect_list("v").over(in_order().rowsBetween(-3, -1)), F.collect_list("v").over(in_order().rowsBetween(1, 3)))
    rows = rows.withColumn("near", F.array_sort(around)).withColumn("base", _median(F.col("near")))
    return rows.where((F.size("near") > 0) & (F.col("v") >= F.element_at("near", -1)) & (F.col("v") > F.greatest(F.col("base") * 1.5, F.lit(1.5)))).select("user_id", "i", "v", "base")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values three median deviations or more above the running median of eight places either side, and the largest within two."""
    wide = in_order().rowsBetween(-8, 8)
    rows = levels(spark, sf_dir).withColumn("near", F.collect_list("v").over(wide)).withColumn("top", F.max("v").over(in_order().rowsBetween(-2, 2))).where("v = top")
    found = F.transform(F.array(F.sort_array("near")), lambda near: F.struct(near.alias("near"), _median(near).alias("middle")))  # each step is made once and then used several times
    found = F.transform(found, lambda x: F.struct(x["middle"].alias("middle"), F.sort_array(F.transform(x["near"], lambda v: F.abs(v - x["middle"]))).alias("away")))
    found = F.transform(found, lambda x: F.struct(x["middle"].alias("middle"), _median(x["away"]).alias("spread")))
    return rows.select("user_id", "i", "v", F.inline(found)).where("spread > 0 and v - middle >= 3 * spread")


def frozen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in which one series stands still while the other moves."""
    rows = steps(levels(spark, sf_dir)).withColumn("frozen", F.coalesce((F.abs("dv") <= 12) & (F.abs("dw") >= 30), F.lit(False)))
    runs = islands(rows, BY, ["i"], ~F.lag("frozen").over(in_order()).eqNullSafe(F.col("frozen")), "run").where("frozen")
    return runs.groupBy("user_id", "run").agg(F.min("i").alias("first"), F.count("*").alias("length")).drop("run")


def flashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value far from both neighbours, which are near each other, while the other series changes by less than half as much."""
    rows = levels(spark, sf_dir)
    before, after = F.lag("v").over(in_order()), F.lead("v").over(in_order())
    side = F.least(F.abs(F.col("v") - before), F.abs(after - F.col("v")))
    under = F.least(F.abs(F.col("w") - F.lag("w").over(in_order())), F.abs(F.lead("w").over(in_order()) - F.col("w")))
    rows = rows.select("user_id", "i", side.alias("side"), F.abs(after - before).alias("back"), under.alias("under"))
    return rows.where("side >= 40 and 2 * back < side and 2 * under < side").select("user_id", "i", "side")


def dark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of values under 20 where the other series is at 20 or more."""
    rows = levels(spark, sf_dir).withColumn("dark", (F.col("v") < 20) & (F.col("w") >= 20))
    runs = islands(rows, BY, ["i"], ~F.lag("dark").over(in_order()).eqNullSafe(F.col("dark")), "run").where("dark")
    return runs.groupBy("user_id", "run").agg(F.min("i").alias("first"), F.count("*").alias("length")).drop("run")


def hard_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of 40 or more that are twice every step within three places: cuts; of 15 to 40 and three times: jumps."""
    rows = steps(levels(spark, sf_dir)).withColumn("d", F.abs("dv"))
    peak = F.greatest(F.max("d").over(in_order().rowsBetween(-3, -1)), F.max("d").over(in_order().rowsBetween(1, 3)))
    rows = rows.withColumn("peak", F.coalesce(peak, F.lit(0)))
    kind = F.when((F.col("d") >= 40) & (F.col("d") >= 2 * F.col("peak")), "cut").when((F.col("d") >= 15) & (F.col("d") < 40) & (F.col("d") >= 3 * F.greatest(F.col("peak"), F.lit(1))), "jump")
    return rows.withColumn("kind", kind).where("kind is not null").select("user_id", "i", "kind", "d", "peak")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four or more steps of at least 15 that end 20 or more from where they began."""
    rows = steps(levels(spark, sf_dir)).withColumn("from", F.lag("v").over(in_order())).withColumn("moving", F.coalesce(F.abs("dv") >= 15, F.lit(False)))
    runs = islands(rows, BY, ["i"], ~F.lag("moving").over(in_order()).eqNullSafe(F.col("moving")), "run").where("moving")
    runs = runs.groupBy("user_id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min_by("from", "i").alias("a"), F.max_by("v", "i").alias("b"))
    return runs.where("last - first >= 3 and abs(b - a) >= 20").select("user_id", "first", "last", (F.col("b") - F.col("a")).alias("moved"))


def _one_way_runs(rows: DataFrame) -> DataFrame:
    """Runs of steps with one sign, steps of 0 passed over: (user_id, nr, way, steps, first, from, last, speed of the first and of the last step)."""
    rows = steps(rows).withColumn("start", F.lag("v").over(in_order())).where("dv != 0").withColumn("way", F.signum("dv").cast("int"))
    rows = islands(rows, BY, ["i"], F.lag("way").over(in_order()) != F.col("way"), "nr")
    return rows.groupBy("user_id", "nr", "way").agg(F.count("*").alias("steps"), F.min("i").alias("first"), F.max("i").alias("last"), F.min_by(F.abs("dv"), "i").alias("speed_in"), F.max_by(F.abs("dv"), "i").alias("speed_out"), F.sum("dv").alias("moved"))


_WAYS_SQL = f"""{_STEPS_SQL}, ways AS (SELECT *, CAST(sign(dv) AS INT) AS way FROM steps WHERE dv <> 0),
turned AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS nr FROM (SELECT *, CASE WHEN lag(way) OVER (PARTITION BY user_id ORDER BY i) IS DISTINCT FROM way THEN 1 ELSE 0 END AS turn FROM ways)),
runs AS (SELECT user_id, nr, way, count(*) AS steps, min(i) AS first, max(i) AS last, arg_min(abs(dv), i) AS speed_in, arg_max(abs(dv), i) AS speed_out, CAST(sum(dv) AS BIGINT) AS moved FROM turned GROUP BY user_id, nr, way)"""


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more steps in one direction."""
    return _one_way_runs(levels(spark, sf_dir)).where("steps >= 2").select("user_id", "first", "last", "steps", "moved")


def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns at speed: two steps or more on each side, the slower of the two speeds at the turn a quarter of the user's peak or more."""
    rows = levels(spark, sf_dir)
    peak = steps(rows).groupBy("user_id").agg(F.max(F.abs("dv")).alias("peak"))
    runs = _one_way_runs(rows)
    w = W.partitionBy("user_id").orderBy("nr")
    turns = runs.withColumn("before", F.lag("steps").over(w)).withColumn("speed", F.least(F.lag("speed_out").over(w), F.col("speed_in"))).join(peak, "user_id")
    return turns.where("before >= 2 and steps >= 2 and speed >= 1 and 4 * speed >= peak").select("user_id", F.col("first").alias("i"), "speed", "peak")


def speed_and_jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest speed, change of speed and jerk between consecutive keys (every fourth value)."""
    keys = levels(spark, sf_dir).where("i % 4 = 0")
    for name, of in (("speed", "v"), ("turn", "speed"), ("jerk", "turn")):
        keys = keys.withColumn(name, F.col(of) - F.lag(of).over(in_order()))
    return keys.groupBy("user_id").agg(*[F.max(F.abs(c)).alias(c) for c in ("speed", "turn", "jerk")], F.count("jerk").alias("n"))


def audible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around every tenth place: the last one at or before it above the quiet level, and the first from it on within five."""
    rows = levels(spark, sf_dir)
    points, loud = rows.where("i % 10 = 0").select("user_id", F.col("i").alias("t")), rows.where(F.col("v") > QUIET).select("user_id", F.col("i").alias("at"))
    found = asof(points, loud, BY, "t", "at", "at").select("user_id", "t", F.col("found.at").alias("ended"))
    found = asof(found, loud, BY, "t", "at", "at", "forward")
    return found.select("user_id", "t", "ended", F.when(F.col("found.at") < F.col("t") + 5, F.col("found.at")).alias("starts"))


def noise_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the 99th level as speech, the commonest level at least 10 under it as floor (ties: the lowest), and the threshold between; with under 20 between them a third of the way up from the tenth level."""
    rows = levels(spark, sf_dir)
    speech = at_ranks(rows, BY, "v", 50, {"speech": F.least(F.col("n") - 1, F.floor(F.lit(0.99) * F.col("n"))), "bed": F.floor(F.lit(0.1) * (F.col("n") - 1))})
    counts = rows.groupBy("user_id", "v").agg(F.count("*").alias("n")).join(speech, "user_id").where("v < speech - 10")
    floor = counts.groupBy("user_id").agg((-F.max(F.struct("n", (-F.col("v")).alias("v")))["v"]).alias("floor"))
    found = speech.join(floor, "user_id")
    near = F.col("speech") - F.col("floor") < 20
    return found.select("user_id", "speech", "floor", F.when(near, F.floor((F.col("bed") * 2 + F.col("speech")) / 3)).otherwise(F.greatest(F.col("speech") - 26, F.col("floor") + 6)).cast("long").alias("noise"))


def window_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each 12 values: the mean of those above the user's median less 15 (all, if there are none), less that median."""
    rows = levels(spark, sf_dir)
    middle = at_ranks(rows, BY, "v", 50, {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}).select("user_id", ((F.col("low") + F.col("high")) / 2).alias("median"))
    rows = rows.join(middle, "user_id").withColumn("part", F.floor(F.col("i") / 12))
    loud = F.col("v") > F.col("median") - 15
    found = rows.groupBy("user_id", "part").agg(F.coalesce(F.sum(F.when(loud, F.col("v"))) / F.count_if(loud), F.sum("v") / F.count("*")).alias("mean"), F.first("median").alias("median"))
    return found.select("user_id", "part", (F.col("mean") - F.col("median")).alias("energy"))


def edges_in_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh place is an edge: those with both windows beside it more than LOUD above the quiet level."""
    rows = levels(spark, sf_dir).withColumn("before", F.lag("v").over(in_order()))
    return rows.where(F.col("i") % 7 == 0).where(F.least("before", "v") > QUIET + LOUD).where("before is not null").select("user_id", "i")


def histogram_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the histogram (bins of 25) of each 20 values is from that of the 20 before: the sum of differences in hundredths of their sizes, rounded half up, in whole numbers throughout."""
    bins = levels(spark, sf_dir).groupBy("user_id", F.floor(F.col("i") / 20).alias("part"), F.floor(F.col("v") / 25).alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.withColumn("size", F.sum("n").over(W.partitionBy("user_id", "part")))
    sizes = bins.select("user_id", "part", "size").distinct()
    both = sizes.join(sizes.select("user_id", (F.col("part") + 1).alias("part"), F.col("size").alias("size_before")), ["user_id", "part"])
    after = bins.select("user_id", (F.col("part") + 1).alias("part"), "bin", F.col("n").alias("was"))
    found = bins.drop("size").join(after, ["user_id", "part", "bin"], "full_outer").join(both, ["user_id", "part"])
    apart = F.sum(F.abs(F.coalesce("n", F.lit(0)) * F.col("size_before") - F.coalesce("was", F.lit(0)) * F.col("size")))
    found = found.groupBy("user_id", "part", "size", "size_before").agg(apart.alias("apart"))
    return found.select("user_id", "part", F.expr("(200 * apart + size * size_before) div (2 * size * size_before)").alias("jump"))


def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag from 2 to 8 at which rises repeat best (sum of products; ties: the shortest), and the phase at which most of the rises lie."""
    rows = steps(levels(spark, sf_dir)).withColumn("rise", F.when(F.col("dv").isNotNull(), F.greatest("dv", F.lit(0))))
    rows = rows.select("user_id", "i", "rise", *[(F.col("rise") * F.lag("rise", k).over(in_order())).alias(f"p{k}") for k in range(2, 9)])
    sums = rows.groupBy("user_id").agg(*[F.coalesce(F.sum(f"p{k}"), F.lit(0)).alias(f"p{k}") for k in range(2, 9)])
    best = sums.select("user_id", F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("score"), F.lit(-k).alias("lag")) for k in range(2, 9)])).alias("x")).select("user_id", F.col("x.score").alias("score"), (-F.col("x.lag")).cast("long").alias("lag"))
    phases = rows.join(best, "user_id").groupBy("user_id", "lag", "score", (F.col("i") % F.col("lag")).alias("phase")).agg(F.coalesce(F.sum("rise"), F.lit(0)).alias("weight"))
    return phases.groupBy("user_id", "lag", "score").agg((-F.max(F.struct("weight", (-F.col("phase")).alias("phase")))["phase"]).alias("phase"))


def projection_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the second series is in the first: the sum of products over the second's sum of squares; null if that is 0."""
    return levels(spark, sf_dir).groupBy("user_id").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0))).alias("gain"))


def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place where the running sum reaches 80% of the whole."""
    rows = levels(spark, sf_dir).withColumn("upto", F.sum("v").over(in_order().rowsBetween(W.unboundedPreceding, 0))).withColumn("whole", F.sum("v").over(W.partitionBy("user_id")))
    return rows.where("upto * 5 >= whole * 4").groupBy("user_id").agg(F.min("i").alias("landed"), F.first("whole").alias("whole"))


def ease_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve that best fits each user's running maxima as a way from 0 to 1: over families and durations (in 32 steps of the series), the least squared error; none where it lands at once.

    Curve and way are in thousandths, so errors are whole numbers and their order doesn't matter."""
    rows = levels(spark, sf_dir).withColumn("top", F.max("v").over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy("user_id").agg(F.min("top").alias("a"), F.max("top").alias("b"), F.count("*").alias("n")).where("n >= 4 and b > a")
    grid = F.explode(F.array(*[F.struct(F.lit(name).alias("ease"), F.lit(power).alias("power"), F.lit(d).alias("part")) for name, power in EASES.items() for d in range(1, EASE_STEPS + 1)])).alias("g")
    rows = rows.join(ends, "user_id").select("user_id", "i", F.expr("1000 * (top - a) div (b - a)").alias("p"), "n", grid).select("user_id", "i", "p", "n", "g.*")
    rows = rows.withColumn("duration", F.greatest(F.lit(1), F.expr(f"n * part div {EASE_STEPS}")))
    rows = rows.withColumn("left", 1000 - F.least(F.lit(1000), F.expr("1000 * i div duration")))
    raised = F.expr("CASE power WHEN 1 THEN left WHEN 2 THEN left * left div 1000 WHEN 3 THEN left * left * left div 1000000 ELSE left * left * left * left div 1000000000 END")
    errors = rows.groupBy("user_id", "ease", "power", "part", "duration").agg(F.sum((1000 - raised - F.col("p")) * (1000 - raised - F.col("p"))).alias("error"))
    best = errors.groupBy("user_id").agg(F.min(F.struct("error", "power", "duration", "ease")).alias("x"))
    return best.select("user_id", F.when(F.col("x.duration") <= 1, "none").otherwise(F.col("x.ease")).alias("ease"), F.when(F.col("x.duration") <= 1, 0).otherwise(F.col("x.duration")).cast("long").alias("duration"), "x.error")


def camera_path(spark: SparkSession, sf_dir: str, gap: int = 5) -> DataFrame:
    """Every fifth value is a key: in between, the way from one to the next with a slow start and end, in thousandths."""
    rows = levels(spark, sf_dir)
    rows = rows.withColumn("a", F.last(F.when(F.col("i") % gap == 0, F.col("v")), ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.coalesce(F.first(F.when(F.col("i") % gap == 0, F.col("v")), ignorenulls=True).over(in_order().rowsBetween(1, W.unboundedFollowing)), F.col("a")))
    k = F.col("i") % gap  # t = k / gap; t * t * (3 - 2 t) in whole numbers
    share = F.floor(k * k * (3 * gap - 2 * k) * 1000 / gap**3)
    return rows.select("user_id", "i", (F.col("a") * 1000 + (F.col("b") - F.col("a")) * share).cast("long").alias("at"))


def voice_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words widened by 80 ms, and gaps up to 250 ms closed: how many stretches of voice, and how long."""
    rows = words(spark, sf_dir).select("conv_id", (F.col("start_ms") - 80).alias("b"), (F.col("end_ms") + 80).alias("e"))
    return intervals.union(rows, ["conv_id"], 250, 600_000).groupBy("conv_id").agg(F.count("*").alias("stretches"), F.sum(F.col("e") - F.col("b")).alias("ms"))


def gain_needed(spark: SparkSession, sf_dir: str, target: int = 120, ceiling: int = 190) -> DataFrame:
    """What to add for the mean level to reach a target without the peak passing a ceiling."""
    found = levels(spark, sf_dir).groupBy("user_id").agg(F.floor(F.sum("v") / F.count("*")).alias("level"), F.max("v").alias("peak"))
    return found.select("user_id", "level", "peak", F.least(target - F.col("level"), ceiling - F.col("peak")).alias("gain"))


QUERIES = {q.__name__: q for q in (local_peaks, onsets, frozen_runs, flashes, dark_runs, hard_cuts, moves, pushes, jitter, speed_and_jerk, audible_edges, noise_thresholds, window_energy, edges_in_speech, histogram_jumps, tempo, projection_gain, landings, ease_fits, camera_path, voice_mask, gain_needed)}

_O = "(PARTITION BY user_id ORDER BY i)"


def _runs_sql(flag: str, more: str = "") -> str:
    return f"""flagged AS (SELECT *, {flag} AS on_ FROM steps), changed AS (SELECT *, CASE WHEN lag(on_) OVER {_O} IS DISTINCT FROM on_ THEN 1 ELSE 0 END AS c FROM flagged),
        numbered AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run{more} FROM changed)"""


def _frame(a: str, b: str) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN {a} AND {b})"


def _middle_sql(list_: str) -> str:
    return f"(list_sort({list_})[(len({list_}) + 1) // 2] + list_sort({list_})[len({list_}) // 2 + 1]) / 2"


ORACLE_SQL = {
    "local_peaks": f"""WITH {LEVELS_SQL}, n AS (SELECT *, list_concat(coalesce(list(v) {_frame('3 PRECEDING', '1 PRECEDING')}, []), coalesce(list(v) {_frame('1 FOLLOWING', '3 FOLLOWING')}, [])) AS near FROM levels), m AS (SELECT *, {_middle_sql('near')} AS base FROM n)
        SELECT user_id, i, v, base FROM m WHERE len(near) > 0 AND v >= list_max(near) AND v > greatest(base * 1.5, 1.5)""",
    "onsets": f"""WITH {LEVELS_SQL}, n AS (SELECT *, list(v) {_frame('8 PRECEDING', '8 FOLLOWING')} AS near, max(v) {_frame('2 PRECEDING', '2 FOLLOWING')} AS top FROM levels), m AS (SELECT *, {_middle_sql('near')} AS middle FROM n),
        d AS (SELECT *, list_transform(near, lambda x: abs(x - middle)) AS away FROM m), s AS (SELECT *, {_middle_sql('away')} AS spread FROM d) SELECT user_id, i, v, middle, spread FROM s WHERE spread > 0 AND v = top AND v - middle >= 3 * spread""",
    "frozen_runs": f"WITH {_STEPS_SQL}, {_runs_sql('coalesce(abs(dv) <= 12 AND abs(dw) >= 30, false)')} SELECT user_id, min(i) AS first, count(*) AS length FROM numbered WHERE on_ GROUP BY user_id, run",
    "flashes": f"""WITH {LEVELS_SQL}, s AS (SELECT user_id, i, least(abs(v - lag(v) OVER {_O}), abs(lead(v) OVER {_O} - v)) AS side, abs(lead(v) OVER {_O} - lag(v) OVER {_O}) AS back, least(abs(w - lag(w) OVER {_O}), abs(lead(w) OVER {_O} - w)) AS under FROM levels)
        SELECT user_id, i, side FROM s WHERE side >= 40 AND 2 * back < side AND 2 * under < side""",
    "dark_runs": f"WITH {_STEPS_SQL}, {_runs_sql('v < 20 AND w >= 20')} SELECT user_id, min(i) AS first, count(*) AS length FROM numbered WHERE on_ GROUP BY user_id, run",
    "hard_cuts": f"""WITH {_STEPS_SQL}, p AS (SELECT user_id, i, abs(dv) AS d, coalesce(greatest(max(abs(dv)) {_frame('3 PRECEDING', '1 PRECEDING')}, max(abs(dv)) {_frame('1 FOLLOWING', '3 FOLLOWING')}), 0) AS peak FROM steps),
        k AS (SELECT *, CASE WHEN d >= 40 AND d >= 2 * peak THEN 'cut' WHEN d >= 15 AND d < 40 AND d >= 3 * greatest(peak, 1) THEN 'jump' END AS kind FROM p) SELECT user_id, i, kind, d, peak FROM k WHERE kind IS NOT NULL""",
    "moves": f"""WITH {_STEPS_SQL}, {_runs_sql('coalesce(abs(dv) >= 15, false)')}, r AS (SELECT user_id, min(i) AS first, max(i) AS last, arg_min(v - dv, i) AS a, arg_max(v, i) AS b FROM numbered WHERE on_ GROUP BY user_id, run)
        SELECT user_id, first, last, b - a AS moved FROM r WHERE last - first >= 3 AND abs(b - a) >= 20""",
    "pushes": f"WITH {_WAYS_SQL} SELECT user_id, first, last, steps, moved FROM runs WHERE steps >= 2",
    "jitter": f"""WITH {_WAYS_SQL}, t AS (SELECT user_id, first AS i, steps, lag(steps) OVER o AS before, least(lag(speed_out) OVER o, speed_in) AS speed FROM runs WINDOW o AS (PARTITION BY user_id ORDER BY nr)), p AS (SELECT user_id, max(abs(dv)) AS peak FROM steps GROUP BY 1)
        SELECT user_id, i, speed, peak FROM t JOIN p USING (user_id) WHERE before >= 2 AND steps >= 2 AND speed >= 1 AND 4 * speed >= peak""",
    "speed_and_jerk": f"""WITH {LEVELS_SQL}, a AS (SELECT *, v - lag(v) OVER {_O} AS speed FROM levels WHERE i % 4 = 0), b AS (SELECT *, speed - lag(speed) OVER {_O} AS turn FROM a), c AS (SELECT *, turn - lag(turn) OVER {_O} AS jerk FROM b)
        SELECT user_id, max(abs(speed)) AS speed, max(abs(turn)) AS turn, max(abs(jerk)) AS jerk, count(jerk) AS n FROM c GROUP BY user_id""",
    "audible_edges": f"""WITH {LEVELS_SQL} SELECT p.user_id, p.i AS t, (SELECT max(l.i) FROM levels l WHERE l.user_id = p.user_id AND l.i <= p.i AND l.v > {QUIET}) AS ended,
        (SELECT min(l.i) FROM levels l WHERE l.user_id = p.user_id AND l.i >= p.i AND l.i < p.i + 5 AND l.v > {QUIET}) AS starts FROM levels p WHERE p.i % 10 = 0""",
    "noise_thresholds": f"""WITH {LEVELS_SQL}, s AS (SELECT user_id, list_sort(list(v)) AS l, count(*) AS n FROM levels GROUP BY 1), t AS (SELECT user_id, l[CAST(least(n - 1, floor(0.99::DOUBLE * n)) AS BIGINT) + 1] AS speech, l[CAST(floor(0.1::DOUBLE * (n - 1)) AS BIGINT) + 1] AS bed FROM s),
        c AS (SELECT user_id, v, count(*) AS n FROM levels GROUP BY 1, 2), f AS (SELECT user_id, v AS floor, speech, bed FROM c JOIN t USING (user_id) WHERE v < speech - 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) = 1)
        SELECT user_id, speech, floor, CAST(CASE WHEN speech - floor < 20 THEN floor((bed * 2 + speech) / 3) ELSE greatest(speech - 26, floor + 6) END AS BIGINT) AS noise FROM f""",
    "window_energy": f"""WITH {LEVELS_SQL}, m AS (SELECT user_id, median(v) AS median FROM levels GROUP BY 1)
        SELECT user_id, i // 12 AS part, coalesce(CAST(sum(v) FILTER (WHERE v > median - 15) AS BIGINT) / count(*) FILTER (WHERE v > median - 15), CAST(sum(v) AS BIGINT) / count(*)) - any_value(median) AS energy FROM levels JOIN m USING (user_id) GROUP BY 1, 2""",
    "edges_in_speech": f"WITH {LEVELS_SQL}, b AS (SELECT *, lag(v) OVER {_O} AS before FROM levels) SELECT user_id, i FROM b WHERE i % 7 = 0 AND before > {QUIET + LOUD} AND v > {QUIET + LOUD}",
    "histogram_jumps": f"""WITH {LEVELS_SQL}, b AS (SELECT user_id, i // 20 AS part, v // 25 AS bin, count(*) AS n FROM levels GROUP BY 1, 2, 3), z AS (SELECT user_id, part, CAST(sum(n) AS BIGINT) AS size FROM b GROUP BY 1, 2),
        y AS (SELECT z.user_id, z.part, z.size, p.size AS before FROM z JOIN z p ON p.user_id = z.user_id AND p.part = z.part - 1),
        a AS (SELECT user_id, part, bin, n AS now_, 0 AS was FROM b UNION ALL SELECT user_id, part + 1, bin, 0, n FROM b), d AS (SELECT user_id, part, bin, CAST(sum(now_) AS BIGINT) AS now_, CAST(sum(was) AS BIGINT) AS was FROM a GROUP BY 1, 2, 3)
        SELECT user_id, part, CAST((200 * sum(abs(now_ * before - was * size)) + size * before) // (2 * size * before) AS BIGINT) AS jump FROM d JOIN y USING (user_id, part) GROUP BY user_id, part, size, before""",
    "tempo": f"""WITH {_STEPS_SQL}, r AS (SELECT user_id, i, CASE WHEN dv IS NULL THEN NULL ELSE greatest(dv, 0) END AS rise FROM steps), k AS (SELECT unnest(range(2, 9)) AS lag),
        p AS (SELECT a.user_id, k.lag, CAST(coalesce(sum(a.rise * b.rise), 0) AS BIGINT) AS score FROM r a CROSS JOIN k LEFT JOIN r b ON b.user_id = a.user_id AND b.i = a.i - k.lag GROUP BY 1, 2),
        o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, lag) = 1), h AS (SELECT user_id, lag, score, i % lag AS phase, coalesce(sum(rise), 0) AS weight FROM r JOIN o USING (user_id) GROUP BY 1, 2, 3, 4)
        SELECT user_id, lag, score, phase FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, phase) = 1""",
    "projection_gain": f"WITH {LEVELS_SQL} SELECT user_id, CAST(sum(v * w) AS BIGINT) / nullif(CAST(sum(w * w) AS BIGINT), 0) AS gain FROM levels GROUP BY user_id",
    "landings": f"""WITH {LEVELS_SQL}, u AS (SELECT user_id, i, sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(v) OVER (PARTITION BY user_id) AS whole FROM levels)
        SELECT user_id, min(i) AS landed, CAST(any_value(whole) AS BIGINT) AS whole FROM u WHERE upto * 5 >= whole * 4 GROUP BY user_id""",
    "ease_fits": f"""WITH {LEVELS_SQL}, t AS (SELECT user_id, i, max(v) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS top FROM levels), e AS (SELECT user_id, min(top) AS a, max(top) AS b, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 4 AND max(top) > min(top)),
        g AS (SELECT * FROM (VALUES {', '.join(f"('{name}', {power})" for name, power in EASES.items())}) f(ease, power) CROSS JOIN (SELECT unnest(range(1, {EASE_STEPS + 1})) AS part)),
        m AS (SELECT user_id, ease, power, part, greatest(1, n * part // {EASE_STEPS}) AS duration, i, 1000 * (top - a) // (b - a) AS p FROM t JOIN e USING (user_id) CROSS JOIN g), l AS (SELECT *, 1000 - least(1000, 1000 * i // duration) AS l FROM m),
        x AS (SELECT *, 1000 - CASE power WHEN 1 THEN l WHEN 2 THEN l * l // 1000 WHEN 3 THEN l * l * l // 1000000 ELSE l * l * l * l // 1000000000 END - p AS x FROM l), s AS (SELECT user_id, ease, power, part, duration, CAST(sum(x * x) AS BIGINT) AS error FROM x GROUP BY 1, 2, 3, 4, 5)
        SELECT user_id, CASE WHEN duration <= 1 THEN 'none' ELSE ease END AS ease, CASE WHEN duration <= 1 THEN 0 ELSE duration END AS duration, error FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY error, power, duration, ease) = 1""",
    "camera_path": f"""WITH {LEVELS_SQL}, k AS (SELECT a.user_id, a.i, a.i % 5 AS k, x.v AS a, coalesce(y.v, x.v) AS b FROM levels a JOIN levels x ON x.user_id = a.user_id AND x.i = a.i - a.i % 5 LEFT JOIN levels y ON y.user_id = a.user_id AND y.i = a.i - a.i % 5 + 5)
        SELECT user_id, i, CAST(a * 1000 + (b - a) * floor(k * k * (15 - 2 * k) * 1000 / 125) AS BIGINT) AS at FROM k""",
    "voice_mask": f"""WITH {WORDS_SQL}, p AS (SELECT conv_id, start_ms - 80 AS b, end_ms + 80 AS e, max(end_ms + 80) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, idx FROM words),
        r AS (SELECT *, sum(CASE WHEN pe IS NULL OR b > pe + 250 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM p), s AS (SELECT conv_id, run, max(e) - min(b) AS ms FROM r GROUP BY 1, 2) SELECT conv_id, count(*) AS stretches, CAST(sum(ms) AS BIGINT) AS ms FROM s GROUP BY 1""",
    "gain_needed": f"WITH {LEVELS_SQL}, g AS (SELECT user_id, CAST(floor(CAST(sum(v) AS BIGINT) / count(*)) AS BIGINT) AS level, max(v) AS peak FROM levels GROUP BY 1) SELECT user_id, level, peak, least(120 - level, 190 - peak) AS gain FROM g",
}
