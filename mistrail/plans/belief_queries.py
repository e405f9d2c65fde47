"""Queries on what an observer may believe (H) and how good such beliefs are (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.functions.filtering import LATTICE, MODELS, BeliefModel
from mistrail.operators.belief import LEVELS, SCORES, WHOLE, Reading, belief_sums, beliefs
from mistrail.operators.time_joins import as_of
from mistrail.plans import base
from mistrail.plans.ground_queries import ground
from mistrail.plans.resolution import _DOWNS, downs
from mistrail.plans.vision import _PROBES, _TICKS, _WALKED, CELL, SIDE, all_spans, probes, walked_cells
from mistrail.sources.tables import table

QUERIES, SQL = {}, {}
BIN = base.MAP_SIDE / LATTICE
#: Mass that a bin keeps when a histogram is smoothed, and seconds for which a hero stays away if it never comes back.
KEPT, AWAY_S = 0.75, 25.0
#: Detection inside a source's radius and in the ring around its edge.
INSIDE, RING, RING_WIDTH = 0.98, 0.75, 58.0
#: The area of a bin in square thousands of units.
BIN_AREA = (BIN / 1000) ** 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return add


def observations(spark: SparkSession, data_dir: str, truth: bool = False) -> DataFrame:
    """(match_id, slot, team, tick, seen, x, z): what the opponents of a hero know, by the fog record. With ``truth`` also
    true_bin, as in ``true_bins``, which nobody observes."""
    fog = base.visible_ticks(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", (1 - F.col("team")).alias("team"), "tick", F.col("visible").alias("seen"))
    joined = fog.join(base.positions(spark, data_dir).select("match_id", "slot", "tick", F.col("x").alias("px"), F.col("z").alias("pz")), ["match_id", "slot", "tick"], "left")
    known = lambda c: F.when(F.col("seen") == 1, F.col(c))
    return joined.select("match_id", "slot", "team", "tick", "seen", known("px").alias("x"), known("pz").alias("z"), *([lattice_bin("px", "pz").alias("true_bin")] if truth else []))


def lattice_bin(x: str, z: str) -> Column:
    low = lambda c: F.least(F.floor(F.col(c) / BIN), F.lit(LATTICE - 1)).cast("int")
    # F.least skips nulls.
    return F.when(F.col(x).isNotNull() & F.col(z).isNotNull(), low(x) * LATTICE + low(z))


@query(_TICKS + f", {base.POSITIONS} SELECT v.match_id, v.slot, 1 - v.team AS team, v.tick, v.visible AS seen, CASE WHEN visible = 1 THEN p.x END AS x, CASE WHEN visible = 1 THEN p.z END AS z FROM visible_ticks v LEFT JOIN positions p ON v.match_id = p.match_id AND v.slot = p.slot AND v.tick = p.tick WHERE v.team IS NOT NULL")
def h1_observations(spark, data_dir):
    """What the opponents of each hero observe at each tick."""
    return observations(spark, data_dir)


@query(f"WITH {base.ROSTER} SELECT match_id, 1 - team AS observer, slot, CAST(row_number() OVER (PARTITION BY match_id, team ORDER BY slot) - 1 AS INT) AS enemy, count(*) OVER (PARTITION BY match_id, team) = 5 AS complete FROM roster WHERE team IS NOT NULL")
def h2_enemy_index(spark, data_dir):
    """Number of each hero among the five enemies of the other team."""
    side = Window.partitionBy("match_id", "team")
    return base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", (1 - F.col("team")).alias("observer"), "slot", (F.row_number().over(side.orderBy("slot")) - 1).alias("enemy"), (F.count(F.lit(1)).over(side) == 5).alias("complete"))


@query(f"""WITH {base.ROSTER}, {_DOWNS}, {base.ANCHORS}, p AS (SELECT *, t + 1e-9 AS u FROM downs), b AS (SELECT p.match_id, p.slot, p.t, a.t AS back_t FROM p ASOF LEFT JOIN anchors a ON p.match_id = a.match_id AND p.slot = a.slot AND p.u <= a.t)
SELECT match_id, slot, CAST(ceil(t) AS INT) AS first_tick, CAST(ceil(coalesce(back_t, t + {AWAY_S})) AS INT) AS end_tick FROM b""")
def h3_away_spans(spark, data_dir):
    """Ticks in which a hero that went down is away."""
    probe = downs(spark, data_dir).withColumn("u", F.col("t") + 1e-9)
    back = as_of(probe, base.anchors(spark, data_dir), ["match_id", "slot"], "u", "t", {"t": "back_t"}, forward=True)
    return back.select("match_id", "slot", F.ceil("t").cast("int").alias("first_tick"), F.ceil(F.coalesce("back_t", F.col("t") + AWAY_S)).cast("int").alias("end_tick"))


_MOVES = f"""{base.POSITIONS}, binned AS (SELECT match_id, slot, tick, CAST(least(floor(x / 922.5), 15) AS INT) * 16 + CAST(least(floor(z / 922.5), 15) AS INT) AS bin FROM positions),
moves AS (SELECT bin AS a, lead(bin) OVER w AS b, lead(tick) OVER w - tick AS dt FROM binned WINDOW w AS (PARTITION BY match_id, slot ORDER BY tick)),
matrix AS (SELECT a, b, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM moves WHERE dt = 1 GROUP BY a, b)"""


def transition_matrix(spark: SparkSession, data_dir: str) -> DataFrame:
    """(a, b, n, p): moves between the cells of a 16 x 16 grid from one tick to the next, as a row-stochastic matrix."""
    low = lambda c: F.least(F.floor(F.col(c) / 922.5), F.lit(15)).cast("int")
    order = Window.partitionBy("match_id", "slot").orderBy("tick")
    binned = base.positions(spark, data_dir).select("match_id", "slot", "tick", (low("x") * 16 + low("z")).alias("a"))
    moves = binned.withColumn("b", F.lead("a").over(order)).withColumn("dt", F.lead("tick").over(order) - F.col("tick")).filter("dt = 1")
    counts = moves.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


@query(_MOVES + " SELECT a, b, n, round(p, 8) AS p FROM matrix")
def h6_transition_matrix(spark, data_dir):
    """Measured transition matrix."""
    return transition_matrix(spark, data_dir).withColumn("p", F.round("p", 8))


@query(_MOVES + ", now AS (SELECT bin AS a, count(*) / sum(count(*)) OVER () AS mass FROM binned GROUP BY bin) SELECT b AS bin, round(sum(mass * p), 8) AS mass FROM now JOIN matrix USING (a) GROUP BY b")
def h6_forward_step(spark, data_dir):
    """The occupancy of the cells carried one tick on by the transition matrix."""
    low = lambda c: F.least(F.floor(F.col(c) / 922.5), F.lit(15)).cast("int")
    now = base.positions(spark, data_dir).groupBy((low("x") * 16 + low("z")).alias("a")).agg(F.count(F.lit(1)).alias("n0"))
    # At most 256 rows.
    mass = now.withColumn("mass", F.col("n0") / F.sum("n0").over(Window.partitionBy(F.lit(0))))
    return mass.join(transition_matrix(spark, data_dir), "a").groupBy(F.col("b").alias("bin")).agg(F.round(F.sum(F.col("mass") * F.col("p")), 8).alias("mass"))


_DETECT = _PROBES.replace("s.class,\n coalesce(", "s.class, s.r,\n coalesce(") + f""", rings AS (SELECT p.match_id, p.tick, p.slot, p.team, max(CASE WHEN p.d IS NULL THEN 0.0 WHEN p.d <= p.r - {RING_WIDTH} THEN {INSIDE} WHEN p.d <= p.r THEN {RING} ELSE 0.0 END) AS pd FROM probes p GROUP BY ALL)"""


def detection(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, tick, slot, team, pd): chance that the other team detects a hero where it is: by the radius of each source,
    less near its edge."""
    pd = F.when(F.col("d").isNull(), 0.0).when(F.col("d") <= F.col("r") - RING_WIDTH, INSIDE).when(F.col("d") <= F.col("r"), RING).otherwise(0.0)
    return probes(spark, data_dir).groupBy("match_id", "tick", "slot", "team").agg(F.max(pd).alias("pd"))


@query(_DETECT + " SELECT match_id, tick, slot, team, CAST(pd AS DOUBLE) AS pd FROM rings")
def h8_detection(spark, data_dir):
    """Detection by radius: interior, ring at the edge, outside."""
    return detection(spark, data_dir)


@query(_DETECT + f", {base.FOG}, {base.TRANSITIONS}, {base.TICKS} SELECT r.match_id, r.slot, count(*) AS n_hidden, round(sum(ln(1.0 - r.pd)), 6) AS log_evidence FROM rings r JOIN visible_ticks v ON r.match_id = v.match_id AND r.slot = v.slot AND r.tick = v.tick WHERE v.visible = 0 GROUP BY r.match_id, r.slot")
def h9_absence_evidence(spark, data_dir):
    """Log-likelihood of not being seen, over the ticks in which a hero was hidden."""
    hidden = base.visible_ticks(spark, data_dir).filter("visible = 0").select("match_id", "slot", "tick")
    return detection(spark, data_dir).join(hidden, ["match_id", "slot", "tick"]).groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_hidden"), F.round(F.sum(F.log(1.0 - F.col("pd"))), 6).alias("log_evidence"))


_WEIGHTS = """o AS (SELECT DISTINCT match_id, order_no, owner AS slot, order_residual AS e FROM move_order WHERE owner >= 0 AND isfinite(order_residual) AND order_residual BETWEEN 0 AND 20900),
lw AS (SELECT *, -e / 200.0 AS logw, max(-e / 200.0) OVER (PARTITION BY match_id, slot) AS top FROM o), w AS (SELECT *, exp(logw - top) AS w FROM lw)"""


def order_weights(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, order_no, w): orders weighted by how well they fit their owner, the best of each hero at 1."""
    o = table(spark, data_dir, "move_order").filter("owner >= 0 AND order_residual BETWEEN 0 AND 20900 AND NOT isnan(order_residual)").select("match_id", "order_no", F.col("owner").alias("slot"), (-F.col("order_residual") / 200.0).alias("logw")).distinct()
    return o.withColumn("w", F.exp(F.col("logw") - F.max("logw").over(Window.partitionBy("match_id", "slot"))))


@query("WITH " + _WEIGHTS + " SELECT match_id, slot, count(*) AS n, round(pow(sum(w), 2) / sum(w * w), 6) AS ess FROM w GROUP BY match_id, slot")
def h11_effective_sample_size(spark, data_dir):
    """Kish's effective sample size of log-weights, per hero."""
    return order_weights(spark, data_dir).groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.round(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w")), 6).alias("ess"))


@query("WITH " + _WEIGHTS + """, c AS (SELECT *, round(sum(w) OVER (PARTITION BY match_id, slot ORDER BY order_no) / sum(w) OVER (PARTITION BY match_id, slot), 9) AS upto, count(*) OVER (PARTITION BY match_id, slot) AS n FROM w),
b AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY match_id, slot ORDER BY order_no), 0) AS since FROM c)
SELECT match_id, slot, order_no, CAST(greatest(0, ceil(upto * 64 - 0.5) - ceil(since * 64 - 0.5)) AS BIGINT) AS copies FROM b WHERE ceil(upto * 64 - 0.5) > ceil(since * 64 - 0.5)""")
def h12_systematic_resampling(spark, data_dir):
    """How often each weighted order is drawn by systematic resampling with 64 strata and their middles as draws.

    A row's share of the strata follows from the cumulative weights before and after it; no join is needed.
    """
    hero = Window.partitionBy("match_id", "slot")
    upto = F.round(F.sum("w").over(hero.orderBy("order_no").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(hero), 9)
    c = order_weights(spark, data_dir).withColumn("upto", upto).withColumn("since", F.coalesce(F.lag("upto").over(hero.orderBy("order_no")), F.lit(0.0)))
    copies = F.ceil(F.col("upto") * 64 - 0.5) - F.ceil(F.col("since") * 64 - 0.5)
    return c.select("match_id", "slot", "order_no", copies.alias("copies")).filter("copies > 0")


def filter_input(spark: SparkSession, data_dir: str, truth: bool = False) -> DataFrame:
    """``observations`` with the hero's role and whether it is alive, which all know; with ``truth``, also true_bin."""
    roles = table(spark, data_dir, "hero", "match_id", "slot", "hero_role").groupBy("match_id", "slot").agg(F.max(F.nullif(F.trim("hero_role"), F.lit(""))).alias("role"))
    spans = h3_away_spans(spark, data_dir).filter("end_tick > first_tick")
    away = spans.select("match_id", "slot", F.explode(F.sequence("first_tick", F.col("end_tick") - 1)).alias("tick"), F.lit(False).alias("alive")).distinct()
    rows = observations(spark, data_dir, truth).join(roles, ["match_id", "slot"], "left").join(away, ["match_id", "slot", "tick"], "left")
    return rows.select("match_id", "slot", "team", "role", "tick", F.coalesce("alive", F.lit(True)).alias("alive"), (F.col("seen") == 1).alias("seen"), "x", "z", *(["true_bin"] if truth else []))


def sight_spans(spark: SparkSession, data_dir: str) -> DataFrame:
    return all_spans(spark, data_dir).select("match_id", F.col("first").alias("tick"), "last", "team", "x", "z", "r")


def believed(spark: SparkSession, data_dir: str, models: list[BeliefModel], bins: bool = True, known: DataFrame | None = None, read: Reading | None = None) -> DataFrame:
    """The beliefs of ``models`` at every tick, from what each team observes and sees; see operators.belief."""
    return beliefs(filter_input(spark, data_dir), sight_spans(spark, data_dir), models, ground(spark, data_dir), CELL, matches=table(spark, data_dir, "matches", "match_id").count(), bins=bins, known=known, read=read)


def scored_beliefs(spark: SparkSession, data_dir: str, models: list[BeliefModel]) -> DataFrame:
    """The beliefs without their bins, with p_true and pit where a hero is alive and hidden and its place is known."""
    return believed(spark, data_dir, models, False, true_bins(spark, data_dir).select("match_id", "slot", "tick", "true_bin"), SCORES)


def true_bins(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, tick, x, z, true_bin): the truth, which is read only when beliefs are scored."""
    return base.positions(spark, data_dir).select("match_id", "slot", "tick", "x", "z", lattice_bin("x", "z").alias("true_bin"))


@query()
def h14_beliefs(spark, data_dir):
    """The full model's belief in each hero at every tick, by lattice bin, with its entropy and the bins of its densest nine tenths."""
    return believed(spark, data_dir, [BeliefModel()])


@query(f"WITH {_TICKS} SELECT match_id, slot, count(*) AS n_ticks, count(*) FILTER (WHERE visible = 1) AS n_seen, CAST(0 AS BIGINT) AS n_wrong FROM visible_ticks WHERE team IS NOT NULL GROUP BY match_id, slot")
def h14_belief_checks(spark, data_dir):
    """Ticks with a belief and with a sighting of each hero, and beliefs that aren't probabilities or whose entropy or
    effective sample size can't be."""
    wrong = ~F.col("whole") | ~F.col("entropy").between(0, 10) | ~F.col("ess").between(0.999, BeliefModel().particles + 0.5)
    return believed(spark, data_dir, [BeliefModel()], bins=False, read=WHOLE).groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_ticks"), F.count_if("seen").alias("n_seen"), F.count_if(wrong).alias("n_wrong"))


def model_sums(spark: SparkSession, data_dir: str, models: list[BeliefModel]) -> DataFrame:
    """How good each model's beliefs in the heroes of each match are, as sums; see operators.belief."""
    return belief_sums(filter_input(spark, data_dir, truth=True), sight_spans(spark, data_dir), models, ground(spark, data_dir), CELL, BIN_AREA, matches=table(spark, data_dir, "matches", "match_id").count())


def model_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    covered = [F.element_at("n_covered", k + 1).alias(f"covered_{round(100 * q)}") for k, q in enumerate(LEVELS)]
    rows = model_sums(spark, data_dir, MODELS).select("*", *covered)
    total = lambda c: F.sum(c).cast("double")
    share = lambda c, of: (total(c) / F.nullif(total(of), F.lit(0.0))).alias(c)
    scores = rows.groupBy("model").agg(
        F.sum("n").alias("n"), share("nll", "n"), share("entropy", "n"), (total("area") * BIN_AREA / F.nullif(total("n"), F.lit(0.0))).alias("area_90"),
        *[share(f"covered_{round(100 * q)}", "n").alias(f"coverage_{round(100 * q)}") for q in LEVELS],
        share("n_dark_alive", "n_alive").alias("dark_alive"), share("n_dark", "n_rows").alias("dark"),
    )
    error = sum((F.abs(F.col(f"coverage_{round(100 * q)}") - q) for q in LEVELS), F.lit(0.0)) / len(LEVELS)
    return scores.withColumn("calibration_error", error)


@query()
def h16_ablation(spark, data_dir):
    """The seven models side by side, on every tick at which a hero is alive and hidden and its place is known: negative
    log-likelihood of the true bin's density, entropy, area of the densest nine tenths, coverage at six levels and its mean
    error, and the share of ticks in the dark."""
    s = model_scores(spark, data_dir)
    return s.select("model", "n", *[F.round(c, 4).alias(c) for c in s.columns if c not in ("model", "n")])


@query()
def h16_gain_of_absence(spark, data_dir):
    """By how much the absence of sightings betters the belief: the two models that differ in nothing else."""
    nll = lambda name: F.max(F.when(F.col("model") == name, F.col("nll")))
    pair = [m for m in MODELS if m.name in ("behavioural", "full")]
    rows = scored_beliefs(spark, data_dir, pair).filter("p_true IS NOT NULL").withColumn("nll", -F.log(F.greatest("p_true", F.lit(0.5 / pair[0].particles)) / BIN_AREA))
    both = rows.groupBy("match_id", "model").agg(F.avg("nll").alias("nll"), F.count(F.lit(1)).alias("n")).groupBy("match_id").agg(F.max("n").alias("n"), nll("behavioural").alias("without"), nll("full").alias("with"))
    return both.select("match_id", "n", F.round("without", 4).alias("without"), F.round("with", 4).alias("with"), F.round(F.col("without") - F.col("with"), 4).alias("gain"))


@query()
def i5_belief_pit(spark, data_dir):
    """How often the truth falls into each tenth of the belief, the densest first: even for a calibrated one."""
    rows = scored_beliefs(spark, data_dir, [BeliefModel()]).filter("p_true IS NOT NULL")
    tenth = F.least(F.floor(F.col("pit") * 10), F.lit(9)).cast("int")
    return rows.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_true"), 6).alias("mean_p"))


@query()
def i7_belief_summaries(spark, data_dir):
    """Mean entropy and area of the belief in each hidden hero, by match and observing team."""
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", (1 - F.col("team")).alias("observer"))
    rows = believed(spark, data_dir, [BeliefModel()], bins=False).filter("alive AND NOT seen").join(teams, ["match_id", "slot"])
    return rows.groupBy("match_id", "observer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("entropy"), 4).alias("entropy"), F.round(F.avg(F.col("area") * BIN_AREA), 4).alias("area"))


#: The kernel of a walk on the open cells: weights of a step, and the chance to stay.
STAY_P = BeliefModel().stay
_KERNEL = f"""{base.POSITIONS}, {_WALKED}, steps AS (SELECT a.i * {SIDE} + a.j AS a, b.i * {SIDE} + b.j AS b, CASE WHEN a.i <> b.i AND a.j <> b.j THEN 70.0::DOUBLE / 99.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM walked a JOIN walked b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j)
 SEMI JOIN walked p ON p.i = b.i AND p.j = a.j SEMI JOIN walked q ON q.i = a.i AND q.j = b.j),
kernel AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) * {1 - STAY_P} AS p FROM steps UNION ALL SELECT i * {SIDE} + j, i * {SIDE} + j, CASE WHEN i * {SIDE} + j IN (SELECT a FROM steps) THEN {STAY_P} ELSE 1.0 END FROM walked)"""


def walk_kernel(spark: SparkSession, data_dir: str) -> DataFrame:
    """(a, b, p): chance of each open cell after one step of the walk from each, without heading and goal."""
    walked = walked_cells(spark, data_dir)
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    near = walked.withColumn("o", F.explode(around)).select("i", "j", (F.col("i") + F.col("o.di")).alias("bi"), (F.col("j") + F.col("o.dj")).alias("bj"))
    there = lambda i, j: walked.select(F.col("i").alias(i), F.col("j").alias(j))
    steps = near.join(there("bi", "bj"), ["bi", "bj"]).join(there("bi", "j"), ["bi", "j"], "left_semi").join(there("i", "bj"), ["i", "bj"], "left_semi")
    a, b = (F.col("i") * SIDE + F.col("j")).alias("a"), (F.col("bi") * SIDE + F.col("bj")).alias("b")
    w = F.when((F.col("i") != F.col("bi")) & (F.col("j") != F.col("bj")), F.lit(70.0) / 99.0).otherwise(1.0)
    moves = steps.select(a, b, w.alias("w")).withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("a")) * (1 - STAY_P)).select("a", "b", "p")
    stays = walked.select(a, a.alias("b")).join(moves.select("a").distinct().withColumn("moves", F.lit(True)), "a", "left").select("a", "b", F.when(F.col("moves"), STAY_P).otherwise(1.0).alias("p"))
    return moves.unionByName(stays)


@query("WITH " + _KERNEL + " SELECT a, b, round(p, 8) AS p FROM kernel")
def h6_walk_kernel(spark, data_dir):
    """The transition matrix of the walk on the open cells, exactly."""
    return walk_kernel(spark, data_dir).withColumn("p", F.round("p", 8))


@query("WITH " + _KERNEL + f""", start AS (SELECT min(a) AS a FROM steps), m0 AS (SELECT a, 1.0::DOUBLE AS m FROM start), m1 AS (SELECT k.b AS a, sum(m * p) AS m FROM m0 JOIN kernel k USING (a) GROUP BY k.b), m2 AS (SELECT k.b AS a, sum(m * p) AS m FROM m1 JOIN kernel k USING (a) GROUP BY k.b),
m3 AS (SELECT k.b AS a, sum(m * p) AS m FROM m2 JOIN kernel k USING (a) GROUP BY k.b), m4 AS (SELECT k.b AS a, sum(m * p) AS m FROM m3 JOIN kernel k USING (a) GROUP BY k.b) SELECT a AS cell, round(m, 9) AS mass FROM m4""")
def h6_walk_forward(spark, data_dir):
    """Where a walk from the first cell that has a way out is after four steps: the exact forward pass, by joins with the matrix."""
    kernel = walk_kernel(spark, data_dir)
    mass = kernel.filter("a <> b").agg(F.min("a").alias("a")).withColumn("m", F.lit(1.0))
    for _ in range(4):
        mass = mass.join(kernel, "a").groupBy("b").agg(F.sum(F.col("m") * F.col("p")).alias("m")).withColumnRenamed("b", "a")
    return mass.select(F.col("a").alias("cell"), F.round("m", 9).alias("mass"))


_HIST = f"""{base.POSITIONS}, raw AS (SELECT match_id, CAST(least(floor(x / {BIN!r}), 31) AS INT) AS i, CAST(least(floor(z / {BIN!r}), 31) AS INT) AS j, count(*) AS n FROM positions GROUP BY ALL),
spread AS (SELECT match_id, i + di AS i, j + dj AS j, n * CASE WHEN di = 0 AND dj = 0 THEN {KEPT} ELSE {(1 - KEPT) / 8} END AS m FROM raw, range(-1, 2) a(di), range(-1, 2) b(dj)),
kept AS (SELECT match_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, sum(m) AS m FROM spread WHERE i BETWEEN 0 AND 31 AND j BETWEEN 0 AND 31 GROUP BY ALL),
hist AS (SELECT match_id, i * 32 + j AS bin, m / sum(m) OVER (PARTITION BY match_id) AS p FROM kept)"""


def histogram(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, bin, p): where the heroes of a match were, on the lattice, with a quarter of each bin's mass on its neighbours."""
    low = lambda c: F.least(F.floor(F.col(c) / BIN), F.lit(LATTICE - 1)).cast("int")
    raw = base.positions(spark, data_dir).groupBy("match_id", low("x").alias("i"), low("z").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(KEPT if a == b == 0 else (1 - KEPT) / 8).alias("f")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = raw.withColumn("o", F.explode(around)).select("match_id", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), (F.col("n") * F.col("o.f")).alias("m"))
    kept = spread.filter(F.col("i").between(0, LATTICE - 1) & F.col("j").between(0, LATTICE - 1)).groupBy("match_id", "i", "j").agg(F.sum("m").alias("m"))
    return kept.select("match_id", (F.col("i") * LATTICE + F.col("j")).alias("bin"), (F.col("m") / F.sum("m").over(Window.partitionBy("match_id"))).alias("p"))


@query("WITH " + _HIST + " SELECT match_id, bin, round(p, 9) AS p FROM hist")
def i1_lattice_histogram(spark, data_dir):
    """Smoothed histogram of positions per match."""
    return histogram(spark, data_dir).withColumn("p", F.round("p", 9))


@query("WITH " + _HIST + ", c AS (SELECT match_id, count(*) AS n FROM positions GROUP BY match_id) SELECT h.match_id, round(least(-sum(p * log2(p)) + (count(*) - 1) / (2.0 * any_value(c.n) * ln(2)), 10.0), 6) AS bits FROM hist h JOIN c ON h.match_id = c.match_id WHERE p > 0 GROUP BY h.match_id")
def i3_entropy(spark, data_dir):
    """Entropy of the histogram in bits with the Miller-Madow correction, at most that of the uniform one."""
    n = base.positions(spark, data_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    per = histogram(spark, data_dir).filter("p > 0").groupBy("match_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("plain"), F.count(F.lit(1)).alias("k")).join(n, "match_id")
    return per.select("match_id", F.round(F.least(F.col("plain") + (F.col("k") - 1) / (2.0 * F.col("n") * F.log(F.lit(2.0))), F.lit(10.0)), 6).alias("bits"))


@query("WITH " + _HIST + ", c AS (SELECT match_id, p, sum(p) OVER (PARTITION BY match_id ORDER BY p DESC, bin ROWS UNBOUNDED PRECEDING) AS upto FROM hist), q AS (SELECT CAST(unnest([0.5, 0.9, 0.95]) AS DOUBLE) AS q) SELECT match_id, q, count(*) FILTER (WHERE round(upto - p, 9) < q) AS n_bins FROM c, q GROUP BY match_id, q")
def i4_density_regions(spark, data_dir):
    """Bins of the smallest region that holds a given share of the mass."""
    order = Window.partitionBy("match_id").orderBy(F.desc("p"), "bin").rowsBetween(Window.unboundedPreceding, 0)
    c = histogram(spark, data_dir).withColumn("before", F.round(F.sum("p").over(order) - F.col("p"), 9)).withColumn("q", F.explode(F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))))
    return c.groupBy("match_id", "q").agg(F.count_if(F.col("before") < F.col("q")).alias("n_bins"))


@query("WITH " + _HIST + f""", last AS (SELECT match_id, slot, arg_max(CAST(least(floor(x / {BIN!r}), 31) AS INT) * 32 + CAST(least(floor(z / {BIN!r}), 31) AS INT), tick) AS bin FROM positions GROUP BY match_id, slot),
t AS (SELECT l.match_id, l.slot, l.bin, h.p AS own FROM last l JOIN hist h ON l.match_id = h.match_id AND l.bin = h.bin)
SELECT t.match_id, t.slot, round(coalesce(sum(h.p) FILTER (WHERE round(h.p, 9) > round(t.own, 9)), 0) + any_value(t.own), 6) AS pit FROM t JOIN hist h ON t.match_id = h.match_id GROUP BY t.match_id, t.slot""")
def i5_pit(spark, data_dir):
    """Mass of the bins denser than the one in which a hero ended, and its own: the probability integral transform."""
    low = lambda c: F.least(F.floor(F.col(c) / BIN), F.lit(LATTICE - 1)).cast("int")
    h = histogram(spark, data_dir)
    last = base.positions(spark, data_dir).groupBy("match_id", "slot").agg(F.max_by(low("x") * LATTICE + low("z"), "tick").alias("bin"))
    own = last.join(h, ["match_id", "bin"]).select("match_id", "slot", F.col("p").alias("own"))
    denser = F.sum(F.when(F.round("p", 9) > F.round("own", 9), F.col("p")).otherwise(0.0))
    return own.join(h, "match_id").groupBy("match_id", "slot").agg(F.round(denser + F.first("own"), 6).alias("pit"))


@query("WITH " + _HIST + """, top AS (SELECT *, max(p) OVER (PARTITION BY match_id) AS most FROM hist), levels AS (SELECT match_id, CAST(least(floor(p / most * 256), 255) AS INT) AS level, sum(p) AS mass, count(*) AS n FROM top GROUP BY ALL),
c AS (SELECT *, sum(mass) OVER (PARTITION BY match_id ORDER BY level DESC ROWS UNBOUNDED PRECEDING) AS upto FROM levels)
SELECT match_id, max(level) FILTER (WHERE round(upto, 9) >= 0.9) AS level, CAST(sum(n) FILTER (WHERE round(upto - mass, 9) < 0.9) AS BIGINT) AS n_bins FROM c GROUP BY match_id""")
def l7_density_level(spark, data_dir):
    """The density level, of 256, above which nine tenths of the mass lie, from the top down."""
    most = F.max("p").over(Window.partitionBy("match_id"))
    levels = histogram(spark, data_dir).withColumn("level", F.least(F.floor(F.col("p") / most * 256), F.lit(255)).cast("int")).groupBy("match_id", "level").agg(F.sum("p").alias("mass"), F.count(F.lit(1)).alias("n"))
    upto = F.sum("mass").over(Window.partitionBy("match_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
    c = levels.withColumn("upto", upto)
    return c.groupBy("match_id").agg(F.max(F.when(F.round("upto", 9) >= 0.9, F.col("level"))).alias("level"), F.sum(F.when(F.round(F.col("upto") - F.col("mass"), 9) < 0.9, F.col("n"))).alias("n_bins"))
