"""One stream through three phases: learn a bank from its first frames, a threshold from the next, inspect the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscan.operators import bank, calibrate

GRID = ["sku", "roll_id", "frame_index", "tile", "gy", "gx", "embedding"]
#: How each sku stands after a micro-batch: its phase and counts, and the parts that hold its sample, bank and calibration.
STATE = "sku string, phase string, learned long, calibrated long, needed long, learned_at array<string>, clean_at array<string>, bank string, calibration string"
RELEASED = "sku string"


@dataclass
class Plan:
    """How many frames each phase takes, how the bank is made and what the threshold has to hold. hold: an accepted threshold
    waits for the sku's row in the control table before frames are inspected."""

    learn: int = 40
    calibrate: int = 60
    more: int = 20
    budget_fa: float = 20.0
    metres_per_tile: float = 0.5
    margin: int = 10
    fraction: float = 0.1
    pool: int = 3
    hold: bool = False


def release(spark: SparkSession, root: str, skus: list[str]) -> None:
    """ST5: lets the skus' frames be inspected from the next micro-batch on."""
    spark.createDataFrame([(s,) for s in skus], RELEASED).write.mode("append").parquet(f"{root}/released")


def _maybe(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty where nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _grids(rows: DataFrame) -> DataFrame:
    """Patches with one name for each tile of the stream."""
    return rows.select("sku", F.to_json(F.struct("roll_id", "frame_index", "tile")).alias("tile"), "gy", "gx", "embedding")


def teach_calibrate_inspect(root: str, plan: Plan, on_phase: Callable[[str, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """ST4, ST5: a foreachBatch function over patches (GRID and end_of_roll, frames in order).

    Frames are counted for each sku. The first plan.learn make its bank (G5), the next plan.calibrate are scored by it and give
    its threshold (A4). A sample that does not support the budget is kept and plan.more frames are asked for. Then tiles are
    scored and classified into `root`/inspected. A stream that ends in the first two phases is an error. Frames that come while
    a sku waits for its release are in no table: they are uninspected.

    Every micro-batch writes under its own batch number, the state of all skus too, and begins from the state of the batch before
    it, so that a batch that runs again writes the same tables again. The state names the parts that hold each sku's sample, bank
    and calibration: a batch reads those of its skus, however many batches there were. The driver holds that row of each sku.
    on_phase is told (sku, phase) whenever a sku enters one.
    """

    def at(table: str, place: str) -> str:
        return f"{root}/{table}/{place}"

    def held(spark: SparkSession, table: str, schema: str, places: dict[str, list[str]]) -> DataFrame:
        """The rows of skus in the parts of a table that hold them."""
        paths = sorted({at(table, p) for parts in places.values() for p in parts})
        return spark.read.schema(schema).parquet(*paths).filter(F.col("sku").isin(list(places)))

    def before(spark: SparkSession, batch_id: int) -> DataFrame:
        """The state that the batch begins from: that of the batch before, else of the last one there is."""
        try:
            return spark.read.schema(STATE).parquet(at("phases", f"batch={batch_id - 1}"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        found = _maybe(spark, f"{root}/phases", STATE + ", batch long").filter(F.col("batch") < batch_id)
        return found.groupBy("sku").agg(F.max_by(F.struct(*[c.split()[0] for c in STATE.split(", ")][1:]), "batch").alias("s")).select("sku", "s.*")

    def scored(spark: SparkSession, rows: DataFrame, banks: dict[str, list[str]]) -> DataFrame:
        """The largest patch score of each tile."""
        points = held(spark, "banks", "sku string, point_id long, embedding array<float>", banks)
        patches = bank.score_grids(_grids(rows), None, points.select("sku", "point_id", "embedding"), plan.pool)
        return patches.groupBy("sku", "tile").agg(F.max("score").alias("score"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counted = batch.groupBy("sku").agg(F.count_distinct("roll_id", "frame_index").alias("n"), F.bool_or("end_of_roll").alias("ended")).collect()
        state = {r.sku: [r.phase, r.learned, r.calibrated, r.needed, list(r.learned_at), list(r.clean_at), r.bank, r.calibration] for r in before(spark, batch_id).collect()}
        free = {r.sku for r in _maybe(spark, f"{root}/released", RELEASED).collect()}
        # the frames of one micro-batch, in order
        order = F.dense_rank().over(Window.partitionBy("sku").orderBy("roll_id", "frame_index")) - 1
        batch = batch.withColumn("_n", order).persist()

        def enter(sku: str, phase: str) -> None:
            state[sku][0] = phase
            if on_phase:
                on_phase(sku, phase)

        try:
            used, part = {r.sku: 0 for r in counted}, 0
            while True:
                share = []
                for r in counted:
                    s = state.setdefault(r.sku, ["learn", 0, 0, plan.calibrate, [], [], None, None])
                    if s[0] == "ready" and (r.sku in free or not plan.hold):
                        enter(r.sku, "inspect")
                    room = {"learn": plan.learn - s[1], "calibrate": s[3] - s[2]}.get(s[0], r.n)
                    upto = min(r.n, used[r.sku] + room)
                    if upto > used[r.sku]:
                        share.append((r.sku, s[0], used[r.sku], upto))
                        s[1] += (upto - used[r.sku]) * (s[0] == "learn")
                        s[2] += (upto - used[r.sku]) * (s[0] == "calibrate")
                        used[r.sku] = upto
                if not share:
                    break
                rows = batch.join(F.broadcast(spark.createDataFrame(share, "sku string, phase string, lo long, hi long")), "sku").filter("_n >= lo AND _n < hi")
                of = {p: [s for s, phase, _, _ in share if phase == p] for p in ("learn", "calibrate", "inspect")}
                place = f"batch={batch_id}/part={part}"
                if of["learn"]:
                    rows.filter("phase = 'learn'").select(*GRID).write.mode("overwrite").parquet(at("learn", place))
                    for s in of["learn"]:
                        state[s][4].append(place)
                    full = [s for s in of["learn"] if state[s][1] >= plan.learn]
                    if full:
                        grids = held(spark, "learn", "sku string, roll_id long, frame_index long, tile long, gy int, gx int, embedding array<float>", {s: state[s][4] for s in full})
                        points = bank.fit_banks(_grids(grids), None, plan.fraction, plan.pool)
                        points.select("sku", "point_id", "embedding").write.mode("overwrite").parquet(at("banks", place))
                        for s in full:
                            state[s][4], state[s][6] = [], place
                            enter(s, "calibrate")
                if of["calibrate"]:
                    scored(spark, rows.filter("phase = 'calibrate'"), {s: [state[s][6]] for s in of["calibrate"]}).write.mode("overwrite").parquet(at("clean", place))
                    for s in of["calibrate"]:
                        state[s][5].append(place)
                    full = [s for s in of["calibrate"] if state[s][2] >= state[s][3]]
                    if full:
                        clean = held(spark, "clean", "sku string, tile string, score double", {s: state[s][5] for s in full})
                        found = calibrate.conformal_threshold(clean.select("sku", "score"), ["sku"], plan.budget_fa, plan.metres_per_tile, plan.margin)
                        found.write.mode("overwrite").parquet(at("calibrations", place))
                        for r in spark.read.parquet(at("calibrations", place)).collect():
                            if r.status == "ok":
                                state[r.sku][5], state[r.sku][7] = [], place
                                enter(r.sku, "ready")
                            else:  # the sample is kept
                                state[r.sku][3] += plan.more
                if of["inspect"]:
                    cals = held(spark, "calibrations", "sku string, threshold double, abstain_low double, status string", {s: [state[s][7]] for s in of["inspect"]}).filter("status = 'ok'")
                    tiles = scored(spark, rows.filter("phase = 'inspect'"), {s: [state[s][6]] for s in of["inspect"]})
                    named = tiles.withColumn("t", F.from_json("tile", "roll_id long, frame_index long, tile long")).select("sku", "t.*", "score")
                    calibrate.classified(named, cals, ["sku"]).write.mode("overwrite").parquet(at("inspected", place))
                part += 1
        finally:
            batch.unpersist()
        spark.createDataFrame([(k, *v) for k, v in state.items()], STATE).write.mode("overwrite").parquet(at("phases", f"batch={batch_id}"))
        early = [f"{r.sku} ({state[r.sku][0]})" for r in counted if r.ended and state[r.sku][0] in ("learn", "calibrate")]
        if early:
            raise ValueError(f"the stream ended while it was being taught: {', '.join(early)}")

    return step
