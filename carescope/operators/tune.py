"""Hyper-parameter search for the leaf-wise learner (M9) and the best trial's refit.

Trials are drawn at random from the reference's ranges. The rows are binned once for all of them.
They are run by successive halving: all trials boost to the first rung's rounds, the better third
goes on to the next rung from the ensembles fitted so far, and so on; every trial has its own early
stop on validation AUROC throughout. Rungs wait for all their trials, so the outcome does not
depend on which finished first. Within a rung trials run at the same time, each in a scheduler pool
and a job group of its own: where fair scheduling is on they share the cluster evenly, and a trial
that fails has its jobs cancelled and counts as failed without ending the search. A trial's trees grow
in as many tasks as its share of the slots: many trials, one task each; the last ones, several each.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .boosting import BoostedTrees, BoostParams

#: The reference's ranges, (kind, low, high); "log" and "logint" are log-uniform.
SPACE = {
    "learning_rate": ("log", 0.01, 0.1),
    "num_leaves": ("logint", 16, 128),
    "max_depth": ("int", 4, 12),
    "min_child_samples": ("logint", 20, 200),
    "l1": ("log", 1e-3, 10.0),
    "l2": ("log", 1e-3, 10.0),
    "feature_fraction": ("float", 0.6, 1.0),
    "bagging_fraction": ("float", 0.6, 1.0),
    "bagging_freq": ("int", 1, 7),
}
ROUNDS = 2000          # a trial's rounds at most; its early stop decides
FIRST_RUNG = 25
KEPT = 3               # one trial in so many goes on
TRIALS = "trial int, params map<string,string>, val_auroc double, best_iteration int, rounds int, state string"


def sample_trials(n_trials: int, seed: int = 42, space: dict = SPACE) -> list[dict]:
    rng, out = random.Random(seed), []
    for _ in range(n_trials):
        p = {}
        for name, (kind, low, high) in space.items():
            if kind in ("log", "logint"):
                v = math.exp(rng.uniform(math.log(low), math.log(high)))
                p[name] = min(high, max(low, round(v))) if kind == "logint" else v
            else:
                p[name] = rng.randint(low, high) if kind == "int" else rng.uniform(low, high)
        out.append(p)
    return out


@dataclass
class Trial:
    number: int
    params: dict
    model: BoostedTrees | None = None
    history: list = field(default_factory=list)
    state: str = "running"                # running, stopped (early stop), pruned, failed

    def best(self, patience: int) -> tuple[int | None, float | None]:
        """(round kept by the early stop, its AUROC)."""
        i = boosting.stop_at(self.history, patience)[0]
        return i, dict(self.history).get(i)


def _advance(spark: SparkSession, group: str, trial: Trial, data: boosting.Binned, rounds: int, patience: int,
             share: Callable[[], int]) -> None:
    """Boost a trial up to ``rounds``, as jobs of its own group and pool, on its share of the slots."""
    sc, name = spark.sparkContext, f"{group}-{trial.number}"
    sc.setJobGroup(name, f"search trial {trial.number}", interruptOnCancel=True)
    sc.setLocalProperty("spark.scheduler.pool", name)
    try:
        trial.model, trial.history, over = boosting.run_rounds(
            data, BoostParams(**trial.params, rounds=rounds), patience, start=trial.model, history=trial.history, share=share)
        trial.state = "stopped" if over else "running"
    except Exception:  # whatever ends a trial ends that trial alone
        sc.cancelJobGroup(name)
        trial.state = "failed"
    finally:
        sc.setLocalProperty("spark.scheduler.pool", None)


def rungs(first: int = FIRST_RUNG, kept: int = KEPT, most: int = ROUNDS) -> list[int]:
    out = [first]
    while out[-1] < most:
        out.append(min(most, out[-1] * kept))
    return out


def search(spark: SparkSession, train: DataFrame, valid: DataFrame, feature_cols: Sequence[str], n_trials: int = 50, seed: int = 42,
           parallelism: int = 8, label: str = "label", patience: int = 50, most: int = ROUNDS) -> list[Trial]:
    """M9: all trials, each with its AUROC by round as far as it was run."""
    trials = [Trial(k, p) for k, p in enumerate(sample_trials(n_trials, seed))]
    data, group = boosting.bin_rows(train, feature_cols, label, valid=valid), f"search-{uuid.uuid4().hex}"
    try:
        for rounds in rungs(most=most):
            running = [t for t in trials if t.state == "running"]
            if not running:
                break
            todo, left, width = list(running), {t.number for t in running}, max(1, min(parallelism, len(running)))

            def share() -> int:
                """Trials that run at present or will: the last ones of a rung take the slots of those that are done."""
                return max(1, min(width, len(left)))

            def work() -> None:
                while todo:
                    try:
                        trial = todo.pop(0)
                    except IndexError:
                        return
                    _advance(spark, group, trial, data, rounds, patience, share)
                    left.discard(trial.number)

            threads = [InheritableThread(target=work, session=spark) for _ in range(width)]
            for t in threads:
                t.start()
            for t in threads:
                t.join()
            # of the trials that reached this rung, stopped or not, the better third goes on
            reached = [t for t in running if t.state != "failed" and t.best(patience)[1] is not None]
            ranked = sorted(reached, key=lambda t: (-t.best(patience)[1], t.number))
            for t in running:
                if t.state == "running" and t not in ranked[:max(1, -(-len(running) // KEPT))]:
                    t.state = "pruned"
    finally:
        data.unpersist()
    return trials


def trial_table(spark: SparkSession, trials: Sequence[Trial], patience: int = 50) -> DataFrame:
    rows = [(t.number, {k: str(v) for k, v in t.params.items()}, t.best(patience)[1], t.best(patience)[0],
             len(t.model.trees) if t.model else 0, t.state) for t in trials]
    return spark.createDataFrame(rows, TRIALS)


def run_trials(spark: SparkSession, train: DataFrame, valid: DataFrame, feature_cols: Sequence[str], n_trials: int = 50, seed: int = 42,
               parallelism: int = 8, label: str = "label", patience: int = 50, most: int = ROUNDS) -> DataFrame:
    """M9: (trial, params, val_auroc, best_iteration, rounds, state) for every sampled parameter set."""
    return trial_table(spark, search(spark, train, valid, feature_cols, n_trials, seed, parallelism, label, patience, most), patience)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the highest validation AUROC (ties: lowest trial number)."""
    return trials.agg(F.max_by(F.struct("trial", "params", "val_auroc", "best_iteration"),
                               F.struct(F.col("val_auroc"), -F.col("trial"))).alias("b")).select("b.*")


def parse_params(params: dict) -> dict:
    return {k: int(v) if SPACE[k][0] in ("int", "logint") else float(v) for k, v in params.items()}


def refit(train_val: DataFrame, feature_cols: Sequence[str], params: dict, best_iteration: int, label: str = "label") -> BoostedTrees:
    """Refit on train + validation with the chosen parameters and the frozen number of rounds."""
    model, _ = boosting.fit_boosted(train_val, feature_cols, label, BoostParams(**params, rounds=best_iteration))
    return model
