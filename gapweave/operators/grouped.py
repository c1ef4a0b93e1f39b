"""Operators that need a numeric kernel: one group of bounded size in a grouped pandas function."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..sources.panel import RUN
from .connectivity import wide
from .segments import SEGMENT, segment_table, windowed

SEQ = "subject string, session string, segment_id long"


def _matrix(part: pd.DataFrame, by: str, column: str = "v") -> np.ndarray:
    return np.array(part.sort_values(by)[column].tolist(), float)


def lowrank_windows(panel: DataFrame, length: int, step: int, ranks: tuple[int, ...]) -> DataFrame:
    """Of each window and rank: effective rank, eigen concentration, held-out R2, split similarity, and the window's basis."""
    rows = windowed(panel, length, step).withColumn("start_frame", F.col("frame") - F.col("at"))
    rows = wide(rows, [*SEGMENT, "start_frame", "frame"], "x")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        v, h, key = _matrix(part, "frame"), length // 2, part.iloc[0]
        out = []
        for r in ranks:
            m = kn.standardized_pca(v, r)
            halves = kn.standardized_pca(v[:h], r)["basis"], kn.standardized_pca(v[h:], r)["basis"]
            out.append((key["subject"], key["session"], key["segment_id"], key["start_frame"], r, kn.effective_rank(m["proportion"]), float(m["proportion"][:r].sum()), kn.bidirectional_r2(v, r), kn.subspace_similarity(*halves), m["basis"].ravel().tolist()))
        return pd.DataFrame(out, columns=["subject", "session", "segment_id", "start_frame", "rank", "effective_rank", "concentration", "heldout_r2", "split_similarity", "basis"])

    return rows.groupBy(*SEGMENT, "start_frame").applyInPandas(solve, f"{SEQ}, start_frame long, rank int, effective_rank double, concentration double, heldout_r2 double, split_similarity double, basis array<double>")


def adjacent_similarity(windows: DataFrame) -> DataFrame:
    """Subspace similarity of each window with the next of its segment and rank."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start_frame")
        b = [np.array(x).reshape(-1, int(r)) for x, r in zip(part["basis"], part["rank"])]
        out = part.iloc[:-1][["subject", "session", "segment_id", "start_frame", "rank"]].copy()
        out["next_frame"] = part["start_frame"].tolist()[1:]
        out["similarity"] = [kn.subspace_similarity(x, y) for x, y in zip(b, b[1:])]
        return out

    return windows.groupBy(*SEGMENT, "rank").applyInPandas(solve, f"{SEQ}, start_frame long, rank int, next_frame long, similarity double")


def run_bases(windows: DataFrame) -> DataFrame:
    """Mean-projector basis of each run and rank, as projector entries (the basis's sign is free)."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        r = int(part["rank"].iloc[0])
        b = kn.mean_projector_basis([np.array(x).reshape(-1, r) for x in part["basis"]])
        return pd.DataFrame([(part["subject"].iloc[0], part["session"].iloc[0], r, (b @ b.T).ravel().tolist())], columns=["subject", "session", "rank", "projector"])

    return windows.groupBy(*RUN, "rank").applyInPandas(solve, "subject string, session string, rank int, projector array<double>")


def window_information(panel: DataFrame, length: int, step: int, left: list[int], right: list[int], conditioning: list[int] | None = None, k: int = 3, jitter: float = 1e-10, seed: int = 20260811) -> DataFrame:
    """MI and CMI (nats) of each left x right pair in each window."""
    rows = windowed(panel, length, step).withColumn("start_frame", F.col("frame") - F.col("at"))
    rows = wide(rows, [*SEGMENT, "start_frame", "frame"], "x")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        mi, cmi = kn.block_information(_matrix(part, "frame"), left, right, conditioning, k=k, jitter=jitter, seed=seed)
        key = part.iloc[0]
        return pd.DataFrame(
            [(key["subject"], key["session"], key["segment_id"], key["start_frame"], i, j, mi[a, b], None if cmi is None else cmi[a, b]) for a, i in enumerate(left) for b, j in enumerate(right)],
            columns=["subject", "session", "segment_id", "start_frame", "i", "j", "mi", "cmi"],
        )

    return rows.groupBy(*SEGMENT, "start_frame").applyInPandas(solve, f"{SEQ}, start_frame long, i int, j int, mi double, cmi double")


def fixed_window_samples(panel: DataFrame, length: int, draws: int, seed: int) -> DataFrame:
    """(run, draw, segment_id, start_frame, end_frame): the seeded numpy stream of each run, runs without room skipped."""
    table = segment_table(panel)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("segment_id")
        if (part["n_frames"] < length).all():
            return pd.DataFrame(columns=["subject", "session", "draw", "segment_id", "start_frame", "end_frame"])
        got = kn.sample_windows(part["n_frames"].tolist(), length, draws, seed)
        first, ids = part["start_frame"].tolist(), part["segment_id"].tolist()
        return pd.DataFrame([(part["subject"].iloc[0], part["session"].iloc[0], d, ids[s], first[s] + o, first[s] + o + length - 1) for d, (s, o) in enumerate(got)], columns=["subject", "session", "draw", "segment_id", "start_frame", "end_frame"])

    return table.groupBy(*RUN).applyInPandas(solve, "subject string, session string, draw long, segment_id long, start_frame long, end_frame long")


def replayed(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Mean of each channel in each scheduled window; a window that is not inside one segment is an error."""
    inside = schedule.alias("w").join(segment_table(panel).alias("s"), RUN).filter("w.start_frame >= s.start_frame and w.end_frame <= s.end_frame").select("w.*")
    if schedule.join(inside, [*RUN, "draw"], "left_anti").limit(1).count():
        raise ValueError("a scheduled window is not one contiguous stretch of retained frames")
    frames = inside.select(*RUN, "draw", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return frames.join(panel, [*RUN, "frame"]).groupBy(*RUN, "draw", "roi_idx").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def matched_within_subject(left: DataFrame, right: DataFrame, caliper: float) -> DataFrame:
    """Optimal one-to-one pairs of each subject on covariate cov."""

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("idx"), b.sort_values("idx")
        got = kn.matched(a[["cov"]].to_numpy(float), b[["cov"]].to_numpy(float), np.array([caliper]))
        return pd.DataFrame([(a["subject"].iloc[0], int(a["idx"].iloc[i]), int(b["idx"].iloc[j]), c) for i, j, c in got], columns=["subject", "left_idx", "right_idx", "cost"])

    return left.groupBy("subject").cogroup(right.groupBy("subject")).applyInPandas(solve, "subject string, left_idx long, right_idx long, cost double")


def resampled(diffs: DataFrame, n: int, seed: int) -> DataFrame:
    """(endpoint, n, estimate, p, low, high): Monte Carlo sign flip and bootstrap interval."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        d = part.sort_values("subject")["diff"].to_numpy(float)
        return pd.DataFrame([(part["endpoint"].iloc[0], len(d), d.mean(), kn.sign_flip_mc(d, n, seed), *kn.bootstrap_ci(d, n, seed + 100_000))], columns=["endpoint", "n", "estimate", "p", "low", "high"])

    return diffs.groupBy("endpoint").applyInPandas(solve, "endpoint string, n long, estimate double, p double, low double, high double")


def kmeans_fit(rows: DataFrame, n_states: int, seed: int, n_init: int = 3, max_iter: int = 50) -> list[list[float]]:
    """Centres of pooled z-scored values (SD below 1e-12 taken as 1), the best of n_init seeds, in original units."""
    flat = rows.select(F.posexplode("values").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("f").collect()
    mean, scale = [r["m"] for r in flat], [r["s"] if r["s"] >= 1e-12 else 1.0 for r in flat]
    lit = lambda x: F.array(*map(F.lit, x))
    z = F.zip_with(F.zip_with("values", lit(mean), lambda a, b: a - b), lit(scale), lambda a, b: a / b)
    data = rows.select(array_to_vector(z).alias("features")).persist()
    fits = [KMeans(k=n_states, seed=seed + i, maxIter=max_iter).fit(data) for i in range(n_init)]
    data.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return sorted([float(x * s + m) for x, s, m in zip(c, scale, mean)] for c in best.clusterCenters())


def hmm_fit(rows: DataFrame, n_states: int, seed: int, n_iter: int = 200, tol: float = 1e-3, least: int = 2) -> dict:
    """Gaussian HMM (diagonal) by EM; E-steps are grouped by sequence, and only their sums reach the driver.

    rows: SEGMENT, start_frame, values. Sums are added in partitions first, so the driver
    gets one set of statistics for each task, not for each sequence. The model tells how
    many rounds it took (n_iter) and whether a round gained less than tol (converged); a
    warning is given if none did.
    """
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*SEGMENT))).filter(F.col("_n") >= least)
    seqs = rows.groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(F.struct("start_frame", "values"))).alias("s")).persist()
    centres = np.array(kmeans_fit(rows, n_states, seed))
    spread = rows.select(F.posexplode("values").alias("f", "v")).groupBy("f").agg(F.var_pop("v").alias("s")).orderBy("f").collect()
    model = {"start": np.full(n_states, 1 / n_states), "move": np.full((n_states, n_states), 0.2 / max(1, n_states - 1)) + np.eye(n_states) * (0.8 - 0.2 / max(1, n_states - 1)), "mean": centres, "cov": np.array([np.diag([r["s"] + 1e-3 for r in spread])] * n_states)}
    last, rounds, converged = -np.inf, 0, False
    for _ in range(n_iter):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def e_step(parts, shared=shared):
            import pickle

            total = None
            for part in parts:
                for s in part["s"]:
                    one = kn.statistics(np.array([r["values"] for r in s], float), shared.value)
                    total = one if total is None else {k: total[k] + one[k] for k in total}
            if total is not None:
                yield pd.DataFrame({"blob": [pickle.dumps(total)]})

        import pickle

        stats = [pickle.loads(r[0]) for r in seqs.mapInPandas(e_step, "blob binary").collect()]
        model = kn.m_step(stats)
        now, rounds = sum(s["loglik"] for s in stats), rounds + 1
        if now - last < tol:
            converged = True
            break
        last = now
    seqs.unpersist()
    if not converged:
        warnings.warn(f"hmm_fit: the tolerance {tol} was not reached in {rounds} rounds", stacklevel=2)
    return model | {"loglik": now, "n_iter": rounds, "converged": converged}


def hmm_decode(rows: DataFrame, model: dict) -> DataFrame:
    """Viterbi state and its posterior for each sample, and the sequence's log-likelihood."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start_frame")
        x = np.array(part["values"].tolist(), float)
        f, path = kn.forward_backward(x, model), kn.viterbi(x, model)
        return part[[*SEGMENT, "start_frame"]].assign(state=path.astype("int32"), posterior=f["post"][np.arange(len(path)), path], loglik=f["loglik"])

    return rows.groupBy(*SEGMENT).applyInPandas(solve, f"{SEQ}, start_frame long, state int, posterior double, loglik double")


def hmm_score(rows: DataFrame, model: dict) -> DataFrame:
    per = hmm_decode(rows, model).groupBy(*SEGMENT).agg(F.max("loglik").alias("l"), F.count("*").alias("n"))
    return per.groupBy(*RUN).agg(F.sum("l").alias("loglik"), F.sum("n").alias("n_samples"), F.count("*").alias("n_sequences"), (F.sum("l") / F.sum("n")).alias("loglik_per_sample"))


def nbs(diffs: DataFrame, threshold: float, n: int, seed: int) -> DataFrame:
    """Components of edges (subject, i, j, diff) with family-wise p; one group: subjects x edges."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        grid = part.pivot_table(index="subject", columns=["i", "j"], values="diff").dropna()
        i, j = (np.array([c[k] for c in grid.columns]) for k in (0, 1))
        got = kn.paired_nbs(grid.to_numpy(float), i, j, threshold, n, seed)
        return pd.DataFrame([(k, c["sign"], c["extent"], sorted({int(x) for e in c["edges"] for x in (i[e], j[e])}), c["p"]) for k, c in enumerate(got)], columns=["component", "sign", "extent", "nodes", "p"])

    return diffs.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "component int, sign int, extent int, nodes array<int>, p double")




