"""Kaplan-Meier, log-rank and Cox models.

People are first summed per (arm or stratum, time, event, covariate pattern).  Running sums over times go in two
levels (a part of the times per task, then the parts).  A Cox step is one or two passes over people laid out
by stratum and falling time, without a shuffle; only p x p sums per part reach the driver.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.tails import chi2_tail, normal_quantile, normal_two_sided
from wardline.operators.concordance import concordance
from wardline.operators.design import column, complete, design, dot, invert, matrix, solve, sum_blocks, term_sources
from wardline.operators.models import Fit, rows_frame
from wardline.operators.riskscan import Scan, hand_on
from wardline.operators.running import ranged, running
from wardline.session import cut_lineage

MAX_ARMS = 50


# --- curves -------------------------------------------------------------------------------------

def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def kaplan_meier(df: DataFrame, time: str, event: str, by: str | None = None, weight: str | None = None,
                 limits: bool = False, level: float = 0.95) -> DataFrame:
    """Per arm and time: at risk, events, censored, survival with Greenwood error, cumulative hazard.

    With ``limits`` also the influence-based error (each person's share in the curve by the infinitesimal
    jackknife, right also with weights) and limits on the log scale, from it where there are weights and else from
    Greenwood's.
    """
    keys = [by] if by else []
    used = complete(df, [time, event, *keys]).withColumn("_w", _weight(weight))
    on_event = lambda c: F.sum(F.when(F.col(event) == 1, c).otherwise(0.0))
    days = used.groupBy(*keys, F.col(time).alias("time")).agg(
        F.sum("_w").alias("_left"), on_event(F.col("_w")).alias("n_event"),
        F.sum(F.col("_w") * F.col("_w")).alias("_left2"), on_event(F.col("_w") * F.col("_w")).alias("_event2"))
    back = {"n_risk": "_left"} | ({"_risk2": "_left2"} if limits else {})
    risk = running(ranged(days, keys, "time"), keys, "time", back, descending=True)
    risk = risk.withColumn("n_censor", F.col("_left") - F.col("n_event"))
    n, d = F.col("n_risk"), F.col("n_event")
    green = F.when((n > d) & (n > 0), F.try_divide(d, n * (n - d))).otherwise(0.0)
    out = running(risk.withColumn("_g", green), keys, "time", {"_green": "_g"},
                  products={"survival": F.when(n > 0, 1 - F.try_divide(d, n)).otherwise(1.0)})
    s = F.col("survival")
    shown = [*keys, "time", "n_risk", "n_event", "n_censor", s.alias("survival"),
             F.when(s > 0, s * F.sqrt("_green")).alias("std_error"), F.when(s > 0, -F.log(s)).alias("cum_hazard")]
    if not limits:
        return out.select(*shown)
    # someone who left at u has the influence event/(n-d) - A(u) on the log curve, A(u) Greenwood's sum; others have -A(t)
    alive = F.coalesce(F.try_divide(F.lit(1.0), n - d), F.lit(0.0))
    gone = (F.col("_event2") * (alive - F.col("_green")) ** 2 + (F.col("_left2") - F.col("_event2")) * F.col("_green") ** 2)
    out = running(out.withColumn("_q", gone), keys, "time", {"_gone": "_q"})
    after = F.greatest(F.col("_risk2") - F.col("_left2"), F.lit(0.0))
    influence = F.sqrt(F.col("_gone") + F.col("_green") ** 2 * after)
    on_log = influence if weight else F.sqrt("_green")
    z = normal_quantile(0.5 + level / 2)
    return out.select(*shown, F.when(s > 0, s * influence).alias("robust_error"),
                      F.when(s > 0, s * F.exp(-z * on_log)).alias("conf_low"),
                      F.when(s > 0, F.least(s * F.exp(z * on_log), F.lit(1.0))).alias("conf_high"))


def risk_table(km: DataFrame, times: list[int], by: str | None = None) -> DataFrame:
    """At risk just before, and survival at, the chosen days."""
    keys = [by] if by else []
    at = km.withColumn("at", F.explode(F.lit(list(times))))
    later = F.col("time") >= F.col("at")
    return at.groupBy(*keys, "at").agg(
        F.coalesce(F.min_by(F.when(later, F.col("n_risk")), F.when(later, F.col("time"))), F.lit(0.0)).alias("n_risk"),
        F.coalesce(F.min(F.when(F.col("time") <= F.col("at"), F.col("survival"))), F.lit(1.0)).alias("survival"))


def median_survival(km: DataFrame, by: str | None = None) -> DataFrame:
    """First day with survival at most one half; NULL when the curve stays above."""
    keys = [by] if by else []
    return km.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def _arms(df: DataFrame, by: str) -> list:
    arms = sorted(r[0] for r in df.select(by).filter(F.col(by).isNotNull()).distinct().limit(MAX_ARMS + 1).collect())
    if len(arms) > MAX_ARMS:
        raise ValueError(f"{by} has more than {MAX_ARMS} arms")
    return arms


def _risk_days(df: DataFrame, time: str, event: str, by: str, arms: list) -> DataFrame:
    """Per day: at risk (n), events (d) and people leaving (m) of each arm side by side."""
    is_arm = [F.col(by) == a for a in arms]
    ev = F.col(event) == 1
    days = complete(df, [time, event, by]).groupBy(F.col(time).alias("t")).agg(
        *[F.count_if(c).alias(f"m{i}") for i, c in enumerate(is_arm)],
        *[F.count_if(c & ev).alias(f"d{i}") for i, c in enumerate(is_arm)])
    return running(ranged(days, [], "t"), [], "t", {f"n{i}": f"m{i}" for i in range(len(arms))}, descending=True)


def _compare(part: list[int], name: str = "") -> list[Column]:
    """Sums that compare the arms with these numbers: sizes, observed, expected and covariance."""
    n = sum(F.col(f"n{i}") for i in part).cast("double")
    d = sum(F.col(f"d{i}") for i in part).cast("double")
    share = {i: F.when(n > 0, F.col(f"n{i}") / n).otherwise(0.0) for i in part}
    spread = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    sums = [F.sum(f"m{i}").alias(f"{name}size{i}") for i in part]
    sums += [F.sum(f"d{i}").alias(f"{name}obs{i}") for i in part]
    sums += [F.sum(d * share[i]).alias(f"{name}exp{i}") for i in part]
    sums += [F.sum(spread * share[i] * ((1 if i == j else 0) - share[j])).alias(f"{name}v{i}_{j}")
             for i in part for j in part]
    return sums


def _parts_of(row, part: list[int], name: str = "") -> tuple[np.ndarray, ...]:
    vec = lambda p: np.array([float(row[f"{name}{p}{i}"] or 0) for i in part])
    cov = np.array([[float(row[f"{name}v{i}_{j}"] or 0) for j in part] for i in part])
    return vec("size"), vec("obs"), vec("exp"), cov


def _logrank_stat(parts) -> tuple[float, int, float]:
    _, obs, exp, cov = parts
    diff = (obs - exp)[:-1]
    stat = float(diff @ np.linalg.pinv(cov[:-1, :-1]) @ diff)
    df = len(obs) - 1
    return stat, df, chi2_tail(stat, df)


def logrank(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Per arm: people, observed and expected events; the test repeated on every row."""
    arms = _arms(df, by)
    part = list(range(len(arms)))
    parts = _parts_of(_risk_days(df, time, event, by, arms).agg(*_compare(part)).first(), part)
    stat, dof, p = _logrank_stat(parts)
    rows = [(str(a), int(parts[0][i]), float(parts[1][i]), float(parts[2][i]), stat, dof, p)
            for i, a in enumerate(arms)]
    return rows_frame(df.sparkSession, rows,
                       "arm string, n long, observed double, expected double, chisq double, df int, p_value double")


def benjamini_hochberg(ps: list[float]) -> list[float]:
    order = sorted(range(len(ps)), key=lambda i: -ps[i])
    out, low = [0.0] * len(ps), 1.0
    for rank, i in enumerate(order):
        low = min(low, ps[i] * len(ps) / (len(ps) - rank))
        out[i] = low
    return out


def pairwise_logrank(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Log-rank test of every pair of arms from one pass, p-values adjusted by Benjamini-Hochberg."""
    arms = _arms(df, by)
    pairs = list(combinations(range(len(arms)), 2))
    sums = [c for k, pair in enumerate(pairs) for c in _compare(list(pair), f"p{k}_")]
    row = _risk_days(df, time, event, by, arms).agg(*sums).first()
    stats = [_logrank_stat(_parts_of(row, list(pair), f"p{k}_")) for k, pair in enumerate(pairs)]
    adjusted = benjamini_hochberg([s[2] for s in stats])
    rows = [(str(arms[i]), str(arms[j]), s[0], s[2], q) for (i, j), s, q in zip(pairs, stats, adjusted)]
    return rows_frame(df.sparkSession, rows,
                       "arm_a string, arm_b string, chisq double, p_value double, p_adjusted double")


# --- Cox model -------------------------------------------------------------------------------------

TIE_SUMS = ("a0", "a1", "c0", "c1", "c2", "ll")
KEYS = ["_s", "_tt"]
DAYS = ("_s string, _tt double, S0 double, d0 double, dw double, dn double, wbar double, g double, S1 array<double>, "
        "D1 array<double>, " + ", ".join(f"{c} double" for c in TIE_SUMS))


def _stratum(strata: list[str]) -> Column:
    return F.to_json(F.struct(*strata)) if strata else F.lit("")


def _read(batches, scan: Scan) -> None:
    for b in batches:
        if b.num_rows:
            scan.take(b.column(0).to_pylist(), *(column(b, c) for c in ("_tt", "_d", "_w")), column(b, "_n").astype(float),
                      matrix(b), column(b, "_g"))


class CoxTable:
    """Pattern rows of a Cox model, laid out by stratum and falling time.

    The rows are dealt by ranges, also within a busy time, and written once; each evaluation reads them in order (``Scan``).
    With several parts a first pass hands the open sums of a part on to the next: 2 (p^2 + 3p) numbers per part.
    """

    def __init__(self, df: DataFrame, time: str, event: str, terms, weight: str | None, strata: list[str]):
        self.spark, self.strata = df.sparkSession, strata
        group = list(dict.fromkeys([*strata, *term_sources(terms)]))
        summed = df.select(*[F.col(c) for c in group], F.col(time).alias("_t"), F.col(event).cast("int").alias("_d"),
                           _weight(weight).alias("_w")).groupBy(*group, "_t", "_d").agg(
            F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"), F.count(F.lit(1)).alias("_n"))
        rows = cut_lineage(summed)
        self.design = d = design(rows, terms, intercept=False)
        self.p = d.width
        center = rows.agg(F.sum("_w"), F.sum("_n"), F.sum(F.col("_n") * F.col("_d")),
                          *[F.sum(F.col("_w") * e) for e in d.exprs]).first()
        self.n, self.events = int(center[1]), int(center[2])
        self.means = [float(c / center[0]) for c in center[3:]]
        self.rows = self._laid_out(rows.select(
            _stratum(strata).alias("_s"), F.col("_t").cast("double").alias("_tt"), "_d", "_w", "_w2", "_n",
            F.lit(0.0).alias("_g"), self.centred().alias("_x")))

    def centred(self) -> Column:
        return F.array(*[(e - F.lit(m)).cast("double") for e, m in zip(self.design.exprs, self.means)])

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        order = [F.col("_s"), F.col("_tt").desc()]
        rows = rows.repartitionByRange(*order, F.xxhash64("_x", "_d")).sortWithinPartitions(*order)
        self.parts = None
        return cut_lineage(rows)

    def with_scale(self, g: DataFrame) -> CoxTable:
        """The same people with g (one row per ``_tt``) beside them."""
        other = object.__new__(CoxTable)
        other.__dict__.update(self.__dict__)
        other.rows = other._laid_out(self.rows.drop("_g").join(g.select(F.col("_tt").alias("_at"), F.col("g").alias("_g")),
                                                               F.col("_tt") == F.col("_at")).drop("_at"))
        return other

    # --- passes ----------------------------------------------------------------------------------

    def _starts(self, beta) -> tuple[dict, set]:
        """What each part starts with; a single part starts with nothing."""
        if self.parts is None:
            self.parts = self.rows.rdd.getNumPartitions()
        if self.parts == 1:
            return {}, set()
        p = self.p

        def run(batches):
            scan = Scan(p, beta, evaluate=False)
            _read(batches, scan)
            part = TaskContext.get().partitionId()
            found = scan.summary(part)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())],
                                             names=["part", "sums"])
        got = self._laid().mapInArrow(run, "part int, sums binary").collect()
        return hand_on([x for x in (pickle.loads(r.sums) for r in sorted(got, key=lambda r: r.part)) if x])

    def _laid(self) -> DataFrame:
        return self.rows.select("_s", "_tt", "_d", "_w", "_n", "_x", "_g")

    def derivatives(self, beta, powers=(0,)):
        """Log-likelihood, score and information; with powers 1 and 2 also their g- and g^2-weighted forms.

        The second-moment sum over event days is turned around: each row adds r*h*xx' with the hazard h of the days it is at
        risk on, so a day has p values and never p x p.
        """
        p = self.p
        starts, open_ended = self._starts(beta)

        def run(batches):
            part = TaskContext.get().partitionId()
            scan = Scan(p, beta, starts.get(part), powers)
            _read(batches, scan)
            if part not in open_ended:
                scan.finish_day()
            sums = np.concatenate([[scan.like], scan.score.ravel(), scan.info.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["sums"])

        got = self._laid().mapInArrow(run, "sums array<double>").collect()
        s = np.sum([r.sums for r in got], axis=0) if got else np.zeros(1 + 3 * p + 3 * p * p)
        return float(s[0]), s[1:1 + 3 * p].reshape(3, p), s[1 + 3 * p:].reshape(3, p, p)

    def days(self, beta) -> DataFrame:
        """Per (stratum, time): risk-set sums, event sums, tie sums, and the hazard up to it (``h0``, running)."""
        p = self.p
        starts, open_ended = self._starts(beta)
        names = [c.split()[0] for c in DAYS.split(", ")]

        def run(batches):
            part, made = TaskContext.get().partitionId(), []

            def emit(s, t, table, wbar, sums):
                lists = [pa.array(list(table[k]), pa.list_(pa.float64())) for k in ("S1", "d1")]
                flat = [pa.array(np.asarray(v, float)) for v in (t, table["S0"], table["d0"], table["dw"], table["dn"], wbar,
                                                                 table["g"])]
                made.append(pa.RecordBatch.from_arrays([pa.array([s] * len(t)), *flat, *lists, *[pa.array(v) for v in sums]],
                                                       names=names))
            scan = Scan(p, beta, starts.get(part), emit=emit)
            for b in batches:
                _read([b], scan)
                yield from made
                made.clear()
            if part not in open_ended:
                scan.finish_day()
            yield from made

        table = ranged(self._laid().mapInArrow(run, DAYS), ["_s"], "_tt")
        return running(table, ["_s"], "_tt", {"h0": F.col("wbar") * F.col("a0")})

    def with_hazard(self, rows: DataFrame, days: DataFrame, extra: list[str] = ()) -> DataFrame:
        """Own-time hazard sums on the rows: an event row leaves out its share of the tied sums."""
        table = days.select(F.col("_s").alias("_s_"), F.col("_tt").alias("_tt_"), F.col("h0").alias("_h"),
                            (F.col("wbar") * F.col("a1")).alias("_own"), *extra)
        joined = rows.join(table, (F.col("_s") == F.col("_s_")) & (F.col("_tt") == F.col("_tt_"))).drop("_s_", "_tt_")
        return joined.withColumn("h0", F.col("_h") - F.when(F.col("_d") == 1, F.col("_own")).otherwise(0.0)).drop("_h")


def cox(df: DataFrame, time: str, event: str, terms, weight: str | None = None, strata=(), robust: bool | None = None,
        where=None, tol: float = 1e-6, max_iter: int = 30) -> Fit:
    """Proportional hazards with Efron ties, optional weights and strata.

    With weights the variance is the robust sandwich unless ``robust=False``; ``extra`` keeps the model-based one as
    ``naive``.  ``extra["converged"]`` tells whether the last step was small; a coefficient without a finite
    maximum (separated data) goes on to ``max_iter`` and does not converge.
    """
    df = df if where is None else df.filter(where)
    strata = list(strata)
    df = complete(df, {time, event, *term_sources(terms), *strata, *([weight] if weight else [])})
    table = CoxTable(df, time, event, terms, weight, strata)
    d = table.design
    beta = np.zeros(d.width)
    like, score, info = table.derivatives(beta)
    null_like, null_score, null_info = like, score[0], info[0]
    converged, steps = False, 0
    while steps < max_iter and not converged:
        steps += 1
        move = solve(info[0], score[0])
        scale = 1.0
        while True:
            new = table.derivatives(beta + scale * move)
            if new[0] >= like - 1e-10 * abs(like) or scale < 1e-4:
                break
            scale /= 2
        beta = beta + scale * move
        like, score, info = new
        converged = bool(np.max(np.abs(scale * move), initial=0.0) < tol * (1 + np.max(np.abs(beta), initial=0.0)))
    naive = invert(info[0])
    robust = weight is not None if robust is None else robust
    cov = naive @ _score_squares(table, beta) @ naive if robust else naive
    return Fit(df.sparkSession, "cox", d, beta, cov, like, table.n, None, table.rows, df,
               {"table": table, "naive": naive, "null_loglik": null_like, "null_score": null_score, "null_info": null_info,
                "events": table.events, "time": time, "event": event, "weight": weight, "strata": strata, "robust": robust,
                "converged": converged, "iterations": steps})


def _event_mean(p: int) -> Column:
    """Mean of the tied risk-set means of a time."""
    return F.array(*[F.when(F.col("dn") > 0, (F.col("a0") * F.col("S1")[j] - F.col("a1") * F.col("D1")[j]) / F.col("dn"))
                     .otherwise(0.0) for j in range(p)])


def _score_squares(table: CoxTable, beta) -> np.ndarray:
    """Sum over people of w^2 L L', L the score residual; people of one pattern share it, so w^2 is summed."""
    p = table.p
    days = table.days(beta)
    # hazard-weighted risk means, running, and their own-time tied share
    drift = {f"g_{j}": F.col("wbar") * (F.col("c0") * F.col("S1")[j] - F.col("c1") * F.col("D1")[j]) for j in range(p)}
    tied = [(F.col("wbar") * (F.col("c1") * F.col("S1")[j] - F.col("c2") * F.col("D1")[j])) for j in range(p)]
    rich = running(days, ["_s"], "_tt", drift).withColumns({
        "_drift": F.array(*[F.col(f"g_{j}") for j in range(p)]), "_tied": F.array(*tied), "_mean": _event_mean(p)})
    scored = table.rows.withColumn("_risk", F.exp(dot("_x", beta)))
    rows = table.with_hazard(scored, rich, ["_drift", "_tied", "_mean"]).select(
        "_x", "_d", "_w2", "_risk", "h0", "_drift", "_tied", "_mean")

    def block(batch):
        x, ev = matrix(batch), column(batch, "_d")[:, None]
        gone = matrix(batch, "_drift") - ev * matrix(batch, "_tied")
        res = ev * (x - matrix(batch, "_mean")) - column(batch, "_risk")[:, None] * (
            x * column(batch, "h0")[:, None] - gone)
        return ((res * column(batch, "_w2")[:, None]).T @ res).ravel()

    return sum_blocks(rows, p * p, block).reshape(p, p)


def _scale_before(table: CoxTable) -> DataFrame:
    """g(t) = 1 - KM(t-) over all people, unweighted, for every time of the data.

    KM(t-) = KM(t) / (1 - d/n) but where everybody left dies, which only the last time can bring; there it is the
    least KM above 0, or 1.
    """
    times = table.rows.groupBy("_tt").agg(F.sum("_n").alias("m"), F.sum(F.col("_n") * F.col("_d")).alias("d"))
    risk = running(ranged(times, [], "_tt"), [], "_tt", {"n": "m"}, descending=True)
    step = F.when(F.col("d") < F.col("n"), 1 - F.col("d") / F.col("n"))
    km = running(risk, [], "_tt", {}, products={"km": F.coalesce(step, F.lit(1.0))})
    return km.select("_tt", (1 - F.col("km") / F.coalesce(step, F.lit(1.0))).alias("g"))


def ph_test(fit: Fit) -> DataFrame:
    """Score test of a time-varying coefficient along g(t), per term (all its columns) and for all."""
    table: CoxTable = fit.extra["table"]
    p = table.p
    _, score, info = table.with_scale(_scale_before(table)).derivatives(fit.beta, (0, 1, 2))
    joint = np.block([[info[0], info[1]], [info[1], info[2]]])
    rows = []
    groups = [*fit.design.groups.items(), ("GLOBAL", list(range(p)))]
    for name, idx in groups:
        keep = [*range(p), *[p + i for i in idx]]
        inv = invert(joint[np.ix_(keep, keep)])[p:, p:]
        u = score[1][idx]
        stat = float(u @ inv @ u)
        rows.append((name, stat, len(idx), chi2_tail(stat, len(idx))))
    return rows_frame(fit.spark, rows, "term string, chisq double, df int, p_value double")


def _scored_people(fit: Fit, keep: list[str]) -> DataFrame:
    """People of the fit with their centred x, own-time hazard and event mean."""
    table: CoxTable = fit.extra["table"]
    strata, time = fit.extra["strata"], F.col(fit.extra["time"])
    people = fit.data.select(*keep, _stratum(strata).alias("_s"), time.cast("double").alias("_tt"), time.alias("_t"),
                             F.col(fit.extra["event"]).cast("int").alias("_d"), table.centred().alias("_x"))
    days = table.days(fit.beta).withColumn("_mean", _event_mean(table.p))
    return table.with_hazard(people.withColumn("_eta", dot("_x", fit.beta)), days, ["_mean"])


def schoenfeld(fit: Fit, key: str = "ref") -> DataFrame:
    """Event rows: covariate minus its risk-set mean, one row per person and term."""
    people = _scored_people(fit, [key])
    pairs = F.array(*[F.struct(F.lit(name).alias("term"), (F.col("_x")[j] - F.col("_mean")[j]).alias("residual"))
                      for j, name in enumerate(fit.terms)])
    return people.filter(F.col("_d") == 1).select(key, F.col("_t").alias("time"), F.inline(pairs))


def cox_residuals(fit: Fit, kind: str = "deviance", key: str = "ref") -> DataFrame:
    """Martingale or deviance residual per person."""
    people = _scored_people(fit, [key])
    m = F.col("_d") - F.exp("_eta") * F.col("h0")
    out = people.select(key, F.col("_t").alias("time"), F.col("_d").alias("event"), F.col("_eta").alias("linear"),
                        m.alias("residual"))
    if kind == "martingale":
        return out
    m = F.col("residual")
    inner = m + F.when(F.col("event") == 1, F.log(F.col("event") - m)).otherwise(0.0)
    return out.withColumn("residual", F.signum(m) * F.sqrt(F.greatest(-2 * inner, F.lit(0.0))))


# --- summaries of a Cox fit -------------------------------------------------------------------------

def cox_terms(fit: Fit) -> DataFrame:
    """Per term: estimate, hazard ratio, model-based and robust error, p-value by the error the fit reports."""
    naive = np.sqrt(np.diag(fit.extra["naive"]))
    robust = fit.extra["robust"]
    rows = [(name, float(b), float(np.exp(b)), float(m), float(se) if robust else None, normal_two_sided(float(b / se)))
            for name, b, m, se in zip(fit.terms, fit.beta, naive, fit.std_errors)]
    return rows_frame(fit.spark, rows, "term string, estimate double, ratio double, model_error double, robust_error double, "
                                       "p_value double")


def cox_summary(fit: Fit) -> DataFrame:
    """People, events, likelihoods, the likelihood-ratio, Wald (by the reported variance) and score tests, concordance."""
    table, p = fit.extra["table"], fit.design.width
    ratio = 2 * (fit.loglik - fit.extra["null_loglik"])
    wald = float(fit.beta @ invert(fit.cov) @ fit.beta)
    score = float(fit.extra["null_score"] @ invert(fit.extra["null_info"]) @ fit.extra["null_score"])
    agree, against, tied = concordance(table.rows.withColumn("_y", dot("_x", fit.beta)), "_s", "_tt", "_d", "_y", "_w")
    pairs = agree + against + tied
    row = (table.n, table.events, fit.extra["null_loglik"], fit.loglik, ratio, chi2_tail(ratio, p), wald, chi2_tail(wald, p),
           score, chi2_tail(score, p), p, agree, against, tied, (agree + tied / 2) / pairs if pairs else None,
           fit.extra["converged"], fit.extra["iterations"])
    return rows_frame(fit.spark, [row], "n long, events long, null_loglik double, loglik double, lr_test double, lr_p double, "
                      "wald_test double, wald_p double, score_test double, score_p double, df int, concordant double, "
                      "discordant double, tied double, concordance double, converged boolean, iterations int")
