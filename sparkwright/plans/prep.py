"""Preparation flows (J1-J6): quick, minimal, raw and per-column custom.

Each flow returns a ``Prepared``: the output frame (id columns, features,
``label`` and a ``split`` column), a step report, and a *recipe* - the
fitted transforms with their statistics frozen as literals or dictionary
frames - that re-applies the same preparation to new data, batch or stream
(J5).  Statistics, donors, categories and codes are fitted on the train split
by default (``fit_on='all'`` takes all rows).

The split frame is checkpointed once.  A stage (fills, fences, bins, scales,
codes) is fitted for all its columns by one aggregation over it, plus one for
values that need grouping (modes, dictionaries).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import numeric_columns, q, quantile_set, text_columns
from sparkwright.operators import binning as BN
from sparkwright.operators import encode as EN
from sparkwright.operators import impute as IM
from sparkwright.operators import quality as QL
from sparkwright.operators import scale as SC
from sparkwright.operators import split as SP
from sparkwright.operators import text as TX
from sparkwright.session import cut_lineage

UNSEEN = -1     # code of a value that the fitted rows do not hold


# ===================================================================== recipe steps
@dataclass
class Step:
    op: str
    column: str
    detail: str = ""
    fn: object = None          # DataFrame -> DataFrame, statistics already frozen
    jobs: bool = False         # runs jobs of its own, so streams replay it batch by batch

    def apply(self, df: DataFrame) -> DataFrame:
        return self.fn(df) if self.fn is not None else df


@dataclass
class Prepared:
    frame: DataFrame
    steps: list[Step] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    info: dict = field(default_factory=dict)

    def report(self) -> DataFrame:
        """One row per step ``(step_no, column, op, detail)``."""
        spark = self.frame.sparkSession
        rows = [(i + 1, s.column, s.op, s.detail) for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, "step_no int, column string, op string, detail string")

    @property
    def runs_jobs(self) -> bool:
        """Whether a replayed step runs jobs of its own (a stream then needs micro-batches)."""
        return any(s.jobs for s in self.steps)

    def apply(self, df: DataFrame) -> DataFrame:
        """Replay the fitted steps on new rows (no refit, no row dropped)."""
        for s in self.steps:
            if s.op not in ("split", "drop_rows"):
                df = s.apply(df)
        if "label" in df.columns:
            df = df.withColumn("label", F.col("label").cast("double"))
        return df.select(*[q(c) for c in self.frame.columns if c in df.columns])


def _sub(df: DataFrame, col: str, expr: Column) -> DataFrame:
    if col in df.columns:
        return df.select(*[expr.alias(c) if c == col else q(c) for c in df.columns])
    return df.select("*", expr.alias(col))


def _fitted(fit_on: str) -> Column:
    """Rows that statistics are taken from."""
    return F.col("split") == "train" if fit_on == "train" else F.lit(True)


# ----------------------------------------------------------------- fitted step builders
def fill_step(col: str, value, how: str) -> Step:
    x = q(col).cast("double") if how in ("mean", "median") else q(col)
    return Step("impute_" + how, col, repr(value), lambda d, c=col, v=F.lit(value): _sub(d, c, F.coalesce(x, v)))


def fill_steps(cur: DataFrame, how: dict[str, str], fitted: Column, constants: dict | None = None) -> list[Step]:
    """Fills of the columns that lack values: one aggregation for means and medians, one for modes."""
    if not how:
        return []
    aggs = [F.count_if(q(c).isNull()).alias(f"n{i}") for i, c in enumerate(how)]
    aggs += [F.avg(F.when(fitted, q(c).cast("double"))).alias(f"v{i}") for i, (c, h) in enumerate(how.items()) if h == "mean"]
    middle = [(i, c) for i, (c, h) in enumerate(how.items()) if h == "median"]
    aggs += [m[0].alias(f"v{i}") for (i, _), m in zip(middle, quantile_set(cur, [(F.when(fitted, q(c)), [0.5]) for _, c in middle]))]
    row = cur.agg(*aggs).first()
    need = [(i, c) for i, c in enumerate(how) if row[f"n{i}"]]
    modes = IM.column_modes(cur.where(fitted), [c for _, c in need if how[c] == "mode"])
    steps = []
    for i, c in need:
        if how[c] == "mode":
            value = IM.UNKNOWN if modes[c] is None and c in text_columns(cur) else modes[c]
        else:
            value = constants[c] if how[c] == "constant" else row[f"v{i}"]
        steps.append(fill_step(c, value, how[c]))
    return steps


def knn_step(df: DataFrame, cols: Sequence[str], named: Sequence[str], fitted: Column) -> Step:
    """k-NN fill of ``cols`` from the fitted rows of ``df``; their index is kept in the shared folder."""
    from sparkwright.operators.knn import donor_index, impute_knn
    lacking = IM.columns_with_nulls(df, list(cols))
    index = donor_index(df.where(fitted), list(cols))

    def fn(d):
        out = impute_knn(d, columns=cols, donors=index)
        return out.select(*[q(c).cast("double").alias(c) if c in lacking else q(c) for c in out.columns])
    return Step("impute_knn", ",".join(named), "k=5", fn, jobs=True)


def label_step(dic: DataFrame, col: str, out: str | None = None, n: int | None = None) -> Step:
    """Codes of ``col`` by a ``(value, code)`` dictionary; values that it does not hold get ``UNSEEN``."""
    name = out or col

    def fn(d, c=col, nm=name):
        key, code = f"__lk_{c}", f"__lc_{c}"
        dd = dic.select(F.col("value").alias(key), F.col("code").alias(code))
        j = d.withColumn(key, EN.as_text(q(c))).join(dd, key, "left")
        found = F.coalesce(F.col(code), F.lit(UNSEEN)).alias(nm)
        cols = [found if x == nm else q(x) for x in d.columns]
        if nm not in d.columns:
            cols.append(found)
        return j.select(*cols)
    return Step("encode_label", col, f"{n} codes", fn)


def target_step(df: DataFrame, target: str) -> Step:
    """Codes of the target's classes, of all rows (the split needs every class)."""
    dic = cut_lineage(EN.label_dictionary(df, target))
    return label_step(dic, target, "label", dic.count())


def onehot_step(col: str, categories: list) -> Step:
    def fn(d, c=col, cats=tuple(categories)):
        keep = [q(x) for x in d.columns if x != c]
        return d.select(*keep, *[F.when(q(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for v in cats])
    return Step("encode_onehot", col, ",".join(map(str, categories)), fn)


def code_steps(cur: DataFrame, columns: Sequence[str], limit: int, fitted: Column) -> tuple[list[Step], list[str]]:
    """One-hot columns for up to ``limit`` values, codes beyond; one dictionary of all columns.  Also the new indicators."""
    if not columns:
        return [], []
    dic = cut_lineage(EN.label_dictionaries(cur.where(fitted), columns))
    sizes = {r["column_name"]: r for r in dic.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("codes"), F.count_if("real").alias("values")).collect()}
    few = [c for c in columns if c not in sizes or sizes[c]["values"] <= limit]
    values: dict[str, list] = {c: [] for c in few}
    for r in dic.where(F.col("column_name").isin(few) & F.col("real")).select("column_name", "value").collect() if few else []:
        values[r["column_name"]].append(r["value"])         # at most limit values per column
    steps, dummies = [], []
    for c in columns:
        if c in values:
            cats = sorted(values[c])
            steps.append(onehot_step(c, cats))
            dummies += [f"{c}_{v}" for v in cats]
        else:
            steps.append(label_step(dic.where(F.col("column_name") == c).select("value", "code"), c, n=sizes[c]["codes"]))
    return steps, dummies


def scale_step(cols: Sequence[str], method: str, fit_df: DataFrame) -> Step:
    stats = SC.scaler_stats(fit_df, list(cols), method).first()   # one row: bounded
    return scaled(cols, method, {c: (stats[f"__a{i}"], stats[f"__b{i}"]) for i, c in enumerate(cols)})


def scaled(cols: Sequence[str], method: str, fit: dict) -> Step:
    """(x - centre) / scale with fitted numbers."""
    def fn(d):
        return d.select(*[((q(c).cast("double") - F.lit(fit[c][0])) / F.lit(fit[c][1])).alias(c)
                          if c in fit else q(c) for c in d.columns])
    return Step("scale_" + method, ",".join(cols), "", fn)


def clip_step(col: str, lo: float | None, hi: float | None, op: str = "clip") -> Step:
    return Step(op, col, f"[{lo}, {hi}]", lambda d: _sub(d, col, F.when(q(col) < lo, F.lit(lo)).when(q(col) > hi, F.lit(hi))
                                                         .otherwise(q(col).cast("double"))))


def _run(cur: DataFrame, steps: list[Step], done: list[Step]) -> DataFrame:
    for s in steps:
        cur = s.apply(cur)
    done += steps
    return cur


def _coded_and_split(df: DataFrame, target: str, ids: list[str], test_size: float, seed: int, stratify: bool | None,
                     steps: list[Step]) -> tuple[DataFrame, bool]:
    """Target as the double ``label`` and a ``split`` column, checkpointed (``stratify`` None: if possible)."""
    cur = df
    if target in text_columns(cur):
        cur = _run(cur, [target_step(cur, target)], steps)
    else:
        cur = cur.withColumn("label", q(target).cast("double"))
    cur = cur.withColumn("label", F.col("label").cast("double"))
    cur = cur.drop(target) if target != "label" else cur
    if stratify is not False:
        stratify = bool(stratify and SP.can_stratify(cur, "label", test_size).first()["stratify"])
    cur = (SP.split_stratified(cur, ids, "label", test_size, seed) if stratify
           else SP.split_random(cur, ids, test_size, seed))
    steps.append(Step("split", "label", "stratified" if stratify else "random"))
    return cut_lineage(cur), stratify


# ===================================================================== J1 quick
def prep_quick(df: DataFrame, target: str, id_cols: Sequence[str], test_size: float = 0.2,
               missing: str = "auto", encoding: str = "auto", scaling: str = "standard",
               fit_on: str = "train", seed: int = SP.SEED) -> Prepared:
    """missing -> target code and split -> impute -> encode -> scale."""
    ids = list(id_cols)
    feats = [c for c in df.columns if c != target and c not in ids]
    steps: list[Step] = []
    cur, fitted = df, _fitted(fit_on)
    task_cls = QL.is_classification(df, target)          # decided once, before coding (T13)
    if missing == "auto":
        missing = IM.auto_strategy(df, feats).first()["strategy"]
    if missing == "drop":
        cur = IM.drop_nulls(cur, feats)
        steps.append(Step("drop_rows", ",".join(feats), "rows with a missing feature"))
    cur, stratify = _coded_and_split(cur, target, ids, test_size, seed, task_cls, steps)
    num = set(numeric_columns(cur))
    if missing == "knn":
        cur = _run(cur, [knn_step(cur, [c for c in feats if c in num], feats, fitted)], steps)
    if missing in ("mean", "median", "mode", "mean_mode", "knn"):
        # numeric columns by mean / median (mode when asked), every other column by its mode
        own = {"median": "median", "mode": "mode"}.get(missing, "mean")
        cur = _run(cur, fill_steps(cur, {c: own if c in num else "mode" for c in feats}, fitted), steps)
    limit = {"auto": 5, "mixed": 5, "onehot": 10, "label": -1}[encoding]
    codes, dummies = code_steps(cur, [c for c in text_columns(cur) if c in feats], limit, fitted)
    cur = _run(cur, codes, steps)
    # scaling: every numeric feature except one-hot indicator columns
    out_feats = [c for c in cur.columns if c not in ids and c not in ("label", "split")]
    num_feats = [c for c in out_feats if c in numeric_columns(cur) and c not in dummies]
    if scaling in ("standard", "minmax", "robust") and num_feats:
        cur = _run(cur, [scale_step(num_feats, scaling, cur.where(fitted))], steps)
    cur = cur.select(*[q(c) for c in ids], *[q(c) for c in out_feats], "label", "split")
    return Prepared(cur, steps, out_feats, {"missing": missing, "task": "classification" if task_cls
                                             else "regression", "stratified": bool(stratify)})


# ===================================================================== J2 minimal
def prep_minimal(df: DataFrame, target: str, id_cols: Sequence[str], test_size: float = 0.2,
                 fit_on: str = "train", seed: int = SP.SEED) -> Prepared:
    """mean/mode fill -> label-encode every text feature -> float32, over a split
    that is stratified when possible for a classification target."""
    ids = list(id_cols)
    feats = [c for c in df.columns if c != target and c not in ids]
    steps: list[Step] = []
    fitted = _fitted(fit_on)
    task_cls = QL.is_classification(df, target)
    cur, stratify = _coded_and_split(df, target, ids, test_size, seed, task_cls, steps)
    num = set(numeric_columns(cur))
    cur = _run(cur, fill_steps(cur, {c: "mean" if c in num else "mode" for c in feats}, fitted), steps)
    codes, _ = code_steps(cur, [c for c in text_columns(cur) if c in feats], -1, fitted)
    cur = _run(cur, codes, steps)
    keep = [c for c in feats if c in numeric_columns(cur)]
    cast = Step("cast_float32", ",".join(keep), "",
                lambda d, k=tuple(keep): d.select(*[q(c).cast("float").alias(c) if c in k else q(c)
                                                    for c in d.columns]))
    cur = _run(cur, [cast], steps)
    cur = cur.select(*[q(c) for c in ids], *[q(c) for c in keep], "label", "split")
    return Prepared(cur, steps, keep, {"task": "classification" if task_cls else "regression",
                                       "stratified": bool(stratify)})


# ===================================================================== J3 raw
def prep_raw(df: DataFrame, target: str, id_cols: Sequence[str], test_size: float = 0.2,
             seed: int = SP.SEED) -> Prepared:
    """Numeric features only, missing -> 0, float32, random split."""
    ids = list(id_cols)
    feats = [c for c in numeric_columns(df) if c != target and c not in ids]
    if not feats:
        raise ValueError("the table has no numeric feature")
    steps: list[Step] = []
    cur, _ = _coded_and_split(df, target, ids, test_size, seed, False, steps)
    fill = Step("fill_zero_float32", ",".join(feats), "",
                lambda d, k=tuple(feats): d.select(*[F.coalesce(q(c).cast("float"), F.lit(0.0).cast("float"))
                                                     .alias(c) if c in k else q(c) for c in d.columns]))
    cur = _run(cur, [fill], steps)
    cur = cur.select(*[q(c) for c in ids], *[q(c) for c in feats], "label", "split")
    return Prepared(cur, steps, feats, {"task": None})


# ===================================================================== J4 custom
@dataclass
class ColumnSpec:
    """Per-column configuration of the custom flow (all optional)."""
    missing: str | None = None           # mean median mode constant drop interpolate forward_fill backward_fill
    fill_value: object = 0
    outliers: str = "none"               # none clip remove
    outlier_threshold: float = 1.5
    binning: str | None = None           # equal_width equal_frequency custom
    n_bins: int = 5
    custom_bins: Sequence[float] = ()
    scaling: str = "none"                # none log sqrt power standard minmax robust maxabs winsorize
    text_processing: Sequence[str] = ()  # lowercase remove_special remove_numbers strip
    rare_categories: str | None = None   # group_as_other drop
    rare_threshold: float = 5.0
    encoding: str = "label"              # label onehot frequency


def _missing_steps(cur: DataFrame, specs: dict[str, ColumnSpec], fitted: Column, order: list[str]) -> list[Step]:
    simple = {c: sp.missing for c, sp in specs.items() if sp.missing in ("mean", "median", "mode", "constant")}
    fills = {s.column: s for s in fill_steps(cur, simple, fitted, {c: sp.fill_value for c, sp in specs.items()})}
    ordered = {"interpolate": IM.interpolate_linear, "forward_fill": IM.ffill, "backward_fill": IM.bfill}
    lacking = set(IM.columns_with_nulls(cur, [c for c, sp in specs.items() if sp.missing and c not in simple]))
    steps = []
    for c, sp in specs.items():
        if c in fills:
            steps.append(fills[c])
        elif c in lacking and sp.missing == "drop":
            steps.append(Step("drop_rows", c, "rows missing the value", lambda d, c=c: d.where(q(c).isNotNull())))
        elif c in lacking and sp.missing in ordered:
            steps.append(Step("impute_" + sp.missing, c, "ordered by " + ",".join(order),
                              lambda d, c=c, f=ordered[sp.missing]: f(d, c, order), jobs=True))
        elif c in lacking:
            raise ValueError(f"unknown missing strategy {sp.missing!r}")
    return steps


def _fence_steps(rows: DataFrame, specs: dict[str, ColumnSpec]) -> list[Step]:
    own = {c: sp for c, sp in specs.items() if sp.outliers in ("clip", "remove")}
    if not own:
        return []
    found = quantile_set(rows, [(q(c), [0.25, 0.75]) for c in own])
    row = rows.agg(*[x.alias(f"q{i}") for i, x in enumerate(found)]).first()
    steps = []
    for i, (c, sp) in enumerate(own.items()):
        lo, hi = row[f"q{i}"] or (None, None)
        lo, hi = (None, None) if lo is None else (lo - sp.outlier_threshold * (hi - lo), hi + sp.outlier_threshold * (hi - lo))
        steps.append(clip_step(c, lo, hi) if sp.outliers == "clip" else
                     Step("drop_rows", c, f"outside [{lo}, {hi}]", lambda d, c=c, lo=lo, hi=hi: d.where(q(c).between(lo, hi))))
    return steps


def _bin_steps(rows: DataFrame, specs: dict[str, ColumnSpec]) -> list[Step]:
    own = {c: sp for c, sp in specs.items() if sp.binning}
    wide = [c for c, sp in own.items() if sp.binning == "equal_width"]
    even = [c for c, sp in own.items() if sp.binning == "equal_frequency"]
    aggs = [a for i, c in enumerate(wide) for a in (F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}"))]
    aggs += [F.array_distinct(e).alias(f"e{i}") for i, e in enumerate(quantile_set(
        rows, [(q(c), [k / own[c].n_bins for k in range(own[c].n_bins + 1)]) for c in even]))]
    row = rows.agg(*aggs).first() if aggs else {}
    steps = []
    for c, sp in own.items():
        out = f"{c}_binned"
        if c in wide:
            lo, hi = row[f"lo{wide.index(c)}"], row[f"hi{wide.index(c)}"]
            steps.append(Step("bin_equal_width", c, f"{sp.n_bins} bins", lambda d, c=c, o=out, lo=lo, hi=hi, n=sp.n_bins: d.select(
                "*", BN.equal_width_index(q(c), F.lit(lo).cast("double"), F.lit(hi).cast("double"), n).alias(o))))
        elif c in even:
            e = row[f"e{even.index(c)}"] or []
            steps.append(Step("bin_equal_freq", c, f"edges {e}", lambda d, c=c, o=out, e=tuple(e): d.select(
                "*", F.when(q(c).isNotNull(), F.greatest(F.size(F.filter(
                    F.array(*[F.lit(float(v)) for v in e]), lambda t: t < q(c).cast("double"))) - 1, F.lit(0))).alias(o))))
        else:
            steps.append(Step("bin_custom", c, f"edges {list(sp.custom_bins)}",
                              lambda d, c=c, o=out, e=tuple(sp.custom_bins): BN.bin_custom(d, c, e, o)))
    return steps


def _transform_steps(rows: DataFrame, specs: dict[str, ColumnSpec]) -> list[Step]:
    own = {c: sp.scaling for c, sp in specs.items() if sp.scaling not in ("none", None)}
    power = [c for c, how in own.items() if how == "power"]
    lam = SC.yeo_johnson_lambdas(rows, power)
    fits = {c: SC.scaler_exprs(rows, [c], how)[0] for c, how in own.items() if how in ("standard", "minmax", "robust", "maxabs")}
    wins = [c for c, how in own.items() if how == "winsorize"]
    for c, found in zip(wins, quantile_set(rows, [(q(c), [0.05, 0.95]) for c in wins])):
        fits[c] = (found[0], found[1])
    for c in power:
        y = SC.yeo_johnson_expr(q(c), lam[c])
        fits[c] = (F.avg(y), F.when(F.stddev_pop(y) == 0, 1.0).otherwise(F.stddev_pop(y)))
    row = rows.agg(*[x.alias(f"{k}{i}") for i, ab in enumerate(fits.values()) for k, x in zip("ab", ab)]).first() if fits else {}
    fit = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(fits)}
    steps = []
    for c, how in own.items():
        if how == "winsorize":
            steps.append(clip_step(c, *fit[c], "winsorize"))
        elif how == "power":
            steps.append(Step("power_yeo_johnson", c, f"lambda={lam[c]:.6f}", lambda d, c=c: _sub(
                d, c, (SC.yeo_johnson_expr(q(c), lam[c]) - F.lit(fit[c][0])) / F.lit(fit[c][1]))))
        elif how in ("log", "sqrt"):
            steps.append(Step(how, c, "", lambda d, c=c, f=SC.log1p if how == "log" else SC.sqrt: f(d, [c])))
        else:
            steps.append(scaled([c], how, {c: fit[c]}))
    return steps


def _rare_steps(rows: DataFrame, specs: dict[str, ColumnSpec]) -> list[Step]:
    own = {c: sp for c, sp in specs.items() if sp.rare_categories in ("group_as_other", "drop")}
    if not own:
        return []
    freq = cut_lineage(EN.frequency_dictionaries(rows, list(own)))
    steps = []
    for c, sp in own.items():
        rare = freq.where((F.col("column_name") == c) & (F.col("freq") < sp.rare_threshold / 100.0)).select(F.col("value").alias("__rv"))
        if sp.rare_categories == "drop":
            steps.append(Step("drop_rare", c, f"< {sp.rare_threshold}%", lambda d, c=c, r=rare: d.join(r, q(c) == F.col("__rv"), "left_anti")))
        else:
            steps.append(Step("rare_to_other", c, f"< {sp.rare_threshold}%", lambda d, c=c, r=rare: d.join(
                r.withColumn("__rf", F.lit(True)), q(c) == F.col("__rv"), "left").select(*[
                    F.when(F.col("__rf"), F.lit(EN.OTHER)).otherwise(q(x)).alias(x) if x == c else q(x) for x in d.columns])))
    return steps


def _text_code_steps(cur: DataFrame, specs: dict[str, ColumnSpec], fitted: Column) -> list[Step]:
    by_freq = [c for c, sp in specs.items() if sp.encoding == "frequency"]
    freq = cut_lineage(EN.frequency_dictionaries(cur.where(fitted), by_freq)) if by_freq else None
    onehot = [c for c, sp in specs.items() if sp.encoding == "onehot"]
    coded = [c for c in specs if c not in by_freq and c not in onehot]
    steps = {s.column: s for s in code_steps(cur, onehot, 1 << 30, fitted)[0] + code_steps(cur, coded, -1, fitted)[0]}
    for c in by_freq:
        dic = freq.where(F.col("column_name") == c).select(F.col("value").alias("__fv"), F.col("freq").alias("__ff"))
        steps[c] = Step("encode_frequency", c, "", lambda d, c=c, dic=dic: d.join(dic, q(c) == F.col("__fv"), "left").select(*[
            F.col("__ff").alias(x) if x == c else q(x) for x in d.columns]))
    return [steps[c] for c in specs]


def prep_custom(df: DataFrame, target: str, id_cols: Sequence[str], specs: dict[str, ColumnSpec],
                test_size: float = 0.2, normalize: bool = False, order_by: Sequence[str] | None = None,
                seed: int = SP.SEED, fit_on: str = "train") -> Prepared:
    """Target code and random split; then per column missing -> outliers -> binning -> transform
    (numeric) or text -> rare -> encode (text), each stage fitted for all columns at once; then the
    numeric projection with 0 fill and optional standard scaling fitted on train."""
    ids = list(id_cols)
    order = list(order_by or ids)
    steps: list[Step] = []
    fitted = _fitted(fit_on)
    cur, _ = _coded_and_split(df, target, ids, test_size, seed, False, steps)
    own = {c: sp for c, sp in specs.items() if c in cur.columns and c != target}
    num = {c: sp for c, sp in own.items() if c in numeric_columns(cur)}
    txt = {c: sp for c, sp in own.items() if c in text_columns(cur)}
    cur = _run(cur, _missing_steps(cur, own, fitted, order), steps)
    for stage in (_fence_steps, _bin_steps, _transform_steps):
        cur = _run(cur, stage(cur.where(fitted), num), steps)
    alias = {"remove_special_chars": "remove_special", "strip_whitespace": "strip"}
    cur = _run(cur, [Step("text", c, ",".join(alias.get(o, o) for o in sp.text_processing),
                          lambda d, c=c, ops=tuple(alias.get(o, o) for o in sp.text_processing): TX.clean_text(d, [c], ops))
                     for c, sp in txt.items() if sp.text_processing], steps)
    cur = _run(cur, _rare_steps(cur.where(fitted), txt), steps)
    if txt:
        cur = _run(cur, _text_code_steps(cur, txt, fitted), steps)
    feats = [c for c in numeric_columns(cur) if c not in ids and c not in (target, "label")]
    proj = Step("numeric_fill0", ",".join(feats), "", lambda d, k=tuple(feats): d.select(
        *[q(c) for c in ids], *[F.coalesce(q(c).cast("double"), F.lit(0.0)).alias(c) for c in k],
        *[q(c) for c in ("label", "split") if c in d.columns]))
    cur = _run(cur, [proj], steps)
    if normalize and feats:
        cur = _run(cur, [scale_step(feats, "standard", cur.where("split = 'train'"))], steps)
    cur = cur.select(*[q(c) for c in ids], *[q(c) for c in feats], "label", "split")
    n_cls = cur.agg(F.count_distinct("label")).first()[0]
    return Prepared(cur, steps, feats, {"is_classification": n_cls < QL.CLASSIFICATION_MAX_DISTINCT})


def removed_features(original: Sequence[str], final: Sequence[str], target: str) -> list[str]:
    """Columns of the input that are not in the output (set difference)."""
    fin = set(final)
    return [c for c in original if c not in fin and c != target]
