"""L2 (train + evaluate) re-aimed as table jobs.

Losses and metrics of the splits come from the per-task NB heads.  The
training log is that of the gradient heads (``operators.gradient``): for epochs 1..3
the train split is shuffled per epoch (md5 key) and cut into the planned batch
sizes; the steps between two evaluations (``EVALS_PER_EPOCH`` per epoch) are a block.  A
train row's loss and prediction are those of the heads at its block's start, the
dev split is scored by the heads as they stand at each evaluation, and all
heads of the run stay stored.  Best-so-far, early stop and the progress lines follow that dev F1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SPLIT_SEED, TASKS
from ..functions import arrays as ar
from ..operators import counting as ct
from ..operators import gradient as gr
from ..operators import losses as ls
from ..operators import metrics as mt
from ..operators import monitor as mo
from ..operators import weighting as wt
from ..operators.common import order_key, r6
from ..plans.ranking import hex_bucket, two_stage_rank
from .prepare import Prepared
from .textmodels import NBScores

N_EPOCHS = 3
RUN_ID = "heads"
# Evaluations per epoch (a parameter: the log has EVALS_PER_EPOCH x epochs states of the heads, or a few more in tiny
# epochs) and steps without improvement that end the run.
EVALS_PER_EPOCH = 4
MONITOR_PATIENCE = 12


class Training:
    def __init__(self, spark: SparkSession, sf_dir: str, n_epochs: int = N_EPOCHS, materialize: bool = True):
        from .stages import materialize as mat
        self._keep = mat if materialize else (lambda d, by=(): d)
        self.p = Prepared.get(spark, sf_dir)
        self.nb = NBScores.get(self.p)
        self.n_epochs = n_epochs
        self.preds = self.nb.predictions()
        self._step_preds = None
        self._step_log = None
        self._dev_eval = None
        self._fit = None

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str) -> Training:
        from .stages import stage
        return stage(spark, sf_dir, "training", lambda: cls(spark, sf_dir))

    # -- scored splits ------------------------------------------------------
    def split_preds(self, split: str) -> DataFrame:
        return self.preds.filter(F.col("split") == split)

    def class_weight_idx(self) -> DataFrame:
        cw = self.p.class_weights().select("task", "label", "weight")
        return cw.join(self.p.label_dim, ["task", "label"]).select("task", "label_idx", "weight")

    def dev_batched(self) -> DataFrame:
        """Dev rows with their epoch-1 batch (as the dev loader would cut)."""
        plan = F.broadcast(self.p.plan.select("task", "batch_size"))
        d = self.split_preds("dev").withColumn("_key", order_key("id", SPLIT_SEED, 1))
        d = two_stage_rank(d, ["task"], ["_key", "id"], hex_bucket("_key"), "pos")
        return d.join(plan, "task").withColumn(
            "batch_id", F.floor((F.col("pos") - 1) / F.col("batch_size")).cast("bigint"))

    # -- derived training log ------------------------------------------------
    def step_preds(self) -> DataFrame:
        if self._step_preds is None:
            self._step_preds = self._keep(self._build_step_preds())
        return self._step_preds

    def step_log(self) -> DataFrame:
        if self._step_log is None:
            self._step_log = self._keep(self._build_step_log())
        return self._step_log

    def steps_of(self, rows: DataFrame) -> DataFrame:
        """Rows (each once per ``epoch``) with the ``step`` they are seen in."""
        plan = F.broadcast(self.p.plan.select("task", "batch_size", "train_batches"))
        tr = two_stage_rank(rows.withColumn("_key", order_key("id", SPLIT_SEED, F.col("epoch"))), ["task", "epoch"],
                            ["_key", "id", "label_idx"], hex_bucket("_key"), "pos")
        return (tr.join(plan, "task")
                .withColumn("step", (F.floor((F.col("pos") - 1) / F.col("batch_size")) + 1).cast("bigint"))
                .filter(F.col("step") <= F.col("train_batches")))

    def epochs(self) -> DataFrame:
        """Keys of the train rows, once per epoch."""
        return self.nb.rows.filter(F.col("split") == "train").select("task", "id", "label_idx").withColumn(
            "epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(self.n_epochs).cast("bigint"))))

    def cuts(self) -> DataFrame:
        """(``task``, ``epoch``, ``part``, ``upto``): the last row, by order key, of each of an epoch's parts: the steps between two
        evaluations, and those behind the last.  Found from the keys; the rows themselves are compared with them."""
        every, per_epoch = self.periods()
        steps = self.steps_of(self.epochs())
        last = F.struct("_key", "id", "label_idx", "_same")
        # Rows alike in all of these are told apart by number.
        alike = Window.partitionBy("task", "epoch", "id", "label_idx").orderBy("pos")
        steps = steps.withColumn("_same", F.row_number().over(alike)) if self.nb.repeated is not None else steps.withColumn("_same", F.lit(1))
        part = F.least(F.ceil(F.col("step") / every), F.lit(per_epoch + 1)).cast("int").alias("part")
        return self._keep(steps.groupBy("task", "epoch", part).agg(F.max(last).alias("upto")))

    def periods(self) -> tuple[int, int]:
        """(steps between evaluations, evaluations per epoch); all tasks have the same number of steps."""
        steps = self.p.plan.agg(F.min("train_batches")).first()[0]
        every = max(1, steps // EVALS_PER_EPOCH)
        return every, steps // every

    def dev_eval(self) -> DataFrame:
        """Dev loss and macro-F1 per (evaluation, task) under the heads as they stand
        then: ``run_id``, ``epoch``, ``step``, ``task``, ``loss``, ``f1``."""
        if self._dev_eval is None:
            self._dev_eval = self._keep(self._build_dev_eval())
        return self._dev_eval

    def classes(self) -> dict[str, int]:
        return {r["task"]: r["n"] for r in self.p.label_dim.groupBy("task").agg(
            (F.max("label_idx") + 1).alias("n")).collect()}

    def features(self) -> DataFrame:
        """Hashed features of all split rows: the ``packed`` counts of each row, whose Euclidean norm they are over once a pass reads
        them.  Rows of repeated keys have the counts of all of them, as ``slot`` and ``value``."""
        cols = ["task", "split", "id", "label_idx", "slot", "value", "packed"]
        none = {"slot": F.lit(None).cast("array<int>"), "value": F.lit(None).cast("array<double>")}
        own, again = self.nb.counted.withColumns(none), self.nb.repeated
        if again is None:
            return own.select(*cols, F.lit(1).alias("_same"))
        alike = Window.partitionBy("task", "split", "id", "label_idx").orderBy(F.size("slot"))
        rows = gr.feature_rows(self.nb.grouped, ct.with_keys(self.nb.rows, again, "left_semi"), gr.FEATURES)
        rows = rows.withColumn("packed", F.lit(None).cast("binary"))
        rows = self._keep(rows.select(*cols, F.row_number().over(alike).alias("_same")))
        alone = ct.with_keys(own, again, "left_anti")
        return alone.select(*cols, F.lit(1).alias("_same")).unionByName(rows)

    def part_rows(self, feats: DataFrame, cuts: DataFrame, epoch: int, part: int) -> DataFrame:
        """Train rows of a part of an epoch: those behind the last row of the part before, up to the part's own."""
        bounds = cuts.filter(F.col("epoch") == epoch).groupBy("task").agg(
            F.max(F.when(F.col("part") < part, F.col("upto"))).alias("_after"), F.max(F.when(F.col("part") == part, F.col("upto"))).alias("_upto"))
        at = F.struct(order_key("id", SPLIT_SEED, epoch).alias("_key"), "id", "label_idx", "_same")
        rows = feats.filter(F.col("split") == "train").join(F.broadcast(bounds), "task").withColumn("_at", at)
        rows = rows.filter((F.col("_at") <= F.col("_upto")) & (F.col("_after").isNull() | (F.col("_at") > F.col("_after"))) & F.col("id").isNotNull())
        return self.pass_rows(rows, "train", F.lit(epoch).cast("bigint"))

    @staticmethod
    def pass_rows(rows: DataFrame, kind: str, epoch: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "task", "split", "id", "label_idx", epoch.alias("epoch"),
                           F.lit(None).cast("bigint").alias("step"), "slot", "value", "packed")

    def fit(self):
        """(passes, states, features) of the run: see ``gradient.train``."""
        if self._fit is None:
            every, per_epoch = self.periods()
            classes, feats, cuts = self.classes(), self.features(), self.cuts()
            # Steps behind an epoch's last evaluation belong to the block of the next one.
            more = {r["epoch"] for r in cuts.filter(F.col("part") > per_epoch).select("epoch").distinct().collect()}
            blocks = []
            for k in range(per_epoch * self.n_epochs + 1):
                epoch, part = k // per_epoch + 1, k % per_epoch + 1
                own = [(epoch, part)] if epoch <= self.n_epochs else []
                parts = ([(epoch - 1, per_epoch + 1)] if part == 1 and epoch - 1 in more else []) + own
                rows = [self.part_rows(feats, cuts, *p) for p in parts] or [self.part_rows(feats, cuts, 1, 1).limit(0)]
                blocks.append(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))
            dev = self.pass_rows(feats.filter(F.col("split") == "dev"), "dev", F.lit(None).cast("bigint"))
            self._fit = (*gr.train(blocks, dev, classes, gr.FEATURES, self._keep), feats)
        return self._fit

    def final_scores(self) -> DataFrame:
        """All labelled rows scored by the heads of the last evaluation."""
        every, per_epoch = self.periods()
        _, states, feats = self.fit()
        classes = self.classes()
        heads = gr.fetched(states[per_epoch * self.n_epochs - 1], classes, gr.FEATURES)
        rows = self.pass_rows(feats.filter(F.col("split") != "test"), "dev", F.lit(None).cast("bigint"))
        return gr.scored(rows, heads).select("task", "split", "id", "label_idx", ar.argmax("logits").alias("pred_idx"))

    def _build_dev_eval(self) -> DataFrame:
        every, per_epoch = self.periods()
        passes, _, _ = self.fit()
        each = None
        for k, passed in enumerate(passes[1:], 1):
            one = passed.filter("kind = 'dev'").select("task", "id", "label_idx", "logits", F.lit(k).alias("period"))
            each = one if each is None else each.unionByName(one)
        each = each.withColumn("pred_idx", ar.argmax("logits"))
        batch = self.dev_batched().select("task", "id", "batch_id")
        loss = ls.batch_mean(each.join(batch, ["task", "id"]), ["period", "task"])
        f1 = mt.macro_f1(each, ["period", "task"])
        return f1.join(loss, ["period", "task"]).select(
            F.lit(RUN_ID).alias("run_id"),
            (F.floor((F.col("period") - 1) / per_epoch) + 1).cast("bigint").alias("epoch"),
            (((F.col("period") - 1) % per_epoch + 1) * every).cast("bigint").alias("step"),
            "task", F.col("batch_mean").alias("loss"), F.col("macro_f1").alias("f1"))

    def _build_step_preds(self) -> DataFrame:
        passes, _, _ = self.fit()
        rows = None
        for passed in passes:
            one = passed.filter("kind = 'train'").select("epoch", "task", "id", "label_idx", "logits")
            rows = one if rows is None else rows.unionByName(one)
        # Rows without an id have a place in the order, but no step.
        lost = self.epochs().filter(F.col("id").isNull()).withColumn("logits", F.lit(None).cast("array<double>"))
        rows = rows if self.nb.repeated is None else rows.unionByName(lost)
        return self.steps_of(rows).select(F.lit(RUN_ID).alias("run_id"), "epoch", "step", "task", "id", "label_idx",
                                          ar.argmax("logits").alias("pred_idx"), "logits")

    def _build_step_log(self) -> DataFrame:
        sp = self.step_preds().withColumn("_nll", ls.nll())
        return sp.groupBy("run_id", "epoch", "step", "task").agg(
            F.avg("_nll").alias("loss"),
            F.avg((F.col("pred_idx") == F.col("label_idx")).cast("double")).alias("acc"),
            F.count(F.lit(1)).cast("bigint").alias("n"))

    def steps_per_epoch(self, log: DataFrame) -> DataFrame:
        return log.groupBy("run_id").agg(F.max("step").alias("spe"), F.max("epoch").alias("n_epochs"))


def _t(spark, sf_dir) -> Training:
    return Training.get(spark, sf_dir)


# --- losses (step 6) ------------------------------------------------------------

def cross_entropy(spark, sf_dir):
    t = _t(spark, sf_dir)
    plain = ls.cross_entropy(t.split_preds("dev")).select("task", F.col("loss").alias("ce"), "n")
    wtd = ls.cross_entropy(t.split_preds("dev"), weights=t.class_weight_idx()).select(
        "task", F.col("loss").alias("weighted_ce"))
    return plain.join(wtd, "task").select("task", F.col("n").cast("bigint").alias("n"),
                                          r6("ce").alias("ce"), r6("weighted_ce").alias("weighted_ce"))


def focal(spark, sf_dir):
    t = _t(spark, sf_dir)
    alpha = ls.alpha_table(t.class_weight_idx())
    dev = t.split_preds("dev")
    out = None
    for mode in ("paired", "broadcast"):
        for reduce in ("mean", "sum"):
            f = ls.focal(dev, alpha, mode=mode, reduce=reduce).select(
                "task", F.lit(mode).alias("mode"), F.lit(reduce).alias("reduce"), r6("loss").alias("loss"))
            out = f if out is None else out.unionByName(f)
    sm = ls.focal(dev, alpha, smooth=0.1).select("task", F.lit("paired_smooth").alias("mode"),
                                                 F.lit("mean").alias("reduce"), r6("loss").alias("loss"))
    return out.unionByName(sm)


def dice(spark, sf_dir):
    t = _t(spark, sf_dir)
    dev = t.split_preds("dev")
    parts = []
    for mode in ("probs", "raw"):
        parts.append(ls.dice_per_class(dev, mode=mode).select(
            "task", F.lit(mode).alias("mode"), F.col("class_idx").cast("bigint").alias("class_idx"),
            r6("dice").alias("dice")))
    tot = ls.dice(dev, mode="probs", weights=t.class_weight_idx()).select(
        "task", F.lit("probs_weighted").alias("mode"), F.lit(-1).cast("bigint").alias("class_idx"),
        r6("loss").alias("dice"))
    return parts[0].unionByName(parts[1]).unionByName(tot)


def batch_mean_loss(spark, sf_dir):
    t = _t(spark, sf_dir)
    b = ls.batch_mean(t.dev_batched())
    return b.select("task", r6("batch_mean").alias("batch_mean"), r6("row_mean").alias("row_mean"),
                    F.col("n_batches").cast("bigint").alias("n_batches"))


def loss_by_name(spark, sf_dir):
    t = _t(spark, sf_dir)
    dev, w = t.split_preds("dev"), t.class_weight_idx()
    out = None
    for name in ls.LOSSES:
        f = ls.compute(dev, name, weights=w).select("task", F.lit(name).alias("loss_name"), r6("loss").alias("loss"))
        out = f if out is None else out.unionByName(f)
    return out


# --- metrics (step 7) -------------------------------------------------------------

def confusion(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mt.confusion(t.preds.filter(F.col("split") != "test"), ["task", "split"]).select(
        "task", "split", F.col("label_idx").cast("bigint").alias("label_idx"),
        F.col("pred_idx").cast("bigint").alias("pred_idx"), "n")


def accuracy(spark, sf_dir):
    t = _t(spark, sf_dir)
    a = mt.accuracy(t.preds.filter(F.col("split") != "test"), ["task", "split"])
    return a.select("task", "split", r6("accuracy").alias("accuracy"), "n")


def per_class_f1(spark, sf_dir):
    t = _t(spark, sf_dir)
    pc = mt.per_class(mt.confusion(t.split_preds("dev")))
    return pc.select("task", F.col("class_idx").cast("bigint").alias("class_idx"), "tp", "n_pred", "n_true",
                     r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


def macro_f1(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mt.macro_f1(t.preds.filter(F.col("split") != "test"), ["task", "split"]).select(
        "task", "split", r6("macro_f1").alias("macro_f1"))


def evaluate(spark, sf_dir):
    t = _t(spark, sf_dir)
    tl = ls.batch_mean(t.dev_batched()).select("task", F.col("batch_mean").alias("loss"))
    e = mt.evaluate(t.split_preds("dev"), tl)
    return e.select(r6("f1").alias("dev_f1"), r6("loss").alias("dev_loss"), "n_tasks")


def decoded_predictions(spark, sf_dir):
    t = _t(spark, sf_dir)
    d = mt.decode_labels(t.split_preds("test"), t.p.label_dim)
    return d.select("task", "id", F.col("pred_idx").cast("bigint").alias("pred_idx"), "pred_label")


def submission(spark, sf_dir):
    """A7 with positional ids (E10): the JSON lines per task."""
    from ..operators import batching as bt
    t = _t(spark, sf_dir)
    d = mt.decode_labels(t.split_preds("test"), t.p.label_dim)
    pos = bt.submission_positions(d.select("task", "id", "pred_label"))
    return mt.submission_lines(pos, "position").select("task", "line")


# --- training log, weighting, monitor (steps 7-8) ----------------------------------

def step_log(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.step_log().select("run_id", "epoch", "step", "task", r6("loss").alias("loss"),
                               r6("acc").alias("acc"), "n")


def dwa_weights(spark, sf_dir):
    t = _t(spark, sf_dir)
    log = t.step_log()
    out = None
    for mode in ("paper", "current", "reference"):
        d = wt.dwa(log, mode=mode).select("epoch", "step", "task", F.lit(mode).alias("mode"),
                                          r6("weight").alias("weight"))
        out = d if out is None else out.unionByName(d)
    return out


def dtp_weights(spark, sf_dir):
    t = _t(spark, sf_dir)
    return wt.dtp(t.step_log()).select("epoch", "step", "task", r6("weight").alias("weight"))


def uw_terms(spark, sf_dir):
    t = _t(spark, sf_dir)
    log = t.step_log()
    a = wt.uw(log).select("epoch", "step", "task", F.lit("init").alias("mode"), r6("term").alias("term"))
    b = wt.uw(log, closed_form=True).select("epoch", "step", "task", F.lit("closed_form").alias("mode"),
                                            r6("term").alias("term"))
    return a.unionByName(b)


def total_loss(spark, sf_dir):
    t = _t(spark, sf_dir)
    log = t.step_log()
    out = None
    for s in wt.STRATEGIES:
        d = wt.total_loss(log, s).select("epoch", "step", F.lit(s).alias("strategy"), r6("total").alias("total"))
        out = d if out is None else out.unionByName(d)
    return out


def running_f1(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mo.running_f1(t.step_preds(), t.periods()[0]).select(
        "run_id", "epoch", "step", "task", r6("f1").alias("f1"))


def running_loss(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mo.running_loss(t.step_log()).select("run_id", "epoch", "step", r6("total").alias("total"),
                                                r6("running_loss").alias("running_loss"))


def dev_eval(spark, sf_dir):
    """Dev loss and macro-F1 of the heads at every evaluation."""
    return _t(spark, sf_dir).dev_eval().select("run_id", "epoch", "step", "task", r6("loss").alias("loss"),
                                               r6("f1").alias("f1"))


TASK_NAMES = [t.name for t in TASKS]


def _best(t: Training):
    log = t.step_log()
    ev = mo.eval_log(log, t.step_preds(), t.dev_eval(), TASK_NAMES, t.periods()[0])
    return log, mo.best_so_far(ev)


def best_so_far(spark, sf_dir):
    _, b = _best(_t(spark, sf_dir))
    return b.select("run_id", "epoch", "step", r6("train_f1").alias("train_f1"), r6("dev_f1").alias("dev_f1"),
                    r6("best_f1").alias("best_f1"), "flag")


def early_stop(spark, sf_dir):
    t = _t(spark, sf_dir)
    log, b = _best(t)
    return mo.early_stop(b, t.steps_per_epoch(log), MONITOR_PATIENCE)


def resume_point(spark, sf_dir):
    return mo.resume_point(_t(spark, sf_dir).step_log())


def progress_log(spark, sf_dir):
    """The progress lines as the log table has them, after a writer that ran twice."""
    from ..streaming.running import scratch
    _, b = _best(_t(spark, sf_dir))
    lines, path = mo.format_progress(b, TASK_NAMES), scratch(spark, "progress")
    mo.append_log(lines.filter("epoch = 1"), path)
    mo.append_log(lines, path)
    return mo.read_log(spark, path)


def focal_alpha(spark, sf_dir):
    """D15 with a scalar alpha (for the last class, and for class 0) and without alpha."""
    t = _t(spark, sf_dir)
    w, dev, out = t.class_weight_idx(), t.split_preds("dev"), None
    for name, alpha, index in (("last_0.25", 0.25, -1), ("first_0.75", 0.75, 0), ("none", None, -1)):
        f = ls.focal(dev, ls.alpha_table(w, alpha, index)).select(
            "task", F.lit(name).alias("alpha"), r6("loss").alias("loss"))
        out = f if out is None else out.unionByName(f)
    return out
