"""Extension registry (2.L): named strategies chosen by configuration.

The reference switches losses, weighting strategies, perturbation methods and
heads by name.  Here each kind maps names to ``DataFrame -> DataFrame`` (or
Column-builder) callables; unknown names fail with a clear error.
"""

from __future__ import annotations

from collections.abc import Callable

_REGISTRY: dict[str, dict[str, Callable]] = {}


def register(kind: str, name: str, fn: Callable | None = None):
    """Register ``fn`` under (kind, name); usable as a decorator."""
    def deco(f: Callable) -> Callable:
        _REGISTRY.setdefault(kind, {})[name] = f
        return f
    return deco(fn) if fn is not None else deco


def get(kind: str, name: str) -> Callable:
    try:
        return _REGISTRY[kind][name]
    except KeyError:
        raise ValueError(f"no {kind} named {name!r}; known: {sorted(_REGISTRY.get(kind, {}))}") from None


def names(kind: str) -> list[str]:
    return sorted(_REGISTRY.get(kind, {}))


def dispatch(rows, heads: dict[str, str], **kw):
    """The rows of each task through the head that ``heads`` names for it."""
    from pyspark.sql import functions as F
    out = None
    for task, name in heads.items():
        part = get("head", name)(rows.filter(F.col("task") == task), **kw)
        out = part if out is None else out.unionByName(part)
    return out


def _builtin() -> None:
    from .functions import arrays
    from .operators import heads, losses, perturb, weighting

    register("loss", "cross_entropy", lambda df, **kw: losses.compute(df, "cross_entropy", **kw))
    register("loss", "focal_loss", lambda df, **kw: losses.compute(df, "focal_loss", **kw))
    register("loss", "dice_loss", lambda df, **kw: losses.compute(df, "dice_loss", **kw))
    for s in weighting.STRATEGIES:
        register("strategy", s, lambda log, _s=s, **kw: weighting.total_loss(log, _s, **kw))
    register("head", "nb", lambda df, **kw: df.withColumn("pred_idx", arrays.argmax("logits")))
    register("head", "majority", lambda df, **kw: heads.majority(df, kw["prior"]))
    register("head", "linear", lambda df, **kw: heads.linear_score(df, kw["model"]).withColumn(
        "pred_idx", arrays.argmax("logits")))
    register("adversarial", "fgm", perturb.fgm)
    register("adversarial", "pgd", perturb.pgd)
    register("adversarial", "freelb", perturb.freelb)


_builtin()
