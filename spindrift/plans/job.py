"""Jobs: what to migrate to which model, with which limits; strict, read from YAML. And the findings about a plan."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from spindrift.plans import spec as S

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}$")


class JobError(ValueError):
    """A job file that can't be used."""


@dataclass(frozen=True)
class Source:
    table: str = ""
    vector_column: str | None = None
    text_column: str | None = None
    model: str | None = None
    group_by: str | None = None


@dataclass(frozen=True)
class Target:
    column: str = "new_vector"
    vector_type: str = "vector"
    index: str = "hnsw"
    metric: str | None = None


@dataclass(frozen=True)
class Limits:
    budget_usd: float | None = None
    tokens_per_minute: int | None = None
    requests_per_minute: int | None = None
    parallel: int | None = None


@dataclass(frozen=True)
class Job:
    name: str
    source: Source
    model: S.ModelSpec
    target: Target = field(default_factory=Target)
    limits: Limits = field(default_factory=Limits)
    cache: str | None = None


_CHOICES = {"vector_type": ("vector", "halfvec"), "index": ("hnsw", "ivfflat", "none"), "metric": (None, "cosine", "l2", "inner_product")}


def _strict(kind: type, data, where: str):
    data = data or {}
    if not isinstance(data, dict):
        raise JobError(f"{where} must be a mapping")
    known = {f.name for f in fields(kind)}
    if extra := sorted(set(data) - known):
        raise JobError(f"{where} has unknown keys: {', '.join(extra)}")
    for k, choices in _CHOICES.items():
        if k in data and data[k] not in choices:
            raise JobError(f"{where}.{k} is one of {', '.join(map(str, choices))}")
    return kind(**data)


def parse(data: dict) -> Job:
    """Unknown keys are refused; an empty section means its defaults."""
    if not isinstance(data, dict):
        raise JobError("a job is a mapping")
    if extra := sorted(set(data) - {"name", "source", "model", "target", "limits", "cache"}):
        raise JobError(f"unknown keys: {', '.join(extra)}")
    if not data.get("name") or not data.get("model"):
        raise JobError("a job needs name and model")
    source, target = _strict(Source, data.get("source"), "source"), _strict(Target, data.get("target"), "target")
    if not source.table:
        raise JobError("source.table is needed")
    for what, name in (("source.vector_column", source.vector_column), ("source.text_column", source.text_column), ("target.column", target.column)):
        if name is not None and not _NAME.match(name):
            raise JobError(f"{what} is no column name: {name!r}")
    limits = _strict(Limits, data.get("limits"), "limits")
    for f in fields(limits):
        if (v := getattr(limits, f.name)) is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v <= 0):
            raise JobError(f"limits.{f.name} must be a positive number")
    try:
        model = S.parse(data["model"])
        if source.model:
            S.parse(source.model)
    except S.SpecError as e:
        raise JobError(str(e)) from e
    if isinstance(limits.parallel, float):
        raise JobError("limits.parallel must be a whole number")
    if data.get("cache") is not None and not isinstance(data["cache"], str):
        raise JobError("cache is a folder")
    return Job(str(data["name"]), source, model, target, limits, data.get("cache"))


def load(path: str | Path) -> Job:
    import yaml

    try:
        return parse(yaml.safe_load(Path(path).read_text()))
    except OSError as e:
        raise JobError(f"can't read {path}: {e.strerror}") from e
    except yaml.YAMLError as e:
        raise JobError(f"{path} isn't YAML") from e


def template(table: str, model: str, column: str = "new_vector", vector: str | None = None, text: str | None = None, old_model: str | None = None, budget: float | None = None) -> str:
    """A job file to start from."""
    show = lambda k, v, example: f"  {k}: {v}\n" if v is not None else f"  # {k}: {example}\n"
    return (
        f"name: {re.sub('[^a-z0-9]+', '-', table.lower()).strip('-')}\nsource:\n  table: {table}\n" + show("vector_column", vector, "embedding") + show("text_column", text, "content")
        + show("model", old_model, "openai/text-embedding-ada-002") + f"model: {model}\ntarget:\n  column: {column}\n  vector_type: vector\n  index: hnsw\nlimits:\n" + show("budget_usd", budget, "10") + "  tokens_per_minute: null\n"
    )


#: The most dimensions a store can index, by vector type.
MOST_DIMENSIONS = {"vector": 2000, "halfvec": 4000}


def plan_findings(job: Job, cost: float | None = None, model_tags: list[str] = (), text_field: str | None = "text", texts: int = 1, rows: int = 1, primary_key: bool = True, column_exists: bool = False, column_dims: int | None = None, cut_over: bool = False, index_bytes: int | None = None, memory: int | None = None) -> list[tuple[str, str]]:
    """(id, severity) of what stands against a plan, in the order of the checks."""
    out, m, dims = [], job.model, S.width(job.model)
    if m.dims and m.provider == "openai" and S.family(m) in S.DIMENSIONS:
        if S.family(m) not in S.SHORTENS and m.dims != S.DIMENSIONS[S.family(m)]:
            out.append(("plan.dims_unsupported", "error"))
        elif m.dims > S.DIMENSIONS[S.family(m)]:
            out.append(("plan.dims_too_large", "error"))
    if m.provider == "hash":
        out.append(("plan.baseline_model", "warning"))
    if text_field is None:
        out.append(("plan.no_text", "error"))
    elif texts < rows:
        out.append(("plan.partial_text", "warning"))
    if any(t.split("@")[0] == f"{m.provider}/{m.model}".lower() for t in model_tags):
        out.append(("plan.same_model", "warning"))
    if not primary_key:
        out.append(("plan.no_primary_key", "error"))
    if cut_over:
        out.append(("plan.cut_over", "error"))
    elif column_exists:
        out.append(("plan.column_conflict", "error") if column_dims and dims and column_dims != dims else ("plan.column_exists", "info"))
    if dims is None:
        out.append(("plan.dims_unknown", "warning"))
    elif job.target.index != "none" and dims > MOST_DIMENSIONS[job.target.vector_type]:
        out.append(("plan.too_large_to_index", "error"))
    if job.limits.budget_usd is not None and cost is not None:
        if cost > job.limits.budget_usd:
            out.append(("plan.over_budget", "error"))
    elif cost and job.limits.budget_usd is None:
        out.append(("plan.no_budget", "info"))
    if m.price is None:
        out.append(("plan.cost_unknown", "info"))
    if index_bytes and memory and index_bytes > memory:
        out.append(("plan.index_memory", "warning"))
    return out


def changes(job: Job, rows: int | None, column_exists: bool = False) -> list[tuple[str, str]]:
    """(kind, summary) of what apply would do, in order."""
    t, live = job.target, job.source.vector_column or "vector"
    out = [] if column_exists else [("add_column", f"add {t.column}, {t.vector_type}({S.width(job.model) or '?'}), to {job.source.table}")]
    out.append(("embed", f"embed {'all' if rows is None else f'about {rows:,}'} rows with {S.title(job.model)}"))
    if t.index != "none":
        out.append(("index", f"build a {t.index} index on {t.column}"))
    return [*out, ("cutover", f"later: {live} becomes {live}_old, {t.column} becomes {live}")]


def suggested_budget(cost: float) -> int:
    return max(1, math.ceil(cost * 1.5))
