"""Jobs declared in parameter files: operators by name, in blocks that may nest."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from sinoflow.operators import penalised, recon, stencil
from sinoflow.sources import headers

_FILTERS: dict[str, Callable] = {}
_METHODS: dict[str, Callable] = {}


def register(table: dict, name: str):
    def add(f):
        table[name.lower()] = f
        return f

    return add


def parse(text: str) -> dict:
    """Nested keywords: a block opens with ``<name> parameters :=`` and closes with ``end <name> parameters :=``."""
    stack: list[dict] = [{}]
    names: list[str] = []
    for key, index, value in headers.entries(text):
        if key.startswith("end") and re.fullmatch(r"end( .*)?", key):
            if len(stack) > 1:
                stack.pop(), names.pop()
        elif re.search(r"\bparameters$", key) or (not names and key.endswith("parameters")):
            inner: dict = {}
            stack[-1][re.sub(r" ?parameters$", "", key)] = inner
            stack.append(inner), names.append(key)
        elif index is not None:
            stack[-1].setdefault(key, {})[index] = value
        else:
            stack[-1][key] = value
    if len(stack) > 1 and len(names) > 1:
        raise ValueError(f"block without an end: {names[-1]}")
    return stack[0]


def find(job: dict, key: str, default=None):
    """A keyword of a block or of those inside it."""
    if key in job:
        return job[key]
    for v in job.values():
        if isinstance(v, dict) and (found := find(v, key)) is not None:
            return found
    return default


@register(_FILTERS, "Separable Gaussian")
def _gaussian(image: DataFrame, by: list[str], p: dict) -> DataFrame:
    widths = [float(find(p, f"{a}-dir filter fwhm (in mm)", 0)) for a in stencil.AXES]
    return stencil.separable(image, by, {a: stencil.gaussian_kernel(w) for a, w in zip(stencil.AXES, widths, strict=True) if w > 0})


@register(_FILTERS, "Median")
def _median(image: DataFrame, by: list[str], p: dict) -> DataFrame:
    return stencil.rank_filter(image, by, int(find(p, "mask radius x", 1)), "median")


@register(_METHODS, "OSMAPOSL")
def _osmaposl(matrix, data, start, image_key, p: dict) -> DataFrame:
    subsets, updates = int(find(p, "number of subsets", 1)), int(find(p, "number of subiterations", 1))
    prior = str(find(p, "prior type", "none")).lower()
    if prior in ("none", "", "0"):
        return recon.osem(matrix, data, start, [image_key, "z"], subsets, updates)
    if prior != "quadratic":
        raise ValueError(f"prior type {prior}")
    form = str(find(p, "map model", "additive")).lower()
    return recon.map_osl(matrix, data, start, image_key, subsets, updates, float(find(p, "penalisation factor", 0)), multiplicative=form == "multiplicative")


@register(_METHODS, "OSSPS")
def _ossps(matrix, data, start, image_key, p: dict) -> DataFrame:
    prior = str(find(p, "prior type", "none")).lower()
    subsets, updates = int(find(p, "number of subsets", 1)), int(find(p, "number of subiterations", 1))
    steps = {"relaxation": float(find(p, "relaxation parameter", 1)), "gamma": float(find(p, "relaxation gamma", 0.1))}
    if prior in ("none", "", "0"):
        return recon.ossps(matrix, data, start, [image_key, "z"], subsets, updates, **steps)
    if prior != "quadratic":
        raise ValueError(f"prior type {prior}")
    return penalised.ossps(matrix, data, start, image_key, subsets, updates, float(find(p, "penalisation factor", 0)), **steps)


def run(text: str, matrix: DataFrame, data: DataFrame, start: DataFrame, image_key: str = "image_id") -> DataFrame:
    """Reconstruct ``data`` as a parameter file says: its outermost block names the method, ``post-filter type`` a filter."""
    job = parse(text)
    method = next(iter(job), "")
    if method not in _METHODS:
        raise ValueError(f"no method {method!r}; known: {sorted(_METHODS)}")
    image = _METHODS[method](matrix, data, start, image_key, job[method])
    name = str(find(job, "post-filter type", "none")).lower()
    if name in ("none", ""):
        return image
    if name not in _FILTERS:
        raise ValueError(f"no filter {name!r}; known: {sorted(_FILTERS)}")
    return _FILTERS[name](image, [image_key], job[method])
