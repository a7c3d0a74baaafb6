"""Slots for models: encoders (prompt to tensors), embedders (item to vector), decoders (vector to bytes).

No model is part of this package. A slot takes a function of a pandas batch and keeps the contract: Arrow batches of a
bounded number of rows, one result a row, a model loaded once for each worker task. Backends are names with knobs and
the shapes of their tensors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Load = Callable[[], Callable[[list[str]], dict[str, np.ndarray]]]


@dataclass(frozen=True)
class Backend:
    """A family of models: its tensors' shapes, defaults for missing knobs, how many prompts are encoded at once, and
    its encoder, a function that loads the model and gives one from prompts to {tensor: array (n, *shape)}."""

    name: str
    tensors: dict[str, tuple[int, ...]]
    defaults: dict[str, float] = field(default_factory=dict)
    batch: int = 8
    load: Load | None = None

    @property
    def sizes(self) -> dict[str, int]:
        return {t: int(np.prod(s)) for t, s in self.tensors.items()}


_BACKENDS: dict[str, Backend] = {}


def register(backend: Backend) -> Backend:
    _BACKENDS[backend.name] = backend
    return backend


def backend(name: str) -> Backend:
    """A backend by its name; it need not have a model to be asked for its shapes and defaults."""
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}, not in {sorted(_BACKENDS)}")
    return _BACKENDS[name]


# Tensors of the known backends (tokens, features), prompts encoded at once, knobs. The features of the
# flow models are those of the text encoder that is loaded, which a slot with an encoder states.
for _name, _tensors, _batch, _knobs in (
    ("sd15", {"embeds": (77, 768)}, 16, {"steps": 30, "guidance": 7.5, "height": 512, "width": 512}),
    ("sd2", {"embeds": (77, 1024)}, 16, {"steps": 30, "guidance": 9.0, "height": 768, "width": 768}),
    ("sdxl", {"prompt_embeds": (77, 2048), "pooled": (1280,)}, 8, {"steps": 1, "guidance": 0.0, "height": 1024, "width": 1024}),
    ("flux2", {}, 8, {"steps": 28, "guidance": 4.0, "height": 1024, "width": 1024}),
    ("krea2", {}, 8, {"steps": 28, "guidance": 4.5, "height": 1024, "width": 1024}),
):
    register(Backend(_name, _tensors, _knobs, _batch))


def encode(prompts: DataFrame, b: Backend, column: str = "prompt", id: str = "id") -> DataFrame:
    """(tensor, id, e): every prompt encoded into the backend's tensors, flattened row by row. Null prompts count as
    empty ones. A result of another shape is an error."""
    if b.load is None:
        raise ValueError(f"backend {b.name!r} has no encoder")
    kind, sizes, load, size = dict(prompts.dtypes)[id], b.sizes, b.load, b.batch

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in it:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                got = model([p or "" for p in part["prompt"]])
                for t, n in sizes.items():
                    x = np.asarray(got[t], float).reshape(len(part), -1)
                    if x.shape[1] != n:
                        raise ValueError(f"{x.shape[1]} numbers for tensor {t!r}, not {n}")
                    yield pd.DataFrame({"tensor": t, "id": part["id"], "e": list(x)})

    return prompts.select(F.col(id).alias("id"), F.col(column).alias("prompt")).mapInPandas(run, f"tensor string, id {kind}, e array<double>")


def embed_new(items: DataFrame, cache: DataFrame, embed: Callable[[pd.Series], np.ndarray], key: str = "rel") -> DataFrame:
    """``cache`` (key, e) with the missing items embedded and scaled to length 1. Items that are there aren't embedded
    again; zero vectors stay zero."""
    todo = items.select(key).distinct().join(cache.select(key), key, "left_anti")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.asarray(embed(pdf[key]), float).reshape(len(pdf), -1)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({key: pdf[key], "e": list(x / np.where(n > 0, n, 1))})

    schema = T.StructType([items.schema[key], T.StructField("e", T.ArrayType(T.DoubleType()))])
    return cache.select(key, "e").unionByName(todo.mapInPandas(run, schema))


def decode(vectors: DataFrame, load: Callable[[], Callable[[np.ndarray], list[bytes]]], batch: int = 4) -> DataFrame:
    """(id, image): what a decoder makes of each vector; as many results as vectors or it is an error."""
    kind = dict(vectors.dtypes)["id"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in it:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                out = model(np.stack(part["e"].to_numpy()))
                if len(out) != len(part):
                    raise ValueError(f"{len(out)} images for {len(part)} vectors")
                yield pd.DataFrame({"id": part["id"], "image": out})

    return vectors.select("id", "e").mapInPandas(run, f"id {kind}, image binary")
