"""Embedders as columns, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .text import clean_text

Embedder = Callable[[DataFrame, str, str], DataFrame]
_REGISTRY: dict[str, Callable[..., tuple[Embedder, int]]] = {}


def register_embedder(name: str, factory: Callable[..., tuple[Embedder, int]]) -> None:
    """``factory(**options)`` gives the embedding function and its dimension."""
    _REGISTRY[name] = factory


def get_embedder(name: str = "hashing", **options) -> tuple[Embedder, int]:
    """An embedder by name; an unknown name falls back to the default one."""
    return _REGISTRY.get(name, _REGISTRY["hashing"])(**options)


def dimension(name: str = "hashing", **options) -> int:
    return get_embedder(name, **options)[1]


def hashing_embedder(dim: int = 64) -> tuple[Embedder, int]:
    """Unit term-frequency vectors of hashed words; runs in the JVM and needs no model."""

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        words = F.filter(F.split(F.lower(clean_text(F.col(text))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        counted = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(df.withColumn("_words", words))
        unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    return embed, dim


def model_embedder(load: Callable[[], Callable[[list[str]], list]], dim: int, batch: int = Config.embed_batch) -> tuple[Embedder, int]:
    """A user-supplied model: ``load`` runs once per Python worker, texts go in by batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            vectors: list = []
            for at in range(0, len(texts), batch):
                vectors += [list(map(float, v)) for v in model(list(texts.iloc[at : at + batch]))]
            yield pd.Series(vectors, dtype=object)

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, run(clean_text(F.col(text))))

    return embed, dim


register_embedder("hashing", hashing_embedder)
register_embedder("model", model_embedder)


def is_stale(vector: Column, vector_dim: Column, dim: int) -> Column:
    """Rows the incremental stage has to embed."""
    return vector.isNull() | vector_dim.isNull() | (vector_dim != dim)


def embed_missing(chunks: DataFrame, embedder: Embedder, dim: int) -> DataFrame:
    """Chunks with every missing or outdated vector filled; fresh ones pass untouched."""
    stale = is_stale(F.col("embedding"), F.col("embedding_dim"), dim)
    todo = chunks.filter(stale).drop("embedding", "embedding_dim")
    done = embedder(todo, "text", "embedding").withColumn("embedding_dim", F.lit(dim))
    return chunks.filter(~stale).unionByName(done)
