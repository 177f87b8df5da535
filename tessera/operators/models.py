"""Plug-in points for models: embedders and generators, batched through Arrow. Only deterministic stand-ins are built in.

A model is given as an object, which goes to the workers as it is, or as ``workers.Lazy``, which each worker loads once. The stand-in embedder hashes words into a vector; it is no sentence encoder and its scores mean nothing beyond shared words.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vocabulary as V
from tessera.operators import prompt as P
from tessera.operators.workers import model, ship


WORDS = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_hashes: dict[str, int] = {}


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """(n, dim); rows are normalised by the caller."""


class Generator(Protocol):
    def generate(self, prompts: list[str], temperature: float, max_new_tokens: int) -> list[str]: ...


@dataclass
class HashingEmbedder:
    """Signed counts of a text's words (runs of ASCII letters and digits) by their MD5: seven hex digits choose the place, the next one the sign."""

    dim: int = 384
    name: str = "hashing-stand-in"
    most_words: int | None = None

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        inside = _IN_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = ends[:-1][ends[:-1] < len(data)]
        first[edge] = inside[edge]  # a word never goes on in the next text
        starts = np.flatnonzero(first)
        row = np.searchsorted(ends, starts, side="right") - 1
        letters = _LOWER[data[inside]]
        at = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        word = np.asarray(coded.indices, np.int64)
        if self.most_words is not None:
            early = np.arange(len(row)) - np.searchsorted(row, row) < self.most_words
            row, word = row[early], word[early]
        place, sign = self._hashed(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return np.bincount(row * self.dim + place[word], sign[word], len(texts) * self.dim).reshape(len(texts), self.dim)

    def _hashed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place and sign of distinct words; a worker remembers ``WORDS`` of them."""
        found = list(map(_hashes.get, words))
        if len(_hashes) + len(words) > WORDS:
            _hashes.clear()
        for i in [i for i, h in enumerate(found) if h is None]:
            x = hashlib.md5(words[i].encode()).hexdigest()
            found[i] = _hashes[words[i]] = int(x[:7], 16) * 2 + (x[7] >= "8")
        h = np.array(found, np.int64)
        return (h >> 1) % self.dim, np.where(h & 1, 1.0, -1.0)


@dataclass
class EchoGenerator:
    """Answers with a digest of the prompt and the settings."""

    tag: str = "base"

    def generate(self, prompts: list[str], temperature: float, max_new_tokens: int) -> list[str]:
        return [f"{self.tag}:{hashlib.md5(p.encode('utf-8', 'surrogatepass')).hexdigest()[:8]}:{temperature:g}:{max_new_tokens}" for p in prompts]


def embed(df: DataFrame, text: str, embedder: Embedder, batch: int = 32, into: str = "embedding") -> DataFrame:
    """Adds unit vectors of a text column, in place of a column of that name; the embedder is called with ``batch`` texts."""
    ship(df.sparkSession)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != into or c == text])
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])

    def run(batches):
        own = model(embedder)
        for b in batches:
            vectors = []
            for s in range(0, b.num_rows, batch):
                v = np.asarray(own.embed([t or "" for t in b.column(at).slice(s, batch).to_pylist()]), np.float64)
                vectors.append((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32))
            flat = np.concatenate(vectors) if vectors else np.zeros((0, 0), np.float32)
            ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * np.int32(flat.shape[1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(flat.reshape(-1)))], schema.names)

    return df.mapInArrow(run, schema)


def generate(df: DataFrame, prompt: str, generator: Generator, temperature: float = 0.3, max_new_tokens: int = 300, into: str = "response", seconds: str = "seconds", batch: int = 8) -> DataFrame:
    """Adds the generator's stripped answer and the time it took, in place of columns of these names; null prompts have null answers."""
    ship(df.sparkSession)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (into, seconds) or c == prompt])
    at = df.columns.index(prompt)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType()), T.StructField(seconds, T.DoubleType())])

    def run(batches):
        own = model(generator)
        for b in batches:
            out, took = [], []
            for s in range(0, b.num_rows, batch):
                prompts = b.column(at).slice(s, batch).to_pylist()
                began = time.perf_counter()
                got = iter(own.generate([p for p in prompts if p is not None], temperature, max_new_tokens))
                out += [None if p is None else next(got).strip() for p in prompts]
                took += [(time.perf_counter() - began) / len(prompts)] * len(prompts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(took, pa.float64())], schema.names)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Profile:
    """A configuration of the comparison: which model, whether it sees contexts, and its temperature."""

    config: str
    tuned: bool
    with_context: bool
    temperature: float
    title: str


PROFILES = (
    Profile("A", True, False, 0.7, "Tuned Model (No RAG)"),
    Profile("B", False, True, 0.3, "Base Model + RAG"),
    Profile("C", True, True, 0.3, "Tuned Model + RAG"),
)


def answers(questions: DataFrame, base: Generator, tuned: Generator | None, *, profiles=PROFILES, missing: str = "suffix", names: V.Names = V.Names()) -> DataFrame:
    """(query_id, config, response, seconds). ``questions``: query_id, query, context.

    Without a tuned model its configurations are the base model's answer with a remark (``missing='suffix'``) or not available (``'na'``).
    """
    out = None
    for p in profiles:
        text = P.reader_prompt(F.col("context"), F.col("query"), names) if p.with_context else P.plain_prompt(F.col("query"))
        rows = questions.select("query_id", F.lit(p.config).alias("config"), text.alias("prompt"))
        model = tuned if p.tuned else base
        if model is None and missing == "na":
            rows = rows.select("query_id", "config", F.lit(V.NOT_AVAILABLE).alias("response"), F.lit(0.0).alias("seconds"))
        else:
            rows = generate(rows, "prompt", model or base, p.temperature)
            if model is None:
                rows = rows.withColumn("response", F.concat("response", F.lit(V.NO_ADAPTER)))
            rows = rows.select("query_id", "config", "response", "seconds")
        out = rows if out is None else out.union(rows)
    return out


def tuning_answers(questions: DataFrame, base: Generator, tuned: Generator, temperature: float = 0.7, max_new_tokens: int = 150) -> tuple[DataFrame, DataFrame]:
    """(base, tuned): query_id, response of both models to the bare questions. ``questions``: query_id, query."""
    asked = questions.select("query_id", P.plain_prompt(F.col("query")).alias("prompt"))
    return tuple(generate(asked, "prompt", m, temperature, max_new_tokens).select("query_id", "response") for m in (base, tuned))
