"""Token ids of training texts for a language model, in Arrow batches."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.operators.workers import Lazy, model, ship


def library_tokenizer(path: str) -> Lazy:
    """A tokenizer file of the tokenizers library, loaded once by each worker."""

    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return Lazy(f"tokenizer {path}", load)


class ByteLevel:
    """A byte-level BPE file by the training-data operators' encoder, which looks pieces up that it has seen; texts with the file's own tokens in them go through the library."""

    def __init__(self, path: str):
        from tessera.llm.tokens import encoder

        kind = json.loads(Path(path).read_text())
        before = kind.get("pre_tokenizer") or {}
        if kind["model"].get("type") != "BPE" or kind.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or kind.get("post_processor"):
            raise ValueError(f"{path} isn't plain byte-level BPE")
        self.pieces, self.whole = encoder(path), library_tokenizer(path).load()
        self.own = [t["content"] for t in kind.get("added_tokens", ())]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not any(t in x for t in self.own) for x in texts]
        fast = iter(self.pieces.encode_many([x for x, p in zip(texts, plain) if p]))
        return [next(fast) if p else np.array(self.whole.encode(x).ids, np.int64) for x, p in zip(texts, plain)]


def byte_level_tokenizer(path: str) -> Lazy:
    """A file of plain byte-level BPE, loaded once by each worker; the ids are those of ``library_tokenizer``."""
    return Lazy(f"byte-level {path}", lambda: ByteLevel(path))


def tokenised(df: DataFrame, text: str, tokenizer, *, max_length: int | None = 128, special: bool = True, batch: int = 256) -> DataFrame:
    """Adds input_ids, attention_mask and labels (a copy of the ids), cut after ``max_length`` ids and not padded; null text has null columns.

    Columns of these names are replaced. ``tokenizer``: has encode_batch, or ids where no special tokens are added, or is ``Lazy``.
    """
    ship(df.sparkSession)
    added = ("input_ids", "attention_mask", "labels")
    df = df.drop(*added)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in added)])

    def run(batches):
        tok = model(tokenizer)
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                valid = np.asarray(part.column(at).is_valid())
                texts = part.column(at).drop_null().to_pylist()
                got = tok.ids(texts) if hasattr(tok, "ids") else [np.array(x.ids, np.int64) for x in tok.encode_batch(texts, add_special_tokens=special)]
                got = [x[:max_length] for x in got]
                n = np.zeros(len(valid) + 1, np.int32)
                n[1:][valid] = [len(x) for x in got]
                offsets = pa.array(np.cumsum(n, dtype=np.int32), pa.int32(), mask=np.append(~valid, False))
                flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
                ids, mask = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat, np.ones(len(flat), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, mask, ids], schema.names)

    return df.mapInArrow(run, schema)
