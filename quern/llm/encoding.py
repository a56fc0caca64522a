"""Encoding a whole corpus, or counting its tokens, with a public tokenizer."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.vocabulary import DEFAULT, FOLDER, load, ship
from quern.session import spread


def _arrow_batches(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, or one row, so long texts don't pile up."""
    sizes = np.cumsum([len(x) if x else 0 for x in batch.column(column).to_pylist()])
    start = 0
    while start < batch.num_rows:
        used = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, used + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode_texts(df: DataFrame, key: str, text: str, name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """``key`` and ``ids`` of every row's text, without special tokens.

    Null and empty texts give the empty list; repeated rows come out as often as
    they come in; other columns are dropped, whatever they are called; an empty
    table gives an empty table. No shuffle, but for small files: every partition is encoded where it is.
    """
    ship(df.sparkSession, name, folder)
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(name, folder)
        for whole in batches:
            for batch in _arrow_batches(whole, text):
                flat, ends = array("i"), [0]
                for value in batch.column(text).to_pylist():
                    if value:
                        flat.extend(vocabulary.encode(value))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(key), ids], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keys: Sequence[str], texts: dict[str, str], name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """``keys`` and, for each ``count -> text column`` of ``texts``, the tokens of that text.

    Null and empty texts have none. Every row comes out once; other columns are dropped.
    """
    ship(df.sparkSession, name, folder)
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in texts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(name, folder).count
        for batch in batches:
            counted = [pa.array(map(count, batch.column(t).to_pylist()), pa.int64()) for t in texts.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *counted], names=[*keys, *texts])

    return spread(df.select(*keys, *dict.fromkeys(texts.values()))).mapInArrow(run, schema)
