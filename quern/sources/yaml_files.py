"""YAML files as rows, where a YAML parser is installed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:
    yaml = None


def parse_yaml(files: DataFrame, text: str, schema: str) -> DataFrame:
    """The other columns of ``files``, ``doc`` (a struct of ``schema``) and ``error``.

    A text that isn't a YAML mapping, or doesn't fit, has an error and no doc, so that
    callers can leave out just its repository.
    """
    if yaml is None:
        raise RuntimeError("no YAML parser is installed")
    kept = [c for c in files.columns if c != text]
    own = T.StructType([*(files.schema[c] for c in kept), *T.StructType.fromDDL("_json string, error string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            found, errors = [], []
            for value in batch.column(text).to_pylist():
                try:
                    doc = yaml.load(value or "", Loader=loader)
                    if not isinstance(doc, dict):
                        raise ValueError("not a mapping")
                    found.append(json.dumps(doc, default=str))
                    errors.append(None)
                except (yaml.YAMLError, ValueError) as e:
                    found.append(None)
                    errors.append(str(e).splitlines()[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array(errors, pa.string())], names=own.names)

    parsed = files.mapInArrow(run, own)
    return parsed.select(*kept, F.from_json("_json", schema).alias("doc"), "error")
