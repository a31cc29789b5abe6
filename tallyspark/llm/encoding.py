"""Token ids of a whole corpus (problem 8), by the transducer of ``bpe``.

Defined results: null and empty texts have an empty list (never null); blanks and odd characters are text
like any other; a text of any length is encoded as a whole.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.bpe import Transducer, read_ranks

# The functions below are marked nondeterministic only so that a filter on their result does not make the
# planner run them a second time; their results are the same in every run.

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A rank file is configuration; a larger one is refused, as its content is broadcast.
MAX_VOCABULARY_BYTES = 64_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabularies lie."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return str(Path("/opt/tokenizers", name))


@lru_cache(maxsize=4)
def _transducer(data: bytes) -> Transducer:
    return Transducer(read_ranks(data))


_BY_HASH: dict[int, Transducer] = {}


def transducer(data: bytes) -> Transducer:
    """One compiled transducer per worker process and vocabulary."""
    key = hash(data)
    if key not in _BY_HASH:
        _BY_HASH[key] = _transducer(data)
    return _BY_HASH[key]


def _read(path: str | None) -> bytes:
    path = path or vocabulary_path()
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary file may be")
    return data


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """array<int> of the ids of ``text`` by the vocabulary file at ``path`` (default: byte_bpe_50k)."""
    shared = spark.sparkContext.broadcast(_read(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        encode = transducer(shared.value).encode
        lists = [encode(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return ids.asNondeterministic()(text.cast("string"))


def token_counts(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Number of tokens (bigint) of ``text``, without moving the ids."""
    shared = spark.sparkContext.broadcast(_read(path))

    @F.arrow_udf(T.LongType())
    def counts(texts: pa.Array) -> pa.Array:
        encode = transducer(shared.value).encode
        return pa.array([len(encode(t)) for t in texts.to_pylist()], pa.int64())

    return counts.asNondeterministic()(text.cast("string"))


def texts_of(spark: SparkSession, ids: Column, path: str | None = None) -> Column:
    """The texts of token ids; null ids as none."""
    shared = spark.sparkContext.broadcast(_read(path))

    @F.arrow_udf(T.StringType())
    def texts(lists: pa.Array) -> pa.Array:
        decode = transducer(shared.value).decode
        return pa.array([decode(x or ()) for x in lists.to_pylist()], pa.string())

    return texts.asNondeterministic()(ids)
