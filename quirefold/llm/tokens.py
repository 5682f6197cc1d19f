"""Sizes of texts in tokens of a public tokenizer, whose file's path is a parameter.

The driver reads the file, and Spark's broadcast brings it to the workers, so the
executors need no copy at that path. Vocabulary files have a few megabytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pretokenizer of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_loaded: dict[tuple[str, int], object] = {}


def counter(path: str, data: bytes | None = None):
    """A function from a text to its number of tokens; made once a worker.

    ``path`` tells the kind of the file by its ending; without ``data`` it is read.
    """
    if data is None:
        with open(path, "rb") as f:
            data = f.read()
    key = (path, hash(data))
    if key not in _loaded:
        _loaded[key] = _counter(path, data)
    return _loaded[key]


def _counter(path: str, data: bytes):
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.splitlines()))}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: len(encode(text))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def count_batches(path: str, shared):
    """(columns.., text) -> (columns.., n_tokens); null and empty texts have none. ``shared``: a Spark broadcast of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = counter(path, shared.value)
        for batch in batches:
            n = [size(t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    return run


def with_sizes(rows: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The other columns of ``rows`` with n_tokens in the text's place."""
    kept = [f for f in rows.schema.fields if f.name != text]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long"])
    with open(path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    return rows.select(*(f"`{f.name}`" for f in kept), text).mapInArrow(count_batches(path, shared), ddl)
