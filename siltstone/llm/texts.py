"""How the operators walk over whole texts in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: A task has one core: the tokenizer library starts no threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Code points whose classes and case mappings are the same in every Unicode version that the
#: tokenizer libraries and Python carry; tests compare each of them with the libraries.
PLAIN = r"\x00-\u0557\u2010-\u205e\u20a0-\u20ba"


def by_block(fn: Callable[[list, list[str]], dict[str, object]], schema: pa.Schema) -> Callable:
    """A function for ``mapInArrow`` over (id, text) rows: ``fn(ids, texts)`` gives the columns of a block of rows.

    A null text is an empty one. Blocks bound the memory that lists of words need, whatever the batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in blocks_of(texts):
                rows = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                cols = fn(ids[a:b], rows)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return run


def blocks_of(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Like ``blocks``, from the byte lengths of an Arrow column."""
    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
