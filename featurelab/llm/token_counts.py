"""Token counts per field and section from one encoding of the whole document.

The fields of a row are joined by newlines to one document, which is encoded
once.  Each token covers a byte span (byte-level tokens concatenate to the
text); the sections - the lines of each field - cover spans too, and both are
joined as sorted intervals.  A token that crosses a section boundary goes by
``rule``:

* ``majority``: to the section with most of its bytes, the earlier on ties;
* ``first`` / ``last``: to the section where it begins / ends;
* ``split``: to each section in proportion to its bytes (fractions).

The newline that ends a line, or joins two fields, belongs to the section
before it.  The sections' counts of a document always add up to its tokens.

Defined results: a null field is an empty one: one section of no characters of
its own; repeated rows are counted one by one; an empty table gives an empty
result; columns other than the id and the fields are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packing import VOCABULARY, encode, encoder

RULES = ("majority", "first", "last", "split")


def token_bytes(enc) -> np.ndarray:
    """Bytes of each token id."""
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of those cross a boundary.

    ``ends``: ascending end of each token; ``bounds``: starts of the sections and the end of the last.
    """
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds[:-1], starts, "right") - 1
    last = np.searchsorted(bounds[:-1], ends - 1, "right") - 1
    cross = np.flatnonzero(first != last)
    inside = first == last
    count = np.bincount(first[inside], minlength=n).astype(np.float64)
    crossing = np.zeros(n, np.int64)
    for t in cross:
        f, e = first[t], last[t]
        part = np.minimum(bounds[f + 1:e + 2], ends[t]) - np.maximum(bounds[f:e + 1], starts[t])
        if rule == "split":
            count[f:e + 1] += part / (ends[t] - starts[t])
            crossing[f:e + 1] += part > 0
        else:
            k = f if rule == "first" else e if rule == "last" else f + int(part.argmax())
            count[k] += 1
            crossing[k] += 1
    return count, crossing


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "majority",
                 vocabulary: str = VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, field, part, n_chars, n_tokens, n_crossing``: one row per line of each field of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    common.prepare(docs.sparkSession)
    src = docs.select(F.col(id_column).alias("doc_id"),
                      *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)))

    def run(it):
        enc = encoder(vocabulary)
        width = token_bytes(enc)
        for rb in it:
            take, name, part, chars, tokens, crossing = [], [], [], [], [], []
            columns = [rb.column(i + 1).to_pylist() for i in range(len(fields))]
            for i in range(rb.num_rows):
                sections = [(f, k, line) for f, col in enumerate(columns) for k, line in enumerate(col[i].split("\n"))]
                sizes = np.array([len(s[2].encode()) + 1 for s in sections], np.int64)
                sizes[-1] -= 1
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                ids = encode(enc, "\n".join(c[i] for c in columns))
                n, c = allocate(np.cumsum(width[ids]), bounds, rule)
                take.extend([i] * len(sections))
                name.extend(fields[s[0]] for s in sections)
                part.extend(s[1] for s in sections)
                chars.extend(len(s[2]) for s in sections)
                tokens.append(n)
                crossing.append(c)
            none = np.empty(0)
            n, c = np.concatenate([none, *tokens]), np.concatenate([none, *crossing]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(take, pa.int64())), pa.array(name, pa.string()), pa.array(part, pa.int32()),
                 pa.array(chars, pa.int64()), pa.array(n) if rule == "split" else pa.array(n.astype(np.int64)), pa.array(c)],
                names=["doc_id", "field", "part", "n_chars", "n_tokens", "n_crossing"])

    kind = src.schema["doc_id"].dataType.simpleString()
    number = "double" if rule == "split" else "long"
    return src.mapInArrow(run, f"doc_id {kind}, field string, part int, n_chars long, n_tokens {number}, n_crossing long")
