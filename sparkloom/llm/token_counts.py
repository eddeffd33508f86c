"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Byte-level tokens tile its UTF-8 bytes, so token lengths give each token's
byte span, and the bytes that begin a character give its character span. An interval join of token spans with
section spans (both ascending, so a binary search) counts tokens by section; a token that crosses a boundary
goes by an explicit rule. Tokens are never counted twice, so a document's sections add up to its tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import bound_batches

RULES = ("first", "last", "most", "share")
#: Where the vocabulary files are; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space, as the pattern's \\s has it. Runs of it that are longer than the regular expression's
#: backtracking is safe with are cut out where the pattern itself cuts.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@cache
def encoder(path: str):
    """Encode function of a vocabulary file of base64 ranks, and the bytes of each token. A worker loads it once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def encode(text: str, path: str) -> list[int]:
    """Tokens of a whole text. The pattern takes a run of white space but for its last character as one piece, and
    all of a run at the end; so a long run is one piece here too, and what is before and after it is encoded alone."""
    encoding, out, at = encoder(path)[0], [], 0
    for m in _LONG_SPACE.finditer(text):
        stop = m.end() - (m.end() < len(text))
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : stop].encode())
        at = stop
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def spans(text: str, path: str) -> np.ndarray:
    """Character spans (n, 2) of the tokens of a whole text. A token that holds part of a character's bytes
    begins at that character; it ends after the last character of which it holds a byte."""
    size = encoder(path)[1]
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = np.cumsum(size[encode(text, path)]) if text else np.zeros(0, np.int64)
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
    return np.stack([char[begins], char[ends - 1] + 1], 1) if len(ends) else np.zeros((0, 2), np.int64)


def attribute(tokens: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; sections are bounds[i] .. bounds[i + 1], ascending, and cover the text.

    first, last: the section of the token's first or last character. most: the section that holds most of its
    characters, the first of equals. share: each section's part of the token's characters."""
    n = len(bounds) - 1
    out = np.zeros(n)
    if not len(tokens) or not n:
        return out
    a = np.searchsorted(bounds, tokens[:, 0], "right") - 1
    b = np.searchsorted(bounds, tokens[:, 1] - 1, "right") - 1
    inside = a == b
    out += np.bincount(a[inside], minlength=n)
    cross = ~inside
    if rule in ("first", "last"):
        return out + np.bincount((a if rule == "first" else b)[cross], minlength=n)
    for (x, y), i, j in zip(tokens[cross].tolist(), a[cross].tolist(), b[cross].tolist(), strict=True):
        held = np.minimum(bounds[i + 1 : j + 2], y) - np.maximum(bounds[i : j + 1], x)
        if rule == "most":
            out[i + int(held.argmax())] += 1
        else:
            out[i : j + 1] += held / (y - x)
    return out


def line_bounds(text: str) -> np.ndarray:
    """Sections of a text: its lines, each with its line feed."""
    at = [0]
    while (i := text.find("\n", at[-1])) >= 0 and i + 1 < len(text):
        at.append(i + 1)
    return np.array([*at, len(text)] if text else [0])


def _count(rule: str, path: str, fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, section, begin, end, n = [], [], [], [], []
            for r, value in enumerate(batch.column(1)):
                value = value.as_py()
                if fields:  # fields of one document, joined by a line feed each
                    parts = [x or "" for x in value or []]
                    text = "\n".join(parts)
                    bounds = np.r_[0, np.cumsum([len(p) + 1 for p in parts])] if parts else np.array([0])
                    bounds[-1] = len(text)
                else:
                    text = value or ""
                    bounds = line_bounds(text)
                k = attribute(spans(text, path), bounds, rule)
                row += [r] * len(k)
                section += range(len(k))
                begin += bounds[:-1].tolist()
                end += bounds[1:].tolist()
                n += k.tolist()
            made = [pa.array(section, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *made], ["id", "section", "begin", "stop", "n"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str | list[str] = "text", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each section of each document: `id_col`, section (from 0), begin, stop (characters), n_tokens.

    With one text column, sections are the lines of the text, each with its line feed; with a list of columns,
    sections are these fields, encoded as one text joined by line feeds. `rule` says where a token that crosses
    a boundary counts; n_tokens is whole but for 'share'. A null or empty text has no section, a null field is
    empty. Texts are encoded whole, whatever their length. Rows that repeat, and rows with a null id, are
    counted each. Other columns, of any name, are not looked at. Empty table: empty result. One pass, no shuffle.
    The vocabulary file must be at `vocabulary` on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bound_batches(docs.sparkSession)
    fields = not isinstance(text_col, str)
    value = F.array(*[F.col(c).cast("string") for c in text_col]) if fields else F.col(text_col)
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), value.alias("t"))
    out = inner.mapInArrow(_count(rule, vocabulary, fields), "id bigint, section bigint, begin bigint, stop bigint, n double")
    return out.select(F.col("id").alias(id_col), "section", "begin", "stop", (F.col("n") if rule == "share" else F.col("n").cast("bigint")).alias("n_tokens"))

