"""Token counts by section: whole documents are encoded once and tokens are attributed by their characters."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradewinds.llm._text import Cache

_tokenizers: dict[tuple[str, bool], object] = {}


def tokenizer(path: str, plain: bool = True):
    """The tokenizer of a file of the tokenizers library, loaded once in a worker. plain: the strings of special tokens are ordinary text."""
    if (path, plain) not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = plain
        _tokenizers[path, plain] = t
    return _tokenizers[path, plain]


def cuts_at_blanks(path: str) -> bool:
    """Whether a tokenizer is a byte-level BPE that takes a text as it is and splits it by that kind's own pattern, by which a blank opens the word behind it."""
    t = json.loads(tokenizer(path).to_str())
    split = t["pre_tokenizer"] or {}
    spaced = any(c.isspace() for x in t["added_tokens"] if not x["special"] for c in x["content"])
    return t["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space") and not spaced


class Spans:
    """Character spans of a tokenizer's tokens, over a whole document.

    The pattern of byte-level BPE never joins characters across a blank that stands between two other characters, nor across a line end that does. A
    text whose blanks and line ends all stand alone is cut there, and what is found for a piece is kept, which gives the spans of the whole document. Other
    texts, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.cuts = cuts_at_blanks(path)
        self.cache = Cache(self._piece)

    def _piece(self, piece: str) -> tuple[bytes, int, int]:
        spans = np.array(self.tok.encode(piece, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
        return spans.tobytes(), len(spans), len(piece)

    def __call__(self, text: str) -> np.ndarray:
        """Rows (start, end) in code points, end exclusive."""
        pieces = []
        lines = text.split("\n")
        plain = self.cuts
        for k, line in enumerate(lines if plain else []):
            if not line or line[0].isspace() or line[-1].isspace():
                plain = False
                break
            parts = line.split(" ")
            if len(line.split()) != len(parts):
                plain = False
                break
            if k:
                pieces.append("\n")
            pieces.append(parts[0])
            pieces += [" " + x for x in parts[1:]]
        if not plain:
            return np.array(self.tok.encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
        found = list(map(self.cache.__getitem__, pieces))
        out = np.frombuffer(b"".join([f[0] for f in found]), np.int32).reshape(-1, 2).copy()
        n = np.fromiter((f[1] for f in found), np.int32, len(found))
        size = np.fromiter((f[2] for f in found), np.int32, len(found))
        out += np.repeat(np.cumsum(size) - size, n)[:, None].astype(np.int32)
        return out


def attribute(spans: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [bounds[k], bounds[k+1]) and how many tokens cross a bound.

    A token that crosses goes to the section with most of its characters, the earlier of equals ("majority"), or to that of its first character ("start").
    A token without characters counts where it stands.
    """
    k = len(bounds) - 1
    last = max(k - 1, 0)
    a = np.clip(np.searchsorted(bounds, spans[:, 0], "right") - 1, 0, last)
    b = np.clip(np.searchsorted(bounds, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1, 0, last)
    crossing = np.flatnonzero(a != b)
    home = a.copy()
    if rule == "majority":
        for i in crossing:
            edges = np.clip(bounds[a[i] : b[i] + 2], spans[i, 0], spans[i, 1])
            home[i] = a[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(home, minlength=k)[:k], len(crossing)


def line_bounds(text: str) -> list[int]:
    """Sections are the lines, each with the line end that closes it; an empty text is one empty section."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    out.append(len(text))
    return out


SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long, doc_crossing long"


def count_tokens(docs: DataFrame, path: str, rule: str = "majority") -> DataFrame:
    """A row for each line of each whole text: its span, its tokens, the document's tokens and the tokens that cross a bound.

    A document's sections sum to its tokens. Null and empty texts have one section of no tokens; each of equal rows is counted; an empty table gives an empty
    one. A text is held whole in a Python worker, with its spans.
    """
    if rule not in ("majority", "start"):
        raise ValueError(f"unknown rule: {rule}")

    def counted(batches):
        spans_of = Spans(path)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                bounds = np.array(line_bounds(text))
                spans = spans_of(text) if text else np.empty((0, 2), np.int32)
                n, crossing = attribute(spans, bounds, rule)
                k = len(bounds) - 1
                for col, values in zip(cols, ([doc] * k, range(k), bounds[:-1].tolist(), bounds[1:].tolist(), n.tolist(), [len(spans)] * k, [crossing] * k)):
                    col.extend(values)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens", "doc_crossing"])

    return docs.select("doc_id", "text").mapInArrow(counted, SCHEMA)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def report(docs: DataFrame) -> DataFrame:
    return count_tokens(docs, default_path())
