"""Token counts of whole texts.

Texts are split at boundaries that no token crosses, the distinct segments of a batch are encoded
together, in library batches balanced by bytes, and only their lengths are kept. A worker
remembers the lengths of recent segments (at most `cache_entries`), since words repeat.

Null text counts as empty (0 bytes, 0 tokens). Rows are independent: repeated rows, ties and null
ids pass through as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import map_arrow, pick
from .text import slices

LONG_SEGMENT = 4096
ENCODE_BYTES = 1 << 16
#: Inside a segment without white space: digits stand alone, so a text may be split next to one.
_DIGIT = re.compile(rb"(?<=[A-Za-z0-9])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def drops_space(tokenizer_json: str) -> bool:
    """Whether the tokenizer folds white space, then drops it between pre-tokens that hold none; ASCII white space is then a safe boundary."""
    pre = (json.loads(tokenizer_json).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = str((pre[0].get("pattern") or {}).get("Regex"))
    return pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Counter:
    """Token counts of UTF-8 texts by one tokenizer of the tokenizers library."""

    def __init__(self, tokenizer_json: str, cache_entries: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = drops_space(tokenizer_json)
        self.most = cache_entries
        self.known: dict[bytes, int] = {}

    def _lengths(self, parts: list[bytes]) -> list[int]:
        """Encodes in runs of about ENCODE_BYTES, longest last, so that a run holds texts of like size."""
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        out, run, size = [0] * len(parts), [], 0
        for k, i in enumerate(order):
            run.append(i)
            size += len(parts[i])
            if size >= ENCODE_BYTES or k == len(order) - 1:
                got = self.tokenizer.encode_batch_fast([parts[j].decode("utf-8", "replace") for j in run], add_special_tokens=False)
                for j, e in zip(run, got, strict=True):
                    out[j] = len(e)
                run, size = [], 0
        return out

    def _learn(self, segments: set[bytes]) -> None:
        if len(self.known) + len(segments) > self.most:
            self.known = {}
        new = list(segments)
        parts, owner = [], []
        for i, s in enumerate(new):
            for p in _DIGIT.split(s) if len(s) > LONG_SEGMENT else (s,):
                parts.append(p)
                owner.append(i)
        total = [0] * len(new)
        for i, n in zip(owner, self._lengths(parts), strict=True):
            total[i] += n
        self.known.update(zip(new, total, strict=True))

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.split:
            return self._lengths(texts)
        split = [t.split() for t in texts]
        words = set().union(*split)
        known = self.known
        missing = {w for w in words if w not in known}
        if missing:
            self._learn(missing if len(known) + len(missing) <= self.most else words)
        get = self.known.__getitem__
        return [sum(map(get, s)) for s in split]


_counters: dict[int, Counter] = {}


def token_counts(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, cache_entries: int = 400_000) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each row.

    tokenizer: path of a tokenizers .json file, read on the driver and broadcast (a vocabulary, a few MB).
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = pick(df, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    key = hash((tokenizer, cache_entries))

    def run(batch: pa.RecordBatch):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = _counters.get(key)
        if counter is None:
            counter = _counters[key] = Counter(shared.value, cache_entries)
        for part in slices(batch, text_col):
            texts = [x or b"" for x in part.column(text_col).cast(pa.large_binary()).to_pylist()]
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(rows, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
