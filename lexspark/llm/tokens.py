"""Token counts by heap-and-linked-list byte-pair merging.

For each pre-token the adjacent pairs stand in a heap by merge rank (then by
position) and the symbols in a linked list; popping the lowest pair merges two
symbols into one. The number of tokens is the number of initial symbols minus
the number of merges, so no identifiers are made. Counts of distinct stretches
between ASCII white space are kept per Python worker, in a bounded memo.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Special strings
inside a text count as one token each, as the library's default has it. Equally
ranked pairs merge from the left; repeated rows get equal counts; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8

#: Stretches that a worker's memo holds before it starts anew.
MEMO = 700_000
#: Longer stretches aren't kept.
MEMO_BYTES = 64
#: Vocabulary files above this aren't broadcast.
MOST_FILE = 64 << 20
LIMIT = 2048


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte:
    itself if printable in Latin-1 and no space, else the next from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Merger:
    """Counts tokens of texts for one tokenizer file of kind BPE whose
    pre-tokens never hold white space."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): n for n, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)).encode()) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.memo: dict[bytes, int] = {}

    def merged(self, symbols: list[str]) -> int:
        """How many of the symbols are left when all merges are done."""
        count = len(symbols)
        if count < 2:
            return count
        rank = self.rank
        heap = [(r, i) for i in range(count - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return count
        heapq.heapify(heap)
        end = count
        after = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        while heap:
            r, i = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= end or rank.get((left, symbols[j])) != r:
                continue
            joined = symbols[i] = left + symbols[j]
            symbols[j] = None
            count -= 1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if (r := rank.get((joined, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], joined))) is not None:
                heapq.heappush(heap, (r, h))
        return count

    def stretch(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "replace")
        if not raw.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        total = 0
        table, vocab, suffix = self.symbols, self.vocab, self.suffix
        for piece in self.pattern.findall(text):
            symbols = [table[b] for b in piece.encode()]
            symbols[-1] += suffix
            total += self.merged([s for s in symbols if s in vocab])
        return total

    def plain(self, raw: bytes) -> int:
        memo, total = self.memo, 0
        for part, times in Counter(raw.split()).items():
            n = memo.get(part)
            if n is None:
                n = self.stretch(part)
                if len(part) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[part] = n
            total += n * times
        return total

    def count(self, raw: bytes) -> int:
        if b"<|" in raw and self.special_pattern is not None:
            parts = self.special_pattern.split(raw)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(raw)


_mergers: dict[int, Merger] = {}


def merger(data: bytes) -> Merger:
    """The worker's own Merger for these bytes, made once."""
    key = hash(data)
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(data)
    return _mergers[key]


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MOST_FILE:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MOST_FILE} can be broadcast")
    return data


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches):
        own = merger(shipped.value)
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column("text"))]
            tokens = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
