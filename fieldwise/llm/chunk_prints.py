"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its low bits vanish, with a
strict mask before the usual chunk size and a loose one after it (normalised chunking), and
never below LEAST or above MOST bytes.  Boundaries depend on nearby bytes only, so an edit moves
the chunks around it and leaves the others.  The fingerprint is the set of chunk digests, each
weighted by the bytes it covers; containment is the weight of what is found again.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import random_words, slices
from .ordered import dealt_in_order

LEAST, USUAL, MOST = 16, 48, 192
#: Bits that must vanish before and from the usual size on.
STRICT, LOOSE = np.uint32(0x7F << 25), np.uint32(0x0F << 25)
#: Bytes the rolling hash sees (a 32-bit hash forgets what is further back).
SIGHT = 32
_GEAR = (random_words(256, 9) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum of gear[byte i back] << i, over SIGHT bytes."""
    h, reach = _GEAR[data], 1
    while reach < SIGHT:
        if len(h) > reach:
            h[reach:] += h[:-reach] << np.uint32(reach)  # the right side is read first
        reach *= 2
    return h


def chunk_ends(hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of a text whose bytes have these gear hashes."""
    n = len(hashes)
    loose = np.flatnonzero(hashes & LOOSE == 0)
    strict = loose[hashes[loose] & STRICT == 0].tolist()
    loose = loose.tolist()
    ends, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        i = bisect.bisect_left(strict, at + LEAST - 1, i)
        if i < len(strict) and strict[i] < at + USUAL - 1:
            at = strict[i] + 1
        else:
            j = bisect.bisect_left(loose, at + USUAL - 1, j)
            at = min(loose[j] + 1 if j < len(loose) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def weights(raw: bytes) -> dict[int, int]:
    """Bytes covered by each chunk digest of a text."""
    out: dict[int, int] = {}
    begin = 0
    for end in chunk_ends(gear_hashes(np.frombuffer(raw, np.uint8))):
        key = xxhash.xxh3_64_intdigest(raw[begin:end])
        out[key] = out.get(key, 0) + end - begin
        begin = end
    return out


def fingerprint(found: dict[int, int]) -> str:
    """digest:bytes of every chunk, sorted by digest."""
    return ",".join([f"{k:016x}:{v}" for k, v in sorted(found.items())])


def containment(of: dict[int, int], within: dict[int, int]) -> float:
    """Share of the bytes of ``of`` whose chunks are in ``within``; of nothing: 1.0 in nothing."""
    total = sum(of.values())
    if not total:
        return 0.0 if within else 1.0
    get = within.get
    return sum([min(v, get(k, 0)) for k, v in of.items()]) / total


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, doc_id); each is written when its successor is seen."""
    last = None
    for batch in batches:
        for piece in slices(batch):
            rows = []
            columns = [piece.column(c).to_pylist() for c in range(4)]
            for bucket, doc_id, text, guest in zip(*columns):
                text = text or ""
                own = weights(text.encode())
                if last is not None and last[0] == bucket:
                    changed = edited(last[2], text)
                    raw = changed.encode()
                    other = weights(raw)
                    rows.append((
                        last[1], len(last[2]), hashlib.sha256(raw).hexdigest(), fingerprint(last[3]),
                        fingerprint(other), containment(last[3], other), containment(last[3], own),
                    ))
                last = None if guest else (bucket, doc_id, text, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            lists = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(lists, kinds)], [c.split()[0] for c in _OUT.split(", ")]
            )


def prints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fingerprints of the text and the edited text.

    The next row is that with the next higher doc_id (equal ids: by text; NULL ids come first),
    after the last comes the first, and a single row follows itself.  ``near_edited`` and
    ``near_next`` are the containment of the text's fingerprint in the edited text's and in the
    next text's.  NULL texts count as empty; an empty text has an empty fingerprint, which is
    contained (1.0) in empty ones only.

    Texts are dealt out once, by ranges of doc_id, so that almost every row meets its successor
    in its own task; the first row of each range also travels to the range before.
    """
    dealt = dealt_in_order(docs.select("doc_id", "text"))
    return dealt.mapInArrow(_prints, _OUT)
