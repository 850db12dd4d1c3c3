"""Compression bands: texts that zstandard shrinks far more, or far less, than prose of their length are rejected.

The ratio (bytes over compressed bytes) of prose grows with its length, so each band of lengths has its own limits. The
whole text is judged, and each chunk of ``CHUNK`` bytes by the limits for its length, so a junk part of a long text shows
even where the rest hides it: more than ``BAD_SHARE`` of the bytes in chunks out of band reject the text.

Limits of ``BANDS`` come from the base-passing texts of sf0.1 and their chunks, in four languages of Latin script: the least ratio
is 7% (short bands) to 19% below theirs, the greatest 15% above. Two things don't show in the ratio of a short text: digits
and letters in turn (hexadecimal has the ratio of prose), so a text or chunk is out of band too if such changes inside words of
``CODE_WORD`` bytes or more exceed a quarter of its bytes without white space; and passages told a few times, so each band has
a limit for the share of repeated words of the whole text. Scripts of which most bytes aren't ASCII have other ratios and
keep the wide limits of ``OTHER_BANDS``.

Base figures (exact): words ``[^\\x20\\x09-\\x0D]+``, their code points, symbols, repeated lines, words inside 3-word windows
that occur twice or more. ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.

Defined results: a null text is an empty one, has no words and fails the base rule. Texts below the shortest band have no
ratio limits. Rows are judged one by one, so repeated rows, ties and other columns don't matter; columns with the names of
the result are replaced. One text must fit into a worker's memory; no text is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
CHUNK = 8192
BAD_SHARE = 0.25
#: From this many bytes: least and greatest ratio, greatest percentage of repeated words.
BANDS = [
    (256, 1.25, 2.12, 45),  # found: ratios 1.34 to 1.84
    (512, 1.33, 2.48, 40),  # 1.43 to 2.15
    (1024, 1.45, 2.78, 28),  # 1.69 to 2.41
    (2048, 1.60, 3.00, 25),  # 1.92 to 2.61
    (4096, 1.70, 3.18, 25),  # 2.09 to 2.77
    (16384, 1.90, 3.33, 40),  # 2.33 to 2.90
    (131072, 1.90, 3.33, 50),  # one text, 2.57
]
OTHER_BANDS = [(256, 1.10, 3.2, 50), (1024, 1.20, 4.2, 50), (4096, 1.25, 5.2, 50), (16384, 1.30, 6.5, 50), (131072, 1.30, 8.0, 50)]
CODE_WORD = 8
CODE_WORDS = re.compile(rb"[^ \t-\r]{%d,}" % CODE_WORD)
CHANGES = re.compile(rb"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, bad_chunk_share double, kept boolean"
)
COLUMNS = [part.split()[0] for part in RESULT.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:  # three ids no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def coded(text: bytes) -> bool:
    """Whether digits and letters take turns in long words, as in hexadecimal; each change needs a digit on one side."""
    least = len(text.translate(None, SPACES)) / 4
    if 2 * (len(text) - len(text.translate(None, DIGITS))) <= least:
        return False
    return sum(len(CHANGES.findall(w)) for w in CODE_WORDS.findall(text)) > least


def in_band(text: bytes, packed: int, repeated_percent: float = 0.0) -> bool:
    size = len(text)
    other = 2 * int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0x80)) > size
    bands = OTHER_BANDS if other else BANDS
    at = bisect_right([b[0] for b in bands], size) - 1
    if at < 0:
        return True
    _, least, greatest, most = bands[at]
    return least <= size / packed <= greatest and repeated_percent <= most and not coded(text)


def judge(text: bytes, pack: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    size = len(text)
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words)
    packed = len(pack.compress(text)) if size else 1
    bad = 0
    if size > CHUNK:
        for at in range(0, size, CHUNK):
            chunk = text[at : at + CHUNK]
            bad += 0 if in_band(chunk, len(pack.compress(chunk))) else len(chunk)
    share = bad / size if size else 0.0
    points = np.frombuffer(text, np.uint8)
    return (
        len(words),
        int(np.count_nonzero((points & 0xC0) != 0x80)) - (size - len(text.translate(None, SPACES))),
        size - len(text.translate(None, SYMBOLS)),
        repeated_lines(text),
        repeated,
        failed,
        size / packed,
        share,
        not failed and in_band(text, packed, 100 * repeated / len(words)) and share <= BAD_SHARE,
    )


KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]


def _judge(text: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    rows = [judge(x.as_py() or b"", pack) for x in text.cast(pa.large_binary())]
    columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], COLUMNS)


def compression_bands(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``RESULT``."""
    others = [c for c in docs.columns if c.lower() not in COLUMNS]
    return docs.select(*others, F.arrow_udf(_judge, RESULT)("text").alias("_judged")).select(*others, "_judged.*")
