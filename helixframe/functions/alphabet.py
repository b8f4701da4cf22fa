"""The nucleotide alphabet as Column functions.

Symbols are ordered $ < A < C < G < T < N. In ASCII N comes before T, so strings are compared through `collated`,
which writes N as Z.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = "$ACGTN"


def normalize(seq: Column) -> Column:
    """Upper case, and every symbol other than A, C, G, T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def encode(seq: Column) -> Column:
    """Symbols as digits: A 1, C 2, G 3, T 4, anything else 5."""
    return F.translate(normalize(seq), "ACGTN", "12345")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def collated(seq: Column) -> Column:
    """A normalized sequence in letters whose ASCII order is the symbols' order."""
    return F.translate(seq, "N", "Z")


def uncollated(seq: Column) -> Column:
    return F.translate(seq, "Z", "N")


def derived(text: Column, unknown: bool = True) -> Column:
    """The sequence that lies in a text: its letters A, C, G, T (and N, if unknown) in either case, in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ACGTNacgtn]" if unknown else "[^ACGTacgt]", ""))


def parse_size(text: str) -> int:
    """A count with an optional suffix k, m or g (thousands, millions, thousand millions)."""
    scale = {"k": 10**3, "m": 10**6, "g": 10**9}.get(text[-1:].lower())
    return int((float(text[:-1]) * scale if scale else float(text)) + 0.499)
