"""Column functions on DNA letters; all are built-in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of sequences, and how strands pair.
VALID = "ACGTURYKMSWBDHNXV"
DEFINITE = "ACGT"
COMPLEMENT = "TGCA"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(letters: Column) -> Column:
    """Upper case of a to z alone ("ß" stays as it is)."""
    return F.translate(letters, LOWER, UPPER)


def is_valid(letters: Column) -> Column:
    return letters.rlike(f"^[{VALID}]*$")


def is_definite(letters: Column) -> Column:
    return letters.rlike(f"^[{DEFINITE}]*$")


def normalised(letters: Column) -> Column:
    """Every letter that is not definite becomes N."""
    return F.regexp_replace(letters, f"[^{DEFINITE}]", "N")


def complement(letter: Column) -> Column:
    """N stays N; other indefinite letters must be normalised before."""
    return F.translate(letter, DEFINITE, COMPLEMENT)


def reverse_complement(letters: Column) -> Column:
    return F.reverse(complement(letters))


def letter_code(letter: Column) -> Column:
    """A, C, G, T as 0 to 3, -1 for any other letter."""
    return F.when(letter == "A", 0).when(letter == "C", 1).when(letter == "G", 2).when(letter == "T", 3).otherwise(-1).cast("long")


def letter_of(number: Column) -> Column:
    """The letter of a code; N for any other number."""
    return F.when(number.between(0, 3), F.substr(F.lit(DEFINITE), number.cast("int") + 1, F.lit(1))).otherwise(F.lit("N"))


def letter_bit(letter: Column) -> Column:
    """A set of one letter as bits: A 1, C 2, G 4, T 8, none for N."""
    return F.when(letter == "A", 1).when(letter == "C", 2).when(letter == "G", 4).when(letter == "T", 8).otherwise(0)


def packed(kmer: Column) -> Column:
    """Two bits per letter, the first letter most significant; numbers order as the strings do. For up to 31 letters."""
    return F.conv(F.translate(kmer, DEFINITE, "0123"), 4, 10).cast("long")


def unpacked(number: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", DEFINITE)


def packed_backwards(kmer: Column) -> Column:
    """Two bits per letter, the first letter least significant: the order of reversed strings."""
    return packed(F.reverse(kmer))
