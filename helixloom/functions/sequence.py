"""Column functions on nucleotide sequences and k-mers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; case and letters other than A, C, G, T are kept."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; as A < C < G < T that is the lesser 2-bit code too."""
    return F.least(kmer, revcomp(kmer))


def is_valid(kmer: Column) -> Column:
    return kmer.rlike("^[ACGT]+$")


def pack(kmer: Column) -> Column:
    """2 bits for each base, A 0, C 1, G 2, T 3, first base leftmost; for 31 bases at most."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def prefix(kmer: Column, n: int) -> Column:
    return F.substring(kmer, 1, n)


def suffix(kmer: Column, n: int) -> Column:
    return F.right(kmer, F.lit(n))


def fold_lines(seq: Column, width: int = 60) -> Column:
    """A line break after every `width` characters, none at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def sanitize(name: Column) -> Column:
    """Characters that file names cannot have become underscores."""
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def effective_length(seq: Column, k: int) -> Column:
    """Bases in runs of A, C, G, T that are k long or longer."""
    return F.aggregate(F.split(seq, "[^ACGT]"), F.lit(0), lambda a, r: a + F.when(F.length(r) >= k, F.length(r)).otherwise(0))


def pseudo_sequence(text: Column) -> Column:
    """Any text as a sequence: white space goes, letters map to bases by their place in the alphabet modulo 4, and
    all else becomes N."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    bases = ("ACGT" * 7)[:26]
    mapped = F.translate(F.regexp_replace(text, "[ \n\t\r]", ""), letters + letters.upper(), bases * 2)
    return F.regexp_replace(mapped, "[^ACGT]", "N")
