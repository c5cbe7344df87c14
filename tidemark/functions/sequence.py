"""Genetic sequences and bit packets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, in the order U, C, A, G of each place, * for stop.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Three-letter names of the amino acids.
SHORT = dict(zip("ARNDCQEGHILKMFPSTWYV", "Ala Arg Asn Asp Cys Gln Glu Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val".split(), strict=True))


def codons() -> list[tuple[str, str]]:
    """(codon, letter) of all 64, X for stop."""
    bases = "UCAG"
    return [(a + b + c, AMINO[16 * i + 4 * j + k].replace("*", "X")) for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)]


def to_rna(dna: Column) -> Column:
    return F.translate(F.upper(dna), "T", "U")


def from_start(rna: Column) -> Column:
    """From the first AUG on; null if there is none."""
    at = F.locate("AUG", rna)
    return F.when(at > 0, F.substring(rna, at, F.length(rna)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body, or a function in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(text: Column, n: int) -> Column:
    """Whole pieces of n characters. Of bytes, where any piece is found at once: letters outside ASCII are counted as one byte, ?."""

    def of(raw: Column) -> Column:
        count = F.floor(F.length(raw) / n).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)) * n, F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, lambda i: i <= count * n), lambda i: F.substring(raw, i, F.lit(n)).cast("string"))

    return _let(F.regexp_replace(text, r"[^\x00-\x7F]", "?").cast("binary"), of)


#: All codons, each with a space behind it: where one stands tells its letter.
_CODONS = "".join(c + " " for c, _ in codons())


#: Whole codons up to the first stop, or to the end; the possessive repeat is a loop and takes no stack.
_OPEN = r"^(?:(?!UAA|UAG|UGA)[\s\S]{3})*+"


def letters(rna: Column) -> Column:
    """Amino acids up to the first stop; unknown codons are null among them. What follows the stop is not cut into codons."""
    at = lambda c: F.instr(F.lit(_CODONS), c)
    letter = lambda c: F.when(at(c) > 0, F.substring(F.lit(AMINO), F.floor((at(c) - 1) / 4).cast("int") + 1, F.lit(1)))
    return F.transform(chunks(F.regexp_extract(rna, _OPEN, 0), 3), letter)


def protein(rna: Column) -> Column:
    return F.array_join(letters(rna), "", "?")


def short_names(rna: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    return F.array_join(F.transform(letters(rna), lambda a: F.try_element_at(table, a)), "-", "?")


def encodings(peptide: Column) -> Column:
    """In how many ways DNA can spell a peptide."""
    many: dict[str, int] = {}
    for _, letter in codons():
        many[letter] = many.get(letter, 0) + 1
    table = F.create_map(*(x for k, n in many.items() for x in (F.lit(k), F.lit(n).cast("long"))))
    return F.aggregate(F.filter(F.split(peptide, ""), lambda c: c != ""), F.lit(1).cast("long"), lambda a, c: a * F.element_at(table, c))


def from_bits(bits: Column, start: int, n: int) -> Column:
    """Most significant first; start from 0."""
    return F.aggregate(F.slice(bits, start + 1, n), F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))


def to_bits(value: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda k: (F.floor(value / F.pow(F.lit(2.0), k)) % 2).cast("int"))


HEADER, TRAILER, WIDTH = [1, 0, 1, 0, 0], [0, 0, 1, 0, 1], 43


def packet(bits: Column) -> Column:
    """(valid, id, v1, v2, v3, v4) of 43 bits: header, 5 bits of id, four values of 7 bits to 100, trailer."""
    values = [from_bits(bits, 10 + 7 * i, 7) for i in range(4)]
    right = (F.size(bits) == WIDTH) & (F.slice(bits, 1, 5) == F.array(*map(F.lit, HEADER))) & (F.slice(bits, 39, 5) == F.array(*map(F.lit, TRAILER)))
    for v in values:
        right = right & (v <= 100)
    return F.struct(right.alias("valid"), from_bits(bits, 5, 5).alias("id"), *(v.alias(f"v{i + 1}") for i, v in enumerate(values)))
