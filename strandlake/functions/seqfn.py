"""Column functions on sequences: gaps, ambiguity, translation, frames, composition."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes masked as gaps (V is not among them), the genetic code by
#: bases in the order TCAG, IUPAC codes with their bases, residue weights and
#: hydropathy, three-letter names.
AMBIGUOUS = "NRYKMSWBDH"
BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}
COMPLEMENT = ("ACGTRYKMBDHVSWN", "TGCAYRMKVHDBSWN")
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
THREE_LETTERS = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter", "?": "Xaa"}
#: Reduced alphabets, as residues and the letter of each one's class.
REDUCED = {
    "hydrophobic": ("AVLIPMFWGSTYCNQKRHDE", "IIIIIIIIOOOOOOOOOOOO"),
    "charge": ("KRHDEACFGILMNPQSTVWY", "CCCAANNNNNNNNNNNNNNN"),
    "chemical": ("GAVLIFYWDEHKRSTCMNQP", "LLLLLRRRAABBBHHSSMMI"),
    "structural": ("ACGPSTWYRNDQEHKILMFV", "AAAAAAAAEEEEEEEIIIII"),
    "functional": ("DEHKRAFILMPVWCGNQSTY", "AACCCHHHHHHHHPPPPPPP"),
    "dayhoff": ("CAGPSTDENQHKRILMVFWY", "ACCCCCDDDDEEEFFFFGGG"),
    "sneath": ("ILVAGPMNQCSTDEKRFHWY", "AAACCCDDDEEEFFGGHHHH"),
    "stanfel": ("ACGILMPSTVDENQFWYHKR", "AAAAAAAAAACCCCDDDEEE"),
}
#: Fixed value: codons that may start a protein under the standard code.
STARTS = ("TTG", "CTG", "ATG")
STOPS = ("TAA", "TAG", "TGA")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def lookup(pairs: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(pairs), key), F.lit(default))


def genetic_code(code: str = STANDARD_CODE) -> dict[str, str]:
    return {"".join(c): a for c, a in zip(product(BASES, repeat=3), code, strict=True)} | {"---": "-"}


def degapped(seq: Column) -> Column:
    return F.regexp_replace(seq, r"[-\s]", "")


def degapped_length(seq: Column) -> Column:
    return F.length(degapped(seq)).cast("long")


def mask_ambiguous(seq: Column) -> Column:
    return F.translate(seq, AMBIGUOUS, "-" * len(AMBIGUOUS))


def trim_trailing_gaps(seq: Column) -> Column:
    return F.regexp_replace(seq, "-+$", "")


def characters(seq: Column) -> Column:
    """Letters as an array; none for the empty sequence."""
    return F.regexp_extract_all(seq, F.lit("(?s)."), F.lit(0))


def reverse_complement(seq: Column, full: bool = False) -> Column:
    """Letters other than A, C, G, T and - are dropped, or with ``full`` complemented by IUPAC."""
    if full:
        return F.translate(F.reverse(seq), *COMPLEMENT)
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGT-]", "")), "ACGT", "TGCA")


def codons(seq: Column, frame: int = 1) -> Column:
    """Triplets from a frame (1 to 3) on, with a shorter last one."""
    return F.regexp_extract_all(F.substring(seq, frame, 1 << 30), F.lit("(?s).{1,3}"), F.lit(0))


def translate(seq: Column, frame: int = 1, code: str = STANDARD_CODE) -> Column:
    """Protein; an unknown or cut codon is ?."""
    table = genetic_code(code)
    return F.array_join(F.transform(codons(seq, frame), lambda c: lookup(table, c, "?")), "")


def six_frames(seq: Column) -> Column:
    """Array of (frame 1..3, -1..-3; protein; stops)."""
    back = reverse_complement(seq)
    rows = [(f, translate(seq, f)) for f in (1, 2, 3)] + [(-f, translate(back, f)) for f in (1, 2, 3)]
    return F.array(*(F.struct(F.lit(f).alias("frame"), p.alias("protein"), F.regexp_count(p, F.lit("[*]")).alias("stops")) for f, p in rows))


def best_frame(seq: Column) -> Column:
    """The frame with the fewest stops, of those the first in the order 1, 2, 3, -1, -2, -3."""
    return F.array_min(F.transform(six_frames(seq), lambda x, i: F.struct(x["stops"].alias("stops"), i.alias("at"), x["frame"].alias("frame"), x["protein"].alias("protein"))))


def open_reading_frames(protein: Column, least: int = 100) -> Column:
    """Runs from M to a stop of at least ``least`` letters."""
    return F.filter(F.regexp_extract_all(protein, F.lit("M[^*]*[*]"), F.lit(0)), lambda x: F.length(x) >= least)


def frame_shift(seq: Column) -> Column:
    """Gaps to put in front (0 to 3) so that no TAA or TAG is in frame; TGA is no stop here."""
    def clean(shift: int) -> Column:
        return ~F.exists(codons(F.concat(F.lit("-" * shift), seq)), lambda c: c.isin("TAA", "TAG"))

    return F.when(clean(0), 0).when(clean(1), 1).when(clean(2), 2).otherwise(3)


def back_translate(protein: Column, dna: Column) -> Column:
    """Spreads degapped ``dna`` over an aligned protein: a codon per residue, --- per gap."""
    letters = characters(protein)
    step = F.aggregate(letters, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.struct(F.when(x == "-", s["at"]).otherwise(s["at"] + 1).alias("at"), F.concat(s["out"], F.when(x == "-", "---").otherwise(F.substring(dna, s["at"] * 3 + 1, F.lit(3)))).alias("out")))
    return step["out"]


def splice(seq: Column, start, end) -> Column:
    """Bases start to end, 1-based and closed."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.substring(seq, start, end - start + 1)


#: Characters of a piece that windows are cut from, at least.
PIECE = 256


def windows(seq: Column, size: int, step: int) -> Column:
    """Array of (start, text) of full windows, in time that follows the text's length.

    A window is cut from a short piece of the text, with what follows of the next
    piece: a cut by place counts characters from the beginning.
    """
    piece = max(PIECE, size)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def of_text(text: Column) -> Column:
        last = F.length(text) - size + 1

        def of_piece(pieces: Column):
            def cut(p: Column, k: Column) -> Column:
                # Starts of a piece: from the first multiple of the step in it, up to its end or the last full window.
                first = F.pmod(-(k * piece), F.lit(step)) + 1
                most = F.least(F.length(p), last - k * piece)
                starts = F.when(most >= first, F.sequence(first, most, F.lit(step))).otherwise(F.array().cast("array<int>"))
                longer = F.concat(p, F.coalesce(F.substring(F.get(pieces, k + 1), 1, size - 1), F.lit("")))
                return let(longer, lambda q: F.transform(starts, lambda i: F.struct((k * piece + i).alias("start"), F.substring(q, i, F.lit(size)).alias("text"))))

            return F.flatten(F.transform(pieces, cut))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), of_piece)

    return let(seq, of_text)


def gc_content(seq: Column) -> Column:
    plain = degapped(seq)
    return F.when(F.length(plain) > 0, F.regexp_count(plain, F.lit("[GC]")) / F.length(plain))


def hydropathy(protein: Column) -> Column:
    """Mean hydropathy of the known residues."""
    known = F.filter(F.transform(characters(protein), lambda x: F.try_element_at(literal_map(HYDROPATHY), x)), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def three_letters(protein: Column) -> Column:
    return F.array_join(F.transform(characters(protein), lambda x: lookup(THREE_LETTERS, x, "Xaa")), "")


def reduced_alphabet(protein: Column, name: str) -> Column:
    return F.translate(protein, *REDUCED[name])


def iupac_code(bases: Column) -> Column:
    """Code of a set of bases, given as an array."""
    return lookup(IUPAC, F.array_join(F.array_sort(F.array_distinct(bases)), ""), "N")


def ambiguity_choices(seq: Column) -> Column:
    """Per letter, the bases it stands for; a letter that is no code stands for itself."""
    bases = {code: list(of) for of, code in IUPAC.items()}
    table = F.create_map(*[x for code, of in bases.items() for x in (F.lit(code), F.array(*map(F.lit, of)))])
    return F.transform(characters(seq), lambda c: F.coalesce(F.try_element_at(table, c), F.array(c)))


def expansion_count(seq: Column) -> Column:
    """How many sequences an ambiguous one stands for."""
    return F.aggregate(ambiguity_choices(seq), F.lit(1).cast("long"), lambda n, of: n * F.size(of))


def expansions(seq: Column) -> Column:
    """All sequences that an ambiguous one stands for; as many as ``expansion_count`` says."""
    longer = lambda made, of: F.flatten(F.transform(made, lambda m: F.transform(of, lambda b: F.concat(m, b))))
    return F.aggregate(ambiguity_choices(seq), F.array(F.lit("")), longer)


def one_letters(names: Column) -> Column:
    """Three-letter residue names in a row as letters; an unknown one is X."""
    table = {name.lower(): letter for letter, name in THREE_LETTERS.items()}
    return F.array_join(F.transform(codons(names), lambda c: lookup(table, F.lower(c), "X")), "")


def gap_to_star(seq: Column) -> Column:
    return F.translate(seq, "-", "*")


def cleaned_length(seq: Column) -> Column:
    """Letters other than N."""
    return F.length(F.regexp_replace(seq, "[nN]", "")).cast("long")
