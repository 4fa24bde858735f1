"""Column functions on delimited identifiers and annotation fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "COI_5P"
#: Fixed value: the field that a tag rewrite leaves out.
MARKER_FIELD = "COI-5P"


def fields(value: Column, mark: str = "|") -> Column:
    """Fields without trailing empty ones."""
    pattern = f"[{mark}]"
    return F.split(F.regexp_replace(value, f"{pattern}+$", ""), pattern, -1)


def short_id(value: Column) -> Column:
    """Two fields of an id, by its number of fields; the first blank becomes _."""
    f = fields(value)
    pair = lambda a, b: F.concat_ws("|", F.get(f, F.lit(a)), F.get(f, F.lit(b)))
    four = F.when(F.get(f, F.lit(3)) == MARKER, pair(1, 2)).when(F.get(f, F.lit(2)) != MARKER, pair(2, 3)).otherwise(value)
    n = F.size(f)
    made = F.when(n == 2, pair(0, 1)).when(n == 5, pair(2, 3)).when(n == 4, four).when(n == 3, pair(1, 2)).otherwise(value)
    return F.regexp_replace(made, "^([^ ]*) ", "$1_")


def id_name(value: Column) -> Column:
    f = fields(value)
    return F.when(F.size(f) == 2, F.get(f, F.lit(1))).otherwise(value)


def genus(value: Column) -> Column:
    return F.substring_index(value, "_", 1)


def is_reference(value: Column) -> Column:
    return F.contains(value, F.lit("REFSEQ"))


def without_reference_mark(value: Column) -> Column:
    return F.replace(value, F.lit("_REFSEQ_"), F.lit(""))


def tagged(value: Column, tag: Column, compat: bool = False) -> Column:
    """Without the field COI-5P, and with _ and the tag (none yet: empty) at the end.

    ``compat`` ends with | instead where COI-5P was not the last field.
    """
    f = fields(value)
    kept = F.array_remove(f, MARKER_FIELD)
    inside = F.array_contains(f, MARKER_FIELD) & (F.element_at(f, -1) != MARKER_FIELD)
    mark = F.when(inside, "|").otherwise("_") if compat else F.lit("_")
    return F.concat(F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "|"), mark)).otherwise(""), F.coalesce(tag, F.lit("")))


def binomial(value: Column, from_right: int = 1, least: int = 4) -> Column:
    """The last two _ parts of a field counted from the right; null if one is short."""
    parts = F.split(F.try_element_at(F.split(value, "[|]"), F.lit(-from_right)), "_")
    one, two = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    return F.when((F.length(one) >= least) & (F.length(two) >= least), F.concat_ws("_", one, two))


def sanitized(value: Column, missing: str = "NA") -> Column:
    """Without quotes and outer blanks, blanks and commas as _; null is ``missing``."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(value, r'"|^\s+|\s+$', ""), "[ ,]", "_"), F.lit(missing))


def one_line(value: Column, missing: str = "NA") -> Column:
    return F.coalesce(F.regexp_replace(value, r"[\r\n]", ""), F.lit(missing))


def repaired_header(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit(" "), F.lit("_")), F.lit("BOLD:"), F.lit("BOLD_"))


def capped(value: Column, most: int = 3000) -> Column:
    return F.when(F.length(value) > most, "---").otherwise(value)


def lineage(value: Column) -> Column:
    """Joins ranks with ; from the second on, up to COMMENT."""
    stop = F.array_position(value, "COMMENT")
    last = F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size(value))
    return F.array_join(F.slice(value, 2, F.greatest(last - 1, F.lit(0))), ";")


def stem(value: Column) -> Column:
    return F.substring_index(value, ".", 1)


def membership_digest(ids: Column) -> Column:
    """Hex SHA-1 of the sorted ids, joined by commas."""
    return F.sha1(F.array_join(F.array_sort(ids), ","))


def short_key(value: Column, size: int = 7) -> Column:
    return F.left(F.sha2(value, 224), F.lit(size))


def percent_error(a: Column, b: Column) -> Column:
    return F.when(a != 0, F.abs(a - b) / a * 100)


def field_order(ident: Column, order: tuple[int, ...], mark: str = "_") -> Column:
    """The fields (from 1) of an identifier in another order, joined anew; absent ones are left out."""
    parts = F.split(ident, "[|]")
    return F.concat_ws(mark, *(F.get(parts, F.lit(k - 1)) for k in order))


def fasta_cell(name: Column, accession: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("_"), accession, F.lit("$"), seq)


def with_cluster(ident: Column, otu: Column) -> Column:
    return F.concat(ident, F.lit("|"), otu.cast("string"))


def without_tags(xml: Column) -> Column:
    """Text of a piece of XML: tags go, white space is single."""
    return F.trim(F.regexp_replace(F.regexp_replace(xml, "(?s)<[^>]*>", " "), r"\s+", " "))


def renamed_from_parts(value: Column, order: tuple[int, ...] = (5, 6, 3)) -> Column:
    """Parts (from 0) of an id cut at | and _, joined by _; a missing part is empty."""
    parts = F.split(F.translate(value, "|", "_"), "_")
    return F.array_join(F.array(*(F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in order)), "_")


#: Fixed value: primer tokens of read headers.
PRIMERS = "HCO[.]fna|mLepF1[.]fna|mLepR1[.]fna"


def read_line(line: Column, site_place: int) -> Column:
    """A cleaned line of a read file: a header with a primer gets the site, the part
    ``site_place`` before the first primer's, after a |; a line of numbers (a quality line) is null.

    Blanks become _. Lines with neither stay as they are.
    """
    plain = F.replace(F.regexp_replace(line, "\\x00$", ""), F.lit(" "), F.lit("_"))
    parts = F.split(plain, "_")
    at = F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(PRIMERS), i)), lambda x: x.isNotNull()))
    header = F.concat(F.lit(">"), F.coalesce(F.get(F.split(plain, ">"), F.lit(1)), F.lit("")))
    # Parts count only before the first that holds a >.
    stop = F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(F.contains(x, F.lit(">")), i)), lambda x: x.isNotNull()))
    numbers = F.exists(F.slice(parts, 1, F.coalesce(stop, F.size(parts))), lambda x: x.rlike(r"^\s*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$"))
    # A place before the first part counts from the end, as a negative index does.
    site = F.get(parts, F.when(at >= site_place, at - site_place).otherwise(F.size(parts) + at - site_place))
    return F.when(at.isNotNull(), F.concat_ws("|", header, F.coalesce(site, F.lit("")))).when(~numbers, plain)
