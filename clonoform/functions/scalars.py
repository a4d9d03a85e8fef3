"""Row-wise normalisation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the receptor schema: chain aliases, chains and truth words.
CHAIN_ALIASES = {
    "A": "TRA", "ALPHA": "TRA", "TCRA": "TRA",
    "B": "TRB", "BETA": "TRB", "TCRB": "TRB",
    "G": "TRG", "GAMMA": "TRG", "TCRG": "TRG",
    "D": "TRD", "DELTA": "TRD", "TCRD": "TRD",
    "HEAVY": "IGH", "KAPPA": "IGK", "LAMBDA": "IGL",
}
CHAINS = ("IGH", "IGK", "IGL", "TRA", "TRB", "TRD", "TRG")
TRUE_WORDS = ("true", "t", "1", "yes", "y", "productive")
FALSE_WORDS = ("false", "f", "0", "no", "n", "nonproductive", "unproductive")
MISSING_WORDS = ("", "nan", "none", "na", "<na>")
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def normalize_chain(c: Column) -> Column:
    """Upper case without ``-`` and ``_``; aliases resolved; missing words become NULL."""
    t = F.translate(F.upper(_text(c)), "-_", "")
    names = F.create_map(*[F.lit(x) for pair in CHAIN_ALIASES.items() for x in pair])
    return F.when(~F.lower(t).isin(*MISSING_WORDS), F.coalesce(F.try_element_at(names, t), t))


def normalize_productive(c: Column) -> Column:
    """True, false or NULL from truth words; other text is NULL."""
    t = F.lower(_text(c))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def normalize_text(c: Column) -> Column:
    t = _text(c)
    return F.when(~F.lower(t).isin(*MISSING_WORDS), t)


def truthy(c: Column) -> Column:
    """Truth test of the feature extraction and of the AIRR check: four words; NULL is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "t", "1", "yes"), F.lit(False))


def truthy_productive(c: Column) -> Column:
    """Truth test of the preparation: also the word "productive"."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "t", "1", "yes", "productive"), F.lit(False))


def numeric_rank(c: Column) -> Column:
    """A number for ranking; what doesn't parse ranks below everything."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(float("-inf")))


def eligibility(cdr3: Column) -> Column:
    return F.when(cdr3.startswith("C"), F.lit("eligible")).otherwise(F.lit("ineligible_cdr3_not_starting_c"))


def rfu_label(rfu_id: Column) -> Column:
    return F.concat(F.lit("RFU"), rfu_id.cast("string"))


def natural_key(c: Column) -> Column:
    """Orders text with its digit runs as numbers and letters without case, so that RFU2
    comes before RFU10. An array of structs; it compares element by element."""
    runs = F.regexp_extract_all(c.cast("string"), F.lit(r"\d+|\D+"), F.lit(0))
    parts = F.when(c.cast("string").rlike(r"^\d"), F.concat(F.array(F.lit("")), runs)).otherwise(runs)
    one = lambda p: F.struct(
        (~p.rlike(r"^\d+$")).alias("is_text"),
        F.when(p.rlike(r"^\d+$"), p).cast("decimal(38,0)").alias("number"),
        F.lower(p).alias("text"),
    )
    return F.transform(parts, one)


def align(cdr3: Column, width: Column, mode: str = "conserved_ends") -> Column:
    """Pad to a common width for display: left, right, center, or conserved_ends, which
    puts the gap before a final F or W of a sequence that starts with C."""
    gap = width - F.length(cdr3)
    dashes = lambda n: F.repeat(F.lit("-"), n.cast("int"))
    left = F.floor(gap / 2)
    centred = F.concat(dashes(left), cdr3, dashes(gap - left))
    if mode == "left":
        return F.concat(cdr3, dashes(gap))
    if mode == "right":
        return F.concat(dashes(gap), cdr3)
    if mode == "center":
        return centred
    if mode != "conserved_ends":
        raise ValueError("alignment must be left, right, center or conserved_ends")
    n = F.length(cdr3)
    anchored = cdr3.startswith("C") & (cdr3.endswith("F") | cdr3.endswith("W")) & (n >= 2)
    return F.when(anchored, F.concat(F.substr(cdr3, F.lit(1), n - 1), dashes(gap), F.substr(cdr3, n, F.lit(1)))).otherwise(centred)


def trimers(cdr3: Column, start: int = 2, end: int = 4) -> Column:
    """All windows of three residues inside the sequence, without ``start`` leading and
    ``end`` trailing residues. Too short: an empty array."""
    n = F.length(cdr3) - start - end - 2
    places = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(cdr3, i + start, F.lit(3)))


def rfu_status(cdr3: Column, rfu_id: Column, passed: Column) -> Column:
    ok = F.coalesce(passed, F.lit(False))
    return (
        F.when(~F.coalesce(cdr3.startswith("C"), F.lit(False)), "ineligible_cdr3_not_starting_c")
        .when(rfu_id.isNull(), "upstream_unassigned")
        .when(ok, "assigned_threshold_pass")
        .otherwise("assigned_below_threshold")
    )


def coverage_status(cdr3: Column, rfu_id: Column, passed: Column) -> Column:
    ok = F.coalesce(passed, F.lit(False))
    return (
        F.when(cdr3.isNull(), "missing_sequence")
        .when(~cdr3.startswith("C"), "ineligible_sequence")
        .when(rfu_id.isNull(), "upstream_unassigned")
        .when(ok, "covered")
        .otherwise("below_threshold")
    )


def assignment_status(coverage: Column) -> Column:
    return F.when(coverage == "covered", "nearest_threshold_qualified").when(coverage == "below_threshold", "nearest_below_threshold").otherwise(coverage)
