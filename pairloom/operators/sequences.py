"""Sequences: cut sites, fragments and their statistics."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.errors import UnknownEnzymeException
from pairloom.operators.binning import edge


@dataclass(frozen=True)
class Enzyme:
    name: str
    site: str
    #: Bases of the site before the cut.
    cut: int


#: Recognition sites and cut offsets of common enzymes, from public tables.
ENZYMES = {
    e.name: e
    for e in (
        Enzyme("AluI", "AGCT", 2), Enzyme("ApaI", "GGGCCC", 5), Enzyme("BamHI", "GGATCC", 1), Enzyme("BglII", "AGATCT", 1), Enzyme("ClaI", "ATCGAT", 2),
        Enzyme("Csp6I", "GTAC", 1), Enzyme("DdeI", "CTNAG", 1), Enzyme("DpnII", "GATC", 0), Enzyme("EcoRI", "GAATTC", 1), Enzyme("EcoRV", "GATATC", 3),
        Enzyme("FatI", "CATG", 0), Enzyme("HaeIII", "GGCC", 2), Enzyme("HhaI", "GCGC", 3), Enzyme("HindIII", "AAGCTT", 1), Enzyme("HinfI", "GANTC", 1),
        Enzyme("HpaII", "CCGG", 1), Enzyme("HpyCH4IV", "ACGT", 1), Enzyme("KpnI", "GGTACC", 5), Enzyme("MboI", "GATC", 0), Enzyme("MluCI", "AATT", 0),
        Enzyme("MseI", "TTAA", 1), Enzyme("MspI", "CCGG", 1), Enzyme("NcoI", "CCATGG", 1), Enzyme("NdeI", "CATATG", 2), Enzyme("NlaIII", "CATG", 4),
        Enzyme("NotI", "GCGGCCGC", 2), Enzyme("PstI", "CTGCAG", 5), Enzyme("RsaI", "GTAC", 2), Enzyme("SacI", "GAGCTC", 5), Enzyme("SalI", "GTCGAC", 1),
        Enzyme("Sau3AI", "GATC", 0), Enzyme("SmaI", "CCCGGG", 3), Enzyme("SpeI", "ACTAGT", 1), Enzyme("TaqI", "TCGA", 1), Enzyme("XbaI", "TCTAGA", 1), Enzyme("XhoI", "CTCGAG", 1),
    )
}
#: Letters that stand for several bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_PAIR = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def enzyme(name: str) -> Enzyme:
    """The enzyme of exactly this name, or one given by its site with the cut marked, as in ``G^ANTC``; the error names similar ones."""
    if name in ENZYMES:
        return ENZYMES[name]
    if "^" in name and valid_site(site := name.upper().replace("^", "", 1)):
        return Enzyme(name, site, name.index("^"))
    similar = [n for n in ENZYMES if difflib.SequenceMatcher(None, n.lower(), name.lower()).ratio() >= 0.8]
    raise UnknownEnzymeException(name, sorted(similar))


def _pattern(site: str) -> str:
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in site)


def site_count(seq: Column, enzymes: list[Enzyme], start: Column | None = None) -> Column:
    """Cuts in a linear sequence: overlapping sites on both strands whose cut falls inside it."""
    upper = F.upper(seq)
    total = F.lit(0)
    for e in enzymes:
        other = e.site[::-1].translate(_PAIR)
        strands = {(e.site, e.cut)} | ({(other, len(e.site) - e.cut)} if other != e.site else set())
        for site, cut in sorted(strands):
            found = F.regexp_count(upper, F.lit(f"(?={_pattern(site)})"))
            # a site at the very start whose cut is before the first base, or at the very end whose cut is after the last, is none
            if cut <= 0:
                found = found - F.when(upper.rlike("^" + _pattern(site)), 1).otherwise(0)
            if cut >= len(site):
                found = found - F.when(upper.rlike(_pattern(site) + "$"), 1).otherwise(0)
            total = total + found
    return total.cast("int")


def tip_site_counts(seq: Column, enzymes: list[Enzyme], tip: int) -> Column:
    """[head, tail]: sites of the two ends; a sequence shorter than both is halved, the tail taking the middle base."""
    n = F.length(seq)
    half = F.floor(n / 2).cast("int")
    head = F.when(n < 2 * tip, F.substring(seq, F.lit(1), half)).otherwise(F.substring(seq, 1, tip))
    tail = F.when(n < 2 * tip, F.substring(seq, half + 1, n - half)).otherwise(F.substring(seq, n - tip + 1, F.lit(tip)))
    return F.array(site_count(head, enzymes), site_count(tail, enzymes))


def with_sites(sequences: DataFrame, enzymes: list[Enzyme], tip: int | None = None) -> DataFrame:
    sites = tip_site_counts(F.col("seq"), enzymes, tip) if tip else site_count(F.col("seq"), enzymes)
    return sequences.select("seq_name", "length", sites.alias("sites"))


def fragment_count(length: Column, size: int, threshold: float = 0.333, integer_division: bool = False) -> Column:
    """Pieces of a sequence; ``integer_division`` cuts the ratio to a whole number before the threshold is added."""
    ratio = F.floor(length / size) if integer_division else length.cast("double") / size
    return F.greatest(F.lit(1), F.floor(ratio + threshold)).cast("int")


def split_fragments(sequences: DataFrame, size: int = 10_000, threshold: float = 0.333, integer_division: bool = False) -> DataFrame:
    """(frag_id, seq_name, start, end, seq): near-equal pieces named ``<id>.<start>_<end>``; a column ``seq_no`` of the sequences is kept."""
    n = fragment_count(F.col("length"), size, threshold, integer_division)
    kept = [c for c in ("seq_no",) if c in sequences.columns]
    rows = sequences.select("seq_name", "seq", "length", *kept, n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    rows = rows.withColumn("start", edge(F.col("k"), F.col("n"), F.col("length"))).withColumn("end", edge(F.col("k") + 1, F.col("n"), F.col("length")))
    name = F.concat("seq_name", F.lit("."), F.col("start").cast("string"), F.lit("_"), F.col("end").cast("string"))
    return rows.select(name.alias("frag_id"), "seq_name", *kept, "start", "end", F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))


def split_stats(sequences: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row: number, mean and greatest length of sequences and fragments."""
    a = sequences.agg(F.count("*").alias("n_seqs"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"))
    b = fragments.select((F.col("end") - F.col("start")).alias("size")).agg(F.count("*").alias("n_fragments"), F.avg("size").alias("mean_fragment"), F.max("size").alias("max_fragment"))
    return a.join(b)  # one row each


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def oriented(seq: Column, ori: Column) -> Column:
    """The sequence, or its reverse complement where ori is -1; other orientations are an error."""
    from pairloom.functions.scalar import reverse_complement

    bad = F.raise_error(F.concat(ori.cast("string"), F.lit(" is no orientation: 1 or -1 is")))
    return F.when(ori == 1, seq).when(ori == -1, reverse_complement(seq)).otherwise(bad)


def valid_site(site: str) -> bool:
    return bool(re.fullmatch("[ACGTRYSWKMBDHVN]+", site))
