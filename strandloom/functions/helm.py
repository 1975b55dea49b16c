"""HELM strings as Column expressions (no Python in the hot path).

A HELM string is ``CHAIN1{m.m.m}|CHAIN2{...}$connections$groups$annotations$version``; connections are
``CHAIN,CHAIN,pos:R-pos:R`` joined by ``|``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, squeezed

BLOCK = r"PEPTIDE[0-9]+\{([^}]*)\}"


def canonical_connection(c: Column) -> Column:
    """One connection, chain names and R in capitals, its two ends in string order."""
    g = lambda i: F.regexp_extract(c, r"^([^,]+),([^,]+),([^:,]+):([^-]+)-([^:]+):(.+)$", i)
    a = F.concat_ws(":", g(1), g(3), g(4))
    b = F.concat_ws(":", g(2), g(5), g(6))
    return F.when(g(1) == "", c).otherwise(F.concat_ws("-", F.least(a, b), F.greatest(a, b)))


def helm_meaning(helm) -> Column:
    """A key that is equal for HELM texts that mean the same.

    Ignored: white space, case of chain names and of R, brackets around a one-letter symbol, the order of a
    connection's ends and of the connections, and what follows the last ``$``. Null stays null.
    """
    text = squeezed(helm)
    text = F.when(text.contains("$"), F.left(text, F.length(text) - F.length(F.substring_index(text, "$", -1)))).otherwise(text)
    parts = F.split(text, r"\$", -1)
    chain = lambda p: F.when(
        p.contains("{"),
        F.concat(F.upper(F.substring_index(p, "{", 1)), F.regexp_replace(F.regexp_extract(p, r"(\{.*)$", 1), r"(?<=[{.])\[(\p{L})\](?=[.}])", "$1")),
    ).otherwise(p)
    chains = F.array_join(F.transform(F.split(parts[0], r"\|"), chain), "|")
    links = F.filter(F.split(F.upper(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), r"\|"), lambda x: x != "")
    links = F.array_join(F.array_sort(F.transform(links, canonical_connection)), "|")
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "$")
    return F.when(col(helm).isNotNull(), F.concat_ws("$", chains, links, rest))


def smiles_meaning(smiles) -> Column:
    """A key that is equal for SMILES that differ in white space, component order or anything from ``|`` on."""
    return F.array_join(F.array_sort(F.split(F.substring_index(squeezed(smiles), "|", 1), r"\.")), ".")


def chain_symbols(helm) -> Column:
    """Distinct monomer symbols of the PEPTIDE chains (names in any case), without brackets and white space."""
    blocks = F.regexp_extract_all(squeezed(helm), F.lit(r"(?i)(?<![A-Za-z0-9])PEPTIDE[0-9]*\{([^}]*)\}"), F.lit(1))
    names = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, r"\."))), lambda m: F.regexp_replace(m, r"^\[|\]$", ""))
    return F.array_distinct(F.filter(names, lambda m: m != ""))


def clean(helm) -> Column:
    """Without white space of any kind."""
    return squeezed(helm)


def strip_brackets(m: Column) -> Column:
    return F.regexp_replace(m, r"^\[(.*)\]$", "$1")


def monomers(helm) -> Column:
    """Monomers of all PEPTIDE chains in order, trimmed, without their brackets; null if there is no such chain."""
    blocks = F.regexp_extract_all(col(helm), F.lit(BLOCK), F.lit(1))
    parts = F.flatten(F.transform(blocks, lambda b: F.split(b, r"\.")))
    return F.when(F.size(blocks) > 0, F.transform(F.filter(F.transform(parts, lambda m: F.trim(m)), lambda m: m != ""), strip_brackets))


def chain_ids(helm) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(helm), F.lit(r"PEPTIDE[0-9]+"), F.lit(0)))


def renumbered(helm) -> Column:
    """A single chain becomes PEPTIDE1; texts with none or several stay."""
    return F.when(F.size(chain_ids(helm)) == 1, F.regexp_replace(col(helm), r"PEPTIDE[0-9]+", "PEPTIDE1")).otherwise(col(helm))


STRICT_LINK = r"^([A-Za-z]+)([0-9]+),([A-Za-z]+)([0-9]+),([0-9]+):R([0-9]+)-([0-9]+):R([0-9]+)$"


def is_swapped(link: Column) -> Column:
    """Whether a fully numbered connection has its larger end (by type, chain, position, R, as numbers) first."""
    g = lambda i: F.regexp_extract(link, STRICT_LINK, i)
    end = lambda t, c, p, r: F.struct(g(t).alias("t"), g(c).cast("long").alias("c"), g(p).cast("long").alias("p"), g(r).cast("long").alias("r"))
    return F.when(link.rlike(STRICT_LINK), end(3, 4, 7, 8) < end(1, 2, 5, 6)).otherwise(False)


def links(helm) -> Column:
    """Connection texts of the section after the first ``$``."""
    return F.split(F.coalesce(F.get(F.split(col(helm), r"\$", -1), F.lit(1)), F.lit("")), r"\|", -1)


def linked_in_order(helm) -> Column:
    """Each fully numbered connection with its smaller end first; connections with wildcards stay as they are."""
    turned = F.transform(links(helm), lambda x: F.when(is_swapped(x), F.regexp_replace(x, STRICT_LINK, "$3$4,$1$2,$7:R$8-$5:R$6")).otherwise(x))
    parts = F.split(col(helm), r"\$", -1)
    whole = F.concat_ws("$", parts[0], F.array_join(turned, "|"), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "$"))
    return F.when(F.size(parts) > 2, whole).when(F.size(parts) == 2, F.concat_ws("$", parts[0], F.array_join(turned, "|"))).otherwise(col(helm))


def remapped(helm, table: Column) -> Column:
    """Symbols inside PEPTIDE blocks replaced through ``table`` (map of symbol to symbol); a replacement is put in
    brackets if the symbol was, or if it has more than one letter."""

    def one(m: Column) -> Column:
        name = strip_brackets(F.trim(m))
        new = F.try_element_at(table, name)
        return F.when(new.isNull(), m).when(F.trim(m).startswith("[") | (F.length(new) > 1), F.concat(F.lit("["), new, F.lit("]"))).otherwise(new)

    def part(p: Column) -> Column:
        head = F.regexp_extract(p, r"^(.*PEPTIDE[0-9]+\{)[^{]*$", 1)
        body = F.substring(p, F.length(head) + 1, F.length(p))
        return F.when(head == "", p).otherwise(F.concat(head, F.array_join(F.transform(F.split(body, r"\.", -1), one), ".")))

    return F.array_join(F.transform(F.split(col(helm), r"\}", -1), part), "}")


def map_column(pairs: dict[str, str]) -> Column:
    """A constant map column."""
    import json

    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


#: Side chains of the standard residues within N[C@@H](...)C(=O) (fixed values).
RESIDUES = {
    "A": "N[C@@H](C)C(=O)", "R": "N[C@@H](CCCNC(=N)N)C(=O)", "N": "N[C@@H](CC(=O)N)C(=O)", "D": "N[C@@H](CC(=O)O)C(=O)", "C": "N[C@@H](CS)C(=O)",
    "E": "N[C@@H](CCC(=O)O)C(=O)", "Q": "N[C@@H](CCC(=O)N)C(=O)", "G": "NCC(=O)", "H": "N[C@@H](Cc1c[nH]cn1)C(=O)", "I": "N[C@@H]([C@@H](C)CC)C(=O)",
    "L": "N[C@@H](CC(C)C)C(=O)", "K": "N[C@@H](CCCCN)C(=O)", "M": "N[C@@H](CCSC)C(=O)", "F": "N[C@@H](Cc1ccccc1)C(=O)", "P": "N1CCC[C@H]1C(=O)",
    "S": "N[C@@H](CO)C(=O)", "T": "N[C@@H]([C@H](O)C)C(=O)", "W": "N[C@@H](Cc1c[nH]c2ccccc12)C(=O)", "Y": "N[C@@H](Cc1ccc(O)cc1)C(=O)", "V": "N[C@@H](C(C)C)C(=O)",
}
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def usable_sequence(seq) -> Column:
    """Upper-case letters of the standard residues only; null for empty, ``-`` and sequences with X."""
    up = F.upper(F.trim(col(seq)))
    kept = F.regexp_replace(up, f"[^{AMINO_ACIDS}]", "")
    return F.when((up != "") & (up != "-") & ~up.contains("X") & (kept != ""), kept)


def sequence_to_helm(seq) -> Column:
    s = usable_sequence(seq)
    return F.coalesce(F.concat(F.lit("PEPTIDE1{"), F.array_join(F.split(s, "(?!^)(?!$)"), "."), F.lit("}$$$$")), F.lit(""))


def sequence_to_smiles(seq) -> Column:
    s = usable_sequence(seq)
    return F.coalesce(F.concat(F.array_join(F.transform(F.split(s, "(?!^)(?!$)"), lambda a: F.try_element_at(map_column(RESIDUES), a)), ""), F.lit("O")), F.lit(""))


def design_monomer(m: Column) -> Column:
    """Lower case is a D residue, ``Me`` before a residue N-methylation, MeG sarcosine; other names get brackets."""
    return (
        F.when(m == "MeG", F.lit("[Sar]"))
        .when(m.rlike("^[A-Z]$"), m)
        .when(m.rlike("^[a-z]$"), F.concat(F.lit("[d"), F.upper(m), F.lit("]")))
        .when(m.rlike("^Me[A-Z]$"), F.concat(F.lit("[me"), F.substring(m, 3, 1), F.lit("]")))
        .when(m.rlike("^Me[a-z]$"), F.concat(F.lit("[Me_d"), F.upper(F.substring(m, 3, 1)), F.lit("]")))
        .otherwise(F.concat(F.lit("["), m, F.lit("]")))
    )


def design_to_cyclic_helm(code) -> Column:
    """Dot-joined design code to a head-to-tail cyclic HELM 2.0."""
    parts = F.split(col(code), r"\.")
    return F.concat(F.lit("PEPTIDE1{"), F.array_join(F.transform(parts, design_monomer), "."), F.lit("}$PEPTIDE1,PEPTIDE1,1:R1-"), F.size(parts).cast("string"), F.lit(":R2$$$V2.0"))


def composition(seq) -> list[Column]:
    """Share of each residue, and the length up to 3,000 as a share of that."""
    n = F.length(col(seq))
    shares = [((n - F.length(F.replace(col(seq), F.lit(a), F.lit("")))) / n).alias(f"share_{a.lower()}") for a in AMINO_ACIDS]
    return [*shares, (F.least(n, F.lit(3000)) / 3000).alias("length_share")]
