"""SMILES text: its tokens, and what makes a text no SMILES."""

from __future__ import annotations

import re

#: Element symbols (fixed values).
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
AROMATIC = ("se", "as", "te", "b", "c", "n", "o", "p", "s")
_SYMBOL = "|".join(sorted([*ELEMENTS, *AROMATIC, r"\*"], key=lambda x: -len(x)))
BRACKET = re.compile(rf"\[(?P<isotope>\d+)?(?P<symbol>{_SYMBOL})(?P<chiral>@@|@(?:TH[12]|AL[12]|SP[1-3]|TB\d{{1,2}}|OH\d{{1,2}})|@)?(?P<h>H\d?)?(?P<charge>\++|-+|[+-]\d{{1,2}})?(?P<map>:\d+)?\]")
TOKEN = re.compile(r"(?P<bracket>\[[^\[\]]*\])|(?P<atom>Cl|Br|[BCNOPSFI*bcnops])|(?P<bond>[-=#$:/\\])|(?P<ring>%\(\d{1,5}\)|%\d\d|\d)|(?P<open>\()|(?P<close>\))|(?P<dot>\.)")


def core(text: str | None) -> str:
    """Without anything from ``|`` on, trimmed."""
    return (text or "").split("|", 1)[0].strip()


def ring_number(token: str) -> int:
    return int(token.strip("%()"))


def fault(text: str | None) -> str | None:
    """Why ``text`` is no SMILES: blank, character, atom, bracket, parenthesis or ring; None if nothing is wrong."""
    s = core(text)
    if not s:
        return "blank"
    at, depth, open_rings = 0, 0, set()
    while at < len(s):
        m = TOKEN.match(s, at)
        if not m:
            return "bracket" if s[at] in "[]" else "character"
        at = m.end()
        kind = m.lastgroup
        if kind == "bracket" and not BRACKET.fullmatch(m.group()):
            return "atom"
        if kind == "ring":
            open_rings ^= {ring_number(m.group())}
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
            if depth < 0:
                return "parenthesis"
    return "parenthesis" if depth else "ring" if open_rings else None
