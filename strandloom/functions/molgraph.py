"""Molecular graphs from SMILES: canonical text, scaffolds, circular fingerprints and stereo operations.

Pure Python on one molecule at a time, meant to run inside Arrow UDFs over distinct texts. Tetrahedral stereo is kept;
the geometry of double bonds is read but not told apart.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from .smiles import BRACKET, TOKEN, core, ring_number

AROMATIC_BOND = 4
ORDERS = {"-": 1, "=": 2, "#": 3, "$": 1, ":": AROMATIC_BOND, "/": 1, "\\": 1}
#: Usual valences (fixed values).
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
HYDROGEN = -1
_R_GROUP = re.compile(r"\[R(\d*)\]")


class NoMolecule(ValueError):
    """The text is no SMILES that can be read as a graph."""


@dataclass
class Atom:
    symbol: str
    aromatic: bool = False
    charge: int = 0
    isotope: int = 0
    hydrogens: int = 0
    label: int = 0  # of an R group
    turn: int = 0  # 1: counterclockwise through ``order``, -1: clockwise, 0: no stereo
    order: list = field(default_factory=list)  # neighbours as written, HYDROGEN for an implicit one
    bracket: bool = False


class Molecule:
    def __init__(self):
        self.atoms: list[Atom] = []
        self.bonds: list[dict[int, int]] = []
        self.rings: list[tuple[int, ...]] | None = None  # as last looked for

    def add(self, atom: Atom) -> int:
        self.atoms.append(atom)
        self.bonds.append({})
        return len(self.atoms) - 1

    def bond(self, a: int, b: int, order: int) -> None:
        if a == b or b in self.bonds[a]:
            raise NoMolecule("bond")
        self.bonds[a][b] = self.bonds[b][a] = order
        self.rings = None

    def without(self, gone: set[int]) -> "Molecule":
        """The graph without some atoms; what was bonded to them gets hydrogens."""
        m, at = Molecule(), {}
        for i, a in enumerate(self.atoms):
            if i not in gone:
                lost = sum(1 if o == AROMATIC_BOND else o for j, o in self.bonds[i].items() if j in gone)
                at[i] = m.add(Atom(a.symbol, a.aromatic, a.charge, a.isotope, a.hydrogens + lost, a.label, 0, [], a.bracket))
        for i, near in enumerate(self.bonds):
            for j, o in near.items():
                if i < j and i in at and j in at:
                    m.bond(at[i], at[j], o)
        return m


def parse(text: str | None) -> Molecule:
    """Read a SMILES, with R groups as ``[*:1]``, ``[1*]``, ``[R1]``, or ``*`` named in a ``|$...$|`` tail."""
    s = _R_GROUP.sub(lambda x: f"[*:{x[1] or 0}]", core(text))
    if not s:
        raise NoMolecule("blank")
    m, stack, before, bond, rings, lone = Molecule(), [], None, None, {}, {}  # lone: where a centre of three neighbours has its lone pair
    at = 0
    while at < len(s):
        t = TOKEN.match(s, at)
        if not t:
            raise NoMolecule(f"character {at}")
        at, kind, token = t.end(), t.lastgroup, t.group()
        if kind in ("atom", "bracket"):
            if kind == "atom":
                a = Atom(token.capitalize() if token.islower() else token, token.islower())
            else:
                b = BRACKET.fullmatch(token)
                if not b:
                    raise NoMolecule("atom")
                sym, charge = b["symbol"], b["charge"] or ""
                a = Atom(sym.capitalize(), sym.islower() and sym != "*", bracket=True, isotope=int(b["isotope"] or 0))
                a.charge = (int(charge[1:]) if charge[1:].isdigit() else len(charge)) * (-1 if charge[:1] == "-" else 1)
                a.hydrogens = int(b["h"][1:] or 1) if b["h"] else 0
                a.turn = {"@": 1, "@@": -1}.get(b["chiral"] or "", 0)
                if sym == "*":
                    a.label, a.isotope = int((b["map"] or ":0")[1:]) or a.isotope, 0
            i = m.add(a)
            if before is not None:
                default = AROMATIC_BOND if a.aromatic and m.atoms[before].aromatic else 1
                m.bond(before, i, bond or default)
                m.atoms[before].order.append(i)
                a.order.append(before)
            if a.hydrogens == 1 and a.bracket:
                a.order.append(HYDROGEN)
            elif a.turn:
                lone[i] = len(a.order)
            before, bond = i, None
        elif kind == "bond":
            bond = ORDERS[token]
        elif kind == "open":
            if before is None:
                raise NoMolecule("parenthesis")
            stack.append(before)
        elif kind == "close":
            if not stack:
                raise NoMolecule("parenthesis")
            before, bond = stack.pop(), None
        elif kind == "dot":
            before, bond = None, None
        else:
            n = ring_number(token)
            if before is None:
                raise NoMolecule("ring")
            if n in rings:
                other, own, slot = rings.pop(n)
                default = AROMATIC_BOND if m.atoms[before].aromatic and m.atoms[other].aromatic else 1
                m.bond(other, before, bond or own or default)
                m.atoms[other].order[slot] = before
                m.atoms[before].order.append(other)
            else:
                rings[n] = (before, bond, len(m.atoms[before].order))
                m.atoms[before].order.append(None)
            bond = None
    if stack or rings:
        raise NoMolecule("ring" if rings else "parenthesis")
    if not m.atoms:
        raise NoMolecule("blank")
    for i, place in lone.items():
        if len(m.atoms[i].order) == 3:
            m.atoms[i].order.insert(place, HYDROGEN)
    _single_between_rings(m)
    _fill_hydrogens(m)
    _name_groups(m, text or "")
    _aromatize(m)
    return m


def _single_between_rings(m: Molecule) -> None:
    """A bond left out between aromatic atoms is aromatic only within a ring of such atoms."""
    if not any(a.aromatic for a in m.atoms):
        return
    inside = {frozenset(x) for r in rings(m, 7) if all(m.atoms[i].aromatic for i in r) for x in zip(r, r[1:] + r[:1])}
    for a, near in enumerate(m.bonds):
        for b in near:
            if near[b] == AROMATIC_BOND and frozenset((a, b)) not in inside:
                near[b] = m.bonds[b][a] = 1


def _fill_hydrogens(m: Molecule) -> None:
    for a, near in zip(m.atoms, m.bonds):
        if a.bracket or a.symbol == "*":
            continue
        used = sum(1 if o == AROMATIC_BOND else o for o in near.values()) + (a.aromatic and a.symbol in "BCNP" and (a.symbol == "C" or len(near) < 3))
        a.hydrogens = next((v - used for v in VALENCES.get(a.symbol, (0,)) if v >= used), 0)


def _name_groups(m: Molecule, text: str) -> None:
    tail = re.search(r"\|[^|]*\$([^$]*)\$", text)
    if not tail:
        return
    names = tail[1].split(";")
    stars = [i for i, a in enumerate(m.atoms) if a.symbol == "*"]
    for i, name in zip(range(len(m.atoms)) if len(names) == len(m.atoms) and len(names) != len(stars) else stars, names):
        number = re.search(r"R(\d+)", name)
        if number and m.atoms[i].symbol == "*":
            m.atoms[i].label = m.atoms[i].label or int(number[1])


RING_SIZE = 8


def rings(m: Molecule, longest: int = RING_SIZE) -> list[tuple[int, ...]]:
    """The shortest ring through each bond that is in one, up to a size (at most RING_SIZE). Only what is left without the branches is
    searched, and no further than the size, so long chains and large rings cost no more than their length."""
    if m.rings is None:
        m.rings = _find_rings(m)
    return [r for r in m.rings if len(r) <= longest]


def _find_rings(m: Molecule) -> list[tuple[int, ...]]:
    degree = [len(near) for near in m.bonds]
    ends = [i for i, d in enumerate(degree) if d == 1]
    while ends:
        i = ends.pop()
        degree[i] = 0
        for j in m.bonds[i]:
            if degree[j]:
                degree[j] -= 1
                if degree[j] == 1:
                    ends.append(j)
    found = {}
    for a, near in enumerate(m.bonds):
        if not degree[a]:
            continue
        for b in near:
            if a > b or not degree[b]:
                continue
            back, front, depth = {a: None}, [a], 1
            while front and b not in back and depth < RING_SIZE:
                new, depth = [], depth + 1
                for x in front:
                    for y in m.bonds[x]:
                        if degree[y] and y not in back and not (x == a and y == b):
                            back[y] = x
                            new.append(y)
                front = new
            if b in back:
                path, x = [], b
                while x is not None:
                    path.append(x)
                    x = back[x]
                found[frozenset(path)] = tuple(path)
    return list(found.values())


def _electrons(m: Molecule, i: int, ring: frozenset) -> int | None:
    """What an atom gives to a ring's aromatic sextet; None if it can't be part of one."""
    a, near = m.atoms[i], m.bonds[i]
    double_in = any(o == 2 and j in ring for j, o in near.items())
    if a.symbol == "C":
        if a.aromatic or double_in:
            return 1
        return 0 if any(o == 2 and m.atoms[j].symbol in ("O", "S", "N") for j, o in near.items()) else None
    if a.symbol in ("N", "P"):
        if double_in:
            return 1
        return 2 if len(near) + a.hydrogens == 3 else 1 if a.aromatic else None
    if a.symbol in ("O", "S") and len(near) == 2 and all(o in (1, AROMATIC_BOND) for o in near.values()):
        return 2
    return None


def _aromatize(m: Molecule) -> None:
    todo = [(frozenset(r), r) for r in rings(m, 7) if 5 <= len(r)]
    changed = True
    while changed:
        changed = False
        for s, r in todo:
            if all(m.bonds[a][b] == AROMATIC_BOND for a, b in zip(r, r[1:] + r[:1])):
                continue
            gives = [_electrons(m, i, s) for i in r]
            if None not in gives and sum(gives) == 6:
                for i in r:
                    m.atoms[i].aromatic = True
                for a, b in zip(r, r[1:] + r[:1]):
                    m.bonds[a][b] = m.bonds[b][a] = AROMATIC_BOND
                changed = True


def _parity(order: list, rank: list[int]) -> int:
    """1 if the neighbours' ranks are an even permutation as written, -1 if odd, 0 if two are alike."""
    r = [HYDROGEN if x == HYDROGEN else rank[x] for x in order]
    if len(set(r)) < len(r) or len(r) < 4:
        return 0
    swaps = sum(r[i] > r[j] for i in range(len(r)) for j in range(i + 1, len(r)))
    return -1 if swaps % 2 else 1


class Ranks:
    """Atoms in classes; an atom's rank is the number of atoms in the classes before its own.

    Classes are split by what their atoms are bonded to. When some atoms of a class see a neighbour's rank change, they
    part from those that see none, which keep their rank, and among themselves by the new ranks around them. Only
    neighbours of atoms whose rank changed are looked at, so a chain costs its length. Every choice goes by ranks and keys, so it
    does not depend on the order in which a molecule is written.
    """

    def __init__(self, m: Molecule, keys: list):
        self.m, self.rank, self.members = m, [0] * len(keys), {}
        by: dict = {}
        for i, k in enumerate(keys):
            by.setdefault(k, set()).add(i)
        at = 0
        for k in sorted(by):
            self.members[at] = by[k]
            for i in by[k]:
                self.rank[i] = at
            at += len(by[k])
        self._refine(range(len(keys)))

    def _part(self, r: int, groups: dict) -> list[int]:
        """Atoms of class r go to new classes by their key, after those that stay; returns the ones whose rank changed."""
        own, moved = self.members[r], []
        at = r + len(own) - sum(map(len, groups.values()))
        for k in sorted(groups):
            atoms = groups[k]
            if at > r:
                own.difference_update(atoms)
                self.members[at] = set(atoms)
                for i in atoms:
                    self.rank[i] = at
                moved += atoms
            at += len(atoms)
        return moved

    def _refine(self, touched) -> None:
        rank, bonds = self.rank, self.m.bonds
        while touched:
            groups: dict[int, dict] = {}
            for i in touched:
                if len(self.members[rank[i]]) > 1:
                    key = tuple(sorted([(rank[j], o) for j, o in bonds[i].items()]))
                    groups.setdefault(rank[i], {}).setdefault(key, []).append(i)
            moved = [i for r, by in groups.items() for i in self._part(r, by)]
            touched = {j for i in moved for j in bonds[i]}

    def split(self, keys: dict[int, int]) -> bool:
        """Split classes by the keys of their atoms (0 for those without one); whether any class was."""
        groups: dict[int, dict] = {}
        for i, k in keys.items():
            groups.setdefault(self.rank[i], {}).setdefault(k, []).append(i)
        moved = [i for r, by in groups.items() for i in self._part(r, by)]
        self._refine({j for i in moved for j in self.m.bonds[i]})
        return bool(moved)

    def single_out(self) -> None:
        """Break ties, the first class first, by setting one of its atoms apart, until every atom has its own rank."""
        at = 0
        while at < len(self.rank):
            if len(self.members[at]) == 1:
                at += 1
                continue
            one = min(self.members[at])
            self._refine({j for i in self._part(at, {0: [one]}) for j in self.m.bonds[i]})


def _classes(m: Molecule, stereo: bool) -> Ranks:
    ring_sizes: list[list[int]] = [[] for _ in m.atoms]
    for r in rings(m):
        for i in r:
            ring_sizes[i].append(len(r))
    got = Ranks(m, [(a.symbol, a.aromatic, a.charge, a.isotope, a.hydrogens, a.label, len(near), tuple(sorted(sizes))) for a, near, sizes in zip(m.atoms, m.bonds, ring_sizes)])
    centres = [i for i, a in enumerate(m.atoms) if a.turn] if stereo else []
    while centres and got.split({i: t for i in centres if (t := m.atoms[i].turn * _parity(m.atoms[i].order, got.rank))}):
        pass
    return got


def classes(m: Molecule, stereo: bool = True) -> list[int]:
    """Equal numbers for atoms that look alike from everywhere, stereo centres included."""
    return _classes(m, stereo).rank


def _unique(m: Molecule, stereo: bool) -> tuple[list[int], list[int]]:
    ranks = _classes(m, stereo)
    same = list(ranks.rank)
    ranks.single_out()
    return same, ranks.rank


def canonical(m: Molecule, stereo: bool = True) -> str:
    """One text for all ways to write the molecule; components in string order."""
    same, rank = _unique(m, stereo)
    left, parts = set(range(len(rank))), []
    while left:
        parts.append(_write(m, min(left, key=rank.__getitem__), rank, same, left, stereo))
    return ".".join(sorted(parts))


def _write(m: Molecule, start: int, rank: list[int], same: list[int], left: set[int], stereo: bool) -> str:
    parent, children, closing = {start: None}, {}, {}
    stack, seen = [(start, iter(sorted(m.bonds[start], key=rank.__getitem__)))], {start}
    order = {start: 0}
    while stack:
        a, it = stack[-1]
        for b in it:
            if b not in seen:
                seen.add(b)
                order[b] = len(order)
                parent[b] = a
                children.setdefault(a, []).append(b)
                stack.append((b, iter(sorted(m.bonds[b], key=rank.__getitem__))))
                break
            if parent[a] != b and order[b] < order[a]:
                closing.setdefault(b, []).append(a)
                closing.setdefault(a, []).append(b)
        else:
            stack.pop()
    left -= seen
    numbers: dict[tuple[int, int], int] = {}
    free: list[int] = []
    top, out = 0, []
    work: list = [start]
    while work:
        a = work.pop()
        if isinstance(a, str):
            out.append(a)
            continue
        p, marks = parent[a], []
        ends = sorted(closing.get(a, []), key=lambda b: (order[b] > order[a], rank[b]))
        for b in ends:
            pair = (min(a, b), max(a, b))
            if pair in numbers:
                n = numbers[pair]
                free.append(n)
            else:
                free.sort()
                n = free.pop(0) if free else (top := top + 1)
                numbers[pair] = n
            marks.append(("" if order[b] < order[a] else _bond_text(m, a, b)) + (str(n) if n < 10 else f"%{n}"))
        out.append((_bond_text(m, p, a) if p is not None else "") + _atom_text(m, a, p, ends, children.get(a, []), same, stereo) + "".join(marks))
        below = children.get(a, [])
        for k, b in reversed(list(enumerate(below))):
            work.extend([b] if k == len(below) - 1 else [")", b, "("])
    return "".join(out)


def _bond_text(m: Molecule, a: int, b: int) -> str:
    o = m.bonds[a][b]
    both = m.atoms[a].aromatic and m.atoms[b].aromatic
    return {1: "-" if both else "", 2: "=", 3: "#", AROMATIC_BOND: "" if both else ":"}[o]


def _atom_text(m: Molecule, i: int, p, ends: list[int], below: list[int], same: list[int], stereo: bool) -> str:
    a = m.atoms[i]
    turn = ""
    if stereo and a.turn and _parity(a.order, same):
        written = [*([p] if p is not None else []), *([HYDROGEN] if HYDROGEN in a.order else []), *ends, *below]
        place = {x: k for k, x in enumerate(a.order)}
        w = [place[x] for x in written]
        swaps = sum(w[x] > w[y] for x in range(len(w)) for y in range(x + 1, len(w)))
        turn = "@" if (a.turn if swaps % 2 == 0 else -a.turn) == 1 else "@@"
    symbol = a.symbol.lower() if a.aromatic else a.symbol
    if a.symbol == "*":
        return f"[*:{a.label}]" if a.label else "*"
    used = sum(1 if o == AROMATIC_BOND else o for o in m.bonds[i].values()) + (a.aromatic and a.symbol in "BCNP" and (a.symbol == "C" or len(m.bonds[i]) < 3))
    usual = next((v - used for v in VALENCES.get(a.symbol, ()) if v >= used), None)
    if not turn and not a.charge and not a.isotope and usual == a.hydrogens and (not a.aromatic or a.symbol in "BCNOPS"):
        return symbol
    h = "" if not a.hydrogens else "H" if a.hydrogens == 1 else f"H{a.hydrogens}"
    c = "" if not a.charge else ("+" if a.charge > 0 else "-") + (str(abs(a.charge)) if abs(a.charge) > 1 else "")
    return f"[{a.isotope or ''}{symbol}{turn}{h}{c}]"


def canonical_smiles(text: str | None, stereo: bool = True) -> str | None:
    """Canonical text, or None if ``text`` can't be read."""
    try:
        return canonical(parse(text), stereo)
    except (NoMolecule, RecursionError):
        return None


def group_labels(m: Molecule) -> list[int]:
    """Sorted labels of the R groups."""
    return sorted(a.label for a in m.atoms if a.symbol == "*")


def stereo_centres(m: Molecule) -> list[tuple[int, str]]:
    """(atom, turn as written against the classes) of real centres."""
    same = classes(m)
    return [(i, "+" if a.turn * _parity(a.order, same) > 0 else "-") for i, a in enumerate(m.atoms) if a.turn and _parity(a.order, same)]


def mirrored(m: Molecule) -> Molecule:
    """All tetrahedral centres turned round, in place."""
    for a in m.atoms:
        a.turn = -a.turn
    return m


def n_methylated(m: Molecule) -> Molecule | None:
    """A methyl on the first nitrogen with a hydrogen next to an R group, in place; None if there is none."""
    for i, a in enumerate(m.atoms):
        if a.symbol == "N" and a.hydrogens and any(m.atoms[j].symbol == "*" for j in m.bonds[i]):
            c = m.add(Atom("C", hydrogens=3))
            m.bond(i, c, 1)
            m.atoms[c].order.append(i)
            a.order.append(c)
            a.hydrogens -= 1
            return m
    return None


def scaffold(m: Molecule) -> str:
    """Ring systems and what links them (atoms double-bonded to them kept), without stereo; empty without rings."""
    keep = set(range(len(m.atoms)))
    degree = [len(n) for n in m.bonds]
    ends = [i for i in keep if degree[i] < 2]
    while ends:
        i = ends.pop()
        if i not in keep:
            continue
        keep.discard(i)
        for j in m.bonds[i]:
            if j in keep:
                degree[j] -= 1
                if degree[j] < 2:
                    ends.append(j)
    if not keep:
        return ""
    keep |= {j for i in keep for j, o in m.bonds[i].items() if o == 2 and len(m.bonds[j]) == 1}
    return canonical(m.without(set(range(len(m.atoms))) - keep), stereo=False)


def _digest(x) -> int:
    return int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "big")


def fingerprint(m: Molecule, radius: int = 2, bits: int = 2048) -> list[int]:
    """Sorted on-bits of the circular environments of every atom up to a radius."""
    in_ring = {i for r in rings(m) for i in r}
    ident = [_digest((a.symbol, a.charge, a.hydrogens, a.isotope, len(n), i in in_ring)) for i, (a, n) in enumerate(zip(m.atoms, m.bonds))]
    found = set(ident)
    for depth in range(1, radius + 1):
        ident = [_digest((depth, ident[i], sorted((o, ident[j]) for j, o in m.bonds[i].items()))) for i in range(len(ident))]
        found.update(ident)
    return sorted({x % bits for x in found})
