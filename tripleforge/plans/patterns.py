"""The nineteen entailment patterns as one declarative table."""

from __future__ import annotations

from dataclasses import dataclass

DOM, RAN, SP, SC, TY = "rdfs:domain", "rdfs:range", "rdfs:subPropertyOf", "rdfs:subClassOf", "rdf:type"
_SHORT = {"dom": DOM, "ran": RAN, "sp": SP, "sc": SC, "ty": TY}


@dataclass(frozen=True)
class Pattern:
    """Triples are of slots: a, b instances; i, j, k properties; x, y, z, w classes."""

    id: str
    premise: tuple[tuple[str, str, str], ...]
    conclusion: tuple[tuple[str, str, str], ...]
    balance: tuple[str, ...]  # slots by which a sample is balanced
    distinct: tuple[str, ...]  # groups of slots that differ in a source row
    swaps: tuple[str, ...]  # a local shuffle: two slots change places, three or more are deranged
    drawn_distinct: tuple[str, ...]  # groups of slots that differ in a randomly drawn row
    moved: tuple[str, ...] = ()  # pairs of slots that must differ for a local shuffle, where they are not the swaps

    @property
    def slots(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for s, p, o in self.premise for t in (s, p, o) if len(t) == 1))

    @property
    def terms(self) -> tuple[str, ...]:
        """Slots in the order of a row's terms: instances, properties, classes. A global shuffle deranges them in it."""
        return tuple(t for t in "abijkxyzw" if t in self.slots)

    @property
    def roles(self) -> tuple[str, ...]:
        """What each premise triple is: domain, range, subPropertyOf, subClassOf, type or instance."""
        return tuple("instance" if len(p) == 1 else p.split(":")[1] for _, p, _ in self.premise)

    @property
    def n_rules(self) -> int:
        return self.id.count("_") + 1


def _triples(text: str) -> tuple[tuple[str, str, str], ...]:
    out = []
    for t in text.split(";"):
        s, p, o = t.split()
        out.append((s, _SHORT.get(p, p), o))
    return tuple(out)


def _row(id_: str, premise: str, conclusion: str, balance: str, distinct: str, swaps: str, drawn: str, moved: str = "") -> Pattern:
    return Pattern(id_, _triples(premise), _triples(conclusion), tuple(balance), tuple(distinct.split()), tuple(swaps.split()), tuple(drawn.split()), tuple(moved.split()))


#: Patterns whose property hierarchy comes from another graph than their facts: i stands there by its equivalent, j and k by their labels.
LINKED = ("rdfs7", "rdfs3_7", "rdfs5_7", "rdfs2_3_7", "rdfs2_5_7", "rdfs3_5_7")

#: Premise; conclusion; balance slots; distinct groups of the source; local shuffle; distinct groups when drawn; pairs that a local shuffle must find different.
PATTERNS: dict[str, Pattern] = {
    p.id: p
    for p in (
        _row("rdfs2", "i dom x; a i b", "a ty x", "x", "ab", "ab", "ab"),
        _row("rdfs3", "i ran x; a i b", "b ty x", "x", "ab", "ab", "ab"),
        _row("rdfs5", "i sp j; j sp k", "i sp k", "k", "ijk", "ijk", "ijk"),
        _row("rdfs7", "i sp j; a i b", "a j b", "j", "ab", "ab ij", "ab ij"),
        _row("rdfs9", "x sc y; a ty x", "a ty y", "y", "xy", "xy", "xy"),
        _row("rdfs11", "x sc y; y sc z", "x sc z", "z", "xyz", "xyz", "xyz"),
        _row("rdfs2_3", "i dom x; i ran y; a i b", "a ty x; b ty y", "xy", "ab xy", "ab xy", "ab xy"),
        _row("rdfs2_7", "i dom x; i sp j; a i b", "a ty x; a j b", "jx", "ab ij", "ab ij", "ab"),
        _row("rdfs2_9", "i dom x; x sc y; a i b", "a ty x; a ty y", "y", "ab xy", "ab xy", "ab xy"),
        _row("rdfs3_7", "i ran x; i sp j; a i b", "b ty x; a j b", "j", "ab", "ab ij", "ab ij"),
        _row("rdfs3_9", "i ran x; x sc y; a i b", "b ty x; b ty y", "y", "ab xy", "ab xy", "ab xy"),
        _row("rdfs5_7", "i sp j; j sp k; a i b", "i sp k; a j b; a k b", "k", "ab", "ab ijk", "ab ijk"),
        _row("rdfs9_11", "x sc y; y sc z; a ty x", "a ty y; a ty z; x sc z", "z", "xyz", "xyz", "xyz"),
        _row("rdfs2_3_7", "i dom x; i ran y; i sp j; a i b", "a ty x; b ty y; a j b", "xy", "ab xy", "ab ij xy", "ab ij xy"),
        _row("rdfs2_3_9", "i dom x; i ran y; x sc z; y sc w; a i b", "a ty x; a ty z; b ty y; b ty w", "zw", "ab xyzw", "ab xw zy", "ab xyzw", "ab yw xz"),
        _row("rdfs2_5_7", "i dom x; i sp j; j sp k; a i b", "a ty x; i sp k; a j b; a k b", "k", "ab", "ab ijk", "ab ijk"),
        _row("rdfs2_9_11", "i dom x; x sc y; y sc z; a i b", "a ty x; a ty y; a ty z; x sc z", "z", "ab xyz", "ab xyz", "ab xyz"),
        _row("rdfs3_5_7", "i ran x; i sp j; j sp k; a i b", "b ty x; i sp k; a j b; a k b", "k", "ab", "ab ijk", "ab ijk"),
        _row("rdfs3_9_11", "i ran x; x sc y; y sc z; a i b", "b ty x; b ty y; b ty z; x sc z", "z", "ab xyz", "ab xyz", "ab xyz"),
    )
}


def chosen(text: str | None) -> list[Pattern]:
    """Patterns of a comma list; None, "", "all" and "*" mean all; an unknown one is an error; repeats count once."""
    if text is None or text.strip() in ("", "all", "*"):
        return list(PATTERNS.values())
    names = dict.fromkeys(n.strip() for n in text.split(",") if n.strip())
    if unknown := [n for n in names if n not in PATTERNS]:
        raise ValueError(f"unknown patterns: {', '.join(unknown)}")
    return [PATTERNS[n] for n in names]
