"""Labelled graphs as columns: regions that can vary, keys of what stays fixed, and exact embeddings.

A graph is two columns: atoms (an array of labels) and bonds (an array of structs a, b, kind). Regions are
proposed by ``cut_keys`` and blocked by the key of their fixed background, which is equal for equal
backgrounds; ``verified`` then embeds the background exactly, so unequal ones with one key do no harm.
Each graph is small and is worked on alone, row by row in batches; pairs come from joins on keys.
"""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Atoms of a graph that is looked at; larger ones are ineligible. Partial mappings that one search may try.
MOST_ATOMS, MOST_STATES = 512, 100_000

Bond = tuple[int, int, str]


class Graph:
    """Labels, and for each atom its neighbours with the bond's number and kind."""

    def __init__(self, atoms, bonds):
        self.labels = list(atoms if atoms is not None else ())
        self.bonds: list[Bond] = [(int(b["a"]), int(b["b"]), b["kind"]) for b in (bonds if bonds is not None else ())]
        self.near: list[dict[int, tuple[int, str]]] = [{} for _ in self.labels]
        n = len(self.labels)
        self.valid = 0 < n <= MOST_ATOMS and all(0 <= a < n and 0 <= b < n and a != b for a, b, _ in self.bonds)
        for k, (a, b, kind) in enumerate(self.bonds if self.valid else ()):
            self.near[a][b] = (k, kind)
            self.near[b][a] = (k, kind)

    def reached(self, start: int, without: frozenset[int]) -> frozenset[int]:
        """Atoms that paths from start reach without some of the bonds."""
        found, todo = {start}, [start]
        while todo:
            for other, (k, _) in self.near[todo.pop()].items():
                if other not in found and k not in without:
                    found.add(other)
                    todo.append(other)
        return frozenset(found)

    def edges(self) -> dict[int, tuple[int, int]]:
        """The bonds by number, of several between two atoms the last one."""
        return {k: (a, b) for a, near in enumerate(self.near) for b, (k, _) in near.items() if a < b}


def labelled_bonds(graph: Graph, edges: dict[int, tuple[int, int]]) -> dict[int, int]:
    """A number for each bond so that a set of bonds is the whole boundary of some atoms just where its numbers cancel out (exclusive or).

    Bonds outside a spanning forest get 64 random bits; a bond of the forest that of all bonds which close a cycle over
    it. So a bridge has zero, and two bonds that only together hold parts in one piece have one number.
    """
    r = random.Random(len(edges))
    parent: dict[int, tuple[int, int] | None] = {}
    order, value, label = [], [0] * len(graph.near), {}
    for root in range(len(graph.near)):
        if root in parent:
            continue
        parent[root] = None
        stack = [root]
        while stack:
            atom = stack.pop()
            order.append(atom)
            for other, (k, _) in graph.near[atom].items():
                if other not in parent:
                    parent[other] = (atom, k)
                    stack.append(other)
    forest = {at[1] for at in parent.values() if at}
    for k, (a, b) in edges.items():
        if k not in forest:
            label[k] = r.getrandbits(64) | 1 << 64
            value[a] ^= label[k]
            value[b] ^= label[k]
    for atom in reversed(order):
        if parent[atom]:
            above, k = parent[atom]
            label[k] = value[atom]
            value[above] ^= value[atom]
    return label


def pieces(graph: Graph, without: set[int] | frozenset[int]) -> list[int]:
    """For each atom the atoms, as bits, that paths without some bonds join it with."""
    mask = [0] * len(graph.near)
    for root in range(len(mask)):
        if mask[root]:
            continue
        found, todo = [root], [root]
        mask[root] = 1
        while todo:
            for other, (k, _) in graph.near[todo.pop()].items():
                if not mask[other] and k not in without:
                    mask[other] = 1
                    found.append(other)
                    todo.append(other)
        whole = sum(1 << k for k in found)
        for k in found:
            mask[k] = whole
    return mask


def regions(graph: Graph, most_bonds: int = 3, most_atoms: int | None = None) -> dict[frozenset[int], frozenset[int]]:
    """Connected regions, of at most so many atoms, that at most so many bonds (three or fewer) join to the rest, with these bonds.

    They come from the structure of small cuts, and no set of bonds is tried in vain: bridges form a tree whose parts are grown together
    (``tree_regions``), bonds of one label lie on a ring of parts (``ring_regions``), and three labels that cancel out are the arms between two hubs (``hub_regions``).
    """
    if not 1 <= most_bonds <= 3:
        raise ValueError("one to three bonds")
    limit = len(graph.labels) if most_atoms is None else most_atoms
    edges = graph.edges()
    label = labelled_bonds(graph, edges)
    classes = defaultdict(list)
    for k, value in sorted(label.items()):
        classes[value].append(k)
    bridges = classes.pop(0, [])
    found: dict[int, tuple[int, ...]] = {}
    sides = tree_regions(graph, edges, bridges, most_bonds, limit, found)
    if most_bonds > 1:
        for bonds in classes.values():
            if len(bonds) > 1:
                ring_regions(graph, edges, bonds, sides if most_bonds > 2 else {}, limit, found)
    if most_bonds > 2:
        values = sorted(classes)
        for i, x in enumerate(values):
            for y in values[i + 1 :]:
                if x ^ y > y and x ^ y in classes:
                    hub_regions(graph, edges, [classes[x], classes[y], classes[x ^ y]], limit, found)
    return {frozenset(atoms_of(mask)): frozenset(cut) for mask, cut in found.items()}


def atoms_of(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def tree_regions(graph: Graph, edges: dict, bridges: list[int], most_bonds: int, limit: int, found: dict[int, tuple[int, ...]]) -> dict[int, tuple[int, int]]:
    """Add the regions that bridges alone bound; gives each bridge's two sides.

    A part below a bridge is given with each choice of bridges that are cut further down; parts join upwards while they hold few enough atoms.
    """
    mask = pieces(graph, set(bridges))
    touching = defaultdict(list)
    for k in bridges:
        a, b = edges[k]
        touching[mask[a]].append((k, mask[b]))
        touching[mask[b]].append((k, mask[a]))
    sides: dict[int, tuple[int, int]] = {}
    seen: set[int] = set()
    for root in touching:
        if root in seen:
            continue
        order, up = [], {root: (None, None)}
        stack = [root]
        while stack:
            part = stack.pop()
            order.append(part)
            for k, other in touching[part]:
                if k != up[part][0]:
                    up[other] = (k, part)
                    stack.append(other)
        seen |= set(order)
        below = {}
        for part in reversed(order):
            below[part] = part
            for k, other in touching[part]:
                if k != up[part][0]:
                    below[part] |= below[other]
        whole = below[root]
        grown: dict[int, list[list[tuple[int, tuple[int, ...]]]]] = {}
        for part in reversed(order):
            above = (whole ^ below[part]).bit_count()
            now = [[(part, ())] if part.bit_count() <= limit else []] + [[] for _ in range(most_bonds)]
            for k, other in touching[part]:
                if k == up[part][0]:
                    continue
                joined: list[list] = [[] for _ in now]
                for j, own in enumerate(now):
                    for m, cut in own:
                        if j < most_bonds:
                            joined[j + 1].append((m, (*cut, k)))
                        for i in range(most_bonds + 1 - j):
                            for x, more in grown[other][i]:
                                if (m | x).bit_count() <= limit:
                                    joined[i + j].append((m | x, cut + more))
                now = joined
            k = up[part][0]
            if k is not None:
                sides[k] = (below[part], whole ^ below[part])
                for own in now[:most_bonds]:
                    found.update((m, (*cut, k)) for m, cut in own)
                # without another bridge to cut, all above would belong to it
                now[most_bonds] = [x for x in now[most_bonds] if x[0].bit_count() + above <= limit]
            else:
                for own in now[1:]:
                    found.update(own)
            grown[part] = now
    return sides


def ring_regions(graph: Graph, edges: dict, bonds: list[int], sides: dict[int, tuple[int, int]], limit: int, found: dict[int, tuple[int, ...]]) -> None:
    """Add the regions between two bonds of one label, and those without what hangs there on a bridge (with its sides)."""
    mask = pieces(graph, set(bonds))
    next_to = defaultdict(list)
    for k in bonds:
        for a, b in (edges[k], edges[k][::-1]):
            next_to[mask[a]].append((k, mask[b]))
    start = mask[edges[bonds[0]][0]]
    ring, cuts, part, came = [start], [], start, None
    while True:
        k, part = next((k, other) for k, other in next_to[part] if k != came)
        cuts.append(k)  # between ring[-1] and part
        came = k
        if len(cuts) == len(bonds):
            break
        ring.append(part)
    n, sizes = len(ring), [p.bit_count() for p in ring]
    for i in range(n):
        m = size = 0
        for length in range(1, n):
            at = (i + length - 1) % n
            m, size = m | ring[at], size + sizes[at]
            if size > limit:
                break
            found[m] = (cuts[i - 1], cuts[at])
    place = {part: k for k, part in enumerate(ring)}
    for k, both in sides.items():
        a = edges[k][0]
        if mask[a] not in place:  # another molecule
            continue
        i = place[mask[a]]
        gone = next((s for s in both if not s & ring[i - 1] and not s & ring[(i + 1) % n] and s & ~ring[i] == 0), None) if n > 1 else None
        if gone is None:
            continue
        own, most = ring[i] ^ gone, limit - sizes[i] + gone.bit_count()
        left = right = 0
        m, used = own, 0
        for left in range(n - 1):
            if left:
                m, used = m | ring[i - left], used + sizes[i - left]
            if used > most:
                break
            w, size = m, used
            for right in range(n - 1 - left):
                if right:
                    w, size = w | ring[(i + right) % n], size + sizes[(i + right) % n]
                if size > most:
                    break
                found[w] = (cuts[(i - left - 1) % n], cuts[(i + right) % n], k)


def hub_regions(graph: Graph, edges: dict, arms: list[list[int]], limit: int, found: dict[int, tuple[int, ...]]) -> None:
    """Add the regions that hold one hub and a beginning of each of the three arms between it and the other hub."""
    mask = pieces(graph, {k for arm in arms for k in arm})
    next_to = defaultdict(lambda: [[], [], []])
    for n, arm in enumerate(arms):
        for k in arm:
            for a, b in (edges[k], edges[k][::-1]):
                next_to[mask[a]][n].append((k, mask[b]))
    for hub in (h for h, bonds in next_to.items() if all(len(x) == 1 for x in bonds)):
        if hub.bit_count() > limit:
            continue
        ways = []
        for n in range(3):
            way, m, part, came = [], 0, hub, None
            while True:
                k, other = next((k, other) for k, other in next_to[part][n] if k != came)
                way.append((m, m.bit_count(), k))
                if len(next_to[other][n]) < 2 or m.bit_count() > limit:
                    break
                m, part, came = m | other, other, k
            ways.append(way)
        own = hub.bit_count()
        for x, nx, i in ways[0]:
            if own + nx > limit:
                break
            for y, ny, j in ways[1]:
                if own + nx + ny > limit:
                    break
                for z, nz, k in ways[2]:
                    if own + nx + ny + nz > limit:
                        break
                    found[hub | x | y | z] = (i, j, k)


def background_key(graph: Graph, variable: frozenset[int]) -> str:
    """A digest of the fixed atoms by refined colours: label, bonds to the region, and the colours around, again and again."""
    fixed = [k for k in range(len(graph.labels)) if k not in variable]
    of = lambda *x: hashlib.blake2b(repr(x).encode(), digest_size=12).hexdigest()
    ports = lambda k: sorted(kind for other, (_, kind) in graph.near[k].items() if other in variable)
    colour = {k: of(graph.labels[k], ports(k)) for k in fixed}
    classes = 0
    while len(set(colour.values())) > classes:
        classes = len(set(colour.values()))
        colour = {k: of(colour[k], sorted((kind, colour[other]) for other, (_, kind) in graph.near[k].items() if other in colour)) for k in fixed}
    return of(sorted(colour.values()))


def cut_keys(rows: DataFrame, identity: str, atoms: str, bonds: str, least_fixed: int = 6, most_variable: int = 32, share: float = 0.4, most_bonds: int = 3, hydrogens: str | None = None, single: str = "-") -> DataFrame:
    """(identity, key, variable, site): each region that may vary, as atom numbers, under the key of its background.

    A region holds at most most_variable atoms and that share of all, and leaves least_fixed at least. With ``hydrogens``, a column
    of each atom's number of hydrogens, which are no atoms of the graph, one of them may vary too: its region is the atom number
    behind the last one, as ``with_hydrogen`` writes it, and the atom that it sits on is the row's site (else null).
    """
    kind = rows.schema[identity].dataType.simpleString()

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for own, a, b, h in zip(pdf[identity], pdf[atoms], pdf[bonds], pdf[hydrogens] if hydrogens else repeat(None)):
                graph = Graph(a, b)
                if graph.valid and h is not None and len(h) == len(graph.labels) >= least_fixed:
                    for site in (k for k, count in enumerate(h) if count and graph.labels[k] != "H"):
                        more = Graph([*graph.labels, "H"], [*({"a": x, "b": y, "kind": kind} for x, y, kind in graph.bonds), {"a": site, "b": len(graph.labels), "kind": single}])
                        out.append((own, background_key(more, frozenset([len(graph.labels)])), [len(graph.labels)], site))
                n = len(graph.labels)
                most = min(most_variable, int(share * n), n - least_fixed)
                for side in regions(graph, most_bonds, most) if graph.valid and most > 0 else ():
                    out.append((own, background_key(graph, side), sorted(side), None))
            yield pd.DataFrame(out, columns=[identity, "key", "variable", "site"]).astype({"site": "Int32"})

    return rows.select(identity, atoms, bonds, *([hydrogens] if hydrogens else [])).mapInPandas(emit, f"{identity} {kind}, key string, variable array<int>, site int")


def with_hydrogen(atoms: Column, bonds: Column, site: Column, single: str = "-") -> tuple[Column, Column]:
    """atoms and bonds with one hydrogen of an atom as an atom of its own, the last."""
    bond = F.struct(site.cast("int").alias("a"), F.size(atoms).alias("b"), F.lit(single).alias("kind"))
    return F.concat(atoms, F.array(F.lit("H"))), F.concat(bonds, F.array(bond))


def embeddings(pattern: Graph, atoms: list[int], host: Graph, exact: set[int]) -> Iterator[dict[int, int]]:
    """Mappings of the pattern's atoms into the host that keep labels, bonds and their absence; exact atoms keep their degree too.

    Raises OverflowError beyond MOST_STATES partial mappings.
    """
    order: list[int] = []
    left = set(atoms)
    while left:  # next to what is placed, rarest label first
        counts = defaultdict(int)
        for label in host.labels:
            counts[label] += 1
        touching = [k for k in left if any(o in pattern.near[k] for o in order)] or list(left)
        order.append(min(touching, key=lambda k: (counts[pattern.labels[k]], -len(pattern.near[k]), k)))
        left.discard(order[-1])
    tried = 0
    stack: list[dict[int, int]] = [{}]
    while stack:
        done = stack.pop()
        if len(done) == len(order):
            yield done
            continue
        k = order[len(done)]
        placed = [(o, done[o]) for o in order[: len(done)]]
        anchors = [at for o, at in placed if o in pattern.near[k]]
        used = set(done.values())
        for at in sorted(host.near[anchors[0]]) if anchors else range(len(host.labels)):
            tried += 1
            if tried > MOST_STATES:
                raise OverflowError("too many partial mappings")
            if at in used or host.labels[at] != pattern.labels[k] or (k in exact and len(host.near[at]) != len(pattern.near[k])):
                continue
            if all(pattern.near[k].get(o, (0, None))[1] == host.near[at].get(there, (0, None))[1] for o, there in placed):
                stack.append(done | {k: at})


def compared(reference: Graph, variable: frozenset[int], candidate: Graph) -> str:
    """matched, not_matched, ambiguous or ineligible: the reference's background in the candidate, all else in one piece.

    Mappings that differ only away from the region's anchors are one; several sets of anchors are ambiguous.
    """
    if not reference.valid or not candidate.valid or not variable or not all(0 <= k < len(reference.labels) for k in variable):
        return "ineligible"
    fixed = [k for k in range(len(reference.labels)) if k not in variable]
    anchors = [k for k in fixed if any(o in variable for o in reference.near[k])]
    if not fixed or len(candidate.labels) <= len(fixed):
        return "not_matched"
    found: set[tuple] = set()
    try:
        for mapping in embeddings(reference, fixed, candidate, set(fixed) - set(anchors)):
            rest = set(range(len(candidate.labels))) - set(mapping.values())
            inner = frozenset(k for k, (a, b, _) in enumerate(candidate.bonds) if (a in rest) != (b in rest))
            if candidate.reached(min(rest), inner) == rest:
                found.add(tuple(mapping[k] for k in anchors))
    except OverflowError:
        return "ambiguous"
    return "not_matched" if not found else "matched" if len(found) == 1 else "ambiguous"


def verified(reference: tuple[Column, Column, Column], candidate: tuple[Column, Column]) -> Column:
    """The result of ``compared`` for pair rows: reference atoms, bonds and variable atoms; candidate atoms and bonds."""

    @F.pandas_udf("string")
    def check(ra: pd.Series, rb: pd.Series, v: pd.Series, ca: pd.Series, cb: pd.Series) -> pd.Series:
        return pd.Series([compared(Graph(a, b), frozenset(int(k) for k in (x if x is not None else ())), Graph(c, d)) for a, b, x, c, d in zip(ra, rb, v, ca, cb)], dtype=object)

    return check(*reference, *candidate)


def has_core(core: Graph, atoms: Column, bonds: Column) -> Column:
    """Whether a confirmed core lies anywhere in a graph; null where the search is too large or the graph invalid."""
    own = list(range(len(core.labels)))

    def inside(a, b) -> bool | None:
        host = Graph(a, b)
        try:
            return any(True for _ in embeddings(core, own, host, set())) if host.valid else None
        except OverflowError:
            return None

    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([inside(x, y) for x, y in zip(a, b)], dtype="boolean")

    return check(atoms, bonds)
