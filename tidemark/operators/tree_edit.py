"""Minimum-cost edit scripts between nested schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

ADD, DELETE, RETYPE = 1.0, 1.0, 0.4
#: A rename costs from RENAME (names alike) to RENAME + NAME_WEIGHT (nothing in common): always less than delete + add.
RENAME, NAME_WEIGHT = 0.6, 0.3
#: A field that keeps name and kind but changes its parent, on top of nothing: less than delete + add, more than a rename.
MOVE = 1.2
#: More than any script costs: no single step.
NEVER = 1e6
#: Ways to match nested objects that are looked at.
WAYS = 2_000


@dataclass
class Node:
    """A field of a schema: its name, the kind of its values and its fields in turn."""

    name: str
    kind: str
    children: list["Node"] = field(default_factory=list)


@dataclass(frozen=True)
class Edit:
    """One step: ``op`` is added, removed, retyped, renamed or moved; paths are dotted, empty where they don't apply."""

    op: str
    old_path: str
    new_path: str
    kind: str


def schema_tree(fields: list[tuple[str, str]]) -> Node:
    """The tree of (dotted path, kind) pairs. A parent that isn't listed itself counts as an object."""
    root = Node("", "object")
    for path, kind in sorted(fields):
        at = root
        steps = path.split(".")
        for i, step in enumerate(steps):
            below = next((c for c in at.children if c.name == step), None)
            if below is None:
                below = Node(step, "object")
                at.children.append(below)
            if i == len(steps) - 1:
                below.kind = kind
            at = below
    return root


def assign(cost: list[list[float]]) -> list[int]:
    """The cheapest assignment of rows to columns of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for row in range(n):
        match[n] = row
        at, least, came, done = n, [float("inf")] * n, [n] * n, [False] * (n + 1)
        while match[at] != n or at == n:
            done[at] = True
            r, step, nxt = match[at], float("inf"), n
            for c in range(n):
                if not done[c]:
                    d = cost[r][c] - u[r] - v[c]
                    if d < least[c]:
                        least[c], came[c] = d, at
                    if least[c] < step:
                        step, nxt = least[c], c
            for c in range(n + 1):
                if done[c]:
                    u[match[c]] += step
                    v[c] -= step
                elif c < n:
                    least[c] -= step
            at = nxt
        while at != n:
            match[at] = match[came[at]]
            at = came[at]
    out = [0] * n
    for c in range(n):
        out[match[c]] = c
    return out


@lru_cache(maxsize=10_000)
def _likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower().replace("_", ""), b.lower().replace("_", "")).ratio()


@dataclass
class _Field:
    """A node of a tree in a list: its place, its parent's place (-1 for none), and its children by name."""

    node: Node
    path: str
    parent: int
    below: dict[str, int]


def _listed(root: Node) -> list[_Field]:
    """All nodes, parents before children, the root first."""
    out = [_Field(root, "", -1, {})]
    todo = [0]
    while todo:
        at = todo.pop()
        for c in out[at].node.children:
            out[at].below[c.name] = len(out)
            todo.append(len(out))
            out.append(_Field(c, f"{out[at].path}.{c.name}" if out[at].path else c.name, at, {}))
    return out


def pair_cost(old: Node, new: Node, parents_match: bool) -> float:
    """What it costs to turn one field into another; infinite where no single step does. Under matching parents a field may
    keep its name (and be retyped) or be renamed within its kind; under others it moves, with name and kind."""
    if old.name == new.name:
        return (0.0 if parents_match else MOVE) if old.kind == new.kind else (RETYPE if parents_match else NEVER)
    return RENAME + NAME_WEIGHT * (1 - _likeness(old.name, new.name)) if parents_match and old.kind == new.kind else NEVER


def _parents(olds: list[_Field], news: list[_Field], limit: int):
    """Ways to match the fields that hold others, roots with roots; a name that stays under matching parents stays itself.
    At most ``limit`` ways, those with the most names kept first."""
    inner = [i for i, f in enumerate(olds) if f.below and i]
    given = 0

    def extend(at: int, match: dict[int, int]):
        nonlocal given
        if given >= limit:
            return
        if at == len(inner):
            given += 1
            yield match
            return
        i = inner[at]
        f = olds[i]
        over = match.get(f.parent)
        stays = news[over].below.get(f.node.name) if over is not None else None
        if stays is not None:
            yield from extend(at + 1, match | {i: stays} if news[stays].below and stays not in match.values() else match)
            return
        used = set(match.values())
        able = [j for j, g in enumerate(news) if j and g.below and j not in used and pair_cost(f.node, g.node, over is not None and over == g.parent) < NEVER]
        for j in sorted(able, key=lambda j: pair_cost(f.node, news[j].node, over is not None and over == news[j].parent)):
            yield from extend(at + 1, match | {i: j})
        yield from extend(at + 1, match)

    yield from extend(0, {0: 0})


def _kept(olds: list[_Field], news: list[_Field], match: dict[int, int]) -> list[tuple[int, int]] | None:
    """The pairs that keep their name under matching parents; None where ``match`` goes against one of them."""
    back = {j: i for i, j in match.items()}
    out = []
    for i, j in match.items():
        for name, c in olds[i].below.items():
            d = news[j].below.get(name)
            if d is None:
                continue
            if match.get(c, d) != d or back.get(d, c) != c:
                return None
            if c not in match:
                if olds[c].below and news[d].below:
                    return None
                out.append((c, d))
    return out


def edit_script(old: Node, new: Node, limit: int = WAYS) -> tuple[float, list[Edit]]:
    """The cheapest script from ``old`` to ``new`` and its cost.

    Fields are unordered. A field that keeps its name under matching parents stays itself (retyped if its kind differs); of the
    others one may be renamed into another of its kind, at a cost that grows as the names differ, or move with name and kind to
    another parent; what remains is added or removed, one by one. All of it is weighed at once: for every way to match the
    fields that hold others, the rest are assigned to each other at least cost. Matching such trees at least cost is
    intractable in general, so at most ``limit`` ways are looked at, the likeliest first; a schema with few nested
    objects has far fewer, and its script is the cheapest there is. Of a field that is added or removed with all below it one
    step tells.
    """
    olds, news = _listed(old), _listed(new)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for match in _parents(olds, news, limit):
        kept = _kept(olds, news, match)
        if kept is None:
            continue
        pairs = [*match.items(), *kept]
        over = lambda i, j: match.get(olds[i].parent) == news[j].parent
        total = sum(pair_cost(olds[i].node, news[j].node, over(i, j)) for i, j in pairs if i)
        gone = [i for i in range(1, len(olds)) if i not in {p[0] for p in pairs}]
        come = [j for j in range(1, len(news)) if j not in {p[1] for p in pairs}]
        if total >= NEVER or (best and total + abs(len(gone) - len(come)) >= best[0]):
            continue
        n = len(gone) + len(come)
        table = [[0.0] * n for _ in range(n)]
        for r in range(n):
            for c in range(n):
                if r < len(gone) and c < len(come):
                    both_hold = olds[gone[r]].below and news[come[c]].below  # such pairs are another way
                    table[r][c] = NEVER if both_hold else pair_cost(olds[gone[r]].node, news[come[c]].node, over(gone[r], come[c]))
                elif r < len(gone):
                    table[r][c] = DELETE
                elif c < len(come):
                    table[r][c] = ADD
        for r, c in enumerate(assign(table)) if n else ():
            total += table[r][c]
            if r < len(gone) and c < len(come):
                pairs.append((gone[r], come[c]))
        if best is None or total < best[0] - 1e-9:
            best = total, pairs
    total, pairs = best
    to, back = dict(pairs), {j: i for i, j in pairs}
    script = []
    for i, j in pairs:
        a, b = olds[i], news[j]
        if i and a.node.name != b.node.name:
            script.append(Edit("renamed", a.path, b.path, b.node.kind))
        elif i and to.get(a.parent) != b.parent:
            script.append(Edit("moved", a.path, b.path, b.node.kind))
        elif i and a.node.kind != b.node.kind:
            script.append(Edit("retyped", a.path, b.path, b.node.kind))
    script += [Edit("removed", f.path, "", f.node.kind) for i, f in enumerate(olds) if i not in to and f.parent in to]
    script += [Edit("added", "", f.path, f.node.kind) for j, f in enumerate(news) if j not in back and f.parent in back]
    return total, sorted(script, key=lambda e: (e.op, e.old_path, e.new_path))
