"""Top-down edit distance of ordered labelled trees.

A node pair costs the cheaper of replacing the whole subtree and of renaming the root plus the best ordered
alignment of the children, where a skipped child costs its whole subtree. Equal subtrees cost nothing and are
recognised by hash, so twins with one change touch only the path to it. A budget bounds every alignment within.
"""

from __future__ import annotations

from collections import Counter

# Kinds whose labels are names, and built-in names whose exchange changes what code does.
_NAME_KINDS = {"Identifier", "BindingIdentifier", "PrivateIdentifier", "Parameter"}
_BUILTINS = set(
    "map filter forEach reduce reduceRight some every find findIndex findLast findLastIndex flatMap push pop shift unshift slice splice concat join reverse sort "
    "includes indexOf lastIndexOf keys values entries min max floor ceil round trunc abs parse stringify toUpperCase toLowerCase trim trimStart trimEnd "
    "startsWith endsWith padStart padEnd get set has delete add".split()
)
BEYOND = -1.0


class Flat:
    """A tree as arrays in preorder."""

    def __init__(self, labels: list[str], kinds: list[str], kids: list[int]):
        n = len(labels)
        self.labels, self.kinds = labels, kinds
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.size = [1] * n
        stack: list[tuple[int, int]] = []  # node, children still to come
        for i in range(n):
            while stack and stack[-1][1] == 0:
                stack.pop()
            if stack:
                parent, left = stack[-1]
                self.children[parent].append(i)
                stack[-1] = (parent, left - 1)
            stack.append((i, int(kids[i])))
        self.key: list = [None] * n
        for i in range(n - 1, -1, -1):
            self.size[i] += sum(self.size[c] for c in self.children[i])
            self.key[i] = hash((labels[i], kinds[i], tuple(self.key[c] for c in self.children[i])))


def rename_cost(label1: str, kind1: str, label2: str, kind2: str, rename: float = 0.3, replace: float = 2.0, flat: bool = False) -> float:
    """Cost of turning one node into another: a name 0.3, another label 0.6, another kind 0.9, never a full replacement."""
    if label1 == label2 and kind1 == kind2:
        return 0.0
    if flat:
        return rename
    cap = 0.99 * replace
    if kind1 != kind2:
        return min(3 * rename, cap)
    if kind1 in _NAME_KINDS:
        return cap if label1 in _BUILTINS and label2 in _BUILTINS else rename
    return min(2 * rename, cap)


def lower_bound(a: Flat, b: Flat) -> float:
    """A distance no pair can stay below: the size gap, and 0.3 for every label the larger tree has alone."""
    gap = abs(a.size[0] - b.size[0]) if a.labels and b.labels else 0
    x, y = Counter(zip(a.labels, a.kinds)), Counter(zip(b.labels, b.kinds))
    return max(gap, 0.3 * (max(len(a.labels), len(b.labels)) - sum((x & y).values())))


def distance(a: Flat, b: Flat, budget: float | None = None, delete: float = 1.0, insert: float = 1.0, rename: float = 0.3, flat: bool = False) -> float:
    """Edit distance, or ``BEYOND`` if it exceeds the budget."""
    if not a.labels or not b.labels:
        d = delete * len(a.labels) + insert * len(b.labels)
        return d if budget is None or d <= budget else BEYOND
    if budget is not None and delete >= 1 and insert >= 1 and rename >= 0.3 and not flat and lower_bound(a, b) > budget:
        return BEYOND
    memo: dict[tuple[int, int], tuple[float, bool]] = {}
    swap = delete + insert
    slack = 1e-9

    def pair(i: int, j: int, limit: float) -> float:
        """The cost if it is at most ``limit``, else a bound above the limit: what exceeds it is not worked out."""
        if a.key[i] == b.key[j]:
            return 0.0
        known = memo.get((i, j))
        if known is not None and (known[1] or known[0] > limit):
            return known[0]
        gap = a.size[i] - b.size[j]
        gap = gap * delete if gap > 0 else -gap * insert
        if gap > limit:
            return gap
        cost = rename_cost(a.labels[i], a.kinds[i], b.labels[j], b.kinds[j], rename, swap, flat)
        exact = True
        p, q = a.children[i], b.children[j]
        if p or q:
            whole = delete * a.size[i] + insert * b.size[j]
            most = min(limit, whole) - cost + slack  # a dearer alignment decides nothing
            row = [0.0]
            for y in q:
                row.append(row[-1] + insert * b.size[y])
            least = row[0]
            for x in p:
                gone, diagonal = delete * a.size[x], row[0]
                row[0] += gone
                for k, y in enumerate(q, 1):
                    best = min(row[k] + gone, row[k - 1] + insert * b.size[y])
                    room = min(best, most) - diagonal
                    if room > 0:
                        best = min(best, diagonal + pair(x, y, room))
                    diagonal, row[k] = row[k], best
                least = min(row)
                if least > most:
                    break
            aligned = max(row[-1], least)
            exact = aligned <= most or whole <= limit
            cost = min(cost + aligned, whole)
        memo[i, j] = cost, exact
        return cost

    d = pair(0, 0, float("inf") if budget is None else budget)
    return d if budget is None or d <= budget else BEYOND
