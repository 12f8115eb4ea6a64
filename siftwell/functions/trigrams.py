"""From a pattern tree to the trigrams that each match must hold.

The query is an OR of ANDs: one set of trigrams for each top-level branch.  A branch
without any makes the whole query no constraint.  Each rule keeps every match: a run of
literals is broken at all that is not literal, at line feeds, and around repetitions
that may differ in count.
"""

from __future__ import annotations

from .fold import fold_text
from .regex_ast import Alt, Concat, Group, Lit, Repeat


class _Runs:
    def __init__(self):
        self.done: list[str] = []
        self.now = ""

    def stop(self) -> None:
        if self.now:
            self.done.append(self.now)
        self.now = ""

    def add(self, node) -> None:
        if isinstance(node, Lit):
            if node.char == "\n":
                self.stop()
            else:
                self.now += node.char
        elif isinstance(node, Group):
            self.add(node.node)
        elif isinstance(node, Concat):
            for x in node.nodes:
                self.add(x)
        elif isinstance(node, Repeat) and node.low >= 1:
            copies = min(node.low, 64)
            for _ in range(copies):
                self.add(node.node)
            if node.high != node.low or copies < node.low:
                # what follows stands after the last of at least `low` copies
                self.stop()
                for _ in range(copies):
                    self.add(node.node)
        else:
            self.stop()


def literal_runs(node) -> list[str]:
    """Texts that every match of the node holds."""
    runs = _Runs()
    runs.add(node)
    runs.stop()
    return runs.done


def branches(node) -> list:
    while isinstance(node, Group) or isinstance(node, Concat) and len(node.nodes) == 1:
        node = node.node if isinstance(node, Group) else node.nodes[0]
    return list(node.nodes) if isinstance(node, Alt) else [node]


def trigram_query(node, folded: bool = False) -> list[list[str]]:
    """Sorted trigrams for each branch; [] if the pattern sets no constraint."""
    out = []
    for branch in branches(node):
        found: set[str] = set()
        for run in literal_runs(branch):
            run = fold_text(run) if folded else run
            found |= {run[i : i + 3] for i in range(len(run) - 2)}
        if not found:
            return []
        out.append(sorted(found))
    return out


def required_literal(node) -> str | None:
    """The longest text of three or more characters that every match holds."""
    if len(branches(node)) > 1:
        return None
    runs = [r for r in literal_runs(node) if len(r) >= 3]
    return max(runs, key=len) if runs else None
