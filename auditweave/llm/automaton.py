"""Regular expressions to minimised byte automata: Thompson construction, subset construction, refinement."""

from __future__ import annotations

import re._constants as C
import re._parser as sre
from collections import defaultdict

import numpy as np


def _class(items, ignore_case: bool) -> frozenset[int]:
    out, negate = set(), False
    for op, arg in items:
        if op is C.NEGATE:
            negate = True
        elif op is C.LITERAL:
            out.add(arg)
        elif op is C.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"class item {op} is not supported")
    return frozenset(_folded(out, ignore_case) if not negate else set(range(256)) - _folded(out, ignore_case))


def _folded(chars: set[int], ignore_case: bool) -> set[int]:
    if any(c > 127 for c in chars):
        raise ValueError("rules are written in ASCII")
    if not ignore_case:
        return set(chars)
    return {x for c in chars for x in (ord(chr(c).lower()), ord(chr(c).upper()))}


class Nfa:
    """Epsilon transitions, byte-set transitions, and the rule that a state accepts."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.eps.append([])
        self.step.append([])
        return len(self.eps) - 1

    def build(self, tree, at: int, ignore_case: bool, backward: bool) -> int:
        """Add `tree` after state `at`; return its end. backward: the reversed language."""
        for op, arg in reversed(list(tree)) if backward else tree:
            if op in (C.LITERAL, C.IN):
                end = self.state()
                chars = frozenset(_folded({arg}, ignore_case)) if op is C.LITERAL else _class(arg, ignore_case)
                self.step[at].append((chars, end))
                at = end
            elif op is C.SUBPATTERN:
                _, add, _, inner = arg
                at = self.build(inner, at, ignore_case or bool(add & C.SRE_FLAG_IGNORECASE), backward)
            elif op is C.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    start = self.state()
                    self.eps[at].append(start)
                    self.eps[self.build(inner, start, ignore_case, backward)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.build(inner, at, ignore_case, backward)
                end = self.state()
                self.eps[at].append(end)
                if high is C.MAXREPEAT:
                    loop = self.build(inner, at, ignore_case, backward)
                    self.eps[loop].extend((at, end))
                else:
                    for _ in range(high - low):
                        at = self.build(inner, at, ignore_case, backward)
                        self.eps[at].append(end)
                at = end
            else:
                raise ValueError(f"{op} is not supported in a rule")
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Dfa:
    """`classes`: byte to class; `next`: states x classes; `rules`: bit set of the rules that a state accepts.

    State 0 starts. Accepting states have the highest numbers, from `first_accepting` on; `dead` is the
    state that nothing leaves (-1 if there is none).
    """

    def __init__(self, classes: np.ndarray, nxt: np.ndarray, rules: np.ndarray) -> None:
        order = np.argsort(rules > 0, kind="stable")
        zero = int(np.flatnonzero(order == 0)[0])
        order = np.concatenate(([0], np.delete(order, zero))) if rules[0] == 0 else order
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.classes, self.next, self.rules = classes, place[nxt[order]].astype(np.int32), rules[order]
        self.start = int(place[0])
        self.first_accepting = int((self.rules == 0).sum())
        loops = [s for s in range(self.first_accepting) if (self.next[s] == s).all()]
        self.dead = loops[0] if loops else -1


def compile_rules(patterns: list[str], unanchored: bool, backward: bool = False) -> Dfa:
    """One minimised automaton for all patterns; unanchored: a match may start at any byte."""
    nfa = Nfa()
    root = nfa.state()
    for rule, pattern in enumerate(patterns):
        parsed = sre.parse(pattern)
        start = nfa.state()
        nfa.eps[root].append(start)
        end = nfa.build(parsed, start, bool(parsed.state.flags & C.SRE_FLAG_IGNORECASE), backward)
        nfa.accept[end] = rule
    sets = {chars for row in nfa.step for chars, _ in row}
    signature = defaultdict(list)
    for b in range(256):
        signature[tuple(b in chars for chars in sorted(sets, key=sorted))].append(b)
    classes, members = np.zeros(256, np.uint8), []
    for k, group in enumerate(signature.values()):
        classes[group] = k
        members.append(group[0])
    base = nfa.closure([root])
    index, rows, todo = {base: 0}, [], [base]
    for states in todo:
        row = []
        for b in members:
            to = nfa.closure([t for s in states for chars, t in nfa.step[s] if b in chars])
            to = to | base if unanchored else to
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        rows.append(row)
    nxt = np.array(rows, np.int32)
    bits = lambda states: sum({1 << nfa.accept[s] for s in states if s in nfa.accept})
    rules = np.array([bits(s) for s in todo], np.int64)
    return Dfa(classes, *_minimised(nxt, rules))


def _minimised(nxt: np.ndarray, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refine the partition by accepted rules until a block's states agree on the block of every successor."""
    _, block = np.unique(rules, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack((block, block[nxt])), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)  # the start state's block comes first
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    keep = first[order]
    return place[block[nxt[keep]]], rules[keep]
