"""A generalised LL recogniser over transition networks, with a graph-structured stack.

A grammar is text: ``rule: alternatives ;`` with ``| ( ) ? * +``, 'literals', TOKEN classes (upper case),
rules (lower case) and ``@PREDICATES`` that look at the input without taking any of it. Each rule
becomes a network of states; where the next token leaves one way open the recogniser walks on, where
it leaves several it forks. A stack node stands for (rule, position): calls from several places share
it, ends found once are handed to every caller, so ambiguity and left recursion cost polynomial time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

TAKE, CALL, CHOOSE, END, LOOK = range(5)
PIECE = re.compile(r"\s*(?:#[^\n]*\n\s*)*('(?:[^'\\]|\\.)+'|@?[A-Za-z_][A-Za-z_0-9]*|[:;|()?*+])")


class Grammar:
    def __init__(self, text: str, predicates: dict[str, Callable] | None = None):
        self.terms: dict[str, int] = {}
        self.rules: dict[str, int] = {}
        self.kind: list[int] = []
        self.arg: list = []
        self.next: list[int] = []
        self.options: list[list[int]] = []
        self.owner: list[int] = []
        self.predicates = predicates or {}
        pieces, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = PIECE.match(text, at)
            if not m:
                raise ValueError("grammar: " + text[at : at + 40])
            pieces.append(m.group(1))
            at = m.end()
        names = [pieces[i] for i in range(len(pieces) - 1) if pieces[i + 1] == ":"]
        for n in names:
            self.rules[n] = len(self.rules)
        self.start = [0] * len(self.rules)
        at = 0
        while at < len(pieces):
            self._rule = self.rules[pieces[at]]
            end = self._state(END)
            first, at = self._alternatives(pieces, at + 2, end)
            if pieces[at] != ";":
                raise ValueError("grammar: ; expected near " + " ".join(pieces[at - 5 : at + 3]))
            self.start[self._rule] = first
            at += 1
        self._prepare()

    def _state(self, kind: int, arg=None, after: int = -1) -> int:
        self.kind.append(kind)
        self.arg.append(arg)
        self.next.append(after)
        self.options.append([])
        self.owner.append(self._rule)
        return len(self.kind) - 1

    def _alternatives(self, p: list[str], at: int, after: int) -> tuple[int, int]:
        found = []
        while True:
            items, at = self._sequence(p, at)
            found.append(self._chain(items, after))
            if p[at] != "|":
                break
            at += 1
        if len(found) == 1:
            return found[0], at
        s = self._state(CHOOSE)
        self.options[s] = found
        return s, at

    def _sequence(self, p: list[str], at: int) -> tuple[list, int]:
        items = []
        while p[at] not in (";", "|", ")"):
            if p[at] == "(":
                begin = at
                depth = 0
                while True:
                    depth += (p[at] == "(") - (p[at] == ")")
                    at += 1
                    if not depth:
                        break
                item = ("group", begin + 1)
            else:
                item = ("one", p[at])
                at += 1
            mark = ""
            if p[at] in ("?", "*", "+"):
                mark = p[at]
                at += 1
            items.append((item, mark, p))
        return items, at

    def _chain(self, items: list, after: int) -> int:
        for item, mark, p in reversed(items):
            if mark == "":
                after = self._one(item, p, after)
            elif mark == "?":
                s = self._state(CHOOSE)
                self.options[s] = [self._one(item, p, after), after]
                after = s
            else:
                s = self._state(CHOOSE)
                body = self._one(item, p, s)
                self.options[s] = [body, after]
                after = s if mark == "*" else body
        return after

    def _one(self, item: tuple, p: list[str], after: int) -> int:
        if item[0] == "group":
            return self._alternatives(p, item[1], after)[0]
        w = item[1]
        if w[0] == "'":
            return self._state(TAKE, self.term(w[1:-1].replace("\\'", "'").replace("\\\\", "\\")), after)
        if w[0] == "@":
            return self._state(LOOK, self.predicates[w[1:]], after)
        if w in self.rules:
            return self._state(CALL, self.rules[w], after)
        if w.isupper():
            return self._state(TAKE, self.term(w), after)
        raise ValueError("grammar: no rule " + w)

    def term(self, name: str) -> int:
        return self.terms.setdefault(name, len(self.terms))

    def _prepare(self) -> None:
        n, r = len(self.kind), len(self.rules)
        first: list[set[int]] = [set() for _ in range(n)]
        null = [self.kind[s] == END for s in range(n)]
        changed = True
        while changed:
            changed = False
            for s in range(n):
                f, e = set(first[s]), null[s]
                k = self.kind[s]
                if k == TAKE:
                    f.add(self.arg[s])
                elif k == CALL:
                    b = self.start[self.arg[s]]
                    f |= first[b]
                    if null[b]:
                        f |= first[self.next[s]]
                        e = e or null[self.next[s]]
                elif k == LOOK:
                    f |= first[self.next[s]]
                    e = e or null[self.next[s]]
                elif k == CHOOSE:
                    for o in self.options[s]:
                        f |= first[o]
                        e = e or null[o]
                if f != first[s] or e != null[s]:
                    first[s], null[s], changed = f, e, True
        follow: list[set[int]] = [set() for _ in range(r)]
        changed = True
        while changed:
            changed = False
            for s in range(n):
                if self.kind[s] == CALL:
                    f = set(first[self.next[s]])
                    if null[self.next[s]]:
                        f |= follow[self.owner[s]]
                    if not f <= follow[self.arg[s]]:
                        follow[self.arg[s]] |= f
                        changed = True
        ahead = [first[s] | (follow[self.owner[s]] if null[s] else set()) for s in range(n)]

        def leaves(s: int, seen: set[int]) -> list[int]:
            if self.kind[s] != CHOOSE:
                return [s]
            if s in seen:
                return []
            seen.add(s)
            return [x for o in self.options[s] for x in leaves(o, seen)]

        self.act: list[dict[int, tuple[int, ...]] | None] = [None] * n
        for s in range(n):
            if self.kind[s] == CHOOSE:
                table: dict[int, list[int]] = {}
                for o in dict.fromkeys(leaves(s, set())):
                    for t in ahead[o]:
                        table.setdefault(t, []).append(o)
                self.act[s] = {t: tuple(v) for t, v in table.items()}

    def accepts(self, tokens: Sequence[int], rules: Sequence[str], context=None) -> tuple[bool, int]:
        """Whether any of the rules (dialects, run together) takes the whole input, and the furthest
        token looked at. ``tokens`` ends with the end token, which the rules take themselves."""
        kind, arg, nxt, act, start = self.kind, self.arg, self.next, self.act, self.start
        nodes: dict[int, list] = {}
        width = len(self.rules) + 1
        size = len(tokens)
        root: list = [[], []]
        todo = [(start[self.rules[x]], root, 0) for x in reversed(rules)]
        seen: set[tuple[int, int, int]] = set()
        far = 0
        tokens = [*tokens, -1]
        while todo:
            s, node, pos = todo.pop()
            while True:
                k = kind[s]
                if k == TAKE:
                    if tokens[pos] != arg[s]:
                        break
                    pos += 1
                    s = nxt[s]
                elif k == CHOOSE:
                    ways = act[s].get(tokens[pos])
                    if ways is None:
                        break
                    s = ways[0]
                    if len(ways) > 1:
                        for w in ways[1:]:
                            key = (w, id(node), pos)
                            if key not in seen:
                                seen.add(key)
                                todo.append((w, node, pos))
                elif k == CALL:
                    key = pos * width + arg[s]
                    called = nodes.get(key)
                    if called is None:
                        called = [[(nxt[s], node)], []]
                        nodes[key] = called
                        s, node = start[arg[s]], called
                        continue
                    back = nxt[s]
                    for e in called[0]:
                        if e[0] == back and e[1] is node:
                            break
                    else:
                        called[0].append((back, node))
                        for p in called[1]:
                            todo.append((back, node, p))
                    break
                elif k == END:
                    ends = node[1]
                    if pos in ends:
                        break
                    ends.append(pos)
                    if node is root:
                        if pos == size:
                            return True, pos
                        break
                    edges = node[0]
                    for e in edges[1:]:
                        todo.append((e[0], e[1], pos))
                    s, node = edges[0]
                else:
                    if not arg[s](tokens, pos, context):
                        break
                    s = nxt[s]
            if pos > far:
                far = pos
        return False, far
