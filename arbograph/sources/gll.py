"""A generalised LL recogniser with a graph-structured stack, over token kinds.

Grammars are text: `Name: alternative | alternative ;` with 'literal' and KIND terminals, (groups), ?, * and +.
Alternatives that the next token rules out are never entered, so that the stack stays a list where a grammar is
LL(1) and forks only where it isn't: stack nodes are (nonterminal, position), shared by all threads; a node keeps
its callers and where it has ended, so each piece of input is recognised once for each nonterminal. Left recursion
is allowed. ?, * and + take what they can. A nonterminal marked with ! is reported with its span in the tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SYMBOL = re.compile(r"\s+|#[^\n]*|(?P<lit>'[^']*')|(?P<name>[A-Za-z_]+!?)|(?P<op>[:|;()?*+])")
END = "END"
#: Terminals that take no token: a line break (or the end, or a closing brace) stands before the next token; none
#: stands there; the next token is not of those that the grammar's `barred` lists for the name.
BREAK, SAME_LINE = "BREAK", "SAMELINE"
_BREAK, _SAME_LINE, _BARRED = -1_000_000, -1_000_001, -1_000_002


@dataclass
class Result:
    """ok: the whole input was recognised; furthest: the first token that no thread could take; spans: (nonterminal, first token, token after the last)."""

    ok: bool
    furthest: int
    end: int
    spans: list[tuple[str, int, int]] = field(default_factory=list)


class Grammar:
    """A compiled grammar. kinds: the number of each token kind."""

    def __init__(self, text: str, start: str, barred: dict[str, tuple[str, ...]] | None = None):
        self.barred = barred or {}
        self.kinds: dict[str, int] = {END: 0}
        self.rules: dict[str, list[list]] = {}
        self.greedy: set[str] = set()
        self.marked: set[str] = set()
        self._fresh = 0
        self._read(text)
        self._compile(start)

    # -- reading

    def _read(self, text: str) -> None:
        at, symbols = 0, []
        while at < len(text):
            m = _SYMBOL.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 30]!r}")
            if m.lastgroup:
                symbols.append((m.lastgroup, m[0]))
            at = m.end()
        self._symbols, self._at = symbols, 0
        while self._at < len(symbols):
            name = symbols[self._at][1]
            if name.endswith("!"):
                name = name[:-1]
                self.marked.add(name)
            assert symbols[self._at + 1] == ("op", ":"), name
            self._at += 2
            self.rules[name] = self._alternatives()
            assert symbols[self._at] == ("op", ";"), name
            self._at += 1

    def _alternatives(self) -> list[list]:
        out = [[]]
        while True:
            kind, text = self._symbols[self._at]
            if (kind, text) in (("op", ";"), ("op", ")")):
                return out
            self._at += 1
            if (kind, text) == ("op", "|"):
                out.append([])
                continue
            if (kind, text) == ("op", "("):
                item = self._rule(self._alternatives())
                self._at += 1
            elif kind == "lit":
                item = text[1:-1]
                self.kinds.setdefault(item, len(self.kinds))
            elif text in (BREAK, SAME_LINE) or text in self.barred:
                item = text
            elif text.isupper():
                item = text
                self.kinds.setdefault(item, len(self.kinds))
            else:
                item = ("N", text)
            kind, text = self._symbols[self._at]
            if kind == "op" and text in "?*+":
                self._at += 1
                if text == "?":
                    item = self._rule([[item], []], True)
                else:
                    loop = self._rule([[], []], True)
                    self.rules[loop[1]][0] = [item, loop]
                    item = loop if text == "*" else self._rule([[item, loop]])
            out[-1].append(item)

    def _rule(self, alternatives: list[list], greedy: bool = False) -> tuple:
        if len(alternatives) == 1 and len(alternatives[0]) == 1 and not greedy:
            return alternatives[0][0]
        self._fresh += 1
        name = f"_{self._fresh}"
        self.rules[name] = alternatives
        if greedy:
            self.greedy.add(name)
        return ("N", name)

    # -- tables

    def _compile(self, start: str) -> None:
        rules, nullable = self.rules, set()
        first: dict[str, set] = {n: set() for n in rules}
        follow: dict[str, set] = {n: set() for n in rules}
        is_n = lambda s: isinstance(s, tuple)
        bars = sorted(self.barred)
        empty = {BREAK: _BREAK, SAME_LINE: _SAME_LINE} | {b: _BARRED - i for i, b in enumerate(bars)}
        self.bars = [frozenset(self.kinds[k] for k in self.barred[b]) for b in bars]

        def of(seq: list) -> tuple[set, bool]:
            out: set = set()
            for s in seq:
                if s in empty:
                    continue
                if not is_n(s):
                    out.add(s)
                    return out, False
                out |= first[s[1]]
                if s[1] not in nullable:
                    return out, False
            return out, True

        changed = True
        while changed:
            changed = False
            for n, alternatives in rules.items():
                for a in alternatives:
                    f, null = of(a)
                    if not f <= first[n] or null and n not in nullable:
                        first[n] |= f
                        nullable |= {n} if null else set()
                        changed = True
        follow[start].add(END)
        changed = True
        while changed:
            changed = False
            for n, alternatives in rules.items():
                for a in alternatives:
                    for i, s in enumerate(a):
                        if is_n(s):
                            f, null = of(a[i + 1 :])
                            f = f | follow[n] if null else f
                            if not f <= follow[s[1]]:
                                follow[s[1]] |= f
                                changed = True
        self.number = {n: i for i, n in enumerate(rules)}
        #: By slot: a terminal's kind >= 0; -1 the end of an alternative; else -2 - the nonterminal's number.
        self.code: list[int] = []
        self.table: list[dict[int, tuple[int, ...]]] = []
        self.is_marked = [n in self.marked for n in rules]
        self.names = list(rules)
        for n, alternatives in rules.items():
            table: dict[int, list[int]] = {}
            for a in alternatives:
                slot = len(self.code)
                self.code += [-2 - self.number[s[1]] if is_n(s) else empty[s] if s in empty else self.kinds[s] for s in a] + [-1]
                f, null = of(a)
                for k in f | (follow[n] if null else set()):
                    if k in f or n not in self.greedy or self.kinds[k] not in table:
                        table.setdefault(self.kinds[k], []).append(slot)
            self.table.append({k: tuple(v) for k, v in table.items()})
        self.start = self.number[start]

    # -- recognising

    def run(self, kinds: list[int], at: int = 0, start: str | None = None, fresh: list[bool] | None = None) -> Result:
        """Recognises kinds (closed by END) from `at`; with a start of its own, what follows it is free (ok: it was found, end: where the longest ends). fresh: before which tokens a line break stands."""
        code, table, marked = self.code, self.table, self.is_marked
        bars, brace = self.bars, self.kinds.get("}", -1)
        prefix = start is not None
        top = self.number[start] if prefix else self.start
        spans: list[tuple[str, int, int]] = []
        size = len(self.names)
        # A node: [nonterminal, position, callers as (slot, node), positions where it ended]
        root = [top, at, [], []]
        nodes = {at * size + top: root}
        furthest, ends = at, []
        work = [(s, root, at) for s in table[top].get(kinds[at], ())]
        while work:
            slot, node, i = work.pop()
            while True:
                c = code[slot]
                if c >= 0:
                    if kinds[i] == c:
                        i += 1
                        slot += 1
                        continue
                    if i > furthest:
                        furthest = i
                    break
                if c < -1:
                    if c <= _BREAK:
                        if c == _BREAK:
                            go = fresh[i] or kinds[i] == 0 or kinds[i] == brace
                        elif c == _SAME_LINE:
                            go = not fresh[i]
                        else:
                            go = kinds[i] not in bars[_BARRED - c]
                        if go:
                            slot += 1
                            continue
                        if i > furthest:
                            furthest = i
                        break
                    n = -2 - c
                    slots = table[n].get(kinds[i])
                    if slots is None:
                        if i > furthest:
                            furthest = i
                        break
                    key = i * size + n
                    child = nodes.get(key)
                    if child is None:
                        node = nodes[key] = [n, i, [(slot + 1, node)], []]
                        if len(slots) > 1:
                            work.extend([(s, node, i) for s in slots[1:]])
                        slot = slots[0]
                        continue
                    child[2].append((slot + 1, node))
                    ended = child[3]
                    if not ended:
                        break
                    for e in ended[1:]:
                        work.append((slot + 1, node, e))
                    i = ended[0]
                    slot += 1
                    continue
                # the end of an alternative
                ended = node[3]
                if i in ended:
                    break
                ended.append(i)
                if marked[node[0]]:
                    spans.append((self.names[node[0]], node[1], i))
                callers = node[2]
                if node is root:
                    ends.append(i)
                if not callers:
                    if i > furthest:
                        furthest = i
                    break
                for s, caller in callers[1:]:
                    work.append((s, caller, i))
                slot, node = callers[0]
        ok = bool(ends) if prefix else len(kinds) in ends
        return Result(ok, furthest, max(ends, default=at), spans)
