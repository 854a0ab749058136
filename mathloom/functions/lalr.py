"""A small LALR(1) table builder with operator precedence, for the formula grammar."""

from __future__ import annotations

from collections import defaultdict

END = "$end"


class Tables:
    """``rules``: (left, right symbols, action name, precedence terminal or None), the first
    left symbol is the start. ``levels``: (associativity, terminals) from low to high."""

    def __init__(self, rules: list[tuple[str, tuple[str, ...], str, str | None]], levels: list[tuple[str, str]]) -> None:
        self.rules = [("$start", (rules[0][0],), "", None), *rules]
        self.left = {r[0] for r in self.rules}
        self.by = defaultdict(list)
        for i, r in enumerate(self.rules):
            self.by[r[0]].append(i)
        self.level = {t: (n, how) for n, (how, ts) in enumerate(levels) for t in ts.split()}
        self._first()
        self._states()
        self._lookaheads()
        self._actions()

    def _first(self) -> None:
        self.nullable: set[str] = set()
        self.first: dict[str, set[str]] = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for left, right, *_ in self.rules:
                before = len(self.first[left]), left in self.nullable
                for s in right:
                    if s not in self.left:
                        self.first[left].add(s)
                        break
                    self.first[left] |= self.first[s]
                    if s not in self.nullable:
                        break
                else:
                    self.nullable.add(left)
                changed |= before != (len(self.first[left]), left in self.nullable)

    def _closure(self, items: dict[tuple[int, int], set[str]]) -> dict[tuple[int, int], set[str]]:
        """LR(1) closure of items (rule, dot) with lookaheads."""
        out = {k: set(v) for k, v in items.items()}
        todo = list(out)
        while todo:
            rule, dot = item = todo.pop()
            right = self.rules[rule][1]
            if dot == len(right) or right[dot] not in self.left:
                continue
            ahead: set[str] = set()
            for s in right[dot + 1 :]:
                if s not in self.left:
                    ahead.add(s)
                    break
                ahead |= self.first[s]
                if s not in self.nullable:
                    break
            else:
                ahead |= out[item]
            for r in self.by[right[dot]]:
                new = (r, 0)
                if new not in out:
                    out[new] = set(ahead)
                    todo.append(new)
                elif not ahead <= out[new]:
                    out[new] |= ahead
                    todo.append(new)
        return out

    def _states(self) -> None:
        start = frozenset({(0, 0)})
        self.kernels = [start]
        self.goto: list[dict[str, int]] = []
        number = {start: 0}
        for kernel in self.kernels:
            moves = defaultdict(set)
            for rule, dot in self._closure({i: set() for i in kernel}):
                right = self.rules[rule][1]
                if dot < len(right):
                    moves[right[dot]].add((rule, dot + 1))
            row = {}
            for s, items in moves.items():
                key = frozenset(items)
                if key not in number:
                    number[key] = len(self.kernels)
                    self.kernels.append(key)
                row[s] = number[key]
            self.goto.append(row)

    def _lookaheads(self) -> None:
        """Lookaheads arise in a state's closure or pass from kernel item to kernel item."""
        ahead = [{i: set() for i in k} for k in self.kernels]
        ahead[0][(0, 0)].add(END)
        passes = defaultdict(list)
        for n, kernel in enumerate(self.kernels):
            for item in kernel:
                for (rule, dot), marks in self._closure({item: {"#"}}).items():
                    right = self.rules[rule][1]
                    if dot == len(right):
                        continue
                    to = (self.goto[n][right[dot]], (rule, dot + 1))
                    ahead[to[0]][to[1]] |= marks - {"#"}
                    if "#" in marks:
                        passes[(n, item)].append(to)
        todo = [(n, i) for n, k in enumerate(self.kernels) for i in k]
        while todo:
            n, item = todo.pop()
            for m, other in passes[(n, item)]:
                if not ahead[n][item] <= ahead[m][other]:
                    ahead[m][other] |= ahead[n][item]
                    todo.append((m, other))
        self.ahead = ahead

    def _actions(self) -> None:
        """By state: terminal -> ("s", state) or ("r", rule). Conflicts: precedence, then
        associativity; without either a shift, or of two rules the first."""
        self.table: list[dict[str, tuple[str, int]]] = []
        for n in range(len(self.kernels)):
            row: dict[str, tuple[str, int]] = {s: ("s", m) for s, m in self.goto[n].items() if s not in self.left}
            dead = set()
            done = sorted((rule, marks) for (rule, dot), marks in self._closure(self.ahead[n]).items() if dot == len(self.rules[rule][1]))
            for rule, marks in done:
                mine = self._precedence(rule)
                for t in marks:
                    now = row.get(t)
                    if now is None:
                        if t not in dead:
                            row[t] = ("r", rule)
                    elif now[0] == "s" and mine is not None and t in self.level:
                        level, how = self.level[t]
                        if mine > level or (mine == level and how == "left"):
                            row[t] = ("r", rule)
                        elif mine == level and how == "nonassoc":
                            del row[t]
                            dead.add(t)
            self.table.append(row)

    def _precedence(self, rule: int) -> int | None:
        _, right, _, given = self.rules[rule]
        if given:
            return self.level[given][0]
        last = next((s for s in reversed(right) if s not in self.left), None)
        return self.level[last][0] if last in self.level else None
