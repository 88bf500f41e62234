"""Secret scans: all rules compiled into one minimal automaton that reads each byte once.

Base rules, leftmost and non-overlapping per kind, dropped if too short:
  assign  (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+), letters
          of the names in either case, 8+ characters in group 2
  access  AKIA[A-Z0-9]+, 16+ characters
  hex     [0-9a-f]+, 32+ characters
Further rules of the method (spans only): pem, jwt, github, slack, google, stripe, bearer.

Every rule is a prefix and a run: a regular expression, and a class of bytes that goes on as long as it
can. A prefix is parsed into a nondeterministic automaton that may start anywhere and is made deterministic
by subset construction. Its run is one more state, entered by the run's first byte and left by the first
byte outside the class, which is looked at as a first byte of new text: so matches are leftmost and do not
overlap. (The construction checks that no later start can reach its run before an earlier one that is
still alive.) The rules' automata are joined into one by the product of what can be reached together, over
classes of equivalent bytes, and minimised by partition refinement. The result is one transition array
per state, and per state the set of rules in whose run it is.

A scan reads every byte once. Some bytes send every state to the start; a text is cut at such bytes into
pieces, which the array then reads side by side, a byte of each at a step. A rule's match ends where its
runs of states end; runs that are too short are dropped, as the contract has it. Where a match starts is
read off the prefix's reversed automaton, made deterministic too, from the run's first byte back, over
bytes that no match before it has: each byte at most once a rule.

Null and empty texts have no spans. Texts are read whole. Repeated rows are scanned one by one; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, lean, small_batches, utf8

_ANY = "[A-Za-z0-9_-]"
#: kind, prefix, class of the run, least length of the run.
# Forms of the base rules and of well-known tokens.
RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 8),
    ("access", "AKIA", "[A-Z0-9]", 12),
    ("hex", "", "[0-9a-f]", 32),
    ("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY----", r"[A-Za-z0-9+/=\r\n-]", 1),
    ("jwt", rf"eyJ{_ANY}{_ANY}*\.eyJ{_ANY}{_ANY}*\.", _ANY, 8),
    ("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    ("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    ("google", "AIza", _ANY, 35),
    ("stripe", "[sr]k_(live|test)_", "[A-Za-z0-9]", 16),
    ("bearer", r"[bB]earer\x20", "[A-Za-z0-9+/_.=-]", 20),
)
KINDS = tuple(r[0] for r in RULES)
BASE = KINDS[:3]
#: Bytes of a piece, or more up to the next byte that sends every state to the start.
PIECE = 512
#: Pieces read side by side as long as they are so many; fewer go on one by one.
LANES = 24
#: Longer data is taken in parts of so many bytes, up to the last at which nothing is under way.
PART = 4 << 20


class _Parser:
    """Literals, classes, groups, alternation, ? * and {m}, {m,n} into a nondeterministic automaton."""

    def __init__(self, text: str, nfa: _Nfa):
        self.s, self.i, self.nfa = text, 0, nfa

    def parse(self) -> tuple[int, int]:
        ends = [self._sequence()]
        while self._peek() == "|":
            self.i += 1
            ends.append(self._sequence())
        if len(ends) == 1:
            return ends[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in ends:
            self.nfa.free[a].append(x)
            self.nfa.free[y].append(b)
        return a, b

    def _peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def _sequence(self) -> tuple[int, int]:
        a = b = self.nfa.state()
        while self._peek() not in ("", "|", ")"):
            at = self.i
            x, y = self._atom()
            low, high = self._count()
            after = self.i
            copies = [(x, y)]
            for _ in range(1, max(high or low, 1)):
                self.i = at
                copies.append(self._atom())
            self.i = after
            if high is None:  # star after `low` copies
                p, q = copies[-1]
                self.nfa.free[q].append(p)
                self.nfa.free[p].append(q) if low == 0 else None
            for n, (p, q) in enumerate(copies):
                self.nfa.free[b].append(p)
                if high is not None and n >= low:
                    self.nfa.free[p].append(q)
                b = q
        return a, b

    def _count(self) -> tuple[int, int | None]:
        c = self._peek()
        if c == "?":
            self.i += 1
            return 0, 1
        if c == "*":
            self.i += 1
            return 0, None
        if c == "{":
            end = self.s.index("}", self.i)
            low, _, high = self.s[self.i + 1 : end].partition(",")
            self.i = end + 1
            return int(low), int(high or low)
        return 1, 1

    def _byte(self) -> int:
        c = self.s[self.i]
        if c == "\\":
            if self.s[self.i + 1] == "x":
                self.i += 4
                return int(self.s[self.i - 2 : self.i], 16)
            self.i += 2
            return {"r": 13, "n": 10}.get(c := self.s[self.i - 1], ord(c))
        self.i += 1
        return ord(c)

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self.i += 1
            out = self.parse()
            self.i += 1
            return out
        allowed: set[int] = set()
        if c == "[":
            self.i += 1
            while self._peek() != "]":
                low = high = self._byte()
                if self._peek() == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    high = self._byte()
                allowed |= set(range(low, high + 1))
            self.i += 1
        else:
            allowed = {self._byte()}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.step[a].append((frozenset(allowed), b))
        return a, b


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append([])
        return len(self.free) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)


def _class(text: str) -> frozenset[int]:
    nfa = _Nfa()
    a, _ = _Parser(text, nfa).parse()
    return next(s for x in nfa.closure({a}) for s, _ in nfa.step[x])


def _search(prefix: str, run: str) -> tuple[np.ndarray, np.ndarray]:
    """(next, in run): states x 256 of a rule's automaton. State 0 starts."""
    nfa = _Nfa()
    first, end = _Parser(prefix, nfa).parse()
    allowed = _class(run)
    # threads by the age of their start: tuples of sets of states, older ones first
    start: tuple[frozenset[int], ...] = (nfa.closure({first}),)
    inside: tuple[frozenset[int], ...] = ()
    number, todo, rows = {start: 0, inside: 1}, [start], {}

    def after(threads: tuple[frozenset[int], ...], byte: int) -> tuple[frozenset[int], ...]:
        out, seen = [], set()
        for k, t in enumerate(threads):
            if end in t and byte in allowed:
                # what is older than the match must not be alive: its own match would start before
                older = [x for x in threads[:k] if any(byte in s for n in x for s, _ in nfa.step[n])]
                if older:
                    raise ValueError(f"the rule {prefix!r} may match a later start before an earlier one")
                return inside
            moved = nfa.closure({y for n in t for s, y in nfa.step[n] if byte in s}) - seen
            if moved:
                out.append(moved)
                seen |= moved
        fresh = start[0] - seen
        return (*out, fresh) if fresh else tuple(out)

    while todo:
        at = todo.pop()
        row = []
        for byte in range(256):
            to = after(at, byte)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows[number[at]] = row
    rows[1] = [1 if byte in allowed else rows[0][byte] for byte in range(256)]
    # ages of threads no longer matter: equal futures are one state
    return minimise(np.array([rows[i] for i in range(len(rows))]), np.arange(len(rows)) == 1)


def minimise(table: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States stay together while their labels agree and their bytes go to the same parts; state 0 stays first."""
    part = np.unique(labels, return_inverse=True)[1].ravel()
    while True:
        key = part.astype(np.uint64)
        for c in range(table.shape[1]):  # two numbers a state tell its row of parts
            key = key * np.uint64(0x9E3779B97F4A7C15) + part[table[:, c]].astype(np.uint64)
            key ^= key >> np.uint64(29)
        finer = np.unique(np.column_stack([part.astype(np.uint64), key]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    first = np.full(part.max() + 1, -1)
    first[part[::-1]] = np.arange(len(part))[::-1]
    order = np.argsort(first)  # parts by first appearance
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[part[table[first[order]]]], labels[first[order]]


def compile_rules(rules: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(next, masks): states x 256 transitions, and per state a bit mask of the rules in whose run it is. State 0 starts."""
    machines = [_search(prefix, run) for _, prefix, run, _ in rules]
    # bytes that no machine tells apart share a class
    _, sample, class_of = np.unique(np.concatenate([t for t, _ in machines]).T, axis=0, return_index=True, return_inverse=True)
    class_of = class_of.ravel()
    steps = [t[:, sample].tolist() for t, _ in machines]
    start = (0,) * len(machines)
    number, todo, rows, masks = {start: 0}, [start], [], []
    for at in todo:  # grows as states are found
        masks.append(sum(int(machines[r][1][x]) << r for r, x in enumerate(at)))
        row = []
        for to in zip(*(steps[r][x] for r, x in enumerate(at)), strict=True):
            if (k := number.get(to)) is None:
                k = number[to] = len(number)
                todo.append(to)
            row.append(k)
        rows.append(row)
    table, masks_ = minimise(np.array(rows), np.array(masks))
    return table[:, class_of], masks_


def _reversed(prefix: str) -> tuple[list[list[int]], list[bool]]:
    """The prefix read from its end: transitions (-1 where none is left), and whether a state is a start."""
    nfa = _Nfa()
    first, end = _Parser(prefix, nfa).parse()
    back = _Nfa()
    for _ in nfa.free:
        back.state()
    for x, (free, step) in enumerate(zip(nfa.free, nfa.step, strict=True)):
        for y in free:
            back.free[y].append(x)
        for s, y in step:
            back.step[y].append((s, x))
    start = back.closure({end})
    number, todo, rows, begins = {start: 0}, [start], [], []
    for at in todo:
        begins.append(first in at)
        row = []
        for byte in range(256):
            to = back.closure({y for x in at for s, y in back.step[x] if byte in s})
            if not to:
                row.append(-1)
                continue
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    return rows, begins


class Scanner:
    """The automaton of some rules, and what finds a match's start."""

    def __init__(self, rules: tuple = RULES, compiled: tuple[np.ndarray, np.ndarray] | None = None):
        self.rules = rules
        table, masks = compiled or compile_rules(rules)
        self.masks = masks.astype(np.uint16)
        # bytes by class, and a flat array: state * classes + class
        _, sample, class_of = np.unique(table, axis=1, return_index=True, return_inverse=True)
        self.class_of = class_of.ravel().astype(np.int32)
        small = table[:, sample].astype(np.int32)
        self.classes = small.shape[1]
        self.resets = (table == 0).all(axis=0)
        self.flat = (small * self.classes).ravel()
        self.rows = (small * self.classes).ravel().tolist()
        self.back = [_reversed(r[1]) for r in rules]
        # a rule without a prefix is in its run in ordinary text: its runs are looked for apart
        self.rules_of_any_text = next((n for n, r in enumerate(rules) if not r[1]), None)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces of the texts start: at each text's start and, PIECE bytes or more apart, after bytes that reset."""
        after = np.flatnonzero(self.resets[data]) + 1
        marks = np.unique(np.concatenate([offsets, after]))
        # of all marks the texts' starts and the first in each PIECE of the data
        keep = np.ones(len(marks), bool)
        keep[1:] = marks[1:] // PIECE != marks[:-1] // PIECE
        marks = np.unique(np.concatenate([marks[keep], offsets]))
        return marks[marks < len(data)]

    def states(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The state after every byte, times the number of classes; each byte is read once."""
        out = np.zeros(len(data), np.int32)
        if not len(data):
            return out
        kinds = self.class_of[data]
        begin = self._pieces(data, offsets)
        size = np.diff(np.append(begin, len(data)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # pieces of at least so many bytes
        state, flat, at = np.zeros(len(begin), np.int32), self.flat, begin.copy()
        j = 0
        while j < len(alive) and (n := int(alive[j])) >= LANES:
            state = flat[state[:n] + kinds[at[:n]]]
            out[at[:n]] = state
            at = at[:n] + 1
            j += 1
        for i in range(int(alive[j]) if j < len(alive) else 0):
            a, b, row, here = int(begin[i]) + j, int(begin[i]) + int(size[i]), self.rows, int(state[i])
            for c in range(a, b, 1 << 20):
                part = kinds[c : min(b, c + (1 << 20))].tolist()
                for k, x in enumerate(part):
                    part[k] = here = row[here + x]
                out[c : c + len(part)] = part
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of data, by start and then rule, of texts that lie between offsets."""
        found, low, n = [], 0, len(data)
        while low < n:
            size = PART
            while True:
                high = min(n, low + size)
                own = np.unique(np.concatenate([[low], offsets[(offsets > low) & (offsets < high)], [high]])) - low
                state = self.states(data[low:high], own)
                if high == n:
                    break
                # nothing is under way where the state is the start: the next part begins there
                idle = np.flatnonzero(state[-65536:] == 0)
                if len(idle):
                    high -= len(state[-65536:]) - 1 - int(idle[-1])
                    state, own = state[: high - low], np.append(own[own < high - low], high - low)
                    break
                size *= 2
            found += [(a + low, r, b + low) for a, r, b in self._spans(data[low:high], own, state)]
            low = high
        return found

    def _spans(self, data: np.ndarray, offsets: np.ndarray, state: np.ndarray) -> list[tuple[int, int, int]]:
        masks = self.masks[state // self.classes]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        found = []
        for group in (1 << self.rules_of_any_text, (1 << len(self.rules)) - 1 & ~(1 << self.rules_of_any_text)) if self.rules_of_any_text is not None else ((1 << len(self.rules)) - 1,):
            at = np.flatnonzero(masks & np.uint16(group))
            for n, (_, _, _, least) in enumerate(self.rules):
                if not group >> n & 1:
                    continue
                own = at[(masks[at] >> np.uint16(n) & 1).astype(bool)] if group != 1 << n else at
                if not len(own):
                    continue
                cut = np.flatnonzero((np.diff(own) != 1) | begins[own[1:]])  # a text's end ends a run
                first, last = own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)] + 1
                for k in np.flatnonzero(last - first >= least).tolist():
                    text = int(offsets[np.searchsorted(offsets, first[k], side="right") - 1])
                    found.append((self._start(n, data, max(text, int(last[k - 1]) if k else 0), int(first[k])), n, int(last[k])))
        return sorted(found)

    def _start(self, rule: int, data: np.ndarray, low: int, first: int) -> int:
        """The leftmost start, not before low, of the prefix that ends at first."""
        rows, begins = self.back[rule]
        state, best, at = 0, first, first
        while at > low:
            piece = data[max(low, at - 4096) : at].tobytes()
            for c in reversed(piece):
                state = rows[state][c]
                if state < 0:
                    return best
                at -= 1
                if begins[state]:
                    best = at
        return best


_scanner: Scanner | None = None
_compiled: tuple[np.ndarray, np.ndarray] | None = None


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """The transition array of RULES, compiled once by the driver; a few MB at any size of the input."""
    global _compiled
    if _compiled is None:
        table, masks = compile_rules(RULES)
        _compiled = table.astype(np.uint16 if len(table) < 65536 else np.int64), masks
    return _compiled


def scanner(compiled: tuple[np.ndarray, np.ndarray] | None = None) -> Scanner:
    """One per process."""
    global _scanner
    if _scanner is None:
        _scanner = Scanner(RULES, compiled or automaton())
    return _scanner


def found_in(s: Scanner, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, rule, end) in bytes of the text; texts without a span are left out."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, n, b in s.spans(data, offsets):
        t = int(np.searchsorted(offsets, a, side="right")) - 1
        out.setdefault(t, []).append((a - int(offsets[t]), n, b - int(offsets[t])))
    return out


def _in_code_points(text: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in code points. Only what lies between spans is counted, so long texts take no more memory."""
    places = sorted({x for a, _, b in found for x in (a, b)})
    before, seen, last = {}, 0, 0
    for p in places:
        seen += int(np.count_nonzero((text[last:p] & 0xC0) != 0x80))
        before[p], last = seen, p
    return [(KINDS[n], before[a], before[b]) for a, n, b in found]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of docs(doc_id, text); spans are
    kind:start:end in code points, end exclusive, by start and then kind in the order of KINDS."""
    small_batches(docs.sparkSession)
    compiled = docs.sparkSession.sparkContext.broadcast(automaton())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(compiled.value)
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                counts, shas, spans = np.zeros((len(BASE), j - i), np.int64), [none] * (j - i), [""] * (j - i)
                for k, found in found_in(s, part, own).items():
                    named = _in_code_points(part[own[k] : own[k + 1]], found)
                    for kind, _, _ in named:
                        if kind in BASE:
                            counts[BASE.index(kind), k] += 1
                    joined = [f"{x}:{a}:{b}" for x, a, b in named]
                    shas[k] = hashlib.sha256(",".join(y for y, (x, _, _) in zip(joined, named, strict=True) if x in BASE).encode()).hexdigest()
                    spans[k] = ",".join(joined)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by `[kind]` and n_chars counted anew; other columns stay."""
    small_batches(docs.sparkSession)
    compiled = docs.sparkSession.sparkContext.broadcast(automaton())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(compiled.value)
        for batch in batches:
            at, counted = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            data, offsets = utf8(batch.column(at))
            for i, j in chunks(offsets):
                part, own, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.slice(i, j - i)
                found = found_in(s, part, own)
                if found:
                    out = rows.column(at).to_pylist()
                    for k, spans in found.items():
                        text, parts, end = part[own[k] : own[k + 1]].tobytes(), [], 0
                        for a, n, b in spans:
                            if a >= end:
                                parts += [text[end:a], b"[" + KINDS[n].encode() + b"]"]
                            end = max(end, b)
                        out[k] = b"".join([*parts, text[end:]]).decode()
                    columns = list(rows.columns)
                    columns[at] = pa.array(out, rows.schema.field(at).type)
                    if counted >= 0:
                        columns[counted] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(rows.schema.field(counted).type)
                    rows = pa.RecordBatch.from_arrays(columns, schema=rows.schema)
                yield rows

    return docs.mapInArrow(run, docs.schema)
