"""Secret scanning with one combined deterministic automaton.

Rule regexes are parsed to a byte-level NFA, determinised by subset construction over byte classes and
minimised by partition refinement into transition arrays.  One pass over the bytes runs all rules at
once: texts are cut into lanes after bytes, or pairs of bytes, that lead every state back to the start
state (no match can reach across such a cut), and numpy advances all lanes of a block by one byte per step.  Lanes in which
some rule accepted are resolved to exact leftmost-longest spans with the rule's own anchored automaton.

Defined results: a null or empty text has no spans; each input row gives one output row, so repeated
rows repeat their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import frugal

BLOCK_BYTES = 4 << 20
LANE_BYTES = 256


@dataclass(frozen=True)
class Rule:
    """``prefix`` and ``pattern`` follow each other; ``least`` bounds the bytes after the prefix
    (``whole=False``) or of the whole match.  ``seek`` replaces both in the combined automaton: a shorter
    part of every wanted match (fewer states), or a longer one where short matches are too common."""

    kind: str
    pattern: str
    prefix: str = ""
    least: int = 1
    whole: bool = True
    ignore_case: bool = False
    seek: str = ""


#: The three base rules of the contract.
BASE_RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 6, False, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24, seek=r"[0-9a-f]{24}"),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", seek=r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", seek=r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", seek=r"eyJ[A-Za-z0-9_-]"),
)
RULES = BASE_RULES + EXTRA_RULES
#: Bytes that tries of a rule may read in vain in one lane before its matches are looked up from the end.
WASTE = 1 << 14
#: Lanes that are left are read one by one.
FEW_LANES = 32


# --- regex -> NFA ---------------------------------------------------------------------------------


class _Nfa:
    """Thompson construction: state -> list of (byte set or None for epsilon, target)."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, b: int, on: frozenset | None = None) -> None:
        self.edges[a].append((on, b))

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for on, to in self.edges[todo.pop()]:
                if on is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


class _Parser:
    """Literals, escapes, classes, groups, alternation and the quantifiers ? * + {m} {m,} {m,n}."""

    def __init__(self, pattern: str, nfa: _Nfa, ignore_case: bool) -> None:
        self.p, self.i, self.nfa, self.fold = pattern, 0, nfa, ignore_case

    def parse(self) -> tuple[int, int]:
        tree = self._alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unsupported regex at {self.i}: {self.p!r}")
        return self._build(tree)

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _next(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def _alternatives(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self._next()
            options.append(self._sequence())
        return ("or", options)

    def _sequence(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._quantified())
        return ("seq", items)

    def _quantified(self):
        item = self._atom()
        while self._peek() and self._peek() in "?*+{":
            q = self._next()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[q]
            if q == "{":
                end = self.p.index("}", self.i)
                low_text, comma, high_text = self.p[self.i : end].partition(",")
                self.i = end + 1
                low = int(low_text)
                high = int(high_text) if high_text else None if comma else low
            item = ("rep", item, low, high)
        return item

    def _escape(self) -> int:
        c = self._next()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _atom(self):
        c = self._next()
        if c == "(":
            tree = self._alternatives()
            self._next()
            return tree
        if c == "[":
            return ("set", self._class())
        return ("set", self._folded({self._escape() if c == "\\" else ord(c)}))

    def _class(self) -> frozenset:
        negated, found = self._peek() == "^", set()
        if negated:
            self._next()
        while self._peek() != "]":
            c = self._next()
            low = high = self._escape() if c == "\\" else ord(c)
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                self._next()
                c = self._next()
                high = self._escape() if c == "\\" else ord(c)
            found.update(range(low, high + 1))
        self._next()
        found = self._folded(found)
        return frozenset(range(256)) - found if negated else found

    def _folded(self, found) -> frozenset:
        if self.fold:
            found = {x for b in found for x in ((b, b ^ 32) if chr(b).isalpha() and b < 128 else (b,))}
        return frozenset(found)

    def _build(self, tree) -> tuple[int, int]:
        nfa = self.nfa
        if tree[0] == "rep":
            _, item, low, high = tree
            start = last = nfa.state()
            for _ in range(low):
                a, b = self._build(item)
                nfa.link(last, a)
                last = b
            if high is None:
                a, b = self._build(item)
                end = nfa.state()
                nfa.link(last, a)
                nfa.link(last, end)
                nfa.link(b, a)
                nfa.link(b, end)
                return start, end
            end = nfa.state()
            nfa.link(last, end)
            for _ in range(high - low):
                a, b = self._build(item)
                nfa.link(last, a)
                nfa.link(b, end)
                last = b
            return start, end
        start, end = nfa.state(), nfa.state()
        if tree[0] == "set":
            nfa.link(start, end, tree[1])
        elif tree[0] == "or":
            for option in tree[1]:
                a, b = self._build(option)
                nfa.link(start, a)
                nfa.link(b, end)
        else:
            last = start
            for item in tree[1]:
                a, b = self._build(item)
                nfa.link(last, a)
                last = b
            nfa.link(last, end)
        return start, end


# --- NFA -> minimal DFA ---------------------------------------------------------------------------


@dataclass
class Dfa:
    """``table[state, byte_class[byte]]`` is the next state; ``accepts[state]`` a bit mask of rules."""

    byte_class: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    start: int
    dead: int = -1
    rows: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rows = [row.tolist() for row in self.table[:, self.byte_class]]

    def run(self, data: bytes, at: int, end: int) -> tuple[int, int]:
        """End of the longest match that starts at ``at``, or -1, and how far it was looked for."""
        state, found, rows, accepts, i = self.start, -1, self.rows, self.accepts, at
        for i in range(at, end):
            state = rows[state][data[i]]
            if state == self.dead:
                break
            if accepts[state]:
                found = i + 1
        return found, i + 1

    def longest(self, data: bytes, at: int, end: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        return self.run(data, at, end)[0]

    def begins(self, data: bytes, start: int, end: int) -> list[int]:
        """Where matches begin, by one pass from the end; of the automaton of the reversed pattern."""
        state, rows, accepts, out = self.start, self.rows, self.accepts, []
        for i in range(end - 1, start - 1, -1):
            state = rows[state][data[i]]
            if accepts[state]:
                out.append(i)
        return out[::-1]


def compile_dfa(patterns: list[tuple[str, bool]], search: bool, backwards: bool = False) -> Dfa:
    """One minimal automaton for all patterns; with ``search`` a match may start at any byte.  ``backwards`` it reads the
    reversed texts of the patterns."""
    nfa = _Nfa()
    ends: dict[int, int] = {}
    starts = []
    for k, (pattern, fold) in enumerate(patterns):
        a, b = _Parser(pattern, nfa, fold).parse()
        starts.append(b if backwards else a)
        ends[a if backwards else b] = 1 << k
    if backwards:
        turned: list[list[tuple[frozenset | None, int]]] = [[] for _ in nfa.edges]
        for state, edges in enumerate(nfa.edges):
            for on, to in edges:
                turned[to].append((on, state))
        nfa.edges = turned
    signature: dict[tuple, list[int]] = {}
    sets = sorted({on for edges in nfa.edges for on, _ in edges if on is not None}, key=sorted)
    for byte in range(256):
        signature.setdefault(tuple(byte in s for s in sets), []).append(byte)
    byte_class = np.zeros(256, np.uint8)
    for k, members in enumerate(signature.values()):
        byte_class[members] = k
    samples = [members[0] for members in signature.values()]

    initial = nfa.closure(starts)
    index, todo, table = {initial: 0}, [initial], []
    while todo:
        states = todo.pop(0)
        row = []
        for byte in samples:
            moved = {to for s in states for on, to in nfa.edges[s] if on is not None and byte in on}
            target = nfa.closure(moved | set(starts)) if search else nfa.closure(moved)
            if target not in index:
                index[target] = len(index)
                todo.append(target)
            row.append(index[target])
        table.append(row)
    moves = np.array(table, np.int64)
    accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in index], np.int64)

    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        refined = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == group.max():
            break
        group = refined
    first = np.unique(group, return_index=True)[1]
    empty = index.get(frozenset())
    return Dfa(byte_class, group[moves[first]], accepts[first], int(group[0]), -1 if empty is None else int(group[empty]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.combined = compile_dfa([(r.seek or r.prefix + r.pattern, r.ignore_case) for r in rules], search=True)
        self.single = [compile_dfa([(r.prefix + r.pattern, r.ignore_case)], search=False) for r in rules]
        self.prefix = [compile_dfa([(r.prefix, r.ignore_case)], search=False) if r.prefix else None for r in rules]
        self.backward = [compile_dfa([(r.prefix + r.pattern, r.ignore_case)], search=True, backwards=True) for r in rules]
        self.first = [{b for b in range(256) if d.rows[d.start][b] != d.dead} for d in self.single]
        c = self.combined
        self.classes = c.table.shape[1]
        self.next = (c.table * self.classes).astype(np.int32).ravel()
        self.accepting = np.repeat(c.accepts.astype(np.uint32), self.classes)
        sync = (c.table == c.start).all(axis=0)
        pairs = (c.table[c.table] == c.start).all(axis=0)
        self.sync = sync[c.byte_class]
        self.sync_pair = pairs[c.byte_class][:, c.byte_class]
        if not self.sync[10]:
            raise ValueError("no rule may match a newline")

    def lanes(self, buffer: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, mask of rules that accepted) of each lane with an accepting byte."""
        resets = self.sync[buffer]
        resets[1:] |= self.sync_pair[buffer[:-1], buffer[1:]]
        stops = np.flatnonzero(resets) + 1
        aims = np.arange(LANE_BYTES, buffer.size + LANE_BYTES, LANE_BYTES)
        ends = np.unique(stops[np.minimum(np.searchsorted(stops, aims), stops.size - 1)])
        starts = np.concatenate([[0], ends[:-1]])
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        length = ends - starts
        classes = self.combined.byte_class[buffer]
        state = np.full(starts.size, self.combined.start * self.classes, np.int32)
        seen = np.zeros(starts.size, np.uint32)
        live = np.searchsorted(-length, -np.arange(length[0]), side="left") if length.size else []
        for t in range(int(length[0]) if length.size else 0):
            k = live[t]
            if k <= FEW_LANES:  # the last, long ones are quicker one by one
                for i in range(k):
                    seen[i] |= self._tail(int(state[i]) // self.classes, buffer[starts[i] + t : ends[i]].tobytes())
                break
            now = self.next[state[:k] + classes[starts[:k] + t]]
            state[:k] = now
            seen[:k] |= self.accepting[now]
        hit = np.flatnonzero(seen)
        return [(int(starts[i]), int(ends[i]), int(seen[i])) for i in hit]

    def _tail(self, state: int, data: bytes) -> int:
        """The rules that accept in the rest of a lane."""
        rows, accepts, seen = self.combined.rows, self.combined.accepts.tolist(), 0
        for byte in data:
            state = rows[state][byte]
            seen |= accepts[state]
        return seen

    def resolve(self, data: bytes, start: int, end: int, rule: int) -> Iterator[tuple[int, int]]:
        """Leftmost-longest, non-overlapping matches of one rule; too short ones are dropped.  Where tries that fail have
        read ``WASTE`` bytes, one pass from the end tells where matches begin, so that no further try fails: a run of
        beginnings costs in proportion to its length."""
        spec, dfa, first, at, wasted = self.rules[rule], self.single[rule], self.first[rule], start, 0
        begins: list[int] | None = None
        while at < end:
            if begins is not None:
                k = bisect_left(begins, at)
                if k == len(begins):
                    return
                at = begins[k]
            stop, seen = dfa.run(data, at, end) if data[at] in first else (-1, at)
            if stop < 0:
                wasted += seen - at
                if wasted > WASTE and begins is None:
                    begins = self.backward[rule].begins(data, at, end)
                at += 1
                continue
            begin = at if spec.whole else self.prefix[rule].longest(data, at, stop)
            if stop - begin >= spec.least:
                yield at, stop
            at = stop

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start byte, end byte, rule) of every span of every text, by start, then rule."""
        data = b"\n".join(texts) + b"\n"
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for start, end, mask in self.lanes(np.frombuffer(data, np.uint8)):
            # a lane may hold the end of one text and the start of others; a newline ends all matches
            for rule in range(len(self.rules)):
                if mask >> rule & 1:
                    for a, b in self.resolve(data, start, end, rule):
                        doc = int(np.searchsorted(offsets, a, side="right")) - 1
                        found[doc].append((a - int(offsets[doc]), b - int(offsets[doc]), rule))
        for spans in found:
            spans.sort(key=lambda s: (s[0], s[2]))
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def code_point_spans(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or len(text) == 0:
        return []
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), rule) for a, b, rule in spans]


def scan_column(column: pa.Array, rules: tuple[Rule, ...]) -> Iterator[list[tuple[int, int, int]]]:
    """Code-point spans of each value of a string column, block by block."""
    texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    for a, b in _blocks(texts):
        for text, spans in zip(texts[a:b], scanner(rules).scan(texts[a:b]), strict=True):
            yield code_point_spans(text, spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id and ``spans`` array<struct<kind, start, end>> in code points."""
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            spans = [[{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in s] for s in scan_column(batch.column(1), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span_type)], names=["id", "spans"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``df``; each stretch of overlapping spans in the text becomes
    ``[SECRET:kind]`` (of its first span).  Null texts stay null."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(scan_column(batch.column(at), rules)):
                if not spans:
                    continue
                out, done = [], 0
                for start, end, rule in spans:
                    if start >= done:
                        out += [texts[i][done:start], f"[SECRET:{rules[rule].kind}]"]
                    done = max(done, end)
                texts[i] = "".join([*out, texts[i][done:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of :func:`find_secrets` per row, as the query returns them."""
    kinds = [r.kind for r in BASE_RULES]
    order = F.array(*[F.lit(k) for k in kinds])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: F.array_contains(order, s["kind"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(df, id_col, text_col).select(
        id_col,
        *[count(k) for k in kinds],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
