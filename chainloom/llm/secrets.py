"""Secret scans: all rules in one automaton over bytes, one pass per text."""

from __future__ import annotations

import hashlib
import re._constants as op
import re._parser as parser
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from chainloom.llm.common import small_batches, tidy

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_names = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY]"
_assign = rf"""({_names})["']?\x20*[:=]\x20*["']?"""
_value = "[A-Za-z0-9+/_.=-]"

#: kind: (head, body, least length of the body, sign). A match is a head and a body. The sign is a short form that every match begins with, for the combined automaton: few counts
#: keep that small. Of two matches of a kind the one that begins first must have its sign end first.
BASE = {
    "assign": (_assign, rf"{_value}+", 6, rf"{_assign}{_value}"),
    "access": ("", r"AKIA[A-Z0-9]+", 20, r"AKIA[A-Z0-9]{4}"),
    "hex": ("", r"[0-9a-f]+", 24, r"[0-9a-f]{24}"),
}
_login = "[!-.0-9;-?A-~]"
#: Forms of published token formats that the base kinds don't cover.
MORE = {
    "private_key": ("", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "github": ("", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, r"gh[pousr]_[A-Za-z0-9]{4}"),
    "slack": ("", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, r"xox[abprs]-[A-Za-z0-9-]"),
    "google": ("", r"AIza[A-Za-z0-9_-]{35}", 0, r"AIza[A-Za-z0-9_-]{4}"),
    "jwt": ("", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    "url_login": ("", rf"[a-z]{{3,}}://[A-Za-z0-9_.-]*:{_login}{{3,}}@", 0, rf"[a-z]{{3,}}://[A-Za-z0-9_.-]*:{_login}+@"),
}
RULES = BASE | MORE


class Nfa:
    """States with empty steps and steps over sets of bytes, from parsed regexes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.over: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.over.append([])
        return len(self.empty) - 1

    def bytes_of(self, items) -> frozenset:
        out, negate = set(), False
        for kind, value in items:
            if kind is op.NEGATE:
                negate = True
            elif kind is op.LITERAL:
                out.add(value)
            elif kind is op.RANGE:
                out.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return frozenset(range(256)) - out if negate else frozenset(out)

    def add(self, tree, at: int, back: bool = False) -> int:
        """Appends a parsed regex, or its mirror image, to a state; the state where it ends."""
        for kind, value in reversed(list(tree)) if back else tree:
            if kind in (op.LITERAL, op.NOT_LITERAL, op.IN):
                step = self.bytes_of(value if kind is op.IN else [(op.NEGATE, None)] * (kind is op.NOT_LITERAL) + [(op.LITERAL, value)])
                to = self.state()
                self.over[at].append((step, to))
                at = to
            elif kind is op.SUBPATTERN:
                at = self.add(value[3], at, back)
            elif kind is op.BRANCH:
                end = self.state()
                for branch in value[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.add(branch, begin, back)].append(end)
                at = end
            elif kind is op.MAX_REPEAT:
                least, most, body = value
                for _ in range(least):
                    at = self.add(body, at, back)
                end = self.state()
                if most is op.MAXREPEAT:
                    begin = self.state()
                    self.empty[at] += [begin]
                    self.empty[begin].append(end)
                    self.empty[self.add(body, begin, back)].append(begin)
                else:
                    self.empty[at].append(end)
                    for _ in range(most - least):
                        at = self.add(body, at, back)
                        self.empty[at].append(end)
                at = end
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return at


def compile_rules(patterns: list[str], anywhere: bool = True, back: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(next state by state and byte, bits of the rules with a match ending there, the state without way on or -1) of the smallest automaton for all patterns, which finds
    matches anywhere or only from the first byte on, read forwards or backwards. State 0 begins."""
    nfa = Nfa()
    start, accept = nfa.state(), {}
    for k, p in enumerate(patterns):
        end = nfa.add(parser.parse(p), start if anywhere else nfa.empty[start].append(own := nfa.state()) or own, back)
        accept[end] = accept.get(end, 0) | 1 << k
    signature = [tuple(b in step for state in nfa.over for step, _ in state) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    of_byte, one = np.array([kinds[s] for s in signature]), [signature.index(s) for s in kinds]

    def closed(states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    again = {start} if anywhere else set()
    first = closed([start])
    number, rows, queue = {first: 0}, [], [first]
    for states in queue:
        row = []
        for b in one:
            to = closed({t for s in states for step, t in nfa.over[s] if b in step} | again)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        rows.append(row)
    table, mask = np.array(rows), np.array([sum(accept.get(s, 0) for s in states) for states in queue])
    block = np.unique(mask, return_inverse=True)[1]
    while True:  # split blocks until all states of one go to the same blocks
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    for b in block:
        if order[b] < 0:
            order[b] = order.max() + 1
    block = order[block]
    keep = np.unique(block, return_index=True)[1]
    table, mask = block[table[keep]], mask[keep]
    dead = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (mask == 0))
    return table[:, of_byte], mask, int(dead[0]) if len(dead) and not anywhere else -1


def _linked(compiled) -> list:
    """The first state of an automaton. A state holds the states that follow, by byte, then its rules' bits; None stands for no way on."""
    table, mask, dead = compiled
    rows = [[None] * 256 + [int(m)] for m in mask]
    for s, to in enumerate(table.tolist()):
        rows[s][:256] = [None if t == dead else rows[t] for t in to]
    return rows[0]


#: Bytes after which a scan looks whether it has met a match.
CHUNK = 4096


class Scanner:
    """All rules in one pass over the bytes: the combined automaton tells where the sign of which kind ends. From there the kind's own automata give the match: one that reads the
    sign backwards finds where it begins, one that reads the whole rule forwards where it ends, a third where its body begins."""

    def __init__(self, rules: dict = RULES, compiled: dict | None = None):
        compiled = compiled or compile_all(rules)
        self.kinds, self.least = list(rules), [r[2] for r in rules.values()]
        table, mask, _ = compiled["signs"]
        self.first = 0
        self.rows = [[None] * 256 + [int(m), s] for s, m in enumerate(mask)]
        self.once = [[None] * 256 + [int(m), s] for s, m in enumerate(mask)]  # the same, but a match holds the scan where it is
        for s, to in enumerate(table.tolist()):
            self.rows[s][:256] = [self.rows[t] for t in to]
            self.once[s][:256] = [self.once[t] for t in to] if not mask[s] else [self.once[s]] * 256
        self.back, self.whole, self.head = ([_linked(c) for c in compiled[k]] for k in ("back", "whole", "head"))

    def signs(self, data: bytes) -> list[tuple[int, int]]:
        """(end, bits of the kinds whose sign ends there). Only chunks with a sign are walked once more, for the places."""
        out, state = [], 0
        for i in range(0, len(data), CHUNK):
            chunk = data[i : i + CHUNK]
            # a state in which a sign ends would hold the scan at once; what follows it is the same as from its row
            row = self.once[state] if not self.rows[state][256] else None
            if row is not None:
                for b in chunk:
                    row = row[b]
                if not row[256]:
                    state = row[257]
                    continue
            row = self.rows[state]
            for at, b in enumerate(chunk, i + 1):
                row = row[b]
                if row[256]:
                    out.append((at, row[256]))
            state = row[257]
        return out

    @staticmethod
    def _longest(row: list, data: bytes, at: int) -> int:
        """Where the longest match from a place ends; -1: there is none."""
        end = at if row[256] else -1
        for i in range(at, len(data)):
            row = row[data[i]]
            if row is None:
                break
            if row[256]:
                end = i + 1
        return end

    def _begins(self, kind: int, data: bytes, end: int, floor: int) -> list[int]:
        """Where signs begin that end at a place, from the left, none before `floor`."""
        row, out = self.back[kind], []
        for i in range(end - 1, floor - 1, -1):
            row = row[data[i]]
            if row is None:
                break
            if row[256]:
                out.append(i)
        return out[::-1]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind, end) by code point, leftmost longest matches that don't overlap of each kind, short ones dropped."""
        out, done = [], [0] * len(self.kinds)
        for end, bits in self.signs(data):
            for k in range(bits.bit_length()):
                if bits >> k & 1 and end > done[k]:
                    for s in self._begins(k, data, end, done[k]):
                        if (e := self._longest(self.whole[k], data, s)) > 0:
                            if e - self._longest(self.head[k], data, s) >= self.least[k]:
                                out.append((s, k, e))
                            done[k] = e
                            break
        if out and not data.isascii():
            place = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])
            out = [(int(place[s]), k, int(place[e])) for s, k, e in out]
        return sorted(out)


def compile_all(rules: dict) -> dict:
    own = lambda patterns, back=False: [compile_rules([p], False, back) for p in patterns]
    return {"signs": compile_rules([r[3] for r in rules.values()]), "back": own([r[3] for r in rules.values()], True), "whole": own([r[0] + r[1] for r in rules.values()]), "head": own([r[0] for r in rules.values()])}


@lru_cache(1)
def automaton() -> dict:
    return compile_all(RULES)


_own: dict[str, Scanner] = {}


def scanner(compiled) -> Scanner:
    """One for each worker process, kept between tasks; the driver compiles the rules and broadcasts their tables."""
    if "it" not in _own:
        _own["it"] = Scanner(RULES, compiled.value)
    return _own["it"]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans ("kind:start:end", comma-joined) of each row of `docs`. No shuffle.

    The combined automaton reads every byte once and says where a kind's sign ends; the kind's own automata give the exact span from there.

    Cases: null or empty text: no spans. Repeated rows and null ids: scanned alike. Texts of any length are scanned whole. Empty table: no rows. Other columns are ignored."""
    small_batches(docs.sparkSession)
    schema = StructType([docs.select(docs[doc_id].alias("doc_id")).schema[0]])
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, LongType())
    schema = schema.add("base_sha256", StringType()).add("spans", StringType())

    compiled = docs.sparkSession.sparkContext.broadcast(automaton())

    def scanned(batches):
        import pyarrow as pa

        s = scanner(compiled)
        joined = lambda spans: ",".join(f"{s.kinds[k]}:{a}:{b}" for a, k, b in spans)
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for value in batch.column(1).cast(pa.large_binary()):
                spans = s.spans(value.as_py() or b"")
                base = [x for x in spans if x[1] < len(BASE)]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest() if base else none, joined(spans)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=schema.names)

    return docs.select(docs[doc_id], docs[text]).mapInArrow(tidy(scanned), schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of their texts replaced by a mark, overlapping spans by one.

    Cases: null texts stay null, empty ones empty. Repeated rows: alike. Very long texts: whole. Empty table: no rows. Other columns are kept."""
    small_batches(docs.sparkSession)
    compiled = docs.sparkSession.sparkContext.broadcast(automaton())

    def redacted(batches):
        import pyarrow as pa

        s = scanner(compiled)
        for batch in batches:
            i = batch.schema.get_field_index(text)
            out = []
            for value in batch.column(i):
                value = value.as_py()
                spans, at, parts = s.spans(value.encode()) if value else [], 0, []
                for a, _, b in spans:
                    if a >= at:
                        parts += [value[at:a], mark]
                    at = max(at, b)
                out.append("".join(parts) + value[at:] if value else value)
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return docs.mapInArrow(tidy(redacted), docs.schema)
